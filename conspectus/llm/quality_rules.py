"""Quality rules: word and repetition counts, and compression bands.

A text's zstandard ratio (bytes by compressed bytes) says how repetitive it is. It grows with length, so each
length class has its own band. The whole text and its chunks of fixed size are held against the bands: text
above its band is repetitive, below it is noise (encoded bytes, random characters).

Defined results: a null text is an empty one (all counts 0, not kept); a text of any length is measured whole,
chunk by chunk; equal texts get equal rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, small_batches
from .tokens import LINES, WORDS, per_text, shingles, slices, string_bytes, tokenise

# (bytes from, least ratio, greatest ratio); shorter texts have no band
BANDS = (
    (64, 0.60, 2.2),
    (128, 0.85, 2.8),
    (256, 1.10, 3.0),
    (512, 1.25, 3.2),
    (1024, 1.35, 3.4),
    (2048, 1.40, 3.6),
    (4096, 1.45, 3.8),
    (8192, 1.50, 4.2),
    (32768, 1.50, 4.8),
)
CHUNK = 4096
BAD_CHUNKS = 0.25

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, bad_chunks long, n_chunks long, verdict string, kept boolean"
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, np.int64)
_LEAD[0x80:0xC0] = 0  # continuation bytes


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """(least, greatest) ratio for a text of so many bytes; no limits under the first class."""
    low, high = 0.0, float("inf")
    for start, a, b in bands:
        if n_bytes >= start:
            low, high = a, b
    return low, high


def compression_verdict(data: bytes, compressor, bands=BANDS, chunk=CHUNK, bad_share=BAD_CHUNKS) -> tuple[float, int, int, str]:
    """(ratio, chunks outside their band, chunks, verdict) of one text."""
    n = len(data)
    ratio = n / len(compressor.compress(data)) if n else 1.0
    low, high = band(n, bands)
    over = under = chunks = 0
    if n > chunk:
        for a in range(0, n, chunk):
            part = data[a : a + chunk]
            lo, hi = band(len(part), bands)
            r = len(part) / len(compressor.compress(part))
            over += r > hi
            under += r < lo
            chunks += 1
    if ratio > high or chunks and over > bad_share * chunks:
        return ratio, over + under, chunks, "repetitive"
    if ratio < low or chunks and under > bad_share * chunks:
        return ratio, over + under, chunks, "incompressible"
    return ratio, over + under, chunks, "kept"


def counts(raw: np.ndarray, bounds: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The base counts of each text of an Arrow string column's bytes."""
    n = len(bounds) - 1
    starts, ends, hashes = tokenise(raw, bounds, WORDS)
    at = per_text(starts, bounds)
    lead = np.r_[0, np.cumsum(_LEAD[raw])]
    chars = np.r_[0, np.cumsum(lead[ends] - lead[starts])]
    symbols = np.r_[0, np.cumsum(_SYMBOLS[raw])]
    ls, le, lh = tokenise(raw, bounds, LINES)
    worded = np.searchsorted(starts, le, "left") > np.searchsorted(starts, ls, "left")
    text_of = np.searchsorted(bounds, ls, "right") - 1
    text_of, lh = text_of[worded], lh[worded]
    lines = np.bincount(text_of, minlength=n)
    if len(lh):
        order = np.lexsort((lh, text_of))
        new = np.r_[True, (text_of[order][1:] != text_of[order][:-1]) | (lh[order][1:] != lh[order][:-1])]
        distinct = np.bincount(text_of[order][new], minlength=n)
    else:
        distinct = np.zeros(n, np.int64)
    repeated = np.zeros(n, np.int64)
    if len(hashes) >= window:
        sh = shingles(hashes, window)
        owner = np.searchsorted(at, np.arange(len(sh)), "right") - 1
        inside = np.arange(len(sh)) + window <= at[owner + 1]
        pos = np.flatnonzero(inside)
        order = pos[np.lexsort((sh[pos], owner[pos]))]
        if len(order) > 1:
            same = (sh[order][1:] == sh[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            twice = order[np.r_[same, False] | np.r_[False, same]]
            cover = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + window, -1)
            covered = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
            repeated = covered[at[1:]] - covered[at[:-1]]
    return {
        "n_words": at[1:] - at[:-1],
        "word_chars": chars[at[1:]] - chars[at[:-1]],
        "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]],
        "n_dup_lines": lines - distinct,
        "n_repeat_words": repeated,
    }


def quality_rules(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_CHUNKS, level: int = 3, min_words: int = 20, max_repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """``keep`` columns of each row with the columns of ``SCHEMA``; one row in, one row out, no shuffle."""
    small_batches(df.sparkSession)
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    columns, work, schema, names = carried(df, keep, *made)
    picked = df.select(*columns, F.col(text_col).cast("string").alias("__text"))

    def rows(batches):
        z = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            raw, bounds = string_bytes(batch.column(len(keep)))
            for a, b in slices(bounds):
                part, own = raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                c = counts(part, own, window)
                failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
                found = [compression_verdict(part[own[i] : own[i + 1]].tobytes(), z, bands, chunk, bad_share) for i in range(b - a)]
                verdict = ["base" if f else v[3] for f, v in zip(failed, found, strict=True)]
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                arrays += [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                arrays += [pa.array(failed), pa.array([v[0] for v in found], pa.float64()), pa.array([v[1] for v in found], pa.int64()), pa.array([v[2] for v in found], pa.int64()), pa.array(verdict, pa.string()), pa.array([v == "kept" for v in verdict])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*work, *made])

    return picked.mapInArrow(rows, f"{schema}{SCHEMA}").toDF(*names)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
