"""Document fingerprints by Order MinHash.

A text is the sequence of its k-word shingles, each numbered by its occurrence. For each of ``SKETCHES`` hash
functions the ``ELL`` shingles of least hash are taken and, in the order in which they stand in the text, hashed
together. Two texts share an entry if they share those shingles in the same order, so the share of equal entries
falls with edit distance, moved passages included.

Defined results: a null text is the empty one; all empty texts have one fingerprint, unlike that of any other
text; a text under k words is one shingle; a text of one shingle gives tuples of one. Texts are read whole.
Equal ids are ordered by text, null ids come last; in a table of one document it is its own successor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import carried, small_batches
from .tokens import WORDS, mix, occurrence, string_bytes, text_shingles, tokenise

K = 5
ELL = 2
SKETCHES = 64
_BLOCK = 4096

_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(values: np.ndarray, sketches: int, ell: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the ``ell`` least entries under each of ``sketches`` hash functions."""
    n = len(values)
    best_h = np.zeros((sketches, 0), np.uint64)
    best_p = np.zeros((sketches, 0), np.int64)
    rows = np.arange(sketches)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for a in range(0, n, _BLOCK):
        h = (values[None, a : a + _BLOCK] ^ _XOR[:sketches, None]) * _ODD[:sketches, None]
        for _ in range(min(ell, h.shape[1])):
            p = h.argmin(1)
            best_h = np.concatenate([best_h, h[rows, p][:, None]], 1)
            best_p = np.concatenate([best_p, (p + a)[:, None]], 1)
            h[rows, p] = top
        if best_h.shape[1] > ell:
            order = np.argsort(best_h, 1, kind="stable")[:, :ell]
            best_h, best_p = np.take_along_axis(best_h, order, 1), np.take_along_axis(best_p, order, 1)
    return best_p, best_h


def sketch(data: bytes, k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint's entries (uint32) of a UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    words = tokenise(raw, np.array([0, len(raw)]), WORDS)[2]
    sh = text_shingles(words, k)
    if not len(sh):
        return np.zeros(sketches, np.uint32)
    values = mix(sh + occurrence(sh).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    pos, _ = _least(values, sketches, ell)
    pos = np.sort(pos, 1)
    out = _XOR[:sketches].copy()
    for j in range(pos.shape[1]):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + values[pos[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries."""
    return float(np.mean(a == b))


def fingerprint_text(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> DataFrame:
    """``keep`` columns and the fingerprint of each row's whole text; no shuffle."""
    small_batches(df.sparkSession)
    columns, work, schema, names = carried(df, keep, "fingerprint")
    picked = df.select(*columns, F.col(text_col).cast("string").alias("__text"))

    def rows(batches):
        for batch in batches:
            raw, bounds = string_bytes(batch.column(len(keep)))
            out = [fingerprint_text(sketch(raw[bounds[i] : bounds[i + 1]].tobytes(), k, ell, sketches)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*work, "fingerprint"])

    return picked.mapInArrow(rows, f"{schema}fingerprint string").toDF(*names)


def edited(text: str, following: str) -> str:
    """``text`` with its last third (code points, rounded down) replaced by the head of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_descending_ranges(df: DataFrame, id_col: str, rows_each: int) -> tuple[DataFrame, int]:
    """Deals rows by descending id to ranges of about ``rows_each`` rows, adding ``__part``.

    Each range also gets, as ``__halo`` rows, the first row of the range that follows it (the first range's, after
    the last). What reaches the driver is one boundary and one id per range. The rows travel once.
    """
    total, nulls = df.select(F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    parts = max(1, min(4000, -(-total // rows_each)))  # so that the boundaries stay a small literal
    cuts: list = []
    if total > nulls:
        found = df.select(F.percentile_approx(id_col, [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0]
        cuts = sorted(set(found), reverse=True) if parts > 1 else []
    # rows with an id over a cut stand before it; ids equal to a cut open the range after it
    part = F.lit(0)
    if cuts:
        known = F.array(*[F.lit(c) for c in reversed(cuts)])
        part = F.size(F.filter(known, lambda c: c >= F.col(id_col)))
    part = F.when(F.col(id_col).isNull(), F.lit(len(cuts))).otherwise(part).cast("int")
    dealt = df.withColumn("__part", part)
    firsts = {r["__part"]: (r["id"], r["n"]) for r in dealt.groupBy("__part").agg(F.max(id_col).alias("id"), F.count("*").alias("n")).collect()}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    ids = [firsts[p][0] for p in order]
    heads = dealt.where(F.col(id_col).isin([i for i in ids if i is not None]) | (F.col(id_col).isNull() if None in ids else F.lit(False)))
    one = Window.partitionBy("__part").orderBy(F.col(id_col).desc_nulls_last(), *[F.col(c) for c in df.columns if c != id_col])
    at = {p: n for n, p in enumerate(order)}
    goes = F.create_map(*[F.lit(x) for p in order for x in (p, at[before[p]])]) if order else None
    home = F.create_map(*[F.lit(x) for p in order for x in (p, at[p])]) if order else None
    if not order:
        return dealt.withColumn("__halo", F.lit(False)), 1
    halo = heads.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n").withColumn("__part", goes[F.col("__part")]).withColumn("__halo", F.lit(True))
    return dealt.withColumn("__part", home[F.col("__part")]).withColumn("__halo", F.lit(False)).unionByName(halo), len(order)


OP8_SCHEMA = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 2000, k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints of each text and of its edit by the text that follows in descending id order.

    Rows are dealt to id ranges once and sorted there; a task streams its range and holds two texts at a time.
    """
    small_batches(df.sparkSession, 256)
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt, parts = in_descending_ranges(base, "doc_id", rows_each)
    placed = dealt.repartitionById(parts, "__part").sortWithinPartitions(F.col("__halo"), F.col("doc_id").desc_nulls_last(), F.col("text"))

    def rows(batches):
        held = None
        out: list[tuple] = []
        for batch in batches:
            ids, texts, halos = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for i, text, halo in zip(ids, texts, halos, strict=True):
                text = text or ""
                entries = sketch(text.encode(), k, ell, sketches)
                if held is not None:
                    j, t, e = held
                    changed = edited(t, text).encode()
                    entries2 = sketch(changed, k, ell, sketches)
                    out.append((j, len(t), hashlib.sha256(changed).hexdigest(), fingerprint_text(e), fingerprint_text(entries2), likeness(e, entries2), likeness(e, entries)))
                held = None if halo else (i, text, entries)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kinds)
                out = []

    id_type = base.schema["doc_id"].dataType
    names = [x.split()[0] for x in OP8_SCHEMA.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = pa.schema(list(zip(names, [to_arrow_type(id_type), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))
    return placed.select("doc_id", "text", "__halo").mapInArrow(rows, OP8_SCHEMA.format(id=id_type.simpleString()))


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    return with_successor(spark.read.parquet(f"{sf_dir}/documents.parquet"))
