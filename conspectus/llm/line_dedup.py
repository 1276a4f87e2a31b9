"""Line dedup by winnowing over line hashes, and over runs of words for passages that stand inside lines.

A run is a stretch of consecutive lines of one text with at least ``MIN_WORDS`` words. For every line the shortest run
that begins with it and the shortest that ends with it are its windows; each window selects its least line hash (the
last of equals). The selected positions, and nothing else, are the fingerprints: a run that occurs twice holds a whole
window, the same in both places, so both places select the same line. Positions are joined on their fingerprints;
about each position that has a fellow its windows are compared by content (128 bits). Of equal windows the first, by id
and line, stays; the others, united, extend the match both ways as far as the texts agree. Hence:

    a line is deleted if and only if it lies in a run whose lines, in this order, occur earlier in the corpus
    (in a text of smaller id, or before in the same text without overlap).

Lines alone miss a passage that begins or ends inside a line. So each stretch of ``MIN_WORDS`` words selects its least
run of ``GRAM`` words likewise, and runs are joined on their hash and on that of all stretches that select them: what is
alike in both repeats the first of its kind as a whole. Where a run also stands in other stretches, those about the first
of each kind are compared by content (126 bits), as the windows of lines are. Hence:

    a word is deleted too if and only if it lies in a stretch of ``MIN_WORDS`` words whose first occurrence in the corpus
    is in an earlier text, or ``MIN_WORDS`` words or more before in the same one.

White space between words does not count. A line that loses all its words goes, and so do the empty lines between
two deleted words; a line that loses some keeps the rest.

No pair of occurrences is formed: each position meets the first of its kind only, so a passage that very many texts
share costs a row per occurrence.

Defined results: a null text stays null and has no lines; an empty text is one empty line; rows of equal id and
text are one document and keep the same lines; null ids rank last; shorter repeated runs (licences, greetings) stay;
a text whose lines all go becomes empty. Lines are equal if all their bytes are.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, free_names, small_batches, written
from .tokens import WORDS, mix, shingles, slices, stretches, string_bytes, tokenise

MIN_WORDS = 50
GRAM = 8


def line_windows(raw: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, tokens: tuple | None = None) -> dict[str, np.ndarray]:
    """Windows of the texts: text (row), first, last and selected line, begin and end (bytes) and the selected hash.

    A line's hash is that of its words, so that equal lines have equal ones; tokens: the texts' words, if known.
    """
    word_starts, _, word_hashes = tokens or tokenise(raw, bounds, WORDS)
    newline = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([bounds[:-1], newline + 1]), kind="stable")
    text = np.sort(np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, newline, "right") - 1]), kind="stable")
    # lines of text i: its start, and after each of its newlines
    end = np.empty_like(begin)
    last = np.r_[text[1:] != text[:-1], True]
    end[~last] = begin[1:][~last[:-1]] - 1
    end[last] = bounds[1:][text[last]]
    word0, word1 = np.searchsorted(word_starts, begin), np.searchsorted(word_starts, end)
    line_hash = stretches(word_hashes, word0, word1)
    words = np.r_[0, np.cumsum(word1 - word0)]
    n = len(begin)
    line0 = np.searchsorted(text, np.arange(len(bounds) - 1), "left")  # first line of each text
    line1 = np.searchsorted(text, np.arange(len(bounds) - 1), "right")
    at = np.arange(n)
    to = np.searchsorted(words[1:], words[:-1] + min_words, "left")
    forward = to < line1[text]
    back = np.searchsorted(words, words[1:] - min_words, "right") - 1
    backward = (words[1:] >= min_words) & (back >= line0[text])
    a, b = np.concatenate([at[forward], back[backward]]), np.concatenate([to[forward], at[backward]])
    if not len(a):
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("text", "first", "last", "selected", "begin", "end"), none) | {"mark": np.zeros(0, np.uint64)}
    two = np.unique(np.stack([a, b], 1), axis=0)
    a, b = two[:, 0], two[:, 1]
    # least line hash of each window by a sparse table: powers of two, the last of equals
    longest = int((b - a).max()) + 1
    levels = [np.arange(n)]
    width = 1
    while width * 2 <= longest:
        p, q = levels[-1][: n - 2 * width + 1], levels[-1][width : n - width + 1]
        levels.append(np.where(line_hash[q] <= line_hash[p], q, p))
        width *= 2
    level = np.log2(b - a + 1).astype(np.int64)
    selected = np.empty(len(a), np.int64)
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        p, q = levels[k][a[own]], levels[k][b[own] - (1 << int(k)) + 1]
        selected[own] = np.where(line_hash[q] <= line_hash[p], q, p)
    first = line0[text[a]]
    return {"text": text[a], "first": a - first, "last": b - first, "selected": selected - first, "begin": begin[a], "end": end[b], "mark": line_hash[selected]}


def line_marks(raw: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, tokens: tuple | None = None) -> dict[str, np.ndarray]:
    """Positions that the windows select: text (row), at (line) and mark."""
    w = line_windows(raw, bounds, min_words, tokens)
    _, once = np.unique((w["text"] << 32) | w["selected"], return_index=True)
    return {"text": w["text"][once], "at": w["selected"][once], "mark": w["mark"][once]}


def word_marks(bounds: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], min_words: int = MIN_WORDS, size: int = GRAM) -> dict[str, np.ndarray]:
    """Selected runs of ``size`` words: text (row), at (first word), mark, the first words lo to hi of the stretches of
    ``min_words`` that select it, about: a hash of all words of these stretches, and sides: hashes (32 bits each) of the
    run with the words before it and with those after it, as many as any stretch holds on one side at least.

    What stands in these stretches tells which of its runs they select, so equal ones select it at the same place.
    """
    starts, _, hashes = tokens
    size = min(size, min_words)
    span = min_words - size + 1
    g = shingles(hashes, size)
    edge = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(edge))
    # least run of each stretch: hash (of equals the last) and place in one number, by powers of two
    best = ((g >> np.uint64(32)) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(g), dtype=np.uint64))
    width = 1
    while width * 2 <= span and len(best) > width:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    a = np.flatnonzero(text[min_words - 1 :] == text[: max(0, len(text) - min_words + 1)])
    at = lo = hi = a
    if len(a):
        least = np.minimum(best[a], best[a + span - width])
        # the selected places rise with the stretches, so those of one place adjoin
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        at = (np.uint64(0xFFFFFFFF) - (least[new] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        lo, hi = a[new], a[np.r_[new[1:], len(a)] - 1]
    first, half = edge[text[at]], _half(min_words)
    near = np.maximum(first, at - half), np.minimum(edge[text[at] + 1], at + size + half)
    about, left, right = np.split(stretches(hashes, np.concatenate([lo, near[0], at]), np.concatenate([hi + min_words, at + size, near[1]])), 3)
    sides = (left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))
    return {"text": text[at], "at": at - first, "mark": g[at], "lo": lo - first, "hi": hi - first, "about": about, "sides": sides}


def _half(min_words: int) -> int:
    return (min_words - min(GRAM, min_words)) // 2


_PLACE = "`__id` {id}, `__node` long"


def _place(df: DataFrame) -> str:
    return _PLACE.format(id=df.schema["__id"].dataType.simpleString())


def fingerprints(base: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __node, words, mark, at, lo, hi, about, sides): the selected lines and runs of words of (__id, __node, __text)."""

    def rows(batches):
        for batch in batches:
            raw, bounds = string_bytes(batch.column(2))
            for x, y in slices(bounds):
                part, own = raw[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x]
                tokens = tokenise(part, own, WORDS)
                for words, found in ((False, line_marks(part, own, min_words, tokens)), (True, word_marks(own, tokens, min_words))):
                    row, n = pa.array(found["text"] + x), len(found["text"])
                    more = [found.get(k, np.zeros(n, np.int64)).astype(np.int32) for k in ("at", "lo", "hi")]
                    hashes = [found.get(k, np.zeros(n, np.uint64)).view(np.int64) for k in ("about", "sides")]
                    arrays = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(n, words)), pa.array(found["mark"].view(np.int64)), *map(pa.array, [*more, *hashes])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["__id", "__node", "words", "mark", "at", "lo", "hi", "about", "sides"])

    return base.select("__id", "__node", "__text").mapInArrow(rows, f"{_place(base)}, words boolean, mark long, at int, lo int, hi int, about long, sides long")


def _first(at: str) -> Column:
    return F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__node").alias("node"), F.col(at).alias("at"))).alias("own")


def _later(at: str, length: Column) -> Column:
    """Whether a place stands in another text than ``own``, or ``length`` or more after it."""
    other = ~(F.col("__id").eqNullSafe(F.col("own.id")) & (F.col("__node") == F.col("own.node")))
    return other | (F.col(at) - F.col("own.at") >= length)


def repeated_marks(marks: DataFrame) -> DataFrame:
    """Positions whose mark occurs again, with ``own``: the first of them, and ``alike``: whether all have one ``about``."""
    alike = (F.min("about") == F.max("about")).alias("alike")
    first = marks.groupBy("mark", "words").agg(_first("at"), alike, F.count("*").alias("times")).where("times > 1")
    # written, so that the join below reads two plain exchanges and its hot keys can be split
    first = written(first.select("mark", "words", "own", "alike"), "owners")
    return marks.join(first.hint("shuffle_hash"), ["mark", "words"])


def apart_marks(hits: DataFrame) -> DataFrame:
    """Runs of words whose mark also stands in other stretches, with ``own``: the first of those with their ``about``."""
    apart = hits.where("not alike").drop("own")
    first = written(apart.groupBy("mark", "about").agg(_first("at")), "owners")
    return apart.join(first.hint("shuffle_hash"), ["mark", "about"])


def line_requests(hits: DataFrame) -> DataFrame:
    """(of, of_node, lines): the lines of each document about which its windows are wanted. hits: (__id, __node, at)."""
    return hits.groupBy(F.col("__id").alias("of"), F.col("__node").alias("of_node")).agg(F.collect_set("at").alias("lines"))


def part_requests(apart: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(of, of_node, parts): for each document the stretches (first words lo to hi) about those of its runs of words that
    repeat none with the same ``about``. Whether a stretch of theirs occurs under another, its content tells.

    A stretch holds the ``_half`` words before its run, or else those after it; where no other of these runs has the same,
    it has no equal and is left out.
    """
    met = apart.where(~_later("at", F.lit(min_words)))
    turn = F.col("at") - (min_words - min(GRAM, min_words) - _half(min_words))
    before = F.struct(F.xxhash64(F.lit(0), "mark", F.shiftright("sides", 32)).alias("side"), "lo", F.least("hi", turn - 1).alias("hi"))
    after = F.struct(F.xxhash64(F.lit(1), "mark", F.shiftleft("sides", 32)).alias("side"), F.greatest("lo", turn).alias("lo"), "hi")
    sides = met.select("__id", "__node", F.explode(F.array(before, after)).alias("x")).select("__id", "__node", "x.*").where("lo <= hi")
    # written, so that the join below reads two plain exchanges and its hot keys can be split
    again = written(sides.groupBy("side").agg(F.count("*").alias("times")).where("times > 1").select("side"), "sides")
    wanted = sides.join(again.hint("shuffle_hash"), "side")
    return wanted.groupBy(F.col("__id").alias("of"), F.col("__node").alias("of_node")).agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))


def later_parts(hits: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __node, first, last): all words about the runs that repeat one with the same ``about``."""
    return hits.where(_later("at", F.lit(min_words))).select("__id", "__node", F.col("lo").alias("first"), (F.col("hi") + (min_words - 1)).alias("last"))


def answers(base: DataFrame, lines: DataFrame, parts: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The windows (__id, __node, first, last, content) asked for: those of lines and those of words.

    The texts travel once for both.
    """
    asked = lines.unionByName(parts, allowMissingColumns=True).groupBy("of", "of_node").agg(F.first("lines", True).alias("lines"), F.first("parts", True).alias("parts"))
    asked = written(asked, "asked")
    same = base["__id"].eqNullSafe(asked["of"]) & (base["__node"] == asked["of_node"])
    met = base.join(asked.hint("shuffle_hash"), same).select("__id", "__node", "__text", "lines", F.col("parts.lo").alias("lo"), F.col("parts.hi").alias("hi"))

    def rows(batches):
        for batch in batches:
            raw, bounds = string_bytes(batch.column(2))
            edges = [np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy())] for k in (3, 4)]
            hit, lo, hi = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (3, 4, 5))
            for x, y in slices(bounds):
                part, own = raw[bounds[x] : bounds[y]], bounds[x : y + 1] - bounds[x]
                tokens = tokenise(part, own, WORDS)
                (a, b), (c, d) = ((e[x], e[y]) for e in edges)
                w = line_windows(part, own, min_words, tokens)
                wanted = (np.repeat(np.arange(y - x), np.diff(edges[0][x : y + 1])) << 32) | hit[a:b]
                near = np.flatnonzero(np.isin((w["text"] << 32) | w["selected"], wanted))
                content = [hashlib.blake2b(part[i:j].tobytes(), digest_size=16).digest() for i, j in zip(w["begin"][near].tolist(), w["end"][near].tolist(), strict=True)]
                # of words: the stretches from lo to hi, one after another
                many = hi[c:d] - lo[c:d] + 1
                text = np.repeat(np.repeat(np.arange(y - x), np.diff(edges[1][x : y + 1])), many)
                first = np.repeat(hi[c:d] + 1 - np.cumsum(many), many) + np.arange(many.sum())
                at = np.searchsorted(tokens[0], own)[text] + first
                two = [stretches(h, at, at + min_words) for h in (tokens[2], mix(~tokens[2]))]
                digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(np.stack(two, 1).tobytes())]).cast(pa.binary())
                for words, row, begun, last, found in ((False, w["text"][near], w["first"][near], w["last"][near], pa.array(content, pa.binary())), (True, text, first, first + min_words - 1, digest)):
                    row = pa.array(row + x)
                    places = [pa.array(v.astype(np.int32)) for v in (begun, last)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(len(row), words)), *places, found], names=["__id", "__node", "words", "first", "last", "content"])

    found = written(met.mapInArrow(rows, f"{_place(base)}, words boolean, first int, last int, content binary"), "found")
    return found.where("not words").drop("words"), found.where("words").drop("words")


def later_windows(windows: DataFrame) -> DataFrame:
    """(__id, __node, first, last) of windows that are not the first of their content and do not overlap it."""
    owner = windows.groupBy("content").agg(_first("first"), F.count("*").alias("times")).where("times > 1")
    # written, so that the join below reads two plain exchanges and its hot keys can be split
    met = windows.join(written(owner.select("content", "own"), "owners").hint("shuffle_hash"), "content")
    return met.where(_later("first", F.col("last") - F.col("first") + 1)).select("__id", "__node", "first", "last")


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last + 1, -1)
    return np.cumsum(cover)[:n] > 0


def without(text: str, cut: np.ndarray, tokens: tuple[np.ndarray, np.ndarray] | None = None, gone: np.ndarray | None = None) -> tuple[str, int]:
    """``text`` without the lines of ``cut`` and the ``gone`` of its words (starts, ends); the number of lines that went."""
    lines = text.split("\n")
    if gone is not None and gone.any():
        data = text.encode()
        newline = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        starts, ends = tokens
        begin, end = np.r_[0, newline + 1], np.r_[newline, len(data)]
        line = np.searchsorted(newline, starts)
        for i in np.flatnonzero(gone[1:] & gone[:-1] & (line[1:] > line[:-1] + 1)):
            cut[line[i] + 1 : line[i + 1]] = True
        n = np.bincount(line, minlength=len(lines))
        lost = np.bincount(line, gone, minlength=len(lines))
        cut |= (n > 0) & (lost == n)
        for k in np.flatnonzero((lost > 0) & ~cut):
            x, y = np.searchsorted(line, [k, k + 1])
            parts, at = [], begin[k]
            edges = np.flatnonzero(np.diff(np.r_[False, gone[x:y], False].astype(np.int8)))
            for i, j in zip(x + edges[::2], x + edges[1::2], strict=True):  # words i to j - 1
                parts.append(data[at : starts[i] if j < y else ends[i - 1]])
                at = starts[j] if j < y else ends[j - 1]
            lines[k] = b"".join([*parts, data[at : end[k]]]).decode()
    return "\n".join(x for x, c in zip(lines, cut.tolist(), strict=True) if not c), int(cut.sum())


def freed(text: str, lines: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]) -> tuple[str, int]:
    """``text`` freed of the runs (first, last) of its lines and of its words."""
    cut = _covered(text.count("\n") + 1, *lines)
    if not len(words[0]) or cut.all():
        return without(text, cut)
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = tokenise(raw, np.array([0, len(raw)]), WORDS)
    return without(text, cut, (starts, ends), _covered(len(starts), *words))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with its text freed of repeated runs, and columns n_lines and n_removed added (named freely if taken)."""
    n_lines, n_removed, node, runs, parts, own, own_node = free_names(df, "n_lines", "n_removed", "__node", "__runs", "__parts", "__own", "__own_node")
    small_batches(df.sparkSession, 512)
    number: Column = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = df.select(F.col(id_col).alias("__id"), number.alias("__node"), F.col(text_col).cast("string").alias("__text"))
    marks = written(fingerprints(base, min_words), "marks")
    hits = written(repeated_marks(marks), "hits")
    forget(marks)
    apart = written(apart_marks(hits), "apart")
    # equal windows of rows of equal id and text are one
    windows, stretched = answers(base, line_requests(hits.where("not words").select("__id", "__node", "at")), part_requests(apart, min_words), min_words)
    found = [(runs, later_windows(windows)), (parts, later_windows(stretched)), (parts, later_parts(hits.where("words and alike"), min_words)), (parts, later_parts(apart, min_words))]
    ranges = [x.select(F.col("__id").alias(own), F.col("__node").alias(own_node), F.struct("first", "last").alias(c)) for c, x in found]
    gone = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranges)
    gone = written(gone.groupBy(own, own_node).agg(F.collect_set(runs).alias(runs), F.collect_set(parts).alias(parts)), "gone")
    forget(hits, apart)
    wide = df.withColumn(node, number)
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(node) == F.col(own_node))
    joined = wide.join(gone.hint("shuffle_hash"), same, "left")
    joined = joined.select(*df.columns, *(F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in (runs, parts) for k in ("first", "last")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{n_lines}` long, `{n_removed}` long"
    columns = list(df.columns)
    at = columns.index(text_col)
    wide_n = len(columns)

    def rows(batches):
        for batch in batches:
            column, ranges = batch.column(at), [batch.column(wide_n + k) for k in range(4)]
            raw, bounds = string_bytes(column)
            newlines = np.flatnonzero(raw == 10)
            total = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(np.searchsorted(newlines, bounds)) + 1, 0)
            hit = pc.and_(ranges[0].is_valid(), column.is_valid())
            out, removed = [], np.zeros(batch.num_rows, np.int64)
            given = [(x.flatten().to_numpy(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy())]) for x in ranges]
            for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist():
                mine = [v[e[i] : e[i + 1]] for v, e in given]
                text, removed[i] = freed(column[i].as_py(), mine[:2], mine[2:])
                out.append(text)
            arrays = [pc.replace_with_mask(column, hit, pa.array(out, column.type)) if i == at else batch.column(i) for i in range(wide_n)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total.astype(np.int64)), pa.array(removed)], names=[*columns, n_lines, n_removed])

    return joined.mapInArrow(rows, schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
