"""Variable-capacity best-fit packing of documents into sequences.

Several sequence lengths are permitted and priced by ``cost``: tokens, their share of attention (which grows with
the square of the length) and a fixed charge. Pieces are placed in order of falling size, each in the open bin that
it fills best. If none has room, the length with the least cost per token it can expect to hold opens, where a bin
expects the piece and what else is still to be placed, at most its capacity; so lengths are chosen jointly, and the
last bins are small. In the end each bin shrinks to the least permitted length that holds its contents.

Rows are dealt evenly to shards by their number in a written table of ids and sizes, so that rows of one id, or
without one, are spread too; each shard is packed by one task. Only ids and sizes travel, and a shard wastes less than
a few bins. Longer documents than the greatest length are cut into pieces of that length and a rest.

Defined results: every token of every row is in exactly one bin; a row without words (null or empty text) gets one
row with no bin; repeated rows are packed each for itself; ids keep their type and value, nulls too; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

LENGTHS = (512, 1024, 2048, 4096, 8192)
WORD = r"[^\x20\x09-\x0D]+"
SHARD_ROWS = 20_000


def cost(length: int, attention: float = 16384.0, fixed: float = 32.0) -> float:
    """Price of a sequence: linear work, attention and a fixed charge."""
    return length + length * length / attention + fixed


def pack(sizes: list[int], lengths=LENGTHS, price=cost) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each size and the final capacity of each bin. Sizes are at least 1 and at most max(lengths)."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    filled: list[int] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted: the first that fits is the best
    left = sum(sizes)
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            can = [c for c in lengths if c >= size]
            free = min(can, key=lambda c: (price(c) / min(c, left), -c))
            b = len(filled)
            filled.append(0)
        bin_of[i], offset[i] = b, filled[b]
        filled[b] += size
        if free > size:
            insort(room, (free - size, b))
        left -= size
    return bin_of, offset, [lengths[bisect_left(lengths, f)] for f in filled]


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths=LENGTHS, shard_rows: int = SHARD_ROWS, size_col: str | None = None) -> DataFrame:
    """Placements: id, piece, start (its first token in the document), n_tokens, bin_id, capacity, offset."""
    size = F.col(size_col).cast("long") if size_col else F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # written, so that a row keeps its number if its task runs again
    narrow = written(df.select(F.col(id_col).alias("doc"), size.alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    shards = max(1, -(-narrow.count() // shard_rows))
    dealt = narrow.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    kind = df.schema[id_col].dataType.simpleString()
    top = max(lengths)
    names = [id_col, "piece", "start", "n_tokens", "bin_id", "capacity", "offset"]

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("row", "ascending")])
        n = rows.column("size").to_numpy()
        pieces = np.maximum(1, -(-n // top))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * top
        tokens = np.minimum(top, n[row] - start)
        real = np.flatnonzero(tokens > 0)
        bins, offsets, capacity = pack(tokens[real].tolist(), lengths)
        bin_of, offset, none = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.ones(len(row), bool)
        bin_of[real], offset[real], none[real] = bins, offsets, False
        shard = rows.column("shard")[0].as_py()
        label = pa.array([None if no else f"{shard}-{b}" for b, no in zip(bin_of.tolist(), none.tolist(), strict=True)], pa.string())
        wide = np.array([*capacity, 0], np.int64)[bin_of]
        columns = [rows.column("doc").take(pa.array(row)), *map(pa.array, (piece, start, tokens)), label, pa.array(wide, mask=none), pa.array(offset, mask=none)]
        return pa.table(columns, names=names)

    return dealt.groupBy("shard").applyInArrow(place, f"`{id_col}` {kind}, piece long, start long, n_tokens long, bin_id string, capacity long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
