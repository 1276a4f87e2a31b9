"""Projection of vectors onto concepts, hits, confidence and neighbours.

A concept matrix within ``MATRIX_BYTES`` goes to each task as one numpy matrix and objects are multiplied in blocks;
nothing is exploded to object x concept rows. A larger one is dealt out in blocks of rows, each block's best hits
are kept, and the blocks' hits are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V

MATRIX_BYTES = 256 << 20
DIGITS = 6


def _matrix(concepts: DataFrame, id_col: str, vector_col: str) -> tuple[list, np.ndarray]:
    rows = concepts.select(id_col, V.doubles(vector_col).alias("v")).orderBy(id_col).collect()
    m = np.array([r["v"] for r in rows], np.float64)
    return [r[id_col] for r in rows], m


def fits(concepts: DataFrame, vector_col: str = "vector", limit: int = MATRIX_BYTES) -> bool:
    """Whether the matrix is within the limit, by a count and the longest vector."""
    n, width = concepts.select(F.count("*"), F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()
    return n * width * 8 <= limit


def _rows(batch_column) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(batch_column), -1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def coordinates(objects: DataFrame, concepts: DataFrame, id_col: str, vector_col: str, concept_col: str = "concept", concept_vector: str = "vector") -> DataFrame:
    """(id, ces): the cosine of each object with every concept, concepts in order of id.

    A row is as long as there are concepts, so a vocabulary beyond ``MATRIX_BYTES`` is refused.
    """
    if not fits(concepts, concept_vector):
        raise ValueError("too many concepts for a coordinate each; use top_k")
    _, m = _matrix(concepts, concept_col, concept_vector)
    unit = _unit_rows(m)
    picked = objects.select(id_col, V.doubles(vector_col).alias("v"))
    kind = objects.schema[id_col].dataType.simpleString()

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                ces = _unit_rows(_rows(batch.column(1))) @ unit.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(ces), pa.list_(pa.float64()))], names=[id_col, "ces"])

    return picked.mapInArrow(project, f"`{id_col}` {kind}, ces array<double>")


def _best(ids: list, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the k best of each row; equals in order of id."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(sims, order, 1)


def top_k(objects: DataFrame, concepts: DataFrame, k: int, id_col: str, vector_col: str, concept_col: str = "concept", concept_vector: str = "vector", block: int = 4096) -> DataFrame:
    """(id, concept, similarity to 6 digits, rank from 1), ``k`` rows an object."""
    id_kind, concept_kind = objects.schema[id_col].dataType, concepts.schema[concept_col].dataType
    schema = f"`{id_col}` {id_kind.simpleString()}, `{concept_col}` {concept_kind.simpleString()}, similarity double, rank int"
    if not fits(concepts, concept_vector):
        return _top_k_blocks(objects, concepts, k, id_col, vector_col, concept_col, concept_vector, block)
    ids, m = _matrix(concepts, concept_col, concept_vector)
    if not ids:
        return objects.sparkSession.createDataFrame([], schema)
    unit = _unit_rows(m)
    from pyspark.sql.pandas.types import to_arrow_type

    names = pa.array(ids, to_arrow_type(concept_kind))

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order, sims = _best(ids, _unit_rows(_rows(batch.column(1))) @ unit.T, k)
            n, width = order.shape
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), width))), names.take(pa.array(order.ravel())), pa.array(np.round(sims.ravel(), DIGITS)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n))],
                names=[id_col, concept_col, "similarity", "rank"],
            )

    return objects.select(id_col, V.doubles(vector_col).alias("v")).mapInArrow(project, schema)


def _top_k_blocks(objects, concepts, k, id_col, vector_col, concept_col, concept_vector, block):
    """Concepts in blocks: each block of objects meets each of them once and keeps its k best there; of equals the least id."""
    id_kind, concept_kind = (df.schema[c].dataType.simpleString() for df, c in ((objects, id_col), (concepts, concept_col)))
    own = objects.select(F.col(id_col).alias("k"), F.col(vector_col).alias("v"))
    their = concepts.select(F.col(concept_col).alias("k"), F.col(concept_vector).alias("v"))

    def best(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                c_ids, ids = (batch.column(c)[r].values for c in (1, 3))
                sims = _unit_rows(_matrix_of(batch.column(4)[r])) @ _unit_rows(_matrix_of(batch.column(2)[r])).T
                named, width = np.asarray(c_ids), min(k, sims.shape[1])
                order = np.lexsort((np.broadcast_to(named, sims.shape), -sims), axis=1)[:, :width]
                take = pa.array(np.repeat(np.arange(sims.shape[0]), width))
                yield pa.RecordBatch.from_arrays([ids.take(take), c_ids.take(pa.array(order.ravel())), pa.array(np.take_along_axis(sims, order, 1).ravel())], names=["id", "c", "s"])

    hits = met_blocks(their, own, "k", "v", block).mapInArrow(best, f"id {id_kind}, c {concept_kind}, s double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "c"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(id_col), F.col("c").alias(concept_col), F.round("s", DIGITS).alias("similarity"), "rank")


def confidence(hits: DataFrame, id_col: str) -> DataFrame:
    """(id, best, top1, margin, sentence_margin): with one hit the first margin is its value, the second 0."""
    of = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    concept = next(c for c in hits.columns if c not in (id_col, "similarity", "rank"))
    out = hits.where("rank <= 2").groupBy(id_col).agg(of(1, concept).alias("best"), of(1, "similarity").alias("top1"), of(2, "similarity").alias("second"))
    second = F.coalesce("second", F.lit(0.0))
    return out.select(id_col, "best", "top1", F.round(F.col("top1") - second, DIGITS).alias("margin"), F.round(F.when(F.col("second").isNull(), 0.0).otherwise(F.col("top1") - F.col("second")), DIGITS).alias("sentence_margin"))


def _in_blocks(rows: DataFrame, id_col: str, vector_col: str, size: int, name: str) -> DataFrame:
    """(name, ids, vectors): rows of equal width in about equal blocks; the number of blocks is set by a count."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(F.col(id_col).alias("i"), V.doubles(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(name))
    packed = dealt.groupBy(name).agg(F.collect_list(F.struct("i", "v")).alias("m"))
    return packed.select(name, F.col("m.i").alias("ids"), F.col("m.v").alias("vectors"))


def met_blocks(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, block: int = 2048) -> DataFrame:
    """(a, q_ids, q, ids, vectors): every block of queries beside every block of rows, for the caller to multiply.

    Nothing reaches the driver but the number of blocks; a row's block is sent once for each block of queries.
    """
    left = _in_blocks(queries, id_col, vector_col, block, "a")
    right = _in_blocks(rows, id_col, vector_col, block, "b")
    every = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-queries.count() // block)) - 1))))
    return left.select("a", F.col("ids").alias("q_ids"), F.col("vectors").alias("q")).join(every, "a").select("a", "q_ids", "q", "ids", "vectors")


def _matrix_of(cell) -> np.ndarray:
    """Rows of a cell of array<array<double>>."""
    flat = cell.values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(cell.values), -1) if len(cell.values) else np.zeros((0, 1))


def neighbours(queries: DataFrame, rows: DataFrame, k: int, id_col: str, ces_col: str = "ces", block: int = 2048, itself: bool = False) -> DataFrame:
    """(query, neighbour, similarity, rank): cosine of coordinate vectors, every query against all rows but itself.

    Blocks of queries meet blocks of rows as matrices; each pair of blocks keeps the k best of a query, which are
    merged. ``itself``: ids of queries and rows are not of one kind, so that none is left out.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    own_kind = queries.schema[id_col].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, ids = (batch.column(c)[r].values for c in (1, 3))
                q, m = _unit_rows(_matrix_of(batch.column(2)[r])), _unit_rows(_matrix_of(batch.column(4)[r]))
                sims = q @ m.T
                named = np.asarray(ids)
                if not itself:
                    sims[np.asarray(q_ids)[:, None] == named[None, :]] = -np.inf
                width = min(k, sims.shape[1])
                order = np.lexsort((np.broadcast_to(named, sims.shape), -np.round(sims, 9)), axis=1)[:, :width]
                best = np.take_along_axis(sims, order, 1)
                ok = np.flatnonzero(np.isfinite(best).ravel())
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(np.repeat(np.arange(len(q)), width)[ok])), ids.take(pa.array(order.ravel()[ok])), pa.array(best.ravel()[ok])], names=["query", "neighbour", "s"])

    near = met_blocks(queries, rows, id_col, ces_col, block).mapInArrow(nearest, f"query {own_kind}, neighbour {kind}, s double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("s", 9)), "neighbour"))).where(F.col("rank") <= k)
    return ranked.select("query", "neighbour", F.round("s", DIGITS).alias("similarity"), "rank")


def annotated(query: Column, concepts: Column) -> Column:
    """The query with its concepts behind it."""
    return F.concat(query, F.lit("  [concepts: "), F.array_join(concepts, ", "), F.lit("]"))
