"""The cross-document concept basis: fold, version, profile of similarities and calibration.

Candidates compete only within their level, so the ordered fold runs per level; its state is that level's rows.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..functions import vectors as V
from . import projection

TAU = 0.75
FLOOR, CEILING = 0.45, 0.95
FOLD_SCHEMA = "level int, row_id string, label string, vector array<double>, support int, documents array<string>, merged_labels array<string>"


class Fold:
    """Rows of one level; a candidate merges with the nearest row of at least ``tau``, or of its own id, or is added."""

    def __init__(self, tau: float = TAU):
        self.tau, self.rows, self.matrix, self.where, self.outcomes = tau, [], np.zeros((0, 0)), {}, []

    def add(self, row_id: str, label: str, vector, document: str) -> str:
        v = np.asarray(vector, np.float64)
        length = float(np.linalg.norm(v))
        self.last = (None, None)
        if not length:
            return "skipped"
        v = v / length
        n = len(self.rows)
        at = None
        if n:
            sims = self.matrix[:n] @ v
            best = int(np.argmax(sims))
            at = best if sims[best] >= self.tau else self.where.get(row_id)
            self.last = (None, float(sims[best if at is None else at]))
        if at is None:
            if n == len(self.matrix):
                grown = np.zeros((max(64, 2 * n), len(v)))
                grown[:n] = self.matrix[:n] if n else grown[:0]
                self.matrix = grown
            self.matrix[n] = v
            self.where[row_id] = n
            self.last = (row_id, self.last[1])
            self.rows.append({"row_id": row_id, "label": label, "support": 1, "documents": [document], "merged": [label]})
            return "added"
        row = self.rows[at]
        self.last = (row["row_id"], self.last[1])
        mean = (self.matrix[at] * row["support"] + v) / (row["support"] + 1)
        size = float(np.linalg.norm(mean))
        self.matrix[at] = mean / size if size else mean
        row["support"] += 1
        for key, value in (("documents", document), ("merged", label)):
            if value not in row[key]:
                row[key].append(value)
        return "merged"


def _streamed(candidates: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Candidates with row_id and vector, one task a group of ``keys``, in order: groups are streamed, not gathered."""
    named = candidates.withColumn("row_id", ids.row_id(F.col("level"), F.col("label"))).withColumn("vector", V.doubles("vector"))
    rows = named.select(*keys, *[F.col(k).cast("string").alias(f"__{k}") for k in order], "row_id", "label", "vector", F.col("document").cast("string").alias("document"))
    place = [*keys, *[F.col(f"__{k}") for k in order], F.col("row_id")]
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*place).select(*keys, "row_id", "label", "vector", "document")


def _folds(batches, n_keys: int, start):
    """(keys, state) of each group in turn; ``start`` makes the state of a group's keys."""
    now = state = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:n_keys] != now:
                if state is not None:
                    yield now, state
                now, state = row[:n_keys], start(*row[:n_keys])
            state.outcomes.append(state.add(*row[n_keys:]))
    if state is not None:
        yield now, state


def fold(candidates: DataFrame, tau: float = TAU, order: tuple[str, ...] = ("document", "label")) -> DataFrame:
    """Basis rows from candidates (level, label, vector, document and the columns of ``order``, compared as text).

    The fold is sequential within a level by definition; a task streams its level and holds the level's basis rows.
    """

    def run(batches):
        names = [c.split()[0] for c in FOLD_SCHEMA.split(", ")]
        for (level,), state in _folds(batches, 1, lambda _: Fold(tau)):
            for at in range(0, len(state.rows), 1024):
                part = state.rows[at : at + 1024]
                columns = [pa.array([level] * len(part), pa.int32()), *(pa.array([x[k] for x in part], t) for k, t in (("row_id", pa.string()), ("label", pa.string())))]
                columns += [pa.array(list(state.matrix[at : at + len(part)]), pa.list_(pa.float64())), pa.array([x["support"] for x in part], pa.int32())]
                columns += [pa.array([x[k] for x in part], pa.list_(pa.string())) for k in ("documents", "merged")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _streamed(candidates.withColumn("level", F.col("level").cast("int")), ["level"], order).mapInArrow(run, FOLD_SCHEMA)


def integrations(candidates: DataFrame, tau: float = TAU, order: tuple[str, ...] = ("document", "label")) -> DataFrame:
    """(level, label, document, span_id, decision, row_id, cosine): what the fold does with each candidate (with span_id), the
    row it ends in, and its cosine with the nearest row, or with the row of its id, before that."""
    keyed = candidates.withColumn("level", F.col("level").cast("int")).withColumn("document", F.to_json(F.struct(F.col("document").cast("string").alias("document"), "span_id")))

    def run(batches):
        names = ["level", "label", "document", "decision", "row_id", "cosine"]
        now = state = None
        for batch in batches:
            out = []
            for level, row_id, label, vector, document in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if level != now:
                    now, state = level, Fold(tau)
                decision = state.add(row_id, label, vector, json.loads(document)["document"])
                out.append((level, label, document, decision, *state.last))
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    found = _streamed(keyed, ["level"], order).mapInArrow(run, "level int, label string, document string, decision string, row_id string, cosine double")
    part = F.from_json("document", "document string, span_id string")
    return found.withColumn("d", part).select("level", "label", "d.document", "d.span_id", "decision", "row_id", F.round("cosine", 6).alias("cosine"))


SINK = "row_000000000000"


def absorb_structural(candidates: DataFrame, dim: int) -> DataFrame:
    """The reserved row that titles of structure go to: the running mean of their unit vectors, without a test of similarity.

    candidates: (label, vector, document). One row of level 0, or none.
    """
    unit = candidates.select("label", "document", V.unit(V.doubles("vector")).alias("v"))
    out = unit.groupBy().agg(F.count("*").alias("n"), V.mean_vector(F.col("v"), dim).alias("m"), F.array_sort(F.collect_set(F.col("document").cast("string"))).alias("documents"), F.array_sort(F.collect_set("label")).alias("labels"))
    return out.where("n > 0").select(F.lit(0).alias("level"), F.lit(SINK).alias("row_id"), F.lit("structural").alias("label"), V.unit(F.col("m")).alias("vector"), F.col("n").cast("int").alias("support"), "documents", F.col("labels").alias("merged_labels"))


def concept_rows(basis: DataFrame) -> DataFrame:
    """Rows without the reserved one."""
    return basis.where(F.col("row_id") != SINK)


def by_level(basis: DataFrame, level: int) -> DataFrame:
    return basis.where(F.col("level") == level)


def position_of(basis: DataFrame, row_id: str) -> DataFrame:
    """(ord) of a row; it holds for this version only."""
    return ordered(basis).where(F.col("row_id") == row_id).select("ord")


def _canonical() -> list:
    """Level, support descending, canonical label, id; the reserved row of level 0 is first."""
    return [F.col("level"), F.desc("support"), ids.canonical_label(F.col("label")), F.col("row_id")]


def ordered(basis: DataFrame) -> DataFrame:
    """Rows in canonical order with ``ord``. Levels are numbered apart and shifted by the rows of those before."""
    inside = basis.withColumn("ord", F.row_number().over(Window.partitionBy("level").orderBy(*_canonical())) - 1)
    counted = basis.groupBy("level").agg(F.count("*").alias("n"))
    before = counted.select("level", F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a level
    return inside.join(F.broadcast(before), "level").withColumn("ord", (F.col("ord") + F.col("__before")).cast("int")).drop("__before")


def version(basis: DataFrame) -> DataFrame:
    """One row: basis_version and the number of rows. It is a hash of the ordered ids, so ids alone go to one task, which
    sorts them (on disk, if need be) and streams them through the hash."""

    def hashed(batches):
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for row_id in batch.column(0).to_pylist():
                digest.update((ids.SEPARATOR if n else "").encode() + row_id.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()[:16]]), pa.array([n], pa.int32())], names=["basis_version", "n_rows"])

    keyed = basis.select("level", "support", "label", "row_id").coalesce(1).sortWithinPartitions(*_canonical()).select("row_id")
    return keyed.mapInArrow(hashed, "basis_version string, n_rows int")


def stats(basis: DataFrame) -> DataFrame:
    """Rows, singletons, rows shared by documents and support, by level."""
    return basis.groupBy("level").agg(
        F.count("*").alias("rows"), F.max("support").alias("max_support"), F.round(F.avg("support"), 6).alias("mean_support"),
        F.count_if(F.col("support") == 1).alias("singletons"), F.count_if(F.size("documents") > 1).alias("shared"),
    )


def pair_counts(rows: DataFrame, id_col: str, group_col: str, vector_col: str, every: int = 100, block: int = 2048) -> DataFrame:
    """(within, s, n): how many pairs of a query and another row have a cosine of s, to 6 digits, within or across groups.

    Queries are the rows whose id is divisible by ``every`` (1: all rows). They meet all rows in blocks, as matrices;
    what leaves a task are counts of cosines, never pairs. A pair of two queries counts once.
    """
    group = rows.select(F.struct(F.col(id_col).alias("i"), F.col(group_col).cast("string").alias("g")).alias("k"), F.col(vector_col).alias("v"))
    queries = group.where(F.col("k.i") % every == 0)

    def counted(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (qi, qg), (ri, rg) = ([np.asarray(x.to_pylist(), object) for x in batch.column(c)[r].values.flatten()] for c in (1, 3))
                q, m = (projection._unit_rows(projection._matrix_of(batch.column(c)[r])) for c in (2, 4))
                qi, ri = qi.astype(np.int64), ri.astype(np.int64)
                keep = (qi[:, None] != ri[None]) & ((ri % every != 0)[None] | (qi[:, None] < ri[None]))
                s, within = np.round((q @ m.T)[keep], 6) + 0.0, (qg[:, None] == rg[None])[keep]
                for side in (False, True):
                    values, n = np.unique(s[within == side], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), side)), pa.array(values), pa.array(n)], names=["within", "s", "n"])

    met = projection.met_blocks(queries, group, "k", "v", block)
    return met.mapInArrow(counted, "within boolean, s double, n long").groupBy("within", "s").agg(F.sum("n").alias("n"))


def profile(counts: DataFrame) -> DataFrame:
    """Number, maximum, mean and percentiles of cosines within and across groups, from (within, s, n)."""
    at = lambda p: F.round(F.percentile("s", p, F.col("n")), 6)
    return counts.groupBy("within").agg(F.sum("n").alias("n"), F.round(F.max("s"), 6).alias("max"), F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 6).alias("mean"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def calibrate(counts: DataFrame, percentile: float = 0.99, floor: float = FLOOR, ceiling: float = CEILING, default: float = TAU) -> DataFrame:
    """Merge threshold: the percentile of cosines across groups, held between floor and ceiling."""
    found = counts.where("not within").agg(F.percentile("s", percentile, F.col("n")).alias("raw"))
    return found.select(F.round("raw", 6).alias("raw"), F.round(F.coalesce(F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.col("raw"))), F.lit(default)), 6).alias("tau"))


def sweep(candidates: DataFrame, taus: tuple[float, ...], order: tuple[str, ...] = ("document", "label")) -> DataFrame:
    """Rows and merges of the fold under each threshold; each (threshold, level) is a group of its own."""
    many = candidates.withColumn("level", F.col("level").cast("int")).withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))

    def run(batches):
        for (tau, level), state in _folds(batches, 2, lambda tau, _: Fold(tau)):
            facts = (len(state.rows), state.outcomes.count("merged"), state.outcomes.count("skipped"), sum(len(r["documents"]) > 1 for r in state.rows))
            yield pa.RecordBatch.from_arrays([pa.array([tau]), pa.array([level], pa.int32()), *(pa.array([x], pa.int64()) for x in facts)], names=["tau", "level", "rows", "merged", "skipped", "shared"])

    return _streamed(many, ["tau", "level"], order).mapInArrow(run, "tau double, level int, rows long, merged long, skipped long, shared long")
