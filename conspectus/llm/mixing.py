"""Mixing sources to target weights by weighted fair queueing.

Sources share the corpus's total size by weight. A source is read up to ``MOST`` times; a target over that is held
there and its excess goes to the others by weight. Each source's documents stand in a shuffled order (md5 of id,
size and number among equal rows), repeated pass by pass. A copy's virtual finish time is the size of its source read up to and with it, divided
by the source's target. The mix is the copies in order of finish time, cut where the running size passes the total.

Virtual time is even by construction, so equal cells of it hold about equally much: the global order is taken by
cells, each sorted by one task, with the cells' totals summed before. Within a source, equal cells of the hash do the
same. No task sees a whole source.

Defined results: a null or empty text has size 0 and is taken with size 0; a null source is a source, ranked last;
rows of equal id are separate documents, ordered by size; a copy whose source has reached its target before it
starts is no candidate; if all sizes are 0 nothing is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
CELL_ROWS = 4_000


def targets(totals: DataFrame, most: int = MOST, weights: int = 3) -> DataFrame:
    """Adds rank, weight and target to (source, source_size, rows): one row a source.

    The level is the size per unit of weight at which the sources that are not held share what the held ones leave.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("rank") - 1) % weights + 1)
    ranked = ranked.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything))
    held = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    ranked = ranked.withColumn("level", (F.col("total") - held) / F.sum("weight").over(after))
    ranked = ranked.withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything))
    is_held = F.struct("ratio", "rank") < F.struct(F.col("at.ratio"), F.col("at.rank"))
    target = F.when(is_held, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.col("at.level"))
    return ranked.select("source", "source_size", "rows", "total", F.col("rank").cast("long").alias("rank"), target.cast("double").alias("target"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = MOST, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken (their size)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    # equal rows travel as one and are told apart by a number; a leading part of a digest of id, size and number shuffles,
    # so that rows of one id, or without one, are spread too
    groups = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    numbered = groups.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    base = numbered.select("doc_id", "source", "size", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "i").cast("binary")).alias("key"))
    shares = targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), most)
    known = shares.withColumnRenamed("source", "of_source")
    rows = base.join(known, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("cell", F.floor(spot * F.ceil(F.col("rows") / cell_rows)))
    cells = rows.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_count"))
    earlier = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("rank", "cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("size_before"), F.coalesce(F.sum("cell_count").over(earlier), F.lit(0)).alias("count_before"))
    inside = Window.partitionBy("rank", "cell").orderBy("key", "doc_id", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(cells, ["rank", "cell"]).withColumn("read", F.col("size_before") + F.sum("size").over(upto)).withColumn("place", F.col("count_before") + F.row_number().over(inside)).drop("cell")
    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(most - 1))).otherwise(F.array(F.lit(0)))
    copies = rows.withColumn("turn", F.explode(passes)).withColumn("done", F.col("turn") * F.col("source_size") + F.col("read"))
    copies = copies.where((F.col("turn") == 0) | (F.col("done") - F.col("size") < F.col("target")))
    copies = copies.withColumn("open", (F.col("target") > 0) & (F.col("done") - F.col("size") < F.col("target")))
    copies = copies.withColumn("finish", F.when(F.col("open"), F.col("done") / F.col("target")))
    # closed copies, which stand apart, need no order; their cells only spread them
    total_rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wide = F.greatest(F.lit(1), F.ceil(F.lit(total_rows) / cell_rows))
    copies = copies.withColumn("cell", F.when(F.col("open"), F.least(F.floor(F.col("finish") * wide), wide * 4)).otherwise(-1 - F.pmod(F.col("place"), wide)))
    counted = F.when(F.col("open"), F.col("size")).otherwise(0)
    sums = copies.groupBy("cell").agg(F.sum(counted).alias("cell_size"))
    sums = sums.select("cell", F.coalesce(F.sum("cell_size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("size_before"))
    queue = Window.partitionBy("cell").orderBy("finish", "rank", "turn", "place").rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.drop("size_before").join(sums, "cell").withColumn("running", F.col("size_before") + F.sum(counted).over(queue))
    taken = (F.col("open") & (F.col("running") <= F.col("total"))).cast("long")
    return copies.groupBy("rank", "place", "doc_id", "source", "size", "source_size", "target").agg(F.sum(taken).alias("copies"), F.sum(taken * F.col("size")).alias("taken")).drop("rank", "place")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH base AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || row_number() OVER (PARTITION BY doc_id, source, size)) AS key
  FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, CAST(source_size * 3 AS DOUBLE) / ((rank - 1) % 3 + 1) AS ratio,
                   CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked),
levels AS (
  SELECT *, CAST(total - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
cut AS (SELECT ratio AS r0, rank AS k0, level AS l0 FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
shares AS (
  SELECT source, source_size, total, rank,
         CASE WHEN ratio < r0 OR (ratio = r0 AND rank < k0) THEN CAST(source_size * 3 AS DOUBLE) ELSE weight * l0 END AS target
  FROM levels, cut),
rows_ AS (
  SELECT b.doc_id, b.size, s.source_size, s.total, s.rank, s.target,
         CAST(sum(b.size) OVER (PARTITION BY s.rank ORDER BY b.key, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS read,
         row_number() OVER (PARTITION BY s.rank ORDER BY b.key, b.doc_id, b.size) AS place
  FROM base b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT r.*, t.turn, t.turn * r.source_size + r.read AS done
  FROM rows_ r JOIN (SELECT unnest([0, 1, 2]) AS turn) t ON t.turn = 0 OR r.size > 0),
queue AS (
  SELECT rank, place, turn, size,
         CAST(sum(size) OVER (ORDER BY CAST(done AS DOUBLE) / target, rank, turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running,
         total
  FROM copies WHERE target > 0 AND done - size < target),
got AS (SELECT rank, place, CAST(sum(size) AS BIGINT) AS taken FROM queue WHERE running <= total GROUP BY rank, place)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(g.taken, 0) AS taken
FROM rows_ r LEFT JOIN got g ON r.rank = g.rank AND r.place = g.place
"""
