"""Section trees: owners of units, parents of markers, descendants and accounting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_marker(markers: DataFrame, units: DataFrame, doc: str = "doc_id", flow: str = "flow_index", marker: str = "marker_id", unit: str = "unit_id", inclusive: bool = True) -> DataFrame:
    """Units with the nearest marker before them (``inclusive``: or at their place), null for the preamble.

    One sorted pass over the union of both sides; no join.
    """
    side = lambda df, kind, own: df.select(F.col(doc), F.col(flow), F.lit(kind).alias("__kind"), *own)
    left = side(markers, 0 if inclusive else 1, [F.col(marker), F.lit(None).cast(units.schema[unit].dataType).alias(unit)])
    right = side(units, 1 if inclusive else 0, [F.lit(None).cast(markers.schema[marker].dataType).alias(marker), F.col(unit)])
    order = Window.partitionBy(doc).orderBy(flow, "__kind", marker).rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).withColumn("owner", F.last(marker, ignorenulls=True).over(order))
    return merged.where(F.col(unit).isNotNull()).select(doc, unit, flow, "owner")


def link_parents(markers: DataFrame, max_level: int = 12, doc: str = "doc_id", flow: str = "flow_index", marker: str = "marker_id", level: str = "level", appendix: str | None = "is_appendix") -> DataFrame:
    """Adds ``parent``: the nearest marker before of a lower level, within the same unbroken run of the appendix flag."""
    place = Window.partitionBy(doc).orderBy(flow, marker)
    rows = markers
    if appendix:
        turned = (F.col(appendix) != F.lag(appendix).over(place)).cast("int")
        rows = rows.withColumn("__run", F.coalesce(F.sum(turned).over(place.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    else:
        rows = rows.withColumn("__run", F.lit(0))
    before = Window.partitionBy(doc, "__run").orderBy(flow, marker).rowsBetween(Window.unboundedPreceding, -1)
    spots = [F.max(F.when(F.col(level) == n, F.struct(F.col(flow).alias("f"), F.col(marker).alias("m")))).over(before).alias(f"__{n}") for n in range(1, max_level + 1)]
    rows = rows.select("*", *spots)
    lower = F.greatest(*[F.when(F.col(level) > n, F.col(f"__{n}")) for n in range(1, max_level + 1)])
    return rows.withColumn("parent", lower["m"]).drop("__run", *[f"__{n}" for n in range(1, max_level + 1)])


def extents(markers: DataFrame, doc: str = "doc_id", flow: str = "flow_index", marker: str = "marker_id") -> DataFrame:
    """Adds ``until``: where the next marker begins, null for the last."""
    return markers.withColumn("until", F.lead(flow).over(Window.partitionBy(doc).orderBy(flow, marker)))


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(ancestor, node, depth) of edges (parent, child), each node its own ancestor at 0; cycles end at their start.

    Breadth first, a join a level, so that depth is the least one and no number of rows or levels is a limit; each level
    and the edges are kept on the executors (memory and disk) and go with the session's garbage.
    """
    known = edges.select("parent", "child").distinct().localCheckpoint()
    nodes = known.select(F.col("parent").alias("node")).union(known.select("child")).distinct()
    reached = nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    last, depth = known.where("parent <> child").select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("depth")), 1
    while not last.isEmpty():
        reached, depth = reached.union(last), depth + 1
        further = last.join(known, last["node"] == known["parent"]).select("ancestor", F.col("child").alias("node")).where("ancestor <> node").distinct()
        last = further.join(reached.where("depth > 0").select("ancestor", "node"), ["ancestor", "node"], "left_anti").withColumn("depth", F.lit(depth)).localCheckpoint()
    return reached


def section_paths(closed: DataFrame, titles: DataFrame, separator: str = " > ") -> DataFrame:
    """(node, path): titles from the outermost ancestor to the node; titles is (node, title)."""
    named = closed.join(titles.select(F.col("node").alias("ancestor"), "title"), "ancestor")
    listed = named.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "title"))).alias("t"))
    return listed.select("node", F.array_join(F.transform("t", lambda x: x["title"]), separator).alias("path"))


def title_paths(sections: DataFrame, title: str = "title") -> DataFrame:
    """(doc_id, section_id, path): titles from the outermost section down, cycles cut; a task holds one document's sections."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(rows["section_id"], rows["parent_id"], strict=True))
        titles = dict(zip(rows["section_id"], rows["own"], strict=True))
        paths = []
        for at in rows["section_id"]:
            seen: dict[str, None] = {}
            while at in titles and at not in seen:
                seen[at] = None
                at = parent[at]
            paths.append([titles[s] or "" for s in reversed(seen)])
        return pd.DataFrame({"doc_id": rows["doc_id"], "section_id": rows["section_id"], "path": paths})

    picked = sections.select("doc_id", "section_id", "parent_id", F.col(title).alias("own"))
    return picked.groupBy("doc_id").applyInPandas(walk, "doc_id string, section_id string, path array<string>")


def accounting(inputs: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """One row: input ids, those in no output, those in several, and output ids that are no input."""
    counted = outputs.groupBy(key).agg(F.count("*").alias("n"))
    both = inputs.select(key).distinct().withColumn("given", F.lit(1)).join(counted, key, "full")
    return both.agg(F.count_if(F.col("given") == 1).alias("inputs"), F.count_if(F.col("n").isNull()).alias("unaccounted"), F.count_if((F.col("given") == 1) & (F.col("n") > 1)).alias("double_counted"), F.count_if(F.col("given").isNull()).alias("unknown"))


def subtree_text(closed: DataFrame, units: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(ancestor, text): own text and that of all descendants in document order; units is (node, flow_index, text)."""
    listed = closed.join(units, "node").groupBy("ancestor").agg(F.array_sort(F.collect_list(F.struct("flow_index", "node", "text"))).alias("t"))
    return listed.select("ancestor", F.array_join(F.transform("t", lambda x: x["text"]), separator).alias("text"))
