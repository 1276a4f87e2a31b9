"""Marker trees of typed-object documents: markers, the units they own, and a reason for every object left out.

All documents of a corpus are read in one plan, keyed by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import latex as L
from ..functions import structural
from ..sources import documents
from . import tree

# Types that open a section, where body types keep their text, mathematics, and types left out with reasons.
MARKER_TYPES = ("section", "heading")
BODY_PROPS = {"paragraph": ("text", "content"), "listitem": ("content", "text"), "sidenote": ("content",), "footnote": ("content",), "picture": ("caption",), "diagram": ("caption",)}
MATH_TYPES = ("formula", "equation", "displayequation", "inlinemath")
SKIPPED_TYPES = {
    "abstract": "deferred: needs its own prompt, not the span prompt",
    "algorithm": "deferred: boundary semantics not yet decided",
    "algorithmstep": "deferred: boundary semantics not yet decided",
    "table": "tabular data: numeric results, which the concept prompt excludes",
    "tablecell": "fragment of a Table, not an independent content object",
    "tablerow": "fragment of a Table, not an independent content object",
    "citation": "reference marker; the citekey is already inlined by clean_body_text",
}
URL_ONLY = r"^\s*(?:!\[\]\()?https?://\S+\)?\s*$"
REFERENCE_ENTRY = r"\[[^\]\n]{1,80}\]\s+[A-Z]"
REFERENCE_GAP = 600
REFERENCE_ENTRIES = 3


@F.pandas_udf(T.IntegerType())
def reference_tail(text: pd.Series) -> pd.Series:
    """Where a list of reference entries at the end begins, in code points; the length of the text without one.

    The tail is the last entries that follow each other within ``REFERENCE_GAP`` characters, three at least.
    """
    import re

    def cut(value):
        value = value or ""
        at = [m.start() for m in re.finditer(REFERENCE_ENTRY, value)]
        apart = max((i + 1 for i in range(len(at) - 1) if at[i + 1] - at[i] > REFERENCE_GAP), default=0)
        return at[apart] if len(at) - apart >= REFERENCE_ENTRIES else len(value)

    return text.map(cut)


def typed_objects(files: DataFrame) -> DataFrame:
    """(doc_id, position, id, kind, props, flow) of every object of files (doc_id, json); kind is null for what is no object."""
    rows = files.select("doc_id", F.posexplode(F.from_json("json", documents.OBJECTS)["objects"]).alias("position", "o"))
    kind = F.when(F.col("o").isNotNull(), F.lower(F.coalesce(F.col("o.type"), F.lit(""))))
    props = F.coalesce(F.col("o.props"), F.create_map().cast("map<string,string>"))
    rows = rows.select("doc_id", "position", F.coalesce(F.col("o.id"), F.lit("")).alias("id"), kind.alias("kind"), F.coalesce(F.col("o.type"), F.lit("")).alias("type"), props.alias("props"))
    return rows.withColumn("flow", F.coalesce(F.col("props")["flow_index"].try_cast("int"), F.col("position")))


def read_markers(objects: DataFrame) -> DataFrame:
    """(doc_id, marker_id, title, title_raw, level, flow_index, is_appendix, lost_macros): named sections and headings."""
    rows = objects.where(F.col("kind").isin(*MARKER_TYPES) & (F.trim("id") != ""))
    props = F.col("props")
    given = lambda name: F.when(props[name] != "", props[name])
    rows = rows.withColumn("title_raw", F.trim(F.coalesce(given("caption"), given("title"), F.lit(""))))
    rows = rows.withColumn("title", L.clean_caption(F.col("title_raw")))
    level = F.coalesce(props["level"].try_cast("int"), F.lit(1))
    appendix = ~F.lower(F.coalesce(props["is_appendix"], F.lit("false"))).isin("false", "0", "")
    return rows.select("doc_id", F.trim("id").alias("marker_id"), "title", "title_raw", F.when(level == 0, 1).otherwise(level).alias("level"), F.col("flow").alias("flow_index"), appendix.alias("is_appendix"), L.lost_macros(F.col("title_raw"), F.col("title")).alias("lost_macros"))


def formulas(objects: DataFrame, speak: Callable[[str], str] | None = None) -> DataFrame:
    """(doc_id, ordinal, id, said): formulas numbered in flow order, as they are read inside a sentence."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce(F.col("props")["flow_index"].try_cast("int"), F.lit(0)), "id")
    rows = objects.where("kind = 'formula'").withColumn("ordinal", F.row_number().over(order))
    return rows.select("doc_id", "ordinal", "id", L.math_text(F.col("props"), speak, least=0)["text"].alias("said"))


def read_content(objects: DataFrame, said: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, skipped, consumed) of body objects.

    units: (doc_id, unit_id, text, named, flow_index); skipped: (doc_id, object_id, object_type, reason), one reason an
    object; consumed: (doc_id, id) of the formulas that ``said`` (see ``formulas``) puts into sentences.
    """
    kind, props = F.col("kind"), F.col("props")
    rows = objects.where(kind.isNull() | ~kind.isin(*MARKER_TYPES, *MATH_TYPES))
    raw, missing = F.lit(""), F.lit(None).cast("string")
    for name, own in BODY_PROPS.items():
        found = F.coalesce(*[F.when(F.trim(props[p]) != "", F.trim(props[p])) for p in own])
        raw = F.when(kind == name, F.coalesce(found, F.lit(""))).otherwise(raw)
        missing = F.when((kind == name) & found.isNull(), F.lit(f"no text under {'/'.join(own)}")).otherwise(missing)
    first = F.when(kind.isNull(), "not an object")
    for name, why in SKIPPED_TYPES.items():
        first = first.when(kind == name, why)
    first = first.when(~kind.isin(*BODY_PROPS), F.concat(F.lit("unhandled object type '"), kind, F.lit("'")))
    rows = rows.withColumn("raw", raw).withColumn("reason", F.coalesce(first, missing, F.when(F.col("raw").rlike(URL_ONLY), "caption is only a URL")))
    tail = reference_tail("raw")
    rows = rows.withColumn("body", F.when(tail < F.char_length("raw"), F.trim(F.substring("raw", F.lit(1), tail))).otherwise(F.col("raw")))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("body") == "", "reference list: no prose before the entries"), F.when(structural.is_latex_artifact(F.col("body")), "text is only LaTeX markup")))
    consumed = None
    if said is not None:
        ids = F.explode(F.regexp_extract_all("body", F.lit(L.PLACEHOLDER), F.lit(1))).alias("name")
        named = rows.where("reason is null").select("doc_id", "position", ids).distinct()
        named = named.withColumn("ordinal", F.regexp_extract("name", r"_([A-Z]+)(\d+)$", 2).try_cast("int"))
        met = named.join(said.where("said <> ''").withColumnRenamed("id", "formula"), ["doc_id", "ordinal"])
        listed = met.groupBy("doc_id", "position").agg(F.map_from_entries(F.collect_list(F.struct("name", "said"))).alias("resolved"))
        consumed = met.select("doc_id", F.col("formula").alias("id")).distinct()
        rows = rows.join(listed, ["doc_id", "position"], "left").withColumn("resolved", F.coalesce("resolved", F.create_map().cast("map<string,string>")))
        text = L.clean_body(F.col("body"), F.col("resolved"))
    else:
        text = L.clean_body(F.col("body"))
    rows = rows.withColumn("text", text).withColumn("reason", F.coalesce("reason", F.when(F.col("text") == "", "placeholder cleaning left no text")))
    owner = F.when(props["parent_section"] != "", props["parent_section"])
    named_id = lambda prefix: F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit(prefix), F.col("position").cast("string")))
    units = rows.where("reason is null").select("doc_id", named_id("para_").alias("unit_id"), "text", owner.alias("named"), F.col("flow").alias("flow_index"))
    skipped = rows.where("reason is not null").select("doc_id", named_id("object_").alias("object_id"), F.col("type").alias("object_type"), "reason")
    return units, skipped, consumed if consumed is not None else units.where("false").select("doc_id", F.col("unit_id").alias("id"))


def read_paragraphs(objects: DataFrame) -> DataFrame:
    """Body units alone."""
    return read_content(objects)[0]


def read_math(objects: DataFrame, speak: Callable[[str], str] | None = None, consumed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, sources): mathematics as prose, formulas that stand in sentences left out; and (doc_id, source, n)."""
    rows = objects.where(F.col("kind").isin(*MATH_TYPES))
    if consumed is not None:
        rows = rows.join(consumed, ["doc_id", "id"], "left_anti")
    rows = rows.withColumn("m", L.math_text(F.col("props"), speak))
    owner = F.when(F.col("props")["parent_section"] != "", F.col("props")["parent_section"])
    name = F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit("math_"), F.col("position").cast("string")))
    units = rows.where("m.text <> ''").select("doc_id", name.alias("unit_id"), F.col("m.text").alias("text"), owner.alias("named"), F.col("flow").alias("flow_index"))
    return units, rows.groupBy("doc_id", F.col("m.source").alias("source")).agg(F.count("*").alias("n"))


def math_residue(objects: DataFrame) -> DataFrame:
    """(doc_id, math_objects, spoken_backslash_literal, spoken_macro_leak, unresolved): what readings of formulas left.

    unresolved: the macros named as such, in order.
    """
    rows = objects.where(F.col("kind").isin(*MATH_TYPES))
    spoken = F.coalesce(F.col("props")["spoken"], F.lit("")).rlike(r"(?i)\bbackslash\b")
    literal = F.coalesce(F.col("props")["latex"], F.lit("")).rlike(r"\\backslash\b")
    macros = F.coalesce(F.from_json(F.col("props")["macros_unresolved"], "array<string>"), F.array().cast("array<string>"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("math_objects"), F.count_if(spoken & literal).alias("spoken_backslash_literal"), F.count_if(spoken & ~literal).alias("spoken_macro_leak"),
        F.array_sort(F.flatten(F.collect_list(macros))).alias("unresolved"),
    )


def attach_paragraphs(units: DataFrame, markers: DataFrame) -> DataFrame:
    """Units with ``marker_id``: the marker that they name, null if the document has none of this name."""
    known = markers.select("doc_id", F.col("marker_id").alias("named"), F.col("marker_id"))
    return units.join(known, ["doc_id", "named"], "left")


def assign_by_flow(units: DataFrame, markers: DataFrame) -> DataFrame:
    """Units with ``marker_id``: the marker that they name, else the last one before or at their place."""
    found = tree.last_marker(markers, units, inclusive=True).select("doc_id", "unit_id", F.col("owner"))
    return units.join(found, ["doc_id", "unit_id"], "left").withColumn("marker_id", F.coalesce("named", "owner")).drop("owner")


def assign_by_extent(units: DataFrame, markers: DataFrame) -> DataFrame:
    """Units with ``marker_id``, the nearest marker before them (null in the preamble), and ``moved``, if they name another."""
    found = tree.last_marker(markers, units, inclusive=False).select("doc_id", "unit_id", F.col("owner").alias("marker_id"))
    moved = F.coalesce((F.col("named") != F.col("marker_id")) & F.col("marker_id").isNotNull(), F.lit(False))
    return units.join(found, ["doc_id", "unit_id"], "left").withColumn("moved", moved)


@dataclass
class MarkerTree:
    """markers (with parent), units (with marker_id), skipped, math (doc_id, source, n) and objects of a corpus."""

    markers: DataFrame
    units: DataFrame
    skipped: DataFrame
    math: DataFrame
    objects: DataFrame

    def by_level(self, level: int) -> DataFrame:
        return self.document_order().where(F.col("level") == level)

    def document_order(self) -> DataFrame:
        """Markers with ``place``, their position in their document."""
        return self.markers.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("flow_index", "marker_id")) - 1)

    def orphans(self) -> DataFrame:
        return self.units.where("marker_id is null")

    def children(self) -> DataFrame:
        """(doc_id, marker_id, children): ids of each marker's children in document order; empty for leaves."""
        own = self.markers.where("parent is not null").groupBy("doc_id", F.col("parent").alias("marker_id")).agg(F.array_sort(F.collect_list(F.struct("flow_index", F.col("marker_id").alias("id")))).alias("c"))
        return self.markers.select("doc_id", "marker_id").join(own, ["doc_id", "marker_id"], "left").select("doc_id", "marker_id", F.coalesce("c.id", F.array().cast("array<string>")).alias("children"))

    def ancestry(self) -> DataFrame:
        """(doc_id, ancestor, marker_id, depth): every marker under each of its ancestors and itself.

        A parent's level is below its child's, so chains are short and free of cycles.
        """
        node = lambda c: F.to_json(F.struct("doc_id", F.col(c).alias("m")))
        edges = self.markers.where("parent is not null").select(node("parent").alias("parent"), node("marker_id").alias("child"))
        closed = tree.closure(self.markers.sparkSession, edges)
        part = lambda c: F.from_json(c, "doc_id string, m string")
        inner = closed.select(part(F.col("ancestor")).alias("a"), part(F.col("node")).alias("n"), "depth").where("depth > 0").select("a.doc_id", F.col("a.m").alias("ancestor"), F.col("n.m").alias("marker_id"), "depth")
        return inner.unionByName(self.markers.select("doc_id", F.col("marker_id").alias("ancestor"), "marker_id", F.lit(0).alias("depth")))

    def depth(self) -> DataFrame:
        """(doc_id, marker_id, depth): edges to the root."""
        return self.ancestry().groupBy("doc_id", "marker_id").agg(F.max("depth").alias("depth"))

    def body_text(self) -> DataFrame:
        """(doc_id, marker_id, text): each marker's own units, parted by empty lines."""
        own = self.units.where("marker_id is not null").groupBy("doc_id", "marker_id").agg(F.array_sort(F.collect_list(F.struct("flow_index", "unit_id", "text"))).alias("t"))
        return self.markers.select("doc_id", "marker_id").join(own, ["doc_id", "marker_id"], "left").select("doc_id", "marker_id", F.coalesce(F.array_join("t.text", "\n\n"), F.lit("")).alias("text"))

    def subtree_text(self) -> DataFrame:
        """(doc_id, marker_id, text): own text and that of all descendants in document order."""
        own = self.body_text().join(self.markers.select("doc_id", "marker_id", "flow_index"), ["doc_id", "marker_id"]).where("text <> ''")
        met = self.ancestry().join(own, ["doc_id", "marker_id"])
        first = F.when(F.col("depth") == 0, 0).otherwise(1).alias("own")
        listed = met.groupBy("doc_id", F.col("ancestor").alias("marker_id")).agg(F.array_sort(F.collect_list(F.struct(first, "flow_index", "marker_id", "text"))).alias("t"))
        return self.markers.select("doc_id", "marker_id").join(listed, ["doc_id", "marker_id"], "left").select("doc_id", "marker_id", F.coalesce(F.array_join("t.text", "\n\n"), F.lit("")).alias("text"))

    def summariser_titles(self) -> DataFrame:
        """(doc_id, marker_id, title): titles that lost macros show the raw one in brackets."""
        shown = F.when((F.size("lost_macros") > 0) & (F.col("title_raw") != ""), F.concat("title", F.lit(" ("), "title_raw", F.lit(")"))).otherwise(F.col("title"))
        return self.markers.select("doc_id", "marker_id", shown.alias("title"))

    def stats(self) -> DataFrame:
        """One row a document: markers, roots, appendix markers, degraded titles, units, orphans, moved and skipped."""
        m = self.markers.groupBy("doc_id").agg(F.count("*").alias("markers"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if("is_appendix").alias("appendix_markers"), F.count_if(F.size("lost_macros") > 0).alias("degraded_titles"))
        u = self.units.groupBy("doc_id").agg(F.count("marker_id").alias("paragraphs"), F.count_if(F.col("marker_id").isNull()).alias("orphans"), F.count_if("moved").alias("moved"))
        s = self.skipped.groupBy("doc_id").agg(F.count("*").alias("skipped"))
        names = ["markers", "roots", "appendix_markers", "degraded_titles", "paragraphs", "orphans", "moved", "skipped"]
        return m.join(u, "doc_id", "full").join(s, "doc_id", "full").fillna(0, names)

    def levels(self) -> DataFrame:
        return self.markers.groupBy("doc_id", "level").agg(F.count("*").alias("n"))

    def accounting(self) -> DataFrame:
        """One row a document: objects, and ids that are in no group or in several of markers, attached, orphans and skipped."""
        groups = [self.markers.select("doc_id", F.col("marker_id").alias("id"), F.lit("marker").alias("g")), self.units.select("doc_id", F.col("unit_id").alias("id"), F.when(F.col("marker_id").isNull(), "orphan").otherwise("attached").alias("g")), self.skipped.select("doc_id", F.col("object_id").alias("id"), F.lit("skipped").alias("g"))]
        seen = groups[0].union(groups[1]).union(groups[2]).distinct().groupBy("doc_id", "id").agg(F.count("*").alias("n"))
        given = self.objects.where("kind is not null").groupBy("doc_id", "id").agg(F.count("*").alias("times"))
        both = given.join(seen, ["doc_id", "id"], "full")
        return both.groupBy("doc_id").agg(
            F.coalesce(F.sum("times"), F.lit(0)).alias("objects"), F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("id")))).alias("unaccounted"),
            F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("id")))).alias("double_counted"),
        )


def build_tree(files: DataFrame, include_math: bool = True, speak: Callable[[str], str] | None = None) -> MarkerTree:
    """The marker trees of files (doc_id, json)."""
    objects = typed_objects(files)
    markers = tree.link_parents(read_markers(objects))
    units, skipped, consumed = read_content(objects, formulas(objects, speak))
    listed = lambda rows, why: rows.select("doc_id", F.col("id").alias("object_id"), F.col("type").alias("object_type"), F.lit(why).alias("reason"))
    inlined = consumed.select("doc_id", F.col("id").alias("object_id"), F.lit("Formula").alias("object_type"), F.lit("inlined into the paragraph that references it").alias("reason"))
    maths = objects.where(F.col("kind").isin(*MATH_TYPES)).join(consumed, ["doc_id", "id"], "left_anti")
    if include_math:
        said, sources = read_math(objects, speak, consumed)
        silent = maths.join(said.select("doc_id", F.col("unit_id").alias("id")), ["doc_id", "id"], "left_anti")
        skipped = skipped.unionByName(inlined).unionByName(listed(silent, "math object rendered to no prose"))
        units = units.unionByName(said)
    else:
        skipped = skipped.unionByName(inlined).unionByName(listed(maths, "math objects excluded from this build"))
        sources = maths.groupBy("doc_id").agg(F.count("*").alias("n")).where("false").select("doc_id", F.lit("none").alias("source"), "n")
    return MarkerTree(markers, assign_by_extent(units, markers), skipped, sources, objects)


def load_tree(spark: SparkSession, path: str, include_math: bool = True, speak: Callable[[str], str] | None = None) -> MarkerTree:
    """The marker trees of the files at a path."""
    return build_tree(documents.read_files(spark, path), include_math, speak)


def is_top_level(parent: Column) -> Column:
    return parent.isNull()
