"""Readers of document files: generic JSON and typed objects, one row per block, section, entry or skipped object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Where a type's text stands, types that hold none, and other names of types.
TEXT_PROPS = {
    "text": "paragraph abstract footnote sidenote code sourcecode algorithm".split(),
    "latex": "equation formula displayequation inlinemath".split(),
    "content": ["listitem"],
    "caption": "picture diagram figure caption".split(),
    "title": "section heading".split(),
}
ALIASES = {"displayequation": "equation", "inlinemath": "formula", "picture": "figure", "diagram": "figure", "sourcecode": "code"}
OTHER_PROPS = ("text", "content", "caption", "latex", "title")

GENERIC = (
    "meta MAP<STRING,STRING>, sections ARRAY<STRUCT<id:STRING,title:STRING,level:INT,parent:STRING,parent_id:STRING>>, "
    "blocks ARRAY<STRUCT<id:STRING,type:STRING,text:STRING,content:STRING,section:STRING,section_id:STRING,name:STRING,props:MAP<STRING,STRING>>>, bibliography ARRAY<STRING>"
)
OBJECTS = "objects ARRAY<STRUCT<id:STRING,type:STRING,props:MAP<STRING,STRING>,parent:STRING>>, meta MAP<STRING,STRING>"


@dataclass
class Corpus:
    """blocks, sections, bibliography and skipped, each keyed by doc_id."""

    blocks: DataFrame
    sections: DataFrame
    bibliography: DataFrame
    skipped: DataFrame


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("json"))


CODE = ("code", "sourcecode", "listing", "algorithm")


def load(spark: SparkSession, path: str, looking: bool = False) -> Corpus:
    """Documents of both kinds at a path, each read by its own reader. ``looking``: looks first which kinds there are, so that
    plans over a few documents hold one reader only."""
    files = read_files(spark, path)
    known = is_object_model(F.col("json"))
    kinds = {r[0] for r in files.select(known).distinct().collect()} if looking else {True, False}  # two rows at most
    if len(kinds) == 1:
        return objects(files) if True in kinds else generic(files)
    a, b = generic(files.where(~known)), objects(files.where(known))
    both = lambda name: getattr(a, name).unionByName(getattr(b, name))
    return Corpus(*[both(n) for n in ("blocks", "sections", "bibliography", "skipped")])


def blocks_of_type(corpus: Corpus, *kinds: str) -> DataFrame:
    return corpus.blocks.where(F.lower("type").isin([k.lower() for k in kinds]))


def full_text(corpus: Corpus, prose: tuple[str, ...]) -> DataFrame:
    """(doc_id, text): a document's prose, parted by empty lines."""
    rows = blocks_of_type(corpus, *prose).where(F.trim("text") != "")
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "\n\n").alias("text"))


def sections_in_order(corpus: Corpus) -> DataFrame:
    """Sections with ``place``, by level and id."""
    return corpus.sections.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("level", "section_id")) - 1)


def section(corpus: Corpus, section_id: str) -> DataFrame:
    return corpus.sections.where(F.col("section_id") == section_id)


def is_object_model(json: Column) -> Column:
    """Whether the first of ``objects`` has a type and props."""
    first = F.get(F.from_json(json, OBJECTS)["objects"], F.lit(0))
    return F.coalesce(first["type"].isNotNull() & first["props"].isNotNull(), F.lit(False))


def filled(*columns: Column) -> Column:
    """The first that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def generic(files: DataFrame) -> Corpus:
    """Generic schema; missing ids come from the position, whole numbers only for years and citations."""
    rows = files.select("doc_id", F.from_json("json", GENERIC).alias("d"))
    at = lambda name: rows.select("doc_id", F.posexplode(F.col("d")[name]).alias("ord", "x"))
    numbered = lambda prefix: F.concat(F.lit(prefix), F.col("ord").cast("string"))
    x = F.col("x")
    blocks = at("blocks").select("doc_id", "ord", filled(x["id"], numbered("blk_")).alias("block_id"), F.lower(F.coalesce(x["type"], F.lit("paragraph"))).alias("type"), F.coalesce(filled(x["text"], x["content"]), F.lit("")).alias("text"), filled(x["section_id"], x["section"]).alias("section_id"), filled(x["name"], x["props"]["name"], x["props"]["title"]).alias("name"))
    sections = at("sections").select("doc_id", "ord", filled(x["id"], numbered("sec_")).alias("section_id"), F.coalesce(x["title"], F.lit("")).alias("title"), F.coalesce(x["level"], F.lit(1)).alias("level"), filled(x["parent_id"], x["parent"]).alias("parent_id"))
    entry = F.from_json(x, "id STRING, title STRING, label STRING, year STRING, citations STRING, keywords ARRAY<STRING>")
    whole = lambda c, kind: F.when(c.rlike("^[0-9]+$"), c.try_cast(kind))
    plain = ~F.startswith(F.trim(x), F.lit("{"))
    bibliography = at("bibliography").withColumn("e", entry).select(
        "doc_id", "ord", filled(F.col("e.id"), numbered("bib_")).alias("bib_id"), F.when(plain, x).otherwise(F.coalesce("e.title", F.lit(""))).alias("title"),
        F.coalesce("e.label", F.lit("")).alias("label"), whole(F.col("e.year"), "int").alias("year"), whole(F.col("e.citations"), "bigint").alias("citations"), F.coalesce("e.keywords", F.array().cast("array<string>")).alias("keywords"),
    )
    empty = blocks.where(F.trim("text") == "").select("doc_id", F.col("block_id").alias("object_id"), F.col("type").alias("object_type"), F.lit("empty text").alias("reason"))
    return Corpus(blocks, sections, bibliography, empty)


def object_text(kind: Column, props: Column) -> Column:
    """Text of a typed object."""
    at = lambda name: props[name]
    alternatives = {"title": ("title", "heading", "text", "caption"), "latex": ("latex", "latex_source", "text"), "caption": ("caption", "text"), "content": ("content", "text"), "text": ("text", "content")}
    out = filled(*[at(p) for p in OTHER_PROPS])
    for prop, kinds in TEXT_PROPS.items():
        out = F.when(kind.isin(kinds), filled(*[at(p) for p in alternatives[prop]])).otherwise(out)
    return F.coalesce(out, F.lit(""))


def looks_like_reference(text: Column) -> Column:
    """At least two of a year, an author's initials and a venue word."""
    signs = (r"\b(19|20)\d{2}\b", r"\b[A-Z]\.\s?(?:[A-Z]\.\s?)?[A-Z][a-z]+|[A-Z][a-z]+,\s[A-Z]\.", r"(?i)\b(proc|proceedings|journal|conf|conference|arxiv|trans|vol|pp|press|springer|acm|ieee)\b")
    return sum((text.rlike(s).cast("int") for s in signs), F.lit(0)) >= 2


def objects(files: DataFrame) -> Corpus:
    """Typed objects: sections, blocks, references told by their text, and a reason for each object left out."""
    rows = files.select("doc_id", F.posexplode(F.from_json("json", OBJECTS)["objects"]).alias("ord", "o"))
    kind = F.lower(F.coalesce(F.col("o.type"), F.lit("")))
    rows = rows.select("doc_id", "ord", F.coalesce("o.id", F.concat(F.lit("obj_"), F.col("ord").cast("string"))).alias("id"), kind.alias("kind"), F.col("o.props").alias("props"), F.col("o.parent").alias("parent"))
    rows = rows.withColumn("text", object_text(F.col("kind"), F.col("props")))
    section = F.col("kind").isin("section", "heading")
    known = rows.where(section).select("doc_id", F.col("id").alias("parent"), F.lit(True).alias("known"))
    sections = rows.where(section).join(known, ["doc_id", "parent"], "left")
    sections = sections.select("doc_id", "ord", F.col("id").alias("section_id"), F.col("text").alias("title"), F.coalesce(F.col("props")["level"].try_cast("int"), F.lit(1)).alias("level"), F.when(F.col("known"), F.col("parent")).alias("parent_id"))
    reason = F.when(section, "section").when(F.trim("text") == "", F.concat(F.lit("no text under any known prop for type '"), "kind", F.lit("'")))
    rest = rows.withColumn("reason", reason)
    reference = (F.col("kind") == "listitem") & looks_like_reference(F.col("text"))
    alias = F.col("kind")
    for name, other in ALIASES.items():
        alias = F.when(F.col("kind") == name, other).otherwise(alias)
    kept = rest.where("reason is null")
    blocks = kept.select("doc_id", "ord", F.col("id").alias("block_id"), F.when(reference, "bibitem").otherwise(alias).alias("type"), "text", F.col("parent").alias("section_id"), filled(F.col("props")["name"], F.col("props")["title"]).alias("name"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    bibliography = kept.where(reference).select("doc_id", (F.row_number().over(order) - 1).alias("ord"), F.col("id").alias("bib_id"), F.col("text").alias("title"), F.lit("").alias("label"), F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("year"), F.lit(None).cast("bigint").alias("citations"), F.array().cast("array<string>").alias("keywords"))
    skipped = rest.where("reason is not null and reason <> 'section'").select("doc_id", F.col("id").alias("object_id"), F.col("kind").alias("object_type"), "reason")
    return Corpus(blocks, sections, bibliography, skipped)
