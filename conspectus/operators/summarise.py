"""Summaries of a marker tree's spans: summarisers, their cache, prompts with word bands, and the run's statistics.

A summariser turns (title, body) into struct(summary, abstraction, label, warnings); chat models are injected as
functions. Every marker with own text is summarised; what is cached is not computed again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import sentences as S
from ..functions import text as T
from . import summaries

# Word bands of the tiers, and their shares of a token ceiling.
BANDS = {"summary": (28, 34), "abstraction": (24, 30), "label": (22, 28)}
SHARES = {"summary": (0.8, 0.97), "abstraction": (0.69, 0.86), "label": (0.63, 0.8)}
CEILING = 50
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z(])"


def _none() -> Column:
    return F.array().cast("array<string>")


@dataclass
class Summariser:
    """name, whether it is deterministic and fit for measurements, and the function of (title, body)."""

    name: str
    summarise: Callable[[Column, Column], Column]
    deterministic: bool = True
    measurement_safe: bool = True


def bands_for(ceiling: int) -> dict[str, tuple[int, int]]:
    """Word bands of the tiers under a ceiling of tokens."""
    words = ceiling / summaries.TOKENS_PER_WORD
    return {tier: (round(words * a), round(words * b)) for tier, (a, b) in SHARES.items()}


def render_prompt(template: str, ceiling: int = CEILING) -> str:
    """A prompt with its placeholders filled: {ceiling}, {ceiling_words}, {summary}, {abstraction}, {label}, {label_low},
    {label_high}; raises if one is left."""
    bands = bands_for(ceiling)
    values = {"ceiling": ceiling, "ceiling_words": round(ceiling / summaries.TOKENS_PER_WORD), **{t: f"{a}-{b}" for t, (a, b) in bands.items()}, "label_low": bands["label"][0], "label_high": bands["label"][1]}
    out = template
    for name, value in values.items():
        out = out.replace("{" + name + "}", str(value))
    left = sorted(n for n in values if "{" + n + "}" in out)
    if left:
        raise ValueError(f"placeholders are left: {left}")
    return out


def sentences_upto(text: Column, budget: int) -> Column:
    """Whole sentences within the budget, the first at least; of a text without any, its first words."""
    parts = F.filter(F.transform(F.split(F.trim(text), SENTENCE), F.trim), lambda s: s != "")
    return summaries.words_upto(parts, budget)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(S.sanitised(text), F.lit("")), r"\s+", " ")


def _tiers(summary: Column, abstraction: Column, label: Column, warnings: Column) -> Column:
    return F.struct(summary.alias("summary"), abstraction.alias("abstraction"), label.alias("label"), warnings.alias("warnings"))


def extractive(title: Column, body: Column) -> Column:
    """The first sentences as summary and abstraction; the title and the first words as label."""
    text, head = _plain(body), _plain(title)
    room = F.greatest(F.lit(0), F.lit(BANDS["label"][1]) - T.word_count(head))
    lead = F.array_join(F.slice(T.words_of(text), F.lit(1), room), " ")
    label = F.regexp_replace(F.concat(head, F.lit(". "), lead), r"^[. ]+|[. ]+$", "")
    full = _tiers(sentences_upto(text, BANDS["summary"][1]), sentences_upto(text, BANDS["abstraction"][1]), label, _none())
    bare = _tiers(head, head, head, F.array(F.lit("empty body: title used")))
    return F.when(text == "", bare).otherwise(full)


def title_only(title: Column, body: Column) -> Column:
    """The clean title as label and nothing else: the ablation."""
    head = F.trim(_plain(title))
    return _tiers(F.lit(""), F.lit(""), head, F.when(head == "", F.array(F.lit("span has no title"))).otherwise(_none()))


def injected(chat: Callable[[str], dict]) -> Callable[[Column, Column], Column]:
    """A summariser from a function of a prompt to a dict of tiers; its failures become warnings and empty tiers."""

    @F.pandas_udf("summary string, abstraction string, label string, warnings array<string>")
    def call(title: pd.Series, body: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(title, body, strict=True):
            try:
                found = chat(f"{a or ''}\n\n{b or ''}")
                rows.append({t: S.sanitise(str(found.get(t) or "")) for t in BANDS} | {"warnings": []})
            except Exception as error:  # a failure is a record of its own
                rows.append(dict.fromkeys(BANDS, "") | {"warnings": [f"{type(error).__name__}: {error}"]})
        return pd.DataFrame(rows, columns=["summary", "abstraction", "label", "warnings"])

    return call


SUMMARISERS = {"extractive": Summariser("extractive", extractive, True, False), "title-only": Summariser("title-only", title_only)}


def make_summariser(name: str, measuring: bool = False) -> Summariser:
    """A summariser by name; one that is unfit for measurements is refused where they are taken."""
    if name not in SUMMARISERS:
        raise ValueError(f"unknown summariser {name!r}; known are {sorted(SUMMARISERS)}")
    if measuring and not SUMMARISERS[name].measurement_safe:
        raise ValueError(f"{name} is not fit for measurements")
    return SUMMARISERS[name]


def summary_key(title: Column, body: Column, model: str, prompt: str) -> Column:
    return ids.joined_hash(F.lit(model), F.lit(prompt), title, body)


@dataclass
class SummaryRun:
    """summaries (doc_id, span_id, title, summary, abstraction, label, warnings, cached, usable) and empty (doc_id, span_id)."""

    summaries: DataFrame
    empty: DataFrame
    fresh: DataFrame
    model: str
    deterministic: bool

    def usable(self) -> DataFrame:
        return self.summaries.where("usable")

    def stats(self) -> DataFrame:
        """One row: spans, usable, cached, generated, failed, empty, with_warnings and how labels fit their band."""
        fit = summaries.band_fit(F.col("label"), *BANDS["label"])
        out = self.summaries.agg(
            F.count("*").alias("spans"), F.count_if("usable").alias("usable"), F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("generated"),
            F.count_if(~F.col("usable")).alias("failed"), F.count_if(F.size("warnings") > 0).alias("with_warnings"), *[F.count_if(fit == f).alias(f"label_{f}") for f in ("under", "ok", "over")],
        )
        return out.crossJoin(self.empty.agg(F.count("*").alias("empty")))  # one row each


def basis_text(rows: DataFrame) -> Column:
    return summaries.basis_text(rows["label"], rows["abstraction"], rows["summary"])


def summarise_tree(tree, summariser: Summariser, cache: DataFrame | None = None, levels: tuple[int, ...] | None = None, prompt: str = "") -> SummaryRun:
    """Summaries of a ``MarkerTree``'s markers with own text; cache is (key, summary, abstraction, label, warnings).

    ``fresh`` of the result holds the new usable cache rows, each distinct text once.
    """
    spans = tree.summariser_titles().join(tree.body_text().withColumnRenamed("text", "body"), ["doc_id", "marker_id"])
    if levels is not None:
        spans = spans.join(tree.markers.where(F.col("level").isin(*levels)).select("doc_id", "marker_id"), ["doc_id", "marker_id"], "left_semi")
    spans = spans.withColumnRenamed("marker_id", "span_id")
    empty = spans.where(F.trim("body") == "").select("doc_id", "span_id")
    keyed = spans.where(F.trim("body") != "").withColumn("key", summary_key(F.col("title"), F.col("body"), summariser.name, prompt))
    tiers = ("summary", "abstraction", "label", "warnings")
    known = cache.select("key", *tiers) if cache is not None else keyed.where("false").select("key", *[F.lit("").alias(t) for t in tiers[:3]], _none().alias("warnings"))
    missing = keyed.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.first("title").alias("title"), F.first("body").alias("body"))
    made = missing.select("key", summariser.summarise(F.col("title"), F.col("body")).alias("t")).select("key", *[F.col(f"t.{t}") for t in tiers])
    both = known.withColumn("cached", F.lit(True)).unionByName(made.withColumn("cached", F.lit(False)))
    rows = keyed.join(both, "key")
    usable = F.trim(F.coalesce(basis_text(rows), F.lit(""))) != ""
    rows = rows.withColumn("usable", usable).select("doc_id", "span_id", "title", *tiers, "cached", "usable")
    fresh = made.where(F.trim(F.coalesce(basis_text(made), F.lit(""))) != "")
    return SummaryRun(rows, empty, fresh, summariser.name, summariser.deterministic)


def check_tiers(rows: DataFrame, most: float = summaries.MOST_OVERLAP) -> DataFrame:
    """Rows with ``problems``: tiers that open or repeat each other."""
    return rows.withColumn("problems", summaries.tier_pairs(rows["label"], rows["abstraction"], rows["summary"], most))


def assert_tiers(rows: DataFrame, most: float = summaries.MOST_OVERLAP) -> DataFrame:
    """Rows as they are; reading one whose tiers depend on each other raises."""
    found = summaries.tier_pairs(rows["label"], rows["abstraction"], rows["summary"], most)
    proven = F.when(F.size(found) == 0, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("tiers depend on each other: "), F.array_join(found, ", "))))
    return rows.withColumn("label", proven)


class SummaryCache:
    """Cache rows as Parquet below a path; a missing cache is empty, of equal keys the first written counts."""

    SCHEMA = "key string, summary string, abstraction string, label string, warnings array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).dropDuplicates(["key"])

    def put(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in self.SCHEMA.split(", ")]).write.mode("append").parquet(self.path)
