"""Checks of a run's span records, each a table of one row with what was counted and whether it passed, and their report.

Span records are (doc_id, span_id, title_raw, concepts array<struct<tier_label, tier_abstraction, tier_summary, basis_text,
...>>); flat records of one concept are wrapped as one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import text as T
from . import summaries, summarise

FLAT = ("tier_label", "tier_abstraction", "tier_summary", "basis_text")


def schema_of(records: DataFrame) -> str:
    """concept or flat."""
    return "concept" if "concepts" in records.columns else "flat"


def concepts_of(records: DataFrame) -> DataFrame:
    """(doc_id, span_id, title_raw, concept_index and the concept's fields), one row a concept."""
    base = ["doc_id", "span_id", "title_raw"]
    if schema_of(records) == "concept":
        return records.select(*base, F.posexplode("concepts").alias("concept_index", "c")).select(*base, "concept_index", *[F.col(f"c.{n}").alias(n) for n in FLAT])
    return records.select(*base, F.lit(0).alias("concept_index"), *FLAT)


def gate_basis_text(records: DataFrame, ablation: bool = False) -> DataFrame:
    """Every basis text keeps the promises of cleaning; in an ablation it may open with its title."""
    title = F.lit("") if ablation else F.coalesce("title_raw", F.lit(""))
    found = F.when(F.col("basis_text").isNotNull(), L.basis_problems(F.col("basis_text"), title))
    rows = concepts_of(records).withColumn("problems", found)
    bad = F.size("problems") > 0
    out = rows.agg(F.count("*").alias("concepts"), F.count("basis_text").alias("checked"), F.coalesce(F.sum(F.when(bad, F.size("problems"))), F.lit(0)).alias("violations"), F.count_if(bad).alias("texts_violating"))
    return out.withColumn("clean_fraction", F.when(F.col("checked") > 0, F.round(1 - F.col("texts_violating") / F.col("checked"), 6))).withColumn("passed", F.col("violations") == 0)


def gate_tiers(records: DataFrame, bands: dict[str, tuple[int, int]] | None = None, most: float = summaries.MOST_OVERLAP) -> DataFrame:
    """No tier opens or repeats another; how the tiers fit the run's own word bands."""
    rows = concepts_of(records)
    tiers = {t: F.trim(F.coalesce(f"tier_{t}", F.lit(""))) for t in summaries.TIERS}
    rows = rows.withColumn("problems", summaries.tier_pairs(tiers["label"], tiers["abstraction"], tiers["summary"], most))
    several = sum(((c != "").cast("int") for c in tiers.values()), F.lit(0)) > 1
    ends = lambda word: F.coalesce(F.sum(F.size(F.filter("problems", lambda p: F.endswith(p, F.lit(word))))), F.lit(0))
    fits = []
    for tier, (low, high) in (bands or summarise.BANDS).items():
        fit = F.when(tiers[tier] != "", summaries.band_fit(tiers[tier], low, high))
        fits += [F.count_if(fit == name).alias(f"{tier}_{name}") for name in ("under", "ok", "over")]
    out = rows.agg(F.count("*").alias("concepts"), F.count_if(several).alias("comparable"), ends("prefix").alias("prefix_relations"), ends("overlap").alias("overlaps"), *fits)
    return out.withColumn("passed", (F.col("prefix_relations") + F.col("overlaps")) == 0)


def report(name: str, gate: DataFrame) -> str:
    """A gate as text: its verdict and what it counted."""
    row = gate.first().asDict()
    head = f"{name}: {'PASS' if row.pop('passed') else 'FAIL'}"
    return "\n".join([head, *(f"  {k}: {v}" for k, v in row.items())])


def run_gates(records: DataFrame, expected: DataFrame, labels: DataFrame | None = None, bands: dict | None = None, ablation: bool = False) -> dict[str, dict]:
    """All gates by name, as plain values; the structural gate only where labels (span_id, structural) are given.

    Structural decisions are the records' ``structural_class``.
    """
    keyed = records.withColumn("span_id", F.concat_ws("/", "doc_id", "span_id"))
    gates = {
        "persistence": summaries.gate_persistence(keyed, expected.select(F.concat_ws("/", "doc_id", "span_id").alias("span_id")), ["doc_id"]),
        "basis_text": gate_basis_text(records, ablation), "tiers": gate_tiers(records, bands),
    }
    if labels is not None:
        decisions = keyed.select("span_id", F.col("structural_class").isNotNull().alias("structural"))
        scored = summaries.gate_structural(decisions, labels.select(F.concat_ws("/", "doc_id", "span_id").alias("span_id"), "structural"))
        gates["structural"] = scored.withColumn("passed", (F.coalesce("recall", F.lit(1.0)) == 1.0) & (F.coalesce("precision", F.lit(1.0)) == 1.0))
    return {name: json.loads(gate.toJSON().first()) for name, gate in gates.items()}


def concept_report(records: DataFrame) -> DataFrame:
    """(doc_id, markdown): each document's concepts under its spans."""
    rows = concepts_of(records).withColumn("line", F.concat(F.lit("- "), T.squeezed(F.coalesce("tier_label", F.lit("(none)")))))
    spans = rows.groupBy("doc_id", "span_id", "title_raw").agg(F.array_join(F.array_sort(F.collect_list(F.struct("concept_index", "line")))["line"], "\n").alias("lines"))
    part = F.concat(F.lit("## "), F.coalesce("title_raw", F.lit("")), F.lit("\n"), "lines")
    return spans.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("span_id", part.alias("t"))))["t"], "\n\n").alias("markdown"))
