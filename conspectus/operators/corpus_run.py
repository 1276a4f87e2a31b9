"""A corpus from its trees to a basis: summarise, clean, set structure aside, embed, fold, and record every span."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import structural
from ..functions.embedders import Embedder
from . import basis, summaries
from .summarise import Summariser, summarise_tree

DECISIONS = ("added", "merged", "skipped")


@dataclass
class Run:
    """records: one row a span, those without text too; basis: its rows, the reserved one first; candidates: what was folded."""

    records: DataFrame
    basis: DataFrame
    candidates: DataFrame


def run(tree, summariser: Summariser, embedder: Embedder, tau: float = basis.TAU, cache: DataFrame | None = None) -> Run:
    """Runs a ``MarkerTree`` through. A span whose title names structure goes to the reserved row and not to the fold.

    Documents are folded in order of their id, candidates of a document by level and label.
    """
    made = summarise_tree(tree, summariser, cache)
    spans = tree.markers.select("doc_id", F.col("marker_id").alias("span_id"), "level", "flow_index", "is_appendix", "title_raw", F.col("title").alias("title_cleaned"))
    spans = spans.withColumn("structural_class", structural.structural_class(structural.normalise_title(F.col("title_raw")), F.col("is_appendix")))
    rows = spans.join(made.summaries.drop("title"), ["doc_id", "span_id"], "left")
    raw = summaries.basis_text(F.col("label"), F.col("abstraction"), F.col("summary"))
    rows = L.with_basis_text(rows.withColumn("__raw", raw), "__raw", "title_raw" if summariser.name != "title-only" else None)
    usable = F.coalesce(F.col("usable"), F.lit(False)) & (F.size("basis.problems") == 0) & (F.col("basis.text") != "")
    # kept, as the fold, its decisions, the reserved row and the records all read them: nothing is embedded twice
    rows = rows.withColumn("basis_text", F.when(usable, F.col("basis.text"))).persist()
    texts = rows.where("basis_text is not null").select("doc_id", "span_id", "level", "structural_class", "basis_text", embedder.encode(F.col("basis_text")).alias("vector")).persist()
    candidates = texts.where("structural_class is null").select("level", F.col("basis_text").alias("label"), "vector", F.col("doc_id").alias("document"), "span_id")
    decided = basis.integrations(candidates, tau).withColumnsRenamed({"document": "doc_id", "row_id": "row_id_assigned"})
    sink = basis.absorb_structural(texts.where("structural_class is not null").select(F.col("basis_text").alias("label"), "vector", F.col("doc_id").alias("document")), embedder.dim)
    merged = basis.fold(candidates, tau)
    concept = F.struct(F.col("label").alias("tier_label"), F.col("abstraction").alias("tier_abstraction"), F.col("summary").alias("tier_summary"), "basis_text", F.lit(embedder.name).alias("embedding_model"), F.lit(embedder.revision).alias("embedding_revision"), F.coalesce("row_id_assigned", F.when(F.col("structural_class").isNotNull() & F.col("basis_text").isNotNull(), basis.SINK)).alias("row_id_assigned"), F.col("decision").alias("merge_decision"), F.col("cosine").alias("merge_cosine"))
    met = rows.join(decided.select("doc_id", "span_id", "row_id_assigned", "decision", "cosine"), ["doc_id", "span_id"], "left")
    has = F.col("label").isNotNull()
    records = met.select("doc_id", "span_id", "level", "flow_index", "is_appendix", "title_raw", "title_cleaned", F.col("basis.rules").alias("cleaning_rules_fired"), "structural_class", F.when(has, F.array(concept)).otherwise(F.array().cast(f"array<{_kind(met, concept)}>")).alias("concepts"))
    return Run(records, sink.unionByName(merged), candidates)


def _kind(rows: DataFrame, column) -> str:
    return rows.select(column.alias("c")).schema["c"].dataType.simpleString()
