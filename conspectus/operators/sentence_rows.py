"""Sentences of marker trees and of documents, and their projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import text as T
from . import basis, projection

MIN_CHARS = 20
TOP_K = 8


def sentences_from_tree(tree, levels: tuple[int, ...] | None = None, include_orphans: bool = True, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, sentence_id, text, span_id, source_id, flow_index, ordinal) of a ``MarkerTree``, in reading order by the last three.

    Orphans (units before the first marker) have no span and are left out where levels are asked for.
    """
    units = tree.units
    if levels is not None:
        wanted = tree.markers.where(F.col("level").isin(*levels)).select("doc_id", "marker_id")
        units = units.join(wanted, ["doc_id", "marker_id"], "left_semi")
    elif not include_orphans:
        units = units.where("marker_id is not null")
    rows = units.select("doc_id", "unit_id", F.col("marker_id").alias("span_id"), "flow_index", F.posexplode(S.sentences(F.col("text"))).alias("ordinal", "text"))
    name = F.concat("unit_id", F.lit("#s"), F.col("ordinal").cast("string"))
    return rows.where(F.char_length("text") >= min_chars).select("doc_id", name.alias("sentence_id"), "text", "span_id", F.col("unit_id").alias("source_id"), "flow_index", "ordinal")


def sentence_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Sentences, sources, spans, orphaned, and least, upper median and most words; one row, or one for each of ``keys``."""
    counted = rows.withColumn("w", T.word_count(F.col("text")))
    out = counted.groupBy(*keys).agg(
        F.count("*").alias("sentences"), F.count_distinct("source_id").alias("sources"), F.count_distinct("span_id").alias("spans"), F.count_if(F.col("span_id").isNull()).alias("orphaned"),
        F.min("w").alias("words_min"), F.percentile("w", F.lit(0.5)).alias("mid"), F.max("w").alias("words_max"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w DESC)").cast("int").alias("words_median"),
    )
    return out.drop("mid")


def project_sentences(rows: DataFrame, basis_rows: DataFrame, encode: Callable[[Column], Column], model: str, revision: str, k: int = TOP_K, store_vectors: bool = False) -> DataFrame:
    """Each sentence with ``hits`` (array of row_id, label, level, similarity, rank), basis_version, model and revision; with
    ``ces``, its coordinates in the basis's canonical order, if wanted. sentence ids are unique within a document."""
    keyed = rows.withColumn("__key", F.to_json(F.struct("doc_id", "sentence_id"))).withColumn("__v", encode(F.col("text")))
    labels = basis_rows.select("row_id", "label", "level")
    hits = projection.top_k(keyed, basis_rows, k, "__key", "__v", "row_id", "vector").join(labels, "row_id")
    listed = hits.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "label", "level", "similarity"))).alias("hits"))
    out = keyed.drop("__v").join(listed, "__key", "left")
    if store_vectors:
        ordered = basis.ordered(basis_rows).select(F.col("ord"), "vector")
        out = out.join(projection.coordinates(keyed, ordered, "__key", "__v", "ord", "vector"), "__key", "left")
    version = basis.version(basis_rows).select("basis_version")
    return out.crossJoin(F.broadcast(version)).drop("__key").select("*", F.lit(model).alias("embedding_model"), F.lit(revision).alias("embedding_revision"))  # one row


def margin(hits: Column) -> Column:
    """First similarity less the second; 0 under two hits."""
    return F.when(F.size(hits) > 1, F.round(hits[0]["similarity"] - hits[1]["similarity"], 6)).otherwise(0.0)
