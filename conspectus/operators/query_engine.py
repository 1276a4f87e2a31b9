"""Questions to a basis and its sentence index: categories, neighbours, and both as one result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.embedders import Embedder
from . import basis, projection

TOP = 5


@dataclass
class QueryEngine:
    """basis rows (level, row_id, label, vector, support), an embedder, and the index: sentences with their coordinates.

    index: (sentence_id, text, document, span_id, ces, hits), hits with labels, as ``sentence_rows.project_sentences``
    stores them; without one there are no neighbours. Every method takes a table of queries (query_id, text).
    """

    basis_rows: DataFrame
    embedder: Embedder
    index: DataFrame | None = None

    def _vectors(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", self.embedder.encode(F.col("text")).alias("vector"))

    def ces_vector(self, queries: DataFrame) -> DataFrame:
        """(query_id, ces): one cosine a row of the basis, in canonical order."""
        rows = basis.ordered(self.basis_rows).select("ord", "vector")
        return projection.coordinates(self._vectors(queries), rows, "query_id", "vector", "ord", "vector")

    def categories(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """(query_id, rank, row_id, label, level, similarity)."""
        rows = basis.ordered(self.basis_rows)
        hits = projection.top_k(self._vectors(queries), rows, k, "query_id", "vector", "ord", "vector")
        return hits.join(rows.select("ord", "row_id", "label", "level"), "ord").select("query_id", "rank", "row_id", "label", "level", "similarity")

    def neighbours(self, queries: DataFrame, k: int = TOP, categories: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, sentence_id, text, document, span_id, similarity, shared): the nearest sentences of the index, and
        the labels that they share with the query's categories, in the sentence's order."""
        if self.index is None:
            return queries.where("false").selectExpr("query_id", "0 as rank", "'' as sentence_id", "'' as text", "'' as document", "'' as span_id", "0D as similarity", "array('') as shared")
        found = projection.neighbours(self.ces_vector(queries).withColumnRenamed("query_id", "id"), self.index.select(F.col("sentence_id").alias("id"), "ces"), k, "id", itself=True)
        met = found.select(F.col("query").alias("query_id"), F.col("neighbour").alias("sentence_id"), "similarity", "rank").join(self.index.select("sentence_id", "text", "document", "span_id", F.col("hits.label").alias("theirs")), "sentence_id")
        own = (categories if categories is not None else self.categories(queries)).groupBy("query_id").agg(F.collect_set("label").alias("own"))
        met = met.join(own, "query_id", "left")
        shared = F.filter("theirs", lambda x: F.array_contains("own", x))
        return met.select("query_id", "rank", "sentence_id", "text", "document", "span_id", "similarity", F.coalesce(shared, F.array().cast("array<string>")).alias("shared"))

    def query(self, queries: DataFrame, concepts: int = TOP, neighbours: int = TOP) -> DataFrame:
        """One row a query: query_id (of version and text), basis_version, model, categories, neighbours, margin and the text
        with its concepts behind it."""
        named = self.categories(queries, concepts)
        near = self.neighbours(queries, neighbours, named)
        listed = lambda rows, name, *columns: rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias(name))
        out = queries.join(listed(named, "categories", "row_id", "label", "level", "similarity"), "query_id", "left")
        out = out.join(listed(near, "neighbours", "sentence_id", "text", "document", "span_id", "similarity", "shared"), "query_id", "left")
        version = basis.version(self.basis_rows).select("basis_version")
        hit = lambda i: F.get("categories", F.lit(i))["similarity"]
        margin = F.when(F.size("categories") > 1, F.round(hit(0) - hit(1), 6)).otherwise(0.0)
        text = F.when(F.size("categories") > 0, projection.annotated(F.col("text"), F.col("categories.label"))).otherwise(F.col("text"))
        out = out.crossJoin(F.broadcast(version))  # one row
        return out.select(ids.query_id(F.col("basis_version"), F.col("text")).alias("query_id"), F.col("text").alias("query"), "basis_version", F.lit(self.embedder.name).alias("embedding_model"), "categories", "neighbours", margin.alias("margin"), text.alias("annotated"))
