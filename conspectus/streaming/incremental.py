"""Incremental runs: streams of vectors are projected onto a stored basis and appended to its index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import projection
from ..sources.stores import CorpusStore


def project_stream(stream: DataFrame, store: CorpusStore, checkpoint: str, k: int = 8, id_col: str = "sentence_id", vector_col: str = "vector"):
    """Starts a query that writes the k best concepts of each arriving vector; a batch that runs again replaces itself."""
    concepts = store.load_basis().select("row_id", "vector")

    def put(batch: DataFrame, number: int) -> None:
        projection.top_k(batch, concepts, k, id_col, vector_col, "row_id").write.mode("overwrite").parquet(f"{store.path}/hits/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
