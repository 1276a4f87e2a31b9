"""Five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Null texts count as empty ones; an empty table passes through; columns
other than doc_id, text, source and n_chars are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conspectus.llm.classifier import quality_model, score
from conspectus.llm.line_dedup import dedup_lines
from conspectus.llm.minhash import one_of_each
from conspectus.llm.mixing import WORD, mixed
from conspectus.llm.packing import pack_documents
from conspectus.llm.shared import free_names, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.5)."""
    (scored,) = free_names(docs, "__score")
    return score(docs, quality_model(spark, sf_dir, docs), keep=tuple(docs.columns), score_col=scored).where(F.col(scored) >= 0.5).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated runs of lines; n_chars follows the text."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return one_of_each(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of equal id, source and size share their copies, rounded up."""
    size, copies, own, of, n = free_names(docs, "__size", "__copies", "__own", "__of", "__n")
    shared = F.ceil(F.sum("copies") / F.count("*")).cast("int").alias(copies)
    taken = mixed(docs).groupBy(F.col("doc_id").alias(own), F.col("source").alias(of), F.col("size").alias(n)).agg(shared).where(F.col(copies) > 0)
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(of)) & (F.col(size) == F.col(n))
    met = sized.join(taken.hint("shuffle_hash"), same)
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(size)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placements of all documents in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
