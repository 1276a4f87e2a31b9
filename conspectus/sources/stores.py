"""Stores: the versioned basis and its index, caches, append-only logs and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import basis as B


class VersionMismatch(ValueError):
    """Rows of one basis version were met by another."""


class CorpusStore:
    """A basis and the coordinates of sentences under it, as Parquet below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save_basis(self, rows: DataFrame, **provenance: str) -> str:
        """Writes rows in canonical order with their version, which is returned."""
        version = B.version(rows).first()["basis_version"]
        out = B.ordered(rows).withColumn("basis_version", F.lit(version))
        for key, value in provenance.items():
            out = out.withColumn(key, F.lit(value))
        out.write.mode("overwrite").parquet(f"{self.path}/basis")
        return version

    def load_basis(self) -> DataFrame:
        """The basis; raises if its rows do not hash to their version."""
        rows = self.spark.read.parquet(f"{self.path}/basis")
        stored = [r[0] for r in rows.select("basis_version").distinct().limit(2).collect()]
        if len(stored) > 1 or stored and B.version(rows).first()["basis_version"] != stored[0]:
            raise VersionMismatch("the stored rows do not have the stored version")
        return rows

    def save_projections(self, rows: DataFrame, version: str) -> None:
        """Appends rows (…, ces, basis_version) partitioned by version; refuses other versions and drops rows without vector."""
        if rows.where(F.coalesce(F.col("basis_version") != version, F.lit(True))).limit(1).count():
            raise VersionMismatch("projections of another basis version")
        rows.where("ces is not null").write.mode("append").partitionBy("basis_version").parquet(f"{self.path}/index")

    def load_index(self, version: str) -> DataFrame:
        """Projections of the version; raises if the index has none of it but some of others."""
        rows = self.spark.read.parquet(f"{self.path}/index")
        own = rows.where(F.col("basis_version") == version)
        if not own.limit(1).count() and rows.limit(1).count():
            raise VersionMismatch("the index is of another basis version")
        return own

    def info(self) -> DataFrame:
        """Rows by version and level, from metadata columns only."""
        return self.spark.read.parquet(f"{self.path}/basis").groupBy("basis_version", "level").agg(F.count("*").alias("rows"), F.count_if(F.col("support") == 1).alias("singletons"))


class Log:
    """Append-only JSON lines; damaged lines are passed over."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "query_id string, basis_version string, query string, margin double, annotated string, created_at string"):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        """Adds entries; each gets its id from version and query."""
        rows.withColumn("query_id", ids.query_id(F.col("basis_version"), F.col("query"))).write.mode("append").json(self.path)

    def read(self, version: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).option("mode", "DROPMALFORMED").json(self.path)
        return rows if version is None else rows.where(F.col("basis_version") == version)


def encode_cached(texts: DataFrame, cache: DataFrame, embed, model: str, revision: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with vector, new cache rows): each distinct missing text is encoded once."""
    keyed = texts.withColumn("key", ids.cache_key(F.col(text_col), F.lit(model), F.lit(revision)))
    missing = keyed.select("key", text_col).dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = missing.select("key", embed(F.col(text_col)).alias("vector"))
    return keyed.join(cache.select("key", "vector").unionByName(fresh), "key", "left").drop("key"), fresh


def conform(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Exactly the contract's fields: unknown columns raise, missing ones become null."""
    unknown = set(rows.columns) - set(fields)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def stale(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(path, stale) of files against known (path, sha256); null where nothing is known."""
    now = fingerprint(spark, path).select("path", F.col("sha256").alias("now"))
    return now.join(known.select("path", "sha256"), "path", "left").select("path", (F.col("now") != F.col("sha256")).alias("stale"))
