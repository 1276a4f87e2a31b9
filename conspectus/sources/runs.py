"""Run directories: span records, basis rows and a manifest that is written last and marks the run as whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import conform


class IncompleteRun(ValueError):
    """A run whose spans are not those expected, or that was never finished."""


def write_run(spark: SparkSession, path: str, spans: DataFrame, basis: DataFrame, expected: int, fields: dict[str, str], key: str = "span_id", **facts) -> None:
    """Writes a run; raises and leaves no manifest if spans are missing, too many, without key or repeated.

    ``fields`` is the contract of span records (see ``conform``). Spans are counted from what was written.
    """
    path = path.rstrip("/")
    conform(spans, fields).write.mode("errorifexists").json(f"{path}/spans", ignoreNullFields=False)
    written = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in fields.items())).json(f"{path}/spans")
    got = written.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col(key).isNull()).alias("unnamed")).first()
    if (got["rows"], got["repeated"], got["unnamed"]) != (expected, 0, 0):
        raise IncompleteRun(f"expected {expected} spans, got {got['rows']}, {got['repeated']} keys repeated, {got['unnamed']} null")
    basis.write.mode("errorifexists").parquet(f"{path}/basis")
    manifest = json.dumps({**facts, "expected": expected, "fields": fields}, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def read_run(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, spans, basis) of a finished run; raises if it has no manifest."""
    path = path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise IncompleteRun(f"{path} was not finished")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    schema = ", ".join(f"`{n}` {t}" for n, t in manifest["fields"].items())
    return manifest, spark.read.schema(schema).json(f"{path}/spans"), spark.read.parquet(f"{path}/basis")
