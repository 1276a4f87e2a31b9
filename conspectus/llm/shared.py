"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one (tests) gets a folder of its own; on a
    cluster that would be a folder which other machines do not see, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="conspectus-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Sets a session option for the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it again.

    Executors lost later cost no recomputation of what stands before; the shuffle files of the write go with its end.
    The table stays until ``forget`` or until the folder's owner clears it, as later plans may read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bounds the rows of an Arrow batch, so that long texts do not pile up in a Python worker."""
    now = int(spark.conf.get(BATCH, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(BATCH, str(rows))


def carried(df: DataFrame, keep: tuple[str, ...], *made: str) -> tuple[list[Column], list[str], str, list[str]]:
    """For operators that carry columns along: those columns under working names, these names, their schema, and the
    result's names: ``keep`` and the made ones, which are renamed freely if taken."""
    work = [f"__kept_{i}" for i in range(len(keep))]
    columns = [F.col(f"`{c}`").alias(w) for c, w in zip(keep, work, strict=True)]
    schema = "".join(f"`{w}` {f.dataType.simpleString()}, " for w, f in zip(work, df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, strict=True))
    return columns, work, schema, [*keep, *free_names(df.select(*[F.col(f"`{c}`") for c in keep]), *made)]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
