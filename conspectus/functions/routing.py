"""Which embedding model a type of block goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "sentencebert"

# Types by model, and those that no present document holds.
MODELS = {
    "sentencebert": "paragraph abstract heading section caption footnote sidenote listitem bibliography bibitem bibentry table figure".split(),
    "mathbert": "equation formula displayequation inlinemath".split(),
    "codebert": "code sourcecode listing algorithm".split(),
}
DORMANT = frozenset("code sourcecode listing algorithm".split())


def model_for_type(kind: Column, override: str | None = None) -> Column:
    """An explicit model, else the type's, else the default."""
    if override:
        return F.lit(override)
    out = F.lit(DEFAULT)
    for model, kinds in MODELS.items():
        if model != DEFAULT:
            out = F.when(F.lower(kind).isin(kinds), model).otherwise(out)
    return out


def routing_table(spark: SparkSession) -> DataFrame:
    """(type, model, dormant) in order of type."""
    rows = sorted((kind, model, kind in DORMANT) for model, kinds in MODELS.items() for kind in kinds)
    return spark.createDataFrame(rows, "type string, model string, dormant boolean")


def group_by_model(blocks: DataFrame, type_col: str = "type", override: str | None = None) -> DataFrame:
    """(model, types, n): the distinct types that go to each model, in order."""
    kind = F.lower(F.col(type_col))
    return blocks.groupBy(model_for_type(F.col(type_col), override).alias("model")).agg(F.array_sort(F.collect_set(kind)).alias("types"), F.count("*").alias("n"))
