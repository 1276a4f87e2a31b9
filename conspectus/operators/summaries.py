"""Summary tiers: bands, independence, and checks of a run's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Tokens to a word, and the greatest overlap of two tiers.
TOKENS_PER_WORD = 1.441
MOST_OVERLAP = 0.6
TIERS = ("label", "abstraction", "summary")


def tier_pairs(label: Column, abstraction: Column, summary: Column, most: float = MOST_OVERLAP) -> Column:
    """Array of violations: ``a/b prefix`` or ``a/b overlap`` of tiers that are present."""
    tiers = dict(zip(TIERS, (label, abstraction, summary), strict=True))
    found = []
    for i, a in enumerate(TIERS):
        for b in TIERS[i + 1 :]:
            x, y = T.squeezed(F.lower(tiers[a])), T.squeezed(F.lower(tiers[b]))
            present = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
            found.append(F.when(present & (F.startswith(y, x) | F.startswith(x, y)), f"{a}/{b} prefix"))
            found.append(F.when(present & (T.jaccard(T.token_set(x), T.token_set(y)) > most), f"{a}/{b} overlap"))
    return F.array_compact(F.array(*found))


def basis_text(label: Column, abstraction: Column, summary: Column) -> Column:
    """The first tier that is there."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in (label, abstraction, summary)])


def band_fit(text: Column, low: int, high: int) -> Column:
    n = T.word_count(text)
    return F.when(n < low, "under").when(n > high, "over").otherwise("ok")


def words_upto(sentences: Column, budget: int) -> Column:
    """Whole sentences within a word budget; at least the first."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def step(acc, s):
        n = acc["n"] + T.word_count(s)
        fits = acc["open"] & ((n <= budget) | (F.size(acc["kept"]) == 0))
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), F.when(fits, F.array_append(acc["kept"], s)).otherwise(acc["kept"]).alias("kept"), fits.alias("open"))

    return F.aggregate(sentences, start, step, lambda acc: F.array_join(acc["kept"], " "))


def gate_persistence(spans: DataFrame, expected: DataFrame, required: list[str], key: str = "span_id") -> DataFrame:
    """One row: expected, got, missing, extra, repeated and incomplete span records, and whether the gate passes."""
    got = spans.groupBy(key).agg(F.count("*").alias("n"), F.max(F.greatest(F.lit(0), *[F.col(c).isNull().cast("int") for c in required])).alias("holes"))
    both = expected.select(key).distinct().withColumn("wanted", F.lit(1)).join(got, key, "full")
    out = both.agg(
        F.count("wanted").alias("expected"), F.count("n").alias("got"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"),
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("holes") > 0).alias("incomplete"),
    )
    return out.withColumn("passed", (F.col("missing") + F.col("extra") + F.col("repeated") + F.col("incomplete")) == 0)


def gate_structural(decisions: DataFrame, labels: DataFrame, key: str = "span_id") -> DataFrame:
    """Recall and precision of structural decisions against labels, both (span_id, structural)."""
    both = labels.select(key, F.col("structural").alias("truth")).join(decisions.select(key, F.col("structural").alias("said")), key, "left")
    tp, fp, fn = F.count_if(F.col("truth") & F.col("said")), F.count_if(~F.col("truth") & F.col("said")), F.count_if(F.col("truth") & ~F.coalesce("said", F.lit(False)))
    return both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select("*", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
