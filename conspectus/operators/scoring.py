"""Quality metrics of concept candidates as aggregates over matched blocks, and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coverage_curve

# Weights of the metrics.
WEIGHTS = {"structural": 0.25, "coverage": 0.20, "purity": 0.10, "information_gain": 0.15, "embedding_variance": 0.10, "citation_importance": 0.10, "reusability": 0.10}
THETA = 0.5
NEUTRAL = 0.5
YEAR = 2026


def entropy(sum_x_log_x: Column, total: Column) -> Column:
    """Entropy in bits of counts, from their sum and that of each times its logarithm."""
    return F.when(total > 0, F.log2(total) - sum_x_log_x / total).otherwise(0.0)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def match_metrics(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """coverage, purity and information gain of each candidate.

    matches is (candidate, block, label), one row a match; labels is (label, n), the blocks of each label. Labels that a
    candidate does not meet enter through totals, so no candidate is crossed with all labels.
    """
    total = labels.agg(F.sum("n").alias("blocks"), F.sum(_xlogx(F.col("n"))).alias("all"))
    per = matches.groupBy("candidate", "label").agg(F.count("*").alias("hit")).join(labels, "label")
    rest = F.col("n") - F.col("hit")
    agg = per.groupBy("candidate").agg(F.sum("hit").alias("hits"), F.max("hit").alias("top"), F.sum(_xlogx(F.col("hit"))).alias("inner"), F.sum(_xlogx(rest)).alias("outer"), F.sum(_xlogx(F.col("n"))).alias("met"))
    agg = agg.crossJoin(F.broadcast(total))  # one row
    inside = entropy(F.col("inner"), F.col("hits"))
    outside = entropy(F.col("outer") + F.col("all") - F.col("met"), F.col("blocks") - F.col("hits"))
    whole = entropy(F.col("all"), F.col("blocks"))
    share = F.col("hits") / F.col("blocks")
    conditional = share * inside + (1 - share) * outside
    # labels of one kind have no entropy but for rounding
    gain = F.when(whole > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (whole - conditional) / whole))).otherwise(NEUTRAL)
    gain = F.when((whole > 1e-9) & (F.col("hits") == F.col("blocks")), 0.0).otherwise(gain)
    return agg.select("candidate", F.col("hits").alias("matches"), F.round(coverage_curve(share), 6).alias("coverage"), F.round(1 - F.col("top") / F.col("hits"), 6).alias("purity"), F.round(gain, 6).alias("information_gain"))


def embedding_variance(matches: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """1 - half the summed population variance of matched vectors; 0.5 under two matches."""
    agg = matches.groupBy("candidate").agg(F.count("*").alias("n"), *[F.var_pop(F.get(vector_col, F.lit(i))).alias(f"v{i}") for i in range(dim)])
    spread = sum((F.col(f"v{i}") for i in range(1, dim)), F.col("v0"))
    value = F.when(F.col("n") < 2, NEUTRAL).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spread / 2)))
    return agg.select("candidate", F.round(value, 6).alias("embedding_variance"))


def citation_importance(citations: Column, year: Column, now: int = YEAR) -> Column:
    """Log citations to 10,000, four fifths of it after five years; neutral without citations."""
    base = F.least(F.lit(1.0), F.log10(citations + 1.0) / 4)
    return F.when(citations.isNull(), NEUTRAL).otherwise(F.round(base * F.when(year.isNotNull() & (F.lit(now) - year <= 5), 1.0).otherwise(0.8), 6))


def reusability(words: Column, frequency: Column, most: Column) -> Column:
    """Mean rarity of a name's words and a bonus for length; ``frequency`` is the array of their counts."""
    rarity = F.transform(frequency, lambda f: 1 - F.log1p(f.cast("double")) / F.log1p(F.greatest(most, F.lit(1)).cast("double")))
    base = F.aggregate(rarity, F.lit(0.0), lambda a, x: a + x) / F.size(words)
    bonus = F.least(F.lit(0.15), 0.05 * (F.size(words) - 1))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + bonus)), 6))


def quality(metrics: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of metrics, weights scaled to a sum of absolutes of 1; missing metrics are neutral."""
    scale = sum(abs(w) for w in weights.values()) or 1.0
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(metrics[name], F.lit(NEUTRAL)) * (weight / scale)
    return F.round(total, 6)
