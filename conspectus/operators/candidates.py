"""Concept candidates: merging, absorption and section spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_label
from ..functions.text import structural_weight


def merge_candidates(candidates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per name (and ``keys``): the winner by weight, source and name, summed frequency, all sources and aliases.

    candidates is (name, source, frequency, ...).
    """
    rows = candidates.withColumn("key", canonical_label(F.col("name"))).withColumn("weight", structural_weight(F.col("source")))
    # of equal weights and sources the greatest name wins
    best = F.max(F.struct("weight", "source", "name")).alias("best")
    merged = rows.groupBy(*keys, "key").agg(best, F.sum("frequency").alias("frequency"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("name")).alias("aliases"))
    return merged.select(*keys, "key", F.col("best.name").alias("name"), F.col("best.source").alias("source"), F.col("best.weight").alias("weight"), "frequency", "sources", "aliases")


def absorb(phrases: DataFrame, name: str = "name", count: str = "frequency", keys: tuple[str, ...] = ()) -> DataFrame:
    """Phrases without those that hold a kept, shorter phrase (as words, in any case) of at least their own count.

    Phrases meet within ``keys``. Each meets its own inner word runs only, found by equality, so the join grows with
    phrase length and not with the square of the phrases. Whatever a dropped phrase would absorb, its absorber
    absorbs too. Phrases, which are read three times, are made once and kept on the executors (memory and disk).
    """
    phrases = phrases.localCheckpoint()
    words = F.split(F.lower(name), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inner = phrases.withColumn("w", words).where(F.size("w") > 1).select(*keys, F.col(name).alias("long"), F.col(count).alias("own"), F.explode(F.array_distinct(runs)).alias("run"))
    most = phrases.groupBy(*keys, F.lower(name).alias("run")).agg(F.max(count).alias("most"))
    taken = inner.join(most, [*keys, "run"]).where(F.col("most") >= F.col("own")).select(*keys, F.col("long").alias(name)).distinct()
    return phrases.join(taken, [*keys, name], "left_anti")


def section_spread(terms: DataFrame, blocks: DataFrame, words_col: str = "words") -> DataFrame:
    """(name, df, idf): sections in which single-word terms occur; blocks is (section, words)."""
    sections = blocks.select("section").distinct().count()
    seen = blocks.select("section", F.explode(F.array_distinct(words_col)).alias("name")).distinct()
    spread = terms.select("name").distinct().join(seen, "name", "left").groupBy("name").agg(F.count("section").alias("df"))
    return spread.select("name", "df", F.round(F.log((1.0 + sections) / (1.0 + F.col("df"))) + 1.0, 6).alias("idf"))
