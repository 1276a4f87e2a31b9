"""Phrases and entities of texts, by an injected tagger or by shape, and where in a document they occur."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Entity labels that are wanted, and parts of speech of phrases.
LABELS = ("ORG", "PRODUCT", "GPE", "NORP", "EVENT", "LAW", "WORK_OF_ART", "LANGUAGE", "FAC", "LOC")
NOMINAL, IN_CHUNK = frozenset({"NOUN", "PROPN"}), frozenset({"NOUN", "PROPN", "ADJ"})

# a tagger turns a text into ([(word, part of speech)], [(entity, label)])
Tagger = Callable[[str], tuple[list[tuple[str, str]], list[tuple[str, str]]]]


def backend_name(tagger: Tagger | None = None) -> str:
    return getattr(tagger, "name", "injected") if tagger else "regex"


def chunks_from_pos(tokens: Iterable[tuple[str, str]], most: int = 5) -> list[str]:
    """Runs of adjectives and nouns that hold a noun, without adjectives at the end; of a long run the last ``most`` words."""
    out, words, last = [], [], 0  # last: words up to and with the last noun
    for word, kind in [*tokens, ("", "")]:
        if kind in IN_CHUNK:
            words.append(word)
            last = len(words) if kind in NOMINAL else last
            continue
        if last:
            out.append(" ".join(words[max(0, last - most) : last]))
        words, last = [], 0
    return out


def analyse(blocks: DataFrame, pattern: str, tagger: Tagger | None = None, most: int = 5) -> DataFrame:
    """(doc_id, kind, text, label, n): acceptable phrases and entities of blocks (doc_id, text), counted in one pass.

    Without a tagger phrases are told by ``pattern`` and short forms count as phrases and as organisations.
    """
    if tagger is None:
        shaped = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("text"))
        shaped = shaped.withColumn("text", T.normalise_phrase(F.col("text"))).where(T.is_acceptable_phrase(F.col("text"), most))
        short = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.ACRONYM), F.lit(0))).alias("text")).where(~F.lower("text").isin(T.STOPWORDS))
        label = F.lit(None).cast("string").alias("label")
        rows = shaped.select("doc_id", F.lit("phrase").alias("kind"), "text", label).union(short.select("doc_id", F.lit("phrase"), "text", label)).union(short.select("doc_id", F.lit("entity"), "text", F.lit("ORG")))
    else:

        def tag(parts):
            for pdf in parts:
                out = []
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    tokens, entities = tagger(text or "")
                    out += [(doc, "phrase", c, None) for c in chunks_from_pos(tokens, most)] + [(doc, "entity", e, (kind or "").upper()) for e, kind in entities]
                yield pd.DataFrame(out, columns=["doc_id", "kind", "text", "label"])

        rows = blocks.select("doc_id", "text").mapInPandas(tag, "doc_id string, kind string, text string, label string")
        rows = rows.withColumn("text", T.normalise_phrase(F.col("text"))).where(T.is_acceptable_phrase(F.col("text"), most))
    return rows.groupBy("doc_id", "kind", "text", "label").agg(F.count("*").alias("n"))


def noun_phrases(found: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, text, n) of phrases that occur often enough."""
    return found.where((F.col("kind") == "phrase") & (F.col("n") >= least)).select("doc_id", "text", "n")


def named_entities(found: DataFrame, least: int = 1, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(doc_id, text, label, n) of entities with a wanted label."""
    return found.where((F.col("kind") == "entity") & (F.col("n") >= least) & F.col("label").isin(*labels)).select("doc_id", "text", "label", "n")


def phrase_sections(phrases: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, text, sections, n_sections): the sections in whose prose a phrase stands, in any case, and how many there are.

    A document's phrases meet its blocks in one task; documents are independent.
    """

    def meet(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        prose: dict = {}
        for section, text in zip(theirs["section_id"], theirs["text"], strict=True):
            prose.setdefault(section if isinstance(section, str) else "", []).append(" ".join((text or "").lower().split()))
        rows = [(doc, text, sorted(s for s, parts in prose.items() if any(text.lower() in p for p in parts)), len(prose)) for doc, text in zip(mine["doc_id"], mine["text"], strict=True)]
        return pd.DataFrame(rows, columns=["doc_id", "text", "sections", "n_sections"])

    both = phrases.select(F.col("doc_id").alias("doc_id"), "text").groupBy("doc_id").cogroup(blocks.select("doc_id", "section_id", "text").groupBy("doc_id"))
    return both.applyInPandas(meet, "doc_id string, text string, sections array<string>, n_sections int")
