"""Concept spaces of documents: scoring candidates, choosing concepts, their hierarchy, projection and refinement.

Every function works on a whole corpus, keyed by doc_id. A document's candidates meet its blocks in one task, as
matrices; documents are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, routing
from ..functions import text as T
from ..functions.embedders import Embedder
from . import generators, scoring, selection

TOP_K = 10
CONCEPT_FIELDS = "doc_id string, position long, concept_id string, name string, source string, tau string, score double, level string, kind string, section_id string, parent_id string, children array<string>, metadata map<string,string>, metrics map<string,double>, vector array<double>"


def merged(candidates: DataFrame) -> DataFrame:
    """One row a document and name: the winner by weight, source and name with its facts, summed frequency, all sources and aliases."""
    rows = candidates.withColumn("key", ids.canonical_label(F.col("name"))).withColumn("weight", T.structural_weight(F.col("source")))
    facts = F.struct("name", "source", "weight", "kind", "tau", "section_id", "metadata")
    out = rows.groupBy("doc_id", "key").agg(
        F.max_by(facts, F.struct("weight", "source", "name")).alias("best"), F.sum("frequency").alias("frequency"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("name")).alias("aliases"),
    )
    return out.select("doc_id", "key", "best.*", "frequency", "sources", "aliases")


def sorted_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``ord`` within a document: by falling frequency, then name."""
    return candidates.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("frequency"), "name")) - 1)


def top_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, top): the outermost known ancestor of each section; cycles end where they began."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(rows["section_id"], rows["parent_id"], strict=True))
        tops = []
        for at in rows["section_id"]:
            seen = {at}
            while parent.get(at) in parent and parent[at] not in seen:
                at = parent[at]
                seen.add(at)
            tops.append(at)
        return pd.DataFrame({"doc_id": rows["doc_id"], "section_id": rows["section_id"], "top": tops})

    return sections.select("doc_id", "section_id", "parent_id").groupBy("doc_id").applyInPandas(walk, "doc_id string, section_id string, top string")


def block_metrics(candidates: DataFrame, blocks: DataFrame, theta: float = scoring.THETA) -> DataFrame:
    """(doc_id, key, matches, coverage, purity, information_gain, embedding_variance).

    candidates: (doc_id, key, vector); blocks: (doc_id, label, vector), vectors of unit length. A block matches a
    candidate if its cosine is over theta.
    """

    def entropy(counts: np.ndarray) -> np.ndarray:
        total = counts.sum(1, keepdims=True)
        p = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
        return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1)

    def measure(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "key", "matches", "coverage", "purity", "information_gain", "embedding_variance"]
        if not len(mine):
            return pd.DataFrame(columns=names)
        c = np.array(mine["vector"].tolist(), np.float64)
        n = len(theirs)
        b = np.array(theirs["vector"].tolist(), np.float64).reshape(n, -1) if n else np.zeros((0, c.shape[1]))
        hit = (c @ b.T > theta).astype(np.float64)
        hits = hit.sum(1)
        labels, code = np.unique(theirs["label"].astype(str), return_inverse=True) if n else (np.zeros(0), np.zeros(0, int))
        one = np.eye(max(1, len(labels)))[code] if n else np.zeros((0, 1))
        inside, total = hit @ one, one.sum(0, keepdims=True)
        whole = entropy(total)[0] if n else 0.0
        share = hits / n if n else np.zeros(len(c))
        left = share * entropy(inside) + (1 - share) * entropy(total - inside)
        gain = np.where((hits == 0) | (hits == n), 0.0, (whole - left) / whole) if whole > 0 else np.full(len(c), scoring.NEUTRAL)
        purity = np.where(hits > 0, 1 - inside.max(1) / np.maximum(hits, 1), 0.0)
        mean = np.divide(hit @ b, hits[:, None], out=np.zeros_like(c), where=hits[:, None] > 0) if n else np.zeros_like(c)
        square = np.divide(hit @ (b * b), hits[:, None], out=np.zeros_like(c), where=hits[:, None] > 0) if n else np.zeros_like(c)
        spread = np.where(hits < 2, scoring.NEUTRAL, np.clip(1 - (square - mean * mean).sum(1) / 2, 0, 1))
        cover = np.interp(share, [0.01, 0.2, 0.4, 0.9], [0.1, 1.0, 1.0, 0.3])
        parts = (hits.astype(np.int64), cover, np.clip(purity, 0, 1), np.clip(gain, 0, 1), spread)
        return pd.DataFrame(dict(zip(names, (mine["doc_id"], mine["key"], parts[0], *(np.round(x, 6) for x in parts[1:])), strict=True)))

    both = candidates.select(F.col("doc_id").alias("doc_id"), "key", "vector").groupBy("doc_id").cogroup(blocks.select("doc_id", "label", "vector").groupBy("doc_id"))
    return both.applyInPandas(measure, "doc_id string, key string, matches long, coverage double, purity double, information_gain double, embedding_variance double")


def word_rarity(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, key, reusability) of names by the words of their document's prose."""
    pattern = F.lit(r"[a-z][a-z0-9'\-]*")
    counted = blocks.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), pattern, F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    most = counted.groupBy("doc_id").agg(F.max("n").alias("most"))
    words = candidates.select("doc_id", "key", T.words_of(F.lower("name")).alias("words"))
    met = words.select("doc_id", "key", F.posexplode_outer("words").alias("i", "word")).join(counted, ["doc_id", "word"], "left")
    listed = met.groupBy("doc_id", "key").agg(F.collect_list(F.when(F.col("word").isNotNull(), F.coalesce("n", F.lit(0)))).alias("f"))
    return words.join(listed, ["doc_id", "key"]).join(most, "doc_id", "left").select("doc_id", "key", scoring.reusability(F.col("words"), F.col("f"), F.coalesce("most", F.lit(1))).alias("reusability"))


def describe(weights: dict[str, float] | None = None, theta: float = scoring.THETA) -> dict:
    """The scorer's weights, scaled, its metrics and threshold."""
    used = {**scoring.WEIGHTS, **(weights or {})}
    scale = sum(abs(w) for w in used.values()) or 1.0
    return {"weights": {n: w / scale for n, w in used.items()}, "metrics": sorted(used), "theta": theta}


def scored(corpus, candidates: DataFrame, embedder: Embedder, weights: dict[str, float] | None = None, theta: float = scoring.THETA) -> DataFrame:
    """Merged candidates with vector, metrics and score; blocks are labelled by their top-level section."""
    tops = top_sections(corpus.sections)
    prose = corpus.blocks.where(F.lower("type").isin(generators.PROSE) & (F.trim("text") != "")).join(tops, ["doc_id", "section_id"], "left")
    label = F.coalesce("top", "section_id", F.lit(""))
    blocks = prose.select("doc_id", label.alias("label"), embedder.encode(F.col("text")).alias("vector"))
    rows = candidates.withColumn("vector", embedder.encode(F.coalesce("tau", "name")))
    rows = rows.join(block_metrics(rows, blocks, theta), ["doc_id", "key"], "left").join(word_rarity(candidates, prose), ["doc_id", "key"], "left")
    cited = F.col("metadata")["citations"].try_cast("bigint"), F.col("metadata")["year"].try_cast("int")
    metrics = {n: F.coalesce(n, F.lit(scoring.NEUTRAL)) for n in ("coverage", "purity", "information_gain", "embedding_variance", "reusability")}
    metrics |= {"structural": F.col("weight"), "citation_importance": scoring.citation_importance(*cited)}
    out = rows.withColumn("score", scoring.quality(metrics, {**scoring.WEIGHTS, **(weights or {})}))
    return out.withColumn("metrics", F.create_map(*[x for n in sorted(metrics) for x in (F.lit(n), F.round(metrics[n], 6))]))


def attach_hierarchy(concepts: DataFrame, sections: DataFrame) -> DataFrame:
    """Fills parent_id and children: a concept's parent is the heading concept of its section, a heading's that of the
    section above; cycles are cut, children are sorted."""
    own = concepts.where((F.col("source") == "heading") & (F.col("kind") == "heading") & F.col("section_id").isNotNull())
    first = own.groupBy("doc_id", "section_id").agg(F.min_by("concept_id", "position").alias("head"))
    above = sections.select("doc_id", "section_id", F.col("parent_id").alias("up")).join(first.select("doc_id", F.col("section_id").alias("up"), F.col("head").alias("up_head")), ["doc_id", "up"], "left")
    met = concepts.drop("parent_id", "children").join(first, ["doc_id", "section_id"], "left").join(above.select("doc_id", "section_id", "up_head"), ["doc_id", "section_id"], "left")
    found = F.when(F.col("head") == F.col("concept_id"), F.col("up_head")).otherwise(F.col("head"))
    met = met.withColumn("parent", F.when(found != F.col("concept_id"), found)).drop("head", "up_head")

    def uncycled(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", kind="stable")
        parent = {c: (p if isinstance(p, str) else None) for c, p in zip(rows["concept_id"], rows["parent"], strict=True)}
        for c in parent:
            at, seen = parent[c], {c}
            while at and at not in seen:
                seen.add(at)
                at = parent.get(at)
            if at:
                parent[c] = None
        return pd.DataFrame({"doc_id": rows["doc_id"], "concept_id": rows["concept_id"], "parent_id": [parent[c] for c in rows["concept_id"]]})

    links = met.select("doc_id", "position", "concept_id", "parent").groupBy("doc_id").applyInPandas(uncycled, "doc_id string, concept_id string, parent_id string")
    kids = links.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("concept_id")).agg(F.array_sort(F.collect_list("concept_id")).alias("children"))
    out = met.drop("parent").join(links, ["doc_id", "concept_id"], "left").join(kids, ["doc_id", "concept_id"], "left")
    return out.withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


@dataclass
class Space:
    """concepts in the columns of ``CONCEPT_FIELDS``, position from 0 within a document; the model and the parameters."""

    concepts: DataFrame
    embedder: Embedder
    parameters: dict = field(default_factory=dict)

    def by_level(self, level: str) -> DataFrame:
        return self.concepts.where(F.col("level") == level)

    def index_of(self, concept_id: str) -> DataFrame:
        """(doc_id, position) of an id."""
        return self.concepts.where(F.col("concept_id") == concept_id).select("doc_id", "position")

    def info(self) -> DataFrame:
        """One row a document: size, roots, most children, concepts by level and by source."""
        base = self.concepts.groupBy("doc_id").agg(F.count("*").alias("size"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.max(F.size("children")).alias("most_children"))
        for name in ("level", "source"):
            counted = self.concepts.groupBy("doc_id", name).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(f"{name}s"))
            base = base.join(counted, "doc_id")
        return base

    def save_matrix(self, path: str) -> None:
        """Writes (doc_id, position, concept_id, vector) with model and revision."""
        self.concepts.select("doc_id", "position", "concept_id", "vector", F.lit(self.embedder.name).alias("model"), F.lit(self.embedder.revision).alias("revision")).write.mode("overwrite").parquet(path)


def build_space(rows: DataFrame, sections: DataFrame, embedder: Embedder, most: int = selection.MOST, diversity: float = selection.DIVERSITY, least: float = 0.0, static: list[tuple[str, DataFrame]] | None = None) -> Space:
    """Selects, wires and orders concepts; static levels (level, concepts (name, optionally tau, source, description)) go in
    front of every document's own, the last named first."""
    chosen = selection.select_diverse(rows, "doc_id", most=most, threshold=diversity, least=least)
    level = F.lit("document")
    none = F.lit(None).cast("string")
    concepts = chosen.select("doc_id", (F.col("position") - 1).alias("position"), ids.concept_id(level, F.col("source"), F.col("name")).alias("concept_id"), "name", "source", "tau", "score", level.alias("level"), "kind", "section_id", none.alias("parent_id"), F.array().cast("array<string>").alias("children"), "metadata", "metrics", "vector")
    concepts = attach_hierarchy(concepts, sections).select(*[f.split()[0] for f in CONCEPT_FIELDS.split(", ")])
    for name, given in static or ():
        given = given.withColumns({c: F.lit(None).cast("string") for c in ("tau", "source") if c not in given.columns})
        ranked = given.withColumn("place", F.row_number().over(Window.orderBy("name")) - 1)  # a static vocabulary is small
        here = ranked.select("place", ids.concept_id(F.lit(name), F.coalesce("source", F.lit(name)), F.col("name")).alias("concept_id"), "name", F.coalesce("source", F.lit(name)).alias("source"), F.coalesce("tau", "name").alias("tau"))
        here = here.withColumn("vector", embedder.encode(F.col("tau")))
        size = here.agg(F.count("*").alias("shift"))
        front = concepts.select("doc_id").distinct().crossJoin(here)  # a small vocabulary for each document
        front = front.select("doc_id", F.col("place").cast("long").alias("position"), "concept_id", "name", "source", "tau", F.lit(0.0).alias("score"), F.lit(name).alias("level"), none.alias("kind"), none.alias("section_id"), none.alias("parent_id"), F.array().cast("array<string>").alias("children"), F.create_map().cast("map<string,string>").alias("metadata"), F.create_map().cast("map<string,double>").alias("metrics"), "vector")
        concepts = front.unionByName(concepts.crossJoin(size).withColumn("position", F.col("position") + F.col("shift")).drop("shift"))
    return Space(concepts, embedder, {"max_concepts": most, "diversity_threshold": diversity, "min_score": least})


def best_concepts(objects: DataFrame, concepts: DataFrame, k: int, id_col: str) -> DataFrame:
    """(doc_id, id, hits): the k best concepts of each object's own document, as (rank, concept_id, name, similarity).

    objects: (doc_id, id, vector of unit length). A document's objects meet its concepts in one task, as matrices.
    """
    kind = objects.schema[id_col].dataType.simpleString()
    schema = f"doc_id string, `{id_col}` {kind}, hits array<struct<rank:int,concept_id:string,name:string,similarity:double>>"

    def meet(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame(columns=["doc_id", id_col, "hits"])
        theirs = theirs.sort_values("position", kind="stable")
        m = np.array(theirs["vector"].tolist(), np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        sims = np.array(mine["vector"].tolist(), np.float64) @ np.divide(m, n, out=np.zeros_like(m), where=n > 0).T
        width = max(1, min(k, sims.shape[1]))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        names, cids = theirs["name"].tolist(), theirs["concept_id"].tolist()
        hits = [[{"rank": r + 1, "concept_id": cids[j], "name": names[j], "similarity": round(float(row[j]), 6)} for r, j in enumerate(own)] for own, row in zip(order, sims, strict=True)]
        return pd.DataFrame({"doc_id": mine["doc_id"], id_col: mine[id_col], "hits": hits})

    left = objects.select(F.col("doc_id").alias("doc_id"), id_col, "vector").groupBy("doc_id")
    return left.cogroup(concepts.select("doc_id", "position", "concept_id", "name", "vector").groupBy("doc_id")).applyInPandas(meet, schema)


def project_blocks(blocks: DataFrame, space: Space, k: int = TOP_K, concept_source: str = "document", store_embedding: bool = False) -> DataFrame:
    """A projection of each block with text: id, object, model, hits, top1 and margin; its embedding, if wanted."""
    e = space.embedder
    rows = blocks.where(F.trim("text") != "").select("doc_id", F.col("block_id").alias("object_id"), F.col("type").alias("object_type"), e.encode(F.col("text")).alias("vector"))
    out = best_concepts(rows, space.concepts, k, "object_id").join(rows, ["doc_id", "object_id"])
    second = F.coalesce(F.get("hits", F.lit(1))["similarity"], F.lit(0.0))
    columns = [
        ids.projection_id(F.col("object_id"), F.lit(e.name), F.lit(e.revision), F.lit(concept_source), F.lit("cosine"), F.size("hits")).alias("projection_id"), "doc_id", "object_id", "object_type",
        F.lit(e.name).alias("embedding_model"), F.lit(e.revision).alias("embedding_revision"), F.lit(concept_source).alias("concept_source"), "hits",
        F.get("hits", F.lit(0))["similarity"].alias("top1"), F.round(F.get("hits", F.lit(0))["similarity"] - second, 6).alias("margin"),
    ]
    return out.select(*columns, *(["vector"] if store_embedding else []))


def project_document(corpus, space: Space, k: int = TOP_K, types: list[str] | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(projections, skipped) of all blocks: those of other types, without text, or left out by the reader have a reason."""
    wanted = F.lower("type").isin([t.lower() for t in types]) if types else F.lit(True)
    reason = F.when(~wanted, "type not in the filter").when(F.trim("text") == "", "no text to embed")
    rows = corpus.blocks.withColumn("reason", reason)
    skipped = rows.where("reason is not null").select("doc_id", F.col("block_id").alias("object_id"), F.col("type").alias("object_type"), "reason")
    read = corpus.skipped.select("doc_id", "object_id", "object_type", "reason").where(F.col("reason") != "empty text")  # those are blocks too
    return project_blocks(rows.where("reason is null"), space, k, **how), skipped.unionByName(read)


def explain(texts: DataFrame, space: Space, k: int = 5, text_col: str = "text", id_col: str = "text_id") -> DataFrame:
    """(doc_id, id, rank, concept_id, name, similarity): the best concepts of a document's space for free texts.

    texts: (doc_id, id, text).
    """
    rows = texts.select("doc_id", id_col, space.embedder.encode(F.col(text_col)).alias("vector"))
    return best_concepts(rows, space.concepts, k, id_col).select("doc_id", id_col, F.inline("hits"))


def project_text(texts: DataFrame, space: Space, text_col: str = "text", id_col: str = "text_id") -> DataFrame:
    """(doc_id, id, similarities): one cosine for each concept, in order of position."""
    sims = best_concepts(texts.select("doc_id", id_col, space.embedder.encode(F.col(text_col)).alias("vector")), space.concepts, 1 << 30, id_col)
    flat = sims.select("doc_id", id_col, F.explode("hits").alias("h")).select("doc_id", id_col, "h.concept_id", "h.similarity").join(space.concepts.select("doc_id", "concept_id", "position"), ["doc_id", "concept_id"])
    return flat.groupBy("doc_id", id_col).agg(F.array_sort(F.collect_list(F.struct("position", "similarity"))).alias("s")).select("doc_id", id_col, F.col("s.similarity").alias("similarities"))


def refine_space(space: Space, contexts: DataFrame, size: int, pool: DataFrame) -> Space:
    """Each document's space grown to ``size`` by the pool's candidates that are nearest to its context.

    contexts: (doc_id, text); pool: scored candidates with vector. Children of concepts are concepts of the space
    already, so what is added comes from the pool, best cosine first, then by name.
    """
    level = F.lit("document")
    have = space.concepts.groupBy("doc_id").agg(F.count("*").alias("have"), F.max("position").alias("last"))
    named = pool.withColumn("concept_id", ids.concept_id(level, F.col("source"), F.col("name")))
    rest = named.join(space.concepts.select("doc_id", "concept_id"), ["doc_id", "concept_id"], "left_anti").dropDuplicates(["doc_id", "concept_id"])
    context = contexts.select("doc_id", space.embedder.encode(F.col("text")).alias("context"))
    near = rest.join(context, "doc_id").join(have, "doc_id").withColumn("s", F.aggregate(F.zip_with("vector", "context", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("s"), "name"))).where(F.col("have") + F.col("n") <= size)
    none = F.lit(None).cast("string")
    fresh = ranked.select("doc_id", (F.col("last") + F.col("n")).alias("position"), "concept_id", "name", "source", "tau", "score", level.alias("level"), "kind", "section_id", none.alias("parent_id"), F.array().cast("array<string>").alias("children"), F.map_concat("metadata", F.create_map(F.lit("added_by"), F.lit("refine_space"))).alias("metadata"), "metrics", "vector")
    return Space(space.concepts.unionByName(fresh), space.embedder, space.parameters)


def model_of(block_type: Column, override: str | None = None) -> Column:
    return routing.model_for_type(block_type, override)
