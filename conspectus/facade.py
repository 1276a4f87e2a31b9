"""From documents to concept spaces and projections in one object, and requests with answers that never raise."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embedders import Embedder, get_embedder
from .operators import generators, scoring, selection
from .operators import space as spaces
from .sources import documents, sidecars


@dataclass
class Atlas:
    """Concept spaces of all documents of a corpus.

    Building is lazy, as plans are: candidates, scores and the space are made where they are first read, and then kept
    (in memory and on disk; what an executor loses is made again). Every result is a table keyed by doc_id.
    """

    corpus: documents.Corpus
    embedder: Embedder = field(default_factory=get_embedder)
    sources: tuple[str, ...] | None = None
    max_concepts: int = selection.MOST
    diversity: float = selection.DIVERSITY
    min_score: float = 0.0
    theta: float = scoring.THETA
    weights: dict[str, float] | None = None
    generator_options: dict | None = None
    static_levels: list[tuple[str, DataFrame]] = field(default_factory=list)

    @classmethod
    def load(cls, spark: SparkSession, path: str, looking: bool = False, **how) -> Atlas:
        """From document files, generic or of typed objects; see ``documents.load``."""
        return cls(documents.load(spark, path, looking), **how)

    @cached_property
    def candidates(self) -> DataFrame:
        return spaces.merged(generators.generate(self.corpus, self.sources, self.generator_options)).persist()

    @cached_property
    def scored(self) -> DataFrame:
        return spaces.scored(self.corpus, self.candidates, self.embedder, self.weights, self.theta).persist()

    @cached_property
    def space(self) -> spaces.Space:
        made = spaces.build_space(self.scored, self.corpus.sections, self.embedder, self.max_concepts, self.diversity, self.min_score, self.static_levels)
        return spaces.Space(made.concepts.persist(), made.embedder, made.parameters)

    def project_text(self, texts: DataFrame) -> DataFrame:
        """(doc_id, text_id, similarities) of texts (doc_id, text_id, text): one cosine a concept."""
        return spaces.project_text(texts, self.space)

    def explain_text(self, texts: DataFrame, k: int = 5) -> DataFrame:
        """(doc_id, text_id, rank, concept_id, name, similarity)."""
        return spaces.explain(texts, self.space, k)

    project_spans = explain_text

    def project_document(self, k: int = spaces.TOP_K, types: list[str] | None = None, store_embedding: bool = False, concept_source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(projections, skipped) of every block."""
        named = concept_source or "+".join(self.sources or generators.GENERATORS)
        return spaces.project_document(self.corpus, self.space, k, types, concept_source=named, store_embedding=store_embedding)

    def refine(self, contexts: DataFrame, size: int) -> spaces.Space:
        """The spaces grown to a size by contexts (doc_id, text); from then on this object's space."""
        self.space = spaces.refine_space(self.space, contexts, size, self.scored)
        return self.space

    def info(self) -> DataFrame:
        """One row a document: facts of the space and counts of blocks, sections and candidates."""
        kind = F.lower("type")
        blocks = self.corpus.blocks.groupBy("doc_id").agg(
            F.count("*").alias("blocks"), F.count_if(kind.isin(generators.PROSE) & (F.trim("text") != "")).alias("prose_blocks"),
            F.count_if(kind.isin(generators.MATH) & (F.trim("text") != "")).alias("math_blocks"), F.count_if(kind.isin(*documents.CODE) & (F.trim("text") != "")).alias("code_blocks"),
        )
        counted = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
        out = blocks.join(self.space.info(), "doc_id", "left").join(counted(self.corpus.sections, "sections"), "doc_id", "left").join(counted(self.candidates, "candidates"), "doc_id", "left")
        return out.fillna(0, ["size", "roots", "most_children", "sections", "candidates"]).withColumn("embedding_model", F.lit(self.embedder.name))


def _answer(operation: str, work: Callable[[], dict]) -> dict:
    try:
        return {"status": "completed", "operation": operation, **work()}
    except Exception as error:  # the answer tells; the caller decides
        return {"status": "failed", "operation": operation, "error": str(error), "error_type": type(error).__name__, "traceback": traceback.format_exc(limit=5)}


def _one(spark: SparkSession, path: str | Path, how: dict) -> Atlas:
    """The atlas of one document."""
    if not Path(path).exists():
        raise FileNotFoundError(f"no such file: {path}")
    model = how.pop("model", "hash")
    return Atlas.load(spark, str(path), True, embedder=get_embedder(model), **how)


def _records(rows: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows.collect()]  # of one document


def _concepts(atlas: Atlas) -> list[dict]:
    return _records(atlas.space.concepts.drop("vector", "doc_id").orderBy("position"))


def request_concepts(spark: SparkSession, path: str | Path, **how) -> dict:
    """Answer with the concepts of one document and its facts."""

    def work():
        atlas = _one(spark, path, how)
        return {"source": str(path), "concepts": _concepts(atlas), "info": _records(atlas.info().drop("doc_id"))}

    return _answer("concept_generation", work)


def request_embedding(spark: SparkSession, texts: list[str], model: str = "hash") -> dict:
    """Answer with the vectors of texts, to 6 digits."""

    def work():
        e = get_embedder(model)
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.transform(e.encode(F.col("t")), lambda x: F.round(x, 6)).alias("v")).orderBy("i").collect()
        return {"model": e.name, "revision": e.revision, "dimension": e.dim, "count": len(rows), "embeddings": [list(r["v"]) for r in rows]}

    return _answer("embedding", work)


def request_projection(spark: SparkSession, path: str | Path, top: int = 10, text: str | None = None, **how) -> dict:
    """Answer with a document's projections, or with the best concepts for a text."""

    def work():
        atlas = _one(spark, path, how)
        if text is not None:
            one = atlas.corpus.blocks.select("doc_id").distinct().withColumns({"text_id": F.lit(0), "text": F.lit(text)})
            return {"source": str(path), "text": text, "concepts": _records(atlas.explain_text(one, top).drop("doc_id", "text_id").orderBy("rank"))}
        projections, skipped = atlas.project_document(top)
        found = _records(projections.drop("doc_id").orderBy("object_id"))
        return {"source": str(path), "projections": found, "n_projections": len(found), "n_skipped": skipped.count()}

    return _answer("projection", work)


def payload(atlases: dict[str, Atlas], source: str, top: int, types: list[str] | None = None, store_embeddings: bool = False, meta: dict | None = None) -> dict:
    """The sidecar payload of one document under several models."""
    spaces, projections, left = {}, [], []
    for model, atlas in atlases.items():
        rows, skipped = atlas.project_document(top, types, store_embeddings)
        spaces[model] = {"concepts": _concepts(atlas), "parameters": atlas.space.parameters, "embedding_revision": atlas.embedder.revision}
        projections += _records(rows.drop("doc_id").orderBy("object_id"))
        left = left or _records(skipped.drop("doc_id").orderBy("object_type", "object_id"))
    return sidecars.build_payload(source, spaces, projections, left, meta)


def request_storage(spark: SparkSession, path: str | Path, output: str | Path | None = None, top: int = 10, store_embeddings: bool = False, **how) -> dict:
    """Writes a document's sidecar; ``updated`` if it took the place of one."""

    def work():
        target = sidecars.sidecar_path(path, output)
        before = target.exists() and sidecars.read_state(target).get("content_hash")
        atlas = _one(spark, path, how)
        made = payload({atlas.embedder.name: atlas}, str(path), top, store_embeddings=store_embeddings)
        sidecars.write_sidecar(made, target)
        status = {"status": "updated"} if target.exists() and before is not False else {}
        return {"source": str(path), "output": str(target), "content_hash": made["content_hash"], "changed": before != made["content_hash"], "n_projections": len(made["projections"]), "n_skipped": len(made["skipped"]), **status}

    return _answer("storage", work)


def request_verification(path: str | Path) -> dict:
    """Whether a sidecar has the hash that it states."""

    def work():
        matches, stored, computed = sidecars.verify_sidecar(path)
        return {"path": str(path), "matches": matches, "stored_hash": stored, "recomputed_hash": computed}

    return _answer("verification", work)
