"""Content-derived identifiers: sha256 over parts joined by the unit separator."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def canonical_label(label: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"\s+", " "))), " +", " ")


def concept_id(level: Column, source: Column, name: Column) -> Column:
    return F.concat(F.lit("cpt_"), F.substring(joined_hash(level, source, canonical_label(name)), 1, 12))


def row_id(level: Column, label: Column) -> Column:
    return F.concat(F.lit("row_"), F.substring(joined_hash(level, canonical_label(label)), 1, 12))


def projection_id(object_id: Column, model: Column, revision: Column, concept_source: Column, metric: Column, top_k: Column) -> Column:
    return F.concat(F.lit("prj_"), F.substring(joined_hash(object_id, model, revision, concept_source, metric, top_k), 1, 16))


def query_id(version: Column, query: Column) -> Column:
    return F.substring(joined_hash(version, query), 1, 16)


def cache_key(text: Column, model: Column, revision: Column) -> Column:
    return joined_hash(model, revision, text)


def version_of(ordered_ids: Column) -> Column:
    """Version of an ordered array of row ids; another order is another version."""
    return F.substring(F.sha2(F.array_join(ordered_ids, SEPARATOR).cast("binary"), 256), 1, 16)


VOLATILE = frozenset({"created_at", "generated_at", "timestamp", "content_hash"})


def canonical_json(value, volatile: frozenset[str] = VOLATILE) -> str:
    """Sorted keys, no spaces, volatile keys dropped at every depth."""

    def kept(x):
        if isinstance(x, dict):
            return {k: kept(v) for k, v in x.items() if k not in volatile}
        return [kept(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(kept(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(value, volatile: frozenset[str] = VOLATILE) -> str:
    return hashlib.sha256(canonical_json(value, volatile).encode()).hexdigest()
