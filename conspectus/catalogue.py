"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from .plans import texts, trees, vectors

QUERIES = {**vectors.QUERIES, **texts.QUERIES, **trees.QUERIES}
ORACLE_SQL = {**vectors.ORACLE_SQL, **texts.ORACLE_SQL, **trees.ORACLE_SQL}
FLAGSHIP = vectors.project_topk
