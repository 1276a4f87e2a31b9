"""Embedding models by name. The hashing model is built in; neural ones are registered as functions of a list of texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentences

# Other names of models.
ALIASES = {
    "all-minilm-l6-v2": "sentencebert", "sentence-transformers/all-minilm-l6-v2": "sentencebert", "sbert": "sentencebert", "minilm": "sentencebert",
    "math": "mathbert", "code": "codebert", "hashing": "hash", "offline": "hash",
}


@dataclass
class Embedder:
    """name, revision, dimension and the column function that turns text into array<double> of unit length."""

    name: str
    revision: str
    dim: int
    encode: Callable[[Column], Column]


_KNOWN: dict[str, Callable[[], Embedder]] = {}


def resolve_name(name: str | None) -> str:
    key = (name or "").strip()
    return ALIASES.get(key.lower(), key)


def from_function(name: str, revision: str, dim: int, encode: Callable[[list[str]], np.ndarray]) -> Embedder:
    """An embedder from a function of a list of texts, called once an Arrow batch; rows are scaled to unit length."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def column(text: pd.Series) -> pd.Series:
        m = np.asarray(encode(text.fillna("").tolist()), np.float64).reshape(len(text), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return pd.Series(list(np.divide(m, n, out=np.zeros_like(m), where=n > 0)))

    return Embedder(name, revision, dim, column)


def register(name: str, build: Callable[[], Embedder]) -> None:
    """Makes a model known under a name."""
    _KNOWN[resolve_name(name)] = build


def get_embedder(name: str = "hash", dim: int = 256) -> Embedder:
    """The model of this name or alias; unknown ones raise."""
    resolved = resolve_name(name)
    if resolved == "hash":
        return Embedder("hash", "conspectus/v1", dim, sentences.hashing_embedder(dim))
    if resolved not in _KNOWN:
        raise ValueError(f"unknown embedding model {name!r}; known are {sorted(['hash', *_KNOWN])}")
    return _KNOWN[resolved]()
