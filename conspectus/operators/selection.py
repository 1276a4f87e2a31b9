"""Greedy choice of diverse concepts, and two-dimensional layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

MOST = 100
DIVERSITY = 0.95


def select_diverse(scored: DataFrame, group: str, name: str = "name", score: str = "score", vector: str = "vector", most: int = MOST, threshold: float = DIVERSITY, least: float = 0.0) -> DataFrame:
    """Per group, best first, whatever is not closer than ``threshold`` to a chosen one; adds ``position``.

    A group's task holds only what is chosen so far, at most ``most`` vectors, besides the group's rows.
    """
    kept = scored.where(F.col(score) >= least)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(__s=-rows[score]).sort_values(["__s", name], kind="stable").drop(columns="__s")
        chosen, taken = np.zeros((0, 0)), []
        for i, v in enumerate(rows[vector]):
            v = np.asarray(v, np.float64)
            n = np.linalg.norm(v)
            v = v / n if n else v
            if len(taken) and float((chosen @ v).max()) > threshold:
                continue
            chosen = np.vstack([chosen, v]) if len(taken) else v[None]
            taken.append(i)
            if len(taken) == most:
                break
        return rows.iloc[taken].assign(position=np.arange(1, len(taken) + 1))

    return kept.groupBy(group).applyInPandas(choose, f"{fields}, position long")


def pca_layout(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, x, y) to 6 digits: projection on the two leading principal axes.

    Moments are summed by the executors (dim + dim^2 numbers); each axis is signed so that its largest component is positive.
    """
    v = rows.select(id_col, V.doubles(vector_col).alias("v"))
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]

    def moments(parts):
        total = None
        for pdf in parts:
            if len(pdf):
                m = np.array(pdf["v"].tolist(), np.float64)
                own = np.concatenate([[len(m)], m.sum(0), (m.T @ m)[np.triu_indices(dim)]])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    found = dict(v.select("v").mapInPandas(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect())
    if not found:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, x double, y double")
    n = found[0]
    mean = np.array([found[1 + i] for i in range(dim)]) / n
    second = np.zeros((dim, dim))
    for at, (i, j) in enumerate(pairs):
        second[i, j] = second[j, i] = found[1 + dim + at]
    _, axes = np.linalg.eigh(second / n - np.outer(mean, mean))
    out = []
    for k in (1, 2):
        axis = axes[:, -k] if dim >= k else np.zeros(dim)
        axis = axis * (1.0 if axis[np.abs(axis).argmax()] >= 0 else -1.0)
        out.append(F.round(V.dot(F.col("v"), F.array(*[F.lit(float(a)) for a in axis])) - float(axis @ mean), 6))
    return v.select(id_col, out[0].alias("x"), out[1].alias("y"))


BACKENDS = {"pca": pca_layout}


def available_backends() -> tuple[str, ...]:
    return tuple(BACKENDS)


def register_backend(name: str, place) -> None:
    """A further layout: a function of (rows, id column, vector column, dimension) to (id, x, y)."""
    BACKENDS[name] = place


def layout(rows: DataFrame, id_col: str, vector_col: str, dim: int, backend: str = "pca", **columns: str) -> DataFrame:
    """(id, x, y, backend and ``columns``) by a backend, or by principal axes where it is not there; columns: name=source column."""
    used = backend.strip().lower()
    used = next((b for b in BACKENDS if b != "pca"), "pca") if used == "auto" else used if used in BACKENDS else "pca"
    placed = BACKENDS[used](rows, id_col, vector_col, dim).withColumn("backend", F.lit(used))
    carried = rows.select(id_col, *[F.col(c).alias(n) for n, c in columns.items()])
    return placed.join(carried, id_col) if columns else placed


def layout_projections(projections: DataFrame, dim: int, backend: str = "pca") -> DataFrame:
    """Sentences placed by their coordinates (ces), with their best concept as group; those of several versions are refused."""
    versions = [r[0] for r in projections.select("basis_version").distinct().limit(2).collect()]
    if len(versions) > 1:
        raise ValueError("projections of several basis versions have no common layout")
    rows = projections.where("ces is not null").withColumn("group", F.get("hits", F.lit(0))["label"])
    return layout(rows, "sentence_id", "ces", dim, backend, label="text", group="group").withColumn("basis_version", F.lit(versions[0] if versions else None))
