"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Training takes at most ``MAX_TRAIN`` labelled rows, those with the least hash of their id, and of these at most
``MAX_BYTES`` of features, so the model's cost is bounded and reruns agree; scoring covers every whole text as a sparse dot product, without a shuffle.

Defined results: a null text scores as the empty one (the bias alone); rows without a label are scored too;
null labels and labels whose document is missing teach nothing; without any label all scores are 0.5;
of an id with several labels each counts as a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, small_batches, written
from .tokens import WORDS_AND_MARKS, mix, per_text, slices, string_bytes, tokenise

BITS = 18
MAX_TRAIN = 8192
EPOCHS = 3
MAX_BYTES = 1 << 28  # of features of the fitted rows


_CASE = np.zeros(256, np.uint8)  # 1 upper, 2 digit
_CASE[65:91] = 1
_CASE[48:58] = 2


def features(raw: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature indices, their values, index bounds per text).

    Hashed unigrams and bigrams of words and runs of marks, and unigrams to trigrams of their shapes: case, digit
    or mark, and whether the token repeats the one before it. Values are sqrt(count / grams of the text), so each
    text has norm 1.
    """
    starts, ends, h = tokenise(raw, bounds, WORDS_AND_MARKS)
    if not len(h):
        return np.zeros(0, np.int32), np.zeros(0), np.zeros(len(bounds), np.int64)
    at = per_text(starts, bounds)
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    mark = WORDS_AND_MARKS[raw[starts]] == 2
    shape = _CASE[raw[starts]].astype(np.uint64) * np.uint64(4) + _CASE[raw[ends - 1]]
    shape = np.where(mark, h, mix(shape + np.uint64(77)))
    same = np.r_[False, (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])]
    shape = mix(shape + same.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5))
    grams, owners = [h, shape], [text_of, text_of]
    step, inside = np.uint64(0xD1342543DE82EF95), text_of[:-1] == text_of[1:]
    for base in (h, shape):
        pair = mix(base[:-1] * step + base[1:])
        grams.append(pair[inside])
        owners.append(text_of[:-1][inside])
    three = inside[:-1] & inside[1:]
    if len(h) > 2:
        grams.append(mix(pair[:-1] * step + shape[2:])[three])
        owners.append(text_of[:-2][three])
    key = np.concatenate([(o.astype(np.int64) << bits) | (g >> np.uint64(64 - bits)).astype(np.int64) for g, o in zip(grams, owners, strict=True)])
    key, count = np.unique(key, return_counts=True)
    at = np.searchsorted(key >> bits, np.arange(len(bounds)), "left")
    total = np.r_[0, np.cumsum(count)]
    return (key & ((1 << bits) - 1)).astype(np.int32), np.sqrt(count / np.repeat(total[at[1:]] - total[at[:-1]], np.diff(at))), at


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2) -> np.ndarray:
    """FTRL-proximal weights; of examples (indices, values, label); the last entry is the bias."""
    dim = 1 << bits
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for idx, values, label in examples:
            at, x = np.r_[idx, dim], np.r_[values, 0.1]
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dim + 1)).astype(np.float32)


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out, max_rows: int) -> DataFrame:
    """(hash order, label, number of the text, text) of the ``max_rows`` labelled ids of least hash, held-out ids left out."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"), order.alias("__order"), held_out(F.col(id_col)).alias("__held"))
        .where("__id is not null and __y is not null and not __held")
        .orderBy("__order", "__id", "__y")
        .limit(max_rows)
    )
    texts = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    # at most max_rows ids, so the broadcast is bounded
    return texts.join(F.broadcast(picked), "__id").select("__order", "__y", F.xxhash64("__text").alias("__number"), "__text", "__id")


def fit(rows: DataFrame, bits: int = BITS, epochs: int = EPOCHS, max_rows: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Weights from ``training_rows``: features are made where the texts are; one task fits the first ``max_rows`` of them
    in hash order (ids may repeat among documents), as far as they stay under ``max_bytes`` together."""

    def hashed(batches):
        for batch in batches:
            raw, bounds = string_bytes(batch.column(3))
            for a, b in slices(bounds):
                idx, values, at = features(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], bits)
                parts = [pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary()) for x in (idx, values.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), *parts], names=["o", "y", "t", "f", "v"])

    def fitted(batches):
        examples, size = [], 0
        for batch in batches:  # in order
            for y, f, v in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                size += len(f) + len(v)
                if size <= max_bytes:
                    examples.append((np.frombuffer(f, np.int32), np.frombuffer(v, np.float32), min(1, max(0, y))))
        weights = train(examples, bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["w"])

    made = written(rows.mapInArrow(hashed, "o long, y int, t long, f binary, v binary"), "features")
    made = made.orderBy("o", "y", "t").limit(max_rows).coalesce(1).sortWithinPartitions("o", "y", "t").mapInArrow(fitted, "w binary").collect()
    return np.frombuffer(bytes(made[0]["w"]), np.float32) if made else np.zeros((1 << bits) + 1, np.float32)


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), score_col: str = "score", bits: int = BITS) -> DataFrame:
    """``keep`` columns with the probability of label 1; the weights have a fixed size of 4 * 2**bits bytes."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    columns, work, schema, names = carried(df, keep, score_col)
    picked = df.select(*columns, F.col(text_col).cast("string").alias("__text"))

    def rows(batches):
        w = shared.value
        for batch in batches:
            raw, bounds = string_bytes(batch.column(len(keep)))
            for a, b in slices(bounds):
                idx, values, at = features(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], bits)
                total = np.r_[0.0, np.cumsum(w[idx] * values)]
                x = total[at[1:]] - total[at[:-1]] + 0.1 * float(w[-1])
                p = 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(np.round(p, 9))], names=[*work, "score"])

    return picked.mapInArrow(rows, f"{schema}score double").toDF(*names)


def remainder(column):
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3


def quality_model(spark, sf_dir: str, documents: DataFrame | None = None) -> np.ndarray:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet") if documents is None else documents
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(training_rows(documents, labels, "doc_id", "text", "quality", lambda c: remainder(c) == 1, MAX_TRAIN))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(documents, quality_model(spark, sf_dir, documents))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
