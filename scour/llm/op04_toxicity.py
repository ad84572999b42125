"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs, and pairs with one word between, hashed to 2^18 coordinates.
FTRL keeps a rate for each coordinate, and its L1 term leaves only few weights other than zero; these are
what is broadcast for scoring.  The bounded training sample may be dealt to shards that train side by side; their
weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import crc_of_id, plain_text, steps, text_buffers, unit_hash
from scour.llm.textkit import NOT_WORD, U, distinct_by_row, mix, word_hashes

BITS = 18


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and row of every word, pair and skip-pair (not distinct)."""
    h, rows = word_hashes(data, offsets, NOT_WORD)
    idx, at = [h], [rows]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            same = rows[:-gap] == rows[gap:]
            idx.append(mix(h[:-gap] * U(3) + h[gap:] + U(gap))[same])
            at.append(rows[:-gap][same])
    return (np.concatenate(idx) >> U(64 - BITS)).astype(np.int64), np.concatenate(at)


class Ftrl:
    """w_i = -(z_i - sign(z_i) l1) / ((beta + sqrt n_i) / alpha + l2), 0 where |z_i| <= l1; the bias has no penalty."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.z0, self.n0 = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z = self.z[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[idx])) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.z0 * self.alpha / (self.beta + self.n0 ** 0.5)

    def learn(self, idx: np.ndarray, y: float) -> None:
        w, b = self.weights(idx), self.bias()
        g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35))) - y
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g
        self.z0 += g - ((self.n0 + g * g) ** 0.5 - self.n0 ** 0.5) / self.alpha * b
        self.n0 += g * g


def train(docs: DataFrame, labels: DataFrame, most: int = 16_000, shards: int = 1, epochs: int = 6,
          alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(coordinates, weights, bias) from the labelled rows whose crc32(doc_id) mod 5 is not 0.

    The sample is bounded at about ``most`` documents (whole texts, chosen by a hash of the id), so what a
    shard holds and what reaches the driver (at most 2^18 weights) doesn't grow with the corpus.  An id that
    is labelled more than once is toxic if any label says so; null labels don't count.  The bias is None
    if there are no labelled rows.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rate = min(1.0, most / max(1, known.count()))
    part = unit_hash("doc_id") < rate
    rows = docs.select("doc_id", plain_text().alias("text")).where(part).join(known.where(part), "doc_id")
    rows = rows.select("text", F.col("y").cast("double").alias("y"), unit_hash("doc_id", seed="order").alias("at"),
                       (F.xxhash64("doc_id", F.lit("shard")) % shards).alias("shard"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in steps(offsets):
                idx, at = distinct_by_row(*feature_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                ends = np.searchsorted(at, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(idx.astype(np.int32))),
                                                  *(batch.column(k).slice(i, j - i) for k in (1, 2, 3))], ["idx", "y", "at", "shard"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(alpha, beta, l1, l2)
        pdf = pdf.sort_values("at")
        for _ in range(epochs):
            for idx, y in zip(pdf["idx"], pdf["y"], strict=True):
                model.learn(idx, y)
        every = np.arange(1 << BITS)
        w = model.weights(every)
        on = np.flatnonzero(w)
        return pd.DataFrame({"idx": np.append(on, -1), "w": np.append(w[on], model.bias())})

    trained = rows.mapInArrow(features, "idx array<int>, y double, at double, shard bigint").groupBy("shard").applyInPandas(learn, "idx bigint, w double")
    table = trained.groupBy("idx").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).toArrow().to_pandas().sort_values("idx")
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0), None
    used = int(table["n"].max())
    idx, w = table["idx"].to_numpy(), table["w"].to_numpy() / used
    return idx[1:], w[1:], float(w[0])


def score(docs: DataFrame, labels: DataFrame, model=None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``model`` defaults to one trained here.

    The score reads the text only.  Null and empty texts score as the bias alone; without any labelled row all
    score 0.  Repeated rows score alike, an empty table gives an empty result, other columns are ignored.
    """
    idx, w, bias = model or train(docs, labels)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[idx] = w
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in steps(offsets):
                f, rows = feature_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                on = dense[f] != 0
                f, rows = distinct_by_row(f[on], rows[on])
                z = np.bincount(rows, dense[f], j - i)
                s = np.zeros(j - i) if bias is None else 1 / (1 + np.exp(-np.clip(z + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(s),
                                                  pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    given = docs.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), plain_text().alias("text"))
    return given.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
