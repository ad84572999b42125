"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its text (hashed words and shape) and its metadata
(hashed source, language, length and other columns that describe it).  Both begin with the labelled rows.  In
each round each view scores all documents without a label, and the share of them that it is surest of is taught to the
*other* view.  Each view is then calibrated on labelled rows that neither trained on, and the calibrated log odds
are added to score every document.

Fitting is spread: every task descends on its own rows from the last weights, and the weights are averaged by
how often a task met their coordinate.  Who was taught what follows from the models and thresholds of the rounds so far,
so no labels are stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import crc_of_id, plain_text, steps, text_buffers, unit_hash, written
from scour.llm.textkit import NOT_WORD, U, distinct_by_row, word_hashes

TEXT_BITS, META_BITS, SHAPE = 16, 12, 8
FEW_LABELS = 1 << 20  # up to so many labels are sent to all tasks instead of shuffling texts
CHUNK = 4096  # rows that a task descends on together


def text_view(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and row: distinct hashed words, and bins of five shape measures (words, repeats, capitals, digits, marks)."""
    n = len(offsets) - 1
    h, rows = word_hashes(data, offsets, NOT_WORD)
    words = np.bincount(rows, minlength=n)
    h, rows = distinct_by_row(h, rows)
    size = np.maximum(np.diff(offsets), 1)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    share = [np.bincount(row_of[mask], minlength=n) / size for mask in (
        (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), (data < 128) & NOT_WORD[data] & (data > 32))] if len(data) else [np.zeros(n)] * 3
    shape = [np.log2(words + 1) / 2, np.bincount(rows, minlength=n) / np.maximum(words, 1) * 8, *(np.log2(1 + 100 * x) for x in share)]
    bins = np.stack([np.minimum(x, SHAPE - 1).astype(np.int64) + (1 << TEXT_BITS) + k * SHAPE for k, x in enumerate(shape)], 1)
    idx = np.concatenate([(h >> U(64 - TEXT_BITS)).astype(np.int64), bins.ravel()])
    at = np.concatenate([rows, np.repeat(np.arange(n), len(shape))])
    order = np.argsort(at, kind="stable")
    return idx[order], at[order]


TEXT_WIDTH, META_WIDTH = (1 << TEXT_BITS) + 5 * SHAPE, 1 << META_BITS


def meta_view(docs: DataFrame, names: tuple[str, ...]):
    """One array column of hashed (column, value) coordinates; a number counts by its power of two."""
    cells = []
    for c in names:
        kind = docs.schema[c].dataType.simpleString()
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        value = F.floor(F.log2(F.abs(F.col(f"`{c}`").cast("double")) + 1)).cast("string") if number else F.col(f"`{c}`").cast("string")
        cells.append(F.pmod(F.xxhash64(F.lit(c), F.coalesce(value, F.lit("\0"))), F.lit(META_WIDTH)))
    return F.array(*cells).cast("array<bigint>")


def sparse(column) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and row of an Arrow list column."""
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def margin(weights: tuple[np.ndarray, float], idx: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Logistic margin of 0/1 rows, each scaled to unit length."""
    return weights[1] + np.bincount(at, weights[0][idx], n) / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))


def descend(weights: tuple[np.ndarray, float], idx: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 40, rate: float = 0.3,
            l2: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """AdaGrad on a few thousand rows: the coordinates met, how often each was, their weights, and the offset."""
    met, idx, often = np.unique(idx, return_inverse=True, return_counts=True)
    w, b, n = weights[0][met], weights[1], len(y)
    s = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))
    seen, seen_b = np.ones(len(w)), 1.0  # so a rare coordinate moves little
    for _ in range(turns):
        g = (1 / (1 + np.exp(-np.clip(b + np.bincount(at, w[idx], n) * s, -35, 35))) - y) * weight
        gw = np.bincount(idx, (g * s)[at], len(w)) + l2 * w
        seen += gw * gw
        w = w - rate * gw / np.sqrt(seen)
        seen_b += g.sum() ** 2
        b -= rate * g.sum() / np.sqrt(seen_b)
    return met, often, w, float(b)


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of the log odds, by Newton steps with a small prior on slope 1."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([((p - y) * m).sum() + (a - 1), (p - y).sum() + 0.1 * b])
        v = p * (1 - p)
        h = np.array([[(v * m * m).sum() + 1, (v * m).sum()], [(v * m).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(0.0, float(a)), float(b)


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    bias: tuple[float, float]
    scale: tuple[tuple[float, float], tuple[float, float]]
    prior: float
    taught: tuple[int, int]  # documents whose label each view got from the other


@dataclass
class Round:
    """The views' weights in a round, and the margins up to which (low) and from which (high) they teach."""
    weights: list[tuple[np.ndarray, float]]
    low: tuple[float, float]
    high: tuple[float, float]


def lessons(past: list[Round], views: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, free: np.ndarray, tie: np.ndarray) -> list[np.ndarray]:
    """Each view's label of every row after the rounds so far (NaN: none); rows in ``free`` get theirs from the other view."""
    label = [np.where(free, np.nan, y) for _ in views]
    for r in past:
        m = [margin(r.weights[k], *views[k], len(y)) + tie for k in (0, 1)]
        for k in (0, 1):
            new = free & np.isnan(label[1 - k])
            label[1 - k] = np.where(new & (m[k] <= r.low[k]), 0.0, np.where(new & (m[k] >= r.high[k]), 1.0, label[1 - k]))
    return label


def features(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], tune: int) -> DataFrame:
    """text, meta, y, fold and tie of every document. fold: 0 without a label, 1 to fit, 2 (about ``tune`` rows) to calibrate."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.where(crc_of_id() % 5 != 0)
    n_known = known.count()
    rows = docs.select("doc_id", plain_text().alias("text"), meta_view(docs, names).alias("meta"))
    if n_known <= FEW_LABELS:
        rows = rows.join(F.broadcast(known), "doc_id", "left")
    else:  # rows without an id aren't joined: they would all go to one task
        rows = rows.where("doc_id is not null").join(known, "doc_id", "left").unionByName(rows.where("doc_id is null").withColumn("y", F.lit(None).cast("double")))
    fold = F.when(F.col("y").isNull(), 0).when(unit_hash("doc_id", seed="tune") < min(0.25, tune / max(1, n_known)), 2).otherwise(1)
    rows = rows.select("text", "meta", "y", fold.alias("fold"), (unit_hash("doc_id", "text", seed="tie") * 1e-6).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in steps(offsets):
                idx, at = text_view(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ends = np.searchsorted(at, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(idx.astype(np.int32))),
                                                  *(batch.column(k).slice(i, j - i) for k in (1, 2, 3, 4))], ["text", "meta", "y", "fold", "tie"])

    return written(rows.mapInArrow(run, "text array<int>, meta array<bigint>, y double, fold int, tie double"), "views")


def unpack(batch: pa.RecordBatch):
    """Views, label, fold and tie of a batch of ``features``."""
    y = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
    return [sparse(batch.column(k)) for k in (0, 1)], y, batch.column(3).to_numpy(), batch.column(4).to_numpy()


def fit(rows: DataFrame, past: list[Round], start: list[tuple[np.ndarray, float]], share: float) -> tuple[list[tuple[np.ndarray, float]], tuple[int, int]]:
    """One averaged descent of both views on all rows they have labels for; and the number of labels each got from the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = [np.zeros(len(w) + 2) for w, _ in start]  # the last two: rows, and rows taught by the other view
        total = [np.zeros(len(w) + 2) for w, _ in start]
        held: list[list] = [[], []]

        def flush(k: int) -> None:
            count = np.cumsum([0] + [len(x[2]) for x in held[k]])
            idx = np.concatenate([x[0] for x in held[k]])
            at = np.concatenate([x[1] + c for x, c in zip(held[k], count, strict=False)])
            t, free = (np.concatenate([x[c] for x in held[k]]) for c in (2, 3))
            weight = np.where(free, 0.5, 1.0) * np.where(t > 0.5, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
            met, n, w, b = descend(start[k], idx, at, t, weight)
            often[k][met] += n
            total[k][met] += n * w
            often[k][-2] += len(t)
            total[k][-2] += len(t) * b
            often[k][-1] += free.sum()
            held[k].clear()

        for batch in batches:
            views, y, fold, tie = unpack(batch)
            label = lessons(past, views, np.where(fold == 1, y, np.nan), fold == 0, tie)
            for k in (0, 1):
                use = ~np.isnan(label[k])
                idx, at = views[k]
                mine = use[at]
                if use.any():
                    held[k].append((idx[mine], (np.cumsum(use) - 1)[at[mine]], label[k][use], (fold == 0)[use]))
                if sum(len(x[2]) for x in held[k]) >= CHUNK:
                    flush(k)
        for k in (0, 1):
            if held[k]:
                flush(k)
            at = np.flatnonzero(often[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(often[k][at]), pa.array(total[k][at])], ["view", "at", "n", "total"])

    table = rows.mapInArrow(run, "view bigint, at bigint, n double, total double").groupBy("view", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    view, at, n, total = (table[c].to_numpy() for c in ("view", "at", "n", "total"))
    out, taught = [], []
    for k, (w, b) in enumerate(start):
        w, mine = np.r_[w, b, 0.0], view == k
        w[at[mine]] = total[mine] / n[mine]
        out.append((w[:-2], float(w[-2])))
        taught.append(int(n[mine & (at == len(w) - 1)].sum()))
    return out, (taught[0], taught[1])


def thresholds(rows: DataFrame, past: list[Round], weights: list[tuple[np.ndarray, float]], take: float, share: float) -> Round:
    """The margins that bound the surest ``take`` of all rows that the other view has no label for, split as the classes are.
    A row is only taught on the side of the margin that it stands on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, y, fold, tie = unpack(batch)
            label = lessons(past, views, y, fold == 0, tie)
            m = [np.where((fold == 0) & np.isnan(label[1 - k]), margin(weights[k], *views[k], len(y)) + tie, np.nan) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True) for x in m], ["m0", "m1"])

    at = F.array(F.lit(take * (1 - share)), F.lit(1 - take * share))
    got = rows.mapInArrow(run, "m0 double, m1 double").agg(*[F.percentile_approx(f"m{k}", at, 10_000).alias(f"q{k}") for k in (0, 1)]).first()
    low, high = zip(*((min(q[0], 0.0), max(q[1], 0.0)) if q else (-np.inf, np.inf) for q in got), strict=True)
    return Round(weights, low, high)


def train(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], rounds: int = 4, take: float = 0.1, tune: int = 4000) -> Model | None:
    """Co-train on all documents: the labelled ones teach both views, and in each of ``rounds`` every view teaches the other
    the share ``take`` of the rest that it is surest of.  None without both classes.

    Rows whose crc32(doc_id) mod 5 is 0 are held out: their labels aren't read, so they are taught like any other.
    About ``tune`` labelled rows (a quarter at most) are kept for calibration.  An id that is labelled more than once is
    good only if all labels say so; null labels don't count.
    """
    rows = features(docs, labels, names, tune)
    n, good = rows.where("fold = 1").agg(F.count("y"), F.sum("y")).first()
    if not n or good in (0, n):
        return None
    share = good / n
    weights = [(np.zeros(TEXT_WIDTH), 0.0), (np.zeros(META_WIDTH), 0.0)]
    past: list[Round] = []
    for _ in range(rounds):
        weights, _ = fit(rows, past, weights, share)
        past.append(thresholds(rows, past, weights, take, share))
    weights, taught = fit(rows, past, weights, share)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, y, _, _ = unpack(batch)
            yield pa.RecordBatch.from_arrays([pa.array(y), *(pa.array(margin(weights[k], *views[k], len(y))) for k in (0, 1))], ["y", "m0", "m1"])

    held = rows.where("fold = 2").mapInArrow(margins, "y double, m0 double, m1 double").toArrow()
    y, m0, m1 = (np.sort(held.to_pandas().to_records(index=False))[c] for c in ("y", "m0", "m1"))
    p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    return Model(weights[0][0], weights[1][0], (weights[0][1], weights[1][1]), (calibrate(m0, y), calibrate(m1, y)), float(np.log(p / (1 - p))), taught)


def score(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] | None = None, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_score, meta_score) for every row of ``docs``.

    ``names`` are the metadata columns (default: those of source, lang and n_chars that exist).  Null metadata is
    a value of its own; null and empty texts are scored by their shape.  Without labels of both classes every score
    is 0.5 and predicted 1.  Equal rows score alike, an empty table gives an empty result, other columns are ignored.
    """
    names = tuple(c for c in ("source", "lang", "n_chars") if c in docs.columns) if names is None else names
    model = model or train(docs, labels, names)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in steps(offsets):
                z = [np.zeros(j - i)] * 2
                total = np.zeros(j - i)
                if model is not None:
                    meta = batch.column(3).slice(i, j - i)
                    lists = (text_view(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]),
                             (meta.flatten().to_numpy(), np.repeat(np.arange(j - i), meta.value_lengths().to_numpy())))
                    z = []
                    for (idx, at), w, b, (slope, shift) in zip(lists, (model.text, model.meta), model.bias, model.scale, strict=True):
                        m = b + np.bincount(at, w[idx], j - i) / np.sqrt(np.maximum(np.bincount(at, minlength=j - i), 1))
                        z.append(slope * m + shift)
                    total = z[0] + z[1] - model.prior
                p = [1 / (1 + np.exp(-np.clip(x, -35, 35))) for x in (total, *z)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(p[0]),
                                                  pa.array((p[0] >= 0.5).astype(np.int32)), pa.array(p[1]), pa.array(p[2])],
                                                 ["doc_id", "held_out", "score", "predicted", "text_score", "meta_score"])

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    given = docs.select("doc_id", held.alias("held_out"), plain_text().alias("text"), meta_view(docs, names).alias("meta"))
    return given.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, text_score double, meta_score double")
