"""Isolation forest (X4): random trees on bounded sub-samples, every row scored by its mean path length.

Each tree is fitted on ``sample`` rows, the algorithm's own parameter, drawn from a pool of at most trees * sample rows
that a hash of the rows' contents chooses.  A forest is five short arrays; scoring is one vectorised map over
all rows without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import types as KT
from scour.functions.exprs import nan_to_null, put, qcol

TREES, SAMPLE = 100, 256
_EULER = 0.5772156649015329


def mean_path(n: int) -> float:
    """c(n): the mean depth of an unsuccessful search in a random binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, threshold, left, right, path length of a row that ends here); feature -1 is a leaf."""
    nodes: list = [None]
    todo = [(0, x, 0)]
    while todo:
        at, rows, depth = todo.pop()
        known = ~np.isnan(rows)
        low = np.where(known, rows, np.inf).min(0, initial=np.inf)
        high = np.where(known, rows, -np.inf).max(0, initial=-np.inf)
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(wide):
            nodes[at] = (-1, 0.0, 0, 0, depth + mean_path(len(rows)))
            continue
        f = int(rng.choice(wide))
        # half the bounds first: their difference may pass the largest number
        cut = float(2 * (low[f] / 2 + (high[f] / 2 - low[f] / 2) * rng.random()))
        cut = cut if low[f] < cut <= high[f] else float(high[f])
        left = rows[:, f] < cut  # a missing value isn't below anything: it goes right
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
        nodes += [None, None]
    return nodes


def _numbers(df: DataFrame, columns: list[str]) -> list:
    """The columns as doubles, infinities as the largest finite numbers."""
    big = float(np.finfo(np.float64).max)
    out = []
    for c in columns:
        v = nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double")
        out.append(F.when(v > big, big).when(v < -big, -big).otherwise(v))
    return out


def fit_isolation(df: DataFrame, columns: list[str] | None = None, *, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> dict:
    """The forest of the numeric ``columns`` (default: all): plain lists, fit for JSON.

    Equal tables give equal forests however their rows are dealt over tasks.  An empty table gives a forest without trees.
    """
    columns = list(columns) if columns is not None else KT.columns_where(df, KT.is_number)
    if not columns:
        raise ValueError("an isolation forest needs a numeric column")
    values = [v.alias(f"v{i}") for i, v in enumerate(_numbers(df, columns))]
    # chosen by a hash of contents and, among equal rows, of as many copies as there are: counts, not positions
    rows = df.select(*values).groupBy(*[f"v{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))
    most = trees * sample
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(most)).cast("int"))))
    chance = F.xxhash64(*[F.coalesce(F.col(f"v{i}"), F.lit(0.5)) for i in range(len(columns))], "copy", F.lit(seed))
    pool = copies.select(*[f"v{i}" for i in range(len(columns))], chance.alias("h")).orderBy("h", *[f"v{i}" for i in range(len(columns))]).limit(most).collect()
    x = np.array([[np.nan if v is None else v for v in r[:-1]] for r in pool], np.float64).reshape(-1, len(columns))
    forest: dict = {"columns": columns, "sample": min(sample, len(x)), "roots": [], "feature": [], "cut": [], "left": [], "right": [], "path": []}
    for t in range(trees if len(x) else 0):
        rng = np.random.default_rng([seed, t])
        rows_t = x[np.sort(rng.choice(len(x), forest["sample"], replace=False))]
        start = len(forest["feature"])
        forest["roots"].append(start)
        for f, cut, left, right, path in _grow(rows_t, rng, max(1, math.ceil(math.log2(max(2, forest["sample"]))))):
            for name, v in zip(("feature", "cut", "left", "right", "path"), (f, cut, start + left, start + right, path), strict=True):
                forest[name].append(v)
    return forest


def isolation_score(df: DataFrame, forest: dict, name: str = "isolation_score") -> DataFrame:
    """Add ``name``: 2^(-mean path / c(sample)), near 1 for rows that few cuts isolate, about 0.5 for usual ones, 0.5
    where the forest is empty or its sample has one row.  An existing column of that name is replaced."""
    arrays = {k: np.array(forest[k]) for k in ("roots", "feature", "cut", "left", "right", "path")}
    norm = mean_path(forest["sample"])
    if not forest["roots"] or norm == 0:
        return df.select(*put(df.columns, {name: F.lit(0.5)}))

    def score(batches: Iterator[tuple]) -> Iterator[pd.Series]:
        for batch in batches:
            batch = (batch,) if isinstance(batch, pd.Series) else batch  # one column comes alone
            x = np.stack([np.asarray(c, np.float64) for c in batch], 1)
            rows, total = np.arange(len(x)), np.zeros(len(x))
            for root in arrays["roots"]:
                at = np.full(len(x), root)
                inner = arrays["feature"][at] >= 0
                while inner.any():
                    own = at[inner]
                    below = x[rows[inner], arrays["feature"][own]] < arrays["cut"][own]
                    at[inner] = np.where(below, arrays["left"][own], arrays["right"][own])
                    inner = arrays["feature"][at] >= 0
                total += arrays["path"][at]
            yield pd.Series(2.0 ** (-total / len(arrays["roots"]) / norm))

    udf = F.pandas_udf(_typed(score), T.DoubleType())
    return df.select(*put(df.columns, {name: udf(*_numbers(df, forest["columns"]))}))


def _typed(fn):
    fn.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return fn


def isolation_outliers(df: DataFrame, columns: list[str] | None = None, *, threshold: float = 0.6, prefix: str = "", **kw) -> DataFrame:
    """X4 one-shot: ``<prefix>isolation_score`` and ``<prefix>isolation_flag`` (1 where the score passes ``threshold``)."""
    forest = fit_isolation(df, columns, **kw)
    return apply_isolation(df, forest, threshold, prefix)


def apply_isolation(df: DataFrame, forest: dict, threshold: float, prefix: str = "") -> DataFrame:
    score, flag = f"{prefix}isolation_score", f"{prefix}isolation_flag"
    out = isolation_score(df, forest, score)
    return out.select(*put(out.columns, {flag: (qcol(score) > threshold).cast("int")}))
