"""K-nearest-neighbour imputation (X3): a missing number becomes the mean over the nearest rows that have it.

The distance of two rows is taken over the columns both have, scaled up by (columns / columns both have).  Rows fold to
distinct points first, so copies cost one point.  Points of one pattern of present columns fall into the cell of their
nearest pivot; a cell keeps its radius.  For any other row the columns it shares with a cell are the same throughout the
cell, so that the triangle inequality holds on them: it bounds the distance from both sides, and only the cells that
may hold one of the k nearest points are compared, in blocks of bounded size.  Nothing is left out: the result equals
that of comparing all pairs.

On the driver and in each task there are at most ``PIVOTS`` + ``PATTERNS`` pivots.  A cell holds points / ``PIVOTS``
points on average, cut into blocks of ``BLOCK``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scour.functions import stats
from scour.functions import types as KT
from scour.functions.exprs import nan_to_null, qcol
from scour.operators.missing import _null_counts
from scour.session import cut_lineage

NEIGHBOURS = 5
PIVOTS = 1024
PATTERNS = 1024
BLOCK = 4096
#: Cell of the points whose pattern is not among the ``PATTERNS`` most frequent ones: no bounds, always compared.
REST = -1
#: Relative slack of the bounds, far above the rounding of a distance.
_SLACK = 1e-9


def _values(df: DataFrame, columns: list[str]):
    """One array of doubles; NaN stands for a missing or infinite value."""
    out = []
    for c in columns:
        v = nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double")
        out.append(F.when(F.abs(v) < float("inf"), v).otherwise(F.lit(float("nan"))))
    return F.array(*out)


def _points(df: DataFrame, columns: list[str]) -> DataFrame:
    """(v, n, q): distinct points with their number of rows and the bits of their present columns."""
    points = df.select(_values(df, columns).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    bits = [F.when(F.isnan(F.col("v")[j]), F.lit(0)).otherwise(F.lit(1 << j)).cast("bigint") for j in range(len(columns))]
    return points.select("v", "n", sum(bits[1:], bits[0]).alias("q"))


def _scales(df: DataFrame, columns: list[str]) -> list[float]:
    """Standard deviations; 1 where there is none or it isn't finite."""
    v = _values(df, columns)
    row = df.select(v.alias("v")).agg(*[F.stddev_pop(F.when(~F.isnan(F.col("v")[j]), F.col("v")[j])) for j in range(len(columns))]).first()
    return [float(s) if s and np.isfinite(s) else 1.0 for s in row]


def _pivots(points: DataFrame) -> list[tuple[int, list[float]]]:
    """(pattern, point): a share of the pivots for each pattern, chosen by a hash of the point."""
    counts = points.groupBy("q").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "q").limit(PATTERNS).collect()
    total = sum(r.c for r in counts)
    if not total:
        return []
    wanted = min(PIVOTS, int(np.ceil(np.sqrt(total))))
    share = points.sparkSession.createDataFrame([(r.q, int(np.ceil(wanted * r.c / total))) for r in counts], "q bigint, wanted int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.xxhash64("v"), "v"))
    first = points.select("q", "v", place.alias("place")).where(F.col("place") <= PIVOTS)
    return [(r.q, r.v) for r in first.join(F.broadcast(share), "q").where("place <= wanted").select("q", "v").collect()]


def _bits(q: int, m: int) -> list[int]:
    return [j for j in range(m) if int(q) >> j & 1]


def _assigned(points: DataFrame, pivots: list, scale: np.ndarray) -> DataFrame:
    """Points with their cell, the number of the nearest pivot of the same pattern, and the distance to it."""
    m = len(scale)
    at = {q: np.array([i for i, p in enumerate(pivots) if p[0] == q]) for q in {p[0] for p in pivots}}
    centres = np.array([p[1] for p in pivots], np.float64).reshape(-1, m) / scale

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()) / scale
            cell, dist = np.full(len(pdf), REST), np.zeros(len(pdf))
            for q in pdf["q"].unique():
                rows = np.flatnonzero(pdf["q"].to_numpy() == q)
                for part in np.array_split(rows, len(rows) // 1000 + 1) if q in at else ():
                    d2 = np.zeros((len(part), len(at[q])))
                    with np.errstate(over="ignore"):
                        for j in _bits(q, m):
                            d2 += (x[part, j][:, None] - centres[at[q], j]) ** 2
                    near = d2.argmin(1)
                    cell[part], dist[part] = at[q][near], np.sqrt(d2[np.arange(len(part)), near])
            yield pd.DataFrame({"v": pdf["v"], "n": pdf["n"], "q": pdf["q"], "cell": cell, "dist": dist})

    return points.mapInPandas(run, "v array<double>, n bigint, q bigint, cell int, dist double")


def _searches(receivers: DataFrame, cells: list, pivots: list, scale: np.ndarray, targets: list[int], k: int) -> DataFrame:
    """(pid, v, cell, mask): the cells that may hold one of the k nearest points for the target columns in ``mask``."""
    m = len(scale)
    rest = any(c.cell == REST for c in cells)
    cells = [c for c in cells if c.cell != REST]
    ids = np.array([c.cell for c in cells], np.int64)
    radius = np.array([c.radius for c in cells], np.float64)
    weight = np.array([c.weight for c in cells], np.int64)
    pattern = np.array([c.q for c in cells], np.int64)
    centres = np.array([pivots[i][1] for i in ids], np.float64).reshape(-1, m) / scale

    def bounds(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        d2, shared = np.zeros((len(x), len(ids))), np.zeros(len(ids), np.int64)
        for j in _bits(p, m):
            has = pattern >> j & 1 == 1
            d2[:, has] += (x[:, j][:, None] - centres[has, j]) ** 2
            shared += has
        grow = np.sqrt(np.where(shared > 0, m / np.maximum(shared, 1), np.inf))
        d, r = np.sqrt(d2) * grow, radius * grow
        low = np.maximum(np.nan_to_num(d * (1 - _SLACK) - r * (1 + _SLACK), nan=0.0, posinf=np.inf), 0.0)
        high = np.nan_to_num((d + r) * (1 + _SLACK), nan=np.inf, posinf=np.inf)
        return np.where(shared > 0, low, np.inf), np.where(shared > 0, high, np.inf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for p in whole["q"].unique():
                same = whole[whole["q"] == p]
                missing = [t for t in targets if not int(p) >> t & 1]
                for start in range(0, len(same), 256):
                    pdf = same.iloc[start:start + 256]
                    with np.errstate(over="ignore", invalid="ignore"):
                        low, high = bounds(np.stack(pdf["v"].to_numpy()) / scale, p)
                    mask = np.zeros(low.shape, np.int64)
                    for t in missing:
                        own = np.flatnonzero(pattern >> t & 1 == 1)
                        if not len(own):
                            continue
                        order = own[np.argsort(high[:, own], axis=1)]
                        enough = np.cumsum(weight[order], axis=1) >= k
                        place = np.where(enough.any(1), enough.argmax(1), order.shape[1] - 1)
                        far = high[np.arange(len(pdf)), order[np.arange(len(pdf)), place]]
                        far = np.where(enough.any(1), far, np.inf)
                        can = (low[:, own] <= far[:, None]) & np.isfinite(low[:, own])
                        mask[:, own] |= can.astype(np.int64) << t
                    r, c = np.nonzero(mask)
                    v = pdf["v"].to_numpy()
                    yield pd.DataFrame({"pid": pdf["pid"].to_numpy()[r], "v": v[r], "cell": ids[c], "mask": mask[r, c]})
                    if rest and missing:
                        yield pd.DataFrame({"pid": pdf["pid"], "v": pdf["v"], "cell": REST, "mask": sum(1 << t for t in missing)})

    return receivers.mapInPandas(run, "pid bigint, v array<double>, cell int, mask bigint")


def _nearest(scale: np.ndarray, targets: list[int], k: int):
    """Compares a block of searches with a block of points: (pid, t, d, n, s), the rows and their sum at each of the k
    least squared distances."""
    m = len(scale)
    names = ["pid", "t", "d", "n", "s"]

    def run(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(points):
            return pd.DataFrame({c: [] for c in names})
        a, raw = np.stack(asked["v"].to_numpy()) / scale, np.stack(points["v"].to_numpy())
        b, n, out = raw / scale, points["n"].to_numpy(), []
        for start in range(0, len(a), 128):
            rows = slice(start, start + 128)
            d2, shared = np.zeros((len(a[rows]), len(b))), np.zeros((len(a[rows]), len(b)), np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                for j in range(m):
                    diff = a[rows, j][:, None] - b[:, j]
                    both = ~np.isnan(diff)
                    d2 += np.where(both, diff * diff, 0.0)
                    shared += both
                d2 = np.where(shared > 0, d2 * (m / np.maximum(shared, 1)), np.inf)
            pid, mask = asked["pid"].to_numpy()[rows], asked["mask"].to_numpy()[rows]
            for t in targets:
                who, has = np.flatnonzero(mask >> t & 1), np.flatnonzero(~np.isnan(raw[:, t]))
                if not len(who) or not len(has):
                    continue
                d = d2[np.ix_(who, has)]
                last = min(k, len(has)) - 1
                r, c = np.nonzero((d <= np.partition(d, last, axis=1)[:, last][:, None]) & np.isfinite(d))
                found = pd.DataFrame({"pid": pid[who[r]], "t": t, "d": d[r, c], "n": n[has[c]], "s": n[has[c]] * raw[has[c], t]})
                out.append(found.groupby(["pid", "t", "d"], as_index=False)[["n", "s"]].sum())
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({c: [] for c in names})

    return run


def _compared(asked: DataFrame, donors: DataFrame, cells: list, scale: np.ndarray, targets: list[int], k: int) -> DataFrame:
    """(pid, t, value): the mean over the nearest rows, from blocks of searches and points of the same cell."""
    spark = asked.sparkSession
    searches = {r.cell: r.c for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).collect()}
    sizes = spark.createDataFrame([(c.cell, -(-searches[c.cell] // BLOCK), -(-c.points // BLOCK)) for c in cells if c.cell in searches],
                                  "cell int, asks int, parts int")
    sizes = F.broadcast(sizes)
    left = asked.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("pid"), "asks").cast("int").alias("ask"),
                                            F.explode(F.sequence(F.lit(1), "parts")).alias("part"), "pid", "v", "mask")
    right = donors.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"),
                                              (F.pmod(F.xxhash64("v"), "parts") + 1).cast("int").alias("part"), "v", "n")
    keys = ["cell", "ask", "part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _nearest(scale, targets, k), "pid bigint, t int, d double, n bigint, s double")
    near = near.groupBy("pid", "t", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    closer = F.sum("n").over(Window.partitionBy("pid", "t").orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("closer", F.coalesce(closer, F.lit(0))).where(F.col("closer") < k)
    return near.groupBy("pid", "t").agg((F.sum("s") / F.sum("n")).alias("value"))


def knn_impute(df: DataFrame, columns: list[str] | None = None, targets: list[str] | None = None, *, k: int = NEIGHBOURS,
               scaled: bool = True, donors: DataFrame | None = None) -> DataFrame:
    """Fill the missing values of ``targets`` (default: all of ``columns``) from the ``k`` nearest rows that have them.

    Distances are over ``columns`` (default: all numeric ones, at most 62), each divided by its standard deviation unless
    ``scaled`` is off.  Rows as far as the k-th nearest all count, so that the result doesn't depend on the order of
    rows.  Values come from ``donors`` (default: ``df`` itself), which has the same columns.  Where no row shares a column,
    or none has the target, the median of the donors fills; a target without any value stays missing.  Infinite values stay
    as they are and neither count in a distance nor fill.  Targets with a missing value become double; other columns and
    all rows stay as they are.
    """
    columns = list(columns) if columns is not None else KT.columns_where(df, KT.is_number)
    targets = list(targets) if targets is not None else columns
    if not set(targets) <= set(columns):
        raise ValueError("targets must be among the columns")
    if len(columns) > 62:
        raise ValueError("at most 62 columns")
    if k < 1:
        raise ValueError("k must be at least 1")
    miss = _null_counts(df)[1] if targets else {}
    targets = [c for c in targets if miss[c]]
    if not targets:
        return df
    source = donors if donors is not None else df
    wanted = [columns.index(c) for c in targets]
    bits = sum(1 << t for t in wanted)
    scale = np.array(_scales(source, columns) if scaled else [1.0] * len(columns))
    finite = source.select(*[F.when(F.abs(qcol(c).cast("double")) < float("inf"), qcol(c)).alias(c) for c in targets])
    median = stats.medians(finite, targets)

    points = cut_lineage(_points(source, columns).where("q != 0"))
    pivots = _pivots(points)
    placed = cut_lineage(_assigned(points, pivots, scale))
    cells = placed.groupBy("cell").agg(F.max("q").alias("q"), F.count(F.lit(1)).alias("points"), F.sum("n").alias("weight"),
                                       F.max("dist").alias("radius")).collect()
    own = points if donors is None else _points(df, columns)
    asking = own.where((F.col("q") != 0) & (F.col("q").bitwiseAND(F.lit(bits)) != bits))
    asking = cut_lineage(asking.select(F.monotonically_increasing_id().alias("pid"), "v", "q"))
    asked = cut_lineage(_searches(asking, cells, pivots, scale, wanted, k))
    found = _compared(asked, placed, cells, scale, wanted, k)
    found = found.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("fills"))
    fills = asking.select("pid", "v").join(found, "pid").select("v", "fills")

    # only rows with a missing target are joined; the row travels as one value, so that no name can clash
    rows = df.select(F.struct(*[qcol(c) for c in df.columns]).alias("row"), _values(df, columns).alias("v"))
    lacking = F.lit(False)
    for t in wanted:
        lacking = lacking | F.isnan(F.col("v")[t])
    joined = rows.where(lacking).join(fills, "v", "left").select("row", "fills")
    rows = rows.where(~lacking).select("row", F.lit(None).cast("map<int,double>").alias("fills")).unionByName(joined)
    out = []
    for c in df.columns:
        v = F.col("row")[c]
        if c in targets:
            own_value = nan_to_null(v, KT.dtype_of(df, c)).cast("double")
            other = F.coalesce(own_value, F.try_element_at(F.col("fills"), F.lit(columns.index(c))))
            v = other if median[c] is None else F.coalesce(other, F.lit(float(median[c])))
        out.append(v.alias(c))
    return rows.select(*out)
