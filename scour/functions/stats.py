"""Bounded-memory statistics over whole columns.

Nothing here gathers a whole column (or a whole group) into one task or onto
the driver:

* ``value_histogram`` counts (column, value) pairs with a map-side combine, so
  a value that holds a third of all rows collapses to one row per map task.
* ``order_statistics`` finds exact order statistics by the radix passes of
  ``radix.select``: plain counts, no sketches.
* ``quantiles`` turns order statistics into linear-interpolated quantiles
  (the same rule as pandas ``quantile`` and DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import radix
from scour.functions import types as KT
from scour.functions.exprs import nan_to_null, qcol

# Accuracy of approximate quantiles (relative rank error 1/ACCURACY); exact ones use no sketch.
ACCURACY = 10_000


# ---------------------------------------------------------------------------
# value histogram
# ---------------------------------------------------------------------------

def _slot(name: str, dt: T.DataType) -> Column:
    """Typed slot struct (l, d, s, t) holding one value; only one field is set."""
    c = nan_to_null(qcol(name), dt)
    null = F.lit(None)
    if KT.is_integral(dt) or KT.is_bool(dt):
        fields = (c.cast("bigint"), null.cast("double"), null.cast("string"), null.cast("timestamp_ntz"))
    elif KT.is_fractional(dt):
        fields = (null.cast("bigint"), c.cast("double"), null.cast("string"), null.cast("timestamp_ntz"))
    elif KT.is_datetime(dt):
        fields = (null.cast("bigint"), null.cast("double"), null.cast("string"), c.cast("timestamp_ntz"))
    else:
        fields = (null.cast("bigint"), null.cast("double"), c.cast("string"), null.cast("timestamp_ntz"))
    return F.struct(*[f.alias(a) for f, a in zip(fields, "ldst")])


def value_histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """(cid, v struct<l,d,s,t>, cnt) for every non-null value of every listed column."""
    if not cols:
        raise ValueError("no columns")
    pairs = F.array(*[F.struct(F.lit(i).alias("cid"), _slot(c, KT.dtype_of(df, c)).alias("v"))
                      for i, c in enumerate(cols)])
    exploded = df.select(F.inline(pairs))
    v = F.col("v")
    nonnull = v.l.isNotNull() | v.d.isNotNull() | v.s.isNotNull() | v.t.isNotNull()
    return exploded.where(nonnull).groupBy("cid", "v").agg(F.count(F.lit(1)).alias("cnt"))


def histogram_summary(hist: DataFrame) -> DataFrame:
    """Per column: distinct count, non-null count, top count, mode (ties -> smallest)."""
    return hist.groupBy("cid").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("cnt").alias("n_values"),
        F.max("cnt").alias("top_cnt"),
        F.min_by("v", F.struct((-F.col("cnt")).alias("neg"), F.col("v").alias("v"))).alias("mode"),
    )


def slot_value(slot, dt: T.DataType):
    """Python value held by a collected slot row, converted back to the column family."""
    if slot is None:
        return None
    if KT.is_bool(dt):
        return None if slot["l"] is None else bool(slot["l"])
    if KT.is_integral(dt):
        return slot["l"]
    if KT.is_fractional(dt):
        return slot["d"]
    if KT.is_datetime(dt):
        t = slot["t"]
        if t is not None and isinstance(dt, T.DateType):
            return t.date()
        return t
    return slot["s"]


def _digest(c: Column, dt: T.DataType) -> Column:
    """(a, b): 128 bits that stand for a value.  ``a`` alone is one-to-one for types of at most 64 bits."""
    fixed = KT.is_integral(dt) or KT.is_bool(dt) or KT.is_datetime(dt) or isinstance(dt, (T.FloatType, T.DoubleType))
    c = c if fixed or KT.is_string(dt) or isinstance(dt, T.DecimalType) else c.cast("string")
    return F.struct(F.xxhash64(c).alias("a"), (F.lit(0).cast("bigint") if fixed else F.xxhash64(F.lit("second"), c)).alias("b"))


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact number of distinct non-null values of each column: one shuffle, of 16-byte digests and not of the values,
    combined in the map tasks."""
    if not cols:
        return {}
    items = []
    for i, c in enumerate(cols):
        dt = KT.dtype_of(df, c)
        v = nan_to_null(qcol(c), dt)
        items.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("cid"), _digest(v, dt).alias("h"))))
    found = df.select(F.inline(F.array(*items))).where(F.col("cid").isNotNull()).select("cid", "h.a", "h.b").distinct()
    counts = {r["cid"]: r["n"] for r in found.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: counts.get(i, 0) for i, c in enumerate(cols)}


@dataclass
class ColumnCounts:
    n_distinct: int
    n_values: int
    top_cnt: int
    mode: object
    samples: list | None = None


def column_counts(df: DataFrame, cols: list[str], *, samples: int = 0) -> dict[str, ColumnCounts]:
    """Exact distinct count, non-null count, top count and mode for each column (one shuffle).

    With ``samples=k`` the k smallest values (with repeats) per column are
    returned in ``ColumnCounts.samples``, taken from the same histogram by a
    per-column group limit (each map task ships at most k rows per column).
    """
    if not cols:
        return {}
    hist = value_histogram(df, cols)
    summ = histogram_summary(hist).select("cid", F.lit(0).alias("kind"), "n_distinct", "n_values", "top_cnt",
                                          "mode", F.lit(None).cast("int").alias("rn"),
                                          F.lit(None).cast("bigint").alias("cnt"))
    rows = []
    if samples > 0:
        w = Window.partitionBy("cid").orderBy("v")
        low = (hist.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples)
               .select("cid", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("n_distinct"),
                       F.lit(None).cast("bigint").alias("n_values"), F.lit(None).cast("bigint").alias("top_cnt"),
                       F.col("v").alias("mode"), "rn", "cnt"))
        summ = summ.unionByName(low)
    rows = summ.collect()
    out = {c: ColumnCounts(0, 0, 0, None, []) for c in cols}
    low_rows = {}
    for r in rows:
        c = cols[r["cid"]]
        if r["kind"] == 0:
            out[c] = ColumnCounts(int(r["n_distinct"]), int(r["n_values"]), int(r["top_cnt"]),
                                  slot_value(r["mode"], KT.dtype_of(df, c)), [])
        else:
            low_rows.setdefault(c, []).append((r["rn"], slot_value(r["mode"], KT.dtype_of(df, c)), r["cnt"]))
    for c, items in low_rows.items():
        vals = []
        for _, v, cnt in sorted(items, key=lambda x: x[0]):
            vals += [v] * int(min(cnt, samples))
        out[c].samples = vals[:samples]
    return out


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, ties broken by the smallest value."""
    return {c: cc.mode for c, cc in column_counts(df, cols).items()}


# ---------------------------------------------------------------------------
# exact order statistics
# ---------------------------------------------------------------------------

def order_statistics(df: DataFrame, exprs: dict[str, Column], targets: list[tuple[str, int]], *, with_counts: bool = False,
                     **widths) -> dict:
    """Exact value at 0-based ascending rank ``r`` of each named numeric expression (NULLs excluded).

    ``targets`` lists (name, rank) pairs; ranks outside [0, n) give None.  With ``with_counts`` each result is a
    ``radix.Selected``.  ``widths`` (bits, exact_rows) only change how many passes it takes.
    """
    if not targets:
        return {}
    types = df.select(*[e.alias(n) for n, e in exprs.items()]).schema
    wanted = {t[0] for t in targets}
    values = {n: (nan_to_null(e, types[n].dataType), types[n].dataType) for n, e in exprs.items() if n in wanted}
    found = radix.select(*radix.with_codes(df, values), targets, **widths)
    if with_counts:
        return found
    return {t: None if s is None else radix.value_of(s.code, types[t[0]].dataType) for t, s in found.items()}


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation (exact at both ends)."""
    diff = b - a
    return b - diff * (1 - t) if t >= 0.5 else a + diff * t


def _num_exprs(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Columns as they are where one code holds them exactly, decimals of over 18 digits as doubles."""
    out = {}
    for c in cols:
        dt = KT.dtype_of(df, c)
        v = nan_to_null(qcol(c), dt)
        out[c] = v if radix.one_word(dt) and not KT.is_string(dt) else v.cast("double")
    return out


def value_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Non-null count per column in one pass."""
    row = df.agg(*[F.count(e).alias(f"k{i}") for i, e in enumerate(_num_exprs(df, cols).values())]).first()
    return {c: row[f"k{i}"] for i, c in enumerate(cols)}


def quantile_plan(n: int, probs: list[float]) -> list[tuple[int, int, float]]:
    """(low rank, high rank, fraction) per probability for n values (linear interpolation)."""
    out = []
    for p in probs:
        h = (n - 1) * p
        lo, hi = math.floor(h), math.ceil(h)
        out.append((lo, hi, h - lo))
    return out


def finish_quantiles(plan, values: dict[int, object]) -> list[float]:
    out = []
    for lo, hi, t in plan:
        a, b = float(values[lo]), float(values[hi])
        out.append(a if lo == hi else _lerp(a, b, t))
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float], *, method: str = "exact",
              known: dict[str, int] | None = None, accuracy: int = ACCURACY) -> dict[str, list]:
    """Linear-interpolated quantiles of each numeric column (NaN/NULL ignored).

    ``method="exact"`` uses ``order_statistics``; ``"approx"`` uses one
    ``percentile_approx`` pass.  ``known`` may give non-null counts.  Returns col -> list aligned with ``probs``
    (None for an all-missing column).
    """
    if not cols:
        return {}
    exprs = _num_exprs(df, cols)
    if method == "approx":
        row = df.agg(*[F.percentile_approx(e, list(probs), accuracy).alias(f"q{i}")
                       for i, e in enumerate(exprs.values())]).collect()[0]
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    known = dict(known or {})
    if any(c not in known for c in cols):
        known.update(value_counts(df, [c for c in cols if c not in known]))
    plan = {c: quantile_plan(known[c], probs) if known[c] else None for c in cols}
    ranks = {(c, r) for c in cols if plan[c] for lo, hi, _ in plan[c] for r in (lo, hi)}
    st = order_statistics(df, exprs, sorted(ranks))
    return {c: [None] * len(probs) if plan[c] is None else finish_quantiles(plan[c], {r: st[c, r] for k, r in ranks if k == c})
            for c in cols}


def medians(df: DataFrame, cols: list[str], *, method: str = "exact", known: dict[str, int] | None = None) -> dict[str, float | None]:
    """Median = mean of the two middle values for an even count."""
    if not cols:
        return {}
    if method == "approx":
        return {c: v[0] for c, v in quantiles(df, cols, [0.5], method="approx").items()}
    known = dict(known or {})
    if any(c not in known for c in cols):
        known.update(value_counts(df, [c for c in cols if c not in known]))
    middle = {c: ((known[c] - 1) // 2, known[c] // 2) for c in cols if known[c]}
    st = order_statistics(df, _num_exprs(df, cols), sorted({(c, r) for c, rs in middle.items() for r in rs}))
    out: dict = {}
    for c in cols:
        if c not in middle:
            out[c] = None
            continue
        a, b = (v if isinstance(v, int) else float(v) for v in (st[c, r] for r in middle[c]))
        out[c] = a if a == b else (a + b) / 2
    return out
