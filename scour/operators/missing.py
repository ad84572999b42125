"""Missing data: sparse-column drop (I1), indicators (I2), median / most-frequent /
mode fills (I3-I5), residual fill (I6) and flag-controlled basic fill (I7).

Fill values come from bounded statistics (``stats.medians`` selects exact
medians; modes come from the value histogram), so no column is gathered
into one task.  Applying is one ``select`` of ``coalesce`` expressions.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.functions import stats
from scour.functions import types as KT
from scour.functions import vocab
from scour.functions.exprs import nan_to_null, put, qcol

KEEP_ROLES = {"id", "datetime_feature", "text"}


def _null_counts(df: DataFrame, known: dict | None = None) -> tuple[int, dict[str, int]]:
    """Row count and missing count per column; with ``known`` (a dict) also fills
    the non-null counts of numeric columns for the median passes."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(nan_to_null(qcol(c), KT.dtype_of(df, c)).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).collect()[0]
    n = row["_n"]
    if known is not None:
        known.update({c: n - row[f"m{i}"] for i, c in enumerate(cols) if KT.is_number(KT.dtype_of(df, c))})
    return n, {c: row[f"m{i}"] for i, c in enumerate(cols)}


def _fill_values(df: DataFrame, cols: list[str], *, method: str = "exact",
                 unknown_for_all_missing: bool = True, known: dict | None = None) -> dict[str, dict]:
    """Fill rule per column: numeric -> median, datetime -> most frequent (earliest on ties),
    other -> mode (smallest on ties) or 'unknown' when nothing is present."""
    dts = {c: KT.dtype_of(df, c) for c in cols}
    num = [c for c in cols if KT.is_number(dts[c])]
    other = [c for c in cols if c not in num]
    med = stats.medians(df, num, method=method, known=known) if num else {}
    md = stats.modes(df, other) if other else {}
    out = {}
    for c in cols:
        if c in num:
            out[c] = {"strategy": "median", "value": med.get(c)}
        elif KT.is_datetime(dts[c]):
            out[c] = {"strategy": "most_frequent", "value": md.get(c)}
        else:
            v = md.get(c)
            if v is None and unknown_for_all_missing:
                v = "unknown"
            out[c] = {"strategy": "mode", "value": v}
    return out


def fill_expr(name: str, dt, spec: dict) -> Column:
    """``coalesce(col, literal)`` typed like the column (numbers become double)."""
    c = nan_to_null(qcol(name), dt)
    v = spec["value"]
    if v is None:
        return c
    if spec["strategy"] == "median" or (KT.is_number(dt) and isinstance(v, float)):
        return F.coalesce(c.cast("double"), F.lit(float(v)))
    if KT.is_datetime(dt):
        if isinstance(v, str):
            try:
                v = _dt.datetime.fromisoformat(v)
            except ValueError:  # e.g. 'unknown' for an all-missing column: the column becomes text
                return F.coalesce(c.cast("string"), F.lit(v))
        return F.coalesce(c, F.lit(v).cast(dt))
    if KT.is_string(dt) or isinstance(v, str):  # an all-missing boolean becomes text, as a date does
        return F.coalesce(c.cast("string"), F.lit(str(v)))
    return F.coalesce(c, F.lit(v).cast(dt))


def fit_missing(df: DataFrame, roles: dict[str, str] | None = None, *,
                sparse_ratio: float = vocab.SPARSE_COLUMN_RATIO, method: str = "exact") -> dict:
    """Which columns to drop, which get an indicator, and each fill value."""
    roles = roles or {}
    known: dict = {}
    n, miss = _null_counts(df, known)
    dropped, kept = [], []
    for c in df.columns:
        if not miss[c]:
            continue
        ratio = miss[c] / n
        if ratio > sparse_ratio and roles.get(c, "") not in KEEP_ROLES:
            dropped.append({"column": c, "missing_ratio": ratio})
        else:
            kept.append(c)
    fills = _fill_values(df, kept, method=method, known=known)
    return {
        "dropped_columns": dropped,
        "indicator_columns": [f"{c}_was_missing" for c in kept],
        "imputations": [{"column": c, **fills[c]} for c in kept],
    }


def apply_missing(df: DataFrame, params: dict, *, indicators: bool = True) -> DataFrame:
    drop = {d["column"] for d in params["dropped_columns"]}
    fills = {d["column"]: d for d in params["imputations"]}
    extra = {}
    if indicators:
        extra = {f"{c}_was_missing": nan_to_null(qcol(c), KT.dtype_of(df, c)).isNull().cast("int") for c in fills}
    values = {c: fill_expr(c, KT.dtype_of(df, c), spec) for c, spec in fills.items() if c in df.columns}
    return df.select(*put([c for c in df.columns if c not in drop], extra, values))


def handle_missing(df: DataFrame, roles: dict[str, str] | None = None, **kw) -> DataFrame:
    return apply_missing(df, fit_missing(df, roles, **kw))


def drop_sparse(df: DataFrame, threshold: float = vocab.SPARSE_COLUMN_RATIO,
                roles: dict[str, str] | None = None) -> DataFrame:
    """I1 alone: drop columns whose missing share exceeds ``threshold`` (id/datetime/text kept)."""
    roles = roles or {}
    n, miss = _null_counts(df)
    keep = [c for c in df.columns
            if not (n and miss[c] / n > threshold and roles.get(c, "") not in KEEP_ROLES)]
    return df.select(*[qcol(c) for c in keep])


def missing_indicators(df: DataFrame) -> DataFrame:
    """I2 alone: ``<col>_was_missing`` (0/1) for every column with a missing value."""
    _, miss = _null_counts(df)
    extra = {f"{c}_was_missing": nan_to_null(qcol(c), KT.dtype_of(df, c)).isNull().cast("int") for c in df.columns if miss[c]}
    return df.select(*put(df.columns, extra))


def impute(df: DataFrame, column: str, strategy: str = "auto", value=None, *, method: str = "exact") -> DataFrame:
    """I3-I5 / U2-U5 for one column: 'median', 'mean', 'mode', 'most_frequent', 'custom' or 'auto'."""
    dt = KT.dtype_of(df, column)
    if strategy == "auto":
        spec = _fill_values(df, [column], method=method)[column]
    elif strategy == "median":
        spec = {"strategy": "median", "value": stats.medians(df, [column], method=method)[column]}
    elif strategy == "mean":
        v = df.agg(F.avg(nan_to_null(qcol(column), dt))).collect()[0][0]
        spec = {"strategy": "median", "value": v}
    elif strategy in ("mode", "most_frequent"):
        spec = {"strategy": strategy, "value": stats.modes(df, [column])[column]}
    elif strategy == "custom":
        spec = {"strategy": "custom", "value": value}
    else:
        raise ValueError(strategy)
    return df.select(*[fill_expr(c, dt, spec).alias(c) if c == column else qcol(c) for c in df.columns])


def fit_residual(df: DataFrame, *, method: str = "exact") -> dict:
    """Fill values for every column that still has a missing value (no indicators)."""
    known: dict = {}
    _, miss = _null_counts(df, known)
    cols = [c for c in df.columns if miss[c]]
    fills = _fill_values(df, cols, method=method, known=known)
    return {"dropped_columns": [], "indicator_columns": [],
            "imputations": [{"column": c, **fills[c]} for c in cols]}


def ensure_complete(df: DataFrame, **kw) -> DataFrame:
    """I6 one-shot."""
    return apply_missing(df, fit_residual(df, **kw), indicators=False)


def fit_basic(df: DataFrame, *, method: str = "exact", known: dict | None = None) -> dict:
    """Numeric -> median (skipped when undefined); anything else -> mode or 'unknown'.
    ``known`` (a dict) receives the non-null counts of numeric columns."""
    known = known if known is not None else {}
    _, miss = _null_counts(df, known)
    cols = [c for c in df.columns if miss[c]]
    dts = {c: KT.dtype_of(df, c) for c in cols}
    num = [c for c in cols if KT.is_number(dts[c])]
    other = [c for c in cols if c not in num]
    med = stats.medians(df, num, method=method, known=known) if num else {}
    md = stats.modes(df, other) if other else {}
    imps = []
    for c in cols:
        if c in num:
            if med.get(c) is not None:
                imps.append({"column": c, "strategy": "median", "value": med[c]})
        else:
            v = md.get(c)
            imps.append({"column": c, "strategy": "mode", "value": "unknown" if v is None else v})
    return {"dropped_columns": [], "indicator_columns": [], "imputations": imps}


def basic_impute(df: DataFrame, **kw) -> DataFrame:
    """I7 one-shot."""
    return apply_missing(df, fit_basic(df, **kw), indicators=False)
