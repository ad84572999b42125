"""User-chosen steps (U1-U11), normalise-all (N1) and robust scaling.

A step is ``Step(column, action, method, params)``.  Each step fits its
statistic with one aggregate (or a bounded statistic) and applies as one
``select``; a step list is a fold over the frame.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions import stats
from scour.functions import types as KT
from scour.functions import vocab
from scour.functions.exprs import nan_to_null, qcol
from scour.operators import features, isolation, missing, neighbours
from scour.session import cut_lineage


@dataclass
class Step:
    column: str
    action: str  # drop, impute, scale, encode, normalize, outliers
    method: str | None = None  # mean, median, mode, custom, standard, minmax, robust, auto, onehot, label, isolation, knn
    params: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def of(d) -> "Step":
        if isinstance(d, Step):
            return d
        return Step(d.get("column"), d.get("action"), d.get("method"), d.get("params") or {})


def _replace(df: DataFrame, column: str, expr) -> DataFrame:
    return df.select(*[expr.alias(c) if c == column else qcol(c) for c in df.columns])


def scale_standard(df: DataFrame, column: str) -> tuple[DataFrame, dict]:
    """(x - mean) / population std; zero std divides by 1; missing stays missing."""
    v = nan_to_null(qcol(column), KT.dtype_of(df, column)).cast("double")
    mean, sd = df.agg(F.avg(v), F.stddev_pop(v)).collect()[0]
    scale = sd if sd else 1.0
    expr = (v - F.lit(mean if mean is not None else 0.0)) / F.lit(scale)
    return _replace(df, column, expr), {"mean": mean, "scale": scale}


def scale_minmax(df: DataFrame, column: str) -> tuple[DataFrame, dict]:
    """(x - min) / (max - min); a constant column becomes 0."""
    v = nan_to_null(qcol(column), KT.dtype_of(df, column)).cast("double")
    lo, hi = df.agg(F.min(v), F.max(v)).collect()[0]
    rng = (hi - lo) if (lo is not None and hi is not None and hi != lo) else 1.0
    expr = (v - F.lit(lo if lo is not None else 0.0)) / F.lit(rng)
    return _replace(df, column, expr), {"min": lo, "range": rng}


def scale_robust(df: DataFrame, column: str, *, method: str = "exact") -> tuple[DataFrame, dict]:
    """(x - median) / IQR; IQR 0 divides by 1."""
    v = nan_to_null(qcol(column), KT.dtype_of(df, column)).cast("double")
    q1, med, q3 = stats.quantiles(df, [column], [0.25, 0.5, 0.75], method=method)[column]
    if med is None:
        return _replace(df, column, v), {"center": None, "scale": 1.0}
    iqr = q3 - q1
    scale = iqr if iqr else 1.0
    return _replace(df, column, (v - F.lit(med)) / F.lit(scale)), {"center": med, "scale": scale}


def choose_scalers(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """The scaler that suits each numeric column's distribution, from its first four moments (one pass for all).

    No spread: none.  Skewed (beyond ``vocab.SCALER_SKEW``) or heavy-tailed (excess kurtosis over
    ``vocab.SCALER_TAIL``): robust, as outliers pull mean and range.  Flat (excess kurtosis under
    ``vocab.SCALER_FLAT``): minmax, as the range is the whole story.  Else standard."""
    cols = columns or KT.columns_where(df, KT.is_number)
    if not cols:
        return {}
    parts = []
    for i, c in enumerate(cols):
        v = nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double")
        parts += [F.stddev_pop(v).alias(f"s{i}"), F.skewness(v).alias(f"g{i}"), F.kurtosis(v).alias(f"k{i}")]
    row = df.agg(*parts).first()
    out = {}
    for i, c in enumerate(cols):
        sd, skew, tail = row[f"s{i}"], row[f"g{i}"], row[f"k{i}"]
        rules = ((not sd, "none"), (sd and (abs(skew) > vocab.SCALER_SKEW or tail > vocab.SCALER_TAIL), "robust"),
                 (sd and tail < vocab.SCALER_FLAT, "minmax"), (True, "standard"))
        out[c] = {"method": next(name for holds, name in rules if holds), "spread": sd, "skew": skew, "excess_kurtosis": tail}
    return out


def scale_auto(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, dict]]:
    """Scale each numeric column by the scaler chosen for it; columns without spread stay.  Returns the choices with
    the fitted parameters."""
    chosen = choose_scalers(df, columns)
    for c, found in chosen.items():
        if found["method"] != "none":
            df, fitted = _SCALES[found["method"]](df, c)
            found.update(fitted)
    return df, chosen


def normalize_all(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Min-max every numeric column with max > min (constants are left unchanged)."""
    cols = KT.columns_where(df, KT.is_number)
    if not cols:
        return df, []
    row = df.agg(*[F.struct(F.min(nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double")),
                            F.max(nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double"))).alias(f"m{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    done, exprs = [], {}
    for i, c in enumerate(cols):
        lo, hi = row[f"m{i}"]
        if lo is not None and hi is not None and hi > lo:
            v = nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double")
            exprs[c] = (v - F.lit(lo)) / F.lit(hi - lo)
            done.append(c)
    return df.select(*[exprs[c].alias(c) if c in exprs else qcol(c) for c in df.columns]), done


_SCALES = {"standard": scale_standard, "minmax": scale_minmax, "robust": scale_robust}


def _impute_value(df: DataFrame, column: str, method: str, params: dict):
    dt = KT.dtype_of(df, column)
    if method == "mean":
        v = df.agg(F.avg(nan_to_null(qcol(column), dt))).first()[0]
        return None if v is None else float(v)
    if method == "median":
        return stats.medians(df, [column])[column] if KT.is_number(dt) else None
    return stats.modes(df, [column])[column] if method == "mode" else params.get("value")


def _impute_step(df: DataFrame, s: Step) -> tuple[DataFrame, dict | None]:
    v = _impute_value(df, s.column, s.method, s.params)
    act = {"value": v}
    if s.method in ("mean", "median"):
        if v is None:
            return df, act
        return _replace(df, s.column, F.coalesce(nan_to_null(qcol(s.column), KT.dtype_of(df, s.column)).cast("double"), F.lit(float(v)))), act
    if s.method == "mode" and v is None:
        return df, None
    return missing.impute(df, s.column, "custom", v), act


def _knn_step(df: DataFrame, s: Step) -> tuple[DataFrame, dict | None]:
    """Params may name the further columns of the distance (default: all numeric ones) and k."""
    if not KT.is_number(KT.dtype_of(df, s.column)):
        return df, None
    further = s.params.get("columns") or KT.columns_where(df, KT.is_number)
    columns = [s.column, *[c for c in further if c != s.column]]
    k = int(s.params.get("k", neighbours.NEIGHBOURS))
    # the rows that fill ride along, so that a replay fills new rows from them
    donors = cut_lineage(df.select(*[qcol(c) for c in columns]))
    return neighbours.knn_impute(df, columns, [s.column], k=k, donors=donors), {"columns": columns, "k": k, "_dictionary": (donors, donors.count())}


def _scale_step(df: DataFrame, s: Step) -> tuple[DataFrame, dict]:
    if s.method == "auto":  # X5; the action names the scaler that was chosen, so a replay needs no choice
        out, chosen = scale_auto(df, [s.column])
        return out, chosen[s.column]
    return _SCALES[s.method](df, s.column)


def _encode_step(df: DataFrame, s: Step) -> tuple[DataFrame, dict]:
    if s.method == "onehot":
        out = features.one_hot(df, s.column, max_categories=None)
        return out, {"new_columns": [c for c in out.columns if c not in df.columns]}
    d = features.label_dictionary(df, s.column)
    # the fitted dictionary rides along so that a replay reuses it (not JSON: a DataFrame)
    return features.label_encode(df, s.column, d), {"_dictionary": d}


def _isolation_step(df: DataFrame, s: Step) -> tuple[DataFrame, dict]:
    """Params may name further columns and the threshold."""
    forest = isolation.fit_isolation(df, [s.column, *s.params.get("columns", [])])
    threshold = float(s.params.get("threshold", 0.6))
    return isolation.apply_isolation(df, forest, threshold, f"{s.column}_"), {"forest": forest, "threshold": threshold}


#: (action, method) -> what carries it out.
_ACTIONS = {("drop", None): lambda df, s: (df.drop(s.column), {})}
_ACTIONS |= {("impute", m): _impute_step for m in ("mean", "median", "mode", "custom")}
_ACTIONS[("impute", "knn")] = _knn_step
_ACTIONS |= {("scale", m): _scale_step for m in (*_SCALES, "auto")}
_ACTIONS |= {("encode", m): _encode_step for m in ("onehot", "label")}
_ACTIONS[("outliers", "isolation")] = _isolation_step


def apply_step(df: DataFrame, step: Step) -> tuple[DataFrame, dict | None]:
    """Apply one step; returns the frame and the action record, None where nothing was done (an unknown action or
    method, the mode of an all-missing column)."""
    action, method = step.action, step.method
    if action == "normalize":  # X6
        action, method = "scale", method or "minmax"
    method = None if action == "drop" else method or ("standard" if action == "scale" else None)
    carry_out = _ACTIONS.get((action, method))
    if carry_out is None:
        return df, None
    out, found = carry_out(df, Step(step.column, action, method, step.params or {}))
    if found is None:
        return out, None
    return out, {"column": step.column, "action": action, **({"method": method} if method else {}), **found}


def apply_steps(df: DataFrame, steps, renames: dict[str, str] | None = None, *,
                mode: str = "prepare") -> tuple[DataFrame, list[Step], list[dict]]:
    """Run steps in order; returns the frame, the steps that were skipped and the actions.

    Column names follow the C1 rename map.  A step for an unknown column is skipped; ``prepare`` mode doesn't count
    the dropping of one as skipped."""
    renames = renames or {}
    skipped, actions = [], []
    for s in map(Step.of, steps):
        s = Step(renames.get(s.column, s.column), s.action, s.method, s.params)
        if not s.column or s.column not in df.columns:
            if mode == "run" or s.action != "drop":
                skipped.append(s)
            continue
        df, act = apply_step(df, s)
        if act is not None:
            actions.append(act)
    return df, skipped, actions
