"""Compositions: the seven-layer automatic run (R1), prepare (R2), auto-clean (R3) and
the five run modes (R4).

Each layer fits on the frame left by the previous one (a few aggregate jobs)
and applies lazily.  Three points materialise to the reliable checkpoint
folder: after the semantic layer (so the text parsing is not redone by every
later fit), after deduplication (the one shuffle of whole rows) and the
ML-ready result (read again by the metrics and any later stage).
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.functions import types as KT
from scour.operators import consistency, features, missing, outliers, profile, schema, semantic, splits, steps
from scour.plans import decisions
from scour.plans.recipe import Recipe
from scour.session import cut_lineage


def auto_layers(df: DataFrame, *, method: str = "exact", materialize: bool = True,
                metrics: bool = True) -> tuple[DataFrame, Recipe]:
    """Schema -> semantic -> missing -> outliers -> consistency -> features -> ML-ready.

    Returns the cleaned frame and the fitted recipe (parameters, roles, log,
    before/after quality metrics).
    """
    r = Recipe()
    clock = _Clock(r)
    raw_cols = list(df.columns)

    # schema (its two jobs also give the row count and the raw quality metrics)
    renames = schema.fit_names(df.columns)
    r.add("names", {"renamed": renames})
    df = schema.apply_names(df, renames)
    sp = schema.fit_schema(df, quality=metrics)
    rows, ncols = sp.pop("rows"), len(raw_cols)
    quality = sp.pop("quality", {})
    r.stats["raw_data"] = {"rows": rows, "columns": raw_cols}
    if metrics:
        inv = {v: k for k, v in renames.items()}
        r.stats["quality_metrics"] = {inv.get(c, c): m for c, m in quality.items()}
    r.decide("raw", "rows", rows)
    r.decide("raw", "columns", ncols)
    r.add("schema", sp)
    roles = dict(sp["roles"])
    df = schema.apply_schema(df, sp)

    clock("schema")
    # semantic
    sem = semantic.fit_semantic(df, roles)
    r.add("semantic", sem)
    df = semantic.apply_semantic(df, sem)
    if materialize:
        df = cut_lineage(df)

    clock("semantic")
    # missing data
    mp = missing.fit_missing(df, roles, method=method)
    r.add("missing", mp)
    df = missing.apply_missing(df, mp)
    for c in mp["indicator_columns"]:
        roles[c] = "missing_indicator"

    clock("missing")
    # outliers
    op = outliers.fit_outliers(df, roles, method=method)
    r.add("outliers", op)
    df = outliers.apply_outliers(df, op)
    for a in op["actions"]:
        if a.get("flag_column"):
            roles[a["flag_column"]] = "outlier_indicator"

    clock("outliers")
    # consistency
    if materialize:
        # whole rows are shuffled once: the counts and the repairs both read the distinct rows
        df = cut_lineage(consistency.drop_exact_duplicates(df))
        cp = consistency.fit_consistency(df, roles, dedup=False)
        cp |= {"dedup": True, "duplicates_removed": rows - cp["rows"]}
        r.add("consistency", cp)
        df = consistency.apply_consistency(df, dict(cp, dedup=False))
    else:
        cp = consistency.fit_consistency(df, roles, rows_before=rows)
        r.add("consistency", cp)
        df = consistency.apply_consistency(df, cp)

    clock("consistency")
    # features
    fp = features.fit_features(df, roles)
    roles = fp.pop("roles")
    r.add("features", fp)
    for enc in fp["categorical_encoded"]:
        if enc["method"] == "label":
            from scour.functions import rank
            r.dictionaries[enc["column"]] = rank.dense_dictionary(df.select(F.col(f"`{enc['column']}`").alias("value")))
    df = features.apply_features(df, fp, dict(r.dictionaries))

    clock("features")
    # ML-ready
    rp = missing.fit_residual(df, method=method)
    r.add("residual", rp)
    df = missing.apply_missing(df, rp, indicators=False)
    bool_cols = KT.columns_where(df, KT.is_bool)
    r.add("bools", {"columns": bool_cols})
    df = features.bools_to_int(df)
    if materialize:
        # the result is read again by the quality metrics and by every later stage
        df = cut_lineage(df)
    rows2, ncols2 = cp["rows"], len(df.columns)
    r.stats["ml_ready"] = {"total_features": ncols2, "rows": rows2, "bool_columns_encoded": bool_cols}
    r.decide("ml_ready", "rows", rows2)
    r.decide("ml_ready", "columns", ncols2)
    if metrics:
        r.stats["post_quality_metrics"] = _metrics(df)
    clock("ml_ready")
    r.roles = roles
    return df, r


class _Clock:
    """Wall time of each layer's fit (P8 run statistics)."""

    def __init__(self, r: Recipe):
        import time
        self._time = time.time
        self._t = time.time()
        self._r = r
        r.stats["fit_seconds"] = {}

    def __call__(self, layer: str) -> None:
        now = self._time()
        self._r.stats["fit_seconds"][layer] = round(now - self._t, 3)
        self._t = now


def _metrics(df: DataFrame) -> dict:
    q = profile.quality_metrics(df).collect()
    return {r["column"]: {"dtype": r["dtype"], "completeness": r["completeness"], "uniqueness": r["uniqueness"]}
            for r in q}


def prepare(df: DataFrame, step_list, **kw) -> tuple[DataFrame, Recipe]:
    """R2: the automatic run, then the manual steps (names follow the rename map);
    residual fill and booleans-to-int run again when a step did something."""
    out, r = auto_layers(df, **kw)
    renames = r.params("names")["renamed"]
    out, skipped, actions = steps.apply_steps(out, step_list, renames, mode="prepare")
    for s in skipped:
        r.decide("manual", "skipped", column=s.column, detail=s.action)
    if actions:
        for a in actions:
            if "_dictionary" in a:
                r.dictionaries[f"step:{a['column']}"] = a.pop("_dictionary")
        r.add("steps", {"actions": actions})
        rp = missing.fit_residual(out)
        r.add("residual", rp)
        out = features.bools_to_int(missing.apply_missing(out, rp, indicators=False))
        r.add("bools", {})
    return out, r


def auto_clean(df: DataFrame, *, split_percent: float | None = 80.0, impute_missing: bool = True,
               remove_outliers: bool = True, normalize_features: bool = True, on_error: str = "raise",
               seed: int = 42, key=None, method: str = "exact") -> tuple[DataFrame, Recipe]:
    """Automatic run (or basic cleaning only if it fails and ``on_error='basic'``), then
    basic fill (I7), blanket IQR clip (O5), min-max of every numeric column (N1) and a
    percent split (D-2).  The result carries a ``split`` column when splitting."""
    raw = df
    try:
        df, r = auto_layers(df, method=method)
    except Exception as e:  # noqa: BLE001 - the caller chose the fallback
        if on_error != "basic":
            raise
        df, r = raw, Recipe()
        r.decide("auto_clean", "layers_failed", detail=type(e).__name__)
    known: dict = {}
    if impute_missing:
        bp = missing.fit_basic(df, method=method, known=known)
        r.add("basic_impute", bp)
        df = missing.apply_missing(df, bp, indicators=False)
    extremes = None
    if remove_outliers:
        # counts and sketches from the fill pass serve the quartiles when nothing was filled
        reuse = known if impute_missing and not bp["imputations"] else None
        cp = outliers.fit_clip_all(df, method=method, known=reuse)
        extremes = cp.pop("extremes")
        r.add("clip_all", cp)
        df = outliers.apply_outliers(df, cp, flags=False)
        r.decide("auto_clean", "values_clipped", cp["clipped"])
    if normalize_features:
        cols = KT.columns_where(df, KT.is_number)
        if cols:
            if extremes is None:
                row = df.agg(*[F.struct(F.min(F.col(f"`{c}`").cast("double")), F.max(F.col(f"`{c}`").cast("double")))
                               .alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
                extremes = {c: tuple(row[f"m{i}"]) for i, c in enumerate(cols)}
            sc = {c: extremes[c] for c in cols
                  if extremes.get(c) and extremes[c][0] is not None and extremes[c][1] > extremes[c][0]}
            r.add("normalize_all", {"columns": sc})
            from scour.plans.recipe import _apply_minmax
            df = _apply_minmax(df, {"columns": sc})
    # imputing, clipping and scaling keep every row: the count is the one the layers measured
    n = r.stats.get("ml_ready", {}).get("rows")
    if n is None:
        n = df.count()
    r.decide("auto_clean", "rows", n)
    r.decide("auto_clean", "columns", len(df.columns))
    if split_percent:
        r.decide("auto_clean", "train_percent", split_percent)
        df = splits.percent_split(df, split_percent, seed=seed, key=key)
    return df, r


MODES = ("clean_only", "split", "clean_and_split", "cross_validation", "clean_and_cv")


def run_mode(df: DataFrame, mode: str, *, step_list=None, test_size: float = 0.2, n_folds: int = 5,
             shuffle: bool = True, seed: int = 42, key=None) -> tuple[DataFrame, dict]:
    """One of the five run modes.  Manual steps (``run`` mode) precede splitting.

    Returns the frame (with ``split`` or ``fold`` when the mode splits) and metadata: rows and columns per output, the
    actions of the steps with their log, the steps that were skipped, and the dictionaries of label encodings.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    rows_before = df.count()
    if rows_before == 0:
        raise ValueError("the input has no rows")
    meta = {"operation": mode, "rows_before": rows_before}
    if mode in ("clean_only", "clean_and_split", "clean_and_cv") and step_list:
        df, skipped, actions = steps.apply_steps(df, step_list, mode="run")
        meta["skipped_steps"] = [s.to_dict() for s in skipped]
        meta["dictionaries"] = {a["column"]: a.pop("_dictionary") for a in actions if "_dictionary" in a}
        meta["actions"] = actions
        meta["log"] = [d.text() for d in decisions.expand("steps", {"actions": actions})]
        # no step drops a row
        meta["rows_after_cleaning"] = rows_before
    if mode in ("split", "clean_and_split"):
        df = splits.train_test_split(df, test_size, shuffle=shuffle, seed=seed, key=key)
        meta["split_type"] = "train_test"
        meta["rows_per_output"] = {r["split"]: r["rows"] for r in splits.split_counts(df).collect()}
    elif mode in ("cross_validation", "clean_and_cv"):
        df = splits.kfold(df, n_folds, shuffle=shuffle, seed=seed, key=key)
        meta["split_type"] = "kfold"
        counts = {r["fold"]: r["rows"] for r in splits.split_counts(df, "fold").collect()}
        total = sum(counts.values())
        meta["rows_per_fold"] = {f"fold_{i}": {"train": total - counts.get(i, 0), "val": counts.get(i, 0)}
                                 for i in range(1, n_folds + 1)}
    meta["columns"] = [c for c in df.columns if c not in ("split", "fold")]
    return df, meta
