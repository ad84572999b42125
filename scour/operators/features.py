"""Feature engineering and ML-ready output: date parts (F1), log1p of skewed columns (F2),
text length and word count (F3, F4), one-hot (F5), factorize (F6), booleans to 0/1 (F7).

Decisions (skew, cardinality, categories) come from one aggregate and one
value histogram; one-hot categories are at most ``max_categories`` values, so
they are safe to collect.  Factorize codes come from an exact distributed
dictionary (``scour.functions.rank``) joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.functions import rank, stats
from scour.functions import types as KT
from scour.functions import vocab
from scour.functions.exprs import nan_to_null, put, qcol, skew_adjusted, word_count

SKIP_ROLES = {"id", "missing_indicator", "outlier_indicator"}


def date_parts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``<col>_year``, ``<col>_month``, ``<col>_day`` for each datetime column; sources kept."""
    columns = columns if columns is not None else KT.columns_where(df, KT.is_datetime)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth}
    return df.select(*put(df.columns, {f"{c}_{name}": part(qcol(c)) for c in columns for name, part in parts.items()}))


def fit_log1p(df: DataFrame, roles: dict[str, str] | None = None) -> list[str]:
    """F2 decision: numeric columns (not id/indicator) with |G1| > 1 and no negative value."""
    roles = roles or {}
    cols = [c for c in KT.columns_where(df, KT.is_number) if roles.get(c) not in SKIP_ROLES]
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(qcol(c), KT.dtype_of(df, c)).cast("double")
        aggs.append(F.struct(skew_adjusted(F.count(v), F.skewness(v)).alias("g"), F.min(v).alias("mn")).alias(f"s{i}"))
    row = df.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols):
        g, mn = row[f"s{i}"]
        if g is not None and mn is not None and abs(g) > vocab.SKEW_LIMIT and mn >= 0:
            out.append(c)
    return out


def log1p_expr(name: str, dt) -> Column:
    v = nan_to_null(qcol(name), dt).cast("double")
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(F.log1p(F.greatest(v, F.lit(0.0))))


def log1p_skewed(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """F2 one-shot: add ``<col>_log1p`` for skewed non-negative columns."""
    cols = fit_log1p(df, roles)
    return df.select(*put(df.columns, {f"{c}_log1p": log1p_expr(c, KT.dtype_of(df, c)) for c in cols}))


def text_exprs(name: str) -> dict[str, Column]:
    """length in characters and white-space word count (missing reads as 'nan')."""
    s = F.coalesce(qcol(name).cast("string"), F.lit("nan"))
    return {f"{name}_length": F.length(s).cast("bigint"), f"{name}_word_count": word_count(s).cast("bigint")}


def text_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """F3/F4 for the given text columns (appended)."""
    extra: dict[str, Column] = {}
    for c in columns:
        extra |= text_exprs(c)
    return df.select(*put(df.columns, extra))


def categories(df: DataFrame, column: str, limit: int | None = None) -> list | None:
    """Sorted distinct non-null values, or None when there are more than ``limit``."""
    found = df.select(qcol(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        return None
    return sorted(r["v"] for r in rows)


def small_categories(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """Sorted distinct values of columns already proven to hold at most ``ONE_HOT_MAX`` of them
    (so each set is bounded), in one aggregate."""
    if not cols:
        return {}
    row = df.agg(*[F.array_sort(F.collect_set(qcol(c))).alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: list(row[f"c{i}"]) for i, c in enumerate(cols)}


def one_hot_exprs(name: str, values: list) -> dict[str, Column]:
    """``<col>_<value>`` booleans in sorted value order; a missing value gives all false."""
    return {f"{name}_{v}": F.coalesce(qcol(name) == F.lit(v), F.lit(False)) for v in values}


def one_hot(df: DataFrame, column: str, max_categories: int | None = vocab.ONE_HOT_MAX,
            as_int: bool = False) -> DataFrame:
    """Replace ``column`` by one boolean column per category, appended at the end."""
    vals = categories(df, column, max_categories)
    if vals is None:
        raise ValueError(f"{column} has more than {max_categories} categories")
    ex = {n: e.cast("int") if as_int else e for n, e in one_hot_exprs(column, vals).items()}
    return df.select(*put([c for c in df.columns if c != column], ex))


def factorize(df: DataFrame, column: str, missing_code: int = -1, order_by: str | None = None) -> DataFrame:
    """codes 0..k-1 in value order - or in order of first appearance along ``order_by`` -
    with missing -> -1, computed by an exact distributed dictionary."""
    if order_by is None:
        d, size = rank.dense_dictionary(df.select(qcol(column).alias("value")))
    else:
        d, size = rank.dense_dictionary(df.select(qcol(column).alias("value"), qcol(order_by).alias("_ord")),
                                        order_col="_ord")
    return rank.join_codes(df, column, d, size, missing_code=missing_code)


def label_encode(df: DataFrame, column: str, dictionary: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Values as text (missing is the class 'nan'), codes in sorted text order.
    A fitted ``dictionary`` (from ``label_dictionary``) is reused instead of refitting."""
    as_text = F.coalesce(qcol(column).cast("string"), F.lit("nan"))
    d, size = dictionary if dictionary is not None else label_dictionary(df, column)
    return rank.join_codes(df, column, d, size, value_expr=as_text)


def label_dictionary(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The (value, code) dictionary of U9 for ``column`` (exact, distributed)."""
    as_text = F.coalesce(qcol(column).cast("string"), F.lit("nan"))
    return rank.dense_dictionary(df.select(as_text.alias("value")))


def bools_to_int(df: DataFrame) -> DataFrame:
    """boolean columns to 0/1 int."""
    return df.select(*[qcol(c).cast("int").alias(c) if KT.is_bool(KT.dtype_of(df, c)) else qcol(c)
                       for c in df.columns])


# ---------------------------------------------------------------------------
# layer fit / apply (used by the automatic run)
# ---------------------------------------------------------------------------

def fit_features(df: DataFrame, roles: dict[str, str]) -> dict:
    """Decide F1-F6 for a whole frame; ``roles`` is updated for new columns."""
    roles = dict(roles)
    dcols = KT.columns_where(df, KT.is_datetime)
    with_parts = date_parts(df, dcols)
    for c in dcols:
        for p in ("year", "month", "day"):
            roles[f"{c}_{p}"] = "numeric_feature"
    skewed = fit_log1p(with_parts, roles)
    for c in skewed:
        roles[f"{c}_log1p"] = "numeric_feature"
    text_cols = [c for c, r in roles.items() if r == "text" and c in df.columns]
    for c in text_cols:
        roles[f"{c}_length"] = "numeric_feature"
        roles[f"{c}_word_count"] = "numeric_feature"
    cat_cols = [c for c in df.columns if KT.is_string(KT.dtype_of(df, c)) and roles.get(c) != "text"]
    encoded = []
    if cat_cols:
        counts = stats.distinct_counts(df, cat_cols)
        small = [c for c in cat_cols if 1 < counts[c] <= vocab.ONE_HOT_MAX]
        cats = small_categories(df, small)
        for c in cat_cols:
            k = counts[c]
            if k <= 1:
                continue
            if k <= vocab.ONE_HOT_MAX:
                vals = cats[c]
                encoded.append({"column": c, "method": "onehot", "categories": vals,
                                "new_columns": [f"{c}_{v}" for v in vals]})
                for v in vals:
                    roles[f"{c}_{v}"] = "numeric_feature"
            else:
                encoded.append({"column": c, "method": "label", "cardinality": k})
                roles[c] = "numeric_feature"
    return {"datetime": dcols, "skewed_numeric": skewed, "text_features": text_cols,
            "categorical_encoded": encoded, "roles": roles}


def apply_features(df: DataFrame, params: dict, dictionaries: dict[str, tuple[DataFrame, int]] | None = None) -> DataFrame:
    """Apply F1-F6.  ``dictionaries`` may carry fitted factorize dictionaries (replay);
    otherwise they are built from ``df``."""
    out = date_parts(df, params["datetime"])
    out = out.select(*put(out.columns, {f"{c}_log1p": log1p_expr(c, KT.dtype_of(out, c)) for c in params["skewed_numeric"]}))
    out = text_features(out, params["text_features"])
    dictionaries = dictionaries if dictionaries is not None else {}
    for enc in params["categorical_encoded"]:
        c = enc["column"]
        if enc["method"] == "onehot":
            out = out.select(*put([x for x in out.columns if x != c], one_hot_exprs(c, enc["categories"])))
        else:
            if c not in dictionaries:
                dictionaries[c] = rank.dense_dictionary(df.select(qcol(c).alias("value")))
            d, size = dictionaries[c]
            out = rank.join_codes(out, c, d, size, missing_code=-1)
    return out
