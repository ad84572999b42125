"""Profiling: quality metrics (P1), column profile (P2-P6), dataset summary.

Each profile is a handful of aggregate jobs whose outputs hold one value per
column; the per-column results are assembled into a small DataFrame (one
row per input column), never into anything that grows with the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import stats
from scour.functions import types as KT
from scour.functions import vocab
from scour.functions.exprs import nan_to_null, qcol, skew_adjusted

QUALITY_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("non_null", T.LongType()),
    T.StructField("n_distinct", T.LongType()),
    T.StructField("completeness", T.DoubleType()),
    T.StructField("uniqueness", T.DoubleType()),
])

PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("inferred_type", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
    T.StructField("unique", T.LongType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("outliers_count", T.LongType()),
    T.StructField("skewness", T.DoubleType()),
    T.StructField("top_share", T.DoubleType()),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("suggested", T.ArrayType(T.StringType())),
])


def _counts(df: DataFrame, method: str, samples: int = 0) -> dict[str, stats.ColumnCounts]:
    cols = df.columns
    if method == "exact":
        return stats.column_counts(df, cols, samples=samples)
    # approximate distinct counts for every column; exact histogram only for text
    text = [c for c in cols if KT.kind(KT.dtype_of(df, c)) == "text"]
    exact = stats.column_counts(df, text) if text else {}
    row = df.agg(*[F.approx_count_distinct(nan_to_null(qcol(c), KT.dtype_of(df, c)), 0.01).alias(f"a{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        out[c] = exact.get(c) or stats.ColumnCounts(int(row[f"a{i}"]), 0, 0, None)
    return out


def quality_metrics(df: DataFrame, *, method: str = "exact") -> DataFrame:
    """Per column dtype, completeness = 1 - null share, uniqueness = distinct / rows."""
    spark = df.sparkSession
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(nan_to_null(qcol(c), KT.dtype_of(df, c))).alias(f"c{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    n = row["_n"]
    counts = stats.distinct_counts(df, cols) if method == "exact" else {c: v.n_distinct for c, v in _counts(df, method).items()}
    out = []
    for i, c in enumerate(cols):
        nn = row[f"c{i}"]
        nd = counts[c]
        out.append((c, i, KT.dtype_of(df, c).simpleString(), nn, nd,
                    (nn / n) if n else 1.0, nd / max(n, 1)))
    return spark.createDataFrame(out, QUALITY_SCHEMA)


def quality_summary(df: DataFrame) -> dict:
    """Row and column counts plus the per-column metrics as plain Python."""
    q = quality_metrics(df).collect()
    rows = df.count()
    return {"rows": rows, "columns": len(df.columns),
            "per_column": {r["column"]: {"dtype": r["dtype"], "completeness": r["completeness"],
                                         "uniqueness": r["uniqueness"]} for r in q}}


def _samples(df: DataFrame, cols: list[str], k: int, order_by: str | None) -> dict[str, list[str]]:
    """First ``k`` non-null values per column in ``order_by`` order (default: value order).

    Uses a row_number filter that Spark turns into a per-partition group limit,
    so each map task ships at most ``k`` rows per column.
    """
    if not cols or k <= 0:
        return {}
    items = []
    for i, c in enumerate(cols):
        dt = KT.dtype_of(df, c)
        v = nan_to_null(qcol(c), dt)
        items.append(F.struct(F.lit(i).alias("cid"), v.cast("string").alias("s"),
                              stats._slot(c, dt).alias("v")))
    if order_by:
        exploded = df.select(qcol(order_by).alias("_k"), F.inline(F.array(*items)))
        order = [F.col("_k"), F.col("v")]
    else:
        exploded = df.select(F.inline(F.array(*items)))
        order = [F.col("v")]
    exploded = exploded.where(F.col("s").isNotNull())
    w = Window.partitionBy("cid").orderBy(*order)
    top = exploded.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    rows = top.select("cid", "rn", "s").collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in sorted(rows, key=lambda r: (r["cid"], r["rn"])):
        out[cols[r["cid"]]].append(r["s"])
    return out


def profile(df: DataFrame, *, method: str = "exact", sample_size: int = 5,
            order_by: str | None = None) -> DataFrame:
    """One row per column with type, missing share, distinct count, samples,
    numeric summary (min, max, mean, median, std, IQR outliers, skew) and the
    issue / suggestion rules."""
    spark = df.sparkSession
    cols = df.columns
    dts = {c: KT.dtype_of(df, c) for c in cols}
    numeric = [c for c in cols if KT.is_number(dts[c])]

    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        v = nan_to_null(qcol(c), dts[c])
        aggs.append(F.count(v).alias(f"c{i}"))
        if c in numeric:
            d = v.cast("double")
            aggs += [F.min(d).alias(f"mn{i}"), F.max(d).alias(f"mx{i}"), F.avg(d).alias(f"av{i}"),
                     F.stddev_samp(d).alias(f"sd{i}"),
                     skew_adjusted(F.count(d), F.skewness(d)).alias(f"sk{i}")]
    base = df.agg(*aggs).collect()[0]
    n = base["_n"]
    nonnull = {c: base[f"c{i}"] for i, c in enumerate(cols)}

    probs = [0.25, 0.5, 0.75]
    qs = stats.quantiles(df, numeric, probs, method=method, known={c: nonnull[c] for c in numeric})
    if order_by is None and method == "exact":
        counts = _counts(df, method, samples=sample_size)
        samples = {c: [None if v is None else str(v) for v in (counts[c].samples or [])] for c in cols}
    else:
        counts = _counts(df, method)
        samples = _samples(df, cols, sample_size, order_by)
    fences = {}
    for c in numeric:
        q1, _, q3 = qs[c]
        if q1 is not None:
            iqr = q3 - q1
            fences[c] = (q1 - vocab.IQR_FACTOR * iqr, q3 + vocab.IQR_FACTOR * iqr)
    outliers = {}
    if fences:
        row = df.agg(*[F.count_if((nan_to_null(qcol(c), dts[c]) < F.lit(lo)) |
                                  (nan_to_null(qcol(c), dts[c]) > F.lit(hi))).alias(f"o{i}")
                       for i, (c, (lo, hi)) in enumerate(fences.items())]).collect()[0]
        outliers = {c: row[f"o{i}"] for i, c in enumerate(fences)}

    out = []
    for i, c in enumerate(cols):
        dt = dts[c]
        kind = KT.kind(dt)
        inferred = "numeric" if kind == "numeric" else ("datetime" if kind == "datetime" else "text")
        missing = n - nonnull[c]
        pct = (missing / n * 100.0) if n else 0.0
        issues, suggested = [], []
        if pct > 0:
            issues.append("missing")
            suggested.append("impute_median" if inferred == "numeric" else "impute_mode")
        cc = counts[c]
        rec = dict(column=c, position=i, inferred_type=inferred, dtype=dt.simpleString(), rows=n,
                   missing=missing, missing_pct=pct, unique=cc.n_distinct, sample_values=samples.get(c, []),
                   min=None, max=None, mean=None, median=None, std=None, q1=None, q3=None,
                   outliers_count=None, skewness=None, top_share=None, issues=issues, suggested=suggested)
        if c in numeric:
            q1, q2, q3 = qs[c]
            rec.update(min=base[f"mn{i}"], max=base[f"mx{i}"], mean=base[f"av{i}"],
                       median=q2, std=base[f"sd{i}"], q1=q1, q3=q3,
                       outliers_count=outliers.get(c, 0))
            if rec["outliers_count"]:
                issues.append("outliers")
                suggested.append("robust_scale")
            g1 = base[f"sk{i}"]
            if g1 is not None and abs(g1) > vocab.SKEW_LIMIT:
                issues.append("skewed")
                rec["skewness"] = g1
        elif inferred == "text":
            k = cc.n_distinct
            if cc.n_values:
                rec["top_share"] = cc.top_cnt / cc.n_values
            if 0 < k < 50 and cc.n_values and cc.top_cnt / cc.n_values > 0.8:
                issues.append("imbalanced")
            if 1 < k < 20:
                suggested.append("encode")
        out.append(tuple(rec[f.name] for f in PROFILE_SCHEMA.fields))
    return spark.createDataFrame(out, PROFILE_SCHEMA)


def numeric_summary(df: DataFrame, **kw) -> DataFrame:
    """P3/P4 only: the numeric rows of ``profile``."""
    return profile(df, **kw).where(F.col("inferred_type") == "numeric")


def recommend(profile_df: DataFrame) -> DataFrame:
    """P6 as a DataFrame function: issues and suggestions from profile columns alone."""
    miss = F.col("missing_pct") > 0
    num = F.col("inferred_type") == "numeric"
    text = F.col("inferred_type") == "text"
    k = F.col("unique")
    issues = F.array_compact(F.array(
        F.when(miss, F.lit("missing")),
        F.when(num & (F.col("outliers_count") > 0), F.lit("outliers")),
        F.when(num & (F.abs(F.col("skewness")) > vocab.SKEW_LIMIT), F.lit("skewed")),
        F.when(text & (k > 0) & (k < 50) & (F.col("top_share") > 0.8), F.lit("imbalanced")),
    ))
    suggested = F.array_compact(F.array(
        F.when(miss, F.when(num, F.lit("impute_median")).otherwise(F.lit("impute_mode"))),
        F.when(num & (F.col("outliers_count") > 0), F.lit("robust_scale")),
        F.when(text & (k > 1) & (k < 20), F.lit("encode")),
    ))
    return profile_df.select("column", issues.alias("issues"), suggested.alias("suggested"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, total missing cells, overall missing percentage (one aggregate)."""
    cols = df.columns
    n = F.count(F.lit(1))
    missing = [F.count_if(nan_to_null(qcol(c), KT.dtype_of(df, c)).isNull()) for c in cols]
    total = missing[0] if len(missing) == 1 else sum(missing[1:], missing[0]) if missing else F.lit(0)
    ncols = len(cols)
    return df.agg(
        n.alias("rows"),
        F.lit(ncols).cast("bigint").alias("columns"),
        total.cast("bigint").alias("missing_cells"),
        (total / F.greatest(n * F.lit(ncols), F.lit(1)) * 100.0).alias("missing_pct"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """P7 per-column part: (column, dtype kind, missing count) by one aggregate and an unpivot."""
    cols = df.columns
    structs = [F.struct(F.lit(c).alias("column"), F.lit(KT.kind(KT.dtype_of(df, c))).alias("kind"),
                        F.count_if(nan_to_null(qcol(c), KT.dtype_of(df, c)).isNull()).alias("missing"))
               for c in cols]
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a"))
