"""

Every query reads the given parquet tables (or the DIRTY view Spark derives
from ``orders``) in full.  Doubles are rounded to 6 places on both sides so
that summation order cannot flip a hash.
"""

from __future__ import annotations

import functools
import math
import os
import sys
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from scour.session import compiled_only  # noqa: E402
from scour.sources.fixtures import dirty, dirty_cte  # noqa: E402
from scour.sources.tables import table  # noqa: E402

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf):
            compiled_only(spark)
            return fn(spark, sf)
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both sides of the oracle compare do this)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- tables and column lists used by several oracle queries -----------------
DIRTY_COLS = [
    ("o_orderkey", "bigint"), ("order_amount", "string"), ("placed_on", "string"),
    ("is_urgent", "string"), ("gift_flag", "string"), ("gender", "string"), ("priority", "string"),
    ("promo_value", "double"), ("visits", "double"), ("ticket", "string"), ("order_notes", "string"),
    ("channel", "string"), ("ship_start", "date"), ("ship_end", "date"), ("margin_percent", "double"),
    ("buyer_age", "double"),
]
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


# =============================================================================
# Profiling
# =============================================================================

_Q_QUALITY = dirty_cte() + "\n" + _union([
    f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, count({c}) AS non_null, "
    f"count(DISTINCT {c}) AS n_distinct, round(count({c}) / count(*), 6) AS completeness, "
    f"round(count(DISTINCT {c}) / count(*), 6) AS uniqueness FROM dirty"
    for i, (c, t) in enumerate(DIRTY_COLS)])


@_query("quality_metrics", _Q_QUALITY)
def q_quality_metrics(spark, sf):
    from scour.operators.profile import quality_metrics
    return _round(quality_metrics(dirty(spark, sf)))


_Q_NUMPROF = _union([
    f"""SELECT '{c}' AS "column", round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct,
       count(DISTINCT {c}) AS "unique", round(min({c}), 6) AS "min", round(max({c}), 6) AS "max",
       round(avg({c}), 5) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std,
       round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3,
       (SELECT count(*) FROM lineitem x, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) q
         WHERE x.{c} < q.a - 1.5 * (q.b - q.a) OR x.{c} > q.b + 1.5 * (q.b - q.a)) AS outliers_count,
       round(CASE WHEN abs(skewness({c})) > 1 THEN skewness({c}) END, 6) AS skewness
FROM lineitem""" for c in LINEITEM_NUM])


@_query("numeric_profile", _Q_NUMPROF)
def q_numeric_profile(spark, sf):
    from scour.operators.profile import profile
    p = profile(table(spark, sf, "lineitem").select(*LINEITEM_NUM))
    # the mean of 2-decimal prices can sit exactly on a 6th-digit tie: compare it at 5
    return _round(p.select("column", "missing_pct", "unique", "min", "max", F.round("mean", 5).alias("mean"),
                           "median", "std", "q1", "q3", "outliers_count", "skewness"))


_Q_TEXTPROF = _union([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique",
       round(max(cnt) / sum(cnt), 6) AS top_share,
       (count(DISTINCT {c}) BETWEEN 1 AND 49 AND max(cnt) / sum(cnt) > 0.8) AS imbalanced,
       (count(DISTINCT {c}) BETWEEN 2 AND 19) AS suggest_encode
FROM (SELECT {c}, count(*) AS cnt FROM part GROUP BY {c})""" for c in ["p_name", "p_brand", "p_type"]])


@_query("text_profile", _Q_TEXTPROF)
def q_text_profile(spark, sf):
    from scour.operators.profile import profile
    p = profile(table(spark, sf, "part").select("p_name", "p_brand", "p_type"))
    return _round(p.select("column", "unique", "top_share",
                           F.array_contains("issues", "imbalanced").alias("imbalanced"),
                           F.array_contains("suggested", "encode").alias("suggest_encode")))


_Q_SUMMARY = dirty_cte() + "\nSELECT count(*) AS rows, CAST(16 AS BIGINT) AS columns, CAST(" + " + ".join(
    f"count(*) - count({c})" for c, _ in DIRTY_COLS) + " AS BIGINT) AS missing_cells, round(100.0 * (" + " + ".join(
    f"count(*) - count({c})" for c, _ in DIRTY_COLS) + ") / (count(*) * 16), 6) AS missing_pct FROM dirty"


@_query("dataset_summary", _Q_SUMMARY)
def q_dataset_summary(spark, sf):
    from scour.operators.profile import dataset_summary
    return _round(dataset_summary(dirty(spark, sf)))


def _kind(t):
    return {"bigint": "numeric", "double": "numeric", "string": "text", "date": "datetime"}[t]


_Q_MISSCOL = dirty_cte() + "\n" + _union([
    f"SELECT '{c}' AS \"column\", '{_kind(t)}' AS kind, count(*) - count({c}) AS missing FROM dirty"
    for c, t in DIRTY_COLS])


@_query("missing_by_column", _Q_MISSCOL)
def q_missing_by_column(spark, sf):
    from scour.operators.profile import missing_by_column
    return missing_by_column(dirty(spark, sf))


# =============================================================================
# Schema and semantic layers
# =============================================================================

def _d_strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _d_numeric(x):
    s = _d_strip(x)
    s = f"regexp_replace({s}, '[$€£¥₹,]', '', 'g')"
    s = f"regexp_replace({s}, '\\s', '', 'g')"
    s = f"regexp_replace({s}, '[^0-9.\\-]', '', 'g')"
    return f"(CASE WHEN {s} IN ('', '-', '.') THEN NULL ELSE TRY_CAST({s} AS DOUBLE) END)"


MESSY_ORDERS = [("o_orderkey", " O OrderKey "), ("o_custkey", "o-custkey"), ("o_orderstatus", "O__OrderStatus!"),
                ("o_totalprice", "O_TotalPrice"), ("o_orderdate", "o totalprice"), ("o_orderpriority", "%%")]
CLEAN_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_totalprice_1", "col"]


@_query("normalize_names", "SELECT " + ", ".join(
        f"{src} AS {dst}" for (src, _), dst in zip(MESSY_ORDERS, CLEAN_ORDERS)) + " FROM orders")
def q_normalize_names(spark, sf):
    from scour.operators.schema import normalize_names
    o = table(spark, sf, "orders")
    messy = o.select(*[F.col(src).alias(m) for src, m in MESSY_ORDERS])
    return normalize_names(messy)[0]


def _schema_role_sql():
    fmts = [("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
            ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"), ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"),
            ("MM/dd/yyyy", "%m/%d/%Y"), ("dd.MM.yyyy", "%d.%m.%Y")]
    parts = []
    for i, (c, t) in enumerate(DIRTY_COLS):
        if t != "string":
            fam = _kind(t)
            if fam == "datetime":
                role = "'datetime_feature'"
            else:
                role = ("CASE WHEN count(DISTINCT {c}) / count(*) > 0.85 THEN 'numeric_key' "
                        "ELSE 'numeric_feature' END").format(c=c)
            if any(k in c.lower() for k in ("description", "notes", "comment", "text", "summary", "review")):
                role = "'text'"
            parts.append(f"SELECT '{c}' AS \"column\", 'keep' AS conversion, {role} AS role FROM dirty "
                         f"HAVING count(*) > 0")
            continue
        dt_counts = ", ".join(f"count(try_strptime({_d_strip(c)}, '{py}')) AS f{k}" for k, (_, py) in enumerate(fmts))
        best = "greatest(" + ", ".join(f"f{k}" for k in range(len(fmts))) + ")"
        fmt_pick = "CASE " + " ".join("WHEN f{} = {} THEN '{}'".format(k, best, sp.replace("'", "''"))
                                      for k, (sp, _) in enumerate(fmts)) + " END"
        texty = any(k in c.lower() for k in ("description", "notes", "comment", "text", "summary", "review"))
        role_trim = ("'text'" if texty else
                     "CASE WHEN mean_len > 40 THEN 'text' WHEN dist / n > 0.5 THEN 'categorical_high_cardinality' "
                     "ELSE 'categorical_feature' END")
        parts.append(f"""SELECT '{c}' AS "column",
  CASE WHEN is_id THEN 'id' WHEN num / n >= 0.8 THEN 'numeric' WHEN {best} / n >= 0.6 THEN 'datetime:' || {fmt_pick}
       WHEN bools / n >= 0.9 THEN 'boolean' ELSE 'trim' END AS conversion,
  CASE WHEN is_id THEN 'id' WHEN num / n >= 0.8 THEN 'numeric_feature' WHEN {best} / n >= 0.6 THEN 'datetime_feature'
       WHEN bools / n >= 0.9 THEN 'numeric_feature' ELSE {role_trim} END AS role
FROM (SELECT count(*) AS n,
  (count({c}) > 0 AND count(*) FILTER (WHERE regexp_full_match({c}, '[0-9]+')) / count({c}) >= 0.9
   AND count(DISTINCT {c}) / count({c}) >= 0.9 AND coalesce(bool_or(starts_with({c}, '0')), false)) AS is_id,
  count({_d_numeric(c)}) AS num,
  count(*) FILTER (WHERE lower({_d_strip(c)}) IN ('true', 'yes', 'y', '1', 'false', 'no', 'n', '0')) AS bools,
  count(DISTINCT {_d_strip(c)}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS dist,
  (coalesce(sum(length({_d_strip(c)})), 0) + 3 * (count(*) - count({c}))) / count(*) AS mean_len,
  {dt_counts}
  FROM dirty)""")
    return dirty_cte() + "\n" + _union(parts)


@_query("schema_roles", _schema_role_sql())
def q_schema_roles(spark, sf):
    from scour.operators.schema import fit_schema
    d = dirty(spark, sf)
    p = fit_schema(d)
    rows = []
    for c in d.columns:
        conv = p["conversions"].get(c)
        if conv is None:
            name = "keep"
        elif conv["to"] == "datetime":
            name = "datetime:" + conv["format"]
        else:
            name = conv["to"]
        rows.append((c, name, p["roles"][c]))
    # decisions are per column; join them back to the data's own column list
    meta = spark.createDataFrame(rows, "column string, conversion string, role string")
    return meta


_COERCED_SQL = dirty_cte() + f"""
SELECT o_orderkey, {_d_numeric('order_amount')} AS order_amount,
  CAST(try_strptime({_d_strip('placed_on')}, '%Y-%m-%d') AS TIMESTAMP) AS placed_on,
  CASE WHEN is_urgent IS NULL THEN NULL WHEN lower({_d_strip('is_urgent')}) IN ('true', 'yes', 'y', '1') THEN 1 ELSE 0 END AS is_urgent,
  {_d_strip('gift_flag')} AS gift_flag, {_d_strip('gender')} AS gender, {_d_strip('priority')} AS priority,
  promo_value, visits, ticket, {_d_strip('order_notes')} AS order_notes, {_d_strip('channel')} AS channel,
  ship_start, ship_end, margin_percent, buyer_age
FROM dirty"""


@_query("coerce_types", _COERCED_SQL)
def q_coerce_types(spark, sf):
    from scour.operators.schema import apply_schema, fit_schema
    d = dirty(spark, sf)
    return _round(apply_schema(d, fit_schema(d)))


def _d_masked(x):
    s = _d_strip(x)
    return (f"(CASE WHEN lower({s}) IN ('na', 'n/a', 'none', 'null', '?', 'unknown', 'nan', '', 'not available') "
            f"THEN NULL ELSE {s} END)")


_SEMANTIC_SQL = dirty_cte() + f"""
SELECT o_orderkey, {_d_numeric('order_amount')} AS order_amount,
  CAST(try_strptime({_d_strip('placed_on')}, '%Y-%m-%d') AS TIMESTAMP) AS placed_on,
  CASE WHEN is_urgent IS NULL THEN NULL WHEN lower({_d_strip('is_urgent')}) IN ('true', 'yes', 'y', '1') THEN 1 ELSE 0 END AS is_urgent,
  CASE WHEN {_d_masked('gift_flag')} IS NULL THEN NULL
       WHEN lower({_d_strip('gift_flag')}) IN ('true', 'yes', 'y', '1', 't') THEN 'yes'
       WHEN lower({_d_strip('gift_flag')}) IN ('false', 'no', 'n', '0', 'f') THEN 'no'
       ELSE lower({_d_strip('gift_flag')}) END AS gift_flag,
  CASE lower({_d_masked('gender')}) WHEN 'm' THEN 'male' WHEN 'male' THEN 'male' WHEN 'f' THEN 'female'
       WHEN 'female' THEN 'female' WHEN 'woman' THEN 'female' WHEN 'man' THEN 'male' WHEN 'other' THEN 'other'
       WHEN 'non-binary' THEN 'non_binary' ELSE lower({_d_masked('gender')}) END AS gender,
  regexp_replace({_d_masked('priority')}, '\\s+', ' ', 'g') AS priority,
  promo_value, visits, {_d_masked('ticket')} AS ticket,
  regexp_replace({_d_masked('order_notes')}, '\\s+', ' ', 'g') AS order_notes, {_d_masked('channel')} AS channel,
  ship_start, ship_end, margin_percent, buyer_age
FROM dirty"""


@_query("semantic_clean", _SEMANTIC_SQL)
def q_semantic_clean(spark, sf):
    from scour.operators.schema import apply_schema, fit_schema
    from scour.operators.semantic import apply_semantic, fit_semantic
    d = dirty(spark, sf)
    sp = fit_schema(d)
    typed = apply_schema(d, sp)
    return _round(apply_semantic(typed, fit_semantic(typed, sp["roles"])))


@_query("null_tokens", dirty_cte() + f"\nSELECT o_orderkey, {_d_masked('gift_flag')} AS gift_flag, "
        f"{_d_masked('gender')} AS gender, {_d_masked('order_amount')} AS order_amount FROM dirty")
def q_null_tokens(spark, sf):
    from scour.operators.semantic import null_tokens
    return null_tokens(dirty(spark, sf).select("o_orderkey", "gift_flag", "gender", "order_amount"))


@_query("collapse_whitespace", dirty_cte() + "\nSELECT o_orderkey, regexp_replace(priority, '\\s+', ' ', 'g') AS priority, "
        "regexp_replace(order_notes, '\\s+', ' ', 'g') AS order_notes, gender FROM dirty")
def q_collapse_whitespace(spark, sf):
    from scour.operators.semantic import collapse_whitespace
    return collapse_whitespace(dirty(spark, sf).select("o_orderkey", "priority", "order_notes", "gender"))


@_query("trim_strings", dirty_cte() + f"\nSELECT o_orderkey, {_d_strip('priority')} AS priority, "
        f"{_d_strip('gender')} AS gender, {_d_strip('is_urgent')} AS is_urgent FROM dirty")
def q_trim_strings(spark, sf):
    from scour.operators.schema import trim_strings
    return trim_strings(dirty(spark, sf).select("o_orderkey", "priority", "gender", "is_urgent"))


@_query("canonical_gender", dirty_cte() + f"""
SELECT o_orderkey, CASE lower({_d_strip('gender')}) WHEN 'm' THEN 'male' WHEN 'male' THEN 'male' WHEN 'f' THEN 'female'
       WHEN 'female' THEN 'female' WHEN 'woman' THEN 'female' WHEN 'man' THEN 'male' WHEN 'other' THEN 'other'
       WHEN 'non-binary' THEN 'non_binary' ELSE lower({_d_strip('gender')}) END AS gender FROM dirty""")
def q_canonical_gender(spark, sf):
    from scour.operators.semantic import canonicalize
    return canonicalize(dirty(spark, sf).select("o_orderkey", "gender"), "gender", "gender")


@_query("canonical_boolean", dirty_cte() + f"""
SELECT o_orderkey, CASE WHEN lower({_d_strip('gift_flag')}) IN ('true', 'yes', 'y', '1', 't') THEN 'yes'
       WHEN lower({_d_strip('gift_flag')}) IN ('false', 'no', 'n', '0', 'f') THEN 'no'
       ELSE lower({_d_strip('gift_flag')}) END AS gift_flag FROM dirty""")
def q_canonical_boolean(spark, sf):
    from scour.operators.semantic import canonicalize
    return canonicalize(dirty(spark, sf).select("o_orderkey", "gift_flag"), "gift_flag", "boolean")


@_query("drop_timezone", "SELECT event_id, ts, ts AS instant FROM events")
def q_drop_timezone(spark, sf):
    from scour.operators.semantic import drop_timezone, wall_clock_text
    e = table(spark, sf, "events")
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789+02:00"))
    return drop_timezone(e.select("event_id", wall_clock_text(zoned).alias("ts"), F.col("ts").cast("timestamp").alias("instant")), ["instant"])


@_query("detect_ids", dirty_cte() + """
SELECT c AS "column" FROM (
  SELECT 'ticket' AS c, count(*) FILTER (WHERE regexp_full_match(ticket, '[0-9]+')) / count(ticket) >= 0.9
         AND count(DISTINCT ticket) / count(ticket) >= 0.9 AND bool_or(starts_with(ticket, '0')) AS hit FROM dirty
  UNION ALL
  SELECT 'o_custkey_text', count(*) FILTER (WHERE regexp_full_match(k, '[0-9]+')) / count(k) >= 0.9
         AND count(DISTINCT k) / count(k) >= 0.9 AND bool_or(starts_with(k, '0'))
  FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS k FROM orders)
  UNION ALL
  SELECT 'order_key_text', count(*) FILTER (WHERE regexp_full_match(k, '[0-9]+')) / count(k) >= 0.9
         AND count(DISTINCT k) / count(k) >= 0.9 AND bool_or(starts_with(k, '0'))
  FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS k FROM orders)) WHERE hit""")
def q_detect_ids(spark, sf):
    from scour.operators.schema import detect_ids
    d = dirty(spark, sf).select("ticket", "priority")
    o = table(spark, sf, "orders")
    ids = detect_ids(d)
    ids += detect_ids(o.select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("o_custkey_text")))
    ids += detect_ids(o.select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("order_key_text")))
    return spark.createDataFrame([(c,) for c in ids], "column string")


# =============================================================================
# Missing data
# =============================================================================

DIRTY_ALL = ", ".join(c for c, _ in DIRTY_COLS)


@_query("drop_sparse", dirty_cte() + "\nSELECT " + ", ".join(c for c, _ in DIRTY_COLS if c != "promo_value")
        + " FROM dirty")
def q_drop_sparse(spark, sf):
    from scour.operators.missing import drop_sparse
    return _round(drop_sparse(dirty(spark, sf)))


@_query("missing_indicators", dirty_cte() + """
SELECT o_orderkey, order_amount, promo_value, visits,
  CAST(order_amount IS NULL AS INTEGER) AS order_amount_was_missing,
  CAST(promo_value IS NULL AS INTEGER) AS promo_value_was_missing,
  CAST(visits IS NULL AS INTEGER) AS visits_was_missing FROM dirty""")
def q_missing_indicators(spark, sf):
    from scour.operators.missing import missing_indicators
    return _round(missing_indicators(dirty(spark, sf).select("o_orderkey", "order_amount", "promo_value", "visits")))


def _mode_sql(col, src):
    return f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


_IMPUTE_SQL = _SEMANTIC_SQL.replace("FROM dirty\"\"\"", "FROM dirty") + """
"""
_IMPUTE_SQL = dirty_cte() + ", sem AS (" + _SEMANTIC_SQL[len(dirty_cte()):] + f""")
SELECT o_orderkey,
  coalesce(order_amount, (SELECT median(order_amount) FROM sem)) AS order_amount,
  coalesce(placed_on, {_mode_sql('placed_on', 'sem')}) AS placed_on,
  is_urgent,
  coalesce(gift_flag, {_mode_sql('gift_flag', 'sem')}) AS gift_flag,
  coalesce(gender, {_mode_sql('gender', 'sem')}) AS gender,
  priority,
  coalesce(visits, (SELECT median(visits) FROM sem)) AS visits,
  ticket, order_notes, channel, ship_start, ship_end, margin_percent, buyer_age,
  CAST(order_amount IS NULL AS INTEGER) AS order_amount_was_missing,
  CAST(placed_on IS NULL AS INTEGER) AS placed_on_was_missing,
  CAST(gift_flag IS NULL AS INTEGER) AS gift_flag_was_missing,
  CAST(gender IS NULL AS INTEGER) AS gender_was_missing,
  CAST(visits IS NULL AS INTEGER) AS visits_was_missing
FROM sem"""


def _semantic_frame(spark, sf):
    from scour.operators.schema import apply_schema, fit_schema
    from scour.operators.semantic import apply_semantic, fit_semantic
    d = dirty(spark, sf)
    sp = fit_schema(d)
    typed = apply_schema(d, sp)
    return apply_semantic(typed, fit_semantic(typed, sp["roles"])), sp["roles"]


@_query("impute_missing", _IMPUTE_SQL)
def q_impute_missing(spark, sf):
    from scour.operators.missing import apply_missing, fit_missing
    sem, roles = _semantic_frame(spark, sf)
    return _round(apply_missing(sem, fit_missing(sem, roles)))


@_query("ensure_complete", dirty_cte() + f"""
SELECT o_orderkey, coalesce(promo_value, (SELECT median(promo_value) FROM dirty)) AS promo_value,
  coalesce(visits, (SELECT median(visits) FROM dirty)) AS visits,
  coalesce(order_amount, {_mode_sql('order_amount', 'dirty')}) AS order_amount, ship_start FROM dirty""")
def q_ensure_complete(spark, sf):
    from scour.operators.missing import ensure_complete
    return _round(ensure_complete(dirty(spark, sf).select("o_orderkey", "promo_value", "visits", "order_amount",
                                                          "ship_start")))


@_query("basic_impute", dirty_cte() + f"""
SELECT o_orderkey, coalesce(promo_value, (SELECT median(promo_value) FROM dirty)) AS promo_value,
  coalesce(order_amount, {_mode_sql('order_amount', 'dirty')}) AS order_amount,
  coalesce(CAST(NULL AS VARCHAR), 'unknown') AS nothing FROM dirty""")
def q_basic_impute(spark, sf):
    from scour.operators.missing import basic_impute
    d = dirty(spark, sf).select("o_orderkey", "promo_value", "order_amount",
                                F.lit(None).cast("string").alias("nothing"))
    return _round(basic_impute(d))


@_query("impute_step", dirty_cte() + """
SELECT o_orderkey, coalesce(visits, (SELECT avg(visits) FROM dirty)) AS visits FROM dirty""")
def q_impute_step(spark, sf):
    from scour.operators.missing import impute
    return _round(impute(dirty(spark, sf).select("o_orderkey", "visits"), "visits", "mean"))


# =============================================================================
# Outliers (O1-O6)
# =============================================================================

_Q_IQR = _union([f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) WHERE q3 > q1"""
                  for c in LINEITEM_NUM])


@_query("iqr_bounds", _Q_IQR)
def q_iqr_bounds(spark, sf):
    from scour.operators.outliers import iqr_bounds
    return _round(iqr_bounds(table(spark, sf, "lineitem")))


def _fences(col, src, lo_dom=None, hi_dom=None):
    lo = f"q1 - 1.5 * (q3 - q1)"
    hi = f"q3 + 1.5 * (q3 - q1)"
    if lo_dom is not None:
        lo = f"greatest({lo}, {lo_dom})"
    if hi_dom is not None:
        hi = f"least({hi}, {hi_dom})"
    return (f"(SELECT {lo} AS lo, {hi} AS hi FROM (SELECT quantile_cont({col}, 0.25) AS q1, "
            f"quantile_cont({col}, 0.75) AS q3 FROM {src}))")


def _clip(col, f):
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} < least({f}.lo, {f}.hi) THEN least({f}.lo, {f}.hi) "
            f"WHEN {col} > greatest({f}.lo, {f}.hi) THEN greatest({f}.lo, {f}.hi) ELSE {col} END")


_OUT_COLS = [("visits", None, None), ("margin_percent", 0, 100), ("buyer_age", 0, 120)]

_Q_HANDLE = dirty_cte() + ", " + ", ".join(f"f_{c} AS {_fences(c, 'dirty', lo, hi)}" for c, lo, hi in _OUT_COLS) + \
    "\nSELECT o_orderkey, " + ", ".join(f"{_clip(c, 'f_' + c)} AS {c}" for c, _, _ in _OUT_COLS) + ", " + \
    ", ".join(f"CAST(coalesce({c} < f_{c}.lo OR {c} > f_{c}.hi, false) AS INTEGER) AS {c}_outlier_flag"
              for c in ("margin_percent", "buyer_age")) + \
    " FROM dirty, " + ", ".join(f"f_{c}" for c, _, _ in _OUT_COLS)


@_query("handle_outliers", _Q_HANDLE)
def q_handle_outliers(spark, sf):
    from scour.operators.outliers import handle_outliers
    d = dirty(spark, sf).select("o_orderkey", "visits", "margin_percent", "buyer_age")
    return _round(handle_outliers(d, {"o_orderkey": "id"}))


_Q_FLAG = dirty_cte() + ", " + ", ".join(f"f_{c} AS {_fences(c, 'dirty', lo, hi)}" for c, lo, hi in _OUT_COLS) + \
    "\nSELECT o_orderkey, visits, margin_percent, buyer_age, " + \
    ", ".join(f"CAST(coalesce({c} < f_{c}.lo OR {c} > f_{c}.hi, false) AS INTEGER) AS {c}_outlier_flag"
              for c in ("margin_percent", "buyer_age")) + \
    " FROM dirty, " + ", ".join(f"f_{c}" for c, _, _ in _OUT_COLS)


@_query("flag_outliers", _Q_FLAG)
def q_flag_outliers(spark, sf):
    from scour.operators.outliers import flag_outliers
    d = dirty(spark, sf).select("o_orderkey", "visits", "margin_percent", "buyer_age")
    return _round(flag_outliers(d, {"o_orderkey": "id"}))


_Q_CLIP = dirty_cte() + ", " + ", ".join(f"f_{c} AS {_fences(c, 'dirty', lo, hi)}" for c, lo, hi in _OUT_COLS) + \
    "\nSELECT o_orderkey, " + ", ".join(f"{_clip(c, 'f_' + c)} AS {c}" for c, _, _ in _OUT_COLS) + \
    " FROM dirty, " + ", ".join(f"f_{c}" for c, _, _ in _OUT_COLS)


@_query("clip_outliers", _Q_CLIP)
def q_clip_outliers(spark, sf):
    from scour.operators.outliers import clip_outliers
    d = dirty(spark, sf).select("o_orderkey", "visits", "margin_percent", "buyer_age")
    return _round(clip_outliers(d, {"o_orderkey": "id"}))


_CLIPALL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_Q_CLIPALL = "WITH " + ", ".join(f"f_{c} AS {_fences(c, 'lineitem')}" for c in _CLIPALL) + \
    "\nSELECT " + ", ".join(f"round({_clip(c, 'f_' + c)}, 6) AS {c}" for c in _CLIPALL) + \
    " FROM lineitem, " + ", ".join(f"f_{c}" for c in _CLIPALL)


@_query("clip_all", _Q_CLIPALL)
def q_clip_all(spark, sf):
    from scour.operators.outliers import clip_all
    return _round(clip_all(table(spark, sf, "lineitem").select(*_CLIPALL)))


_Q_REMOVE = dirty_cte() + f""", s1 AS (
  SELECT d.* FROM dirty d, {_fences('margin_percent', 'dirty')} f
  WHERE d.margin_percent >= f.lo AND d.margin_percent <= f.hi),
s2 AS (SELECT s.* FROM s1 s, {_fences('buyer_age', 's1')} f WHERE s.buyer_age >= f.lo AND s.buyer_age <= f.hi)
SELECT o_orderkey, margin_percent, buyer_age FROM s2"""


@_query("remove_outlier_rows", _Q_REMOVE)
def q_remove_outlier_rows(spark, sf):
    from scour.operators.outliers import remove_outlier_rows
    d = dirty(spark, sf).select("o_orderkey", "margin_percent", "buyer_age")
    return _round(remove_outlier_rows(d, ["margin_percent", "buyer_age"]))


# =============================================================================
# Consistency (K1-K5)
# =============================================================================

@_query("drop_duplicates", dirty_cte() + "\nSELECT DISTINCT * FROM dirty")
def q_drop_duplicates(spark, sf):
    from scour.operators.consistency import drop_exact_duplicates
    return _round(drop_exact_duplicates(dirty(spark, sf)))


@_query("drop_constant", dirty_cte() + "\nSELECT " + ", ".join(c for c, _ in DIRTY_COLS if c != "channel")
        + " FROM dirty")
def q_drop_constant(spark, sf):
    from scour.operators.consistency import drop_constant
    return _round(drop_constant(dirty(spark, sf)))


@_query("non_negative", dirty_cte() + "\nSELECT o_orderkey, CASE WHEN buyer_age < 0 THEN 0 ELSE buyer_age END "
        "AS buyer_age, visits FROM dirty")
def q_non_negative(spark, sf):
    from scour.operators.consistency import enforce_non_negative
    return _round(enforce_non_negative(dirty(spark, sf).select("o_orderkey", "buyer_age", "visits")))


@_query("percentage_range", dirty_cte() + "\nSELECT o_orderkey, CASE WHEN margin_percent < 0 THEN 0 "
        "WHEN margin_percent > 100 THEN 100 ELSE margin_percent END AS margin_percent FROM dirty")
def q_percentage_range(spark, sf):
    from scour.operators.consistency import enforce_percentage
    return _round(enforce_percentage(dirty(spark, sf).select("o_orderkey", "margin_percent")))


@_query("date_order", dirty_cte() + "\nSELECT o_orderkey, ship_start, CASE WHEN ship_start > ship_end "
        "THEN ship_start ELSE ship_end END AS ship_end FROM dirty")
def q_date_order(spark, sf):
    from scour.operators.consistency import repair_date_order
    return repair_date_order(dirty(spark, sf).select("o_orderkey", "ship_start", "ship_end"))


@_query("check_consistency", dirty_cte() + """
SELECT o_orderkey, order_amount, placed_on, is_urgent, gift_flag, gender, priority, promo_value, visits, ticket,
  order_notes, ship_start, CASE WHEN ship_start > ship_end THEN ship_start ELSE ship_end END AS ship_end,
  CASE WHEN margin_percent < 0 THEN 0 WHEN margin_percent > 100 THEN 100 ELSE margin_percent END AS margin_percent,
  CASE WHEN buyer_age < 0 THEN 0 ELSE buyer_age END AS buyer_age
FROM (SELECT DISTINCT * FROM dirty)""")
def q_check_consistency(spark, sf):
    from scour.operators.consistency import check_consistency
    return _round(check_consistency(dirty(spark, sf)))


# =============================================================================
# Features (F1-F7) and encoders
# =============================================================================

@_query("date_parts", "SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, "
        "CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day "
        "FROM orders")
def q_date_parts(spark, sf):
    from scour.operators.features import date_parts
    return date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


@_query("log1p_skewed", """
SELECT d.doc_id, d.n_chars, round(ln(1 + d.n_chars), 6) AS n_chars_log1p
FROM documents d, (SELECT abs(skewness(n_chars)) > 1 AND min(n_chars) >= 0 AS hit FROM documents) s WHERE s.hit""")
def q_log1p_skewed(spark, sf):
    from scour.operators.features import log1p_skewed
    return _round(log1p_skewed(table(spark, sf, "documents").select("doc_id", "n_chars"), {"doc_id": "id"}))


@_query("text_features", r"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length,
  CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS text_word_count
FROM documents""")
def q_text_features(spark, sf):
    from scour.operators.features import text_features
    return text_features(table(spark, sf, "documents").select("doc_id", "text"), ["text"]).drop("text")


_P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@_query("one_hot", "SELECT p_partkey, p_size, " + ", ".join(
        f"coalesce(p_type = '{v}', false) AS \"p_type_{v}\"" for v in _P_TYPES) + " FROM part")
def q_one_hot(spark, sf):
    from scour.operators.features import one_hot
    return one_hot(table(spark, sf, "part").select("p_partkey", "p_type", "p_size"), "p_type")


@_query("factorize", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand FROM part")
def q_factorize(spark, sf):
    from scour.operators.features import factorize
    return factorize(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


@_query("label_encode", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) "
        "AS c_mktsegment FROM customer")
def q_label_encode(spark, sf):
    from scour.operators.features import label_encode
    return label_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@_query("bools_to_int", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_final FROM orders")
def q_bools_to_int(spark, sf):
    from scour.operators.features import bools_to_int
    o = table(spark, sf, "orders")
    return bools_to_int(o.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_final")))


_O_STATUS = ["F", "O", "P"]
_O_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@_query("engineer_features", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, "
        "CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, "
        "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, "
        + ", ".join(f"coalesce(o_orderstatus = '{v}', false) AS \"o_orderstatus_{v}\"" for v in _O_STATUS) + ", "
        + ", ".join(f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\"" for v in _O_PRIO)
        + " FROM orders")
def q_engineer_features(spark, sf):
    from scour.operators.features import apply_features, fit_features
    from scour.operators.schema import fit_schema
    o = table(spark, sf, "orders")
    roles = fit_schema(o)["roles"]
    return _round(apply_features(o, fit_features(o, roles)))


# =============================================================================
# Steps (U1-U11, N1, X1)
# =============================================================================

@_query("scale_standard", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / "
        "(SELECT CASE WHEN stddev_pop(c_acctbal) = 0 THEN 1 ELSE stddev_pop(c_acctbal) END FROM customer), 6) "
        "AS c_acctbal FROM customer")
def q_scale_standard(spark, sf):
    from scour.operators.steps import scale_standard
    return _round(scale_standard(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")[0])


@_query("scale_minmax", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / "
        "(SELECT CASE WHEN max(c_acctbal) = min(c_acctbal) THEN 1 ELSE max(c_acctbal) - min(c_acctbal) END "
        "FROM customer), 6) AS c_acctbal FROM customer")
def q_scale_minmax(spark, sf):
    from scour.operators.steps import scale_minmax
    return _round(scale_minmax(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")[0])


@_query("scale_robust", "SELECT c_custkey, round((c_acctbal - (SELECT median(c_acctbal) FROM customer)) / "
        "(SELECT CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END FROM (SELECT quantile_cont(c_acctbal, 0.25) AS q1, "
        "quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)), 6) AS c_acctbal FROM customer")
def q_scale_robust(spark, sf):
    from scour.operators.steps import scale_robust
    return _round(scale_robust(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")[0])


def _scale_auto_sql():
    cols = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
            "power": "pow(l_quantity, 4)", "total": "l_quantity + 50 * l_discount * 10 + 50 * l_tax * 12"}
    ctes = ["x AS (SELECT l_orderkey, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in cols.items()) + " FROM lineitem)"]
    for c in cols:
        ctes += [f"a_{c} AS (SELECT avg({c}) AS m, stddev_pop({c}) AS sd, median({c}) AS md, min({c}) AS lo, max({c}) AS hi, "
                 f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM x)",
                 f"b_{c} AS (SELECT any_value(m) AS m, any_value(sd) AS sd, any_value(md) AS md, any_value(lo) AS lo, any_value(hi) AS hi, "
                 f"any_value(q1) AS q1, any_value(q3) AS q3, avg(pow(({c} - m) / sd, 3)) AS g, avg(pow(({c} - m) / sd, 4)) - 3 AS k FROM x, a_{c})"]
    pick = [f"round(CASE WHEN b_{c}.sd = 0 THEN x.{c} WHEN abs(b_{c}.g) > 1 OR b_{c}.k > 3 THEN (x.{c} - b_{c}.md) / "
            f"CASE WHEN b_{c}.q3 = b_{c}.q1 THEN 1 ELSE b_{c}.q3 - b_{c}.q1 END WHEN b_{c}.k < -1 THEN (x.{c} - b_{c}.lo) / (b_{c}.hi - b_{c}.lo) "
            f"ELSE (x.{c} - b_{c}.m) / b_{c}.sd END, 6) AS {c}" for c in cols]
    return "WITH " + ", ".join(ctes) + " SELECT l_orderkey, " + ", ".join(pick) + " FROM x, " + ", ".join(f"b_{c}" for c in cols), cols


@_query("scale_auto", _scale_auto_sql()[0])
def q_scale_auto(spark, sf):
    from scour.operators.steps import scale_auto
    cols = _scale_auto_sql()[1]
    src = table(spark, sf, "lineitem").select("l_orderkey", *[F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in cols.items()])
    return _round(scale_auto(src, list(cols))[0])


_NORM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query("normalize_all", "SELECT " + ", ".join(
        f"round(CASE WHEN (SELECT max({c}) > min({c}) FROM lineitem) THEN ({c} - (SELECT min({c}) FROM lineitem)) / "
        f"(SELECT max({c}) - min({c}) FROM lineitem) ELSE {c} END, 6) AS {c}" for c in _NORM) + " FROM lineitem")
def q_normalize_all(spark, sf):
    from scour.operators.steps import normalize_all
    return _round(normalize_all(table(spark, sf, "lineitem").select(*_NORM))[0])


@_query("impute_steps", dirty_cte() + f"""
SELECT o_orderkey, coalesce(visits, (SELECT median(visits) FROM dirty)) AS visits,
  coalesce(promo_value, (SELECT avg(promo_value) FROM dirty)) AS promo_value,
  coalesce(gift_flag, {_mode_sql('gift_flag', 'dirty')}) AS gift_flag,
  coalesce(order_amount, '0') AS order_amount
FROM dirty""")
def q_impute_steps(spark, sf):
    from scour.operators.steps import Step, apply_steps
    d = dirty(spark, sf).select("o_orderkey", "visits", "promo_value", "gift_flag", "order_amount")
    steps = [Step("visits", "impute", "median"), Step("promo_value", "impute", "mean"),
             Step("gift_flag", "impute", "mode"), Step("order_amount", "impute", "custom", {"value": "0"}),
             Step("no_such_column", "impute", "mean")]
    return _round(apply_steps(d, steps)[0])


@_query("transform_steps", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / "
        "(SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice, o_orderdate, "
        "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority, "
        + ", ".join(f"coalesce(o_orderstatus = '{v}', false) AS \"o_orderstatus_{v}\"" for v in _O_STATUS)
        + " FROM orders")
def q_transform_steps(spark, sf):
    from scour.operators.steps import Step, apply_steps
    o = table(spark, sf, "orders")
    steps = [Step("o_custkey", "drop"), Step("o_totalprice", "scale", "standard"),
             Step("o_orderstatus", "encode", "onehot"), Step("o_orderpriority", "encode", "label")]
    return _round(apply_steps(o, steps)[0])


@_query("step_normalize", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / "
        "(SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def q_step_normalize(spark, sf):
    from scour.operators.steps import apply_steps
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return _round(apply_steps(c, [{"column": "c_acctbal", "action": "normalize"}], mode="run")[0])


@_query("derived_again", dirty_cte() + "\nSELECT o_orderkey, visits, CAST(visits IS NULL AS INTEGER) AS visits_was_missing, ship_start, "
        "CAST(year(ship_start) AS INTEGER) AS ship_start_year, CAST(month(ship_start) AS INTEGER) AS ship_start_month, "
        "CAST(day(ship_start) AS INTEGER) AS ship_start_day FROM dirty")
def q_derived_again(spark, sf):
    from scour.operators.features import date_parts
    from scour.operators.missing import missing_indicators
    d = dirty(spark, sf).select("o_orderkey", "visits", F.lit(5).alias("visits_was_missing"), "ship_start", F.lit("x").alias("ship_start_year"))
    return date_parts(date_parts(missing_indicators(d)))


# Whole numbers, so that distances and ties are exact on both sides.
_KNN = {"size": "CASE WHEN p_partkey % 10 < 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END",
        "price": "CASE WHEN p_partkey % 7 < 2 THEN NULL ELSE CAST(floor(p_retailprice) AS DOUBLE) END",
        "width": "CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE CAST(length(p_name) AS DOUBLE) END"}


def _knn_sql():
    view = "SELECT p_partkey, " + ", ".join(f"{e} AS {c}" for c, e in _KNN.items()) + " FROM part"
    total = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in _KNN)
    both = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INTEGER)" for c in _KNN)
    fills = _union([
        f"SELECT p_partkey, '{t}' AS t, avg(v) AS v FROM (SELECT *, max(d) FILTER (WHERE place <= 5) OVER (PARTITION BY p_partkey) AS last "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d) AS place FROM (SELECT a.p_partkey, b.{t} AS v, "
        f"({total}) * (3.0::DOUBLE / ({both})) AS d FROM p a, p b WHERE a.{t} IS NULL AND b.{t} IS NOT NULL AND ({both}) > 0))) "
        f"WHERE d <= last GROUP BY p_partkey" for t in _KNN])
    value = ", ".join(f"round(coalesce(p.{c}, (SELECT f.v FROM f WHERE f.p_partkey = p.p_partkey AND f.t = '{c}'), "
                      f"(SELECT median({c}) FROM p)), 6) AS {c}" for c in _KNN)
    return f"WITH p AS ({view}), f AS ({fills}) SELECT p_partkey, {value} FROM p"


@_query("knn_impute", _knn_sql())
def q_knn_impute(spark, sf):
    from scour.operators.neighbours import knn_impute
    parts = table(spark, sf, "part").select("p_partkey", *[F.expr(e).alias(c) for c, e in _KNN.items()])
    return _round(knn_impute(parts, list(_KNN), scaled=False))


# Trees are random: no SQL; tests/test_isolation.py compares path lengths with a plain walk and looks for planted rows.
@_query("isolation_outliers")
def q_isolation_outliers(spark, sf):
    from scour.operators.isolation import isolation_outliers
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return _round(isolation_outliers(li, ["l_quantity", "l_extendedprice", "l_discount"]))


# =============================================================================
# Splits (D-1..D-4, X2)
# =============================================================================

_RN = "row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)))"


@_query("train_test_split", f"SELECT o_orderkey, CASE WHEN {_RN} <= ceil(0.2 * count(*) OVER ()) THEN 'test' "
        "ELSE 'train' END AS split FROM orders")
def q_train_test_split(spark, sf):
    from scour.operators.splits import train_test_split
    return train_test_split(table(spark, sf, "orders").select("o_orderkey"), 0.2, key="o_orderkey")


@_query("train_test_unshuffled", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= "
        "count(*) OVER () - ceil(0.25 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM orders")
def q_train_test_unshuffled(spark, sf):
    from scour.operators.splits import train_test_split
    return train_test_split(table(spark, sf, "orders").select("o_orderkey"), 0.25, shuffle=False, key="o_orderkey")


@_query("percent_split", f"SELECT o_orderkey, o_totalprice, CASE WHEN {_RN} <= count(*) OVER () - "
        "floor(0.8 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders")
def q_percent_split(spark, sf):
    from scour.operators.splits import percent_split
    return percent_split(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 80, key="o_orderkey")


_KFOLD_SQL = f"""
SELECT o_orderkey, CAST(CASE WHEN rn <= r * (q + 1) THEN (rn - 1) // (q + 1) + 1
  ELSE r + (rn - 1 - r * (q + 1)) // q + 1 END AS INTEGER) AS fold
FROM (SELECT o_orderkey, {_RN} AS rn, count(*) OVER () // 7 AS q, count(*) OVER () % 7 AS r FROM orders)"""


@_query("kfold", _KFOLD_SQL)
def q_kfold(spark, sf):
    from scour.operators.splits import kfold
    return kfold(table(spark, sf, "orders").select("o_orderkey"), 7, key="o_orderkey")


@_query("split_counts", "SELECT fold, count(*) AS rows FROM (" + _KFOLD_SQL + ") GROUP BY fold")
def q_split_counts(spark, sf):
    from scour.operators.splits import kfold, split_counts
    return split_counts(kfold(table(spark, sf, "orders").select("o_orderkey"), 7, key="o_orderkey"), "fold")


@_query("stratified_split", "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY "
        "md5('42:' || CAST(doc_id AS VARCHAR))) <= ceil(0.2 * count(*) OVER (PARTITION BY quality)) THEN 'test' "
        "ELSE 'train' END AS split FROM labels")
def q_stratified_split(spark, sf):
    from scour.operators.splits import stratified_split
    return stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", 0.2, key="doc_id")


_BY_DATE = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS placed FROM orders"


@_query("train_test_by_date", "SELECT o_orderkey, placed, CASE WHEN row_number() OVER (ORDER BY placed NULLS FIRST, o_orderkey) <= "
        f"count(*) OVER () - ceil(0.3 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM ({_BY_DATE})")
def q_train_test_by_date(spark, sf):
    from scour.operators.splits import train_test_split
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("date")).alias("placed"))
    return train_test_split(o, 0.3, shuffle=False, key=["placed", "o_orderkey"])


@_query("kfold_unshuffled", """
SELECT o_orderkey, o_orderpriority, price, CAST(CASE WHEN rn <= r * (q + 1) THEN (rn - 1) // (q + 1) + 1
  ELSE r + (rn - 1 - r * (q + 1)) // q + 1 END AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, price, o_orderkey) AS rn, count(*) OVER () // 7 AS q, count(*) OVER () % 7 AS r
      FROM (SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(24,2)) AS price FROM orders))""")
def q_kfold_unshuffled(spark, sf):
    from scour.operators.splits import kfold
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(24,2)").alias("price"))
    return kfold(o, 7, shuffle=False, key=["o_orderpriority", "price", "o_orderkey"])


_MANY = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS buyer FROM orders"


@_query("stratified_many", "SELECT o_orderkey, buyer, CASE WHEN row_number() OVER (PARTITION BY buyer ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) "
        f"<= ceil(0.2 * count(*) OVER (PARTITION BY buyer)) THEN 'test' ELSE 'train' END AS split FROM ({_MANY})")
def q_stratified_many(spark, sf):
    from scour.operators.splits import stratified_split
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("o_custkey")).alias("buyer"))
    return stratified_split(o, "buyer", 0.2, key="o_orderkey")


# =============================================================================
# Compositions and replay
# =============================================================================

def _auto_layers_sql():
    """The seven layers on DIRTY as one CTE chain (decisions that depend on the data - which
    flags exist, which columns are skewed - are the ones this data leads to)."""
    imp = _IMPUTE_SQL[len(dirty_cte()):]
    # imp is ", sem AS (...)\nSELECT ... FROM sem": make it a named CTE
    sem_part, sel = imp.split(")\nSELECT ", 1)
    chain = dirty_cte() + sem_part + "), imp AS (SELECT " + sel + ")"

    def fence(col, lo=None, hi=None):
        a, b = f"q1 - 1.5 * (q3 - q1)", f"q3 + 1.5 * (q3 - q1)"
        if lo is not None:
            a = f"greatest({a}, {lo})"
        if hi is not None:
            b = f"least({b}, {hi})"
        return (f"f_{col} AS (SELECT {a} AS lo, {b} AS hi FROM (SELECT quantile_cont({col}, 0.25) AS q1, "
                f"quantile_cont({col}, 0.75) AS q3 FROM imp))")

    fcols = [("o_orderkey", None, None), ("order_amount", 0, None), ("is_urgent", None, None),
             ("visits", None, None), ("margin_percent", 0, 100), ("buyer_age", 0, 120)]
    chain += ", " + ", ".join(fence(c, lo, hi) for c, lo, hi in fcols)

    def clip(c):
        return (f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least(CAST({c} AS DOUBLE), greatest(f_{c}.lo, f_{c}.hi)), "
                f"least(f_{c}.lo, f_{c}.hi)) END AS {c}")

    out_cols = ", ".join(clip(c) for c, _, _ in fcols)
    flags = ", ".join(f"CAST(coalesce({c} < f_{c}.lo OR {c} > f_{c}.hi, false) AS INTEGER) AS {c}_outlier_flag"
                      for c in ("margin_percent", "buyer_age"))
    chain += (f", outl AS (SELECT {out_cols}, placed_on, gift_flag, gender, priority, ticket, order_notes, channel, "
              f"ship_start, ship_end, order_amount_was_missing, placed_on_was_missing, gift_flag_was_missing, "
              f"gender_was_missing, visits_was_missing, {flags} FROM imp, "
              + ", ".join(f"f_{c}" for c, _, _ in fcols) + ")")
    chain += (", con AS (SELECT o_orderkey, CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END AS order_amount, "
              "placed_on, is_urgent, visits, gift_flag, gender, priority, ticket, order_notes, ship_start, "
              "CASE WHEN ship_start > ship_end THEN ship_start ELSE ship_end END AS ship_end, "
              "CASE WHEN margin_percent < 0 THEN 0 WHEN margin_percent > 100 THEN 100 ELSE margin_percent END AS margin_percent, "
              "CASE WHEN buyer_age < 0 THEN 0 ELSE buyer_age END AS buyer_age, order_amount_was_missing, "
              "placed_on_was_missing, gift_flag_was_missing, gender_was_missing, visits_was_missing, "
              "margin_percent_outlier_flag, buyer_age_outlier_flag FROM (SELECT DISTINCT * FROM outl))")
    parts = []
    for c in ("placed_on", "ship_start", "ship_end"):
        parts += [f"CAST(year({c}) AS INTEGER) AS {c}_year", f"CAST(month({c}) AS INTEGER) AS {c}_month",
                  f"CAST(day({c}) AS INTEGER) AS {c}_day"]
    logs = [f"ln(1 + {p}({'ship_end'})) AS ship_end_{n}_log1p" for p, n in (("year", "year"), ("month", "month"),
                                                                            ("day", "day"))]
    onehot = []
    for c, vals in (("gift_flag", ["maybe", "no", "yes"]), ("gender", ["female", "male", "other"]),
                    ("priority", ["HIGH", "LOW", "MEDIUM", "NOT SPECIFIED", "URGENT"])):
        onehot += [f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS \"{c}_{v}\"" for v in vals]
    text = ["CAST(length(order_notes) AS BIGINT) AS order_notes_length",
            "CAST(len(list_filter(regexp_split_to_array(order_notes, '\\s+'), lambda x: x <> '')) AS BIGINT) "
            "AS order_notes_word_count"]
    final = ("SELECT o_orderkey, order_amount, placed_on, is_urgent, visits, "
             "CAST(dense_rank() OVER (ORDER BY ticket) - 1 AS BIGINT) AS ticket, order_notes, ship_start, ship_end, "
             "margin_percent, buyer_age, order_amount_was_missing, placed_on_was_missing, gift_flag_was_missing, "
             "gender_was_missing, visits_was_missing, margin_percent_outlier_flag, buyer_age_outlier_flag, "
             + ", ".join(parts + logs + text + onehot) + " FROM con")
    return chain + ", auto AS (" + final + ")\n"


_ROUNDED = ("o_orderkey", "order_amount", "is_urgent", "visits", "margin_percent", "buyer_age",
            "ship_end_year_log1p", "ship_end_month_log1p", "ship_end_day_log1p")


def _rounded_select(src: str, cols=_ROUNDED) -> str:
    return ("SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + ", * EXCLUDE (" + ", ".join(cols)
            + f") FROM {src}")


_AUTO_BASE = _auto_layers_sql()
_AUTO_SQL = _AUTO_BASE + _rounded_select("auto")
_PREPARE_SQL = _AUTO_BASE.rstrip() + """, st AS (SELECT * EXCLUDE (ticket, margin_percent, buyer_age),
  (margin_percent - (SELECT avg(margin_percent) FROM auto)) /
    (SELECT CASE WHEN stddev_pop(margin_percent) = 0 THEN 1 ELSE stddev_pop(margin_percent) END FROM auto) AS margin_percent,
  (buyer_age - (SELECT min(buyer_age) FROM auto)) /
    (SELECT CASE WHEN max(buyer_age) = min(buyer_age) THEN 1 ELSE max(buyer_age) - min(buyer_age) END FROM auto) AS buyer_age
FROM auto)
""" + _rounded_select("st", tuple(c for c in _ROUNDED))


@_query("auto_layers", _AUTO_SQL)
def q_auto_layers(spark, sf):
    from scour.plans.auto import auto_layers
    return _round(auto_layers(dirty(spark, sf))[0])


@_query("audit_log")
def q_audit_log(spark, sf):
    from scour.plans.auto import auto_layers
    return auto_layers(dirty(spark, sf))[1].log_df(spark)


@_query("run_stats", dirty_cte() + """
SELECT 'raw' AS stage, count(*) AS rows, CAST(16 AS BIGINT) AS columns FROM dirty
UNION ALL SELECT 'ml_ready', count(*), CAST(43 AS BIGINT) FROM (SELECT DISTINCT * FROM dirty)""")
def q_run_stats(spark, sf):
    from scour.plans.auto import auto_layers
    _, r = auto_layers(dirty(spark, sf))
    rows = [("raw", r.stats["raw_data"]["rows"], len(r.stats["raw_data"]["columns"])),
            ("ml_ready", r.stats["ml_ready"]["rows"], r.stats["ml_ready"]["total_features"])]
    return spark.createDataFrame(rows, "stage string, rows bigint, columns bigint")


@_query("replay_recipe", _AUTO_SQL)
def q_replay_recipe(spark, sf):
    from scour.plans.auto import auto_layers
    from scour.plans.recipe import Recipe
    _, r = auto_layers(dirty(spark, sf))
    again = Recipe.from_json(r.to_json())
    again.dictionaries = r.dictionaries
    return _round(again.apply(dirty(spark, sf)))


@_query("prepare_steps", _PREPARE_SQL)
def q_prepare_steps(spark, sf):
    from scour.operators.steps import Step
    from scour.plans.auto import prepare
    steps = [Step("margin_percent", "scale", "standard"), Step("buyer_age", "scale", "minmax"),
             Step("Visits", "impute", "median"), Step("ticket", "drop")]
    return _round(prepare(dirty(spark, sf), steps)[0])


@_query("auto_clean")
def q_auto_clean(spark, sf):
    from scour.plans.auto import auto_clean
    return _round(auto_clean(dirty(spark, sf), split_percent=80, key="o_orderkey")[0])


_AUTO_NUMBERS = (
    "o_orderkey order_amount is_urgent visits ticket margin_percent buyer_age order_amount_was_missing placed_on_was_missing "
    "gift_flag_was_missing gender_was_missing visits_was_missing margin_percent_outlier_flag buyer_age_outlier_flag placed_on_year "
    "placed_on_month placed_on_day ship_start_year ship_start_month ship_start_day ship_end_year ship_end_month ship_end_day "
    "ship_end_year_log1p ship_end_month_log1p ship_end_day_log1p order_notes_length order_notes_word_count gift_flag_maybe gift_flag_no "
    "gift_flag_yes gender_female gender_male gender_other priority_HIGH priority_LOW priority_MEDIUM priority_URGENT").split() + ["priority_NOT SPECIFIED"]


def _auto_clean_sql():
    """Blanket clip and min-max of all numeric columns of the seven-layer run, whose result has nothing missing."""
    q = ", ".join(f'quantile_cont("{c}", 0.25) AS "a_{c}", quantile_cont("{c}", 0.75) AS "z_{c}"' for c in _AUTO_NUMBERS)
    clipped = ", ".join(f'CASE WHEN "z_{c}" = "a_{c}" THEN CAST("{c}" AS DOUBLE) ELSE least(greatest(CAST("{c}" AS DOUBLE), '
                        f'"a_{c}" - 1.5 * ("z_{c}" - "a_{c}")), "z_{c}" + 1.5 * ("z_{c}" - "a_{c}")) END AS "{c}"' for c in _AUTO_NUMBERS)
    ends = ", ".join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in _AUTO_NUMBERS)
    scaled = ", ".join(f'round(CASE WHEN "hi_{c}" > "lo_{c}" THEN ("{c}" - "lo_{c}") / ("hi_{c}" - "lo_{c}") ELSE "{c}" END, 6) AS "{c}"' for c in _AUTO_NUMBERS)
    return (_AUTO_BASE.rstrip() + f", qs AS (SELECT {q} FROM auto), cl AS (SELECT placed_on, order_notes, ship_start, ship_end, {clipped} FROM auto, qs), "
            f"en AS (SELECT {ends} FROM cl) SELECT placed_on, order_notes, ship_start, ship_end, {scaled} FROM cl, en")


@_query("auto_clean_values", _auto_clean_sql())
def q_auto_clean_values(spark, sf):
    from scour.plans.auto import auto_clean
    return _round(auto_clean(dirty(spark, sf), split_percent=None)[0])


_RUN_STEPS = [{"column": "o_custkey", "action": "drop"}, {"column": "o_totalprice", "action": "scale",
                                                          "method": "minmax"},
              {"column": "o_orderpriority", "action": "encode", "method": "label"}]
_RUN_CLEAN = ("SELECT o_orderkey, o_orderstatus, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / "
              "(SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS o_totalprice, o_orderdate, "
              "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority FROM orders")


def _run(spark, sf, mode, **kw):
    from scour.plans.auto import run_mode
    o = table(spark, sf, "orders")
    return _round(run_mode(o, mode, step_list=_RUN_STEPS, key="o_orderkey", **kw)[0])


@_query("run_clean_only", _RUN_CLEAN)
def q_run_clean_only(spark, sf):
    return _run(spark, sf, "clean_only")


@_query("run_split", f"SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, "
        f"o_orderdate, o_orderpriority, CASE WHEN {_RN} <= ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' "
        "END AS split FROM orders")
def q_run_split(spark, sf):
    return _run(spark, sf, "split", test_size=0.3)


@_query("run_clean_and_split", f"SELECT *, CASE WHEN {_RN} <= ceil(0.2 * count(*) OVER ()) THEN 'test' "
        f"ELSE 'train' END AS split FROM ({_RUN_CLEAN})")
def q_run_clean_and_split(spark, sf):
    return _run(spark, sf, "clean_and_split", test_size=0.2)


_KF3 = lambda src, cols: f"""
SELECT {cols}, CAST(CASE WHEN rn <= r * (q + 1) THEN (rn - 1) // (q + 1) + 1
  ELSE r + (rn - 1 - r * (q + 1)) // q + 1 END AS INTEGER) AS fold
FROM (SELECT *, {_RN} AS rn, count(*) OVER () // 3 AS q, count(*) OVER () % 3 AS r FROM ({src}))"""


@_query("run_cross_validation", _KF3("SELECT * FROM orders", "o_orderkey, o_custkey, o_orderstatus, "
                                     "round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority"))
def q_run_cross_validation(spark, sf):
    return _run(spark, sf, "cross_validation", n_folds=3)


@_query("run_clean_and_cv", _KF3(_RUN_CLEAN, "o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"))
def q_run_clean_and_cv(spark, sf):
    return _run(spark, sf, "clean_and_cv", n_folds=3)


# =============================================================================
# Sources, sinks and streaming (S1-S7, R6 on a stream)
# =============================================================================

def _scratch(spark, name):
    """A fresh folder under the session's reliable checkpoint folder (shared storage on a cluster)."""
    import uuid

    from scour.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/scour-{name}-{uuid.uuid4().hex[:8]}"


@_query("read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, "
        "o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 'x' ELSE 'y' END "
        "AS flag, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS maybe_key FROM orders")
def q_read_csv(spark, sf):
    from scour.sources.io import read_table, write_table
    o = table(spark, sf, "orders")
    src = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                   F.when(F.col("o_orderstatus") == "P", "NA").when(F.col("o_orderstatus") == "F", "x")
                    .otherwise("y").alias("flag"),
                   F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
                    .alias("maybe_key"))
    path = _scratch(spark, "csv")
    write_table(src, path, "csv")
    return _round(read_table(spark, path, "csv"))


@_query("read_json", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def q_read_json(spark, sf):
    from scour.sources.io import read_table, write_table
    path = _scratch(spark, "json")
    write_table(table(spark, sf, "customer"), path, "json")
    back = read_table(spark, path, "json")
    return _round(back.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"),
                              "c_acctbal", "c_mktsegment"))


@_query("narrow_types", "SELECT CAST(l_orderkey AS SMALLINT) AS l_orderkey, CAST(l_partkey AS SMALLINT) AS l_partkey, "
        "CAST(l_suppkey AS TINYINT) AS l_suppkey, CAST(l_linenumber AS TINYINT) AS l_linenumber, "
        "CAST(l_quantity AS FLOAT) AS l_quantity, l_extendedprice FROM lineitem")
def q_narrow_types(spark, sf):
    from scour.sources.io import narrow_types
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice")
    return narrow_types(li, floats=True)


@_query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def q_preview(spark, sf):
    from scour.sources.io import preview
    return preview(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 20, "o_orderkey")


@_query("write_splits", "SELECT fold, count(*) AS rows FROM (" + _KFOLD_SQL + ") GROUP BY fold")
def q_write_splits(spark, sf):
    from scour.operators.splits import kfold, split_counts
    from scour.sources.io import write_splits
    path = _scratch(spark, "folds")
    write_splits(kfold(table(spark, sf, "orders"), 7, key="o_orderkey"), path)
    return split_counts(spark.read.parquet(path), "fold")


def _orders_layers_sql():
    def fence(col, lo=None):
        a = "q1 - 1.5 * (q3 - q1)" if lo is None else f"greatest(q1 - 1.5 * (q3 - q1), {lo})"
        return (f"f_{col} AS (SELECT {a} AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({col}, 0.25) AS q1, "
                f"quantile_cont({col}, 0.75) AS q3 FROM orders))")

    def clip(c):
        return (f"round(greatest(least(CAST({c} AS DOUBLE), greatest(f_{c}.lo, f_{c}.hi)), least(f_{c}.lo, f_{c}.hi)), 6) "
                f"AS {c}")
    onehot = [f"CAST(o_orderstatus = '{v}' AS INTEGER) AS \"o_orderstatus_{v}\"" for v in _O_STATUS]
    onehot += [f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\"" for v in _O_PRIO]
    return ("WITH " + ", ".join([fence("o_orderkey"), fence("o_custkey"), fence("o_totalprice", 0)]) +
            "\nSELECT DISTINCT " + ", ".join([clip("o_orderkey"), clip("o_custkey"), clip("o_totalprice"), "o_orderdate",
                                              "CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year",
                                              "CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month",
                                              "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day"] + onehot) +
            " FROM orders, f_o_orderkey, f_o_custkey, f_o_totalprice")


@_query("stream_replay", _orders_layers_sql())
def q_stream_replay(spark, sf):
    import os

    from scour.plans.auto import auto_layers
    from scour.streaming.replay import replay_stream, run_to_table
    o = table(spark, sf, "orders")
    _, recipe = auto_layers(o, materialize=False)
    stream = spark.readStream.schema(o.schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    out = replay_stream(recipe, stream)
    name = "scour_stream_" + os.urandom(4).hex()
    return _round(run_to_table(out, name, _scratch(spark, "stream")))


ARRIVALS = 8  # micro-batches at most; up to as many files come one by one


@_query("stream_dedup", _orders_layers_sql())
def q_stream_dedup(spark, sf):
    """Every row arrives twice, in different files; the stream itself drops the second."""
    import os

    from scour.plans.auto import auto_layers
    from scour.streaming.replay import replay_stream, run_to_table
    o = table(spark, sf, "orders")
    _, recipe = auto_layers(o, materialize=False)
    twice = _scratch(spark, "twice")
    for mode in ("error", "append"):
        o.write.mode(mode).parquet(twice)
    # A micro-batch goes through the whole state, so their number must not grow with the table.
    each = max(1, math.ceil(len(spark.read.parquet(twice).inputFiles()) / ARRIVALS))
    out = replay_stream(recipe, spark.readStream.schema(o.schema).option("maxFilesPerTrigger", each).parquet(twice))
    return _round(run_to_table(out, "scour_stream_" + os.urandom(4).hex(), _scratch(spark, "stream")))


# =============================================================================
# driver contract
# =============================================================================

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: full column profile of lineitem at sf0.001."""
    from scour.operators.profile import profile
    return profile(table(spark, "/root/testdata/sf0.001", "lineitem"))


def _dealt() -> tuple[dict, dict]:
    """Queries and SQL of the training-data subpackage and its pipeline, where these are installed."""
    found, sql = {}, {}
    try:
        from scour.llm.queries import ORACLE_SQL, QUERIES
    except ImportError:
        return found, sql
    found, sql = dict(QUERIES), dict(ORACLE_SQL)
    try:
        import corpus_pipeline
    except ImportError:
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | _dealt()[0]


def oracle_sql() -> dict[str, str]:
    return _SQL | _dealt()[1]
