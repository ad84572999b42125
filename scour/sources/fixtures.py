"""The DIRTY view: a deterministic messy table derived from ``orders``.

The same SQL text runs in Spark SQL and in DuckDB, so every operator that
needs missing values, tokens, currency text or bad dates can be checked
against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scour.sources.tables import table

DIRTY_SQL = """
WITH base AS (
 SELECT o_orderkey,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 20 = 1 THEN 'N/A'
       ELSE concat(' $', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' ') END AS order_amount,
  CASE WHEN o_orderkey % 10 = 3 THEN 'not available'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS placed_on,
  CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' Y ' ELSE 'N' END AS is_urgent,
  CASE WHEN o_orderkey % 10 < 4 THEN 'T' WHEN o_orderkey % 10 < 7 THEN 'false'
       WHEN o_orderkey % 10 < 9 THEN 'maybe' ELSE 'n/a' END AS gift_flag,
  CASE o_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN ' Woman'
       WHEN 3 THEN 'Other' ELSE 'unknown' END AS gender,
  concat(' ', replace(substr(o_orderpriority, 3), ' ', '   '), ' ') AS priority,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 9 AS DOUBLE) END AS promo_value,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 12 AS DOUBLE) END AS visits,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '1' END, lpad(CAST(o_orderkey AS STRING), 9, '0')) AS ticket,
  concat('note   ', o_orderpriority, ' for ', CAST(o_custkey AS STRING)) AS order_notes,
  'x' AS channel,
  CAST(o_orderdate AS DATE) AS ship_start,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST('1990-01-01' AS DATE) ELSE CAST('2030-01-01' AS DATE) END AS ship_end,
  CASE WHEN o_orderkey % 13 = 0 THEN 140.0E0 WHEN o_orderkey % 13 = 1 THEN -5.0E0
       ELSE CAST(o_custkey % 100 AS DOUBLE) END AS margin_percent,
  CASE WHEN o_orderkey % 17 = 0 THEN -3.0E0 WHEN o_orderkey % 17 = 1 THEN 400.0E0
       ELSE CAST(20 + o_custkey % 60 AS DOUBLE) END AS buyer_age
 FROM orders)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0
"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DIRTY table over ``orders`` of ``sf_dir``."""
    orders = table(spark, sf_dir, "orders")
    return orders.sparkSession.sql(DIRTY_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)


def dirty_cte(alias: str = "dirty") -> str:
    """DIRTY as a CTE prefix for oracle SQL: ``WITH dirty AS (...)``."""
    return f"WITH {alias} AS ({DIRTY_SQL})"
