"""Exact dense codes for the distinct values of a column, without a one-task window.

The distinct values are range-partitioned and sorted by Spark; each row gets
``monotonically_increasing_id`` (partition index in the high bits, position
in the low bits); the sorted dictionary is checkpointed to the reliable
checkpoint folder so the ids are stable; one tiny aggregate gives the row
count per partition, whose running sums are the partition offsets.  The code
is offset + position.  Only one row per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.session import cut_lineage

_LOW_BITS = 33
# Dictionaries with at most this many entries are broadcast to the join (a copy per executor).
BROADCAST_ROWS = 100_000


def dense_dictionary(values: DataFrame, value_col: str = "value",
                     order_col: str | None = None) -> tuple[DataFrame, int]:
    """(value, code) with code = 0-based rank among the distinct non-null values; plus the count.

    With ``order_col`` values are ranked by their first appearance (smallest
    ``order_col`` of the value; ties by value) instead of by value.
    """
    d = values.where(F.col(value_col).isNotNull())
    if order_col is None:
        d = d.select(F.col(value_col).alias("value")).distinct()
        keys = ["value"]
    else:
        d = d.groupBy(F.col(value_col).alias("value")).agg(F.min(order_col).alias("_first"))
        keys = ["_first", "value"]
    ordered = d.orderBy(*keys).withColumn("_mid", F.monotonically_increasing_id())
    ck = cut_lineage(ordered)
    per_part = (ck.groupBy(F.shiftright("_mid", _LOW_BITS).alias("pid"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = {}, 0
    for r in sorted(per_part, key=lambda r: r["pid"]):
        offsets[r["pid"]] = run
        run += r["n"]
    if offsets:
        items = []
        for k, v in offsets.items():
            items += [F.lit(k), F.lit(v)]
        off = F.element_at(F.create_map(*items), F.shiftright("_mid", _LOW_BITS))
    else:
        off = F.lit(0).cast("bigint")
    low = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return ck.select("value", (off + low).cast("bigint").alias("code")), run


def join_codes(df: DataFrame, column: str, dictionary: DataFrame, size: int, *, missing_code=-1,
               value_expr: Column | None = None, out_name: str | None = None) -> DataFrame:
    """Replace ``column`` by its code from ``dictionary`` (left join; values not found get ``missing_code``).

    The dictionary is broadcast only when its row count (known exactly) is
    under ``BROADCAST_ROWS``; otherwise it is a shuffle join, where adaptive
    execution splits a skewed value's partition.
    """
    key = value_expr if value_expr is not None else F.col(f"`{column}`")
    tmp = "__scour_key"
    left = df.withColumn(tmp, key)
    right = dictionary.withColumnRenamed("value", tmp).withColumnRenamed("code", "__scour_code")
    if size <= BROADCAST_ROWS:
        right = F.broadcast(right)
    joined = left.join(right, on=tmp, how="left")
    code = F.coalesce(F.col("__scour_code"), F.lit(missing_code).cast("bigint"))
    name = out_name or column
    cols = [code.alias(name) if c == column else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*cols)
