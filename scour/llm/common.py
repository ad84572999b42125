"""Helpers shared by the operators: tables in the shared folder, row selectors, Arrow text batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.session import checkpoint_dir

#: Bytes of text that one numpy step works on; a longer single document makes a step of its own.
STEP_BYTES = 2 << 20
#: The same for kernels that hold several 64-bit numbers for each byte: these then stay in the processor's cache.
KERNEL_BYTES = 128 << 10


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, where it isn't installed for them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")) if x)


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let rows travel to Python in batches of at most ``most`` bytes, each of which an executor holds several times, off its
    heap.  A session with another limit than Spark's own (64 MB) keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64MB").lower() in ("64mb", "64m", "67108864", "67108864b"):
        spark.conf.set(key, most)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once, bucketed by ``key`` as the shuffle has dealt it, so that later joins by it don't move its rows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def unit_hash(*cols: str, seed: str = "s") -> Column:
    """A number in [0, 1) that depends on the columns' values only; used to choose bounded training samples."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def plain_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its offsets (rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    arr = arr.fill_null(b"") if arr.null_count else arr
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay within ``most`` bytes (a single longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
