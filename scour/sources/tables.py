"""Access to the parquet tables of a scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register each table as a temporary view named after it."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
