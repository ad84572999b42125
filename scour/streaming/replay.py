"""Structured Streaming replay of a fitted recipe.

Every layer of a recipe is a row-local projection except deduplication and
the factorize dictionaries.  On a stream, the dictionaries are static
DataFrames (a stream-static left join), and deduplication keeps state: within
an event-time watermark on the rows as they arrive, so the state stays bounded,
or without an event time on the cleaned rows, as in a batch; then the state
holds a digest of each distinct row, dealt over the shuffle partitions.  ``run_to_table`` drives a stream to completion into a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scour.plans.recipe import Recipe


def replay_stream(recipe: Recipe, stream: DataFrame, *, event_time: str | None = None,
                  delay: str = "1 day", dedup: bool = True) -> DataFrame:
    """Apply ``recipe`` to a streaming frame.  With ``event_time`` (a timestamp column of the
    input) rows that arrive again within ``delay`` of the watermark are dropped before the first layer, where the
    watermark is still known; rows that only cleaning makes equal stay.  Without it the deduplication layer drops every
    row that came before, as a batch replay does; a state store on disk (RocksDB) suits streams of many distinct rows.
    Only a recipe that deduplicates does so here; ``dedup=False`` turns it off."""
    if not dedup or not (recipe.params("consistency") or {}).get("dedup", True):
        return recipe.apply(stream, streaming_dedup=False)
    if event_time is None:
        return recipe.apply(stream)
    stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark()
    return recipe.apply(stream, streaming_dedup=False)


def run_to_table(df: DataFrame, name: str, checkpoint: str, *, output_mode: str = "append") -> DataFrame:
    """Run a streaming frame over everything available into Parquet files beside ``checkpoint`` (a path in
    shared storage) and return them as a batch frame, also registered as the view ``name``."""
    path = f"{checkpoint.rstrip('/')}-table"
    q = (df.writeStream.format("parquet").queryName(name).outputMode(output_mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    spark: SparkSession = df.sparkSession
    out = spark.read.schema(df.schema).parquet(path)
    out.createOrReplaceTempView(name)
    return out
