import os
import uuid

from pyspark.sql import functions as F

from scour.plans.auto import auto_layers
from scour.plans.recipe import Recipe
from scour.session import checkpoint_dir
from scour.streaming.replay import replay_stream, run_to_table

from .conftest import SF


def test_stream_replay_with_watermarked_dedup(spark):
    base = spark.read.parquet(os.path.join(SF, "events.parquet"))
    # the recipe is fitted on the batch table; the stream repeats every row twice
    _, recipe = auto_layers(base, metrics=False, materialize=False)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-src-{uuid.uuid4().hex[:6]}"
    base.union(base).write.parquet(folder)
    stream = spark.readStream.schema(base.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = replay_stream(recipe, stream, event_time="ts", delay="3650 days")
    name = "t_" + uuid.uuid4().hex[:8]
    got = run_to_table(out, name, f"{checkpoint_dir(spark).rstrip('/')}/stream-ck-{uuid.uuid4().hex[:6]}")
    batch = recipe.apply(base.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.count() == batch.count() == base.count()


def test_stream_replay_query_drops_copies_and_writes_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry
    rows = spark.read.parquet(os.path.join(SF, "orders.parquet")).toArrow()
    pq.write_table(pa.concat_tables([rows, rows.slice(0, 100)]), tmp_path / "orders.parquet")
    table = entry.queries()["stream_replay"](spark, str(tmp_path))
    assert table.inputFiles() and table.count() == rows.num_rows


def test_stream_without_event_time_drops_copies_across_restarts(spark):
    base = spark.createDataFrame([(1, " a ", 0.0), (1, "a", -0.0), (2, None, 1.5), (2, None, 1.5), (3, "c", None)], "k bigint, t string, v double")
    # 0.0 and -0.0 are equal, as in a batch
    recipe = Recipe([("consistency", {"dedup": True, "constant_columns_dropped": [], "numeric_adjustments": [], "date_corrections": []})], {}, [], {})
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-src-{uuid.uuid4().hex[:6]}"
    place = f"{checkpoint_dir(spark).rstrip('/')}/stream-ck-{uuid.uuid4().hex[:6]}"
    base = base.withColumn("t", F.trim("t"))

    def run():
        stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return run_to_table(replay_stream(recipe, stream), "t_" + uuid.uuid4().hex[:8], place)

    base.repartition(3).write.parquet(folder)
    assert run().count() == 3
    base.union(base.where("k = 3").withColumn("k", F.lit(4).cast("bigint"))).write.mode("append").parquet(folder)
    assert sorted(r["k"] for r in run().collect()) == [1, 2, 3, 4]  # the state outlives the first query


def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    import __spark_entry__ as entry
    rows = spark.read.parquet(os.path.join(SF, "orders.parquet")).toArrow()
    folder = tmp_path / "orders.parquet"
    folder.mkdir()
    for i in range(10):
        pq.write_table(rows.slice(i * rows.num_rows // 10, (i + 1) * rows.num_rows // 10 - i * rows.num_rows // 10), folder / f"part-{i}.parquet")
    places, scratch = [], entry._scratch
    monkeypatch.setattr(entry, "_scratch", lambda *a: places.append(scratch(*a)) or places[-1])
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        table = entry.queries()["stream_dedup"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert table.count() == rows.num_rows
    batches = [x for x in os.listdir(places[-1].removeprefix("file:") + "/commits") if x.isdigit()]
    assert 2 <= len(batches) <= entry.ARRIVALS and len(spark.read.parquet(places[0]).inputFiles()) > entry.ARRIVALS
