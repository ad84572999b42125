"""Headline timings: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced with a full-row action (count of its result, which for
the preparation queries means computing every output column) and timed on
a warm session; the JIT warm-up run on the smallest table is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from scour.session import get_session  # noqa: E402
from scour.sources.fixtures import dirty  # noqa: E402
from scour.sources.tables import table  # noqa: E402


def _force(df):
    # hash every column so that no projection is pruned away
    return df.select(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).collect()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))

    from scour.operators import features, outliers, profile, splits
    from scour.plans import auto

    def q_profile():
        return profile.profile(table(spark, sf_dir, "lineitem"))

    def q_quality():
        return profile.quality_metrics(table(spark, sf_dir, "lineitem"))

    def q_auto_layers():
        return auto.auto_layers(dirty(spark, sf_dir))[0]

    def q_clip_all():
        li = table(spark, sf_dir, "lineitem")
        return outliers.clip_all(li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax"))

    def q_kfold():
        return splits.kfold(table(spark, sf_dir, "lineitem"), 5, key=["l_orderkey", "l_linenumber"])

    def q_train_test():
        return splits.train_test_split(table(spark, sf_dir, "orders"), 0.2, key="o_orderkey")

    def q_factorize():
        return features.factorize(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")

    def q_auto_clean():
        return auto.auto_clean(dirty(spark, sf_dir), key="o_orderkey")[0]

    plan = [("profile_lineitem", q_profile), ("quality_lineitem", q_quality), ("auto_layers_dirty", q_auto_layers),
            ("clip_all_lineitem", q_clip_all), ("kfold_lineitem", q_kfold), ("train_test_orders", q_train_test),
            ("factorize_lineitem", q_factorize), ("auto_clean_dirty", q_auto_clean)]

    # warm-up on the smallest table (JIT, codegen caches); not timed
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        _force(profile.profile(table(spark, warm, "lineitem")))
        _force(auto.auto_layers(dirty(spark, warm))[0])

    times = {}
    for name, fn in plan:
        t0 = time.time()
        _force(fn())
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
