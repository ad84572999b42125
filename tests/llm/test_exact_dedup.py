"""The extendible-hash index: directory, owners' chains, hot groups, and whole results against a plain grouping."""

import collections
import hashlib
import re

import pyarrow as pa
import pytest

from scour.llm import op09_exact_dedup as op


def _rows(n=600):
    rows = [(i, f"word{i % 170} " * (1 + i % 4) + ("\t" if i % 3 else "")) for i in range(n)]
    rows += [(5000 + i, "the same text" + " " * (i % 7)) for i in range(400)]  # a hot group
    return rows + [(None, "no id"), (None, "no  id"), (9000, None), (9001, " \n"), (3, "word3 "), (3, "word3 "), (9002, " x"), (9003, "x")]


def _plain(rows):
    by = collections.defaultdict(list)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]", "", t or ""), len(t or "")) for i, t in rows]
    for i, t, n in norm:
        by[t].append((-n, i is None, i))
    out = []
    for i, t, n in norm:
        size, _, keep = min(by[t])
        out.append((i, keep, len(by[t]), i == keep and n == -size, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,capacity", [(64, 512), (64, 8), (6, 4), (0, 1)])
def test_equals_a_plain_grouping_with_any_directory_and_chains(spark, monkeypatch, bits, capacity):
    monkeypatch.setattr(op, "HOT", 100)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted((tuple(r) for r in op.exact_dedup(docs, capacity, key_bits=bits).collect()), key=repr)
    assert got == _plain(rows)


def test_directory_splits_only_overfull_buckets(spark):
    few = [k << 56 for k in (1, 40, 90)]  # top bit 0
    many = [-(1 << 63) + (i << 40) for i in range(50)]  # all under one long prefix: depth beyond one pass
    keys = spark.createDataFrame([(k,) for k in few + many], "key bigint")
    slots, depth = op.build_directory(keys, 10)
    rows = slots.collect()
    local = {r.bucket: r.local_depth for r in rows}
    assert depth > op.GRAIN and local[0] == 1  # the half with three keys split once, with the root
    by = {r.slot: r.bucket for r in rows}
    assert len(by) == len(rows)
    held = collections.Counter(by[(k & (1 << 64) - 1) >> (64 - depth)] for k in few + many)
    assert max(held.values()) <= 10 and sum(held.values()) == 53
    for r in rows:  # pointers of a bucket are exactly the slots that share its local bits
        assert r.slot >> (depth - r.local_depth) == r.bucket >> (depth - r.local_depth)
    one, depth = op.build_directory(keys, 100)
    assert depth == 0 and [tuple(r) for r in one.collect()] == [(0, 0, 0)]
    assert op.build_directory(keys.limit(0), 10)[1] == 0


def test_owner_compares_bytes_across_batches():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))],
                                          ["key", "body", "copies"])
    made = op._insert(iter([batch((1, b"a", 2), (1, b"b", 1)), batch((1, b"a", 3), (2, b"a", 1))]))
    got = [tuple(r.values()) for b in made for r in b.to_pylist()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [(1, 0, sha(b"a"), 5), (1, 1, sha(b"b"), 1), (2, 0, sha(b"a"), 1)]
    assert [b.num_rows for b in op._insert(iter([]))] == [0]


def test_unique_texts_are_not_sent(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(99, "text 7")], "doc_id bigint, text string")
    out = op.exact_dedup(docs)
    assert out.where("group_size = 2").count() == 2 and out.where("kept").count() == 50
    # the branch of rows that stand alone has neither exchange nor Python
    plan = out.where("group_size = 1")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "MapInArrow" not in plan
