"""What moves between tasks and what a worker keeps: narrow rows, sets that are dealt once, a cache of its true size."""

import random
import sys

import numpy as np
import pyarrow as pa

from scour.llm import op06_lm_difference as lm
from scour.llm import op07_bpe, op10_minhash
from scour.llm import op03_suffix_dedup as suffixes


def _nodes(plan, name: str) -> list:
    below = [x for i in range(plan.children().size()) for x in _nodes(plan.children().apply(i), name)]
    return below + [plan] * (plan.nodeName() == name)


def test_words_and_pairs_travel_as_four_numbers(spark):
    docs = spark.createDataFrame([(i, f"one two w{i % 3} two one") for i in range(12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    found = lm.score(docs, labels, frequent_cells=2)
    assert [x.output().size() for x in _nodes(found._jdf.queryExecution().optimizedPlan(), "MapInArrow")] == [4]
    assert {r.n_tokens for r in found.collect()} == {5}


def test_packed_numbers_come_apart():
    kind, flag, n, ends = np.array([0, 1, 2, 3]), np.array([3, 2, 1, 0], np.int32), np.array([1 << 30, 1, 7, 0]), np.array([0, 1, 0, 0])
    d = lm.packed(kind, flag, n, ends)
    assert ((d & 3) == kind).all() and ((d >> 2 & 3) == flag).all() and ((d >> 4 & 1) == ends).all() and ((d >> 5) == n).all()


def test_near_dedup_deals_sets_once(spark, monkeypatch):
    plans, real = [], op10_minhash.verify

    def verify(pairs, sets, percent):
        plans.append(sets.groupBy("cid").count()._jdf.queryExecution().executedPlan().toString())
        return real(pairs, sets, percent)

    monkeypatch.setattr(op10_minhash, "verify", verify)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "begin " + text), (4, "other words altogether")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in op10_minhash.near_dedup(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert plans and not any("Exchange" in p for p in plans)


def test_few_rows_of_many_texts_leave_together():
    parts = [(pa.array([b"%d" % i], pa.binary()), [np.arange(i % 4), np.arange(i % 4) + i]) for i in range(50)]
    got = list(suffixes.together(iter(parts), ["at", "kh"], 20))
    assert all(b.num_rows >= 20 for b in got[:-1]) and len(got) < 5
    table = pa.Table.from_batches(got)
    assert table.column_names == ["rep", "at", "kh"]
    assert table.to_pydict() == {"rep": [b"%d" % i for i in range(50) for _ in range(i % 4)], "at": [x for i in range(50) for x in range(i % 4)],
                                 "kh": [x + i for i in range(50) for x in range(i % 4)]}
    assert list(suffixes.together(iter([]), ["at"])) == []
    assert list(suffixes.together(iter([(pa.array([b"a"], pa.binary()), [np.zeros(0, np.int64)])]), ["at"])) == []


def test_cache_of_pre_tokens_is_within_its_limit_and_changes_nothing():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b" a": 259, b"aba": 260, b"bb": 261}
    pattern, rnd = r" ?\p{L}+|\s+", random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 12))) for _ in range(40)) for _ in range(100)]
    small, large = op07_bpe.Codec(ranks, pattern, 1 << 16), op07_bpe.Codec(ranks, pattern)

    def brute(token: str) -> list[int]:
        ids = list(token.encode())
        name = {v: k for k, v in ranks.items()}
        while pairs := [(ranks[name[a] + name[b]], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if name[a] + name[b] in ranks]:
            r, i = min(pairs)
            ids[i:i + 2] = [r]
        return ids

    for text in texts:
        want = [x for token in large.find(text) for x in (lambda t: [ranks[t.encode()]] if t.encode() in ranks else brute(t))(token)]
        assert small.encode(text).tolist() == large.encode(text).tolist() == want
        assert small.decode(small.encode(text)) == text.encode()
        held = [x for d in (small.seen, small.old) for pair in d.items() for x in pair]
        assert all(type(x) in (str, bytes) for x in held) and sum(map(sys.getsizeof, held)) < 1 << 16
    assert small.old and len(small.seen) + len(small.old) < len(large.seen)
    small.release()
    assert not small.seen and not small.old
