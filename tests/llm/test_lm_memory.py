"""Of the language models, only compressed pieces go to the driver and only a broadcast leaves it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.llm import op06_lm_difference as lm


def test_counts_leave_tasks_as_pieces_and_the_bitmap_as_broadcast(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 30)],
                                                                            F.concat(F.lit("own"), F.col("id").cast("string"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    seen, sent = [], []
    kind = type(spark.sparkContext)
    arrow, broadcast = type(docs).toArrow, kind.broadcast
    monkeypatch.setattr(type(docs), "toArrow", lambda self: seen.append((self.columns, arrow(self))) or seen[-1][1])
    monkeypatch.setattr(kind, "broadcast", lambda self, value: sent.append(type(value)) or broadcast(self, value))
    got = lm.score(docs.repartition(4), labels, frequent_cells=64).collect()
    assert len(got) == 400 and sent.count(np.ndarray) == 1
    counts = next(t for names, t in seen if names == ["h", "piece"])
    width = 64 + 64 + 1
    assert sum(p.is_valid for p in counts["piece"]) <= -(-4 * width // lm.CHUNK)
    # 97 words, of them some frequent, and one word a document; 30 tokens each
    assert sum(h for h, p in zip(counts["h"].to_pylist(), counts["piece"]) if not p.is_valid) == 97 + 400 - 64
    assert {r.n_tokens for r in got} == {30}
    again = lm.score(docs.repartition(2), labels, frequent_cells=8).collect()
    assert sorted((r.doc_id, pytest.approx(r.score, abs=1e-6)) for r in again) == sorted((r.doc_id, r.score) for r in got)


def test_sparse_pieces_come_back():
    rng = np.random.default_rng(5)
    for n in (1, 2, 90, 2000):
        piece = np.zeros(2 * lm.CHUNK, np.uint8)
        piece[rng.choice(len(piece), n, False)] = rng.integers(1, 256, n)
        at = np.flatnonzero(piece)
        packed = lm.sparse(piece, at)
        got, value = lm.from_sparse(np.frombuffer(packed, np.uint8), n)
        assert len(packed) == 3 * n and (got == at).all() and (value == piece[at]).all()
    piece[[0, -1]] = 3
    assert lm.from_sparse(np.frombuffer(lm.sparse(piece, np.array([0, len(piece) - 1])), np.uint8), 2)[0].tolist() == [0, len(piece) - 1]
