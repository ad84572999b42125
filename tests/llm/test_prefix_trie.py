"""op12 against a plain-Python trie, with small blocks and shards so that every split is taken."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scour.llm.common import ship
from scour.llm.op12_prefix_trie import DoubleArray, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _content_key(role, text):
    raw = f"{len(role.encode())}:{role}{text}".encode()
    h = hashlib.sha256(raw).hexdigest()
    return int(h[:15], 16), int(h[15:30], 16)


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0, _content_key(role or "", text or "")), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        giver = c - int(np.fmod(c, 5))
        rebuilt[c] = tuple(turns.get(giver, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        total[node] = (1 if not kids else sum(total[k][0] for k in kids), own + sum(total[k][1] for k in kids))
    out = set()
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(node))))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *total[node],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _random_rows(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        kind = r.random()
        length = 1 if kind < 0.2 else r.randint(1, 14)
        for t in range(length):
            text = "hello" if t == 0 and kind < 0.7 else r.choice(["a", "é", "", None, "long " * 3]) if r.random() < 0.8 else str(r.random())
            rows.append((c, None if t == 0 and r.random() < 0.2 else t, r.choice(["user", "user", None]), text))
    for c in range(100, 130):  # copies of one conversation
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (-7, 0, "user", "below zero"), (None, 1, "user", "nobody")]
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(14)]
    return rows


@pytest.mark.parametrize("block,shard", [(512, 50_000), (4, 6)])
def test_equals_brute_force(spark, block, shard):
    ship(spark)
    rows = _random_rows(block)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in prefix_trie(df, block=block, shard_turns=shard).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    assert set(got) == want


def test_empty_clashing_and_turnless(spark):
    ship(spark)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # 8 has crc32 % 9 turns to borrow from 5, which doesn't exist: with one turn of its own it is left without any
    c = next(c for c in range(6, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "y", 2) for r in rows], SCHEMA + ", depth int, x1 string, size int")
    assert {tuple(r) for r in prefix_trie(df).collect()} == brute(rows)
    assert brute(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_double_array_keeps_its_words():
    r = np.random.default_rng(1)
    states, trie = np.zeros(1, np.int64), DoubleArray(1, 500)
    edges = {}
    for _ in range(4):
        pairs = sorted({(int(s), int(c)) for s in states for c in r.integers(0, 500, r.integers(1, 30))})
        s, c = (np.array(x) for x in zip(*pairs, strict=True))
        states = trie.add_level(s, c)
        assert len(set(states.tolist())) == len(pairs)
        edges |= {p: int(t) for p, t in zip(pairs, states, strict=True)}
        states = states[:200]
    for (s, c), t in edges.items():
        assert trie.step(np.array([s]), np.array([c]))[0] == t
        assert trie.check[t] == s
    missing = [(s, c) for s in {s for s, _ in edges} for c in range(0, 500, 7) if (s, c) not in edges]
    assert all(trie.step(np.array([s]), np.array([c]))[0] == -1 for s, c in missing[:3000])
