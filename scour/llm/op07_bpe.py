"""Byte-level BPE: a minimal perfect hash resolves whole pre-tokens, a heap over linked bytes merges the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from scour.llm.common import plain_text

#: Bytes of pre-tokens seen that a worker may hold while it encodes.
KEPT_BYTES = 96 << 20


class PerfectHash:
    """A minimal perfect hash of a fixed set of byte strings (hash, displace): n keys fill n slots.

    Keys are dealt to about n / 2 groups; the largest group first, a displacement is sought that puts all its
    keys into free slots; a group of one takes the next free slot by number.  ``get`` compares the bytes, so a
    string outside the set is told apart.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = len(ranks)
        self.groups = max(1, n // 2)
        self.shift = [0] * self.groups
        self.key: list[bytes | None] = [None] * n
        self.value = [-1] * n
        dealt: list[list[bytes]] = [[] for _ in range(self.groups)]
        for k in ranks:
            dealt[xxhash.xxh3_64_intdigest(k) % self.groups].append(k)
        used, next_free = bytearray(n), 0
        for g in sorted(range(self.groups), key=lambda g: -len(dealt[g])):
            if not dealt[g]:
                break
            if len(dealt[g]) == 1:
                while used[next_free]:
                    next_free += 1
                slots, self.shift[g] = [next_free], -1 - next_free
            else:
                d, slots = 0, []
                while not slots:
                    d += 1
                    slots = [xxhash.xxh3_64_intdigest(k, d) % n for k in dealt[g]]
                    if any(used[s] for s in slots) or len(set(slots)) < len(slots):
                        slots = []
                self.shift[g] = d
            for k, s in zip(dealt[g], slots, strict=True):
                used[s], self.key[s], self.value[s] = 1, k, ranks[k]

    def get(self, token: bytes) -> int:
        """The value, or -1."""
        if not self.n:
            return -1
        d = self.shift[xxhash.xxh3_64_intdigest(token) % self.groups]
        s = -1 - d if d < 0 else xxhash.xxh3_64_intdigest(token, d) % self.n
        return self.value[s] if self.key[s] == token else -1


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Left id * 2^20 + right id -> rank of the joined token, for every way to cut a token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a << 20 | b] = rank
    return out


def merge(ids: list[int], pair: dict[int, int]) -> list[int]:
    """The ids of a pre-token outside the vocabulary, given the ids of its bytes.

    The bytes are a doubly linked list; the heap has (rank, place) of neighbours that can join, lowest rank
    first, leftmost on ties.  An entry is stale if its place starts a pair of another rank, or none, by now.
    """
    n = len(ids)
    get, push, pop = pair.get, heapq.heappush, heapq.heappop
    bits = n.bit_length()  # small entries are cheaper to make and compare
    place = (1 << bits) - 1
    rank = [get(a << 20 | b, -1) for a, b in itertools.pairwise(ids)]
    heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return ids
    rank.append(-1)
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        x = pop(heap)
        i, r = x & place, x >> bits
        if rank[i] != r:
            continue
        j = after[i]
        ids[i], ids[j], rank[j] = r, -1, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank[i] = new = get(r << 20 | ids[k], -1)
            if new >= 0:
                push(heap, new << bits | i)
        else:
            rank[i] = -1
        k = before[i]
        if k >= 0:
            rank[k] = new = get(ids[k] << 20 | r, -1)
            if new >= 0:
                push(heap, new << bits | k)
    return [x for x in ids if x >= 0]


class Seen(dict):
    """Pre-token -> the bytes of its ids.  A pre-token that isn't held is encoded by the codec, which decides what to hold."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, s: str) -> bytes:
        return self.encode(s)


class Codec:
    """Encodes and decodes texts; keeps the ids of pre-tokens seen while they take about ``kept`` bytes at most."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_BYTES):
        import regex
        self.find = regex.compile(pattern).findall
        self.index = PerfectHash(ranks)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair = pair_ranks(ranks)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.kept = kept // 2
        self.release()

    def release(self) -> None:
        """Forget the pre-tokens seen; a worker is used again by other stages."""
        self.seen, self.held = Seen(self.token), 0
        # Two generations: when the younger one is full it becomes the older one, so what is used often stays.
        self.old: dict[str, bytes] = {}

    def token(self, s: str) -> bytes:
        """The ids of a pre-token that the younger generation doesn't hold, as little-endian unsigned 32-bit integers."""
        ids = self.old.get(s)
        if ids is None:
            raw = s.encode("utf-8")
            whole = self.index.get(raw)
            ids = array("I", (whole,) if whole >= 0 else merge([self.single[b] for b in raw], self.pair))
            if sys.byteorder == "big":
                ids.byteswap()
            ids = ids.tobytes()
        if len(s) <= 64:
            # A dictionary entry, a string and a byte string.
            size = 100 + sys.getsizeof(s) + sys.getsizeof(ids)
            if self.held + size > self.kept:
                # The dictionary that encode() reads just now stays the younger one.
                self.old, self.held = dict(self.seen), 0
                self.seen.clear()
            self.seen[s] = ids
            self.held += size
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.seen.__getitem__, self.find(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, built once from the vocabulary file that every executor's Python has."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = True,
                     extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves, for every row.

    One narrow map over the rows, without a shuffle; a row's result depends on its text only.  Null text counts
    as empty: no ids, and the digests of nothing.  Very long texts are encoded whole.  ``path`` and ``pattern``
    default to the public multilingual vocabulary.
    """
    import public_tokenizers
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    n, ids_sha, out_sha, kept = [], [], [], []
                    for text in part.column(1).to_pylist():
                        ids = c.encode(text or "")
                        n.append(len(ids))
                        ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                        out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                        if keep_ids:
                            kept.append(ids.astype(np.int32))
                    cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        cols.append(pa.array(kept, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            c.release()

    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(run, schema)
