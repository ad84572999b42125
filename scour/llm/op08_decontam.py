"""Benchmark decontamination: SimHashes of item-sized windows, multi-index Hamming search, exact verification.

A window has as many words as a benchmark item and slides over the document word by word.  A window can only
be similar enough if most of its shingles occur in the benchmark, so only windows that pass this exact count
get a SimHash.  The 64 bits are cut into four blocks of 16; fingerprints within radius 19 differ by at most
four bits in some block, so probing every value within four flips in each block finds all of them.  Items so
found are verified by the exact weighted similarity (sum of least over sum of greatest multiplicity) of the
shingles.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import KERNEL_BYTES, plain_text, steps, text_buffers
from scour.llm.textkit import U, mix, word_hashes, word_offsets

RADIUS, BLOCKS = 19, 4
_MASKS = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(16), k)], np.int64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places are 0 and not to be used."""
    out = np.zeros(len(h), U)
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        for i in range(k if n > 0 else 0):
            out[:n] = mix(out[:n] * U(3) + h[i:i + n] + U(i + 1))
    return out


def simhash(windows: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of shingle hashes (windows x shingles); a repeated shingle counts repeatedly."""
    out = np.zeros(len(windows), U)
    for at in range(0, len(windows), max(1, 200_000 // max(1, windows.shape[1]))):
        part = np.ascontiguousarray(windows[at:at + max(1, 200_000 // max(1, windows.shape[1]))])
        bits = np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=2)
        up = bits.sum(1, dtype=np.int32) * 2 >= part.shape[1]
        out[at:at + len(part)] = np.packbits(up, axis=1).view(U).ravel()
    return out


def blocks_of(prints: np.ndarray) -> np.ndarray:
    return prints.astype("<u8").view("<u2").reshape(-1, BLOCKS).astype(np.int64)


class Index:
    """The items of one block: per item its length, shingle counts and SimHash; per block of bits the items by value."""

    def __init__(self, ids: list, texts: pa.Array, size: int, percent: int):
        data, offsets = text_buffers(texts)
        h, rows = word_hashes(data, offsets)
        at = word_offsets(rows, len(ids))
        self.size, self.percent, self.ids, self.n = size, percent, ids, np.diff(at)
        self.counts: list[Counter] = []
        prints, known = np.zeros(len(ids), U), {}
        for i in range(len(ids)):
            n = int(self.n[i])
            k = min(size, n)
            g = grams(h[at[i]:at[i + 1]], k)[:n - k + 1] if n else np.zeros(0, U)
            self.counts.append(Counter(g.tolist()))
            if n:
                prints[i] = simhash(g[None, :])[0]
                known.setdefault(k, []).append(g)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.prints = prints
        #: item length -> (items, for each block of bits: distinct values, where their items begin, items by value)
        self.tables = {}
        part = blocks_of(prints)
        for n in np.unique(self.n[self.n > 0]).tolist():
            items = np.flatnonzero(self.n == n)
            tables = []
            for b in range(BLOCKS):
                order = items[np.argsort(part[items, b], kind="stable")]
                values, begin = np.unique(part[order, b], return_index=True)
                tables.append((values, np.append(begin, len(order)), order))
            self.tables[n] = tables

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All (place in ``prints``, item of n words) within the radius.

        A block's table is probed with every value within four flips, or, if it has fewer values than there
        are probes, its values are compared one by one; both give the same items.
        """
        got, part = [np.zeros((0, 2), np.int64)], blocks_of(prints)
        for b, (values, begin, order) in enumerate(self.tables[n]):
            for at in range(0, len(prints), 256):
                own = part[at:at + 256, b]
                if len(values) <= len(_MASKS):
                    w, v = np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= RADIUS // BLOCKS)
                else:
                    probe = own[:, None] ^ _MASKS[None, :]
                    place = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                    w, k = np.nonzero(values[place] == probe)
                    v = place[w, k]
                size = begin[v + 1] - begin[v]
                before = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
                item = order[np.repeat(begin[v] - before, size) + np.arange(size.sum())]
                w = np.repeat(w, size) + at
                near = np.bitwise_count(prints[w] ^ self.prints[item]) <= RADIUS
                got.append(np.stack([w[near], item[near]], 1))
        pairs = np.unique(np.concatenate(got), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def windows(self, h: np.ndarray, rows: np.ndarray, n_rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item length, row, first word, window words) of the windows that have enough shingles of the benchmark."""
        at = word_offsets(rows, n_rows)
        for k, known in self.known.items():
            if len(h) < k:
                continue
            g = grams(h, k)
            g[np.maximum(len(h) - k + 1, 0):] = 0
            inside = np.arange(len(h)) + k <= at[rows + 1]  # the shingle ends within its row
            place = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = (known[place] == g) & inside
            if not hit.any():
                continue
            sums = np.concatenate([[0], np.cumsum(hit)])
            live = np.unique(rows[hit])
            words = np.concatenate([np.arange(at[r], at[r + 1]) for r in live])
            count = at[rows[words] + 1] - at[rows[words]]
            for n in np.unique(self.n[(self.n >= 1) & (np.minimum(self.n, self.size) == k)]).tolist():
                m = n - k + 1
                # Windows of the item's size; a shorter document is one window as a whole.
                start = words[(words + n <= at[rows[words] + 1])]
                least = -(-2 * self.percent * m // (100 + self.percent))
                start = start[sums[start + m] - sums[start] >= least]
                yield n, rows[start], start, np.full(len(start), n), g
                start = words[(words == at[rows[words]]) & (count < n) & (count >= k)]
                size = at[rows[start] + 1] - start
                ok = (sums[start + size - k + 1] - sums[start]) * 100 >= self.percent * m
                for s, w in zip(start[ok], size[ok], strict=True):
                    yield n, rows[s:s + 1], np.array([s]), np.array([w]), g

    def search(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, dict[int, float]]:
        """Row -> item -> best similarity, of the rows with a match."""
        found: dict[int, dict[int, float]] = {}
        n_rows = len(offsets) - 1
        h, rows = word_hashes(data, offsets)
        for n, row, start, size, g in self.windows(h, rows, n_rows):
            if not len(start):
                continue
            m = int(size[0]) - min(self.size, n) + 1
            shown = g[start[:, None] + np.arange(m)]
            w, item = self.near(simhash(shown), n)
            for a, i in zip(w.tolist(), item.tolist(), strict=True):
                mine, its = Counter(shown[a].tolist()), self.counts[i]
                both = sum((mine & its).values())
                s = both / (sum(mine.values()) + sum(its.values()) - both)
                if s * 100 >= self.percent:
                    best = found.setdefault(int(row[a]), {})
                    best[i] = max(best.get(i, 0.0), s)
        return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, block: int = 20_000,
                  block_bytes: int = 32 << 20, carry: bool = False) -> DataFrame:
    """(doc_id, contaminated, items, similarity) for every row of ``docs`` against ``benchmark`` (item_id, text).

    ``items`` are the sorted item_ids that some window matches with a weighted ``size``-word shingle similarity
    of ``percent`` or more, ``similarity`` the best of them (0 without any).  An item or window of fewer words
    is one shingle as a whole; a document shorter than an item is one window.  Null, empty and blank texts
    match nothing, nor do such items; items with a null id take part but aren't listed.  Repeated rows are
    judged alike; an empty documents table gives an empty result, an empty benchmark leaves all clean; other
    columns are ignored, or with ``carry`` returned as the struct ``row``.

    Documents are never shuffled.  The benchmark is the stated query set: blocks of at most about ``block``
    items and ``block_bytes`` of text go to all tasks one after another, as many as it takes.
    """
    items = benchmark.select("item_id", plain_text().alias("text"))
    stats = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, math.ceil(stats["n"] / block), math.ceil((stats["bytes"] or 0) / block_bytes))
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    # With ``carry`` the text travels once, in the row.
    name, text = "row" if carry else "text", docs.columns.index("text")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else plain_text()
    out = docs.select("doc_id", whole.alias(name), F.array().cast(f"array<{item_type}>").alias("items"), F.lit(0.0).alias("similarity"))
    schema = f"doc_id {id_type}, {name} {out.schema[name].dataType.simpleString()}, items array<{item_type}>, similarity double"
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        index = Index(part["item_id"].to_pylist(), part["text"], size, percent)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffers(batch.column(1).field(text) if carry else batch.column(1))
                lists, best = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for i, j in steps(offsets, 4 * KERNEL_BYTES):  # windows of several words for each word
                    for r, got in index.search(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]).items():
                        lists[i + r] = sorted({*lists[i + r], *(index.ids[x] for x in got if index.ids[x] is not None)})
                        best[i + r] = max(best[i + r], *got.values())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, batch.schema.field(2).type), pa.array(best, pa.float64())],
                                                 ["doc_id", name, "items", "similarity"])

        out = out.mapInArrow(run, schema)
    return out.select("doc_id", (F.col("similarity") > 0).alias("contaminated"), "items", "similarity", *["row"] * carry)
