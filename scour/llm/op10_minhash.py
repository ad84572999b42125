"""MinHash near-dedup with tensored banding.

Two collections of ``half`` half-keys (each of ``rows`` minhashes) are computed; a table key pairs half-key i
of the first with half-key j of the second.  So half * half tables cost only 2 * half * rows minhashes.  A
pair of documents shares a table key exactly if it shares a half-key in both collections.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.common import KERNEL_BYTES, bucketed, plain_text, steps, text_buffers, written
from scour.llm.textkit import U, _seeded, distinct_by_row, mix, shingles, word_hashes

ROWS = 2  # minhashes in a half-key
WORDS = 8  # 64-bit words in a set's parity map
MAPS = [f"m{i}" for i in range(WORDS)]
SIEVE_BITS = 1 << 26  # of the filter that picks rows to read again: 8 MB at most, at every size


def halves_for(percent: int, miss: float = 1e-4) -> int:
    """Half-keys of each collection, so that a pair just at the threshold shares no table with probability <= miss."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the place where each row's set begins (rows + 1)."""
    n = len(offsets) - 1
    h, rows = word_hashes(data, offsets)
    h, rows = distinct_by_row(*shingles(h, rows, n, size))
    return h, np.searchsorted(rows, np.arange(n + 1))


def half_keys(h: np.ndarray, at: np.ndarray, half: int, rows: int = ROWS) -> np.ndarray:
    """Rows x (2 * half) half-keys; the first ``half`` are of the first collection. Rows with an empty set get 0."""
    n = len(at) - 1
    out = np.zeros((n, 2 * half), U)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    a, b = _seeded(2 * half * rows, 101) | U(1), _seeded(2 * half * rows, 202)
    with np.errstate(over="ignore"):
        for k in range(2 * half):
            key = np.full(len(full), k + 1, U)
            for r in range(k * rows, (k + 1) * rows):
                x = h * a[r] + b[r]
                x ^= x >> U(29)
                key = mix(key * U(3) + np.minimum.reduceat(x * a[r - 1], at[full]))
            out[full, k] = key
    return out


def set_ids(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for a whole set; None for an empty one."""
    with np.errstate(over="ignore"):
        one = np.concatenate([[U(0)], np.cumsum(mix(h), dtype=U)])
        two = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
        pair = np.stack([mix(one[at[1:]] - one[at[:-1]]), mix(two[at[1:]] - two[at[:-1]])], 1).astype(">u8")
    raw, full = pair.tobytes(), np.diff(at) > 0
    return [raw[16 * i:16 * i + 16] if full[i] else None for i in range(len(full))]


def row_pick() -> Column:
    """Hash of id and text."""
    return F.xxhash64("doc_id", plain_text())


def signatures(docs: DataFrame, size: int, half: int) -> DataFrame:
    """(doc_id, n, cid, pick, keys) of every row: set size, 128-bit id of the set, hash of id and text, half-keys."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in steps(offsets, KERNEL_BYTES):
                h, at = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], size)
                keys = half_keys(h, at, half).view(np.int64)
                ends = np.arange(j - i + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array(set_ids(h, at), pa.binary()),
                    batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                    ["doc_id", "n", "cid", "pick", "keys"])

    text = plain_text()
    return docs.select("doc_id", row_pick().alias("pick"), text.alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n bigint, cid binary, pick bigint, keys array<bigint>")


def parity_maps(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x WORDS: bit j tells whether an odd number of the set's shingles hash to j.

    Two maps differ in at most as many bits as there are shingles in just one of the sets.
    """
    bits, rows = 64 * WORDS, np.repeat(np.arange(len(at) - 1), np.diff(at))
    cell = (mix(h ^ U(0x2545F4914F6CDD1D)) % U(bits)).astype(np.int64)
    odd = np.bincount(rows * bits + cell, minlength=(len(at) - 1) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def sieve(picks: DataFrame) -> np.ndarray:
    """Bit ``pick`` mod SIEVE_BITS is set for every ``pick``; bit_or folds them before anything is sent."""
    cell = F.pmod("pick", F.lit(SIEVE_BITS))
    got = picks.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (cell % 64).cast("int"))).alias("v")).toArrow()
    out = np.zeros(SIEVE_BITS >> 6, np.int64)
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out.view(U)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, n, hs, parity map) of the rows whose hash ``wanted`` (pick, cid) has; one row for each cid.

    The sieve only spares rows that can't be wanted; the joins after it are exact.
    """
    bits = sieve(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy().astype(np.int64) % SIEVE_BITS
            batch = batch.filter(pa.array((bits[cell >> 6] >> (cell & 63).astype(U) & U(1)) > 0))
            data, offsets = text_buffers(batch.column(1))
            for i, j in steps(offsets, KERNEL_BYTES):
                h, at = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], size)
                maps = parity_maps(h, at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(set_ids(h, at), pa.binary()), pa.array(np.diff(at).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))),
                    *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(WORDS))], ["cid", "n", "hs", *MAPS])

    text = plain_text()
    sets = docs.select(F.xxhash64("doc_id", text).alias("pick"), text.alias("text")).mapInArrow(
        run, "cid binary, n bigint, hs array<bigint>, " + ", ".join(f"{m} bigint" for m in MAPS))
    # Rows that the sieve lets pass needlessly, and repeated rows: keep the wanted sets, once each.
    return sets.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def close_enough(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity at all (exact)."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def maps_allow(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """Parity maps (columns a0.., b0..) that differ in few enough bits for the similarity (exact: never false for a link)."""
    differ = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(WORDS)), F.lit(0))
    both = F.col(na) + F.col(nb)
    return (both - differ) * (100 + percent) >= both * (2 * percent)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; parity maps spare most reads of sets."""
    def maps(x: str) -> DataFrame:
        return sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), *[F.col(m).alias(f"{x}{i}") for i, m in enumerate(MAPS)])

    pairs = pairs.join(maps("a"), "a").join(maps("b"), "b").where(maps_allow("a", "b", "na", "nb", percent)).select("a", "b")
    one = pairs.join(sets.select(F.col("cid").alias("a"), F.col("hs").alias("ha")), "a")
    both = one.join(sets.select(F.col("cid").alias("b"), F.col("hs").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(common * 100 >= (F.size("ha") + F.size("hb") - common) * percent).select("a", "b")


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can still be similar enough, without loss.

    With every set sorted by one order, two sets that reach the threshold share an element among the first
    n - ceil(n * percent / 100) + 1 of each.  The order puts rare shingles first, by counts in 2^20 hash cells;
    a shingle alone in its cell is in one set only and is left out.  Under one shingle, members of its largest
    component aren't compared with each other.  A pair is made only if the places of the shingle leave enough
    of both sets (true for the first one they share) and their parity maps allow the similarity.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 20, np.int64)
        for batch in batches:
            total += np.bincount((batch.column(0).flatten().to_numpy().view(U) >> U(44)).astype(np.int64), minlength=1 << 20)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    table = sets.select("hs").mapInArrow(counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << 20, np.int64)
    often[table["cell"].to_numpy()] = table["n"].to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(3).flatten().to_numpy()
            at = batch.column(3).value_lengths().to_numpy().cumsum()
            n = np.diff(at, prepend=0)
            rows = np.repeat(np.arange(len(n)), n)
            count = often[(h.view(U) >> U(44)).astype(np.int64)]
            order = np.lexsort((h, count, rows))
            place = np.arange(len(h)) - np.repeat(at - n, n)
            short = place < np.repeat(n + (-percent * n // 100) + 1, n)  # -(-x) rounds up
            short &= count[order] > 1
            keep = order[short]
            take = pa.array(rows[short])
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), *(batch.column(k).take(take) for k in (0, 1, 2)), pa.array(n[rows[short]] - place[short]),
                                              *(batch.column(k).take(take) for k in range(4, 4 + WORDS))], ["s", "cid", "comp", "n", "left", *MAPS])

    near = sets.join(labels, "cid").select("cid", "comp", "n", "hs", *MAPS).mapInArrow(
        first, "s bigint, cid binary, comp binary, n bigint, left bigint, " + ", ".join(f"{m} bigint" for m in MAPS))
    near = written(near, "prefixes")
    per = near.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("most"))
    few = near.join(per.where("comps > 1").select("s", F.col("most.comp").alias("main")), "s").where("comp != main").drop("main")
    few = written(few, "minor")
    other = near.select("s", F.col("cid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("left").alias("left_b"),
                        *[F.col(m).alias(f"b{i}") for i, m in enumerate(MAPS)])
    enough = F.least("left", "left_b") * (100 + percent) >= (F.col("n") + F.col("nb")) * percent
    pairs = few.join(other, "s").where((F.col("comp") != F.col("cb")) & enough & maps_allow("m", "b", "n", "nb", percent))
    return pairs.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()


def contract(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): connected components by random hooking.

    Each pass hooks a node to the least of its neighbourhood under a new random order and replaces the
    edges' ends, until no edge is left; a path shrinks by a constant factor a pass.  Every pass is a written
    table; nothing but a yes/no reaches the driver.
    """
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), f"{name}-nodes")
    edges, turn = written(edges.distinct(), f"{name}-edges"), 0
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        order = [F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("x")) for x in ("a", "b")]
        hook = both.groupBy("a").agg(F.min(order[1]).alias("m")).select(
            "a", F.least(F.col("m"), order[0])["x"].alias("to"))
        hook = written(hook, f"{name}-hook")
        nodes = written(nodes.join(hook.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-nodes")
        moved = edges.join(hook.select("a", F.col("to").alias("ta")), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        edges = written(moved.where("ta != tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), f"{name}-edges")
        turn += 1
    return nodes


def merge(labels: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """Labels (cid, comp) after joining the components that ``links`` (a, b) connect."""
    of_a, of_b = (labels.select(F.col("cid").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    ends = links.join(of_a, "a").join(of_b, "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = contract(ends, f"round{turn}")
    return written(labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("cid", F.coalesce("root", "comp").alias("comp")), "labels")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, rounds: int = 3, picks: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``size``-word shingles
    (words are runs without ASCII white space, A-Z lowered; fewer words give the whole sequence as one shingle).
    ``component_id`` is the smallest doc_id that links reach.  Null, empty and blank texts have an empty set
    and link with nothing.  Rows with equal sets are one class and linked.  Rows that repeat a doc_id share
    its fate; null ids are never the smallest.  An empty table gives an empty result; other columns are
    ignored.  With ``picks`` there are two more columns: pick, the hash of a row's id and text, and stands, true for
    one (id, text) of each component: the smallest doc_id, null last, then the smallest pick.

    Candidates share a table key.  In each of ``rounds`` every table compares its members with one pivot,
    members that are already connected aside, so a large group costs a few comparisons a member; after that
    all remaining pairs of candidates that lie in different components and can reach the threshold are
    compared.  So no link is lost.
    """
    half = halves_for(percent)
    sig = written(signatures(docs, size, half), "signatures")
    classes = sig.where("cid is not null").groupBy("cid", "n", "keys").agg(F.min("pick").alias("pick"))
    halves = classes.select("cid", "n", "pick", F.posexplode("keys").alias("pos", "k"))
    shared = halves.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    hit = halves.join(shared, "k").groupBy("cid", "n", "pick").agg(
        F.collect_set(F.when(F.col("pos") < half, F.col("k"))).alias("x"), F.collect_set(F.when(F.col("pos") >= half, F.col("k"))).alias("y"))
    hit = written(hit.where((F.size("x") > 0) & (F.size("y") > 0)), "hits")  # at most ``half`` keys in each list
    tables = hit.select("cid", "n", "y", F.explode("x").alias("kx")).select("cid", "n", "kx", F.explode("y").alias("ky"))
    tables = tables.select("cid", "n", F.xxhash64("kx", "ky").alias("key"))
    crowded = tables.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    tables = written(tables.join(crowded, "key"), "tables")
    # Each round reads sets and maps by cid: bucketed by it, only pairs move.
    sets = bucketed(full_sets(docs, hit.join(tables.select("cid").distinct(), "cid", "left_semi").select("pick", "cid"), size), "cid", "sets")

    labels = written(tables.select("cid").distinct().select("cid", F.col("cid").alias("comp")), "labels")
    tried = None
    for turn in range(rounds + 1):
        if turn < rounds:
            now = tables.join(labels, "cid")
            pivots = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                            F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "comp", "n")).alias("p"))
            pivots = pivots.where("lo != hi").select("key", F.col("p.cid").alias("b"), F.col("p.comp").alias("cb"), F.col("p.n").alias("nb"))
            pairs = now.join(pivots, "key").where((F.col("comp") != F.col("cb")) & close_enough(F.col("n"), F.col("nb"), percent))
            pairs = pairs.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()
        else:
            pairs = prefix_pairs(sets, labels, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, f"pairs{turn}")
        if pairs.limit(1).count() == 0:
            continue
        labels = merge(labels, written(verify(pairs, sets, percent), f"links{turn}"), turn)
        tried = pairs if tried is None else tried.union(pairs)

    pick = ["pick"] if picks else []
    rows = sig.select("doc_id", "n", "cid", *pick).where("cid is not null").join(labels, "cid", "left").select(
        "doc_id", "n", F.coalesce("comp", "cid").alias("comp"), *pick)
    rows = written(rows, "rows")
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pick")).alias("first")] if picks else []
    stands = [(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pick") == F.col("first.pick"))).alias("stands")] if picks else []
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"), *first)
    linked = rows.join(least, "comp").select("doc_id", "n", "component_id", *pick, *stands)
    blank = sig.where("cid is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), *pick, *([F.lit(True).alias("stands")] if picks else []))
    every = linked.unionByName(blank)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                        *(["pick", "stands"] if picks else []))
