"""Prefix trie of conversations: double-array tries over prefix shards, upper nodes merged globally.

Turns become 128-bit keys; each conversation is cut into blocks of bounded length, and equal blocks after equal
prefixes are folded before anything is gathered.  A shard is everything below one prefix: first turns to begin with, and
longer prefixes wherever a shard would hold too many turns, so a first turn (or a long opening) that a third of all
conversations share is split.  Whole shards are packed into bins.  The task of a bin numbers its turns densely, packs
a double array (BASE and CHECK), and walks all paths through it to gather members, children and subtree sums.  Nodes
above the shards occur in several bins; their partial sums are merged by a grouped aggregate.  Blocks are worked from
the deepest to the first, and hand the totals below their root to the block that ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scour.llm.common import written

#: Turns of one conversation that may stand in a row.
BLOCK = 512
#: Turns (after folding) that a shard may hold before it is split, and that a bin is filled up to.
SHARD_TURNS = 50_000
#: Fixed values of the contract: conversations borrow from c - c % FAMILY the first crc32(c) % HEAD turns.
FAMILY, HEAD = 5, 9
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
FREE = -1
#: Cells looked at together when a place is sought.
SCAN = 4096


class DoubleArray:
    """A static trie in two arrays: the child of state s by symbol c is t = BASE[s] + c, if CHECK[t] = s.

    States 0 .. roots - 1 are roots.  Built from distinct (parent node, symbol) edges given level by level.
    """

    def __init__(self, roots: int, symbols: int):
        self.roots, self.symbols = roots, symbols
        self.base = np.zeros(max(roots, 1), np.int64)
        self.check = np.full(max(roots, 1), FREE, np.int64)
        self.filled = self.full = roots

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, FREE, np.int64)])

    def _place(self, span: np.ndarray) -> int:
        """The first cell t from which all t + span are free.  Cells behind the filled ones are free."""
        while self.full < self.filled and self.check[self.full] != FREE:
            self.full += 1
        width = int(span[-1])
        for low in range(self.full, self.filled, SCAN):
            high = min(low + SCAN, self.filled)
            self._grow(high + width + 1)
            at = np.flatnonzero(self.check[low:high] == FREE) + low
            for gap in span[1:]:
                if not len(at):
                    break
                at = at[self.check[at + gap] == FREE]
            if len(at):
                return int(at[0])
        return self.filled

    def add_level(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Pack the children of one level's states; edges come sorted by (state, symbol).  Returns the child states.

        States with several children are placed first, the largest first, each from the first cell where all its
        children meet free cells; the others' children then fill the cells that are left free.
        """
        first = np.flatnonzero(np.r_[True, states[1:] != states[:-1]]) if len(states) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(states)])
        out = np.zeros(len(states), np.int64)
        for f, c in sorted(zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True), key=lambda x: -x[1]):
            own = symbols[f:f + c]
            span = own - own[0]
            at = self._place(span)
            self._grow(at + int(span[-1]) + 1)
            cells = at + span
            self.base[states[f]] = at - own[0]
            self.check[cells] = states[f]
            self.filled = max(self.filled, int(cells[-1]) + 1)
            out[f:f + c] = cells
        alone = first[count == 1]
        if len(alone):
            free = np.flatnonzero(self.check[self.roots:self.filled] == FREE)[:len(alone)] + self.roots
            rest = len(alone) - len(free)
            self._grow(self.filled + rest)
            cells = np.concatenate([free, np.arange(self.filled, self.filled + rest)])
            self.filled += rest
            self.base[states[alone]] = cells - symbols[alone]
            self.check[cells] = states[alone]
            out[alone] = cells
        return out

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``symbols``, or -1."""
        t = self.base[states] + symbols
        inside = (t >= 0) & (t < self.filled)
        return np.where(inside & (self.check[np.where(inside, t, 0)] == states), t, -1)


def shard_nodes(root: np.ndarray, offsets: np.ndarray, key: np.ndarray, mixed: np.ndarray, size: np.ndarray, level: np.ndarray,
                members: np.ndarray, smallest: np.ndarray, tail: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of the trie of distinct paths (those of one bin).

    A path i is key[offsets[i]:offsets[i+1]] (rows of two 64-bit numbers) after the root state root[i]; ``mixed`` has
    what each turn adds to the node's id, ``size`` its bytes, ``level`` the depth of its shard's prefix, ``tail``
    (children, leaves, saved) of what follows the path.  For nodes above their shard (``upper``) leaves and saved hold
    only what lies in shards here, and members only those of this bin.
    """
    n_paths, length = len(root), np.diff(offsets)
    # Dense ids in the order of first use, level by level and parent by parent, so that siblings' ids are close.
    _, first, dense = np.unique(key.view([("a", key.dtype), ("b", key.dtype)]).ravel(), return_index=True, return_inverse=True)
    dense, rank, given = dense.ravel(), np.full(len(first), -1), 0
    node = root.astype(np.int64)
    for d in range(int(length.max()) if n_paths else 0):
        on = np.flatnonzero(length > d)
        pair, inverse = np.unique(node[on] * len(first) + dense[offsets[on] + d], return_inverse=True)
        node[on] = inverse.ravel()
        turns, at = np.unique(pair % len(first), return_index=True)
        new = rank[turns] < 0
        order = turns[new][np.argsort(at[new], kind="stable")]
        rank[order] = np.arange(given, given + len(order))
        given += len(order)
    symbol = rank[dense]
    n_symbols, n_roots = len(first), int(root.max()) + 1 if n_paths else 0
    trie = DoubleArray(n_roots, n_symbols)
    state = root.astype(np.int64).copy()
    levels = []
    for d in range(int(length.max()) if n_paths else 0):
        on = np.flatnonzero(length > d)
        pair, inverse = np.unique(state[on] * n_symbols + symbol[offsets[on] + d], return_inverse=True)
        cells = trie.add_level(pair // n_symbols, pair % n_symbols)
        state[on] = cells[inverse.ravel()]
        levels.append(cells)
    total = trie.filled
    out = {"members": np.zeros(total, np.int64), "smallest": np.full(total, np.iinfo(np.int64).max), "bytes": np.zeros(total, np.int64),
           "depth": np.zeros(total, np.int64), "upper": np.zeros(total, bool), "id": np.zeros((total, 2), np.int64),
           "children": np.zeros(total, np.int64), "leaves": np.zeros(total, np.int64), "saved": np.zeros(total, np.int64)}
    # Walk every path through the packed arrays.
    state = root.astype(np.int64).copy()
    out["upper"][:n_roots] = True
    for d in range(len(levels)):
        on = np.flatnonzero(length > d)
        at = offsets[on] + d
        found = trie.step(state[on], symbol[at])
        if (found < 0).any():
            raise AssertionError("a path leaves the double array")
        out["id"][found] = out["id"][state[on]] ^ mixed[at]
        out["depth"][found], out["bytes"][found] = d + 1, size[at]
        np.add.at(out["members"], found, members[on])
        np.minimum.at(out["smallest"], found, smallest[on])
        out["upper"][found] = d + 1 < level[on]
        state[on] = found
    np.add.at(out["children"], state, tail[:, 0])
    np.add.at(out["leaves"], state, tail[:, 1])
    np.add.at(out["saved"], state, tail[:, 2])
    for cells in reversed(levels):
        below = ~out["upper"][cells]
        own = cells[below]
        out["leaves"][own] += out["children"][own] == 0
        out["saved"][own] += (out["members"][own] - 1) * out["bytes"][own]
        parents = trie.check[cells]
        np.add.at(out["children"], parents, 1)
        np.add.at(out["leaves"], parents, out["leaves"][cells])
        np.add.at(out["saved"], parents, out["saved"][cells])
    out["parent"], out["cells"] = trie.check[:total], np.concatenate(levels) if levels else np.zeros(0, np.int64)
    return out


def _positions(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (the turn's 128-bit key), size (bytes of its text).

    Rows are sorted in ranges, so a conversation of any length is spread over tasks; a row's position is its place in
    its range and conversation plus what earlier ranges hold of the conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("k1"),
        F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint").alias("k2"), F.octet_length(text).cast("bigint").alias("size"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(rows.select("conv_id", "k1", "k2", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")), "turns")
    runs = rows.groupBy("conv_id", "part").agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.col("i0") - F.coalesce(F.sum("n").over(earlier), F.lit(0)) - 1).alias("shift"))
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("i") - F.col("shift")).alias("pos"), "k1", "k2", "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, size) for each turn of the rebuilt conversations, and their (conv_id, total) turns."""
    turns = written(_positions(conversations), "positions")
    heads = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = heads.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("giver"), (F.crc32(F.col("conv_id").cast("string")) % HEAD).alias("h"), "n")
    convs = convs.join(heads.select(F.col("conv_id").alias("giver"), F.col("n").alias("given")), "giver", "left")
    convs = written(convs.select("conv_id", "giver", "h", "n", F.least("h", F.coalesce("given", F.lit(0))).alias("given")), "conversations")
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= HEAD - 1)).withColumnRenamed("conv_id", "giver").join(
        convs.select("giver", "conv_id", "h"), "giver").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "k1", "k2", "size")
    own = turns.join(convs.select("conv_id", "h", "given"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "k1", "k2", "size")
    totals = convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    return lent.unionByName(own), totals


_PATH = "array<struct<k1:bigint,k2:bigint,m1:bigint,m2:bigint,size:bigint>>"


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, b, path, x1, x2, e1, e2): the b-th block of a conversation, and the ids of the nodes where it starts and ends.

    A node's id is the exclusive or of what each of its turns adds by its key and depth.
    """
    turn = F.struct("depth", "k1", "k2", F.xxhash64("k1", "k2", "depth").alias("m1"), F.xxhash64("depth", "k2", "k1", F.lit(1)).alias("m2"), "size")
    rows = turns.select("conv_id", F.expr(f"(depth - 1) div {block}").alias("b"), turn.alias("t"))
    # At most ``block`` turns a group.
    got = rows.groupBy("conv_id", "b").agg(F.sort_array(F.collect_list("t")).alias("t"), F.expr("bit_xor(t.m1)").alias("y1"), F.expr("bit_xor(t.m2)").alias("y2"))
    got = got.withColumn("path", F.transform("t", lambda t: F.struct(t.k1.alias("k1"), t.k2.alias("k2"), t.m1.alias("m1"), t.m2.alias("m2"), t.size.alias("size"))))
    got = written(got.select("conv_id", "b", "path", "y1", "y2"), "blocks")
    zero = F.lit(0).cast("bigint")
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    x = [F.coalesce(F.expr(f"bit_xor({y})").over(before), zero).alias(n) for y, n in (("y1", "x1"), ("y2", "x2"))]
    long = got.groupBy("conv_id").agg(F.max("b").alias("last")).where("last > 0").select("conv_id")
    if long.limit(1).count() == 0:
        out = got.withColumns({"x1": zero, "x2": zero})
    else:  # only conversations of several blocks need a running id
        out = got.join(long, "conv_id", "left_anti").withColumns({"x1": zero, "x2": zero}).unionByName(
            got.join(long, "conv_id", "left_semi").select("conv_id", "b", "path", "y1", "y2", *x))
    return out.select("conv_id", "b", "path", "x1", "x2", F.col("x1").bitwiseXOR(F.col("y1")).alias("e1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("e2"))


def _shards(paths: DataFrame, limit: int) -> DataFrame:
    """``paths`` with s (hash of the shard's prefix) and level (its length).  Shards of over ``limit`` turns are split one
    turn deeper until they fit; distinct paths differ at their ends at the latest, and a path that has ended stays alone."""
    def at(level: int, s):
        return F.xxhash64(s, F.try_element_at("path.m1", F.lit(level)), F.try_element_at("path.m2", F.lit(level)))

    done, todo, level = [], paths.withColumn("s", at(1, F.xxhash64("x1", "x2"))), 1
    while True:
        heavy = todo.groupBy("s").agg(F.sum(F.size("path")).alias("w"), F.max(F.size("path")).alias("far")).where((F.col("w") > limit) & (F.col("far") > level)).select("s")
        heavy = written(heavy, "heavy")
        if heavy.limit(1).count() == 0:
            break
        done.append(todo.join(heavy, "s", "left_anti").withColumn("level", F.lit(level)))
        todo = written(todo.join(heavy, "s", "left_semi").withColumn("s", at(level + 1, F.col("s"))), "split")
        level += 1
    out = todo.withColumn("level", F.lit(level))
    for part in done:
        out = out.unionByName(part)
    return out


_NODE = ("x1 bigint, x2 bigint, depth bigint, p1 bigint, p2 bigint, upper boolean, under boolean, n_convs bigint, conv_id bigint, bytes bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, above array<struct<x1:bigint,x2:bigint>>")


def _bin_nodes(start: int):
    """The function of a bin: rows (_PATH and its facts) to nodes; ``start`` is the depth where the block begins."""
    ints = pa.int64()
    above_type = pa.list_(pa.struct([("x1", ints), ("x2", ints)]))

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        col = {n: t[n].to_numpy() for n in ("x1", "x2", "level", "members", "smallest", "t_children", "t_leaves", "t_saved")}
        path = t["path"].chunk(0) if t["path"].num_chunks else pa.array([], t["path"].type)
        offsets = path.offsets.to_numpy().astype(np.int64)
        flat = path.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        part = {n: flat.field(i).to_numpy(zero_copy_only=False) for i, n in enumerate(("k1", "k2", "m1", "m2", "size"))}
        starts, root = np.unique(np.stack([col["x1"], col["x2"]], 1), axis=0, return_inverse=True)
        # Ids count from the block's root here; the root's own id is put in after the walk.
        nodes = shard_nodes(root.ravel(), offsets, np.ascontiguousarray(np.stack([part["k1"], part["k2"]], 1)), np.stack([part["m1"], part["m2"]], 1), part["size"],
                            col["level"], col["members"], col["smallest"], np.stack([col["t_children"], col["t_leaves"], col["t_saved"]], 1))
        n_roots = len(starts)
        ids, parent = nodes["id"], nodes["parent"]
        owner = np.full(len(ids), -1)
        owner[:n_roots] = np.arange(n_roots)
        cells = nodes["cells"]
        for c in (cells[nodes["depth"][cells] == d] for d in range(1, int(nodes["depth"].max()) + 1)):
            owner[c] = owner[parent[c]]
        real = np.concatenate([np.arange(n_roots), cells])
        ids[real] ^= starts[owner[real]]
        up = np.where(real < n_roots, real, parent[real])
        above = []
        for s in real[nodes["upper"][real]].tolist():
            line, at = [], s
            while at >= n_roots:
                at = int(parent[at])
                line.append((int(ids[at, 0]), int(ids[at, 1])))
            above.append([{"x1": a, "x2": b} for a, b in line])
        line_of = iter(above)
        is_root = real < n_roots
        none = np.iinfo(np.int64).max
        least = nodes["smallest"][real]
        return pa.table({
            "x1": ids[real, 0], "x2": ids[real, 1], "depth": nodes["depth"][real] + start,
            "p1": pa.array(ids[up, 0], ints, mask=is_root), "p2": pa.array(ids[up, 1], ints, mask=is_root),
            "upper": nodes["upper"][real], "under": nodes["upper"][up] & ~is_root, "n_convs": nodes["members"][real],
            "conv_id": pa.array(least, ints, mask=least == none), "bytes": nodes["bytes"][real], "n_children": nodes["children"][real],
            "n_leaves": nodes["leaves"][real], "saved_tokens": nodes["saved"][real],
            "above": pa.array([next(line_of) if u else None for u in nodes["upper"][real].tolist()], above_type)})

    return run


def _block_nodes(paths: DataFrame, start: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The complete nodes of one block's trie, and its roots with their totals (x1, x2, n_children, n_leaves, saved_tokens)."""
    sharded = written(_shards(paths, limit), "shards")
    weight = sharded.agg(F.sum(F.size("path"))).first()[0] or 0
    bins = max(1, -(-weight // limit))
    found = sharded.withColumn("bin", F.pmod("s", F.lit(bins))).groupBy("bin").applyInArrow(_bin_nodes(start), _NODE)
    found = written(found, "nodes")
    whole = found.where("not upper")
    upper = found.where("upper").groupBy("x1", "x2", "depth").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("above").alias("above"))
    children = found.where("under").select("x1", "x2", "p1", "p2", "depth").distinct().groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    upper = written(upper.join(children, ["x1", "x2"], "left"), "upper")
    # An upper node's own weight belongs to it and to the upper nodes above it.
    own = F.when(F.col("depth") > start, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(F.lit(0))
    weights = upper.select(own.alias("w"), F.explode(F.concat("above", F.array(F.struct("x1", "x2")))).alias("a")).groupBy(
        F.col("a.x1").alias("x1"), F.col("a.x2").alias("x2")).agg(F.sum("w").alias("w"))
    upper = upper.join(weights, ["x1", "x2"], "left").withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("w", F.lit(0)))
    names = ["x1", "x2", "depth", "p1", "p2", "n_convs", "conv_id", "bytes", "n_children", "n_leaves", "saved_tokens"]
    upper = written(upper.select(*names), "upper")
    return whole.select(*names).unionByName(upper.where(F.col("depth") > start)), upper.where(F.col("depth") == start).select(
        "x1", "x2", "n_children", "n_leaves", "saved_tokens")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(x1, x2, depth, ends_sha256) of the conversations (x1, x2, depth, conv_id) that end at a node.

    Ids are first gathered by 4096 consecutive numbers, at most so many a row; the digest runs over a node's sorted rows
    as they stream by.  It goes from the smallest id to the largest by definition, so one task takes a node's ids.
    """
    runs = ends.groupBy("x1", "x2", "depth", F.floor(F.col("conv_id") / 4096).alias("run")).agg(F.sort_array(F.collect_set("conv_id")).alias("ids"))
    runs = runs.repartition("x1", "x2", "depth").sortWithinPartitions("x1", "x2", "depth", "run")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, hashes = [], []
            for *now, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = ",".join(map(str, ids)).encode()
                if now == node:
                    state.update(b"," + text)
                else:
                    if node is not None:
                        nodes.append(node)
                        hashes.append(state.hexdigest())
                    node, state = now, hashlib.sha256(text)
            yield rows(nodes, hashes)
        if node is not None:
            yield rows([node], [state.hexdigest()])

    def rows(nodes: list, hashes: list) -> pa.RecordBatch:
        cols = [pa.array([n[i] for n in nodes], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(hashes, pa.string())], ["x1", "x2", "depth", "ends_sha256"])

    return runs.select("x1", "x2", "depth", "ids").mapInArrow(digest, "x1 bigint, x2 bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns that tie by their content's hash, and repeated rows each count as a
    turn.  Null role or text is empty.  Rows without a conv_id belong to no conversation and are left out.  ``%`` keeps
    the sign of conv_id.  An empty table gives an empty result (a root without members has no conv_id); other columns
    are ignored.  ``block`` and ``shard_turns`` bound what a task holds; any values give the same result.
    """
    turns, totals = rebuilt(conversations)
    blocks = written(_blocks(turns, block), "paths")
    folded = blocks.groupBy("b", "x1", "x2", "e1", "e2").agg(F.any_value("path").alias("path"), F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("smallest"))
    folded = written(folded, "folded")
    last = folded.agg(F.max("b")).first()[0]
    nodes: DataFrame | None = None
    below: DataFrame | None = None
    tails = ["t_children", "t_leaves", "t_saved"]
    for b in range(-1 if last is None else last, -1, -1):
        paths = folded.where(F.col("b") == b)
        if below is None:
            paths = paths.withColumns({t: F.lit(0).cast("bigint") for t in tails})
        else:
            after = below.select(F.col("x1").alias("e1"), F.col("x2").alias("e2"), *[F.col(c).alias(t) for c, t in zip(("n_children", "n_leaves", "saved_tokens"), tails, strict=True)])
            paths = paths.join(after, ["e1", "e2"], "left").withColumns({t: F.coalesce(t, F.lit(0)) for t in tails})
        found, below = _block_nodes(paths, b * block, shard_turns)
        nodes = found if nodes is None else nodes.unionByName(found)
    names = ["x1", "x2", "depth", "p1", "p2", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"]
    zero = F.lit(0).cast("bigint")
    everyone = totals.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = everyone.select(zero.alias("x1"), zero.alias("x2"), zero.alias("depth"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"), "n_convs", "conv_id")
    if below is None:  # no conversation has a turn
        nodes = root.withColumns({"n_children": zero, "n_leaves": F.lit(1).cast("bigint"), "saved_tokens": zero})
    else:
        sums = ["n_children", "n_leaves", "saved_tokens"]
        both = root.unionByName(below.select(*sums), allowMissingColumns=True)
        nodes = nodes.select(*names).unionByName(both.agg(*[F.max(c).alias(c) for c in names]).where("n_convs is not null"))
    final = blocks.join(totals, "conv_id").where((F.col("b") + 1) * block >= F.col("total")).select(F.col("e1").alias("x1"), F.col("e2").alias("x2"), F.col("total").alias("depth"), "conv_id")
    none = totals.where("total = 0").select(zero.alias("x1"), zero.alias("x2"), zero.alias("depth"), "conv_id")
    nodes = written(nodes, "trie").join(_end_hashes(final.unionByName(none)), ["x1", "x2", "depth"], "left")
    nodes = written(nodes, "trie")
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["p1", "p2", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
