"""Exact, reproducible splits: train/test (D-1), percent split (D-2), K folds (D-3),
row counts (D-4) and stratified train/test (X2).

Rows are ordered by ``md5(seed:key)``, or by the key columns themselves when not shuffling, then by a 120-bit
hash of their content.  Instead of sorting rows, the split points are selected by radix passes (``radix.select``) and
each row's side is a comparison with a few literals - a projection, no shuffle of rows.  Where a split point falls
into a group of identical rows, that group is replaced by as many copies of its row, numbered, so the sizes are exact
and don't depend on how rows are dealt over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.functions import radix
from scour.functions.exprs import qcol
from scour.session import cut_lineage

#: Copies of an identical row that one task makes at once.
COPIES = 100_000


def key_text(df: DataFrame, key=None) -> Column:
    """Text identity of a row: the key column(s), or every column when no key is given."""
    if key is None:
        key = df.columns
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.coalesce(qcol(k).cast("string"), F.lit("\u0000")) for k in keys]
    return parts[0] if len(parts) == 1 else F.concat_ws("\u0001", *parts)


def _hex_words(digest: Column, count: int) -> list[Column]:
    """The leading ``count`` words of a hex digest, 15 digits each and so never negative; the last may have fewer."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(count)]


def shuffle_words(df: DataFrame, key=None, seed: int = 42) -> list[Column]:
    """All 128 bits of md5('<seed>:<key>') as words in the order of the hex text."""
    return _hex_words(F.md5(F.concat(F.lit(f"{seed}:"), key_text(df, key))), 3)


def content_words(df: DataFrame) -> list[Column]:
    """120 bits that tell the contents of rows apart."""
    parts = [F.coalesce(F.xxhash64(qcol(c), F.lit(i)), F.lit(0)).cast("string") for i, c in enumerate(df.columns)]
    twice = [F.xxhash64(F.lit(i), qcol(c)).cast("string") for i, c in enumerate(df.columns)]
    return _hex_words(F.md5(F.concat_ws(",", *parts, *twice, *[F.isnull(qcol(c)).cast("string") for c in df.columns])), 2)


class _Order:
    """The words that rows are ordered by, one after the other: the key's, then the content's."""

    def __init__(self, df: DataFrame, shuffle: bool, seed: int, key):
        self.content = content_words(df)
        if shuffle:
            self.fixed = shuffle_words(df, key, seed)
            self.key = None
        else:
            if key is None:
                raise ValueError("shuffle=False needs the key column or columns that give the order of rows")
            self.fixed, self.key = [], radix.Words(df, [key] if isinstance(key, str) else list(key))

    def walk(self, values: list[int]):
        """The word that follows after ``values`` were found in the words before, or None after the last."""
        if self.key is not None:
            it = self.key.start()
            word, at = next(it, None), 0
            while word is not None and at < len(values):
                try:
                    word = it.send(values[at])
                except StopIteration:
                    word = None
                at += 1
            if word is not None:
                return word
            values = values[at:]
        words = self.fixed + self.content
        return words[len(values)] if len(values) < len(words) else None


@dataclass
class _Cut:
    """Rows at or below a split point: a path of (word, value); of the identical rows at its end ``take`` are below
    (None: all of ``eq``)."""

    path: list
    take: int | None = None
    eq: int = 0
    all: bool | None = None

    def below(self) -> Column:
        if self.all is not None:
            return F.lit(self.all)
        word, value = self.path[-1]
        out = word <= F.lit(value).cast("bigint")
        for word, value in reversed(self.path[:-1]):
            v = F.lit(value).cast("bigint")
            out = (word < v) | ((word == v) & out)
        return out

    def same(self) -> Column:
        out = F.lit(True)
        for word, value in self.path:
            out = out & (word == F.lit(value).cast("bigint"))
        return out


def _cuts(df: DataFrame, order: _Order, counts: list[int], n: int) -> list[_Cut]:
    """A cut for each of ``counts`` (rows that must fall at or below it)."""
    cuts: dict[int, _Cut] = {c: _Cut([], all=c >= n) for c in counts if not 0 < c < n}
    # groups of equal leading words that hold split points: values -> (path, count -> rows still to take, rows)
    open_groups = {(): ([], {c: c for c in counts if 0 < c < n}, n)}
    while open_groups:
        after: dict = {}
        for values, (path, wanted, eq) in open_groups.items():
            word = order.walk(list(values))
            if not wanted:
                continue
            if word is None:
                cuts.update({c: _Cut(path, take, eq) for c, take in wanted.items()})
                continue
            rows = df
            for w, v in path:
                rows = rows.where(w == F.lit(v).cast("bigint"))
            known = {"w": (n, 0, (1 << 60) - 1)} if order.fixed and not values else None
            found = radix.select(rows, {"w": word}, [("w", take - 1) for take in wanted.values()], known=known)
            for c, take in wanted.items():
                s = found["w", take - 1]
                here = path + [(word, s.code)]
                if take - s.lt == s.eq:
                    cuts[c] = _Cut(here)
                else:
                    after.setdefault((*values, s.code), (here, {}, s.eq))[1][c] = take - s.lt
        open_groups = after
    return [cuts[c] for c in counts]


def _copies(one: DataFrame, eq: Column, columns: list[str]) -> DataFrame:
    """Each row ``r`` of ``one`` as many times as ``eq`` says, with its number ``pos`` from 1; made in pieces that any
    task can take."""
    pieces = one.withColumn("eq", eq).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(eq - 1) div {COPIES}"))))
    pieces = pieces.repartition(F.col("piece"), F.col("eq"))
    low = F.col("piece") * COPIES + 1
    return pieces.withColumn("pos", F.explode(F.sequence(low, F.least(low + (COPIES - 1), F.col("eq")))))


def _label(df: DataFrame, name: str, cuts: list[_Cut], build) -> DataFrame:
    """Add column ``name`` = build(list of below-conditions); one of that name is replaced."""
    columns = [c for c in df.columns if c != name]
    partial = [c for c in cuts if c.take is not None]
    plain = df.select(*[qcol(c) for c in columns], build([c.below() for c in cuts]).alias(name))
    if not partial:
        return plain
    # identical rows are interchangeable: each such group is taken out and made again, numbered
    groups = {tuple(v for _, v in c.path): c for c in partial}
    inside = F.lit(False)
    for g in groups.values():
        inside = inside | g.same()
    out = df.where(~inside).select(*[qcol(c) for c in columns], build([c.below() for c in cuts]).alias(name))
    for values, g in groups.items():
        row = F.struct(*[qcol(c).alias(f"f{i}") for i, c in enumerate(columns)]).alias("r")
        sides = [F.col("pos") <= c.take if c.take is not None and tuple(v for _, v in c.path) == values else F.element_at("sides", i + 1)
                 for i, c in enumerate(cuts)]
        one = df.where(g.same()).limit(1).select(row, F.array(*[c.below() for c in cuts]).alias("sides"))
        again = _copies(one, F.lit(g.eq).cast("bigint"), columns)
        out = out.unionByName(again.select(*[F.col(f"r.f{i}").alias(c) for i, c in enumerate(columns)], build(sides).alias(name)))
    return out


def train_test_split(df: DataFrame, test_size: float = 0.2, *, shuffle: bool = True, seed: int = 42,
                     key=None, min_rows: int = 10) -> DataFrame:
    """D-1: adds ``split`` ('train'/'test'); n_test = ceil(test_size * n).

    Shuffled: the n_test rows first in md5 order are the test set.  Unshuffled: the last n_test rows in the order of
    ``key``, one or several columns of any type that can be ordered, NULL first and NaN next.
    """
    if not 0.1 <= test_size <= 0.4:
        raise ValueError(f"test_size={test_size} lies outside [0.1, 0.4]")
    order = _Order(df, shuffle, seed, key)
    n = df.count()
    if n < min_rows:
        raise ValueError(f"{n} rows are too few to split; {min_rows} are needed")
    n_test = math.ceil(test_size * n)
    low, high = ("test", "train") if shuffle else ("train", "test")
    return _label(df, "split", _cuts(df, order, [n_test if shuffle else n - n_test], n), lambda b: F.when(b[0], low).otherwise(high))


def percent_split(df: DataFrame, percent: float, *, seed: int = 42, key=None) -> DataFrame:
    """D-2: train share = percent/100 clamped to [0.1, 0.95]; n_train = floor(share * n); rest test."""
    if not (0 < percent <= 100):
        raise ValueError("percent must be in (0, 100]")
    share = max(0.1, min(0.95, percent / 100.0))
    n = df.count()
    if n < 2:
        raise ValueError(f"{n} rows are too few for a percent split")
    order = _Order(df, True, seed, key)
    return _label(df, "split", _cuts(df, order, [n - math.floor(share * n)], n), lambda b: F.when(b[0], "test").otherwise("train"))


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def kfold(df: DataFrame, k: int = 5, *, shuffle: bool = True, seed: int = 42, key=None) -> DataFrame:
    """D-3: adds ``fold`` (1..k); the first n % k folds hold one extra row.  Unshuffled folds are consecutive in the
    order of ``key`` (any columns that can be ordered)."""
    if not 2 <= k <= 10:
        raise ValueError(f"k={k} lies outside [2, 10]")
    order = _Order(df, shuffle, seed, key)
    n = df.count()
    if n < 2 * k:
        raise ValueError(f"{n} rows are too few for {k} folds; two a fold are needed")
    ends = [sum(fold_sizes(n, k)[:i + 1]) for i in range(k - 1)]
    return _label(df, "fold", _cuts(df, order, ends, n), lambda below: sum((F.when(b, 0).otherwise(1) for b in below), F.lit(1)).cast("int"))


def fold_views(df: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """Train (fold != i) and validation (fold == i) views of a frame with a ``fold`` column."""
    return df.where(F.col("fold") != i), df.where(F.col("fold") == i)


def split_counts(df: DataFrame, by: str = "split") -> DataFrame:
    """D-4: rows per split (or per fold)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


def stratified_split(df: DataFrame, stratify, test_size: float = 0.2, *, seed: int = 42, key=None, **widths) -> DataFrame:
    """Per stratum (one or several columns, NULL a stratum of its own) the first ceil(test_size * n_s) rows in md5
    order are test.

    The cut-offs of all strata are found together by ``radix.select_by_group`` and joined back as a table, so there
    may be any number of strata and one may hold most rows.
    """
    if test_size <= 0 or test_size >= 1:
        raise ValueError("test_size must be in (0, 1)")
    strata = [stratify] if isinstance(stratify, str) else list(stratify)
    columns = [c for c in df.columns if c != "split"]
    g = [f"g{i}" for i in range(len(strata))]
    words = shuffle_words(df, key, seed) + content_words(df)
    names = [f"w{i}" for i in range(len(words))]
    rows = df.select(*[qcol(s).alias(a) for s, a in zip(strata, g, strict=True)], F.struct(*[qcol(c).alias(f"f{i}") for i, c in enumerate(columns)]).alias("r"),
                     *[w.alias(a) for w, a in zip(words, names, strict=True)])
    keyed = rows.select(*g, *names)
    sizes = keyed.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).select(*g, F.ceil(F.lit(float(test_size)) * F.col("n")).alias("need"), "n")
    sizes = cut_lineage(sizes)
    cuts = sizes.where("need >= n").select(*g, *[F.lit(None).cast("bigint").alias(a) for a in names], F.lit(None).cast("bigint").alias("take"), F.lit(None).cast("bigint").alias("eq"))
    todo = sizes.where("need < n").select(*g, "need")
    for level, name in enumerate(names):
        # rows that are equal in all words before, in strata that aren't settled yet
        found = radix.select_by_group(_matching(keyed, todo, g, names[:level]), todo.select(*g, "need"), g, name, cut_lineage, **widths)
        path = todo.select(*[F.col(c).alias(f"_{c}") for c in g], *names[:level])
        on = F.lit(True)
        for c in g:
            on = on & found[c].eqNullSafe(path[f"_{c}"])
        found = found.join(path, on).select(*g, "need", *names[:level], name, "eq")
        rest = [F.lit(None).cast("bigint").alias(a) for a in names[level + 1:]]
        whole = found.where("need = eq").select(*g, *names[:level + 1], *rest, F.lit(None).cast("bigint").alias("take"), F.lit(None).cast("bigint").alias("eq"))
        cuts = cuts.unionByName(whole)
        todo = cut_lineage(found.where("need < eq"))
        if todo.limit(1).count() == 0:
            todo = None
            break
    if todo is not None:
        cuts = cuts.unionByName(todo.select(*g, *names, F.col("need").alias("take"), "eq"))
    cuts = cut_lineage(cuts).select(*[F.col(c).alias(f"_{c}") for c in g], *[F.col(a).alias(f"v{i}") for i, a in enumerate(names)], "take", "eq")
    on = F.lit(True)
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = rows.join(cuts, on)
    below = F.lit(True)
    for i in reversed(range(len(names))):
        w, v = F.col(names[i]), F.col(f"v{i}")
        below = v.isNull() | (w < v) | ((w == v) & below)
    side = F.when(below, "test").otherwise("train").alias("split")
    out = [F.col(f"r.f{i}").alias(c) for i, c in enumerate(columns)]
    if todo is None:
        return joined.select(*out, side)
    same = F.col("take").isNotNull()
    for i, a in enumerate(names):
        same = same & (F.col(a) == F.col(f"v{i}"))
    # identical rows at a cut-off are folded to one row and made again, numbered
    one = joined.where(same).groupBy(*g, "take", "eq").agg(F.any_value("r").alias("r"))
    again = _copies(one.select("r", "take", F.col("eq").alias("copies")), F.col("copies"), columns)
    made = again.select(*out, F.when(F.col("pos") <= F.col("take"), "test").otherwise("train").alias("split"))
    return joined.where(~same).select(*out, side).unionByName(made)


def _matching(keyed: DataFrame, todo: DataFrame, g: list[str], names: list[str]) -> DataFrame:
    """Rows of ``todo``'s strata that equal its values in the words ``names``."""
    if not names:
        return keyed
    t = todo.select(*[F.col(c).alias(f"_{c}") for c in g], *[F.col(a).alias(f"_{a}") for a in names])
    on = F.lit(True)
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for a in names:
        on = on & (F.col(a) == F.col(f"_{a}"))
    return keyed.join(t, on).select(keyed.columns)
