"""Exact Jaccard join of word-shingle sets, with skipping by set relations.

Sets are equal, highly similar, or neither, and the join uses all three relations:

* Equal sets are merged first, by a 128-bit fingerprint; one representative stays for any number of copies.
* Highly similar sets are gathered in trees. Each representative meets the smallest id that shares a minimum under one
  of `HASHES` orders, so a group of n near copies costs n comparisons, not n^2. A verified meeting makes the smaller one the
  parent. Along the tree a set knows how many shingles it gained at most over its root.
* Between trees an index of prefix shingles (frequent ones last) finds candidates. Its lists hold one entry per tree;
  they are cut to blocks, and two blocks are skipped whole if their positions and sizes leave too little overlap. Counts of shingles in
  `BOXES` boxes bound the overlap of a pair that is left, so most texts need not travel to be compared. The answer of a
  tree's members is derived from the computed overlap of the roots plus what the members gained; only members that this bound
  leaves open, of trees in different components, meet and are compared.

So no link between different trees is lost, and links within a tree are not needed for the components.

Defined cases: null and empty texts have no shingle and link with nothing; fewer than five words make one shingle; rows
that repeat an id are one document; rows without id take no part and have no component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankfold.llm.common import materialize, rows_per_batch, told
from rankfold.llm.components import connected_components
from rankfold.llm.words import blocks, mix, shingles

K = 5
#: Sets link if 4 * intersection >= 3 * union, which is 7 * intersection >= 3 * (size + size).
PART, WHOLE = 3, 4
HASHES = 4
#: So many of the most frequent shingles are told to all tasks. They order the prefixes and decide no result.
FREQUENT_MOST = 1_000_000
#: Ids are broadcast up to so many bytes as plain columns.
BROADCAST_BYTES = 1 << 24
LIST_BLOCK = 256
#: An index list that may be longer is cut to parts of about this length, and each pair of parts is a task of its own.
LIST_PART = 20_000
#: A minimum that more than this share of the sets have is met by a broadcast of its first set; there are at most 1 / share of them.
HOT_SHARE = 0.001
#: Rows of shingles, index entries or pairs that a task holds before it passes them on.
HELD_ROWS = 1 << 18
#: Texts a task gets at a time.
TEXT_ROWS = 500

#: Shingles of a set are counted in so many boxes; sums of minima over the boxes bound an overlap from above.
BOXES = 1024

_SIGNATURE = "part int, doc_id long, n long, fp1 long, fp2 long, " + ", ".join(f"m{i} long" for i in range(HASHES)) + ", boxes binary"


def _sets(column: pa.Array, k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """`(row, sorted distinct shingle hashes)` of every row."""
    for block in blocks(column):
        shingle, _, limits = shingles(block, k)
        for row in range(block.hi - block.lo):
            yield block.lo + row, np.unique(shingle[limits[row]:limits[row + 1]])


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _boxes(s: np.ndarray) -> bytes:
    """Shingles in each box, by the top bits of their hashes; 255 stands for that many and more."""
    return np.minimum(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=BOXES), 255).astype(np.uint8).tobytes()


def _open_pairs(pairs: DataFrame, boxes: DataFrame, best: DataFrame) -> DataFrame:
    """The pairs `(a, b)` that may hold a link: seven times the bound of the roots' overlap makes up for what the best members of both lack.

    `boxes(id, boxes)` and `best(root, best)`: a thousand bytes a set travel, not texts. Boxes that are full on both sides leave a pair open.
    """
    joined = pairs
    for c in "ab":
        joined = joined.join(boxes.select(F.col("id").alias(c), F.col("boxes").alias(f"boxes_{c}")), c)
        joined = joined.join(best.select(F.col("root").alias(c), F.col("best").alias(f"best_{c}")), c)

    def judge(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(n, -1) for c in (2, 3))
            least = np.minimum(x, y)
            need = batch.column(4).to_numpy(zero_copy_only=False) + batch.column(5).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array((7 * least.sum(axis=1, dtype=np.int64) + need >= 0) | (least == 255).any(axis=1)))

    narrow = joined.select("a", "b", "boxes_a", "boxes_b", "best_a", "best_b")
    with rows_per_batch(pairs.sparkSession, 4 * TEXT_ROWS):
        return materialize(narrow.mapInArrow(judge, "a long, b long")).distinct()


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """Part 0: size, fingerprints and minima of every row. Part 1: `(shingle, texts)` of those frequent among texts read together.

    Counting within some million shingles at a time and adding up misses only those that are rare everywhere.
    """

    def packed(ids: list, rows: list, held: list, boxes: list) -> pa.RecordBatch:
        many, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        often = count >= 4
        values = np.array(rows, dtype=np.uint64).reshape(-1, 3 + HASHES).view(np.int64)
        extra, zeros = int(often.sum()), np.zeros(int(often.sum()), dtype=np.int64)
        columns = [pa.array(np.repeat([0, 1], [len(rows), extra]).astype(np.int32)), pa.array([*ids, *[None] * extra], pa.int64()),
                   pa.array(np.concatenate([values[:, 0], count[often]])), pa.array(np.concatenate([values[:, 1], _signed(many[often])]))]
        columns += [pa.array(np.concatenate([values[:, c], zeros])) for c in range(2, 3 + HASHES)]
        columns.append(pa.array([*boxes, *[None] * extra], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SIGNATURE.split(", ")])

    def sign(batches):
        ids, rows, held, boxes, size = [], [], [], [], 0
        for batch in batches:
            for i, (_, s) in zip(batch.column(0).to_pylist(), _sets(batch.column(1), k)):
                ids.append(i)
                boxes.append(_boxes(s) if len(s) else None)
                if len(s):
                    minima = [mix(s ^ np.uint64(0x51ED270B * (i + 1))).min() for i in range(HASHES)]
                    rows.append((len(s), s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(7))), *minima))
                    held.append(s)
                    size += len(s)
                else:
                    rows.append((0,) * (3 + HASHES))
                if size >= 4 * HELD_ROWS or len(rows) >= HELD_ROWS // 64:
                    yield packed(ids, rows, held, boxes)
                    ids, rows, held, boxes, size = [], [], [], [], 0
        yield packed(ids, rows, held, boxes)

    with rows_per_batch(docs.sparkSession, TEXT_ROWS):
        return materialize(docs.mapInArrow(sign, _SIGNATURE))


def _of(spark: SparkSession, docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Texts of the given ids. Up to BROADCAST_BYTES of narrow id rows are broadcast; more are joined by a shuffle."""
    few = ids.count() * 8 * len(ids.columns) <= BROADCAST_BYTES
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids[key])


def overlaps(docs: DataFrame, pairs: DataFrame, k: int = K) -> DataFrame:
    """`(a, b, na, nb, common)` of the pairs `(a, b)`, exact. Reads the texts once and keeps those that a pair asks for."""
    spark = docs.sparkSession
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = _of(spark, docs, ids, "id").select("id", "text").distinct()
    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")

    def compare(batches):
        for batch in batches:
            out = [(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))
                   for (_, x), (_, y) in zip(_sets(batch.column(2), k), _sets(batch.column(3), k))]
            numbers = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(numbers[:, i]) for i in range(3))],
                                             names=["a", "b", "na", "nb", "common"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    with rows_per_batch(spark, 256):
        return materialize(joined.mapInArrow(compare, "a long, b long, na long, nb long, common long"))


def _linked(row: DataFrame) -> DataFrame:
    return row.filter(f"{WHOLE} * common >= {PART} * (na + nb - common)")


def _meetings(nodes: DataFrame) -> DataFrame:
    """Distinct pairs `(a, b)` of representatives to be compared: `a` has the smallest id of those that share a minimum with `b`.

    The minima of all orders are rows of one table, so one aggregation and one join serve them all: a query for each order
    would have the driver keep as many times the tasks, broadcasts and generated code.
    """
    minima, same = [f"m{i}" for i in range(HASHES)], ["_order", "_minimum"]
    hot_size = nodes.count() * HOT_SHARE
    rows = nodes.select("rep", "n", *minima, F.posexplode(F.array(*minima)).alias(*same))
    first = rows.groupBy(*same).agg(F.min(F.struct("rep", "n", *minima)).alias("f"), F.max("rep").alias("last"), F.count("*").alias("sets"))
    first = materialize(first.filter("last > f.rep"))
    agree = sum((F.col(x) == F.col(f"f.{x}")).cast("int") for x in minima)
    like = (WHOLE * F.least("n", "f.n") >= PART * F.greatest("n", "f.n")) & (agree >= 2) & (F.col("f.rep") < F.col("rep"))
    # A minimum of very many sets: they stay where they are. At most HASHES / HOT_SHARE rows are broadcast.
    hot = F.broadcast(first.filter(F.col("sets") > hot_size))
    others = rows.join(hot.select(*same), same, "left_anti").join(first.filter(F.col("sets") <= hot_size), same)
    met = [m.filter(like).select(F.col("f.rep").alias("a"), F.col("rep").alias("b")) for m in (rows.join(hot, same), others)]
    return met[0].union(met[1]).distinct()


def _trees(nodes: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """`(rep, n, root, gained)` of every representative, and the verified links `(a, b)` that made the trees.

    Only meetings of like size that agree in two minima are compared; the index finds what this leaves out.
    """
    links = materialize(_linked(overlaps(docs, materialize(_meetings(nodes)), k)))
    best = F.max(F.struct((F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("j"), (-F.col("a")).alias("low")))
    parents = links.groupBy(F.col("b").alias("rep")).agg(best.alias("p")).select("rep", (-F.col("p.low")).alias("root"))
    tree = materialize(nodes.select("rep", "n").distinct().join(parents, "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("root")))
    while True:  # parents have smaller ids, so jumping ends at roots
        up = tree.filter("root <> rep").select(F.col("rep").alias("at"), F.col("root").alias("next"))
        moved = materialize(tree.join(told(up)(up), F.col("root") == F.col("at"), "left").select(
            "rep", "n", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("changed")))
        tree = moved.drop("changed")
        if not moved.filter("changed").limit(1).count():
            break
    # What each member has over its root, counted directly.
    known = links.select("a", "b", "nb", "common")
    pairs = tree.filter("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b")).distinct()
    far = overlaps(docs, materialize(pairs.join(known, ["a", "b"], "left_anti")), k).select("a", "b", "nb", "common")
    gained = known.unionByName(far).groupBy(F.col("a").alias("root"), F.col("b").alias("rep")).agg(F.max(F.col("nb") - F.col("common")).alias("gained"))
    size = F.count("*").over(Window.partitionBy("root"))
    tree = tree.join(gained, ["root", "rep"], "left").select("rep", "n", "root", F.coalesce("gained", F.lit(0)).alias("gained"))
    return materialize(tree.withColumn("alone", size == 1)), links.select("a", "b")


def prefix_length(n):
    """Of two linked sets, some common shingle lies within this many first ones of either."""
    return n - -(-PART * n // WHOLE) + 1


def _shingle_counts(docs: DataFrame, ids: DataFrame, key: str, k: int) -> DataFrame:
    """`(shingle, texts)` of the shingles that several of the texts have."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        shingle, texts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(_signed(shingle)), pa.array(texts)], names=["shingle", "texts"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, s in _sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size >= 4 * HELD_ROWS:
                    yield packed(held)
                    held, size = [], 0
        yield packed(held)

    rows = _of(docs.sparkSession, docs, ids, key).select("text").mapInArrow(count, "shingle long, texts long")
    return rows.groupBy("shingle").agg(F.sum("texts").alias("texts")).filter("texts > 1").orderBy(F.desc("texts"), "shingle").limit(FREQUENT_MOST)


def _candidates(docs: DataFrame, tree: DataFrame, counts: DataFrame, k: int, grouped: bool = False) -> DataFrame:
    """Distinct pairs `(a, b)` of roots whose members may link, from the index of prefix shingles.

    `tree`: `(rep, root, alone, kind)`; if `grouped`, pairs of one kind are left out. Shingles are ordered by their
    `counts(shingle, texts)`, those without a count first.
    """
    spark = docs.sparkSession
    with rows_per_batch(spark, TEXT_ROWS):
        counts = counts.orderBy(F.desc("texts"), "shingle").limit(FREQUENT_MOST).toArrow().to_pandas()
    known = counts["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(known)
    known, times = known[order], counts["texts"].to_numpy(dtype=np.int64)[order]

    def emit(batches):
        pool = _Entries()
        for batch in batches:
            roots, alone, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            for row, s in _sets(batch.column(1), k):
                n = len(s)
                if not n:
                    continue
                seen = np.zeros(n, dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    seen = np.where(known[at] == s, times[at], 0)
                    order = np.argsort(seen, kind="stable")
                    s, seen = s[order], seen[order]
                p = prefix_length(n)
                yield from pool.add(_signed(s[:p]), int(roots[row]), n, bool(alone[row]), int(kind[row]), 1 + seen[:p] // LIST_PART)
        yield from pool.rest()

    texts = _of(spark, docs, tree.select("rep", "root", "alone", "kind"), "rep").select("root", "text", "alone", "kind")
    index = texts.mapInArrow(emit, "token long, part int, root long, least int, most int, rest int, alone boolean, kind long, half int")
    lists = index.repartition("token", "part").sortWithinPartitions("token", "part", "least")
    met = lists.mapInArrow(partial(_join_lists, grouped=grouped), "a long, b long, sizes int, rest int, shared int")
    # Of two sets, not trees, all common shingles up to the last met are counted: at most `rest` more can follow.
    found = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("rest").alias("rest"), F.max("sizes").alias("sizes"))
    with rows_per_batch(spark, 4 * TEXT_ROWS):
        return materialize(found.filter("sizes = 0 or 7 * (shared + rest - 1) >= 3 * sizes").select("a", "b"))


class _Entries:
    """Index entries on their way out: one per shingle and tree among those held, with sizes from least to most and the most that can follow.

    Raw rows are merged `HELD_ROWS` at a time; merged ones are merged again, and leave when there are as many of them.
    """

    def __init__(self):
        self.raw, self.raw_size, self.pool, self.size = [], 0, [], 0

    def add(self, token: np.ndarray, root: int, n: int, alone: bool, kind: int, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.raw.append((token, root, n, alone, kind, parts))
        self.raw_size += len(token)
        if self.raw_size >= HELD_ROWS:
            self._settle()
            if self.size >= HELD_ROWS:
                yield from self.rest()

    def _settle(self) -> None:
        if self.raw:
            count = [len(r[0]) for r in self.raw]
            token, parts = (np.concatenate([r[c] for r in self.raw]) for c in (0, 5))
            root, n, alone, kind = (np.repeat(np.array([r[c] for r in self.raw], dtype=t), count) for c, t in ((1, np.int64), (2, np.int32), (3, bool), (4, np.int64)))
            rest = n - np.concatenate([np.arange(c, dtype=np.int32) for c in count])
            self.pool.append(self._merged([(token, root, n, n, rest, alone, kind, parts.astype(np.int32))]))
            self.size += len(self.pool[-1][0])
        self.raw, self.raw_size = [], 0

    @staticmethod
    def _merged(pool: list[tuple]) -> tuple:
        columns = [np.concatenate(c) for c in zip(*pool)]
        order = np.lexsort((columns[1], columns[0]))
        token, root = columns[0][order], columns[1][order]
        start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (root[1:] != root[:-1])])
        least, most, rest = (f.reduceat(columns[c][order], start) for f, c in ((np.minimum, 2), (np.maximum, 3), (np.maximum, 4)))
        return token[start], root[start], least, most, rest, *(columns[c][order][start] for c in (5, 6, 7))

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        if not self.pool:
            return
        token, root, least, most, rest, alone, kind, parts_of = self._merged(self.pool)
        self.pool, self.size = [], 0
        # Of a list in p parts an entry goes to each pair of parts that its own is one of.
        for a in range(0, len(token), HELD_ROWS):
            few = slice(a, a + HELD_ROWS)
            of = parts_of[few].astype(np.int64)
            copy = np.repeat(np.arange(len(of)), of)
            other = np.arange(len(copy)) - np.repeat(np.cumsum(of) - of, of)
            mine = (mix(root[few].view(np.uint64)) % of.view(np.uint64)).view(np.int64)[copy]
            half = np.where(mine == other, -1, (mine > other).astype(np.int64))
            part = np.minimum(mine, other) * of[copy] + np.maximum(mine, other)
            small = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[few][copy]), small(part), pa.array(root[few][copy]), *(pa.array(x[few][copy]) for x in (least, most, rest, alone, kind)), small(half)],
                names=["token", "part", "root", "least", "most", "rest", "alone", "kind", "half"])


def _join_lists(batches, grouped: bool) -> Iterator[pa.RecordBatch]:
    """Root pairs of each index list, or part of one; a list may run over several batches."""
    held, last, found = [], None, _Pairs()
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not len(rows):
            continue
        ends = (rows[-1, 0], rows[-1, 1])
        if last == ends:  # the last list goes on
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows])
        whole = int(np.flatnonzero((rows[:, 0] != ends[0]) | (rows[:, 1] != ends[1]))[-1]) + 1 if (rows[0, 0], rows[0, 1]) != ends else 0
        yield from _pairs(rows[:whole], grouped, found)
        held, last = [rows[whole:]], ends
    if held:
        yield from _pairs(np.concatenate(held), grouped, found)
    yield from found.rest()


def _pairs(rows: np.ndarray, grouped: bool, found: _Pairs) -> Iterator[pa.RecordBatch]:
    start = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(rows)])
    for length in np.unique(size[(size > 1) & (size <= LIST_BLOCK)]):  # short lists of one length together
        at = start[size == length][:, None] + np.arange(length)
        i, j = np.triu_indices(length, 1)
        step = max(1, HELD_ROWS // len(i))
        for part in range(0, len(at), step):
            x = at[part:part + step]
            yield from found.add(_fitting(rows, x[:, i].ravel(), x[:, j].ravel(), grouped))
    for a, n in zip(start[size > LIST_BLOCK], size[size > LIST_BLOCK]):
        cuts = np.arange(a, a + n, LIST_BLOCK)
        least, rest = np.minimum.reduceat(rows[:a + n, 3], cuts), np.maximum.reduceat(rows[:a + n, 5], cuts)
        most = np.maximum.reduceat(rows[:a + n, 4], cuts)
        for x in range(len(cuts)):
            y = np.arange(x, len(cuts))
            # Blocks are skipped whole by size and by position.
            fits = (7 * np.minimum(rest[x], rest[y]) >= 3 * (least[x] + least[y])) & (WHOLE * most[x] >= PART * least[y])
            for z in y[fits]:
                i, j = np.meshgrid(np.arange(cuts[x], min(cuts[x] + LIST_BLOCK, a + n)), np.arange(cuts[z], min(cuts[z] + LIST_BLOCK, a + n)))
                i, j = i.ravel(), j.ravel()
                yield from found.add(_fitting(rows, i[i < j], j[i < j], grouped))


class _Pairs:
    """Pairs on their way out, twice `HELD_ROWS` at a time, each of these once."""

    def __init__(self):
        self.found, self.size = [], 0

    def add(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            self.found.append(rows)
            self.size += len(rows)
        if self.size >= 2 * HELD_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield _batch(self.found)
        self.found, self.size = [], 0


def _fitting(rows: np.ndarray, i: np.ndarray, j: np.ndarray, grouped: bool) -> np.ndarray:
    """Pairs that sizes and positions leave open; columns as in the index, 8 says which part of a cut list an entry is from."""
    a, b = rows[i], rows[j]
    ok = (a[:, 2] != b[:, 2]) & ((a[:, 7] != b[:, 7]) | (not grouped)) & (7 * np.minimum(a[:, 5], b[:, 5]) >= 3 * (a[:, 3] + b[:, 3])) & (
        WHOLE * a[:, 4] >= PART * b[:, 3]) & (WHOLE * b[:, 4] >= PART * a[:, 3]) & ((a[:, 8] < 0) | (a[:, 8] != b[:, 8]))
    a, b = a[ok], b[ok]
    sizes = np.where((a[:, 6] > 0) & (b[:, 6] > 0), a[:, 3] + b[:, 3], 0)
    return np.column_stack([np.minimum(a[:, 2], b[:, 2]), np.maximum(a[:, 2], b[:, 2]), sizes, np.minimum(a[:, 5], b[:, 5])])


def _batch(found: list[np.ndarray]) -> pa.RecordBatch:
    """`(a, b, sizes, rest, shared)`: pairs that met, and in how many lists; sizes is 0 unless both are single sets."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    start = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    sizes, rest = np.maximum.reduceat(rows[:, 2], start), np.minimum.reduceat(rows[:, 3], start)
    small = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(rows[start, 0]), pa.array(rows[start, 1]), small(sizes), small(rest), small(np.diff(np.r_[start, len(rows)]))],
                                      names=["a", "b", "sizes", "rest", "shared"])


def _tree_links(docs: DataFrame, tree: DataFrame, links: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """`(root, component)` of all roots. `links` join roots; `roots` holds all overlaps of candidate roots.

    Trees whose roots don't link may still hold members that do. The roots' overlap and what members gained bound the
    members' overlap. Members of trees that this leaves open, and that are in different components yet, meet in an index of
    their own, with shingles ordered by how many of them have these.
    """
    linked = f"{WHOLE} * common >= {PART} * (na + nb - common)"
    placed = connected_components(links.unionByName(roots.filter(linked).select("a", "b")))
    every = materialize(tree.select("root").distinct().join(placed, F.col("root") == F.col("node"), "left").select(
        "root", F.coalesce("component", "root").alias("component")))
    member = tree.select("rep", "root", (7 * F.col("gained") - 3 * F.col("n")).alias("slack"))
    best = member.groupBy("root").agg(F.max("slack").alias("best")).join(every, "root")
    open_ = roots.filter(f"not ({linked})").select("a", "b", "common")
    for c in "ab":
        open_ = open_.join(best.select(F.col("root").alias(c), F.col("best").alias(f"best_{c}"), F.col("component").alias(f"in_{c}")), c)
    open_ = materialize(open_.filter("7 * common + best_a + best_b >= 0 and in_a <> in_b").select("a", "b", "common"))
    if not open_.limit(1).count():
        return every
    left = open_.select(F.col("a").alias("root")).union(open_.select("b")).distinct()
    rest = materialize(member.join(left, "root").join(every, "root").select("rep", "root", "slack", F.col("component").alias("kind")))
    counts = _shingle_counts(docs, rest.select("rep").distinct(), "rep", k)
    met = _candidates(docs, rest.select("rep", F.col("rep").alias("root"), F.lit(True).alias("alone"), "kind"), counts, k, grouped=True)
    for c, x in (("a", "p"), ("b", "q")):
        met = met.join(rest.select(F.col("rep").alias(c), F.col("root").alias(f"r{c}"), F.col("slack").alias(f"s{c}")), c).withColumnRenamed(c, x)
    ends = met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.col("p").alias("xa"), F.col("q").alias("xb"),
                      (F.col("sa") + F.col("sb")).alias("both"))
    asked = ends.join(open_, ["a", "b"]).filter("7 * common + both >= 0")
    more = _asked_links(docs, asked, k)
    for c in "ab":  # links between components, which are then joined in turn
        more = more.join(every.select(F.col("root").alias(c), F.col("component").alias(f"in_{c}")), c)
    wider = connected_components(more.select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))).withColumnRenamed("component", "wider")
    return every.join(wider, F.col("component") == F.col("node"), "left").select("root", F.coalesce("wider", "component").alias("component"))


def _asked_links(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """`(a, b)` of the roots whose members `xa` and `xb` link."""
    asked = materialize(asked.select("a", "b", F.least("xa", "xb").alias("x"), F.greatest("xa", "xb").alias("y")).distinct())
    near = _linked(overlaps(docs, asked.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), k))
    return asked.join(near.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).select("a", "b")


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` of every row."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed = _signatures(docs, k)
    rows = signed.filter("part = 0")
    counts = signed.filter("part = 1").groupBy("fp1").agg(F.sum("n").alias("texts")).select(F.col("fp1").alias("shingle"), "texts")
    full = rows.filter("n > 0 and doc_id is not null")
    nodes = materialize(full.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(HASHES)]))
    tree, near = _trees(nodes, docs, k)
    sides = tree.select("rep", "root", "alone", F.lit(0).cast("long").alias("kind"))
    slack = tree.groupBy("root").agg(F.max(7 * F.col("gained") - 3 * F.col("n")).alias("best"))
    boxes = rows.join(tree.select("root").distinct(), F.col("doc_id") == F.col("root"), "left_semi").select(F.col("doc_id").alias("id"), "boxes").filter("boxes is not null")
    roots = overlaps(docs, _open_pairs(_candidates(docs, sides, counts, k), boxes, slack), k)
    root_of = materialize(tree.groupBy("rep").agg(F.min("root").alias("root")))
    # Rows that repeat an id with another text tie the trees of their sets.
    several = full.groupBy("doc_id").agg(F.min("fp1").alias("lo"), F.max("fp1").alias("hi")).filter("lo <> hi").select("doc_id")
    tied = full.join(several, "doc_id").join(nodes.select("n", "fp1", "fp2", "rep"), ["n", "fp1", "fp2"])
    first_rep = tied.groupBy("doc_id").agg(F.min("rep").alias("b"))
    links = near.unionByName(tied.join(first_rep, "doc_id").select(F.col("rep").alias("a"), "b"))
    for c in "ab":
        links = links.join(root_of.select(F.col("rep").alias(c), F.col("root").alias(f"r{c}")), c)
    first = _tree_links(docs, tree, links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b"), roots, k)
    placed = nodes.join(root_of, "rep").join(first, "root").select("n", "fp1", "fp2", F.col("component").alias("component_id"))
    return rows.join(placed, ["n", "fp1", "fp2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """The rows of each component's smallest id, with all their columns; rows that repeat an id and its text stay once."""
    ids = materialize(components(docs, id_column, text_column, k).withColumn("first", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("component_id"))))
    repeated = ids.filter("doc_id is not null and first > 1").limit(1).count()
    leaders = ids.filter("doc_id = component_id and first = 1").select(F.col("doc_id").alias("_leader"))
    kept = _of(docs.sparkSession, docs.withColumnRenamed(id_column, "doc_id"), leaders, "_leader").drop("_leader")
    if repeated:  # of rows that agree in id and text the least in all columns stays
        whole = F.struct(*[c for c in kept.columns])
        kept = kept.groupBy("doc_id", text_column).agg(F.min(whole).alias("_row")).select("_row.*")
    return kept.withColumnRenamed("doc_id", id_column).unionByName(docs.filter(F.col(id_column).isNull()))
