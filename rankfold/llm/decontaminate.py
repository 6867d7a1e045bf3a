"""Benchmark decontamination: item-sized windows, SimHash candidates, exact weighted shingle similarity.

A text's five-word shingles are looked up among those of the items. A window without a common shingle has similarity
zero, so only item-sized windows around a common shingle are fingerprinted: each bit of the SimHash is the sign of the
weighted vote of the window's shingles. Fingerprints are cut to `radius` + 1 blocks; two within the radius agree in at
least one block, so the block indexes give every item within it. Candidates are then compared exactly: the sum of
minima over the sum of maxima of the shingle weights must reach `threshold`. A shingle weighs less the more items share it.

How many items hold a shingle is counted once over all items, so a similarity doesn't depend on what else is looked for at the same
time. Only shingles of several items are told with their weights; any other, known or not, weighs as much as one of a single item.

The index of the items is sent to all tasks; larger item tables are split by hash to parts of about `PART_BYTES` of text,
with one pass over the texts each, whose result is stored before the next part is read. Texts are never shuffled, so a passage in a third of
them costs no task more than its share.

Defined cases: null and empty texts, and items without words, match nothing; a text or item of fewer than five words is
one shingle, so it matches only its like; a text shorter than an item is one window; of equal windows the first counts;
of rows that repeat an item id the best counts; repeated rows of texts are reported alike; very long texts are read in whole, window by
window; extra columns are ignored or carried along; without texts or without items nothing is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import materialize
from rankfold.llm.words import Block, blocks, mix, shingles

K, THRESHOLD, RADIUS, BITS = 5, 0.75, 20, 64
PART_BYTES = 1 << 25
_FILTER = 1 << 20


def votes(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of +-weight per shingle, a column per bit."""
    bits = (mix(shingle)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.where(bits == 1, weight[:, None], -weight[:, None])


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Sign pattern of summed votes; sums are rounded, so that their order doesn't matter."""
    return ((np.round(sums, 6) > 0).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class ShingleWeights:
    """Weight of a shingle by the number of items that hold it: `1 + ln(items / holders)`, at least one holder."""

    def __init__(self, items: int, shared: np.ndarray, holders: np.ndarray):
        order = np.argsort(shared)
        self.shared, self.rare = shared[order], 1 + math.log(max(1, items))
        self.weight = 1 + np.log(max(1, items) / holders[order])

    def weigh(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(shingle), self.rare)
        at = np.minimum(np.searchsorted(self.shared, shingle), len(self.shared) - 1)
        return np.where(self.shared[at] == shingle, self.weight[at], self.rare)


class ItemIndex:
    """Shingles, weights and block indexes of the items."""

    def __init__(self, ids: list[int], texts: list[str | None], radius: int = RADIUS, k: int = K, held: ShingleWeights | None = None):
        self.k, self.radius = k, radius
        owned: list[tuple[int, np.ndarray, int]] = []
        for block in blocks(pa.array(texts, pa.string())):
            shingle, _, limits = shingles(block, k)
            count = np.diff(block.first)
            owned += [(ids[block.lo + r], shingle[limits[r]:limits[r + 1]], int(count[r])) for r in range(len(count)) if count[r]]
        self.ids = [i for i, _, _ in owned]
        self.words = np.array([n for _, _, n in owned], dtype=np.int64)
        self.shingle = [np.unique(s, return_counts=True) for _, s, _ in owned]
        every = np.concatenate([u for u, _ in self.shingle]) if owned else np.zeros(0, np.uint64)
        self.known, shared = np.unique(every, return_counts=True)
        self.held = held or ShingleWeights(len(owned), self.known[shared > 1], shared[shared > 1])
        self.filter = np.zeros(_FILTER, dtype=bool)
        self.filter[(self.known & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        holder = np.repeat(np.arange(len(owned)), [len(u) for u, _ in self.shingle])
        order = np.argsort(every, kind="stable")
        self.holder, self.at = holder[order], np.searchsorted(every[order], np.append(self.known, np.uint64(2**64 - 1)))
        self.at[-1] = len(every)
        marks = [fingerprint(votes(u, self.weigh(u) * c).sum(axis=0)[None, :])[0] for u, c in self.shingle]
        self.marks = np.array(marks, dtype=np.uint64)
        self.total = np.array([float((self.weigh(u) * c).sum()) for u, c in self.shingle])
        cuts = np.linspace(0, BITS, radius + 2).astype(int)
        self.cuts = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        self.sizes = {int(m): self._tables(np.flatnonzero(self.words == m)) for m in np.unique(self.words)}

    def _tables(self, items: np.ndarray):
        tables = []
        for shift, mask in self.cuts:
            value = (self.marks[items] >> shift) & mask
            order = np.argsort(value, kind="stable")
            tables.append((value[order], items[order]))
        return tables

    def find(self, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `shingle` of those that some item holds, and their places in `known`."""
        at = np.flatnonzero(self.filter[(shingle & np.uint64(_FILTER - 1)).astype(np.int64)])
        place = np.searchsorted(self.known, shingle[at])
        place[place == len(self.known)] = 0
        same = self.known[place] == shingle[at] if len(self.known) else np.zeros(len(at), bool)
        return at[same], place[same]

    def weigh(self, shingle: np.ndarray) -> np.ndarray:
        return self.held.weigh(shingle)

    def near(self, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`(window, item, distance)` of all pairs of one size within the radius, through the block indexes."""
        pairs = []
        for (shift, mask), (value, item) in zip(self.cuts, self.sizes[size]):
            asked = (marks >> shift) & mask
            lo, hi = np.searchsorted(value, asked, "left"), np.searchsorted(value, asked, "right")
            window = np.repeat(np.arange(len(marks)), hi - lo)
            inside = np.arange(len(window)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            pairs.append(window * len(self.ids) + item[lo[window] + inside])
        window, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.ids))
        distance = np.bitwise_count(marks[window] ^ self.marks[item])
        keep = distance <= self.radius
        return window[keep], item[keep], distance[keep]


def leaks_in(shingle: np.ndarray, words: int, hit: np.ndarray, place: np.ndarray, index: ItemIndex, threshold: float) -> dict:
    """Best window of every leaked item of one text: item id -> (similarity, first word, words, distance)."""
    found: dict = {}
    weight = index.weigh(shingle)
    running = np.concatenate([[0.0], np.cumsum(weight)])
    items = np.unique(np.concatenate([index.holder[index.at[p]:index.at[p + 1]] for p in np.unique(place)]))
    for size in np.unique(index.words[items]):
        length = min(int(size), words)
        held = max(1, length - index.k + 1)  # shingles of a window
        near_hit = (hit[:, None] - np.arange(held)[None, :]).ravel()
        starts = np.unique(np.clip(near_hit, 0, max(0, words - length)))
        for part in np.array_split(starts, max(1, len(starts) // 4096)):
            inside = part[:, None] + np.arange(held)[None, :]
            used, back = np.unique(inside, return_inverse=True)
            sums = np.zeros((len(part), BITS))
            ballots, back = votes(shingle[used], weight[used]), back.reshape(inside.shape)
            for j in range(held):
                sums += ballots[back[:, j]]
            for w, i, distance in zip(*index.near(fingerprint(sums), int(size))):
                start = int(part[w])
                window = shingle[start:start + held]
                unique, count = index.shingle[i]
                at = np.minimum(np.searchsorted(unique, window), len(unique) - 1)
                seen = np.bincount(at[unique[at] == window], minlength=len(unique))
                both = float((np.minimum(seen, count) * index.weigh(unique)).sum())
                similarity = both / (index.total[i] + running[start + held] - running[start] - both)
                best = found.get(index.ids[i])
                if similarity >= threshold - 1e-9 and (best is None or similarity > best[0] + 1e-12):
                    found[index.ids[i]] = (similarity, start, length, int(distance))
    return found


def scan_block(block: Block, index: ItemIndex, threshold: float):
    """`(row, leaks)` of the rows of a block that hold a leaked item."""
    shingle, _, limits = shingles(block, index.k)
    at, place = index.find(shingle)
    owner = np.searchsorted(limits, at, side="right") - 1
    for row in np.unique(owner):
        mine = owner == row
        leaks = leaks_in(shingle[limits[row]:limits[row + 1]], int(block.first[row + 1] - block.first[row]),
                         at[mine] - limits[row], place[mine], index, threshold)
        if leaks:
            yield block.lo + int(row), leaks


def shingle_weights(texts: DataFrame, k: int = K) -> ShingleWeights:
    """Counted over all item texts; of the shingles only those that several items hold come to the driver."""

    def count(batches):
        for batch in batches:
            for block in blocks(batch.column(0)):
                shingle, _, limits = shingles(block, k)
                held = [np.unique(shingle[a:b]) for a, b in zip(limits[:-1], limits[1:]) if b > a]
                every, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[every.view(np.int64), 0]), pa.array(np.r_[n, len(held)]), pa.array(np.arange(len(n) + 1) == len(n))],
                                                 names=["shingle", "holders", "items"])

    counted = texts.mapInArrow(count, "shingle long, holders long, items boolean").groupBy("shingle", "items").agg(F.sum("holders").alias("holders"))
    told = counted.filter("items or holders > 1").toArrow()
    shingle, holders, items = (told.column(c).to_numpy() for c in ("shingle", "holders", "items"))
    return ShingleWeights(int(holders[items].sum()), shingle[~items].view(np.uint64), holders[~items])


def _indexes(items: DataFrame, item_column: str, text_column: str, radius: int):
    """`(index, whether it is the last)` of each part."""
    rows = items.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).cast("string").alias("text")).filter(
        F.col("item").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    weights = shingle_weights(rows.select("text"))
    for part in range(parts):
        held = rows.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "text").collect()
        yield ItemIndex([r["item"] for r in held], [r["text"] for r in held], radius, held=weights), part == parts - 1


def find_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """`(id, item_id, similarity, first_word, n_words, distance)` of every text and item it holds; clean texts give no row."""
    found = None
    for index, last in _indexes(items, item_column, item_text, radius):

        def scan(batches, index=index):
            for batch in batches:
                rows = [(at, item, *leak) for block in blocks(batch.column(1)) for at, leaks in scan_block(block, index, threshold)
                        for item, leak in sorted(leaks.items())]
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types))],
                    names=[id_column, "item_id", "similarity", "first_word", "n_words", "distance"])

        kind = docs.schema[id_column].dataType.simpleString()
        part = docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(
            scan, f"`{id_column}` {kind}, item_id long, similarity double, first_word long, n_words long, distance int")
        part = part if last and found is None else materialize(part)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaking(docs: DataFrame, items: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
                 threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows whose text holds no item, with all their columns; a filter in place, without a shuffle."""
    at = docs.columns.index(text_column)
    for index, last in _indexes(items, item_column, item_text, radius):

        def keep(batches, index=index):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for block in blocks(batch.column(at)):
                    for row, _ in scan_block(block, index, threshold):
                        clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
        docs = docs if last else materialize(docs)
    return docs
