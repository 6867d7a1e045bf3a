"""Scores of texts by a probabilistic suffix tree over bytes, beside add-one word counts.

A text is its lower-cased words with one space between and an end mark; its symbols are bytes. A context is what the
last `DEPTH` symbols since the text's begin were, or a part of that. A context is retained if its next-symbol counts diverge from
those of its parent (the context without its oldest symbol): count times Kullback-Leibler divergence of at least `GAIN` nats.
Every context of the training texts is tried, however rare, so the tree grows with the corpus. Probabilities are
smoothed toward the parent's, and the root's toward equal ones; a context that isn't retained has its parent's.

The tree is a partitioned table. Symbol runs (a symbol and its context) are counted in batches, then by one shuffle; each
length is worked out from the next shorter one by a join, also for runs that only texts to be scored have. Runs that make
up at least `GRAM_SHARE` of all runs, so at most 1 / GRAM_SHARE of them, and words that make up at least `WORD_SHARE` of
all words go to all tasks, to save shuffling; texts meet their other runs and words by a join. The shares don't change a score.

Words are told apart by a 64-bit hash. Defined cases: null and empty texts are the end mark alone; rows that repeat are
scored each; without training texts all bytes are equally likely and no word is known; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rankfold.llm.common import fold, materialize, rows_per_batch
from rankfold.llm.words import Block, blocks

DEPTH, GAIN, PULL = 5, 10.0, 2.0
GRAM_SHARE, WORD_SHARE = 5e-7, 1e-6
#: Texts held at once by a task; they are worked through in blocks.
BATCH_ROWS = 4000
#: Counts that a task holds before it passes them on.
HELD = 1 << 21
_BITS = 9  # a symbol is its byte plus one; zero is none
_LOW = (1 << _BITS) - 1
_END = 10


def stream(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the block's texts, words parted by one space, each text closed by the end mark; and the texts' limits."""
    count, length = np.diff(block.first), block.ends - block.starts
    empty = np.cumsum(count == 0)
    words, texts = len(length), len(count)
    owner = np.repeat(np.arange(texts), count)
    size = np.bincount(owner, weights=length + 1, minlength=texts).astype(np.int64) + (count == 0)
    limits = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(limits[-1]), 32, dtype=np.uint8)
    word = np.repeat(np.arange(words), length)
    at = np.arange(len(word)) + word + empty[owner][word]
    source = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length) + block.starts[word]
    out[at] = block.data[source]
    out[limits[1:] - 1] = _END
    return out, limits


def runs(symbols: np.ndarray) -> np.ndarray:
    """Code of every symbol and the context before it; contexts begin anew after an end mark."""
    code = np.concatenate([[_END], symbols]).astype(np.int64) + 1
    total = code.copy()
    for _ in range(DEPTH):
        total[1:] = total[:-1] << _BITS | code[1:]
    total = total[1:]
    begins = np.concatenate([[0], np.flatnonzero(symbols == _END) + 1])
    for passed in range(DEPTH - 1):  # symbols since a text's begin; the end mark before that is the oldest of a context
        at = begins + passed
        total[at[at < len(total)]] &= (1 << (_BITS * (passed + 2))) - 1
    return total


class Tally:
    """Keys with counts; parts are merged as soon as they outgrow `MERGE` entries, so memory follows the distinct keys."""

    MERGE = 1 << 20

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size - len(self.parts[0][0]) > self.MERGE:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        start = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]][:len(keys)])
        return keys[start], np.add.reduceat(n, start) if len(start) else n


def _both(learnt: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key of either side once, its count among the learnt and among all."""
    keys = np.sort(np.concatenate([learnt[0], asked[0]]))
    keys = keys[np.r_[len(keys) > 0, keys[1:] != keys[:-1]][:len(keys)]]
    n = np.zeros(len(keys), np.int64)
    n[np.searchsorted(keys, learnt[0])] = learnt[1]
    m = n.copy()
    m[np.searchsorted(keys, asked[0])] += asked[1]
    return keys, n, m


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_gather`'s rows of a task; a key has one row as long as the task's keys stay below `HELD`, and one more each time they outgrow it."""
    symbols, words, asked, texts = Tally(), Tally(), Tally(), 0

    def rows():
        grams, found = _both(symbols.merged(), asked.merged()), words.merged()
        parts = [grams, (*found, found[1]), tuple(np.full(1, x) for x in (0, texts, texts))]
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(part[0]) for part in parts])
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate(x)) for x in zip(*parts))], names=["kind", "key", "n", "m"])

    for batch in batches:
        learnt = batch.column(1) if batch.num_columns > 1 else pa.array(np.ones(batch.num_rows, dtype=bool))
        for block in blocks(batch.column(0).filter(learnt)):
            symbols.add(runs(stream(block)[0]))
            words.add(block.hashes.view(np.int64))
        for block in blocks(batch.column(0).filter(pc.invert(learnt))):
            asked.add(runs(stream(block)[0]))
        texts += pc.sum(learnt, min_count=0).as_py()
        if symbols.size + words.size + asked.size > HELD:
            yield rows()
            symbols, words, asked, texts = Tally(), Tally(), Tally(), 0
    yield rows()


def _gather(texts: DataFrame) -> DataFrame:
    """`(kind, key, n, m)`: symbol runs (kind 0) and word hashes (kind 1); kind 2 counts the texts.

    `n` counts the texts that are learnt from: all, or those that a second column marks. `m` counts all texts; words
    and texts that aren't learnt from are left out.
    """
    with rows_per_batch(texts.sparkSession, BATCH_ROWS):
        counts = texts.mapInArrow(count_batches, "kind int, key long, n long, m long")
        return materialize(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def _probabilities(grams: DataFrame) -> DataFrame:
    """`(key, m, log)`: log10 probability of the symbol of every run after its context, for `grams(key, n, m)`.

    Runs are cut shorter length by length, from the longest down to the symbol alone; `m` marks the given ones. Then each
    length takes its priors from the one below: a run has at most 256 longer ones, and a context as many next symbols.
    """

    def cut(d: int):
        return F.col("key").bitwiseAND(F.lit((1 << (_BITS * (d + 1))) - 1))

    def own(d: int):
        """Runs whose context has d symbols."""
        return (F.shiftright("key", _BITS * d) > 0) & (F.shiftright("key", _BITS * (d + 1)) == 0)

    rows = {DEPTH: grams.filter(own(DEPTH)).select("key", "n", "m")}
    for d in range(DEPTH - 1, -1, -1):
        shorter = rows[d + 1].select(cut(d).alias("key"), "n", F.lit(0).cast("long").alias("m"))
        both = shorter.unionByName(grams.filter(own(d)).select("key", "n", "m"))
        rows[d] = materialize(both.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    total = rows[0].agg(F.sum("n")).first()[0] or 0
    level = rows[0].withColumn("p", (F.col("n") + PULL / 256) / (total + PULL))
    levels = [level]
    for d in range(1, DEPTH + 1):
        prior = level.select(F.col("key").alias("_shorter"), F.col("p").alias("prior"))
        met = rows[d].withColumn("_shorter", cut(d - 1)).join(prior, "_shorter")
        after = Window.partitionBy(F.shiftright("key", _BITS))
        total, n = F.sum("n").over(after), F.col("n")
        gain = F.sum(F.when(n > 0, n * F.log(n / F.col("prior"))).otherwise(0.0)).over(after)
        met = met.withColumns({"_total": total, "_gain": gain})
        kept = (F.col("_total") > 0) & (F.col("_gain") - F.col("_total") * F.log("_total") >= GAIN)
        smooth = (n + PULL * F.col("prior")) / (F.col("_total") + PULL)
        level = materialize(met.select("key", "n", "m", F.when(kept, smooth).otherwise(F.col("prior")).alias("p")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).filter("m > 0").select("key", "m", F.log10("p").alias("log"))


def _contexts(grams: DataFrame) -> pd.DataFrame:
    """`(d, context, symbol, n)` of the contexts of all lengths."""
    lengths = F.explode(F.array(*[F.struct(
        F.lit(d).alias("d"), F.shiftright("key", _BITS).bitwiseAND(F.lit((1 << (_BITS * d)) - 1)).alias("context")) for d in range(DEPTH + 1)]))
    rows = grams.select("n", F.col("key").bitwiseAND(F.lit(_LOW)).alias("symbol"), lengths.alias("c")).select("n", "symbol", "c.*")
    whole = F.lit(False)
    for d in range(DEPTH + 1):  # a context has all its symbols
        full = F.lit(True) if d == 0 else F.shiftright("context", _BITS * (d - 1)) > 0
        whole = whole | ((F.col("d") == d) & full)
    return rows.filter(whole).groupBy("d", "context", "symbol").agg(F.sum("n").alias("n")).toArrow().to_pandas()


class SuffixTree:
    """The tree of a small corpus as an automaton, whose state is always the longest suffix in the tree.

    States, their transitions and log10 probabilities; column 0 of the tables stands for bytes never seen. It has to fit
    one process, so texts are scored by `_probabilities`; the tests hold that against it.
    """

    def __init__(self, rows: pd.DataFrame):
        seen = np.unique(rows["symbol"].to_numpy(dtype=np.int64))
        self.column = np.zeros(257, dtype=np.int64)
        self.column[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        # The root; a byte never seen keeps the share that smoothing leaves it.
        rows = rows.sort_values("context", kind="stable")  # a longer context has the larger code
        keys = rows[["d", "context"]].drop_duplicates().to_numpy(dtype=np.int64)
        if not len(keys):
            keys = np.zeros((1, 2), dtype=np.int64)
        where = {int(c): i for i, c in enumerate(keys[:, 1])}
        counts = np.zeros((len(keys), width), dtype=np.float32)
        owner = np.searchsorted(keys[:, 1], rows["context"].to_numpy(dtype=np.int64))
        counts[owner, self.column[rows["symbol"].to_numpy(dtype=np.int64)]] = rows["n"].to_numpy()
        parent = np.array([where[int(c) & ((1 << (_BITS * (d - 1))) - 1)] if d else -1 for d, c in keys], dtype=np.int64)
        smooth, retained = np.full((len(keys), width), 1 / 256, dtype=np.float32), np.zeros(len(keys), dtype=bool)
        for d in range(DEPTH + 1):
            of_length = np.flatnonzero(keys[:, 0] == d)
            for at in np.array_split(of_length, len(of_length) // 4096 + 1):
                prior = smooth[parent[at]].astype(float) if d else smooth[at].astype(float)
                n = counts[at].astype(float)
                total = n.sum(axis=1, keepdims=True)
                here = (n + PULL * prior) / (total + PULL)
                if d:
                    raw = n / np.maximum(total, 1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = (np.where(raw > 0, raw * np.log(raw / prior), 0) * total).sum(axis=1)
                    retained[at] = gain >= GAIN
                    here = np.where(retained[at, None], here, prior)
                smooth[at] = here
        self.retained = int(retained.sum()) + 1
        states = {0, _END + 1} if _END + 1 in where else {0}
        for d, c in keys[retained]:
            for older in range(d):  # every part of a retained context is one that the walk to it passes
                for n in range(1, d - older + 1):
                    states.add((int(c) >> (_BITS * older)) & ((1 << (_BITS * n)) - 1))
        self.codes = np.array(sorted(states), dtype=np.int64)
        place = np.array([where.get(int(c), 0) for c in self.codes])
        self.logs = np.log10(smooth[place].astype(float))
        symbols = np.concatenate([[0], seen])
        longer = (self.codes[:, None] << _BITS) | symbols[None, :]
        self.next = np.zeros(longer.shape, dtype=np.int32)
        for n in range(1, DEPTH + 1):  # the longest suffix is looked up last and stays
            code = longer & ((1 << (_BITS * n)) - 1)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = (self.codes[at] == code) & (code >> (_BITS * (n - 1)) > 0)
            self.next[hit] = at[hit]
        self.next[:, 0] = 0
        self.start = int(np.searchsorted(self.codes, _END + 1)) if _END + 1 in states else 0
        if self.column[_END + 1]:
            self.next[:, self.column[_END + 1]] = self.start


def score_texts(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, then `(n_tokens, n_known, train_tokens, base_score, score)` of every row of `docs`."""
    text = F.col(text_column).cast("string").alias("text")
    counted = _gather(training.select(text, F.lit(True).alias("learnt")).unionByName(docs.select(text, F.lit(False).alias("learnt"))))
    return _scored(docs, counted, text_column, keep)


def _told(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values; there is one of each at least."""
    found = rows.select("key", value).toArrow()
    keys, values = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(keys)
    return (keys[order], values[order].astype(float)) if len(keys) else (np.full(1, -1), np.zeros(1))


def _found(keys: np.ndarray, told: tuple[pd.Index, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are told, and the values of these; other keys have 0."""
    at = told[0].get_indexer(keys)
    hit = at >= 0
    return hit, np.where(hit, told[1][at], 0.0)


def _sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[limits])


def _left(keys: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    size = np.concatenate([np.zeros(1, np.int64), *sizes])
    flat = np.concatenate([np.zeros(0, np.int64), *keys])
    return pa.LargeListArray.from_arrays(pa.array(np.cumsum(size)), pa.array(flat)).cast(pa.list_(pa.int64()))


def _scored(docs: DataFrame, counted: DataFrame, text_column: str, keep: tuple[str, ...]) -> DataFrame:
    vocabulary = counted.filter("kind = 1").select("key", "n", F.log10(F.col("n") + 1.0).alias("log"))
    sums = vocabulary.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    ends = counted.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    total, distinct = (sums["tokens"] or 0) + ends, sums["words"] + int(ends > 0)
    grams = materialize(_probabilities(counted.filter("kind = 0")))
    least = WORD_SHARE * (sums["tokens"] or 0), GRAM_SHARE * (grams.agg(F.sum("m")).first()[0] or 0)
    told_words, told_grams = _told(vocabulary.filter(F.col("n") >= least[0]), "log"), _told(grams.filter(F.col("m") >= least[1]), "log")
    width = len(keep)

    def measure(batches):
        task, row = TaskContext.get().partitionId() << 33, 0
        of_words, of_grams = ((pd.Index(keys), values) for keys, values in (told_words, told_grams))
        for batch in batches:
            tokens, known, logs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            words, word_sizes, rare, sizes = [], [], [], []
            for block in blocks(batch.column(width)):
                hashes = block.hashes.view(np.int64)
                told, values = _found(hashes, of_words)
                tokens.append(np.diff(block.first) + 1)
                known.append(_sums(told, block.first) + int(ends > 0))
                logs.append(_sums(values, block.first) + np.log10(ends + 1.0))
                words.append(hashes[~told])
                word_sizes.append(_sums(~told, block.first))
                symbols, limits = stream(block)
                keys = runs(symbols)
                told, values = _found(keys, of_grams)
                scores.append(_sums(values, limits))
                rare.append(keys[~told])
                sizes.append(_sums(~told, limits))
            join = lambda parts, kind: pa.array(np.concatenate(parts), kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(np.arange(row, row + batch.num_rows) + task, pa.int64()), join(tokens, pa.int64()),
                 join(known, pa.int64()), join(logs, pa.float64()), join(scores, pa.float64()), _left(words, word_sizes), _left(rare, sizes)],
                names=[*keep, "_row", "n_tokens", "_known", "_logs", "_score", "_words", "_grams"])
            row += batch.num_rows

    given = docs.select(*keep, F.col(text_column).cast("string"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:width]]
    schema = ", ".join([*fields, "_row long, n_tokens long, _known long, _logs double, _score double, _words array<long>, _grams array<long>"])
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        rows = materialize(given.mapInArrow(measure, schema))
    # Either kind is joined by its key alone: a single long is sorted by its digits, two columns are compared row by row.
    met = lambda keys, table: rows.select("_row", F.explode(keys).alias("key")).join(table.select("key", "log"), "key").groupBy("_row")
    words = met("_words", vocabulary.filter(F.col("n") < least[0])).agg(F.count("*").alias("more"), F.sum("log").alias("logs"))
    scores = met("_grams", grams.filter(F.col("m") < least[1])).agg(F.sum("log").alias("scores"))
    base = F.col("_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return rows.drop("_words", "_grams").join(words, "_row", "left").join(scores, "_row", "left").select(
        *keep, "n_tokens", (F.col("_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("_score") + F.coalesce("scores", F.lit(0.0))).alias("score"))


def score_documents(docs: DataFrame) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`; the held-out fold is not learnt from."""
    held = fold("doc_id", 7) == 2
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    counted = _gather(rows.select(F.col("text").cast("string"), (~F.col("held_out")).alias("learnt")))
    return _scored(rows, counted, "text", ("doc_id", "held_out"))
