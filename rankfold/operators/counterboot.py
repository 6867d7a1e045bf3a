"""Bootstrap replicates whose row weights are a pure function of (seed, replicate, id).

A row's weight in a replicate is Poisson(1), by the inverse law from 16 bits of md5("seed:block:id"); a digest serves the eight
replicates of a block. No weight is stored or shuffled and none depends on layout, row count or other rows, so any engine with
md5 draws the same replicates. The size of a replicate varies around N, which ratios such as AUC, average precision and F1 don't notice.

Rows are put in order of (model, score) by ranges of about `PART_ROWS` rows. A part's first and last scores may go on in other
parts, so their weights are summed for themselves; the scores strictly between are the part's own. That gives up to three cells per
part, model and replicate, and only cells are shuffled: what lies above a cell is a running sum over them. AUC needs nothing else;
average precision needs the sums above a cell inside it, so a second pass draws the weights once more.
A score that a third of all rows share fills whole parts, each of which is one cell.

A model with few different scores (at most about `MAX_CELLS`, counted on the rows) needs no order: a row's weights are drawn once for all
such models and added up by model, score and class where the row lies, so only these sums are shuffled and every metric follows from
them. Both ways give the same replicates; a call may use both, each for its models.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from rankfold.functions.scalars import ratio, ratio_or_zero
from rankfold.session import materialize

PER_BLOCK = 8
#: Rows of a part, and replicates drawn at a time within it.
PART_ROWS, BATCH = 5_000, 200
#: Different scores up to which a model's weights are summed by score; rows drawn at a time there, and rows worth a task.
MAX_CELLS, CHUNK_ROWS, TASK_ROWS = 2_048, 8_192, 25_000
#: Rows after which a task hands its sums on, before they could outgrow 32 bits.
FULL_ROWS = 100_000_000
#: Groups in which the sums of a model and batch from all tasks meet.
MERGES = 16
#: Digests worked out at a time, so that what one step leaves is still near when the next one reads it.
DIGESTS = 32_768


def weight_limits() -> list[int]:
    """A 16-bit number at or above k + 1 of these limits weighs more than k: the cumulative Poisson(1) law times 2^16, rounded."""
    total, term, out = 0.0, math.exp(-1.0), []
    for k in range(1, 20):
        total += term
        term /= k
        limit = round(total * 65536)
        if limit >= 65536:
            break
        out.append(limit)
    return out


_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digest_words(words: list, shape: tuple[int, int]) -> np.ndarray:
    """md5 of one-block messages, many at a time: `words` are the 16 message words, arrays that broadcast to `shape` or None for zeros."""
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in _START)
    f, g = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            k = i
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            k = (5 * i + 1) % 16
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            k = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            k = 7 * i % 16
        f += a
        if words[k] is not None:
            f += words[k]
        f += np.uint32(_ADDED[i])
        turn = _TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        f >>= np.uint32(32 - turn)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START)], axis=-1)


@cache
def _weight_table() -> np.ndarray:
    """Weight by the 16-bit number as it lies in memory, its high byte first."""
    numbers = np.arange(65536, dtype="<u2").view(">u2").astype(np.int64)
    return np.searchsorted(np.array(weight_limits()), numbers, side="right").astype(np.uint8)


def drawn(ids: list[bytes], blocks: range, seed: int) -> np.ndarray:
    """Weights as bytes, a row per id and eight columns per block."""
    out = np.empty((len(ids), len(blocks), PER_BLOCK), dtype=np.uint8)
    before, sizes = f"{seed}:".encode(), np.array([len(i) for i in ids], dtype=np.int64)
    at = len(before)
    for digits in sorted({len(str(b)) for b in blocks}):
        mine = [b for b in blocks if len(str(b)) == digits]
        head = at + digits + 1
        short = np.flatnonzero(sizes + head <= 55)
        for i in np.flatnonzero(sizes + head > 55):  # longer than one md5 block
            for b in mine:
                out[i, b - blocks.start] = _weight_table()[np.frombuffer(md5(before + f"{b}:".encode() + ids[i]).digest(), dtype="<u2")]
        if not len(short):
            continue
        text = np.zeros((len(short), 64), dtype=np.uint8)
        width = max(1, int(sizes[short].max()))
        text[:, head:head + width] = np.array([ids[i] for i in short], dtype=f"S{width}").view(np.uint8).reshape(len(short), width)
        text[:, :at], text[:, head - 1] = np.frombuffer(before, dtype=np.uint8), ord(":")
        text[np.arange(len(short)), head + sizes[short]] = 0x80
        text[:, 56:58] = (8 * (head + sizes[short])).astype("<u2").view(np.uint8).reshape(-1, 2)
        base = np.ascontiguousarray(text.view("<u4").T)
        numbers = np.zeros((len(mine), 64), dtype=np.uint8)
        numbers[:, at:at + digits] = np.frombuffer("".join(map(str, mine)).encode(), dtype=np.uint8).reshape(-1, digits)
        numbers = numbers.view("<u4")
        step = max(1, DIGESTS // len(short))
        for lo in range(0, len(mine), step):
            part = numbers[lo:lo + step]
            words = [base[k] + part[:, k:k + 1] if part[:, k].any() else base[k] if base[k].any() else None for k in range(16)]
            found = _digest_words(words, (len(part), len(short))).view("<u2")
            where = slice(mine[lo] - blocks.start, mine[lo] - blocks.start + len(part))
            weights = _weight_table()[found].transpose(1, 0, 2)
            if len(short) == len(ids):
                out[:, where] = weights
            else:
                out[short, where] = weights
    return out.reshape(len(ids), len(blocks) * PER_BLOCK)


def _drawn(ids: list[bytes], replicates: range, seed: int) -> np.ndarray:
    first = replicates.start // PER_BLOCK
    found = drawn(ids, range(first, -(-replicates.stop // PER_BLOCK)), seed)
    return found[:, replicates.start - first * PER_BLOCK:][:, :len(replicates)]


def draw_weights(ids: list[bytes], replicates: range, seed: int) -> np.ndarray:
    """Weights, a row per id and a column per replicate."""
    return _drawn(ids, replicates, seed).astype(np.int64)


def weight_sql(digest: str, place: str) -> str:
    """The weight in SQL, from the hex digest and the replicate's place (0 to 7) in its block."""
    number = f"CAST('0x' || substr({digest}, 4 * ({place}) + 1, 4) AS INTEGER)"
    return "(" + " + ".join(f"CAST({number} >= {limit} AS INTEGER)" for limit in weight_limits()) + ")"


def _batches(replicates: int):
    return [range(a, min(a + BATCH, replicates)) for a in range(0, replicates, BATCH)]


def _merged(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray):
    """Sums over rows of equal scores, which lie together, in descending order."""
    start = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
    return np.add.reduceat(pos, start, axis=0), np.add.reduceat(neg, start, axis=0)


def _parts(wide: DataFrame, models: list[str], id_column: str, rows: int) -> DataFrame:
    """Stored `(model, score, id, y, part)` in parts of neighbouring scores."""
    long = wide.select(F.col(id_column).cast("string").alias("id"), F.col("y").cast("int").alias("y"), *[F.col(m).cast("double").alias(m) for m in models])
    long = long.unpivot(["id", "y"], models, "model", "score").filter("id is not null and score is not null and y is not null")
    parts = max(1, -(-wide.count() * len(models) // rows))
    placed = long.repartitionByRange(parts, F.col("model"), F.desc("score"), F.col("id"))
    return materialize(placed.withColumn("part", F.spark_partition_id()))


CELL = "model int, part int, score double, edge boolean, rep int, pos long, neg long, tp long, fp long, wins double"


def _few_scores(wide: DataFrame, models: list[str], most: int) -> dict[str, np.ndarray]:
    """The different scores, ascending, of those models that have about `most` at most and no NaN."""
    value = {m: F.col(m).cast("double") for m in models}
    seen = wide.agg(*[F.when(F.count_if(F.isnan(value[m])) > 0, F.lit(None)).otherwise(F.approx_count_distinct(value[m])).alias(f"n{i}") for i, m in enumerate(models)]).first()
    few = [m for i, m in enumerate(models) if seen[f"n{i}"] is not None and seen[f"n{i}"] <= most]
    if not few:
        return {}
    found = wide.select(*[value[m].alias(m) for m in few]).unpivot([], few, "model", "score").filter("score is not null").distinct().collect()
    return {m: np.array(sorted(r["score"] for r in found if r["model"] == m), dtype=float) for m in few}


SUMS = "model int, batch int, merge int, score double, pos binary, neg binary"


def _by_score(wide: DataFrame, thresholds: dict[str, float], scores: dict[str, np.ndarray], replicates: int, seed: int, id_column: str) -> DataFrame:
    """`(model, rep, wins, steps, tp, fp, all_pos, all_neg)` of models with few different scores: weights summed by score and class."""
    models, batches = list(scores), _batches(replicates)
    first = np.cumsum([0, *[len(scores[m]) for m in models]])
    rows = wide.select(F.col(id_column).cast("string").alias("id"), F.col("y").cast("int").alias("y"), *[F.col(m).cast("double").alias(m) for m in models])
    rows = rows.filter("id is not null and y is not null")
    cores = wide.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-wide.count() // TASK_ROWS), 2 * cores))

    def listed(sums: np.ndarray):
        for j, m in enumerate(models):
            cells = range(int(first[j]), int(first[j + 1]))
            for k, reps in enumerate(batches):
                pos, neg = ([sums[2 * c + i, reps.start:reps.stop].astype(np.int64).tobytes() for c in cells] for i in (0, 1))
                yield pd.DataFrame({"model": j, "batch": k, "merge": np.arange(len(cells)) % MERGES, "score": scores[m], "pos": pos, "neg": neg})

    def add(frames):
        sums, count = np.zeros((2 * int(first[-1]), replicates), dtype=np.int32), 0  # pos and neg of a cell follow one another
        for frame in frames:
            for lo in range(0, len(frame), CHUNK_ROWS):
                chunk = frame.iloc[lo:lo + CHUNK_ROWS]
                w = _drawn([i.encode() for i in chunk["id"]], range(replicates), seed)
                negative = (chunk["y"].to_numpy() != 1).astype(np.int64)
                for j, m in enumerate(models):
                    values = chunk[m].to_numpy(dtype=float)
                    at = np.flatnonzero(~np.isnan(values))
                    cell = 2 * (first[j] + np.searchsorted(scores[m], values[at])) + negative[at]
                    order = np.argsort(cell, kind="stable")
                    cell, at = cell[order], at[order]
                    for rows_of in np.split(np.arange(len(at)), np.flatnonzero(cell[1:] != cell[:-1]) + 1) if len(at) else ():
                        sums[cell[rows_of[0]]] += w[at[rows_of]].sum(axis=0, dtype=np.int32)
                count += len(chunk)
                if count >= FULL_ROWS:
                    yield from listed(sums)
                    sums[:], count = 0, 0
        if count:
            yield from listed(sums)

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack([np.frombuffer(b, dtype=np.int64) for b in column])

    def merged(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("score", kind="stable")
        values = mine["score"].to_numpy()
        start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        pos, neg = (np.add.reduceat(matrix(mine[c]), start, axis=0) for c in ("pos", "neg"))
        return pd.DataFrame({"model": int(key[0]), "batch": int(key[1]), "merge": int(key[2]), "score": values[start],
                             "pos": [p.tobytes() for p in pos], "neg": [n.tobytes() for n in neg]})

    def metrics(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("score", ascending=False, kind="stable")
        pos, neg, reps = matrix(mine["pos"]), matrix(mine["neg"]), batches[int(key[1])]
        flagged = mine["score"].to_numpy() >= thresholds[models[int(key[0])]]
        tp, fp = np.cumsum(pos, axis=0), np.cumsum(neg, axis=0)
        return pd.DataFrame({"model": models[int(key[0])], "rep": np.array(reps, dtype=np.int32), "wins": (pos * (fp[-1] - fp + neg / 2)).sum(axis=0),
                             "steps": np.where(pos > 0, pos * (tp / np.maximum(tp + fp, 1)), 0.0).sum(axis=0),
                             "tp": pos[flagged].sum(axis=0), "fp": neg[flagged].sum(axis=0), "all_pos": tp[-1].astype(float), "all_neg": fp[-1].astype(float)})

    # Dealt out by id: weights are drawn where a row lies, and a task's sums are sent once.
    found = rows.repartition(tasks, "id").mapInPandas(add, SUMS).groupBy("model", "batch", "merge").applyInPandas(merged, SUMS)
    return found.groupBy("model", "batch").applyInPandas(
        metrics, "model string, rep int, wins double, steps double, tp long, fp long, all_pos double, all_neg double")


def _metrics(every: DataFrame) -> DataFrame:
    return every.select("rep", "model", ratio(F.col("wins"), F.col("all_pos") * F.col("all_neg")).alias("roc_auc"), ratio(F.col("steps"), F.col("all_pos")).alias(
        "average_precision"), ratio_or_zero(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")).alias("f1"))


def counter_replicates(wide: DataFrame, thresholds: dict[str, float], replicates: int, seed: int = 42, id_column: str = "id",
                       part_rows: int = PART_ROWS, max_cells: int = MAX_CELLS) -> DataFrame:
    """`(rep, model, roc_auc, average_precision, f1)`; all models of a replicate share its row weights."""
    wide = materialize(wide.select(id_column, "y", *thresholds))
    scores = _few_scores(wide, list(thresholds), max_cells)
    parts = [_metrics(_by_score(wide, thresholds, scores, replicates, seed, id_column))] if any(len(s) for s in scores.values()) else []
    if rest := {m: t for m, t in thresholds.items() if m not in scores}:
        parts.append(_metrics(_by_order(wide, rest, replicates, seed, id_column, part_rows)))
    return reduce(DataFrame.unionByName, parts) if parts else wide.sparkSession.createDataFrame([], "rep int, model string, roc_auc double, average_precision double, f1 double")


def _by_order(wide: DataFrame, thresholds: dict[str, float], replicates: int, seed: int, id_column: str, part_rows: int) -> DataFrame:
    """`(model, rep, wins, steps, tp, fp, all_pos, all_neg)` from parts of neighbouring scores."""
    models = list(thresholds)
    rows = _parts(wide, models, id_column, part_rows)

    def ordered(mine: pd.DataFrame):
        mine = mine.sort_values("score", ascending=False, kind="stable")
        scores = mine["score"].to_numpy()
        return scores, [i.encode() for i in mine["id"]], mine["y"].to_numpy()[:, None] == 1

    def cells(key: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        part, model = int(key[0]), key[1]
        scores, ids, positive = ordered(mine)
        out = []
        for reps in _batches(replicates):
            w = draw_weights(ids, reps, seed)
            pos, neg = np.where(positive, w, 0), np.where(positive, 0, w)
            inner = (scores < scores[0]) & (scores > scores[-1])
            for edge, at in ((True, scores == scores[0]), (True, (scores == scores[-1]) & (scores < scores[0])), (False, inner)):
                if not at.any():
                    continue
                p, n = pos[at], neg[at]
                flagged = scores[at] >= thresholds[model]
                wins = np.zeros(len(reps))
                if not edge:
                    a, b = _merged(scores[at], p, n)
                    wins = (a * (b.sum(axis=0) - np.cumsum(b, axis=0) + b / 2)).sum(axis=0)
                out.append(pd.DataFrame({"model": models.index(model), "part": -1 if edge else part, "score": scores[at][0], "edge": edge, "rep": np.array(reps, dtype=np.int32),
                                         "pos": p.sum(axis=0), "neg": n.sum(axis=0), "tp": p[flagged].sum(axis=0), "fp": n[flagged].sum(axis=0), "wins": wins}))
        return pd.concat(out)

    found = rows.groupBy("part", "model").applyInPandas(cells, CELL)
    # Edges of one score from all parts become one cell.
    sums = [F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp", "wins")]
    merged = materialize(found.groupBy("model", "rep", "score", "edge", "part").agg(*sums))
    above = W.partitionBy("model", "rep").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("model", "rep")
    zero = F.lit(0).cast("long")
    placed = materialize(merged.select(
        "*", F.coalesce(F.sum("pos").over(above), zero).alias("pos_above"), F.coalesce(F.sum("neg").over(above), zero).alias("neg_above"),
        F.sum("pos").over(whole).alias("pos_all"), F.sum("neg").over(whole).alias("neg_all")))

    def steps(key: tuple, mine: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"model": [], "rep": [], "steps": []})
        if mine.empty or start.empty:
            return empty
        scores, ids, positive = ordered(mine)
        at = (scores < scores[0]) & (scores > scores[-1])
        start, out = start.sort_values("rep"), []
        for reps in _batches(replicates):
            w = draw_weights([i for i, a in zip(ids, at) if a], reps, seed)
            p, n = _merged(scores[at], np.where(positive[at], w, 0), np.where(positive[at], 0, w))
            tp = np.cumsum(p, axis=0) + start["pos_above"].to_numpy()[reps.start:reps.stop]
            fp = np.cumsum(n, axis=0) + start["neg_above"].to_numpy()[reps.start:reps.stop]
            out.append(pd.DataFrame({"model": int(key[1]), "rep": np.array(reps, dtype=np.int32), "steps": np.where(p > 0, p * tp / np.maximum(tp + fp, 1), 0.0).sum(axis=0)}))
        return pd.concat(out)

    # Models go by their number from here on.
    numbered = rows.withColumn("model", F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")).cast("int") - 1)
    inside = numbered.groupBy("part", "model").cogroup(placed.filter("not edge").select("part", "model", "rep", "pos_above", "neg_above").groupBy(
        "part", "model")).applyInPandas(steps, "model int, rep int, steps double").groupBy("model", "rep").agg(F.sum("steps").alias("inside"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    edge_wins = F.when(F.col("edge"), pos * neg / 2).otherwise(F.col("wins"))
    below = F.col("neg_all") - F.col("neg_above") - neg
    through = F.col("pos_above") + pos
    edge_steps = F.when(F.col("edge") & (pos > 0), pos * through / (through + F.col("neg_above") + neg)).otherwise(0.0)
    total = placed.groupBy("model", "rep").agg(
        F.sum(edge_wins + pos * below).alias("wins"), F.sum(edge_steps).alias("steps"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.max("pos_all").cast("double").alias("all_pos"), F.max("neg_all").cast("double").alias("all_neg"))
    every = total.join(inside, ["model", "rep"], "left")
    name = F.element_at(F.array(*[F.lit(m) for m in models]), F.col("model") + 1).alias("model")
    return every.select(name, "rep", "wins", (F.col("steps") + F.coalesce("inside", F.lit(0.0))).alias("steps"), "tp", "fp", "all_pos", "all_neg")


def replicates_sql(thresholds: dict[str, float], replicates: int, seed: int = 42, source: str = "wide") -> str:
    """CTE `reps`: `(model, rep, roc_auc, average_precision, f1)` of the same replicates, from `source(id, y, <models>)`."""
    models = list(thresholds)
    cells = " UNION ALL ".join(
        f"SELECT '{m}' AS model, rep, {m} AS score, CAST(sum(w * y) AS DOUBLE) AS pos, CAST(sum(w * (1 - y)) AS DOUBLE) AS neg FROM weighted GROUP BY rep, {m}"
        for m in models)
    return f"""digests AS MATERIALIZED (
  SELECT id, y, {', '.join(models)}, b, md5('{seed}:' || b || ':' || id) AS h FROM {source}, range({-(-replicates // PER_BLOCK)}) u(b)),
weighted AS MATERIALIZED (
  SELECT * FROM (SELECT id, y, {', '.join(models)}, CAST(b * {PER_BLOCK} + j AS INTEGER) AS rep, {weight_sql('h', 'j')} AS w FROM digests, range({PER_BLOCK}) v(j))
  WHERE w > 0 AND rep < {replicates}),
rep_cells AS ({cells}),
rep_curve AS (
  SELECT *, sum(pos) OVER t AS tp, sum(neg) OVER t AS fp, sum(pos) OVER (PARTITION BY model, rep) AS all_pos, sum(neg) OVER (PARTITION BY model, rep) AS all_neg
  FROM rep_cells WINDOW t AS (PARTITION BY model, rep ORDER BY score DESC)),
reps AS (
  SELECT model, rep, sum(pos * (all_neg - fp + neg / 2)) / (max(all_pos) * max(all_neg)) AS roc_auc,
    sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / max(all_pos) AS average_precision,
    2 * sum(pos) FILTER (score >= t) / (sum(pos + neg) FILTER (score >= t) + max(all_pos)) AS f1
  FROM rep_curve JOIN (VALUES {', '.join(f"('{m}', {t:.17e})" for m, t in thresholds.items())}) c(m, t) ON m = model GROUP BY model, rep)"""
