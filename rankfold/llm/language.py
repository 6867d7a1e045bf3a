"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, runs of anything but letters become one space, and runs of one to three characters are hashed to `BUCKETS`
columns. A document's column is (1 + ln count) * idf, scaled to length one. Document frequencies come from every training text, added
up within tasks before they are shuffled. The weights are learnt by follow-the-regularised-leader with an elastic net (L1 keeps most
weights at exactly zero, L2 shrinks the others), one document at a time; a temperature fitted on other labelled documents
makes the highest probability a calibrated score.

Only the regression is fitted on a bounded sample: at most `PER_LANGUAGE` documents a language, drawn by hash of the id, of which a
share of `CALIBRATION` sets the temperature. The sample is read whole texts, in one task, in hash order; the driver sees counts per language, one
number per bucket and the weights. Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text, or one without a letter, is `und` with score 0; a null language teaches nothing; without
labelled training texts every text is `und` with score 0, with a single language its score is 1; very long texts are read in
windows that overlap, so their counts are those of the whole; rows that repeat an id and language teach once (the least text), and are each
scored; a null id hashes as the empty text; equal scores go to the first language by code point; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import fold, unit_hash

ORDERS, BUCKET_BITS = (1, 2, 3), 16
BUCKETS = 1 << BUCKET_BITS
PER_LANGUAGE, CALIBRATION = 900, 1 / 3
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 0.002, 0.0002, 3
WINDOW = 1 << 20
UNKNOWN = "und"
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _letters_and_spaces(text: str, after_space: bool) -> np.ndarray:
    """Code points of the letters, every other run as one space; none first if a space stands before."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if len(keep):
        keep[0] |= not after_space
    return np.where(letter, code, np.uint32(32))[keep]


def gram_counts(text: str | None, window: int = WINDOW) -> np.ndarray | None:
    """Counts by bucket of the whole text, with a space at either end; None without a letter."""
    total, tail, any_letter = None, np.full(1, 32, dtype=np.uint32), False
    text = text or ""
    for begin in range(0, len(text), window):
        part = _letters_and_spaces(text[begin:begin + window], tail[-1] == 32)
        if begin + window >= len(text) and (part[-1] if len(part) else tail[-1]) != 32:
            part = np.append(part, np.uint32(32))
        any_letter = any_letter or bool((part != 32).any())
        run, held = np.concatenate([tail, part]), len(tail)
        code = run.astype(np.uint64)
        for n in ORDERS:
            first = max(0, held - n + 1)  # runs that end in the new part
            if len(run) - first < n:
                continue
            key = np.full(len(run) - first - n + 1, n, dtype=np.uint64)
            for i in range(n):
                key = (key ^ code[first + i:len(run) - n + 1 + i]) * _FACTOR[i]
                key ^= key >> np.uint64(29)
            found = np.bincount(((key * _FACTOR[0]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
            total = found if total is None else total + found
        tail = run[-(max(ORDERS) - 1):]
    return total if any_letter else None


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in use and their TF-IDF values, of length one."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / max(float(np.sqrt(value @ value)), 1e-300)


class Leader:
    """Follow-the-regularised-leader for a multinomial regression with elastic net, per coordinate; the intercept has no L1."""

    def __init__(self, buckets: int, classes: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        slope = softmax(value @ w)
        slope[label] -= 1
        g = value[:, None] * slope
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """Temperature of the least log loss, by golden section on its logarithm; 1 without rows."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(p)), label], 1e-300)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[np.ndarray, int]:
    """Number of texts that hold each bucket, and of all texts with a letter. Tasks add up before anything is shuffled."""

    def count(batches):
        total, texts = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = gram_counts(text.as_py())
                if found is not None:
                    total[:BUCKETS] += found > 0
                    texts += 1
        total[BUCKETS] = texts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "texts"])

    rows = docs.select(F.col(text_column).cast("string")).mapInArrow(count, "bucket int, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts"))
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in rows.collect():  # a row per bucket at most
        out[r["bucket"]] = r["texts"]
    return out[:BUCKETS], int(out[BUCKETS])


class LanguageModel:
    """Weights of the buckets in use, intercepts and temperature; `fit` once, then `predict` any table."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    @classmethod
    def fit(cls, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE):
        """Fits on the rows of `docs`: frequencies on all texts, the regression on a sample of `per_language` documents a language."""
        rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
        rows = rows.filter("lang is not null and text is not null")
        sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("id").alias("n")).collect()}  # a row per language
        languages = sorted(sizes)
        if not languages:
            return cls([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
        held, texts = document_frequencies(rows)
        idf = np.log((1 + texts) / (1 + held)) + 1
        share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * per_language / max(n, 1)))]), F.col("lang"))
        order = unit_hash("language", "id")
        drawn = rows.withColumn("order", order).filter(F.col("order") <= share).groupBy("lang", "order", "id").agg(F.min("text").alias("text"))
        part = (unit_hash("temperature", "id") < CALIBRATION).alias("calibrates")
        sample = drawn.select("order", "id", "lang", part, "text").repartition(1).sortWithinPartitions("order", "id", "lang")
        trained = sample.select("lang", "calibrates", "text").mapInArrow(_trainer(languages, idf, per_language), "bucket int, weight array<double>").collect()
        weights, temperature = np.zeros((BUCKETS + 1, len(languages))), 1.0
        for r in trained:  # a row per bucket in use at most
            if r["bucket"] < 0:
                temperature = r["weight"][0]
            else:
                weights[r["bucket"]] = r["weight"]
        return cls(languages, idf, weights, temperature)

    def predict(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """`(id, lang_pred, score)` of every row."""
        languages, temperature = self.languages, self.temperature
        idf, weights = self.idf.astype(np.float32), self.weights.astype(np.float32)

        def label(batches):
            for batch in batches:
                found, score = [], []
                for text in batch.column(1):
                    counts = gram_counts(text.as_py()) if languages else None
                    if counts is None:
                        found.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    at, value = features(counts, idf)
                    p = softmax((value @ weights[at] + weights[-1]).astype(float) / temperature)
                    best = int(p.argmax())
                    found.append(languages[best])
                    score.append(float(p[best]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

        kind = docs.schema[id_column].dataType.simpleString()
        return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(label, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def _trainer(languages: list[str], idf: np.ndarray, per_language: int):
    """Reads the sample in its order; gives the weights of the buckets in use and, at bucket -1, the temperature."""
    number = {lang: i for i, lang in enumerate(languages)}

    def train(batches):
        taken, learn, check = [0] * len(languages), [], []
        for batch in batches:
            for lang, calibrates, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                k = number[lang]
                counts = gram_counts(text.as_py()) if taken[k] < per_language else None
                if counts is not None:
                    taken[k] += 1
                    at, value = features(counts, idf)
                    (check if calibrates else learn).append((at.astype(np.int32), value.astype(np.float32), k))
        leader = Leader(len(idf), len(languages))
        for _ in range(EPOCHS):
            for at, value, k in learn:
                leader.learn(at, value, k)
        weights = leader.weights(np.arange(len(leader.z)))
        logits = np.array([value @ weights[at] + weights[-1] for at, value, _ in check]).reshape(-1, len(languages))
        warm = fit_temperature(logits, np.array([k for *_, k in check], dtype=int)) if learn else 1.0
        used = np.flatnonzero(weights.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array([[warm], *weights[used].tolist()], pa.list_(pa.float64()))],
                                         names=["bucket", "weight"])

    return train


def identify(docs: DataFrame) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)` of every document; fitted without the held-out fifth."""
    model = LanguageModel.fit(docs.filter(fold("doc_id", 5) != 0))
    return model.predict(docs).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
