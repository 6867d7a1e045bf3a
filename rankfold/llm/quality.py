"""Quality from compression: two zstandard dictionaries, one of good and one of bad text, and how well each shortens a text.

A text is cut into pieces of `PIECE` bytes and every piece is compressed with either dictionary, so that a long text is
measured against the dictionaries to its end. The difference of the two sums per byte of text is the raw score; a
logistic curve fitted on other labelled rows turns it into the probability that the text is good.

The model is fitted on a bounded sample: at most `DICTIONARY_DOCS` labelled rows per class, of these `PIECES` pieces, and
`CALIBRATION_DOCS` further rows for the curve, all drawn by hash of the id. Scoring reads every text in full.

Defined cases: null and empty texts have raw score 0 and so the curve's value there; labels other than 0 and 1 and labels
without a text are ignored; of several labels of an id the smallest counts; a class without text compresses without a
dictionary; without labels of both classes the score is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import fold, unit_hash
from rankfold.llm.words import text_bytes

PIECE, PIECES, DICTIONARY_BYTES = 2048, 6000, 1 << 18
DICTIONARY_DOCS, CALIBRATION_DOCS = 4000, 8000
LEVEL, THRESHOLD = 3, 0.7


def _pieces(column: pa.Array):
    """Pieces of each row; an empty text has none."""
    data, limits = text_bytes(column)
    view = memoryview(np.ascontiguousarray(data))
    for a, b in zip(limits[:-1], limits[1:]):
        yield [view[i:min(i + PIECE, b)] for i in range(int(a), int(b), PIECE)]


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def build_dictionary(pieces: list[bytes]) -> bytes | None:
    """Trained dictionary; with too few pieces to train on, the pieces themselves."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:] or None


def _gain(pieces: list, better: zstandard.ZstdCompressor, worse: zstandard.ZstdCompressor) -> float:
    """Bytes with the bad dictionary less bytes with the good one, per byte of text."""
    gain = sum(len(worse.compress(p)) - len(better.compress(p)) for p in pieces)
    return gain / max(1, sum(map(len, pieces)))


def raw_score(docs: DataFrame, good: bytes | None, bad: bytes | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`(id, raw)` of every row."""

    def measure(batches):
        better, worse = _compressor(good), _compressor(bad)
        for batch in batches:
            raw = [_gain(pieces, better, worse) for pieces in _pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], names=[id_column, "raw"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, docs[text_column].cast("string").alias("text")).mapInArrow(measure, f"`{id_column}` {kind}, raw double")


def fit_curve(raw: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """`(slope, offset, scale)` of the logistic curve, by Newton steps with a weak pull to zero."""
    scale = float(np.std(raw)) or 1.0
    x = np.column_stack([raw / scale, np.ones(len(raw))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (label - p) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1]), scale


class CompressionClassifier:
    """Dictionaries and curve; `fit` once, then `score` any table."""

    def __init__(self, good: bytes | None, bad: bytes | None, slope: float, offset: float, scale: float):
        self.good, self.bad, self.slope, self.offset, self.scale = good, bad, slope, offset, scale

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality"):
        """Fits on the rows of `labels`, a bounded sample of them."""
        labels = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter(
            F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
        order = unit_hash("quality", "id")
        drawn = labels.withColumns({"order": order, "part": F.floor(unit_hash("part", "id") * 2)}).persist()
        parts = [drawn.filter(f"part = 0 and label = {c}").orderBy("order", "id").limit(DICTIONARY_DOCS) for c in (0, 1)]
        parts.append(drawn.filter("part = 1").orderBy("order", "id").limit(CALIBRATION_DOCS))
        chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
        # At most 2 * DICTIONARY_DOCS + CALIBRATION_DOCS narrow rows are broadcast.
        texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(chosen), "id")
        texts = texts.groupBy("id").agg(F.first("part").alias("part"), F.first("label").alias("label"), F.min("text").alias("text")).persist()
        good, bad = (build_dictionary(_sample(texts.filter(f"part = 0 and label = {c}"))) for c in (1, 0))
        rows = raw_score(texts.filter("part = 1"), good, bad, "id").join(texts.filter("part = 1").select("id", "label"), "id").collect()
        texts.unpersist()
        drawn.unpersist()
        raw, label = np.array([r["raw"] for r in rows], dtype=float), np.array([r["label"] for r in rows], dtype=float)
        if len(set(label.tolist())) < 2:
            return cls(good, bad, 0.0, 0.0, 1.0)
        return cls(good, bad, *fit_curve(raw, label))

    def score(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """`(id, raw, score)` of every row, in one pass without a shuffle."""
        z = F.lit(self.slope / self.scale) * F.col("raw") + F.lit(self.offset)
        return raw_score(docs, self.good, self.bad, id_column, text_column).withColumn("score", 1 / (1 + F.exp(-z)))


    def keep(self, docs: DataFrame, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """Rows that score at least the threshold, with all their columns; a filter in place, without a shuffle."""
        at, slope, offset, good, bad = docs.columns.index(text_column), self.slope / self.scale, self.offset, self.good, self.bad

        def choose(batches):
            better, worse = _compressor(good), _compressor(bad)
            for batch in batches:
                raw = np.array([_gain(pieces, better, worse) for pieces in _pieces(batch.column(at))], dtype=float)
                yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(slope * raw + offset, -700, 700))) >= threshold))

        return docs.mapInArrow(choose, docs.schema)


def _sample(texts: DataFrame) -> list[bytes]:
    """At most PIECES pieces of the texts, by hash. A task puts the first ones together, and only these reach the driver, once."""

    def cut(batches):
        for batch in batches:
            out = [bytes(p) for row in _pieces(batch.column(0)) for p in row]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["piece"])

    pieces = texts.select("text").mapInArrow(cut, "piece binary")
    return pieces.orderBy(F.xxhash64("piece"), "piece").limit(PIECES).toArrow().column(0).to_pylist()


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.filter(fold("doc_id", 4) != 2)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every document; fitted without the held-out fold."""
    model = CompressionClassifier.fit(docs, training_labels(labels))
    return model.score(docs).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
