"""Alignment of two tokenizers: where tokens of both end at the same byte, the text is cut into groups, and groups give links.

A text goes through a byte-level BPE (A, with a space put before it) and a sentence-piece model (B, which puts that space
itself). The bytes at which tokens of one side end are marked; the other side's ends that meet a mark,
in order, slice both id lists into groups. Within a group every A token is linked with every B token.

Links of the whole corpus are counted by document. A text then asks how often its pairs are linked elsewhere: pairs that
many documents hold are told to all tasks (at most `TOLD`, whatever the size of the corpus), the others meet their counts by
a join. No pair is left out. A text's pairs are stored once, as arrays of distinct pairs and how often each occurs in it.

Defined cases: null and empty texts, and texts whose tokens don't spell them byte for byte (a model that normalises), have no
tokens: zeros, an empty `groups` and an empty hash. Marks of special tokens inside a text are plain text. A very long text is
encoded whole; links of a very large group are counted by distinct ids, not written out. Rows that repeat an id, or an
id and its text, count as documents of their own; a null id stays null; extra columns are ignored; an empty table gives an
empty result. Equal counts are all best.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import materialize, rows_per_batch

TOKENIZERS = "/opt/tokenizers"
BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that all tasks are told at most; decides how a count is fetched, never its value.
TOLD = 500_000
#: Fixed value: how byte-level BPE of this kind cuts a text before merging; and the end of the Latin blocks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_END = "\u0250"
#: A group of more links than this is counted by distinct ids.
GROUP_LINKS = 1 << 16
#: Texts of about this many characters, or one longer text, go through a step together.
SLICE_CHARS = 1 << 20

ALIGNED = "n_a int, n_b int, n_groups int, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """Character that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the rest follows 255."""
    plain = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    others = (b for b in range(256) if b not in plain)
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def merge_ranks(model: dict, letters: dict[str, int]) -> dict[bytes, int] | None:
    """Bytes of each entry of a byte-level BPE to its id, if ids rise with the order of the merges, so that they serve as ranks; else None."""
    vocabulary = model["vocab"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    order = [vocabulary.get(x, -1) for x in made]
    singles = {c: vocabulary.get(c) for c in letters}
    if None in singles.values() or order != sorted(set(order)) or len(order) + 256 != len({*made, *letters}):
        return None
    return {bytes(letters[c] for c in x): vocabulary[x] for x in (*letters, *made)}


class Encoders:
    """Both tokenizers and the bytes of each of their tokens; made from file contents, so tasks need no files.

    The first model's merges are also run as ranks, several times as fast, on texts of Latin script; letters there are the same to every
    library, which newer scripts need not be.
    """

    def __init__(self, byte_model: str, piece_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(byte_model)
        self._a.encode_special_tokens = True
        letters = byte_alphabet()
        spelled = {i: entry for entry, i in self._a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(letters[c] for c in spelled.get(i, "")) for i in range(self._a.get_vocab_size())]
        described = json.loads(byte_model)
        steps = described.get("pre_tokenizer") or {}
        plain = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and not described.get("normalizer")
        ranks = merge_ranks(described["model"], letters) if plain else None
        self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self._b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        ids = range(self._b.vocab_size())
        pieces = self._b.id_to_piece(list(ids))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]

    def first(self, text: str) -> np.ndarray:
        """Ids of a space and the text, none if they don't spell it. Ranks always do: all bytes are among them."""
        if self._fast is not None and (text.isascii() or max(text) < LATIN_END):
            return np.array(self._fast.encode_ordinary(" " + text), dtype=np.int64)
        ids = self._a.encode(" " + text, add_special_tokens=False).ids
        return np.array(ids if b"".join(map(self.bytes_a.__getitem__, ids)) == b" " + text.encode() else [], dtype=np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of either side; both empty where they don't spell the text."""
        (a,), (b,) = self.encode_all([text])
        return a, b

    def encode_all(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of either side of each text. One side goes after the other: taking turns, each would drive the other's vocabulary out of the cache."""
        none = np.zeros(0, np.int64)
        a = [self.first(text) if text else none for text in texts]
        b = [none] * len(texts)
        for i, text in enumerate(texts):
            ids = self._b.encode(text) if len(a[i]) else []
            if ids and b"".join(map(self.bytes_b.__getitem__, ids)) == b" " + text.encode():
                b[i] = np.array(ids, dtype=np.int64)
            else:
                a[i] = none
        return a, b


def read_encoders(folder: str = TOKENIZERS) -> tuple[str, bytes]:
    """Contents of the two vocabulary files, read on the driver; a few megabytes."""
    text = (Path(folder) / BYTE_MODEL).read_text(encoding="utf-8")
    json.loads(text)  # a broken file ends here and not in a task
    return text, (Path(folder) / PIECE_MODEL).read_bytes()


def group_cuts(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in either list after which each group ends."""
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    here = np.zeros(max(ends_a.max(initial=0), ends_b.max(initial=0)) + 1, dtype=bool)
    here[ends_a] = True
    shared = ends_b[here[ends_b]]
    if len(shared):  # tokens without bytes repeat an end; the last one closes the group
        shared = shared[np.r_[shared[1:] != shared[:-1], True]]
    return np.searchsorted(ends_a, shared, side="right"), np.searchsorted(ends_b, shared, side="right")


class GroupNames:
    """Writes groups as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, vocabulary_a: int, vocabulary_b: int):
        self.a = [np.array([f"{i}{mark}" for i in range(vocabulary_a)], dtype=object) for mark in ",|"]
        self.b = [np.array([f"{i}{mark}" for i in range(vocabulary_b)], dtype=object) for mark in ",;"]

    def render(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """Each token with the mark behind it, put in place by the tokens of either side that stand before it."""
        out = np.empty(len(a) + len(b), dtype=object)
        sizes_a, sizes_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(cut_b - sizes_b, sizes_a)
        place_b = np.arange(len(b)) + np.repeat(cut_a, sizes_b)
        for ids, place, cuts, (inner, last) in ((a, place_a, cut_a, self.a), (b, place_b, cut_b, self.b)):
            out[place] = inner[ids]
            out[place[cuts - 1]] = last[ids[cuts - 1]]
        return "".join(out.tolist())[:-1]


def linked_pairs(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs, as `a << 32 | b` in order, and how many links each has."""
    start_a, start_b = np.r_[0, cut_a[:-1]], np.r_[0, cut_b[:-1]]
    n_a, n_b = cut_a - start_a, cut_b - start_b
    links = n_a * n_b
    few = links <= GROUP_LINKS
    keys, times = [], []
    # Groups of ordinary size: all links written out, some four million at a time.
    chosen = np.flatnonzero(few)
    part = np.cumsum(links[chosen]) >> 22
    for lo, hi in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(chosen)]))(np.flatnonzero(np.diff(part)) + 1)):
        g = chosen[lo:hi]
        group = np.repeat(g, links[g])
        inside = np.arange(len(group)) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
        pair = a[start_a[group] + inside // n_b[group]] << 32 | b[start_b[group] + inside % n_b[group]]
        found = np.unique(pair, return_counts=True)
        keys.append(found[0])
        times.append(found[1])
    for g in np.flatnonzero(~few):
        ids_a, of_a = np.unique(a[start_a[g]:cut_a[g]], return_counts=True)
        ids_b, of_b = np.unique(b[start_b[g]:cut_b[g]], return_counts=True)
        keys.append((ids_a[:, None] << 32 | ids_b).ravel())
        times.append((of_a[:, None] * of_b).ravel())
    if len(keys) < 2:
        return (keys[0], times[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    pair, back = np.unique(np.concatenate(keys), return_inverse=True)
    return pair, np.bincount(back, weights=np.concatenate(times), minlength=len(pair)).astype(np.int64)


class Aligner:
    """Both encoders, and what is looked up for their tokens."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.sizes = [np.array([len(x) for x in spelled], dtype=np.int64) for spelled in (encoders.bytes_a, encoders.bytes_b)]
        self.names = GroupNames(*map(len, self.sizes))

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """`(n_a, n_b, n_groups, groups, pairs, times)` of each text."""
        a, b = self.encoders.encode_all(texts)
        cuts = [group_cuts(*ids, *self.sizes) for ids in zip(a, b)]
        names = [self.names.render(*ids, *at) for *ids, at in zip(a, b, cuts)]
        return [(len(x), len(y), len(at[0]), name, *linked_pairs(x, y, *at)) for x, y, at, name in zip(a, b, cuts, names)]


@lru_cache(maxsize=1)
def _aligner(byte_model: str, piece_model: bytes) -> Aligner:
    """One for all tasks of a worker process."""
    return Aligner(Encoders(byte_model, piece_model))


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, some `SLICE_CHARS` characters at a time."""
    out, held = [], 0
    for text in texts:
        out.append(text)
        held += len(text or "")
        if held >= SLICE_CHARS:
            yield out
            out, held = [], 0
    if out:
        yield out


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, groups: bool = False) -> DataFrame:
    """One stored row per document: `(row, id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times)`, and `groups` if asked.

    `a`, `b`, `times` are the distinct linked pairs and how many links each has; `row` numbers the rows.
    """
    models = read_encoders(folder)
    kind = docs.schema[id_column].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def run(batches):
        aligner = _aligner(*models)
        for batch in batches:
            rows, drawn, pairs, times = [], [], [], []
            for part in _slices(batch.column(1).to_pylist()):
                for n_a, n_b, n_groups, text, pair, of in aligner.align(part):
                    rows.append((n_a, n_b, n_groups, int(of.sum()), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
                    drawn.append(text if groups else None)
                    pairs.append(pair)
                    times.append(of)
            limits = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            pair, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, times))
            lists = [pa.ListArray.from_arrays(limits, pa.array(x.astype(np.int32))) for x in (pair >> 32, pair & 0xFFFFFFFF, of)]
            plain = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.nulls(0, t) for t in types]
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"]
            columns = [batch.column(0), *plain, *lists]
            if groups:
                columns, names = [*columns, pa.array(drawn, pa.string())], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col(id_column), F.col(text_column).cast("string"))
    out = texts.mapInArrow(run, f"id {kind}, {ALIGNED}" + (", groups string" if groups else ""))
    with rows_per_batch(docs.sparkSession, 500):
        return materialize(out.select(F.monotonically_increasing_id().alias("row"), "*"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """`(a, b, docs, best)`: how many documents hold each linked pair, and whether no pair of its A token is in more.

    Counting is combined before the shuffle. The table of largest counts has a row per A token at most, so it is broadcast.
    """
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("p"))
    counted = materialize(pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("docs")))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return materialize(counted.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")))


def told_from(counts: DataFrame, most: int) -> int:
    """Smallest power of two such that at most `most` pairs are in that many documents."""
    level = F.floor(F.log2("docs")).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    cut, total = 63, 0
    while cut > 0 and total + sizes.get(cut - 1, 0) <= most:
        cut, total = cut - 1, total + sizes.get(cut - 1, 0)
    return 1 << min(cut, 62)


def score_links(aligned: DataFrame, counts: DataFrame, told: int = TOLD) -> DataFrame:
    """`(row, n_best, count_sum)` of the rows that have links: links whose count is best, and the sum of counts over all links."""
    cut = told_from(counts, told)
    flat = aligned.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.a", "p.b", "p.times")
    frequent = F.broadcast(counts.filter(F.col("docs") >= cut))  # at most `told` rows
    known = flat.join(frequent, ["a", "b"])
    if cut > 1:
        rare = flat.join(frequent.select("a", "b"), ["a", "b"], "left_anti").join(counts.filter(F.col("docs") < cut), ["a", "b"])
        known = known.unionByName(rare)
    times = F.col("times").cast("long")
    return known.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("docs")).alias("count_sum"))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """`(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)` of every document."""
    aligned = align(docs, id_column, text_column, folder)
    scored = score_links(aligned, link_counts(aligned))
    long = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return aligned.drop("a", "b", "times").join(scored, "row", "left").select(
        F.col("id").cast("long").alias("doc_id"), *map(long, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256")
