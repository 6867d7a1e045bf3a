"""Token alignment, language identification and conversation repair against plain versions."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
from helpers import EDGE_TEXTS, prose
from pyspark.sql import functions as F

from rankfold.llm import alignment, language, turns
from rankfold.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_models = pytest.mark.skipif(not Path(alignment.TOKENIZERS, alignment.BYTE_MODEL).exists(), reason="no tokenizer files")


def documents(spark, texts, ids=None, langs=None):
    ids, langs = ids or range(len(texts)), langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in zip(ids, texts, langs)], DOCS)


def crowded(df):
    return df.withColumns({c: F.lit("other") for c in ("row", "id", "a", "b", "times", "docs", "best", "n", "conv", "at", "fault", "state", "score", "order")})


# conversation repair


def plain_best(initials, faults):
    """`(cost, audit)` by trying every edit of every turn, cheapest first, then least."""

    @lru_cache(maxsize=None)
    def ahead(i, state, put):
        out = []
        if i == len(initials):
            if state in "0a":
                out.append((0, ""))
        else:
            late = 1 if faults[i] == "truncated" else 0
            cost, audit = ahead(i + 1, state, 0)
            out.append((cost + 3, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                for role in {"0": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    step, letter = (0, "K") if initials[i] == role else (2, "R")
                    if letter == "K" or role != "s":
                        cost, audit = ahead(i + 1, role, 0)
                        out.append((cost + step + late, letter + audit))
        if put < 3:
            cost, audit = ahead(i, {"0": "u", "s": "u", "u": "a", "a": "u"}[state], put + 1)
            out.append((cost + 2, "I" + audit))
        return min(out) if out else (10**6, "")

    return ahead(0, "0", 0)


def plain_repair(rows):
    """Report of one conversation's `(turn, role, text)` after the damage, and its repaired lines."""
    rows = sorted(((t, r or " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = plain_best(tuple(initials), tuple(faults))
    lines, state, i = [], "0", 0
    for edit in audit:
        nxt = "a" if state == "u" else "u"
        if edit == "I":
            lines.append(turns.ROLE[nxt] + ":")
            state = nxt
            continue
        if edit != "D":
            state = nxt if edit == "R" else initials[i]
            lines.append(f"{turns.ROLE[nxt] if edit == 'R' else rows[i][1]}:{rows[i][2]}")
        i += 1
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = Counter(faults)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def test_best_edits_equal_all_edits():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 9)
        initials = [rng.choice("suax") for _ in range(n)]
        faults = [rng.choice([None, None, None, "truncated", "blank"]) for _ in range(n)]
        codes = "".join("d" if f == "blank" else c.upper() if f else c for c, f in zip(initials, faults))
        cost, audit, after = turns.best_edits(codes, turns.START, turns.AT_END)
        assert (cost, audit + "I" * (turns.AT_END[after] // 2)) == plain_best(tuple(initials), tuple(faults))


def conversation(rng, n):
    out = []
    for t in range(n):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
        out.append((t + (t > n // 2), role, prose(rng.randrange(1, 6), rng.randrange(50)) + rng.choice([".", "!", "?", "", ". \n"])))
    return out


@pytest.mark.parametrize("bits", [1, 2, 6])
def test_repair_equals_plain_version(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "PIECE_BITS", bits)
    rng = random.Random(bits)
    groups = {i: conversation(rng, rng.randrange(1, 9)) for i in range(40)}
    groups[100] = conversation(rng, 150)
    groups[101] = [(0, "system", "Be kind."), *[(i + 1, r, t) for i, r, t in conversation(rng, 30)]]
    groups[102] = [(3, "user", "Same."), (3, "user", "Same."), (3, "assistant", "Tie."), (None, None, None), (None, "tool", "x" * 200_000)]
    groups[103] = [(0, "user", ""), (1, "assistant", " \t\n")]
    groups[None] = [(1, "user", "Hello."), (5, "system", "Late?"), (9, "", "No role.")]
    groups[104] = [(0, "system", "Alone.")]
    groups[105] = [(7, "user", "Again.")] * 40
    rows = [(c, *r) for c, rs in groups.items() for r in rs]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv"]: tuple(r[1:]) for r in turns.report(crowded(table)).collect()}
    want = {c: plain_repair(rs) for c, rs in groups.items()}
    assert got == {c: w[0] for c, w in want.items()}
    if bits == 2:
        fixed = defaultdict(list)
        for r in turns.repair(crowded(table)).filter("edit <> 'D'").orderBy("at", "part").collect():
            fixed[r["conv"]].append(f"{r['role']}:{r['text']}")
        assert fixed == {c: w[1] for c, w in want.items() if w[1]}


def test_conversations_that_lose_all_turns_are_reported(spark):
    table = spark.createDataFrame([(i, t, "user", "Hm.") for i in range(60) for t in range(1)] + [(None, None, None, None)],
                                  "conv_id long, turn long, role string, text string")
    got = turns.damaged_report(table).collect()
    assert len(got) == 61
    lost = turns.damage(table).select("conv_id").distinct().count()
    empty = [r for r in got if r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and not r["audit"]]
    assert 61 - lost > 0 and len(empty) >= 61 - lost and all(r["cost"] == r["gaps"] == 0 for r in empty)
    assert turns.damaged_report(table.limit(0)).count() == turns.report(table.limit(0)).count() == 0


# token alignment


def plain_alignment(encoders, text):
    """Groups by testing every byte offset."""
    a, b = (x.tolist() for x in encoders.encode(text))
    ends = []
    for ids, spelled in ((a, encoders.bytes_a), (b, encoders.bytes_b)):
        at, out = 0, []
        for i in ids:
            at += len(spelled[i])
            out.append(at)
        ends.append(out)
    groups, x, y = [], 0, 0
    after = [{end: i + 1 for i, end in enumerate(e)} for e in ends]
    for end in range(1, (ends[0][-1] if a else 0) + 1):
        if end in after[0] and end in after[1]:
            p, q = after[0][end], after[1][end]
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
    return a, b, groups


@needs_models
@pytest.mark.parametrize("told, links", [(0, 1), (50, 1 << 16), (500_000, 1 << 16)])
def test_alignment_equals_plain_version(spark, monkeypatch, told, links):
    monkeypatch.setattr(alignment, "GROUP_LINKS", links)
    monkeypatch.setattr(alignment, "TOLD", told)
    texts = [*EDGE_TEXTS, "The <|endoftext|> mark and </s> stay text.", "日本語のテキスト 한국어 ñandú 🙂🙃", "   spaces    and\ttabs\n\n\nlines", "ﬁ ² ①",
             *[prose(n, n) for n in (1, 3, 30, 31, 32)], prose(30, 30), prose(9000, 1), "naïve " * 5, " x", " lead", "a" * 3000, "ก" * 500]
    ids = [3 * i for i in range(len(texts) - 1)] + [None]
    df = crowded(documents(spark, texts, ids).drop("source")).repartition(3)
    aligned = alignment.align(df)
    counts = alignment.link_counts(aligned)
    scored = {r["row"]: r for r in alignment.score_links(aligned, counts, told).collect()}
    encoders = alignment.Encoders(*alignment.read_encoders())
    plain = [plain_alignment(encoders, t or "") for t in texts]
    pairs = [Counter((i, j) for x, y in groups for i in x for j in y) for *_, groups in plain]
    held = Counter(p for c in pairs for p in c)
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    assert {(r["a"], r["b"]): (r["docs"], r["best"]) for r in counts.collect()} == {p: (n, n == most[p[0]]) for p, n in held.items()}
    want = Counter()
    for i, (a, b, groups), c in zip(ids, plain, pairs):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        want[(i, len(a), len(b), len(groups), sum(c.values()), sum(m for p, m in c.items() if held[p] == most[p[0]]),
              sum(m * held[p] for p, m in c.items()), hashlib.sha256(text.encode()).hexdigest() if a else "")] += 1
    got = Counter()
    for r in aligned.collect():
        s = scored.get(r["row"])
        got[(r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], s["n_best"] if s else 0, s["count_sum"] if s else 0, r["groups_sha256"])] += 1
    assert got == want
    assert sum(n for k, n in got.items() if k[1]) >= 15  # most texts are spelled by both


@needs_models
def test_ranks_equal_the_merges_they_stand_for():
    encoders = alignment.Encoders(*alignment.read_encoders())
    rng = random.Random(8)
    letters = [chr(c) for c in range(32, 0x250)] + list(" \n\t'.,0aé") * 30
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(3000)] + ["Ā" * 50, " " * 40, "x\r\n \n y", "The <|endoftext|> mark", "it's we'LL"]
    texts += [x.decode() for x in encoders.bytes_a[::7] if x and x.decode("utf-8", "ignore").encode() == x]
    assert all(encoders.first(t).tolist() == encoders._a.encode(" " + t, add_special_tokens=False).ids for t in texts)


def test_cuts_equal_those_of_dictionaries_and_take_less_time():
    def plain(a, b, size_a, size_b):
        at_a, at_b = ({int(end): i + 1 for i, end in enumerate(np.cumsum(size[ids]))} for ids, size in ((a, size_a), (b, size_b)))
        shared = [end for end in at_a if end in at_b]
        return [at_a[end] for end in shared], [at_b[end] for end in shared]

    rng = np.random.default_rng(4)
    for least in (0, 1):  # also tokens without bytes, and lists that end apart
        for _ in range(500):
            sizes = rng.integers(least, 4, 8), rng.integers(least, 5, 8)
            ids = rng.integers(0, 8, rng.integers(0, 12)), rng.integers(0, 8, rng.integers(0, 12))
            assert tuple(x.tolist() for x in alignment.group_cuts(*ids, *sizes)) == plain(*ids, *sizes)
    ids, sizes = (rng.integers(0, 8, 300_000), rng.integers(0, 8, 300_000)), (np.arange(1, 9), np.arange(1, 9))
    took = []
    for cuts in (alignment.group_cuts, plain):
        start = time.process_time()
        cuts(*ids, *sizes)
        took.append(time.process_time() - start)
    assert 2 * took[0] < took[1]


@needs_models
def test_slices_of_texts_align_as_single_ones(monkeypatch):
    texts = [*EDGE_TEXTS, None, "", "日本語", "ﬁ ² ①", *[prose(n, n) for n in (1, 30, 200)], "naïve x"]
    aligner = alignment.Aligner(alignment.Encoders(*alignment.read_encoders()))
    plain = [(r[:4], r[4].tolist(), r[5].tolist()) for t in texts for r in aligner.align([t])]
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(alignment, "SLICE_CHARS", size)
        slices = list(alignment._slices(texts))
        assert [t for part in slices for t in part] == texts and (size < 1000) == (len(slices) > 1)
        assert [(r[:4], r[4].tolist(), r[5].tolist()) for part in slices for r in aligner.align(part)] == plain


@needs_models
def test_alignment_report_of_repeats_and_nothing(spark):
    df = documents(spark, ["one two", "one two", None], [7, 7, 8])
    got = sorted((r["doc_id"], r["n_links"] > 0, r["count_sum"] == 2 * r["n_links"]) for r in alignment.report(df).collect())
    assert got == [(7, True, True), (7, True, True), (8, False, True)]
    assert alignment.report(df.limit(0)).count() == 0
    drawn = alignment.align(df, groups=True).filter("id = 7").first()
    assert hashlib.sha256(drawn["groups"].encode()).hexdigest() == drawn["groups_sha256"]


# language


def test_gram_counts_of_windows_equal_those_of_the_whole():
    text = "Ab9-cd, ÉÉ  ü\n" * 7 + "zz"
    whole = language.gram_counts(text)
    letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    assert whole.sum() == sum(len(letters) - n + 1 for n in language.ORDERS) - 1  # the space put first is no run of its own
    assert np.count_nonzero(whole) <= len({letters[i:i + n] for n in language.ORDERS for i in range(len(letters) - n + 1)})
    for window in (1, 2, 3, 5, 13, 40):
        assert (language.gram_counts(text, window) == whole).all()
    assert all(language.gram_counts(t) is None for t in (None, "", " 12 -\n", "²" * 0))


def test_leader_equals_its_formula():
    rng = random.Random(2)
    leader = language.Leader(6, 3, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        l1 = 0.0 if i == 6 else 0.3
        v = z[i, c]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((1.0 + math.sqrt(n[i, c])) / 0.5 + 0.1)

    for _ in range(60):
        at = sorted(rng.sample(range(6), 3))
        value, label = [rng.random() for _ in at], rng.randrange(3)
        leader.learn(np.array(at), np.array(value), label)
        row = [*zip(at, value), (6, 1.0)]
        w = {(i, c): weight(i, c) for i, _ in row for c in range(3)}
        e = [math.exp(sum(x * w[i, c] for i, x in row)) for c in range(3)]
        for i, x in row:
            for c in range(3):
                g = x * (e[c] / sum(e) - (c == label))
                z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / 0.5 * w[i, c]
                n[i, c] += g * g
    got = leader.weights(np.arange(7))
    assert np.allclose(got, [[weight(i, c) for c in range(3)] for i in range(7)]) and (got == 0).any()


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(400, 3))
    p = language.softmax(logits)
    label = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language.fit_temperature(logits * 4, label) / 4 - language.fit_temperature(logits, label)) < 0.01
    assert 0.7 < language.fit_temperature(logits, label) < 1.4 and language.fit_temperature(logits[:0], label[:0]) == 1.0


def plain_tf_idf(texts):
    counts = [language.gram_counts(t) for t in texts]
    held = sum((c > 0).astype(int) for c in counts)
    return counts, np.log((1 + len(texts)) / (1 + held)) + 1


def invented(seed, letters, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    alphabets = {"aa": "abcdeé", "bb": "cdefgü", "cc": "efghiñ"}
    texts, langs = [], []
    for i in range(240):
        lang = sorted(alphabets)[i % 3]
        texts.append(invented(i, alphabets[lang], 3 + i % 40))
        langs.append(lang if i % 11 else None)
    extra = [None, "", "12 34", "²³ !", "e" * 3, invented(999, alphabets["bb"], 60_000), texts[0]]
    df = documents(spark, texts + extra, [*range(240), *range(500, 506), 0], langs + [None] * 5 + ["bb", "aa"])
    out = {(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.identify(crowded(df).drop("source")).collect()}
    found = {i: lang for i, lang, _ in out}
    held = {r["doc_id"] for r in df.filter(fold("doc_id", 5) == 0).select("doc_id").collect()}
    right = [found[i] == sorted(alphabets)[i % 3] for i in range(240) if i in held]
    assert len(right) > 30 and sum(right) / len(right) > 0.95
    assert all((i, "und", 0.0) in out for i in range(500, 504)) and found[505] == "bb" and all(0 <= s <= 1 for *_, s in out)
    model = language.LanguageModel.fit(df.filter(fold("doc_id", 5) != 0))
    known = [t for i, t, g in zip([*range(240), *range(500, 506), 0], texts + extra, langs + [None] * 5 + ["bb", "aa"]) if g and i not in held]
    _, idf = plain_tf_idf(known)
    assert np.allclose(model.idf, idf)
    assert (model.weights[:-1] != 0).sum() < 0.9 * 3 * (model.weights[:-1] != 0).any(axis=1).sum() or (model.weights[:-1] == 0).any()
    # A score recomputed piece by piece.
    counts = language.gram_counts(texts[5])
    value = {b: (1 + math.log(counts[b])) * idf[b] for b in np.flatnonzero(counts)}
    norm = math.sqrt(sum(v * v for v in value.values()))
    logit = [sum(v / norm * model.weights[b, c] for b, v in value.items()) + model.weights[-1, c] for c in range(3)]
    e = [math.exp(x / model.temperature) for x in logit]
    assert any(i == 5 and abs(s - max(e) / sum(e)) < 1e-4 for i, _, s in out)


def test_language_without_labels(spark):
    df = documents(spark, ["ab", None], [1, 2], [None, "xx"])
    assert {(r["lang_pred"], r["score"]) for r in language.identify(df).collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0)).count() == 0
    only = documents(spark, ["ab cd", "ef"], [1, 3], ["xx", "xx"])
    model = language.LanguageModel.fit(only)
    assert {(r["lang_pred"], r["score"]) for r in model.predict(only).collect()} == {("xx", 1.0)}
