"""The pipeline against its stages' plain definitions, and the registered queries against their SQL."""

from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from helpers import edited, prose
from oracle import compare, connect
from test_operators import DOCS, plain_components, plain_leaks, plain_lines

from rankfold.llm import quality
from rankfold.llm.queries import REGISTRY, SQL

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and shouted texts, exact and near copies, repeated lines, a benchmark passage, nulls and repeated rows."""
    folder = tmp_path_factory.mktemp("corpus")
    item = prose(20, 700)
    texts = [prose(50, s) + "\n" + prose(12, 900 + s % 3) + f" {s % 3}" for s in range(60)]
    texts += ["!! ".join(prose(60, 1000 + s).upper().split()) for s in range(60)]
    texts += [texts[0], edited(texts[1], 1, 5), prose(30, 801) + " " + item + " " + prose(30, 802), None, "", "tiny"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], (None, prose(40, 77), "en", None, 0)]
    frame = spark.createDataFrame(rows, DOCS)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, [(1, item)]


def test_stages_do_what_their_operators_say(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = quality.CompressionClassifier.fit(docs, quality.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    good = {r["text"] for r in model.score(docs.select("doc_id", "text")).join(docs.select("doc_id", "text"), "doc_id").filter("score >= 0.7").collect()}
    left = [(i, t) for i, t, *_ in rows if t in good or (i is None)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        assert docs.columns == columns
        if name == "quality_classifier":
            assert {t for i, t in got if i is not None} == {t for i, t in left if i is not None}
            left = list(got.elements())
        elif name == "line_dedup":
            cut = plain_lines(left, 1, 16)
            left = [(i, cut[i, t]) for i, t in left if not (cut[i, t] == "" and t)]
            assert got == Counter(left)
        elif name == "jaccard_join":
            component = plain_components(left)
            left = [(i, t) for i, t in dict.fromkeys(left) if i is None or component[i] == i]
            assert got == Counter(left)
        elif name == "decontamination":
            leaking = {d for d, _ in plain_leaks(left, items)}
            left = [(i, t) for i, t in left if i not in leaking]
            assert leaking and got == Counter(left)
        else:
            assert set(got) <= set(left) and max(got.values()) <= 2


def test_short_lines_stay_once(spark):
    texts = ["Menu\n" + prose(9, 1), prose(9, 2) + "\n\n Menu\t\nMenus", "\n", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    got = [r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()]
    assert got == [texts[0], prose(9, 2) + "\n\nMenus", "\n", None]


def test_run_equals_its_stages_and_reruns_agree(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert Counter(docs.collect()) == Counter(corpus_pipeline.run(spark, folder).collect())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(str(SF)), REGISTRY[name], SQL[name], str(SF)) is None
