"""Each stage of the pipeline against a plain version of it, on what the stage before it kept."""

import re
from collections import Counter

import duckdb
import pytest
from test_jaccard import brute as components
from test_substrings import WORD
from test_substrings import brute as cut

import corpus_pipeline as P
from attesta.llm import curriculum, quality, shared


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The inputs of the stages and, last, the result, each written and read again."""
    out, docs = [], shared.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(P.STAGES):
        out.append(docs)
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "mixing sources to target weights"]


def test_quality(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r["doc_id"] for r in quality.resampled(stages[0], labels).where("kept").collect()}
    assert set(texts(stages[1])) == kept
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & kept) > 0.9 * len(good)


def test_one_of_each_group(stages):
    before = texts(stages[1])
    named = components(sorted(before.items()), 5, 8, 10)
    assert texts(stages[2]) == {i: t for i, t in before.items() if named[i][1] == i}


def test_repeats(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want = cut(sorted(before.items()))
    import hashlib

    assert set(after) == set(before)
    for i, t in after.items():
        words = WORD.findall(t)
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == want[i][2]
        if not want[i][1]:
            assert t == before[i]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_leaks(spark, sf_dir, stages):
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    gone = set(before) - set(after)
    assert set(after) <= set(before)
    whole = {i for i, t in before.items() if any(x in flat(t) for x in items)}
    assert whole <= gone  # and the rest of those that go hold half of an item at least
    for i in gone - whole:
        w = flat(before[i]).split()
        assert any(any(" " + " ".join(x.split()[k : k + 8]) + " " in " " + " ".join(w) + " " for k in range(len(x.split()) - 7)) for x in items)


def test_mix(spark, stages, tmp_path):
    stages[4].coalesce(1).write.parquet(f"file://{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, taken FROM ({curriculum.OP3_SQL}) WHERE taken > 0").fetchall()}
    assert {r["doc_id"]: r["taken"] for r in stages[5].collect()} == want


def test_run_is_the_stages(spark, sf_dir, stages):
    key = lambda df: sorted((r["doc_id"], r["taken"], r["position"]) for r in df.collect())
    assert key(P.run(spark, sf_dir)) == key(stages[-1])


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    """Each stage on nulls, empty and very long texts, repeated rows and clashing columns: no row is made up or
    comes twice, and the columns stay."""
    before = Counter(str(r["doc_id"]) for r in odd_docs.collect())
    for n, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, odd_docs, sf_dir)
        got = Counter(str(r["doc_id"]) for r in out.collect())
        assert got <= before and got["10"] == 1
        assert n == len(P.STAGES) - 1 or out.columns == odd_docs.columns
        assert stage(spark, no_docs, sf_dir).count() == 0
