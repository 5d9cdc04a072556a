import random

import numpy as np
import pytest

from attesta.llm import quality as Q


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    stock = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [rng.choice(stock) + (rng.choice(["%%%", "###"]) if bad else "") for _ in range(rng.randrange(8, 200))]
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_bad_texts_go_and_good_ones_stay(spark):
    rows, labels = corpus()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = Q.resampled(docs, labels).collect()
    assert len(out) == len(rows)
    good = [r["kept"] for r in out if r["doc_id"] % 5]
    bad = [r["kept"] for r in out if r["doc_id"] % 5 == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05
    again = Q.resampled(docs.repartition(5), labels).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in again) == sorted((r["doc_id"], r["kept"]) for r in out)


def test_whole_table(spark, sf_dir):
    out = {r["doc_id"]: r["kept"] for r in Q.op9_importance_resampling(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert np.mean([out[r["doc_id"]] for r in labels if r["quality"] == 1]) > 0.9


def test_weights_are_sums_of_log_ratios(spark):
    """Against counting in plain Python."""
    import re

    from attesta.llm import shared

    ratio = np.random.default_rng(2).normal(size=Q.BUCKETS)
    texts = ["One two two, three!! x", "", None, "ÉA éa éa.. 5", "a  b\n\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["log_weight"] for r in Q.weighed(docs, Q.Models(ratio, 0.0)).collect()}

    def word_hash(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return shared.word_hashes(shared.Words(raw, np.array([0]), np.array([len(raw)]), np.array([0, 1])))[0]

    for i, t in enumerate(texts):
        low = "".join(c.lower() if c < "\x80" else c for c in t or "")
        toks = [word_hash(w) for w in re.findall(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+|[\x21-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+", low)]
        grams = toks + [Q._REPEAT if a == b else shared.mixed(np.array([a * np.uint64(3) + b]))[0] for a, b in zip(toks, toks[1:])]
        want = sum(ratio[int(shared.mixed(np.array([g]))[0] % np.uint64(Q.BUCKETS))] for g in grams)
        assert got[i] == pytest.approx(want)


@pytest.mark.filterwarnings("ignore")
def test_kth_greatest(spark):
    values = [float(x) for x in np.random.default_rng(3).normal(size=997)] + [5.0] * 7
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 3, 7, 8, 500, len(values)):
        assert Q.kth_greatest(df, "v", k, width=16) == sorted(values, reverse=True)[k - 1]


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.resampled(odd_docs, none).where("kept").count() == odd_docs.count()
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (10, 1, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.resampled(odd_docs, some).count() == odd_docs.count()
    assert Q.resampled(no_docs, some).count() == 0
    assert Q.good_documents(spark, odd_docs, none).columns == odd_docs.columns


def test_sample_is_the_first_by_hash(spark):
    from pyspark.sql import functions as F

    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    want = {r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id")).limit(500).collect()}
    assert {r["doc_id"] for r in Q.labelled_sample(labels, 500).collect()} == want
