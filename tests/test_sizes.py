"""What large inputs need: bounded memory in a worker, no work that grows with rounds."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta.operators import analyze, dense, lexical


class Held:
    """Stands for a DataFrame and keeps the function that a worker would run."""

    def __init__(self, **dtypes):
        self.dtypes = list(dtypes.items())

    def select(self, *_):
        return self

    def mapInPandas(self, f, _):
        self.run = f
        return self


def peak(f) -> float:
    """MB that a call takes at most."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_cosines_of_a_large_batch_stay_small(monkeypatch):
    """A full Arrow batch against many queries: 24 million scores, 16 bytes each, were held at once."""
    rng = np.random.default_rng(3)
    vectors, asked = Held(k="bigint"), pd.DataFrame({"q": range(2400), "embedding": list(rng.normal(size=(2400, 8)))})
    monkeypatch.setattr(lexical, "ranked", lambda rows, *_: rows)
    dense.top_cosines(vectors, "k", asked, "q", 10)
    frame = pd.DataFrame({"k": range(10_000), "embedding": list(rng.normal(size=(10_000, 8)))})
    assert peak(lambda: list(vectors.run(iter([frame])))) < 250


def test_cosines_across_blocks_keep_ties_by_key(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    rng = np.random.default_rng(5)
    points = rng.integers(-2, 3, size=(60, 3)).astype(float).tolist()
    vectors = spark.createDataFrame([(int(k), p) for k, p in zip(rng.permutation(60), points)], "k long, embedding array<double>").coalesce(2)
    asked = vectors.where("k % 3 = 0").select(F.col("k").alias("q"), "embedding")
    want = lexical.ranked(dense.cosine_scores(vectors, "k", asked, "q", digits=6), "q", "k", 4)
    held = Held(k="bigint")
    monkeypatch.setattr(lexical, "ranked", lambda rows, *_: rows)
    dense.top_cosines(held, "k", asked.toPandas(), "q", 4, digits=6)
    frames = [vectors.toPandas().iloc[a : a + 25] for a in range(0, 60, 25)]
    got = pd.concat(held.run(iter(frames)))
    assert sorted(map(tuple, got[["q", "k", "score"]].to_numpy().tolist())) == sorted((r["q"], r["k"], r["score"]) for r in want.collect())


def test_chunks_need_no_rounds(spark):
    """3,000 chunks of one document: a job for each was needed."""
    df = spark.range(3000).select(F.lit(1).alias("d"), F.col("id").cast("int").alias("ord"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 9).cast("int").alias("end"))
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    got = analyze.chunk_spans(df, "d", 10, 0)
    assert "UnionLoop" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.orderBy("ordinal").collect()] == [(1, i, i * 10, i * 10 + 9) for i in range(3000)]
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == before


@pytest.mark.parametrize("with_tokens", [True, False])
def test_analysis_of_a_batch_leaves_in_pieces(with_tokens):
    """A batch of Arrow is not held with all its tokens."""
    docs = Held(doc_id="bigint", text="string")
    analyze.analyze(docs, with_tokens=with_tokens)
    frame = pd.DataFrame({"doc_id": range(40), "text": ["word after word. " * 2000] * 39 + [None]})
    sizes = [out for out in docs.run(iter([frame, frame]))]
    assert [d for out in sizes for d in out["doc_id"]] == [*range(40)] * 2
    assert all(len(out) <= 8 for out in sizes)


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_block_search_finds_what_the_joins_find(spark, monkeypatch, broadcast):
    """Copies, ties, blocks, batches of queries and both ways to count, against one row for each shared term."""
    from attesta.sources import staging

    monkeypatch.setattr(staging, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(lexical, "POSTINGS", 150)
    monkeypatch.setattr(lexical, "ASKED", 60)
    monkeypatch.setattr(lexical, "MATRIX_BYTES", 800)
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in range(40)]
    text = lambda n: [words[min(39, int(x))] for x in rng.exponential(6, n)]
    docs = [(i, text(rng.integers(0, 12))) for i in range(120)]
    docs += [(200 + i, docs[i % 3 + 5][1]) for i in range(60)]
    asked = [(i, text(rng.integers(0, 9)) + ["unknown"]) for i in range(40)]
    docs, asked = spark.createDataFrame(docs, "d long, terms array<string>"), spark.createDataFrame(asked, "q long, terms array<string>")
    want = lexical.ranked(lexical.bm25(docs, "d", asked, "q", digits=6), "q", "d", 5)
    got = lexical.best(docs, "d", asked, "q", 5, digits=6)
    key = lambda df: sorted((r["q"], r["rank"], r["d"], r["score"]) for r in df.collect())
    assert key(got) == key(want)


def test_rungs_make_no_row_for_a_term(spark):
    """The plan of weights explodes the candidates once, for the counts; the joins are by answer."""
    from attesta.operators import attribution

    clauses = spark.createDataFrame([(1, 0, ["a", "b"])], "answer long, clause int, terms array<string>")
    cands = spark.createDataFrame([(1, 5, ["a", "c"]), (1, 6, ["d"])], "answer long, cand long, terms array<string>")
    got = attribution.candidate_weights(clauses, cands)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert [(r["cand"], round(r["weight"], 6)) for r in got.collect()] == [(5, round(float(np.log(2)), 6))]


def test_search_tables_go_before_texts_are_sent(spark, sf_dir):
    """What the search staged is gone when passages are joined to answers, but for what it found."""
    from attesta.plans import catalogue
    from attesta.sources import staging

    mark = staging.made()
    rows = catalogue._retrieved(spark, sf_dir)
    assert staging.made() - mark == 1
    assert rows.where("size(results) > 0").count() > 0
