import numpy as np
import pytest

from attesta.llm import shared
from attesta.llm import tokens as T

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return T.read_ranks()


def brute(lengths):
    x, out = np.array(sorted(lengths)), {}
    for n in sorted(set(lengths)):
        at_least = x >= n
        out[n] = ((x == n).sum(), at_least.sum(), x[at_least].sum(), np.minimum(x, n).sum(), (~at_least).sum() / len(x))
    return out


def check(histogram, lengths):
    got = {r["n_tokens"]: (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["total_cut"], r["docs_below_share"]) for r in histogram.collect()}
    want = brute(lengths)
    assert set(got) == set(want)
    for n, v in want.items():
        assert got[n] == pytest.approx(v)
        assert T.truncated_total(histogram, n) == v[3]
    for q in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0):
        x = sorted(lengths)
        want_q = next(n for i, n in enumerate(x) if n == x[-1] or (np.array(x) <= n).sum() / len(x) >= q)
        assert T.length_quantile(histogram, q) == want_q


def test_whole_table(spark, sf_dir, ranks):
    bpe = T.encoder(ranks)
    texts = [r[0] for r in shared.documents(spark, sf_dir).select("text").collect()]
    check(T.op1_token_length_histogram(spark, sf_dir).cache(), [len(bpe.encode_ordinary(t)) for t in texts])


def test_odd_rows(spark, odd_docs, no_docs, ranks):
    bpe = T.encoder(ranks)
    lengths = [len(bpe.encode_ordinary(r["text"])) for r in odd_docs.collect() if r["text"] is not None]
    check(T.length_histogram(T.encoded_lengths(odd_docs, ranks)).cache(), lengths)
    assert T.length_histogram(T.encoded_lengths(no_docs, ranks)).count() == 0


def test_blocks_of_lengths(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    lengths = [int(x) for x in np.random.default_rng(1).integers(0, 40, 500)]
    check(T.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")).cache(), lengths)


def test_special_tokens_are_text(spark, ranks):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    row, = T.encoded_lengths(docs, ranks, ("doc_id",)).collect()
    assert row["n_tokens"] > 3
