import hashlib
import random
import re

import pytest

from attesta.llm import shared
from attesta.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=20):
    seen, out = {}, {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            seen[key] = min(seen.get(key, (i, j)), (i, j))
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if seen[tuple(w[j : j + n])] != (i, j):
                gone[j : j + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def digests(df):
    out = {}
    for r in df.collect():
        kept = " ".join(WORD.findall(r["kept_text"] or ""))
        out[r["doc_id"]] = (r["n_words"], sum(x["end"] - x["start"] for x in r["repeats"]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_whole_table(spark, sf_dir):
    rows = [(r[0], r[1]) for r in shared.documents(spark, sf_dir).select("doc_id", "text").collect()]
    out = S.op4_substring_dedup(spark, sf_dir)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()} == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    """Few words, so that windows repeat within and across documents at every offset."""
    rng = random.Random(seed)
    stock = [" ".join(f"v{rng.randrange(5)}" for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(stock) if rng.random() < 0.6 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(0, 5))]
        rows.append((i * 3, "\n".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(S.cut_repeats(docs)) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    out = S.cut_repeats(odd_docs)
    assert out.count() == odd_docs.count()
    found = digests(out.where("doc_id is not null"))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None]
    want = brute(rows)
    assert found == {i: want[i] for i in found}
    assert all(not r["repeats"] for r in out.where("doc_id is null").collect())
    assert S.cut_repeats(no_docs).count() == 0


def test_text_around_repeats_stays(spark):
    base = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, base, 0), (2, f"head\n\n{base}\n tail.\n", 0)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in S.without_repeats(spark, docs).collect()}
    assert out[1]["text"] == base
    assert out[2]["text"] == "head\n\ntail." and out[2]["n_chars"] == 11
