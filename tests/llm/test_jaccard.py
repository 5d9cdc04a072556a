import itertools
import random
import re

import numpy as np
import pytest

from attesta.llm import jaccard as J
from attesta.llm import shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute(rows, k, num, den):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if den * len(x & y) >= num * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 8, 10)])
def test_whole_table(spark, sf_dir, k, num, den):
    docs = shared.documents(spark, sf_dir)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert got(J.jaccard_components(docs, k, num, den)) == brute(rows, k, num, den)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = J.jaccard_components(odd_docs, 3, 9, 10)
    assert got(out) == brute(rows, 3, 9, 10)
    assert out.count() == len(rows)
    assert sorted(str(r["component_id"]) for r in out.where("doc_id is null").collect()) == ["1", "None"]
    assert J.jaccard_components(no_docs).count() == 0


def test_random_near_copies(spark):
    """Chains of copies, each a few words from the last, among texts that share one passage."""
    rng = random.Random(3)
    passage, texts = [f"p{i}" for i in range(30)], []
    for group in range(12):
        text = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
    texts += [" ".join(passage + [f"u{i}x{j}" for j in range(8)]) for i in range(300)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (8, 9):
        assert got(J.jaccard_components(docs, 3, num, 10)) == brute(rows, 3, num, 10)
    # prefixes of seven bits a shingle, in which many become equal: no link is lost
    assert got(J.jaccard_components(docs, 3, 9, 10, cut=57)) == brute(rows, 3, 9, 10)


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[: i % 70] + [f"x{i}"] + base[i % 70 + 1 :])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.jaccard_components(docs, 3, 8, 10)) == brute(rows, 3, 8, 10)


def test_divide_skip_against_counting():
    rng = random.Random(5)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 15))]
        t = rng.randrange(1, len(lists) + 1)
        counts = np.bincount([x for y in lists for x in y], minlength=40)
        assert dict(J.divide_skip(lists, t, lambda m: False)) == {i: c for i, c in enumerate(counts) if c >= t}


def test_one_of_each_group(spark, odd_docs):
    kept = sorted(r["doc_id"] for r in J.one_of_each_group(spark, odd_docs).collect())
    assert kept == [1, 4, 5, 6, 7, 9, 10, 12]  # 3 differs from 1 in five of 56 shingles, 8 from 7 in case


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(200, x) for x in range(201, 260)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    out = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len({r["node"] for r in out})
    assert {r["node"]: r["component"] for r in out} == {i: find(i) for i in root}


def test_only_the_rest_of_a_long_list_asks(spark, monkeypatch):
    """Copies of one text in many blocks, and some that link to a few of them only."""
    monkeypatch.setattr(J, "BLOCK", 6)
    monkeypatch.setattr(J, "FAN", 2)
    monkeypatch.setattr(J, "PAIRS", 1)
    rng, base, texts = random.Random(12), [f"w{i}" for i in range(100)], []
    for i in range(120):
        text = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 4, 6))):
            text[rng.randrange(100)] = f"x{rng.randrange(12)}"
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (7, 8, 9):
        assert got(J.jaccard_components(docs, 3, num, 10)) == brute(rows, 3, num, 10)


def test_what_asks_elsewhere_is_not_in_the_main_component():
    """A member that asks links to one of the main component and to another outside it: both links count."""
    a = np.arange(100, dtype=np.uint64)
    b, c = a.copy(), a.copy()
    b[:8], c[-8:] = np.arange(200, 208), np.arange(300, 308)
    for roles, want in (([J.MAIN, J.ASKS, J.OTHER], {(0, 1), (1, 2)}), ([J.OTHER, J.ASKS, J.MAIN], {(0, 1), (1, 2)}), ([J.MAIN, J.ASKS, J.MAIN], {(0, 1)})):
        got = {tuple(sorted(p)) for p in J.unit_links([0, 1, 2], [100] * 3, [np.sort(b), a, np.sort(c)], 8, 10, False, roles)}
        assert got == want or (roles.count(J.MAIN) == 2 and len(got) == 1)
