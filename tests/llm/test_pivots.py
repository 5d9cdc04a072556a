import math

import duckdb
import numpy as np
import pytest

from attesta.llm import pivots as P


def brute(rows, cosine=0.93):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows if i is not None}
    root = {i: i for i in links}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            (i, x, l), (j, y, m) = ok[a], ok[b]
            if l == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i in links}


def got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def cloud(rng, n, near, spread, d=64):
    base = rng.normal(size=(n, d))
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(base)]
    for k in range(near):
        i = int(rng.integers(0, n))
        v = base[i] / np.linalg.norm(base[i]) + rng.normal(size=d) * spread / math.sqrt(d)
        rows.append((n + k, v.astype(np.float32).tolist(), int(i % 3)))
    return rows


@pytest.mark.parametrize("spread", [0.05, 0.2, 0.35])
def test_recall(spark, spread):
    rows = cloud(np.random.default_rng(4), 1500, 400, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want, found = brute(rows), got(P.near_duplicates(df))
    assert set(want) == set(found)
    assert all(found[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(f[0] for f in found.values()) >= 0.9 * sum(w[0] for w in want.values())


def test_recall_with_more_pivots():
    """Of pairs at the threshold itself, the share that meets in a list, whatever the number of pivots."""
    rng = np.random.default_rng(8)
    base, z = rng.normal(size=(2, 2500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    z -= (z * base).sum(1, keepdims=True) * base
    near = 0.93 * base + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n in (1_000, 50_000, 1_000_000, 10**9):
        pivots, prefix = P.pivots_for(n)
        chosen = P.spread(base, pivots)
        a, b = (np.argsort(-(x @ chosen.T), 1)[:, :prefix] for x in (base, near))
        assert ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= P.LEAST).mean() > 0.95, n
    assert [P.pivots_for(n)[0] for n in (1_000, 50_000, 1_000_000, 10**9)] == [64, 256, 1024, P.MOST_PIVOTS]


@pytest.mark.parametrize("pivots", [128, 512])
def test_links_with_more_pivots(spark, pivots):
    rows = cloud(np.random.default_rng(5), 900, 300, 0.2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want, found = brute(rows), got(P.near_duplicates(df, pivots=pivots, prefix=6))
    assert all(found[i][0] <= want[i][0] for i in want) and sum(f[0] for f in found.values()) >= 0.95 * sum(w[0] for w in want.values())


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = {r[0]: r[1:] for r in con.execute(P.OP10_SQL).fetchall()}
    assert got(P.op10_pivot_near_dedup(spark, sf_dir)) == want


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.1).astype(np.float32).tolist(), 1) for i in range(150)] + cloud(rng, 100, 0, 0)[:100]
    rows = [(k, v, l) for k, (_, v, l) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(P.near_duplicates(df)) == brute(rows)


def test_odd_rows(spark):
    v, w, nan = [1.0] * 8, [1.0, -1.0] * 4, [float("nan")] + [1.0] * 7
    rows = [(5, v, 1), (3, v, 1), (4, v, 2), (6, None, 1), (7, [], 1), (8, [0.0] * 8, 1), (9, nan, 1), (10, [None] + [1.0] * 7, 1), (11, v, None), (12, w, 1), (13, [float("inf")] * 8, 1), (14, [2.0] * 8, 1), (15, [1.0] * 4, 1), (16, [1.0] * 4, 1)]
    df = spark.createDataFrame([r + (0, 0) for r in rows], "vec_id long, embedding array<float>, label int, n int, class int")
    assert got(P.near_duplicates(df)) == brute(rows)
    twice = P.near_duplicates(df.where("vec_id = 12").union(df.where("vec_id = 12")))
    assert [(r["n_links"], r["component_id"]) for r in twice.collect()] == [(1, 12), (1, 12)]
    assert P.near_duplicates(df.limit(0)).count() == 0


def test_many_lengths(spark):
    rows = [(2 * d + k, [1.0] * (d - 1) + [1.0 + k / 100], 0) for d in range(1, 1201) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(P.near_duplicates(df)) == {i: (1, i // 2 * 2, i % 2 == 0) for i, _, _ in rows}
