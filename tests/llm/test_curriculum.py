import duckdb
import pytest

from attesta.llm import curriculum as C


def water(sizes, weights, most):
    """Targets by filling: full sources leave, the rest share what is over."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        full = {i for i in open_ if most * sizes[i] < level * weights[i]}
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            return target
        for i in full:
            target[i] = float(most * sizes[i])
        open_ -= full
    return target


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(C.OP3_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = C.op3_curriculum_mix(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_targets_and_takes(spark, odd_docs, no_docs):
    rows = C.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        assert [c["position"] for c in r["copies"]] == sorted(c["position"] for c in r["copies"])
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    for s, size, target in zip(names, sizes, water(sizes, weights, 3)):
        assert all(r["source_size"] == size for r in by[s])
        assert all(r["target"] == pytest.approx(target) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 0.5
    assert C.mix(no_docs).count() == 0


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "a", "x y z") for i in range(3000)], "doc_id long, source string, text string")
    rising = ((0.0, 0.5), (1.0, 1.5))
    got = [c["position"] for r in C.mix(docs, schedules=(rising,)).collect() for c in r["copies"]]
    for t in (0.25, 0.5, 0.75):  # the integral of 0.5 + t
        assert sum(p <= t for p in got) / len(got) == pytest.approx(0.5 * t + t * t / 2, abs=0.005)
    order = [r["position"] for r in C.training_order(C.mix(docs, schedules=(rising,))).collect()]
    assert order == sorted(order)


def test_bent_schedule(spark):
    from pyspark.sql import functions as F

    bent = ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25))
    total = 0.25 + 0.75
    got = spark.range(1, 100).select((F.col("id") / 100.0).alias("u")).select("u", C.time_of(F.col("u"), bent).alias("t")).collect()
    for u, t in got:
        area = 0.25 * t + t * t / 2 if t <= 0.5 else 0.25 + 0.75 * (t - 0.5) + 1.5 * (t - 0.5) ** 2
        assert area / total == pytest.approx(u, abs=1e-9)


def test_reruns_agree(spark, odd_docs):
    one, two = (sorted(map(str, C.mix(odd_docs.repartition(n)).collect())) for n in (1, 7))
    assert one == two


def test_clashing_columns(spark, odd_docs):
    out = C.mixed_documents(spark, odd_docs)
    assert len(out.columns) == len(set(out.columns)) and out.count() > 0


def test_repeated_and_null_rows_are_taken_each(spark, odd_docs, no_docs):
    """One row for each row that the mix takes, whatever its doc_id."""
    plan = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in C.mix(odd_docs).where("taken > 0").collect())
    got = C.mixed_documents(spark, odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == plan
    assert all(len((r["text"] or "").split()) == r["size"] for r in got) and sum(r["doc_id"] == 2 for r in got) > 1
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "f g h i", "s")], "doc_id long, text string, source string")
    assert sorted((str(r["doc_id"]), r["text"], r["taken"]) for r in C.mixed_documents(spark, docs).collect()) == [("1", "a b c", 3)] * 3 + [("None", "d e", 2), ("None", "f g h i", 4)]
    assert C.mixed_documents(spark, no_docs).count() == 0
