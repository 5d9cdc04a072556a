"""Every query of the package against its SQL on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from attesta.plans import catalogue

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*names).collect()), key=str)
    if name not in catalogue.SQL:
        assert got
        return
    rel = duck.execute(catalogue.SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = sorted(([plain(r[cols.index(c)]) for c in names] for r in rel.fetchall()), key=str)
    assert got == want


def test_invariants_over_all_documents(spark, sf_dir):
    """Positions select their text; chunks are no longer than allowed unless of one sentence, in order, and
    none lies within the one before."""
    from attesta.operators import analyze

    docs = catalogue.table(spark, sf_dir, "documents")
    out = analyze.analyze(docs).join(docs.select("doc_id", "text"), "doc_id")
    for r in out.collect():
        text = r["text"]
        assert len(r["masked"]) == len(text)
        assert all(a["end"] <= b["start"] for a, b in zip(r["regions"], r["regions"][1:]))
        ends = {s["end"] for s in r["sentences"]}
        for c in r["chunks"]:
            one = sum(c["start"] <= s["start"] and s["end"] <= c["end"] for s in r["sentences"]) <= 1
            assert c["end"] - c["start"] <= 1200 or one
            assert c["end"] in ends or c["end"] == 0
            for t in c["tokens"]:
                assert 0 <= t["start"] < t["end"] <= c["end"] - c["start"] and t["term"]
        spans = [(c["start"], c["end"]) for c in r["chunks"]]
        assert all(a < c and b < d for (a, b), (c, d) in zip(spans, spans[1:]))


def test_chunk_index_is_dense_and_in_order(spark, sf_dir):
    rows = catalogue.chunks_full(spark, sf_dir).select("chunk_index", "doc_id", "ordinal").collect()
    assert [r[0] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(len(rows)))


def test_entry_without_the_optional_parts(tmp_path):
    """The rest imports and answers when the subpackage and the pipeline are not there."""
    for name in ("__spark_entry__.py", "attesta"):
        src = os.path.join(HERE, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)


def test_cosine_topk_ranks_by_rounded_scores(spark, tmp_path):
    """More vectors than are kept round to one score; the smallest numbers win."""
    rows = [(i, [1.0, 0.0] if i == 0 else [1.0 - (200 - i) * 1e-9, 0.0]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.cosine_topk(spark, str(tmp_path)).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10))


def test_retrieved_is_what_the_search_finds(spark, tmp_path):
    """The source of an answer is among its results, whatever both are numbered; answers without any stay."""
    docs = [(i, f"document{i} speaks of subject{i} and of nothing else") for i in range(40)]
    turns = [(1, 1, "assistant", "subject30 is what document30 speaks of"), (2, 1, "assistant", "zzz"), (3, 0, "user", "subject3")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["answer"]: [x["document_id"] for x in r["results"]] for r in catalogue._retrieved(spark, str(tmp_path)).collect()}
    assert got[1001][0] == "30" and len(got[1001]) == 10 and got[2001] == [] and len(got) == 2
    assert {r["answer"] for r in catalogue.attribution_spans(spark, str(tmp_path)).collect()} == {1001, 2001}
