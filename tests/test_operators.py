import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import columns as C
from attesta.functions import segments as S
from attesta.operators import analytics, analyze, attribution, dense, lexical, ruler, workbench
from attesta.sources import corpus, providers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# ---------------------------------------------------------------- expressions


def test_fold_and_stem_agree_with_their_definitions(spark):
    words = ["AÇÕES", "Lençóis", "naïve", "ÉA", "Ǆ", "straße", "Åre", "flores", "pais", "depois", "ﬁ", "ñandú", "İ"[:0] or "x", "βΑς", "maçãs"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", C.fold("w").alias("f"), C.stem_plural(C.fold("w")).alias("s")).collect()
    for r in got:
        assert (r["f"], r["s"]) == (S.fold(r["w"]), S.stem_plural(S.fold(r["w"])))


@pytest.mark.parametrize("start,end,want", [(0, 2, "a💡"), (1, 99, "💡ç"), (-1, None, "ç"), (2, 1, ""), (-9, 1, "a"), (0, -1, "a💡")])
def test_slices(spark, start, end, want):
    e = None if end is None else F.lit(end)
    assert spark.range(1).select(C.slice_code_points(F.lit("a💡ç"), F.lit(start), e)).first()[0] == want


def test_weights(spark):
    import math

    r = spark.range(1).select(C.lucene_idf(F.lit(10), F.lit(3)), C.classic_idf(F.lit(10), F.lit(6)), C.bm25_term(F.lit(2), F.lit(5), F.lit(3), F.lit(10), C.d(4)), C.bm25_term(F.lit(0), F.lit(5), F.lit(3), F.lit(10), C.d(4)), C.bm25_term(F.lit(1), F.lit(5), F.lit(3), F.lit(10), C.d(0)), C.separation_weight(F.lit(0), F.lit(5)), C.sustain_weight(F.lit(0), F.lit(5))).first()
    idf = math.log(1 + 7.5 / 3.5)
    assert r[0] == pytest.approx(idf) and r[1] < 0 and r[2] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 1.25)))
    assert r[3] == 0 and r[4] == pytest.approx(idf * 2.2 / (1 + 1.2)) and r[5] == 0 and r[6] == pytest.approx(math.log(1 + 4.5 / 1.5))


def test_bad_vectors(spark):
    for v in ([0.0, 0.0], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="length 1"):
            spark.createDataFrame([(v,)], "v array<double>").select(C.normalize("v")).collect()
    with pytest.raises(Exception, match="different sizes"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(C.dot("a", "b")).collect()


# ---------------------------------------------------------------- search


def test_page_cap_is_the_greedy_walk(spark):
    scores = spark.createDataFrame([(1, i, 10.0 - i, p) for i, p in enumerate([1, 1, None, 1, 2, None, 2, 3])] + [(1, 99, 0.0, None)], "q long, c long, score double, page_number int")
    assert rows(lexical.capped(scores, "q", "c", 5, 1).select("rank", "c")) == [(1, 0), (2, 2), (3, 4), (4, 5), (5, 7)]
    assert rows(lexical.capped(scores, "q", "c", 3).select("rank", "c")) == [(1, 0), (2, 1), (3, 2)]


def test_repeated_query_terms_count(spark):
    docs = lexical.with_terms(spark.createDataFrame([(1, "alfa beta"), (2, "gama delta"), (3, "alfa")], "d long, text string"))
    one, two = (lexical.with_terms(spark.createDataFrame([(1, t)], "q long, text string")) for t in ("alfa", "alfa alfa"))
    a, b = ({r["d"]: r["score"] for r in lexical.bm25(docs, "d", q, "q").collect()} for q in (one, two))
    assert set(a) == {1, 3} and all(b[k] == pytest.approx(2 * a[k]) for k in a)
    with pytest.raises(ValueError):
        lexical.refuse_empty(lexical.with_terms(spark.createDataFrame([(1, "...")], "d long, text string")))


def test_rank_fusion(spark):
    one, two = (spark.createDataFrame(r, "q long, c long, rank int") for r in ([(1, 5, 1), (1, 6, 2)], [(1, 6, 1), (1, 7, 2)]))
    got = {r["c"]: r["score"] for r in dense.fused([one, two], "q", "c").collect()}
    assert got == {5: pytest.approx(1 / 61), 6: pytest.approx(1 / 61 + 1 / 62), 7: pytest.approx(1 / 62)}


def test_top_cosines_agree_with_expressions(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vectors.where("vec_id < 5").select(F.col("vec_id").alias("q"), "embedding")
    one = lexical.ranked(dense.cosine_scores(vectors, "vec_id", asked, "q"), "q", "vec_id", 7)
    two = dense.top_cosines(vectors.repartition(5), "vec_id", asked.toPandas(), "q", 7)
    assert rows(one, "q", "rank", "vec_id") == rows(two, "q", "rank", "vec_id")


def test_vetoed_choice(spark):
    def choose(*cands):
        df = spark.createDataFrame([(1, i, s, v) for i, (s, v) in enumerate(cands)], "clause long, cand long, score double, veto boolean")
        return [r["cand"] for r in dense.dense_choice_vetoed(df, "clause", "cand", "veto").collect()]

    assert choose((0.9, True), (0.5, False), (0.1, False)) == [1]
    assert choose((0.9, True), (0.5, False), (0.45, False)) == []
    assert choose((0.9, False), (0.8, False)) == [] and choose((0.9, True)) == [] and choose((-1.0, False)) == []


def test_sql_rungs_agree_with_answers_one_by_one(spark):
    from attesta.functions import attributing as A

    texts = ["A multa sera de 500 reais por dia.", "O contrato nao pode ser cedido.", "A entrega ocorre em Recife em maio."]
    answer = "A multa sera de 500 reais. O contrato nao pode ser cedido hoje. Nada disso vale."
    found = A.Evidence([A.Passage(str(i), "d", t) for i, t in enumerate(texts)])
    clauses = spark.createDataFrame([(1, i, sorted(c.terms)) for i, c in enumerate(A.clauses_of(answer))], "answer long, clause int, terms array<string>")
    cands = spark.createDataFrame([(1, i, sorted(t)) for i, t in enumerate(found.terms)], "answer long, cand int, terms array<string>")
    got = {r["clause"]: r for r in attribution.lexical_rung(clauses, cands).collect()}
    for i, c in enumerate(A.clauses_of(answer)):
        verdict, best, share = found.rung(c)
        assert got[i]["verdict"] == verdict
        if verdict == "clear":
            assert got[i]["cand"] == best and got[i]["confidence"] == pytest.approx(share)


# ---------------------------------------------------------------- segmentation as relations


def test_recursion_packs_as_the_fold_does(spark):
    import random

    rng, all_rows, want = random.Random(8), [], []
    for d in range(20):
        spans, at = [], 0
        for i in range(rng.randrange(1, 12)):
            at += rng.randrange(0, 3)
            spans.append((at, at := at + rng.randrange(1, 40)))
            all_rows.append((d, i, *spans[-1]))
        want += [(d, k, *c) for k, c in enumerate(S.pack(spans, 60, 25))]
    df = spark.createDataFrame(all_rows, "doc_id long, ord int, start int, end int")
    assert rows(analyze.chunk_spans(df, "doc_id", 60, 25)) == sorted(want)


def test_pages_and_both_arms(spark):
    docs = spark.createDataFrame([("a", "t", ("x", "image/png")), ("b", " ", ("x", "image/png")), ("c", "t", None)], "doc_id string, text string, page struct<data:string,mime_type:string>")
    assert rows(analyze.refuse_both_arms(docs).select("doc_id")) == [("a",)]
    out = analyze.analyze(docs.select("doc_id", F.when(F.col("doc_id") == "c", F.col("text")).alias("text"))).collect()
    assert {r["doc_id"]: [(c["start"], c["end"]) for c in r["chunks"]] for r in out} == {"a": [(0, 0)], "b": [(0, 0)], "c": [(0, 1)]}


def test_regions_are_clipped_to_chunks(spark):
    chunks = spark.createDataFrame([("c", "d", 10, 20)], "chunk_id string, doc_id string, start int, end int")
    regions = spark.createDataFrame([("d", "code", 5, 12), ("d", "url", 20, 25), ("d", "code", 15, 40), ("e", "code", 10, 20)], "doc_id string, kind string, start int, end int")
    assert rows(analyze.clip_regions(chunks, regions)) == [("c", "code", 0, 2), ("c", "code", 5, 10)]


# ---------------------------------------------------------------- ruler and sources


def test_to_code_points(spark):
    text = "aé💡b"
    got = spark.range(0, 9).select(F.col("id").cast("int").alias("o")).select("o", ruler.to_code_points(F.lit(text), F.col("o"), "start").alias("s"), ruler.to_code_points(F.lit(text), F.col("o"), "end").alias("e")).collect()
    for r in got:
        assert (r["s"], r["e"]) == (S.byte_to_code_point(text, r["o"], "start")[0], S.byte_to_code_point(text, r["o"], "end")[0])


def test_overlapping_occurrences(spark):
    snippets = spark.createDataFrame([(1, "aa"), (2, "zz"), (3, ""), (4, "x💡")], "snippet_id long, snippet string")
    docs = spark.createDataFrame([("a", "aaa"), ("b", "x💡")], "doc_id string, text string")
    places = ruler.located(snippets, docs)
    assert rows(places) == [(1, "a", 0, 2), (1, "a", 1, 3), (4, "b", 0, 2)]
    assert rows(ruler.ambiguity(snippets, places).select("snippet_id", "kind")) == [(1, "ambiguous"), (2, "not_found"), (3, "not_found"), (4, "exact")]


def test_states_and_counters(spark):
    states = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 0, None), (1, 1, 2, 2, 0, 0, None), (1, 2, 2, 1, 1, 1, 0.6), (1, 3, 2, 2, 2, 1, 0.2), (1, 4, 1, 1, 0, 2, None)],
        "fixture long, marker long, raw_chunks long, sources long, located long, segment long, overlap double",
    )
    segments = spark.createDataFrame([(1, s) for s in range(4)], "fixture long, segment long")
    r = ruler.scored(ruler.marker_states(states), segments).first()
    assert (r["citations_correct"], r["citations_scored"], r["partial_supports"], r["choice_supports"], r["sourceless"]) == (1, 2, 1, 1, 1)
    assert (r["segments_covered"], r["segments_indeterminate"], r["segments_sustained"]) == (1, 2, 2)


def test_recordings(spark, tmp_path):
    recording = {"id": "q", "parts": [{"text": "olá tudo bem"}], "groundingMetadata": {"groundingChunks": [{"retrievedContext": {"text": "t"}}], "groundingSupports": [{"segment": {"endIndex": 4, "text": "olá"}, "groundingChunkIndices": [0]}, {"segment": {"startIndex": 5, "endIndex": 9, "text": "tuda"}}, {"segment": {"partIndex": 3, "endIndex": 1, "text": "x"}}, {"segment": {"text": "olá"}}, {"segment": {"endIndex": 5, "text": "olá"}}]}}
    (tmp_path / "a.json").write_text(json.dumps(recording))
    got = ruler.parse_checks(corpus.supports(corpus.recordings(spark, f"file://{tmp_path}"))).orderBy("support").collect()
    assert [r["violation"] for r in got] == [None, "position", "missing_part", "missing_end", "position"]
    assert got[0]["indices"] == [0] and got[1]["indices"] == [] and got[4]["length_delta"] == 1


def test_text_directory(spark, tmp_path):
    (tmp_path / "b.txt").write_text("dois\nlinhas")
    (tmp_path / "a.txt").write_text("um")
    (tmp_path / "c.md").write_text("no")
    assert rows(corpus.text_directory(spark, f"file://{tmp_path}")) == [("a", "um"), ("b", "dois\nlinhas")]


def make_index(spark, path, provider=None):
    chunks = spark.createDataFrame([(0, "d#0", "alfa beta"), (1, "d#1", "gama")], "chunk_index long, chunk_id string, text string")
    posted = lexical.postings(lexical.with_terms(chunks), "chunk_index")
    vectors = providers.embed_table(chunks, provider, "chunk_index") if provider else None
    corpus.save_index(path, chunks, posted, 1.5, "standard+rslp-s-folded", vectors, provider.id if provider else None, provider.dimensions if provider else None)


def test_index_round_trip(spark, tmp_path):
    p = providers.Deterministic(4)
    make_index(spark, f"file://{tmp_path}/i", p)
    index = corpus.load_index(spark, f"file://{tmp_path}/i", "standard+rslp-s-folded", p)
    assert index["dense"] == "ready" and rows(index["lengths"]) == [(0, 2), (1, 1)]
    assert corpus.load_index(spark, f"file://{tmp_path}/i", "standard+rslp-s-folded")["dense"] == "needs-provider"
    again = corpus.import_json(spark, corpus.export_json(index))
    assert rows(again["postings"].select("term", "chunk_index", "tf")) == rows(index["postings"].select("term", "chunk_index", "tf"))
    assert rows(again["vectors"]) == rows(index["vectors"].select("chunk_index", "embedding"))
    with pytest.raises(ValueError, match="made with"):
        corpus.load_index(spark, f"file://{tmp_path}/i", "standard+no-stemmer")
    with pytest.raises(ValueError, match="asked with"):
        corpus.load_index(spark, f"file://{tmp_path}/i", "standard+rslp-s-folded", providers.Deterministic(5))
    make_index(spark, f"file://{tmp_path}/j")
    assert corpus.load_index(spark, f"file://{tmp_path}/j", "standard+rslp-s-folded")["dense"] == "absent"


def test_bad_postings_are_refused(spark):
    chunks = spark.createDataFrame([(0,)], "chunk_index long")
    for bad in ([("a", 1, 1)], [("a", 0, 0)]):
        with pytest.raises(ValueError):
            corpus.refuse_postings(spark.createDataFrame(bad, "term string, chunk_index long, tf long"), chunks)


# ---------------------------------------------------------------- analytics and workbench


def test_quotes_by_their_longest_pieces():
    passages = [("a", "the quick brown fox jumps over the lazy dog and runs"), ("b", "the quick brown fox jumps over it all again today")]
    got = analytics.quote_pieces("the quick brown fox jumps over the lazy dog [...] brown fox jumps over it all again today", passages)
    assert got == [("the quick brown fox jumps over the lazy dog", ["a"]), ("brown fox jumps over it all again today", ["b"])]
    spread = analytics.quote_pieces("The Quick\n brown  fox jumps over the LAZY (...) fox jumps over it all AGAIN x", passages)
    assert spread == [("the quick brown fox jumps over the lazy", ["a"]), ("fox jumps over it all again ", ["b"])]
    assert analytics.quote_pieces("short", passages) == []


def test_gaps_and_pieces(spark):
    texts = spark.createDataFrame([(1, 10), (2, 5)], "k long, length int")
    marks = spark.createDataFrame([(1, "a", 2, 6), (1, "b", 4, 8), (1, "a", 0, 1)], "k long, kind string, start int, end int")
    assert rows(workbench.uncovered(texts, marks, "k")) == [(1, 1, 2), (1, 8, 10), (2, 0, 5)]
    assert rows(workbench.pieces(texts, marks, "k")) == [(1, 0, 1, "a"), (1, 1, 2, ""), (1, 2, 4, "a"), (1, 4, 6, "a,b"), (1, 6, 8, "b"), (1, 8, 10, ""), (2, 0, 5, "")]


@pytest.mark.parametrize("text,stripped", [("# Title\n- *a* **b**\n> c", "Title\na b\nc"), ("2 * 3 * 4", "2 * 3 * 4"), ("plain", "plain"), ("**x** `*y*`", "x `*y*`"), ("", "")])
def test_markdown(text, stripped):
    regions = [(r.start, r.end) for r in S.mask_regions(text)[1]]
    got, removed = workbench.strip_markdown(text, regions)
    assert got == stripped and workbench.restore_markdown(got, removed) == text


def test_matched_sentences(spark):
    """Most shared weight wins, then the earlier sentence; no shared term, no row; repeats of a term count once."""
    won = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, 8)], "answer int, clause int, cand int")
    clauses = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"]), (1, 2, ["z"])], "answer int, clause int, terms array<string>")
    candidates = spark.createDataFrame([(1, 7, ["a", "b", "c", "d"]), (1, 8, ["y"])], "answer int, cand int, terms array<string>")
    sentences = spark.createDataFrame([(7, 0, ["a", "a", "a"]), (7, 1, ["a", "b"]), (7, 2, ["b", "c", "a"]), (7, 3, ["c"]), (8, 0, ["y"]), (9, 0, ["a", "b"]), (8, 1, None)], "cand int, sentence int, terms array<string>")
    got = attribution.matched_sentences(won, clauses, candidates, sentences).collect()
    assert sorted((r["clause"], r["cand"], r["sentence"]) for r in got) == [(0, 7, 1), (1, 7, 2)]
    assert attribution.matched_sentences(won.limit(0), clauses, candidates, sentences).count() == 0


def test_class_columns(spark):
    """Means by bucket; an empty bucket is 0, no ratio without gold mass, a null bucket belongs to none."""
    row = lambda v, bucket, code: (v, bucket, code, 0.0, 0.0, 0.0, 0.0, 1.0 - code)
    rows = [row("v", "gold", 0.5), row("v", "gold", 0.0), row("v", "scored", 1.0), row("v", None, 1.0), row("w", "scored", 0.5)]
    masses = spark.createDataFrame(rows, "variant string, bucket string, code double, url double, formula double, enumerator double, abbreviation double, plain double")
    got = {(r["variant"], r["class"]): tuple(r)[2:] for r in ruler.class_columns(masses, ["variant"]).collect()}
    assert len(got) == 12 and got["v", "code"] == (0.25, 1.0, 0.0, 0.0, 4.0, 1) and got["v", "plain"] == (0.75, 0.0, 0.0, 0.0, 0.0, 2)
    assert got["w", "code"] == (0.0, 0.5, 0.0, 0.0, None, 0) and ruler.class_columns(masses.limit(0), ["variant"]).count() == 0


def test_negative_terms_and_summary(spark):
    """Most texts first, then by code point; half of the texts is not enough; an empty corpus has a row of zeros."""
    rows = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["b", "a"]), (3, ["b", "É"]), (4, ["É"]), (5, [])], "doc_id int, terms array<string>")
    posted, stats = lexical.postings(rows, "doc_id"), lexical.corpus_stats(rows)
    got = [(r["place"], r["term"], r["df"]) for r in lexical.negative_terms(posted, stats).orderBy("place").collect()]
    assert got == [(1, "b", 3)]
    assert tuple(lexical.regime_summary(posted, stats).first()) == (5, 3, 8, 1, 3 / 8)
    all_in = rows.where("doc_id < 3")
    got = lexical.negative_terms(lexical.postings(all_in, "doc_id"), lexical.corpus_stats(all_in)).orderBy("place").collect()
    assert [r["term"] for r in got] == ["a", "b"]
    none = rows.limit(0)
    assert tuple(lexical.regime_summary(lexical.postings(none, "doc_id"), lexical.corpus_stats(none)).first()) == (0, 0, 0, 0, 0.0)
