import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import segments as S
from attesta.operators import index as I
from attesta.operators import round as R
from attesta.sources import providers

TEXTS = {"lei": "Art. 1. O prazo e de 10 dias. A multa sera de 500 reais. " * 3, "contrato": "A entrega ocorre em Recife. O foro e Lisboa. " * 3, "nota": "Nada consta."}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string").withColumn("page_number", F.when(F.col("doc_id") == "lei", 1))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "multa de 500 reais"), (2, "foro Lisboa"), (3, "zzz")], "query_id long, text string")


def hits(df):
    return [(r["query_id"], r["rank"], r["chunk_id"]) for r in df.orderBy("query_id", "rank").collect()]


def brute(texts, query, k=10, most=80, overlap=40):
    """BM25 over chunks in plain Python."""
    import math

    chunks = []
    for doc in sorted(texts):
        spans = S.pack(S.sentences(texts[doc]), most, overlap)
        chunks += [(f"{doc}#{i}", [t.term for t in S.STEMMED.tokenize(texts[doc][a:b])]) for i, (a, b) in enumerate(spans)]
    n, avg = len(chunks), sum(len(t) for _, t in chunks) / len(chunks)
    df = lambda w: sum(w in t for _, t in chunks)
    scores = [(sum(math.log(1 + (n - df(w) + 0.5) / (df(w) + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in (x.term for x in S.STEMMED.tokenize(query)) if w in t), -i) for i, (_, t) in enumerate(chunks)]
    return [chunks[-i][0] for s, i in sorted(scores, reverse=True) if s > 0][:k]


def test_search_by_words(docs, queries):
    index = I.create_index(docs, most=80, overlap=40)
    got = hits(index.search_lexical(queries))
    for q, text in ((1, "multa de 500 reais"), (2, "foro Lisboa"), (3, "zzz")):
        want = brute(TEXTS, text)
        assert [c for k, _, c in got if k == q] == want and [r for k, r, _ in got if k == q] == list(range(1, len(want) + 1))
    capped = hits(index.search_lexical(queries, 5, max_per_page=1).where("query_id = 1"))
    assert sum(c.startswith("lei") for _, _, c in capped) == 1
    assert index.dense_arm == "absent" and I.describe_arm(index) == "words" and not I.provider_may_be_asked(True, index)
    with pytest.raises(ValueError, match="absent"):
        index.search(queries)


def test_search_by_both(spark, docs, queries, tmp_path):
    events, p = [], providers.Deterministic(8)
    index = I.create_dense_index(docs, p, most=80, overlap=40, on_state=events.append)
    assert [e["kind"] for e in events] == ["lexical-done", "embed-start", "embed-done"]
    got = hits(index.search(queries, top_k=4))
    assert [r for q, r, _ in got if q == 1] == [1, 2, 3, 4] and any(q == 3 for q, _, _ in got)
    path = f"file://{tmp_path}/index"
    index.save(path)
    again = I.load(spark, path, provider=p)
    assert hits(again.search(queries, top_k=4)) == got and hits(again.search_lexical(queries)) == hits(index.search_lexical(queries))
    assert again.dense_arm == "ready" and I.approximate_bytes(spark, path) > 1000
    with pytest.raises(ValueError) as e:
        I.load(spark, path, S.PLAIN)
    assert I.classify_load_failure(e.value) == "stale"
    I.forget(spark, path)
    with pytest.raises(Exception) as e:
        I.load(spark, path)
    assert I.classify_load_failure(e.value) == "unknown"
    narrow = providers.Deterministic(8)
    narrow.window = 50
    with pytest.raises(providers.CheckError):
        I.create_dense_index(docs, narrow, most=80, overlap=40)


def eyes():
    """A provider that sees images as their data; a local class, so that it travels to workers by value."""

    class Eyes(providers.Deterministic):
        def __init__(self):
            super().__init__(4)
            self.modalities = ("text", "image")

        def embed_images(self, images):
            return [self.embed_query(i["data"]) for i in images]

        def embed_image_query(self, image):
            return self.embed_images([image])[0]

    return Eyes()


def test_pages(spark):
    page = "page struct<data:string,mime_type:string>"
    docs = spark.createDataFrame([("a", "Alfa beta.", None), ("p", "", ("QUJD", "image/png"))], f"doc_id string, text string, {page}")
    with pytest.raises(providers.CheckError):
        I.create_dense_index(docs, providers.Deterministic(4))
    index = I.create_dense_index(docs, eyes())
    assert index.n == 2 and index.average == 2.0
    asked = spark.createDataFrame([(1, None, ("QUJD", "image/png"))], f"query_id long, text string, {page}")
    assert hits(index.search(asked))[0][2] == "p#0"
    both = spark.createDataFrame([("x", "t", ("QUJD", "image/png"))], f"doc_id string, text string, {page}")
    with pytest.raises(ValueError, match="besides"):
        I.create_index(both)
    with pytest.raises(ValueError, match="tokenizer"):
        I.create_index(spark.createDataFrame([("a", "... !!")], "doc_id string, text string"))


def test_empty_corpus_costs_nothing(spark, queries):
    index = I.create_dense_index(spark.createDataFrame([], "doc_id string, text string"), providers.Deterministic(4))
    index.provider = None
    assert hits(index.search(queries)) == []


def test_packets(docs, queries):
    rows = {r["query_id"]: r["packet"] for r in I.create_index(docs, most=80, overlap=40).packets(queries, 2).collect()}
    assert rows[1].startswith("QUESTION multa") and rows[1].count("### [") == 2 and rows[3].count("###") == 0


def test_choices():
    assert I.choose_provider({}) is None and I.choose_provider({"OPENAI_API_KEY": "k"}).id.startswith("openai")
    assert "key" not in I.public_shape(I.choose_provider({"GEMINI_API_KEY": "secret"})) and "secret" not in str(I.public_shape(I.choose_provider({"GEMINI_API_KEY": "secret"})))


# ---------------------------------------------------------------- a round


def recording(fixture, supports, parts=("A multa é de 500. O foro é Lisboa.",), chunks=()):
    return {"id": fixture, "model": "m", "recordedAt": f"2026-0{len(fixture)}", "storeEmbeddingModel": "e", "parts": [{"text": p} for p in parts], "usageMetadata": {"toolUsePromptTokenCount": 3}, "groundingMetadata": {"groundingChunks": [{"retrievedContext": c} for c in chunks], "groundingSupports": supports}}


def support(a, b, text, *indices):
    return {"segment": {"startIndex": a, "endIndex": b, "text": text}, "groundingChunkIndices": list(indices)}


def test_a_round(spark, tmp_path):
    doc = "Clausula: a multa e de 500 reais. Clausula: o foro e Lisboa. Fim. Fim."
    chunks = [{"text": "a multa e de 500 reais.", "title": "lei"}, {"text": "o foro e Lisboa.", "customMetadata": [{"key": "documentId", "stringValue": "lei"}]}, {"text": "Fim.", "title": "lei"}, {"text": "ausente", "title": "?"}, {"title": "lei"}]
    text = "A multa é de 500. O foro é Lisboa."
    first, second = text[:17], text[18:]
    n1, n = len(first.encode()), len(text.encode())
    supports = [support(0, n1, first, 0, 1), support(n1 + 1, n, second, 1, 4), support(0, n1, first, 2), support(n1 + 1, n, second, 3), support(0, n1, first), support(0, n1 + 1, first, 0)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "q.json").write_text(json.dumps(recording("q", supports, chunks=chunks)))
    g = lambda s: {"documentId": "lei", "span": {"start": doc.index(s), "end": doc.index(s) + len(s)}}
    label = {"id": "q", "parts": [{"text": text}], "segments": [{"partIndex": 0, "textSpan": {"start": 0, "end": 17}, "sourceSpans": [g("a multa e de 500 reais.")]}, {"partIndex": 0, "textSpan": {"start": 18, "end": 34}, "sourceSpans": [g("o foro e")]}], "labeledBy": "x", "labeledAt": "y"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "q.json").write_text(json.dumps(label))
    from attesta.sources import corpus

    recorded, labels = corpus.recordings(spark, f"file://{tmp_path}/r"), corpus.labels(spark, f"file://{tmp_path}/l")
    documents = spark.createDataFrame([("lei", doc), ("other", "x")], "document_id string, text string")
    fixtures = spark.createDataFrame([("q", "lei")], "fixture string, document_id string")
    variants = spark.createDataFrame([("q", "plain")], "fixture string, variant string")
    r = R.run_round(recorded, labels, documents, fixtures, variants, {"model": "m"}).first().asDict()
    assert (r["citations_correct"], r["citations_scored"]) == (3, 3) and (r["segments_covered"], r["segments_sustained"]) == (2, 2)
    assert (r["choice_supports"], r["partial_supports"], r["sourceless"], r["not_located"], r["ambiguous"], r["unmatched_document"]) == (1, 1, 1, 1, 1, 1)
    assert (r["length"], r["position"], r["meta_mismatch"], r["publishable"], r["all_plus_one"]) == (1, 1, 0, False, True)
    assert r["precision"] == 1.0 and r["sample_sufficient"] is False and r["tool_used"] == 1 and r["by_document_held"] is False
    assert (r["lost_by_custom"], r["lost_by_title"], r["ambiguous_in_one"], r["empty_metadata"]) == (0, 0, 1, 0)
    plain, code = r["by_class"]["plain"], r["by_class"]["code"]
    assert len(r["by_class"]) == 6 and tuple(plain) == (1.0, 1.0, 1.0, 1.0, 1.0, 2) and tuple(code) == (0.0, 0.0, 0.0, 0.0, None, 0)
    _, sources = R.parse(recorded, documents, fixtures)
    assert [s["snippet"] for s in sources.where("snippet is not null").collect()] == ["ausente"]
    assert R.not_located_by_document(sources, variants).collect() == []
    named = sources.withColumns({"document_id": F.coalesce("document_id", F.lit("lei")), "in_fixture": F.lit(True)})
    assert [tuple(x) for x in R.not_located_by_document(named, variants).collect()] == [("plain", "lei", 1)]
    mass = R.gold_mass(labels, documents).collect()
    assert len(mass) == 2 and all(m["plain"] == 1.0 for m in mass)
    wrong = spark.createDataFrame([("q", [("other text",)])], "id string, parts array<struct<text:string>>")
    with pytest.raises(ValueError, match="differ"):
        R.run_round(recorded, wrong.withColumn("segments", F.lit(None).cast(labels.schema["segments"].dataType)), documents, fixtures, variants)
    with pytest.raises(ValueError, match="does not have"):
        R.parse(recorded, documents, spark.createDataFrame([("q", "lost")], "fixture string, document_id string"))


def test_headers(spark):
    """A field that the run states must be equal, a date within the interval; what it does not state is free."""
    kind = "model string, recordedAt string, storeEmbeddingModel string, storeChunking struct<maxTokensPerChunk:int,maxOverlapTokens:int>"
    rows = spark.createDataFrame([("m", "2026-02", "e", (200, 20)), ("m", "2026-04", "e", (200, 30)), (None, None, None, None)], kind)
    differs = lambda meta: [r[0] for r in rows.select(R.header_differs(meta)).collect()]
    assert differs({}) == [False] * 3 and differs({"model": "m"}) == [False, False, True]
    assert differs({"recordedAt": "2026-02"}) == [False, True, True] and differs({"recordedAt": "2026-01/2026-04"}) == [False, False, True]
    assert differs({"storeChunking": {"maxTokensPerChunk": 200, "maxOverlapTokens": 20}}) == [False, True, True]


def test_a_saved_index_keeps_its_parameters(spark, tmp_path):
    """Scores after a reload are those of before, whatever k1 and b are."""
    docs = spark.createDataFrame([(str(i), "alfa beta " * (i + 1) + f"gama{i}") for i in range(5)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "alfa gama3")], "query_id int, text string")
    index, path = I.create_index(docs, k1=0.5, b=0.1), f"file://{tmp_path}/custom"
    index.save(path)
    score = lambda i: {r["chunk_id"]: r["score"] for r in i.search_lexical(asked).collect()}
    again = I.load(spark, path)
    assert (again.k1, again.b) == (0.5, 0.1) and score(again) == pytest.approx(score(index))
    assert score(index) != pytest.approx(score(I.create_index(docs)))
