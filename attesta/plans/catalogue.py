"""Every query of the package by name, with the SQL that checks it.

Where the tables lack an input (answers with their passages, gold spans, recordings), it is derived
from whole tables by rules that both sides state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions import exact
from ..operators import analytics, analyze, attribution, dense, lexical, ruler, workbench
from ..sources import staging
from ..sources.corpus import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "conversations") else rows


def longs(df: DataFrame) -> DataFrame:
    """Integers as bigint, which is what the SQL side returns."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- shared SQL

_WORDS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}\p{{M}}]+')"


def _stem_sql(t: str) -> str:
    out = f"CASE WHEN length({t}) < 3 OR {t} NOT LIKE '%s' THEN {t} "
    for ending, new, least, spared in K.PLURAL_RULES:
        keep = f" AND {t} NOT IN ({', '.join(repr(s) for s in spared)})" if spared else ""
        out += f"WHEN {t} LIKE '%{ending}' AND length({t}) >= {len(ending) + least}{keep} THEN substring({t}, 1, length({t}) - {len(ending)}) || '{new}' "
    return out + f"ELSE {t} END"


def _terms_sql(table: str, key: str, text: str = "text") -> str:
    return f"SELECT {key}, {_stem_sql('w')} AS term FROM (SELECT {key}, unnest({_WORDS.format(text)}) AS w FROM {table})"


_D = "CAST('{}' AS DOUBLE)"
_IDF = f"ln({_D.format(1.0)} + (CAST({{n}} AS DOUBLE) - CAST({{df}} AS DOUBLE) + {_D.format(0.5)}) / (CAST({{df}} AS DOUBLE) + {_D.format(0.5)}))"


def _bm25_sql(tail: str) -> str:
    norm = f"({_D.format(1 - K.BM25_B)} + {_D.format(K.BM25_B)} * (CAST(len AS DOUBLE) / average))"
    return f"""
WITH d AS ({_terms_sql('documents', 'doc_id')}), q AS ({_terms_sql('benchmark', 'item_id')}),
lens AS (SELECT doc_id, count(*) AS len FROM d GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM d) / (SELECT count(*) FROM documents) AS average),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, round(sum(qtf * {_IDF.format(n='n', df='df')} * (tf * {_D.format(K.BM25_K1 + 1)}) / (tf + {_D.format(K.BM25_K1)} * {norm})), 6) AS score
       FROM qt JOIN tf USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st GROUP BY 1, 2)
{tail}"""


# ---------------------------------------------------------------- text and terms


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_code_points, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
substring(text, 6, 20) AS inner_slice, CASE WHEN length(text) >= 7 THEN substring(text, length(text) - 6, 7) ELSE text END AS tail_slice FROM documents""")
def code_point_stats(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.code_points(t).alias("n_code_points"), C.utf8_bytes(t).alias("n_bytes"),
        C.slice_code_points(t, F.lit(5), F.lit(25)).alias("inner_slice"), C.slice_code_points(t, F.lit(-7)).alias("tail_slice"),
    )


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)")
def tokens_class_path(spark, sf_dir):
    rows = lexical.with_terms(table(spark, sf_dir, "documents"), stemmed=False)
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_tokens"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.fold("text").alias("folded"))


@query("SELECT doc_id, nfc_normalize(text) AS nfc, CAST(length(nfc_normalize(text)) AS BIGINT) AS n FROM documents")
def nfc_text(spark, sf_dir):
    return longs(table(spark, sf_dir, "documents").select("doc_id", exact.nfc(F.col("text")).alias("nfc")).withColumn("n", F.char_length("nfc")))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n_matches, CAST(coalesce(list_sum([length(m) for m in regexp_extract_all(text, '[A-Z][a-z]+')]), 0) AS BIGINT) AS n_matched FROM documents")
def match_spans(spark, sf_dir):
    """Capitalised words by their positions."""
    spans = table(spark, sf_dir, "documents").select("doc_id", exact.match_spans(F.col("text"), "[A-Z][a-z]+").alias("s"))
    return longs(spans.select("doc_id", F.size("s").alias("n_matches"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_matched")))


@query(f"SELECT DISTINCT w AS term, {_stem_sql('w')} AS stem FROM (SELECT unnest({_WORDS.format('text')}) AS w FROM documents)")
def stem_plural(spark, sf_dir):
    terms = lexical.with_terms(table(spark, sf_dir, "documents"), stemmed=False).select(F.explode("terms").alias("term")).distinct()
    return terms.select("term", C.stem_plural(F.col("term")).alias("stem"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM ({_terms_sql('documents', 'doc_id')}) GROUP BY 1, 2")
def term_frequency(spark, sf_dir):
    return lexical.postings(lexical.with_terms(table(spark, sf_dir, "documents")), "doc_id").select("doc_id", "term", "tf")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM ({_terms_sql('documents', 'doc_id')}) GROUP BY 1")
def document_frequency(spark, sf_dir):
    return lexical.term_stats(lexical.postings(lexical.with_terms(table(spark, sf_dir, "documents")), "doc_id"))


@query(f"""WITH t AS ({_terms_sql('documents', 'doc_id')}), s AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, occurrences, round(ln((CAST(n AS DOUBLE) - df + {_D.format(0.5)}) / (df + {_D.format(0.5)})), 6) AS classic, round({_IDF.format(n='n', df='df')}, 6) AS lucene,
round(CAST(occurrences AS DOUBLE) / (SELECT count(*) FROM t), 6) AS share FROM s, n WHERE df * 2 > n""")
def df_regime(spark, sf_dir):
    """Words in more than half of the documents, of which the classic weight is negative."""
    docs = lexical.indexed(table(spark, sf_dir, "documents"), "doc_id")
    stats = lexical.corpus_stats(docs)
    rows = lexical.df_regime(lexical.postings(docs, "doc_id"), stats).crossJoin(docs.agg(F.sum(F.size("terms")).alias("all"))).crossJoin(stats.select("n"))
    share = F.col("occurrences").cast("double") / F.col("all").cast("double")
    return rows.where(F.col("df") * 2 > F.col("n")).select("term", "df", "occurrences", F.round("classic", 6).alias("classic"), F.round("lucene", 6).alias("lucene"), F.round(share, 6).alias("share"))


@query(f"""WITH t AS ({_terms_sql('documents', 'doc_id')}), s AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT n, count(*) AS vocabulary, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) FILTER (df * 2 > n) AS negative_terms, round(CAST(coalesce(sum(occurrences) FILTER (df * 2 > n), 0) AS DOUBLE) / CAST(sum(occurrences) AS DOUBLE), 6) AS negative_share FROM s, n GROUP BY n""")
def df_regime_summary(spark, sf_dir):
    docs = lexical.indexed(table(spark, sf_dir, "documents"), "doc_id")
    rows = lexical.regime_summary(lexical.postings(docs, "doc_id"), lexical.corpus_stats(docs))
    return rows.withColumn("negative_share", F.round("negative_share", 6))


@query(f"""WITH t AS ({_terms_sql('documents', 'doc_id')}), s AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT row_number() OVER (ORDER BY df DESC, term) AS place, term, df, round(ln((CAST(n AS DOUBLE) - df + {_D.format(0.5)}) / (df + {_D.format(0.5)})), 6) AS classic FROM s, n WHERE df * 2 > n""")
def negative_terms(spark, sf_dir):
    docs = lexical.indexed(table(spark, sf_dir, "documents"), "doc_id")
    rows = lexical.negative_terms(lexical.postings(docs, "doc_id"), lexical.corpus_stats(docs))
    return longs(rows.select("place", "term", "df", F.round("classic", 6).alias("classic")))


# ---------------------------------------------------------------- retrieval


def _searched(spark, sf_dir) -> DataFrame:
    docs, items = (lexical.indexed(table(spark, sf_dir, t), k) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    return lexical.bm25(docs, "doc_id", items, "item_id", digits=6)


@query(_bm25_sql("SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10"))
def bm25_topk(spark, sf_dir):
    return longs(lexical.ranked(_searched(spark, sf_dir), "item_id", "doc_id", K.TOP_K))


FLAGSHIP = bm25_topk


@query(_bm25_sql(""", p AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 7 END AS page_number FROM sc WHERE score > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id, page_number ORDER BY score DESC, doc_id) AS on_page FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE page_number IS NULL OR on_page <= 1)
SELECT item_id, doc_id, score, page_number, rank FROM r WHERE rank <= 10"""))
def bm25_topk_page_capped(spark, sf_dir):
    page = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 7)
    return longs(lexical.capped(_searched(spark, sf_dir).withColumn("page_number", page), "item_id", "doc_id", K.TOP_K, 1))


@query(f"SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])), 6) AS norm, CAST(len(embedding) AS BIGINT) AS width, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])), 6) AS first_unit FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.norm("embedding"), 6).alias("norm"), F.size("embedding").cast("long").alias("width"), F.round(F.get(C.normalize("embedding"), F.lit(0)), 6).alias("first_unit"))


_COS = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"


@query(f"""SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE score > 0) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """Every twentieth vector asks all."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding").toArrow().to_pandas()
    found = dense.top_cosines(rows, "vec_id", asked, "query_id", depth=K.TOP_K, digits=6)
    return longs(found.select("query_id", "vec_id", "score", "rank"))


@query(_bm25_sql(f""", dn AS (SELECT b.item_id, e.vec_id AS doc_id, {_COS} AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
lr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0),
dr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dn WHERE score > 0),
f AS (SELECT item_id, doc_id, round(sum({_D.format(1.0)} / ({_D.format(60.0)} + rank)), 9) AS score FROM (SELECT * FROM lr WHERE rank <= 100 UNION ALL SELECT * FROM dr WHERE rank <= 100) GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""))
def hybrid_rrf_topk(spark, sf_dir):
    """Item i asks by its words and by vector i; vector j is that of document j."""
    vectors, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    asked = items.join(vectors, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    near = dense.cosine_scores(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", asked, "item_id", digits=6)
    return longs(lexical.ranked(dense.hybrid(_searched(spark, sf_dir), near, "item_id", "doc_id", digits=9), "item_id", "doc_id", K.TOP_K))


@query(_bm25_sql(f""", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0),
a AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT item_id, min(rank) AS best FROM r JOIN a USING (item_id, doc_id) WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (best <= 1) AS hit_1, count(*) FILTER (best <= 3) AS hit_3, count(*) FILTER (best <= 5) AS hit_5,
round(avg(coalesce({_D.format(1.0)} / best, 0)), 6) AS mrr FROM benchmark LEFT JOIN f USING (item_id)"""))
def retrieval_mrr_hits(spark, sf_dir):
    """Documents that hold an item word for word are what its search should find."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    found = lexical.ranked(_searched(spark, sf_dir), "item_id", "doc_id", K.TOP_K)
    right = ruler.located(items, docs, "item_id", "text").select("item_id", "doc_id").distinct()
    return analytics.retrieval_metrics(found, right, "item_id", "doc_id", items)


@query(_bm25_sql("SELECT item_id, doc_id % 50 AS page, max(score) AS score FROM sc GROUP BY 1, 2"))
def page_scores(spark, sf_dir):
    return analytics.page_scores(_searched(spark, sf_dir).withColumn("page", F.col("doc_id") % 50), "item_id", "page")


# ---------------------------------------------------------------- segmentation

_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i, length(line) AS n, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(line) - 1 AS s FROM l),
z AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, s, s + n AS e FROM p WHERE n > 0)"""


def _lines(spark, sf_dir) -> DataFrame:
    """(doc_id, ord, start, end) of the lines that are not empty, which stand for sentences here."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), F.char_length)).alias("i", "n"))
    n, order = F.col("n"), W.partitionBy("doc_id").orderBy("i")
    rows = rows.select("doc_id", "i", "n", (F.sum(n + 1).over(order) - n - 1).alias("start"))
    rows = rows.where("n > 0").withColumn("ord", F.row_number().over(order) - 1)
    return rows.select("doc_id", "ord", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("n")).cast("int").alias("end"))


@query(f"""WITH RECURSIVE {_LINES},
lst AS (SELECT a.doc_id, a.ord, a.s, max(CASE WHEN b.e - a.s <= 1200 OR b.ord = a.ord THEN b.ord END) AS last FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.ord >= a.ord GROUP BY 1, 2, 3),
nx AS (SELECT x.doc_id, x.ord, x.s, x.last, le.e, n.e AS after FROM lst x JOIN z le ON le.doc_id = x.doc_id AND le.ord = x.last LEFT JOIN z n ON n.doc_id = x.doc_id AND n.ord = x.last + 1),
st AS (SELECT x.doc_id, x.ord, x.s, x.e, CASE WHEN x.after IS NOT NULL THEN coalesce((SELECT min(m.ord) FROM z m WHERE m.doc_id = x.doc_id AND m.ord > x.ord AND m.ord <= x.last AND x.e - m.s <= 160 AND x.after - m.s <= 1200), x.last + 1) END AS nxt FROM nx x),
c(doc_id, ordinal, s, e, nxt) AS (SELECT doc_id, 0, s, e, nxt FROM st WHERE ord = 0 UNION ALL SELECT c.doc_id, c.ordinal + 1, st.s, st.e, st.nxt FROM c JOIN st ON c.doc_id = st.doc_id AND c.nxt = st.ord)
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM c""")
def sentence_windows_chunks(spark, sf_dir):
    """Chunks of lines."""
    return longs(analyze.chunk_spans(_lines(spark, sf_dir), "doc_id", K.MAX_CHUNK, K.MAX_OVERLAP))


def _marked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as texts with a length, and marks: each line longer than 80 is one, of a kind by its number."""
    lines = _lines(spark, sf_dir).where(F.col("end") - F.col("start") > 80)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("length"))
    kinds = F.array(*map(F.lit, ruler.KINDS))
    return docs, lines.select("doc_id", F.get(kinds, F.col("ord") % 5).alias("kind"), F.col("start"), (F.col("end") - F.when(F.col("ord") % 2 == 0, 3).otherwise(0)).alias("end"))


_MARKS = f"{_LINES}, k AS (SELECT doc_id, ord, ['code','url','formula','enumerator','abbreviation'][ord % 5 + 1] AS kind, s, CASE WHEN ord % 2 = 0 THEN e - 3 ELSE e END AS e FROM z WHERE e - s > 80)"


@query(f"""WITH {_MARKS}, u AS (SELECT doc_id, s, e, 0 AS l FROM k UNION ALL SELECT doc_id, length(text), length(text), 1 FROM documents),
r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY l, s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM u)
SELECT doc_id, CAST(reached AS BIGINT) AS start, CAST(s AS BIGINT) AS "end" FROM r WHERE s > reached""")
def uncovered_ranges(spark, sf_dir):
    return longs(workbench.uncovered(*_marked(spark, sf_dir), "doc_id"))


@query(f"""WITH {_MARKS}, c AS (SELECT doc_id, s AS p FROM k UNION SELECT doc_id, e FROM k UNION SELECT doc_id, 0 FROM documents UNION SELECT doc_id, length(text) FROM documents),
i AS (SELECT doc_id, p AS s, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM c)
SELECT i.doc_id, CAST(i.s AS BIGINT) AS start, CAST(i.e AS BIGINT) AS "end", coalesce(string_agg(DISTINCT k.kind, ',' ORDER BY k.kind), '') AS kinds
FROM i LEFT JOIN k ON i.doc_id = k.doc_id AND k.s <= i.s AND i.e <= k.e WHERE i.e IS NOT NULL GROUP BY 1, 2, 3""")
def elementary_pieces(spark, sf_dir):
    return longs(workbench.pieces(*_marked(spark, sf_dir), "doc_id"))


@query(f"""WITH {_MARKS}, d AS (SELECT doc_id, 0 AS s, length(text) AS e FROM documents),
o AS (SELECT d.doc_id, k.kind, CASE WHEN k.kind IS NOT NULL AND d.e > d.s THEN CAST(least(d.e, k.e) - greatest(d.s, k.s) AS DOUBLE) / (d.e - d.s) ELSE {_D.format(0.0)} END AS part, d.e > d.s AS filled FROM d LEFT JOIN k ON d.doc_id = k.doc_id AND k.s < d.e AND d.s < k.e)
SELECT doc_id AS span, {', '.join(f"round(sum(CASE WHEN kind = '{k}' THEN part ELSE {_D.format(0.0)} END), 6) AS {k}" for k in ruler.KINDS)},
round(max(CASE WHEN filled THEN {_D.format(1.0)} ELSE {_D.format(0.0)} END) - sum(part), 6) AS plain FROM o GROUP BY 1""")
def class_mass(spark, sf_dir):
    """What kinds of regions each document consists of."""
    docs, marks = _marked(spark, sf_dir)
    spans = docs.select(F.col("doc_id").alias("span"), "doc_id", F.lit(0).alias("start"), F.col("length").alias("end"))
    return ruler.class_mass(spans, marks, digits=6)


_BUCKETS = ("gold", "scored", "ambiguous", "not_located")


@query(f"""WITH {_MARKS}, o AS (SELECT z.doc_id, z.ord, k.kind, CASE WHEN k.kind IS NOT NULL THEN CAST(least(z.e, k.e) - greatest(z.s, k.s) AS DOUBLE) / (z.e - z.s) ELSE {_D.format(0.0)} END AS part FROM z LEFT JOIN k ON z.doc_id = k.doc_id AND k.s < z.e AND z.s < k.e),
g AS (SELECT doc_id, ord, {', '.join(f"round(sum(CASE WHEN kind = '{k}' THEN part ELSE {_D.format(0.0)} END), 6) AS {k}" for k in ruler.KINDS)}, round(1 - sum(part), 6) AS plain FROM o GROUP BY 1, 2),
b AS (SELECT doc_id % 2 AS variant, [{', '.join(repr(b) for b in _BUCKETS)}][(doc_id + ord) % 4 + 1] AS bucket, unnest([{', '.join(repr(k) for k in (*ruler.KINDS, 'plain'))}]) AS class, unnest([{', '.join((*ruler.KINDS, 'plain'))}]) AS mass FROM g),
m AS (SELECT variant, class, {', '.join(f"coalesce(avg(mass) FILTER (bucket = '{b}'), 0) AS {b}" for b in _BUCKETS)}, count(*) FILTER (bucket = 'gold' AND mass > 0) AS gold_spans FROM b GROUP BY 1, 2)
SELECT variant, class, {', '.join(f'round({b}, 6) AS {b}' for b in _BUCKETS)}, CASE WHEN gold <> 0 THEN round(scored / gold, 6) END AS scored_over_gold, gold_spans FROM m""")
def report_by_class(spark, sf_dir):
    """The columns by class of a report; lines stand for spans, of a bucket by their number."""
    _, marks = _marked(spark, sf_dir)
    spans = _lines(spark, sf_dir).withColumn("span", F.struct("doc_id", "ord"))
    masses = ruler.class_mass(spans, marks, digits=6)
    bucket = F.get(F.array(*map(F.lit, _BUCKETS)), ((F.col("span.doc_id") + F.col("span.ord")) % 4).cast("int"))
    return ruler.class_columns(masses.withColumns({"variant": F.col("span.doc_id") % 2, "bucket": bucket}), ["variant"], 6)


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, g AS chunk, g * 500 AS s, least(g * 500 + 800, length(text)) AS e FROM (SELECT doc_id, text, unnest(range(0, length(text) // 500 + 1)) AS g FROM documents))
SELECT doc_id, sentence, chunk_id FROM (SELECT z.doc_id, CAST(z.ord AS BIGINT) AS sentence, CAST(c.chunk AS BIGINT) AS chunk_id,
row_number() OVER (PARTITION BY z.doc_id, z.ord ORDER BY least(z.s - c.s, c.e - z.e) DESC, c.e DESC, c.s, c.chunk) AS place FROM z JOIN c ON z.doc_id = c.doc_id AND c.s <= z.s AND z.e <= c.e) WHERE place = 1""")
def seam_choice(spark, sf_dir):
    """Of overlapping stretches of a document the one that holds each line most centrally."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n"))
    chunks = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 500).cast("int"))).alias("chunk_id"))
    chunks = chunks.select("doc_id", "chunk_id", (F.col("chunk_id") * 500).alias("start"), F.least(F.col("chunk_id") * 500 + 800, F.col("n")).alias("end"))
    return longs(ruler_seam(_lines(spark, sf_dir).withColumnRenamed("ord", "sentence"), chunks))


ruler_seam = attribution.seam_choice


@query(f"""WITH {_LINES}, c AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM (SELECT doc_id, ord, s, e FROM z) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (s < pe) AS overlapping, count(*) FILTER (s >= ps AND e <= pe) AS redundant, count(*) FILTER (e - s > 1200) AS oversized, CAST(sum(e - s) AS BIGINT) AS chunk_code_points FROM c GROUP BY 1)
SELECT d.doc_id, CAST(length(text) AS BIGINT) AS code_points, CAST(len(regexp_extract_all(text, '[0-9]+(?:[.,/:-][0-9]+)+')) AS BIGINT) AS composite_numbers,
CAST(len(regexp_extract_all(text, '(?i)\\b(?:art|arts|inciso|al[ií]nea|par[aá]grafo)\\b|§')) AS BIGINT) AS provisions, chunks, overlapping, redundant, oversized, chunk_code_points FROM documents d LEFT JOIN g USING (doc_id)""")
def corpus_profile(spark, sf_dir):
    return longs(analytics.profile(_lines(spark, sf_dir).withColumnRenamed("ord", "ordinal"), table(spark, sf_dir, "documents")))


# ---------------------------------------------------------------- attribution


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer"), "text")


def _found(turns: DataFrame, docs: DataFrame) -> DataFrame:
    """(answer, doc_id, rank) that the search by BM25 finds for the turns in all documents, given by their terms."""
    return lexical.best(docs, "doc_id", lexical.indexed(turns, "answer"), "answer", K.TOP_K, digits=6)


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as answers, cut at full stops to clauses, and what the search finds for each turn in all
    documents as its candidates. Of a candidate's terms those are kept that the answer holds too, and negations: no
    other is asked for."""
    docs, turns = lexical.indexed(table(spark, sf_dir, "documents"), "doc_id"), _turns(spark, sf_dir)
    clauses = turns.select("answer", F.posexplode(F.split("text", r"\.")).alias("clause", "text"))
    clauses = staging.stage(lexical.with_terms(clauses).where("size(terms) > 0").select("answer", "clause", F.array_distinct("terms").alias("terms")), "clauses")
    asked = clauses.groupBy("answer").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("asked"))
    asked = staging.stage(asked.withColumn("asked", F.array_union("asked", F.array(*map(F.lit, K.NEGATION_MARKERS)))), "asked")
    found = staging.bounded(staging.stage(_found(turns, docs).select("answer", F.col("doc_id").alias("cand")), "found"), 64)
    held = found.join(docs.withColumnRenamed("doc_id", "cand"), "cand").join(staging.bounded(asked, 4096), "answer")
    return clauses, staging.stage(held.select("answer", "cand", F.array_intersect("terms", "asked").alias("terms")), "candidates")


_ANSWERS = f"""t AS (SELECT conv_id * 1000 + turn AS answer, text FROM conversations WHERE role = 'assistant'),
bd AS ({_terms_sql('documents', 'doc_id')}), bq AS ({_terms_sql('t', 'answer')}), bl AS (SELECT doc_id, count(*) AS len FROM bd GROUP BY 1),
bt AS (SELECT doc_id, term, count(*) AS tf FROM bd GROUP BY 1, 2), bf AS (SELECT term, count(*) AS df FROM bt GROUP BY 1),
bn AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM bd) / (SELECT count(*) FROM documents) AS average),
bw AS (SELECT answer, term, count(*) AS qtf FROM bq GROUP BY 1, 2),
bs0 AS (SELECT answer, doc_id, round(sum(qtf * {_IDF.format(n='n', df='df')} * (tf * {_D.format(K.BM25_K1 + 1)}) / (tf + {_D.format(K.BM25_K1)} * ({_D.format(1 - K.BM25_B)} + {_D.format(K.BM25_B)} * (CAST(len AS DOUBLE) / average)))), 6) AS score
       FROM bw JOIN bt USING (term) JOIN bf USING (term) JOIN bl USING (doc_id), bn GROUP BY 1, 2),
m AS (SELECT answer, doc_id AS cand FROM (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY score DESC, doc_id) AS rank FROM bs0 WHERE score > 0) WHERE rank <= {K.TOP_K}),
c0 AS (SELECT answer, unnest(string_split(text, '.')) AS text, generate_subscripts(string_split(text, '.'), 1) - 1 AS clause FROM t),
c1 AS (SELECT answer, clause, unnest({_WORDS.format('text')}) AS w FROM c0), cl AS (SELECT DISTINCT answer, clause, {_stem_sql('w')} AS term FROM c1),
dt AS (SELECT DISTINCT doc_id AS cand, {_stem_sql('w')} AS term FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents)),
ca AS (SELECT m.answer, m.cand, dt.term FROM m JOIN dt USING (cand)), n AS (SELECT answer, count(*) AS n FROM m GROUP BY 1),
f AS (SELECT answer, term, count(*) AS df, n FROM ca JOIN n USING (answer) GROUP BY 1, 2, n),
wt AS (SELECT cl.answer, clause, cand, round(sum({_IDF.format(n='n', df='df')}), 6) AS weight, round(sum({_IDF.format(n='n', df='greatest(df, 1)')}), 6) AS carried
       FROM cl JOIN f ON cl.answer = f.answer AND cl.term = f.term JOIN ca ON ca.answer = cl.answer AND ca.term = cl.term GROUP BY 1, 2, 3),
tt AS (SELECT cl.answer, clause, round(sum({_IDF.format(n='n.n', df='greatest(coalesce(df, 0), 1)')}), 6) AS total FROM cl JOIN n USING (answer) LEFT JOIN f ON cl.answer = f.answer AND cl.term = f.term GROUP BY 1, 2),
bs AS (SELECT * FROM (SELECT *, coalesce(lead(weight) OVER w, 0) AS nxt, row_number() OVER w AS place FROM wt WINDOW w AS (PARTITION BY answer, clause ORDER BY weight DESC, cand)) WHERE place = 1),
rg AS (SELECT x.answer, x.clause, CASE WHEN coalesce(weight, 0) <= 0 OR coalesce(total, 0) <= 0 THEN 'unattributable' WHEN round(carried / total, 6) < {_D.format(0.25)} OR (nxt > 0 AND weight < {_D.format(1.25)} * nxt) THEN 'tied' ELSE 'clear' END AS verdict,
       cand, round(carried / total, 6) AS share FROM (SELECT DISTINCT answer, clause FROM cl) x LEFT JOIN bs USING (answer, clause) LEFT JOIN tt USING (answer, clause))"""


@query(f"WITH {_ANSWERS} SELECT answer, CAST(clause AS BIGINT) AS clause, cand, weight, carried FROM wt")
def clause_candidate_weights(spark, sf_dir):
    return longs(attribution.candidate_weights(*_answers(spark, sf_dir), digits=6))


@query(f"WITH {_ANSWERS} SELECT answer, CAST(clause AS BIGINT) AS clause, verdict, CASE WHEN verdict = 'clear' THEN cand END AS cand, CASE WHEN verdict = 'clear' THEN share END AS confidence FROM rg")
def lexical_rung(spark, sf_dir):
    return longs(attribution.lexical_rung(*_answers(spark, sf_dir), digits=6))


@query(f"WITH {_ANSWERS} SELECT answer, count(*) FILTER (verdict = 'clear') AS lexical, count(*) FILTER (verdict = 'tied') AS tied, count(*) FILTER (verdict = 'unattributable') AS unattributable FROM rg GROUP BY 1")
def rung_counts(spark, sf_dir):
    return attribution.rung_counts(attribution.lexical_rung(*_answers(spark, sf_dir), digits=6))


@query(f"""WITH {_ANSWERS}, v AS (SELECT rg.answer, rg.clause, rg.cand FROM rg WHERE verdict = 'clear'),
x AS (SELECT v.answer, v.clause, v.cand, (SELECT count(*) FROM cl WHERE cl.answer = v.answer AND cl.clause = v.clause AND regexp_matches(cl.term, '[0-9]') AND cl.term NOT IN (SELECT term FROM dt WHERE dt.cand = v.cand)) AS lacking,
(SELECT count(*) FROM cl WHERE cl.answer = v.answer AND cl.clause = v.clause AND cl.term IN {K.NEGATION_MARKERS}) > 0 AS neg, (SELECT count(*) FROM dt WHERE dt.cand = v.cand AND dt.term IN {K.NEGATION_MARKERS}) > 0 AS pneg FROM v)
SELECT answer, CAST(clause AS BIGINT) AS clause, cand, CASE WHEN lacking > 0 THEN 'numeral' WHEN neg <> pneg THEN 'negation' END AS veto FROM x""")
def veto_flags(spark, sf_dir):
    """Numbers and negation of each clear clause against its passage, taken as one sentence."""
    clauses, candidates = _answers(spark, sf_dir)
    won = attribution.lexical_rung(clauses, candidates, digits=6).where("verdict = 'clear'").select("answer", "clause", "cand")
    rows = won.join(clauses.withColumnRenamed("terms", "mine"), ["answer", "clause"]).join(candidates.withColumnRenamed("terms", "theirs"), ["answer", "cand"])
    return longs(attribution.vetoes(rows, "mine", "theirs", "theirs").select("answer", "clause", "cand", "veto"))


@query(f"""WITH {_ANSWERS}, v AS (SELECT answer, clause, cand FROM rg WHERE verdict = 'clear'), p0 AS (SELECT doc_id AS cand, unnest(string_split(text, '.')) AS text, generate_subscripts(string_split(text, '.'), 1) - 1 AS sentence FROM documents),
p AS (SELECT DISTINCT cand, sentence, {_stem_sql('w')} AS term FROM (SELECT cand, sentence, unnest({_WORDS.format('text')}) AS w FROM p0)),
mw AS (SELECT v.answer, v.clause, v.cand, p.sentence, round(sum({_IDF.format(n='f.n', df='f.df')}), 6) AS weight FROM v JOIN cl ON cl.answer = v.answer AND cl.clause = v.clause JOIN f ON f.answer = cl.answer AND f.term = cl.term JOIN p ON p.cand = v.cand AND p.term = cl.term GROUP BY 1, 2, 3, 4),
mb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer, clause ORDER BY weight DESC, sentence) AS place FROM mw WHERE weight > 0) WHERE place = 1),
lk AS (SELECT v.answer, v.clause, count(*) AS lacking FROM v JOIN cl ON cl.answer = v.answer AND cl.clause = v.clause AND regexp_matches(cl.term, '[0-9]') LEFT JOIN dt ON dt.cand = v.cand AND dt.term = cl.term WHERE dt.term IS NULL GROUP BY 1, 2),
ng AS (SELECT DISTINCT answer, clause FROM cl WHERE term IN {K.NEGATION_MARKERS}), pn AS (SELECT DISTINCT cand, sentence FROM p WHERE term IN {K.NEGATION_MARKERS})
SELECT v.answer, CAST(v.clause AS BIGINT) AS clause, v.cand, CAST(mb.sentence AS BIGINT) AS sentence, mb.weight, CASE WHEN lk.lacking > 0 THEN 'numeral' WHEN (ng.answer IS NOT NULL) <> (pn.cand IS NOT NULL) THEN 'negation' END AS veto
FROM v LEFT JOIN mb ON mb.answer = v.answer AND mb.clause = v.clause LEFT JOIN lk ON lk.answer = v.answer AND lk.clause = v.clause LEFT JOIN ng ON ng.answer = v.answer AND ng.clause = v.clause LEFT JOIN pn ON pn.cand = v.cand AND pn.sentence = mb.sentence""")
def matched_sentence(spark, sf_dir):
    """The sentence of its passage that each clear clause rests on, and the vetoes against it; sentences end at full stops."""
    clauses, candidates = _answers(spark, sf_dir)
    won = staging.stage(attribution.lexical_rung(clauses, candidates, digits=6).where("verdict = 'clear'").select("answer", "clause", "cand"), "won")
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand"), F.posexplode(F.split("text", r"\.")).alias("sentence", "text"))
    said = lexical.with_terms(said).select("cand", "sentence", "terms")
    best = attribution.matched_sentences(won, clauses, candidates, said, digits=6)
    rows = won.join(best, ["answer", "clause", "cand"], "left").join(said.withColumnRenamed("terms", "stated"), ["cand", "sentence"], "left")
    rows = rows.join(clauses.withColumnRenamed("terms", "mine"), ["answer", "clause"]).join(candidates.withColumnRenamed("terms", "theirs"), ["answer", "cand"])
    return longs(attribution.vetoes(rows, "mine", "theirs", "stated").select("answer", "clause", "cand", "sentence", "weight", "veto"))


_DENSE = f"""s AS (SELECT q.vec_id AS clause, e.vec_id AS cand, {_COS} AS score, e.vec_id % 3 = 0 AS veto FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM s WHERE score > 0 WINDOW w AS (PARTITION BY clause ORDER BY score DESC, cand)),
k AS (SELECT *, nxt IS NULL OR score >= {_D.format(1.01)} * nxt AS wins FROM o)"""


def _dense_scores(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cand"), "embedding")
    asked = rows.where("cand % 20 = 0").select(F.col("cand").alias("clause"), "embedding")
    return dense.cosine_scores(rows, "cand", asked, "clause", digits=6).where("clause <> cand").withColumn("veto", F.col("cand") % 3 == 0)


@query(f"WITH {_DENSE} SELECT clause, cand, score FROM k WHERE place = 1 AND wins")
def dense_rung(spark, sf_dir):
    return dense.dense_choice(_dense_scores(spark, sf_dir), "clause", "cand", margin=1.01)


@query(f"WITH {_DENSE}, h AS (SELECT *, min(CASE WHEN NOT (wins AND veto) THEN place END) OVER (PARTITION BY clause) AS stop FROM k) SELECT clause, cand, score FROM h WHERE place = stop AND wins AND NOT veto")
def dense_veto_loop(spark, sf_dir):
    return dense.dense_choice_vetoed(_dense_scores(spark, sf_dir), "clause", "cand", "veto", margin=1.01)


# ---------------------------------------------------------------- the ruler


def _snippets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("snippet_id"), F.col("text").alias("snippet")), table(spark, sf_dir, "documents")


_PLACES = """o AS (SELECT b.item_id AS snippet_id, d.doc_id, unnest([i for i in range(1, length(d.text) - length(b.text) + 2) if substring(d.text, CAST(i AS BIGINT), length(b.text)) = b.text]) AS at1, length(b.text) AS n
FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


@query(f'WITH {_PLACES} SELECT snippet_id, doc_id, CAST(at1 - 1 AS BIGINT) AS start, CAST(at1 - 1 + n AS BIGINT) AS "end" FROM o')
def locate_snippets(spark, sf_dir):
    return longs(ruler.located(*_snippets(spark, sf_dir)))


@query(f"WITH {_PLACES}, c AS (SELECT snippet_id, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM o GROUP BY 1) SELECT b.item_id AS snippet_id, CASE WHEN coalesce(occurrences, 0) = 0 THEN 'not_found' WHEN occurrences = 1 THEN 'exact' ELSE 'ambiguous' END AS kind, coalesce(occurrences, 0) AS occurrences, coalesce(documents, 0) AS documents FROM benchmark b LEFT JOIN c ON b.item_id = c.snippet_id")
def snippet_ambiguity(spark, sf_dir):
    snippets, docs = _snippets(spark, sf_dir)
    return longs(ruler.ambiguity(snippets, ruler.located(snippets, docs)))


@query("""WITH b AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents), o AS (SELECT doc_id, text, unnest([0, n // 3, n // 2, n]) AS off FROM b),
x AS (SELECT doc_id, off, hex(encode(text)) AS h FROM o), y AS (SELECT doc_id, off, len(regexp_extract_all(regexp_replace(substring(h, 1, 2 * off), '([0-9A-F][0-9A-F])', '\\1 ', 'g'), '[0-7C-F][0-9A-F] ')) AS whole, substring(h, 2 * off + 1, 1) IN ('8', '9', 'A', 'B') AS inside FROM x)
SELECT DISTINCT doc_id, CAST(off AS BIGINT) AS byte_offset, CAST(CASE WHEN inside THEN whole - 1 ELSE whole END AS BIGINT) AS as_start, CAST(whole AS BIGINT) AS as_end FROM y""")
def byte_to_code_point(spark, sf_dir):
    n = F.octet_length("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), n)).alias("o"))
    places = (ruler.to_code_points(F.col("text"), F.col("o"), e) for e in ("start", "end"))
    return longs(rows.select("doc_id", F.col("o").alias("byte_offset"), *(p.alias(f"as_{e}") for p, e in zip(places, ("start", "end")))).distinct())


def _cited(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments of three hundred, markers and sources of other lengths, over every document as a fixture."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fixture"), F.char_length("text").alias("n"))
    cut = lambda step, length, name: docs.select("fixture", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / step).cast("int"))).alias(name)).select("fixture", F.lit(0).alias("part"), name, (F.col(name) * step).alias("start"), F.least(F.col(name) * step + length, F.col("n")).alias("end"))
    segments, markers = cut(400, 300, "segment"), cut(250, 200, "marker")
    sources = markers.select("fixture", "marker", F.explode(F.sequence(F.lit(0), F.col("marker") % 3)).alias("source"), (F.col("fixture") % 5).alias("document_id"), "start", "end")
    sources = sources.select("fixture", "marker", "source", "document_id", (F.col("start") + F.col("source") * 40).alias("start"), (F.col("end") + F.col("source") * 40).alias("end"))
    return segments, markers, sources


_CITED = """d AS (SELECT doc_id AS fixture, length(text) AS n FROM documents),
sg AS (SELECT fixture, i AS segment, i * 400 AS s, least(i * 400 + 300, n) AS e FROM (SELECT fixture, n, unnest(range(0, n // 400 + 1)) AS i FROM d)),
mk AS (SELECT fixture, i AS marker, i * 250 AS s, least(i * 250 + 200, n) AS e FROM (SELECT fixture, n, unnest(range(0, n // 250 + 1)) AS i FROM d)),
so AS (SELECT fixture, marker, source, fixture % 5 AS document_id, s + source * 40 AS s, e + source * 40 AS e FROM (SELECT *, unnest(range(0, marker % 3 + 1)) AS source FROM mk)),
ms AS (SELECT * FROM (SELECT m.fixture, m.marker, g.segment, least(m.e, g.e) - greatest(m.s, g.s) AS shared, row_number() OVER (PARTITION BY m.fixture, m.marker ORDER BY least(m.e, g.e) - greatest(m.s, g.s) DESC, g.s, g.segment) AS place FROM mk m JOIN sg g ON m.fixture = g.fixture AND least(m.e, g.e) > greatest(m.s, g.s)) WHERE place = 1)"""


@query(f"WITH {_CITED} SELECT fixture, CAST(marker AS BIGINT) AS marker, CAST(segment AS BIGINT) AS segment, CAST(shared AS BIGINT) AS shared FROM ms")
def segment_match(spark, sf_dir):
    segments, markers, _ = _cited(spark, sf_dir)
    return longs(ruler.matched_segment(markers, segments))


_BEST = f"""{_CITED}, gd AS (SELECT fixture, segment AS gold, fixture % 5 AS document_id, s, e, segment FROM sg),
bp AS (SELECT so.fixture, so.marker, so.source, gd.gold, ms.segment, CASE WHEN so.document_id = gd.document_id THEN greatest(CASE WHEN gd.e > gd.s THEN CAST(greatest(0, least(so.e, gd.e) - greatest(so.s, gd.s)) AS DOUBLE) / (gd.e - gd.s) ELSE 0 END,
 CASE WHEN so.e > so.s THEN CAST(greatest(0, least(so.e, gd.e) - greatest(so.s, gd.s)) AS DOUBLE) / (so.e - so.s) ELSE 0 END) ELSE 0 END AS overlap FROM so JOIN ms USING (fixture, marker) JOIN gd ON gd.fixture = ms.fixture AND gd.segment = ms.segment),
bg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture, marker ORDER BY overlap DESC, source, gold) AS place FROM bp) WHERE place = 1)"""


def _best(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    segments, markers, sources = _cited(spark, sf_dir)
    at = ruler.matched_segment(markers, segments).select("fixture", "marker", "segment")
    golds = segments.select("fixture", "segment", F.col("segment").alias("gold"), (F.col("fixture") % 5).alias("document_id"), "start", "end")
    return ruler.best_gold(sources.join(at, ["fixture", "marker"]), golds, ["fixture", "segment"]), sources.groupBy("fixture", "marker").agg(F.count("*").alias("sources")), segments


@query(f"WITH {_BEST} SELECT fixture, CAST(segment AS BIGINT) AS segment, CAST(marker AS BIGINT) AS marker, CAST(source AS BIGINT) AS source, CAST(gold AS BIGINT) AS gold, round(overlap, 6) AS overlap FROM bg")
def span_overlap_score(spark, sf_dir):
    best, _, _ = _best(spark, sf_dir)
    return longs(best.select("fixture", "segment", "marker", "source", "gold", F.round("overlap", 6).alias("overlap")))


_STATES = f"""{_BEST}, cn AS (SELECT fixture, marker, count(*) AS sources FROM so GROUP BY 1, 2),
st AS (SELECT cn.fixture, cn.marker, cn.sources, cn.sources + cn.marker % 2 AS raw_chunks, CASE WHEN cn.marker % 4 = 3 THEN 0 ELSE cn.sources END AS located, bg.segment, bg.overlap FROM cn LEFT JOIN bg USING (fixture, marker)),
sx AS (SELECT *, CASE WHEN located = 0 THEN 'bucket' ELSE 'scored' END AS state, located > 0 AND (raw_chunks > sources OR located < sources) AS partial, located > 1 AS choice, located > 0 AND segment IS NOT NULL AND coalesce(overlap, 0) >= {_D.format(0.5)} AS correct FROM st),
sc AS (SELECT fixture, count(*) FILTER (correct) AS citations_correct, count(*) FILTER (state = 'scored') AS citations_scored, count(*) FILTER (partial) AS partial_supports, count(*) FILTER (choice) AS choice_supports,
 CAST(0 AS BIGINT) AS sourceless, count(*) FILTER (raw_chunks > 1) AS multi_source_supports, sum(CASE WHEN state = 'scored' THEN coalesce(overlap, 0) END) AS overlap_sum FROM sx GROUP BY 1),
se AS (SELECT sg.fixture, sg.segment, coalesce(bool_or(correct), false) AS covered, coalesce(bool_and(state <> 'scored'), false) AS lost FROM sg LEFT JOIN sx ON sg.fixture = sx.fixture AND sg.segment = sx.segment GROUP BY 1, 2),
cv AS (SELECT fixture, count(*) FILTER (covered) AS segments_covered, count(*) FILTER (NOT covered AND lost) AS segments_indeterminate, count(*) FILTER (NOT (NOT covered AND lost)) AS segments_sustained FROM se GROUP BY 1)"""


def _scored(spark, sf_dir) -> DataFrame:
    best, counts, segments = _best(spark, sf_dir)
    located = F.when(F.col("marker") % 4 == 3, 0).otherwise(F.col("sources"))
    states = counts.join(best.select("fixture", "marker", "segment", "overlap"), ["fixture", "marker"], "left").withColumns({"raw_chunks": F.col("sources") + F.col("marker") % 2, "located": located})
    return ruler.scored(ruler.marker_states(states), segments)


@query(f"WITH {_STATES} SELECT fixture, citations_correct, citations_scored, partial_supports, choice_supports, sourceless, multi_source_supports, segments_covered, segments_indeterminate, segments_sustained FROM sc JOIN cv USING (fixture)")
def score_counters(spark, sf_dir):
    return _scored(spark, sf_dir).drop("overlap_sum")


@query(f"""WITH {_STATES} SELECT fixture % 2 AS variant, count(*) AS answers, CAST(sum(citations_correct) AS BIGINT) AS citations_correct, CAST(sum(citations_scored) AS BIGINT) AS citations_scored, CAST(sum(partial_supports) AS BIGINT) AS partial_supports, CAST(sum(choice_supports) AS BIGINT) AS choice_supports,
CAST(sum(sourceless) AS BIGINT) AS sourceless, CAST(sum(multi_source_supports) AS BIGINT) AS multi_source_supports, CAST(sum(segments_covered) AS BIGINT) AS segments_covered, CAST(sum(segments_indeterminate) AS BIGINT) AS segments_indeterminate, CAST(sum(segments_sustained) AS BIGINT) AS segments_sustained,
CASE WHEN sum(citations_scored) > 0 THEN round(CAST(sum(citations_correct) AS DOUBLE) / CAST(sum(citations_scored) AS DOUBLE), 6) END AS precision, CASE WHEN sum(segments_sustained) > 0 THEN round(CAST(sum(segments_covered) AS DOUBLE) / CAST(sum(segments_sustained) AS DOUBLE), 6) END AS coverage,
CASE WHEN sum(citations_scored) > 0 THEN round(sum(overlap_sum) / CAST(sum(citations_scored) AS DOUBLE), 6) END AS mean_overlap, sum(citations_scored) >= 100 AS sample_sufficient FROM sc JOIN cv USING (fixture) GROUP BY 1""")
def run_report(spark, sf_dir):
    return ruler.run_report(_scored(spark, sf_dir).withColumn("variant", F.col("fixture") % 2), ["variant"])


@query("""WITH x AS (SELECT conv_id, turn, text, length(text) AS n, unnest(range(4)) AS quarter FROM conversations), y AS (SELECT *, n * quarter // 4 AS a, n * (quarter + 1) // 4 AS b FROM x),
z AS (SELECT *, octet_length(encode(substring(text, 1, a))) AS sb, octet_length(encode(substring(text, 1, b))) + CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS eb, substring(text, a + 1, b - a) AS seg FROM y)
SELECT conv_id, turn, quarter, CASE WHEN eb > octet_length(encode(text)) THEN 'position' WHEN turn % 3 = 1 THEN 'position' END AS violation, CAST(eb - sb - octet_length(encode(seg)) AS BIGINT) AS length_delta FROM z""")
def parse_checks(spark, sf_dir):
    """Every turn as a part of which each quarter is marked, in every third with an end one byte late."""
    n, quarter = F.char_length("text"), F.col("quarter")
    rows = table(spark, sf_dir, "conversations").withColumn("quarter", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rows = rows.select("conv_id", "turn", "quarter", F.col("text").alias("part_text"), F.floor(n * quarter / 4).cast("int").alias("a"), F.floor(n * (quarter + 1) / 4).cast("int").alias("b"))
    head = lambda c: F.octet_length(F.substring(F.col("part_text"), F.lit(1), F.col(c)))
    rows = rows.withColumns({"start_byte": head("a"), "end_byte": head("b") + F.when(F.col("turn") % 3 == 1, 1).otherwise(0), "segment_text": F.substring(F.col("part_text"), F.col("a") + 1, F.col("b") - F.col("a"))})
    return longs(ruler.parse_checks(rows).select("conv_id", "turn", "quarter", "violation", "length_delta"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS custom, source AS title FROM documents),
k AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 2 = 0 AS fx FROM documents UNION ALL SELECT DISTINCT source, false FROM documents WHERE source <> 'src3')
SELECT t.doc_id, coalesce(a.id, b.id) AS document_id, coalesce(CASE WHEN a.id IS NOT NULL THEN a.fx ELSE b.fx END, false) AS in_fixture FROM t LEFT JOIN k a ON a.id = t.custom LEFT JOIN k b ON b.id = t.title""")
def resolve_origins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hints = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).alias("custom"), F.col("source").alias("title"))
    known = docs.select(F.col("doc_id").cast("string").alias("document_id"), (F.col("doc_id") % 2 == 0).alias("in_fixture")).union(docs.where("source <> 'src3'").select("source").distinct().withColumn("f", F.lit(False)))
    return ruler.resolve_origin(hints, known).select("doc_id", "document_id", "in_fixture")


@query("SELECT role, CASE WHEN min(s) = max(s) THEN min(s) ELSE min(s) || '/' || max(s) END AS recorded_at FROM (SELECT role, '2026-' || lpad(CAST(1 + conv_id % 12 AS VARCHAR), 2, '0') AS s FROM conversations) GROUP BY 1")
def recorded_at(spark, sf_dir):
    at = F.concat(F.lit("2026-"), F.lpad((1 + F.col("conv_id") % 12).cast("string"), 2, "0"))
    return ruler.recorded_at(table(spark, sf_dir, "conversations").withColumn("recorded_at", at), ["role"])


_ENTRIES = """e AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'labeled-' || CAST(doc_id + 1 AS VARCHAR) WHEN doc_id % 13 = 0 THEN CAST(doc_id - 1 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS id, 'p' || CAST(doc_id - CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS path,
CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'derived' END AS kind, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'secret' ELSE 'CC0' END WHEN doc_id % 21 = 0 THEN 'CC0' END AS license,
CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 19 = 0 THEN [] ELSE [CAST(doc_id - 1 AS VARCHAR)] END WHEN doc_id % 14 = 0 THEN ['x'] END AS derived_from FROM documents), pr AS (SELECT 'p' || CAST(doc_id + CASE WHEN doc_id % 23 = 0 THEN 100000000 ELSE 0 END AS VARCHAR) AS path FROM documents)"""


@query(f"""WITH {_ENTRIES}, o AS (SELECT id, unnest(derived_from) AS origin FROM e WHERE kind = 'derived'), kn AS (SELECT DISTINCT id AS origin, kind AS ok FROM e),
lb AS (SELECT e.id, substring(e.id, 9) AS raw, e.derived_from FROM e WHERE kind = 'derived' AND e.id LIKE 'labeled-%'), lr AS (SELECT lb.id, r.kind AS rk, lb.derived_from AS a, r.derived_from AS b FROM lb LEFT JOIN e r ON r.id = lb.raw)
SELECT id, 'id appears more than once' AS problem FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT path, 'path is declared more than once' FROM e GROUP BY path HAVING count(*) > 1
UNION ALL SELECT path, 'file has no entry' FROM pr WHERE path NOT IN (SELECT path FROM e) UNION ALL SELECT id, 'entry points at no file' FROM e WHERE path NOT IN (SELECT path FROM pr)
UNION ALL SELECT id, 'license is not allowed' FROM e WHERE kind = 'source' AND coalesce(license, '') NOT IN ('CC0', 'MIT') UNION ALL SELECT id, 'source declares origins' FROM e WHERE kind = 'source' AND derived_from IS NOT NULL
UNION ALL SELECT id, 'derived declares a license' FROM e WHERE kind = 'derived' AND license IS NOT NULL UNION ALL SELECT id, 'derived names no source' FROM e WHERE kind = 'derived' AND coalesce(len(derived_from), 0) = 0
UNION ALL SELECT o.id, 'derived names an unknown source' FROM o WHERE origin NOT IN (SELECT id FROM e) UNION ALL SELECT o.id, 'derived names what is no source' FROM o JOIN kn USING (origin) WHERE ok <> 'source'
UNION ALL SELECT id, 'label has no response' FROM lr WHERE rk IS NULL UNION ALL SELECT id, 'label and response disagree on origins' FROM lr WHERE rk IS NOT NULL AND (rk <> 'derived' OR NOT coalesce(list_sort(list_distinct(a)) = list_sort(list_distinct(b)), false))""")
def manifest_problems(spark, sf_dir):
    """Every document as an entry, some of them with faults by rule."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    entries = docs.select(
        F.when(i % 11 == 0, F.concat(F.lit("labeled-"), s(i + 1))).when(i % 13 == 0, s(i - 1)).otherwise(s(i)).alias("id"),
        F.concat(F.lit("p"), s(i - F.when(i % 17 == 0, 1).otherwise(0))).alias("path"), F.when(i % 2 == 0, "source").otherwise("derived").alias("kind"),
        F.when(i % 2 == 0, F.when(i % 10 == 0, "secret").otherwise("CC0")).when(i % 21 == 0, "CC0").alias("license"),
        F.when(i % 2 == 1, F.when(i % 19 == 0, F.array().cast("array<string>")).otherwise(F.array(s(i - 1)))).when(i % 14 == 0, F.array(F.lit("x"))).alias("derived_from"),
    )
    present = docs.select(F.concat(F.lit("p"), s(i + F.when(i % 23 == 0, 100000000).otherwise(0))).alias("path"))
    return ruler.manifest_problems(entries, present, ["CC0", "MIT"])


@query("""WITH l AS (SELECT conv_id AS fixture, CASE WHEN conv_id % 9 = 0 THEN 'nobody' ELSE 'ana' END AS labeled_by, max(turn) AS n_parts FROM conversations GROUP BY 1, 2),
s AS (SELECT conv_id AS fixture, turn AS segment, turn % 3 AS part, turn * 10 - CASE WHEN turn % 4 = 3 THEN 35 ELSE 0 END AS s, turn * 10 + length(text) % 7 AS e FROM conversations),
g AS (SELECT fixture, segment, s, e - 1 AS e, segment % 5 <> 4 AS allowed FROM s WHERE segment % 6 <> 5),
x AS (SELECT *, max(e) OVER (PARTITION BY fixture, part ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s)
SELECT fixture, CAST(NULL AS BIGINT) AS segment, 'signer is not known' AS problem FROM l WHERE labeled_by <> 'ana' UNION ALL SELECT s.fixture, s.segment, 'part does not exist' FROM s JOIN l USING (fixture) WHERE part < 0 OR part >= n_parts
UNION ALL SELECT fixture, segment, 'span is empty' FROM s WHERE e <= s UNION ALL SELECT fixture, segment, 'starts before the last one ends' FROM x WHERE s < last UNION ALL SELECT fixture, segment, 'has no source' FROM s WHERE segment % 6 = 5
UNION ALL SELECT fixture, segment, 'source is not an origin' FROM g WHERE NOT allowed UNION ALL SELECT fixture, segment, 'source span is empty' FROM g WHERE e <= s""")
def label_problems(spark, sf_dir):
    """Every conversation as a label whose turns are segments, some with faults by rule."""
    t = F.col("turn")
    turns = table(spark, sf_dir, "conversations")
    labels = turns.groupBy(F.col("conv_id").alias("fixture")).agg(F.max("turn").alias("n_parts")).withColumn("labeled_by", F.when(F.col("fixture") % 9 == 0, "nobody").otherwise("ana"))
    segments = turns.select(F.col("conv_id").alias("fixture"), t.alias("segment"), (t % 3).alias("part"), (t * 10 - F.when(t % 4 == 3, 35).otherwise(0)).alias("start"), (t * 10 + F.char_length("text") % 7).alias("end"))
    golds = segments.where("segment % 6 <> 5").select("fixture", "segment", "start", (F.col("end") - 1).alias("end"), (F.col("segment") % 5 != 4).alias("allowed"))
    return longs(ruler.label_problems(labels, segments, golds, ["ana"]))


# ---------------------------------------------------------------- analytics and workbench


@query(r"""WITH d AS (SELECT doc_id, text, 1000 + doc_id AS act FROM documents), n AS (SELECT doc_id AS source, unnest(regexp_extract_all(text, '[0-9][0-9.]*[0-9]|[0-9]')) AS number FROM d),
c AS (SELECT source, number, count(*) AS mentions FROM n GROUP BY 1, 2) SELECT c.source, d.doc_id AS target, CAST(sum(mentions) AS BIGINT) AS mentions FROM c JOIN d ON CAST(d.act AS VARCHAR) = c.number WHERE c.source <> d.doc_id GROUP BY 1, 2""")
def citation_graph(spark, sf_dir):
    """Document i has act number 1000 + i."""
    return analytics.citation_graph(table(spark, sf_dir, "documents").withColumn("act", F.col("doc_id") + 1000))


@query("""SELECT turn % 2 AS model, count(*) AS questions, count(*) FILTER (a AND v = 'correct') AS correct, count(*) FILTER (a AND v = 'neighbour') AS neighbour, count(*) FILTER (a AND v NOT IN ('correct', 'neighbour')) AS missed,
count(*) FILTER (NOT a AND r) AS refused, count(*) FILTER (NOT a AND NOT r AND w) AS warned, count(*) FILTER (NOT a AND NOT r AND NOT w) AS confabulated, count(*) FILTER (NOT k) AS invented
FROM (SELECT turn, conv_id % 5 < 3 AS a, ['correct', 'neighbour', 'wrong'][conv_id % 3 + 1] AS v, conv_id % 7 < 4 AS r, conv_id % 2 = 0 AS w, conv_id % 29 <> 0 AS k FROM conversations) GROUP BY 1""")
def round_tally(spark, sf_dir):
    i = F.col("conv_id")
    verdicts = F.array(F.lit("correct"), F.lit("neighbour"), F.lit("wrong"))
    rows = table(spark, sf_dir, "conversations").select((F.col("turn") % 2).alias("model"), (i % 5 < 3).alias("answerable"), F.get(verdicts, (i % 3).cast("int")).alias("verdict"), (i % 7 < 4).alias("refused"), (i % 2 == 0).alias("warned"), (i % 29 != 0).alias("chunk_known"))
    return analytics.round_tally(rows, ["model"])


@query(r"""SELECT page_id, CASE WHEN len(regexp_extract_all(html, '\p{L}')) >= 60 THEN 'text' WHEN page_id % 4 = 0 THEN 'image' ELSE 'dropped' END AS arm, url || '#p' || CAST(page_id AS VARCHAR) AS page_key, url AS file, page_id AS page FROM pages""")
def page_arm_routing(spark, sf_dir):
    image = F.when(F.col("page_id") % 4 == 0, F.lit("image"))
    key = workbench.page_id(F.col("url"), F.col("page_id"))
    return longs(table(spark, sf_dir, "pages").select("page_id", workbench.page_arm(F.col("html"), image).alias("arm"), key.alias("page_key"), workbench.file_of(key).alias("file"), workbench.page_of(key).alias("page")))


@query("""WITH a AS (SELECT doc_id % (SELECT count(*) // 2 + 1 FROM documents) AS k, doc_id AS ord, text, 1 AS new FROM documents), r AS (SELECT item_id AS k, item_id AS ord, text, 0 AS new FROM benchmark WHERE trim(text) <> ''),
b AS (SELECT * FROM a UNION ALL SELECT * FROM r), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY new DESC, ord DESC) AS p, max(new) OVER (PARTITION BY k) AS m FROM b),
f AS (SELECT k, min(ord) AS place FROM (SELECT *, max(new) OVER (PARTITION BY k) AS m FROM b) WHERE new = m GROUP BY 1)
SELECT x.k AS doc_id, x.ord, x.text, f.place, x.new = 1 AS added FROM x JOIN f USING (k) WHERE p = 1""")
def merged_corpus(spark, sf_dir):
    """Documents under colliding ids over restored benchmark texts."""
    docs = table(spark, sf_dir, "documents")
    half = docs.agg((F.floor(F.count("*") / 2) + 1).alias("half"))
    added = docs.crossJoin(half).select((F.col("doc_id") % F.col("half")).alias("doc_id"), F.col("doc_id").alias("ord"), "text")
    restored = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("ord"), "text")
    return workbench.merged_corpus(added, restored)


@query(r"""SELECT conv_id, turn, CAST(regexp_extract_all(m, '\[([0-9]+)\]', 1) AS BIGINT[]) AS numbers, CAST(len([p for p in string_split_regex(m, '\n{2,}') if trim(p) <> '']) AS BIGINT) AS paragraphs,
substring(m, 1, 10) AS before, substring(m, 11, 10) AS inside FROM (SELECT conv_id, turn, text || ' [' || CAST(turn AS VARCHAR) || ']' || chr(10) || chr(10) || '[12] ' || role AS m FROM conversations)""")
def marker_numbers(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("]\n\n[12] "), F.col("role"))
    part = workbench.highlight_parts(F.col("m"), F.lit(10), F.lit(20))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("m"))
    return rows.select("conv_id", "turn", F.transform(workbench.markers_in(F.col("m")), lambda x: x.cast("long")).alias("numbers"), F.size(workbench.paragraphs_of(F.col("m"))).cast("long").alias("paragraphs"), part["before"].alias("before"), part["inside"].alias("inside"))


@query("SELECT source, round(quantile_cont(length(text), 0.5), 6) AS median_length, count(*) AS n FROM documents GROUP BY 1")
def median_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.median(F.char_length("text")), 6).alias("median_length"), F.count("*").alias("n"))


@query("""WITH v AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 1 WHEN source = 'src3' THEN 2 END AS view FROM documents) SELECT i.item_id, count(*) FILTER (view = 1) AS own, count(*) FILTER (view = 2) AS other
FROM benchmark i LEFT JOIN (SELECT b.item_id, v.view FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN v USING (doc_id)) x USING (item_id) GROUP BY 1""")
def locate_in_view(spark, sf_dir):
    """Where items stand in a fixture's own documents, and in another that an origin names."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = ruler.located(items, docs, "item_id", "text").select("item_id", "doc_id").distinct().join(docs.select("doc_id", "source"), "doc_id")
    rows = items.select("item_id").join(found, "item_id", "left")
    return rows.groupBy("item_id").agg(F.count_if(F.col("source").isin("src1", "src2")).alias("own"), F.count_if(F.col("source") == "src3").alias("other"))


# ---------------------------------------------------------------- what SQL cannot state


def _fold_sql(start: int, by: int) -> str:
    return f"list_reduce(list_prepend(CAST({start} AS UBIGINT), cs), lambda a, c: (xor(a, c) * {by}) & 4294967295)"


@query(f"""WITH c AS (SELECT doc_id, text, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS UBIGINT)) AS cs FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN printf('%08x%08x', {_fold_sql(0x811C9DC5, 0x01000193)}, {_fold_sql(0x01000193, 0x85EBCA6B)}) END AS content_hash FROM c""")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", exact.content_hash(F.col("text")).alias("content_hash"))


@query()
def vector_codec(spark, sf_dir):
    """Every vector packed to base64 of little-endian floats and back."""
    def run(frames):
        import numpy as np
        import pandas as pd

        from ..sources.providers import pack_vectors, unpack_vectors

        for f in frames:
            packed = [pack_vectors([v]) for v in f["embedding"]]
            same = [np.array_equal(np.asarray(unpack_vectors(p, len(v))[0], "<f4"), v) for p, v in zip(packed, f["embedding"])]
            yield pd.DataFrame({"vec_id": f["vec_id"], "packed": packed, "same": same})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, packed string, same boolean")


@query(r"""WITH h AS (SELECT doc_id, unnest([substring(text, 1, length(text) // 2), substring(text, length(text) // 2 + 1, length(text))]) AS p FROM documents),
f AS (SELECT doc_id AS quote_id, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS piece FROM h) SELECT quote_id, piece, CAST(1 AS BIGINT) AS n_holders FROM f WHERE length(piece) >= 25""")
def quote_pieces(spark, sf_dir):
    """Every document quoted whole, with an elision in its middle, cut into the longest pieces that it holds."""
    docs = table(spark, sf_dir, "documents")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    quote = F.concat(F.substring("text", F.lit(1), half), F.lit(" [...] "), F.substring("text", half + 1, n))
    passages = F.array(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"), "text"))
    rows = analytics.quotes_found(docs.select(F.col("doc_id").alias("quote_id"), quote.alias("quote"), passages.alias("passages")))
    return rows.select("quote_id", "piece", F.size("holders").cast("long").alias("n_holders"))


@query()
def index_search(spark, sf_dir):
    """The index API over whole tables: chunks with exact terms, asked by every item."""
    from ..operators import index

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = index.create_index(table(spark, sf_dir, "documents")).search_lexical(items, max_per_page=2)
    return longs(found.select("query_id", "rank", F.round("score", 6).alias("score"), "chunk_id"))


@query()
def masked_regions(spark, sf_dir):
    return analyze.regions(analyze.analyze(table(spark, sf_dir, "documents"), with_tokens=False))


@query()
def sentences_full(spark, sf_dir):
    return analyze.sentences(analyze.analyze(table(spark, sf_dir, "documents"), with_tokens=False))


@query()
def chunks_full(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return analyze.chunks(analyze.analyze(docs, with_tokens=False)).select("doc_id", "chunk_index", "chunk_id", "ordinal", "start", "end", "content_hash", "text")


@query()
def tokens_full(spark, sf_dir):
    rows = analyze.analyze(table(spark, sf_dir, "documents")).select("doc_id", F.explode("chunks").alias("c"))
    return rows.select("doc_id", "c.ordinal", F.explode("c.tokens").alias("t")).select("doc_id", "ordinal", "t.term", "t.start", "t.end")


def _retrieved(spark, sf_dir) -> DataFrame:
    """Assistant turns with what the search by BM25 finds for them in all documents, best first."""
    docs, turns, mark = table(spark, sf_dir, "documents"), _turns(spark, sf_dir), staging.made()
    found = staging.stage(_found(turns, lexical.indexed(docs, "doc_id")), "found")
    staging.sweep(spark, mark, found)
    found = staging.bounded(found, 64)
    one = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), "text", F.lit(0).alias("start"))
    held = found.select("answer", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id").groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("one")))).alias("held"))
    held = held.select("answer", F.transform("held", lambda h: h["one"]).alias("results"))
    none = F.array().cast(held.schema["results"].dataType)
    return turns.join(held, "answer", "left").select("answer", "text", F.coalesce("results", none).alias("results"))


@query()
def attribution_spans(spark, sf_dir):
    rows = attribution.attribute_answers(_retrieved(spark, sf_dir))
    return rows.select("answer", "lexical", "vetoed", "dense", "unattributed", F.explode_outer("spans").alias("s")).select("answer", "lexical", "vetoed", "dense", "unattributed", "s.*")


@query()
def formatted_answers(spark, sf_dir):
    from ..sources.providers import Deterministic

    rows = attribution.attribute_answers(_retrieved(spark, sf_dir), provider=Deterministic(32), style="bracket")
    return rows.select("answer", "lexical", "dense", "formatted", F.size("formatted_spans").cast("long").alias("n_spans"))


@query()
def markdown_roundtrip(spark, sf_dir):
    def run(frames):
        import pandas as pd

        for f in frames:
            got = [workbench.strip_markdown(t or "") for t in f["text"]]
            yield pd.DataFrame({"conv_id": f["conv_id"], "turn": f["turn"], "stripped": [s for s, _ in got], "restored": [workbench.restore_markdown(s, r) == (t or "") for (s, r), t in zip(got, f["text"])]})

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rows.mapInPandas(run, "conv_id long, turn long, stripped string, restored boolean")
