"""Where documents and recordings come from, and where an index is kept."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from . import providers

PAGE = T.StructType([T.StructField("data", T.StringType()), T.StructField("mime_type", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.StringType(), False), T.StructField("text", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("page", PAGE)])

#: Recorded answers, as one JSON file each.
RECORDING = (
    "id string, model string, recordedAt string, reportVersion string, storeEmbeddingModel string,"
    "storeChunking struct<maxTokensPerChunk:int,maxOverlapTokens:int>, parts array<struct<text:string>>,"
    "usageMetadata struct<toolUsePromptTokenCount:int,tool_use_prompt_token_count:int>,"
    "groundingMetadata struct<groundingChunks:array<struct<retrievedContext:struct<text:string,title:string,fileSearchStore:string,customMetadata:array<struct<key:string,stringValue:string>>>>>,"
    "groundingSupports:array<struct<segment:struct<partIndex:int,startIndex:int,endIndex:int,text:string>,groundingChunkIndices:array<int>,confidenceScores:array<double>>>>"
)
LABEL = "id string, parts array<struct<text:string>>, segments array<struct<partIndex:int,textSpan:struct<start:int,end:int>,sourceSpans:array<struct<documentId:string,span:struct<start:int,end:int>>>>>, labeledBy string, labeledAt string"


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than there are cores, dealt over all of them: a small file is one
    row group, which one core would read and work on alone. Large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of every .txt of a folder, the id being the name without its ending."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))


def recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDING).option("multiLine", True).json(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).option("multiLine", True).json(path)


def supports(recorded: DataFrame) -> DataFrame:
    """A row for each support, with the text of the part that it marks; what is absent is 0 or null."""
    rows = recorded.select("id", "parts", F.col("groundingMetadata.groundingChunks").alias("chunks"), F.posexplode("groundingMetadata.groundingSupports").alias("support", "s"))
    part = F.coalesce("s.segment.partIndex", F.lit(0))
    return rows.select(
        "id", "support", part.alias("part"), F.get("parts", part)["text"].alias("part_text"), F.coalesce("s.segment.startIndex", F.lit(0)).alias("start_byte"),
        F.col("s.segment.endIndex").alias("end_byte"), F.col("s.segment.text").alias("segment_text"),
        F.coalesce("s.groundingChunkIndices", F.array().cast("array<int>")).alias("indices"), "chunks",
    )


def report_sink(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


# ---------------------------------------------------------------- the index as tables

TABLES = ("chunks", "postings", "vectors")


def save_index(path: str, chunks: DataFrame, postings: DataFrame, average: float, tokenizer_id: str, vectors: DataFrame | None = None, provider_id: str | None = None, dimensions: int | None = None, k1: float = K.BM25_K1, b: float = K.BM25_B) -> None:
    """Postings are sorted by term within files, so a query reads few row groups."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    postings.repartition("term").sortWithinPartitions("term", "chunk_index").write.mode("overwrite").parquet(f"{path}/postings")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = {
        "format_version": K.INDEX_FORMAT_VERSION, "tokenizer_id": tokenizer_id, "chunker_policy": K.CHUNKER_POLICY, "k1": k1, "b": b,
        "average_length": float(average), "dense": None if vectors is None else {"provider_id": provider_id, "dimensions": dimensions},
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str, tokenizer_id: str, provider=None) -> dict:
    """The tables and `dense`: ready, needs-provider or absent. Refuses what does not hold together."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["format_version"] != K.INDEX_FORMAT_VERSION:
        raise ValueError(f"index of format {meta['format_version']}, not {K.INDEX_FORMAT_VERSION}")
    if meta["tokenizer_id"] != tokenizer_id:
        raise ValueError(f"index made with {meta['tokenizer_id']}, asked with {tokenizer_id}")
    chunks, postings = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings")
    refuse_postings(postings, chunks)
    lengths = postings.groupBy("chunk_index").agg(F.sum("tf").alias("length"))
    vectors = None
    if meta["dense"] is not None:
        vectors = spark.read.parquet(f"{path}/vectors")
        refuse_vectors(vectors, chunks, meta["dense"], provider)
    state = "absent" if vectors is None else "ready" if provider is not None else "needs-provider"
    return {"meta": meta, "chunks": chunks, "postings": postings, "lengths": lengths, "vectors": vectors, "dense": state}


def refuse_postings(postings: DataFrame, chunks: DataFrame) -> None:
    bad, lost = postings.agg(F.count_if(F.coalesce(F.col("tf") <= 0, F.lit(True)))).first()[0], postings.join(chunks.select("chunk_index"), "chunk_index", "left_anti").limit(1).count()
    if bad:
        raise ValueError(f"{bad} postings without a positive count")
    if lost:
        raise ValueError("postings of a chunk that is not there")


def refuse_vectors(vectors: DataFrame, chunks: DataFrame, dense: dict, provider=None) -> None:
    if not isinstance(dense.get("dimensions"), int) or not dense.get("provider_id"):
        raise ValueError("malformed dense section")
    if provider is not None and (provider.id != dense["provider_id"] or provider.dimensions != dense["dimensions"]):
        raise ValueError(f"vectors of {dense['provider_id']}, asked with {provider.id}")
    n, odd = vectors.agg(F.count("*"), F.count_if(F.size("embedding") != dense["dimensions"])).first()
    if odd:
        raise ValueError(f"{odd} vectors that are not {dense['dimensions']} wide")
    if n != chunks.count():
        raise ValueError(f"{n} vectors for {chunks.count()} chunks")


def export_json(index: dict) -> str:
    """The interchange document; the driver holds it whole, so it is for indexes of that size."""
    meta, chunks = index["meta"], [r.asDict(True) for r in index["chunks"].orderBy("chunk_index").collect()]
    postings: dict[str, list] = {}
    for r in index["postings"].orderBy("term", "chunk_index").collect():
        postings.setdefault(r["term"], []).append([r["chunk_index"], r["tf"]])
    dense = None
    if index["vectors"] is not None:
        rows = [r[0] for r in index["vectors"].orderBy("chunk_index").select("embedding").collect()]
        dense = {"providerId": meta["dense"]["provider_id"], "dimensions": meta["dense"]["dimensions"], "vectors": providers.pack_vectors(rows)}
    bm25 = {"k1": meta["k1"], "b": meta["b"], "averageLength": meta["average_length"]}
    return json.dumps({"formatVersion": meta["format_version"], "tokenizerId": meta["tokenizer_id"], "chunkerPolicy": meta["chunker_policy"], "bm25": bm25, "chunks": chunks, "postings": postings, "dense": dense}, ensure_ascii=False)


def import_json(spark: SparkSession, document: str) -> dict:
    """Tables from the interchange document."""
    a = json.loads(document)
    chunks = spark.read.json(spark.sparkContext.parallelize([json.dumps(c) for c in a["chunks"]])) if a["chunks"] else spark.createDataFrame([], "chunk_index long")
    postings = spark.createDataFrame([(t, int(c), int(n)) for t, ps in a["postings"].items() for c, n in ps], "term string, chunk_index long, tf long")
    vectors = None
    if a["dense"] is not None:
        rows = providers.unpack_vectors(a["dense"]["vectors"], a["dense"]["dimensions"])
        vectors = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "chunk_index long, embedding array<float>")
    refuse_postings(postings, chunks)
    return {"average_length": a["bm25"]["averageLength"], "tokenizer_id": a["tokenizerId"], "chunks": chunks, "postings": postings, "vectors": vectors}


def unchanged(chunks: DataFrame, known: DataFrame, by: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Chunks whose vector is known by their content, and those to embed."""
    keys = known.select(by).distinct()
    return chunks.join(keys, by, "left_semi"), chunks.join(keys, by, "left_anti")


def on_state(listener: Callable[[dict], None] | None, **event) -> None:
    if listener is not None:
        listener(event)
