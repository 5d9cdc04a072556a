"""Incremental indexing: a stream of documents into the index tables, micro-batch by micro-batch.

An extension: attribution itself runs once, over a finished answer. What a batch adds is keyed by
content hash, so passages whose vector is known are not embedded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import segments as S
from ..operators import analyze
from ..sources import corpus, providers


def index_batch(batch: DataFrame, batch_id: int, path: str, tokenizer: S.Tokenizer = S.STEMMED, provider=None) -> None:
    """Writes the chunks, postings and missing vectors of one batch under its own folder, which a repeat
    of the batch overwrites."""
    spark = batch.sparkSession
    docs = batch.dropDuplicates(["doc_id"])
    rows = analyze.analyze(docs, tokenizer=tokenizer).select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.*")
    rows = rows.withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")))
    place = f"batch={batch_id}"
    rows.write.mode("overwrite").parquet(f"{path}/chunks/{place}")
    kept = spark.read.parquet(f"{path}/chunks/{place}")
    posted = kept.select("chunk_id", F.explode("tokens.term").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    posted.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings/{place}")
    if provider is not None:
        todo = kept.select("content_hash", "text").dropDuplicates(["content_hash"])
        known = _table(spark, f"{path}/vectors", batch_id)
        if known is not None:
            todo = corpus.unchanged(todo, known)[1]
        providers.embed_table(todo, provider, "content_hash").write.mode("overwrite").parquet(f"{path}/vectors/{place}")


def _table(spark, path: str, before: int) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).where(F.col("batch") < before)


def index_stream(stream: DataFrame, path: str, checkpoint: str, tokenizer: S.Tokenizer = S.STEMMED, provider=None, **trigger) -> StreamingQuery:
    """Indexes documents (doc_id, text) as they come."""
    writer = stream.writeStream.foreachBatch(lambda b, i: index_batch(b, i, path, tokenizer, provider)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
