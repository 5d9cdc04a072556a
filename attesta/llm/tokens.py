"""Exact length histogram: documents by encoded length, and what it answers for every context limit.

Each text is encoded whole with a byte-level BPE whose ranks come from a file (a parameter). Documents
are counted by length and suffix sums run over the histogram, in blocks of lengths and then over the
sums of blocks. A row for a length L says how many documents and tokens are of that length, how many
are as long or longer, what is left of all texts cut at L, and how far up the ranking L reaches. From
these rows any quantile and the loss at any context limit follow exactly (`truncated_total`,
`length_quantile`).

Null text is left out of the histogram; an empty text has length 0. The driver sends the ranks once,
about a megabyte. Repeated rows each count. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that goes with the ranks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
_ENCODERS: dict[int, object] = {}


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str = PATTERN):
    """An encoder of these ranks; a worker builds it once."""
    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _ENCODERS[key] = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _ENCODERS[key]


def encoded_lengths(docs: DataFrame, ranks: bytes, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and n_tokens, null for null text, of each row."""
    kind = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)

    def encode(batches):
        bpe = encoder(ranks)
        for batch in batches:
            counts = [None if t is None else _length(bpe, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(shared.lean(encode), ", ".join(x for x in (kind, "n_tokens long") if x))


def _length(bpe, text: str) -> int:
    return len(bpe.encode_to_numpy(text, disallowed_special=()))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, tokens, docs_at_least, tokens_at_least, total_cut, docs_below_share) of each
    length that occurs. The counts are staged: two branches read them, and texts are encoded once."""
    rows = shared.stage(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")
    rows = rows.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = sums.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    inside = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(sums, "block")
    docs, tokens = F.col("d") + F.col("d_later"), F.col("t") + F.col("t_later")
    return rows.select(
        "n_tokens", "n_docs", "tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("t_all") - tokens + F.col("n_tokens") * docs).alias("total_cut"),
        ((F.col("d_all") - docs).cast("double") / F.col("d_all").cast("double")).alias("docs_below_share"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left of all documents when each is cut at the limit."""
    row = histogram.select(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))).first()
    return row[0] or 0


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length such that this share of the documents or more are no longer."""
    all_docs = F.col("docs_at_least").cast("double") / (F.lit(1.0) - F.col("docs_below_share"))
    reached = (all_docs - F.col("docs_at_least") + F.col("n_docs")) / all_docs
    return histogram.where(reached >= F.lit(share) - F.lit(1e-12)).agg(F.min("n_tokens")).first()[0]


def op1_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(shared.documents(spark, sf_dir), read_ranks()))
