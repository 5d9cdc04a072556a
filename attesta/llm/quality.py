"""Quality by importance resampling (DSIR; Xie et al., 2023).

Two bag-of-n-grams models over the same hash buckets are fitted: of target text, the labelled rows of
good quality, and of raw text, every document. A document's log weight is the sum over its n-grams of
the log ratio of the models. Documents are drawn without replacement in proportion to their weights by
Gumbel top-k: each adds Gumbel noise, drawn from a hash of its doc_id, and the k greatest stay.

k is how many documents the models call target rather than not: those whose log weight is above the
cut that separates other labelled good texts from bad ones best. Weights are sums over whole texts, so
they differ by far more than the noise except near the cut.

Tokens are runs of letters and digits, lower-cased, and runs of other marks, as in DSIR; n-grams are
single tokens and pairs. A pair of equal tokens counts as one kind of pair whatever the token.

At most LABELLED labelled rows, first by a hash of doc_id, fit the target model and the cut. The raw
model counts every n-gram of every document. Null or empty text has log weight 0. Without labels of
both kinds nothing can be told apart and every document stays. Ties at the k-th all stay; repeated
rows draw the same noise and are kept or dropped together. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 1 << 14
LABELLED = 50_000
SMOOTH, GOOD_COUNTS = 40.0, 4.0
_KIND: list[np.ndarray] = []
_REPEAT = np.uint64(0x51ED270B)


def token_kinds() -> np.ndarray:
    """Of each byte of UTF-8 text: 0 white space, 1 letters, digits and all that is not ASCII, 2 marks."""
    if not _KIND:
        kind = np.full(256, 2, np.uint8)
        kind[128:] = 1
        for i in range(128):
            if chr(i).isalnum() or chr(i) == "_":
                kind[i] = 1
            elif chr(i).isspace() or i < 32:
                kind[i] = 0
        _KIND.append(kind)
    return _KIND[0]


def gram_buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of all n-grams, row of each counted from the first) by slices."""
    data, offsets = shared.utf8(batch.column("text"))
    for a, b in shared.slices(offsets):
        raw, at = shared._LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        if not len(raw):
            yield a, b, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        kind = token_kinds()[raw]
        edge = np.append(True, kind[1:] != kind[:-1])
        edge[at[at < len(raw)]] = True
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(raw))
        words = kind[begin] > 0
        begin, end = begin[words], end[words]
        first = np.searchsorted(begin, at)
        each = shared.word_hashes(shared.Words(np.where(kind == 0, 32, raw).astype(np.uint8), begin, end, first)) if len(begin) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(b - a), np.diff(first))
        pair = np.where(each[1:] == each[:-1], _REPEAT, shared.mixed(each[:-1] * np.uint64(3) + each[1:]))
        inside = row[1:] == row[:-1]
        grams = np.concatenate([each, pair[inside]])
        yield a, b, (shared.mixed(grams) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][inside]])


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, good, fits) of at most so many labelled rows, the first by a hash of doc_id; a doc_id with
    several labels is good if all are. Half of them fit the target model, the others set the cut."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    first = shared.first_by(rows.withColumn("hash", F.xxhash64("doc_id")), "hash", most, "doc_id").drop("hash")
    return first.withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)


class Models:
    """Log ratios of the buckets, and the cut on log weights; None where nothing can be told apart."""

    def __init__(self, ratio: np.ndarray | None, cut: float):
        self.ratio, self.cut = ratio, cut


def summed(batch: pa.RecordBatch, ratio: np.ndarray) -> np.ndarray:
    out = np.zeros(batch.num_rows)
    for a, b, buckets, row in gram_buckets(batch):
        if len(buckets):
            out[a:b] = np.bincount(row, ratio[buckets], minlength=b - a)
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Models:
    sample = shared.stage(labelled_sample(labels, most), "labelled")  # its size is bounded by `most`
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "good", "fits")

    def count(batches):
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            good = np.array([bool(g and f) for g, f in zip(batch.column("good").to_pylist(), batch.column("fits").to_pylist())])
            for a, b, buckets, row in gram_buckets(batch):
                total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(buckets[good[a:b][row]], minlength=BUCKETS)
        yield shared.vector_rows(total)

    total = shared.summed_vector(marked.mapInArrow(shared.lean(count), "piece int, counts binary"), 2 * BUCKETS)
    raw, target = total[:BUCKETS].astype(np.float64), total[BUCKETS:].astype(np.float64)
    if not target.any():
        return Models(None, -math.inf)
    # both models are smoothed at the size of the target's sample, so buckets seen seldom say little
    ratio = np.log(target + SMOOTH) - np.log(raw * (target.sum() / raw.sum()) + SMOOTH)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(summed(batch, ratio))], ["good", "weight"])

    rows = marked.where("not fits").mapInArrow(shared.lean(score), "good boolean, weight double").collect()  # at most `most`, and repeated rows
    weight, good = np.array([r["weight"] for r in rows]), np.array([r["good"] for r in rows], bool)
    if good.all() or not good.any():
        return Models(None, -math.inf)
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    # to lose a share of the good texts is worse than to keep that share of the bad
    loss = GOOD_COUNTS * np.append(0, np.cumsum(good)) / good.sum() + 1 - np.append(0, np.cumsum(~good)) / (~good).sum()
    at = int(loss.argmin())
    low = weight[at - 1] if at else weight[0] - 1
    high = weight[at] if at < len(weight) else weight[-1] + 1
    return Models(ratio, float((low + high) / 2))


def weighed(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, log_weight) of each row."""
    ratio = models.ratio if models.ratio is not None else np.zeros(BUCKETS)

    def weigh(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(summed(batch, ratio))], ["doc_id", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(shared.lean(weigh), "doc_id long, log_weight double")


def gumbel(seed: int = 9) -> Column:
    """Standard Gumbel noise from a hash of doc_id."""
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def kth_greatest(rows: DataFrame, column: str, k: int, width: int = 4096) -> float:
    """Exactly the k-th greatest value. Each pass counts by `width` ranges of the interval that holds
    it, so the driver gets that many counts however many rows there are."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    rest = k
    while low < high:
        step = (high - low) / width
        if not low + step > low:
            break
        bin_of = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(width - 1))
        inside = rows.where(F.col(column).between(low, high))
        found = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if rest <= r["n"]:
                low, high = r["low"], r["high"]
                break
            rest -= r["n"]
    return low


def resampled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) of each row."""
    shared.small_batches(docs.sparkSession)
    models = fit(docs, labels, most)
    rows = shared.stage(weighed(docs, models).withColumn("gumbel_key", F.col("log_weight") + F.coalesce(gumbel(), F.lit(0.0))), "weights")
    k = rows.where(F.col("log_weight") > models.cut).count() if models.ratio is not None else 0
    if models.ratio is None:
        return rows.withColumn("kept", F.lit(True))
    if k == 0:
        return rows.withColumn("kept", F.lit(False))
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(kth_greatest(rows, "gumbel_key", k)))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that importance resampling keeps; a doc_id with several texts goes only with all."""
    rows = resampled(docs, labels).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return shared.without(docs, rows.where("not kept"))
