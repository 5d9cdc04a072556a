"""What the training-data operators share: staged tables, word hashes, group streams, components.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8 text, which is the
same as the runs of ``[^\\x20\\x09-\\x0D]+`` of its code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import spread
from ..sources.staging import BROADCAST_BYTES, bounded, made, shared_dir, shared_path, stage, sweep, unstage  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def give_back() -> None:
    """Has this process's allocator return arrays of eight megabytes or more when they are freed, and free
    memory at the end of the heap. Only Python workers call it: they live on between tasks and would keep
    what the largest needed."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        ctypes.CDLL(None).mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few enough rows for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of which doc_id is not among the ids, in one pass over the texts where the ids are few."""
    return docs.join(bounded(stage(ids.select("doc_id").distinct(), "ids"), 48), "doc_id", "left_anti").select(*docs.columns)


def first_by(rows: DataFrame, key: str, most: int, *then: str) -> DataFrame:
    """The first rows by a uniform 64-bit hash. Of large tables only hashes that can be among them are
    sorted, half as many again as are wanted."""
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.col(key) < F.lit(int(-(1 << 63) + (1 << 64) * 1.5 * most / n)))
    return rows.orderBy(key, *then).limit(most)


# ---------------------------------------------------------------- words


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after the other
    start: np.ndarray  # of each word, into data
    end: np.ndarray
    first: np.ndarray  # number of each text's first word; one more entry at the end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    gap = np.ones(n + 2, bool)  # gap[i + 1]: byte i is white space
    gap[1:-1] = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(~gap[1:] & (gap[:-1] | cut))
    end = np.flatnonzero(~gap[:-1] & (gap[1:] | cut))
    return Words(data, start, end, np.searchsorted(start, offsets))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, mixed. Taken in slices, so memory
    beside the result doesn't grow with the text."""
    data, start, end, _ = words
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    powers = np.cumprod(np.full(int((end - start).max()), _BASE, np.uint64))
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SLICE, "right")))
        a, s = start[at], start[at:to] - start[at]
        piece = data[a : end[to - 1]]
        place = np.arange(len(piece)) - np.repeat(s, np.diff(np.append(s, len(piece))))
        inside = ~_SPACE[piece]
        values = np.where(inside, _BYTE[piece] * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
        out[at:to] = np.add.reduceat(values, s)
        at = to
    return mixed(out)


_ROUNDS = [np.uint64(x) for x in np.random.default_rng(21).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; gram i starts at word i. Grams may straddle texts: the
    caller leaves those out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = out * _ROUNDS[j % 64] + words[j : j + n]
        if j % 8 == 7:
            out = mixed(out)
    return mixed(out)


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with about so many bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_slices(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of a few megabytes of the batch at a time."""
    data, offsets = utf8(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, kind))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal key, of a partition sorted by it; one table for each key."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
        table = pa.Table.from_batches([batch])
        if kept and kept[0].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(kept)
            kept = []
        for a, b in zip(edges, edges[1:]):
            kept.append(table.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_tables(kept)
                kept = []
    if kept:
        yield pa.concat_tables(kept)


def lean(work):
    """The same function of batches; when it ends, what the worker has free goes back to the system. Idle
    workers wait beside the tasks of later stages."""

    def run(batches):
        give_back()
        yield from work(batches)
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


# ---------------------------------------------------------------- sums of fixed-size vectors


def summed_vector(parts: DataFrame, size: int, piece: int = 1 << 14) -> np.ndarray:
    """Adds up vectors of a fixed size that tasks gave as (piece int, counts binary) rows, counts
    being int64 of one piece. Tasks add whole streams; the driver gets `size` numbers."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(raw, np.int64)
                total[p] = total[p] + x if p in total else x
        if total:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    schema = "piece int, counts binary"
    first = parts.withColumn("salt", F.spark_partition_id() % 32).repartition("piece", "salt").drop("salt")
    sums = first.mapInArrow(add, schema).repartition("piece").mapInArrow(add, schema)
    out = np.zeros(size, np.int64)
    for row in sums.collect():  # size / piece rows, whatever the input
        x = np.frombuffer(row["counts"], np.int64)
        out[row["piece"] * piece : row["piece"] * piece + len(x)] += x
    return out


def vector_rows(vector: np.ndarray, piece: int = 1 << 14) -> pa.RecordBatch:
    n = -(-len(vector) // piece)
    parts = [vector[i * piece : (i + 1) * piece].astype(np.int64) for i in range(n)]
    filled = [i for i in range(n) if parts[i].any()]
    return pa.RecordBatch.from_pydict({"piece": pa.array(filled, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in filled], pa.binary())})


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each end of an edge (a, b) the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars.
    Each step aggregates before it shuffles, so a node of very many edges needs no task of its own.
    """
    old = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = old.select("a", "b").union(old.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = stage(small.where("a <> b").distinct(), "edges")
        unstage(old)
        unstage(large)
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        old = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return old.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        old.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
