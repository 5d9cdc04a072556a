"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of the vectors gives the pivots, spread by farthest-point choice; there are more of
them the more vectors there are, up to MOST_PIVOTS, so that the mean length of a list stays. Each vector
is described by its `prefix` nearest pivots in order (permutation index; Amato and Savino, 2008). An
inverted list is kept for each label and pair of pivots, so all that meet in one share two; vectors
link where they share `least` pivots or more and verify by cosine in double precision, so no reported
link is wrong. A pair that meets in several lists counts in the first.

All vectors are indexed; lengths other than the commonest, of at most BLOCK classes, are compared whole,
without pivots. Equal vectors of one label are one class and are compared once. Long lists
are cut into blocks, and each pair of blocks is a unit of bounded size; tasks give link counts and a
spanning forest of each unit, never its pairs.

Vectors that are null, zero or hold null or non-finite components, and rows of null label, link with
nothing. Vectors of different lengths link with nothing. Repeated rows are vectors of their own that
link with each other; rows of null vec_id are counted but their component is null when they reach no
other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

COSINE, LEAST = 0.93, 2
SAMPLE, BLOCK = 4096, 384
#: Mean length of a list, over all labels, for which the number of pivots is chosen, and its bounds.
LENGTH, PIVOTS, MOST_PIVOTS = 32, 64, 2048


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    return sample[chosen]


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one width, scaled to length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable() -> Column:
    """Whether a row can link with others at all."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & whole & F.exists("embedding", lambda x: x != 0), F.lit(False))


def met(vectors: np.ndarray, nearest, key: int, block: np.ndarray, apart: bool, pivots: int, least: int, cosine: float):
    """Pairs (i, j) of a unit that verify, share enough pivots, and of which this is the first common list;
    nearest(vectors) gives their pivots, which only those that are close need."""
    close = np.triu(vectors @ vectors.T >= cosine - 1e-6, 1)
    if apart:
        close &= block[:, None] != block[None, :]
    i, j = np.nonzero(close)
    if not len(i):
        return i, j
    some = np.unique(np.concatenate([i, j]))
    few, mine = np.sort(nearest(vectors[some]), 1), np.zeros(len(i), bool)
    near = np.zeros((len(vectors), few.shape[1]), few.dtype)
    near[some] = few
    for a in range(0, len(i), 1 << 16):
        p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        common = (near[p][:, :, None] == near[q][:, None, :]).any(2)  # of the pivots of p, in order of their numbers
        ok = ((vectors[p] * vectors[q]).sum(1) >= cosine) & (common.sum(1) >= least)
        if near.shape[1] > 1:  # the first common list is that of the two smallest common pivots
            row, first = np.arange(len(p)), common.argmax(1)
            common[row, first] = False
            ok &= near[p][row, first] * pivots + near[p][row, common.argmax(1)] == key
        mine[a : a + (1 << 16)] = ok
    return i[mine], j[mine]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def pivots_for(n: int) -> tuple[int, int]:
    """(number of pivots, how many of the nearest describe a vector) for so many vectors: among more pivots
    the nearest change places more easily, so one more is kept."""
    pivots = PIVOTS
    while pivots < MOST_PIVOTS and n * 30 > LENGTH * pivots * pivots:  # 15 of pivots ** 2 / 2 lists for each vector
        pivots *= 2
    return pivots, 5 if pivots == PIVOTS else 6


def near_duplicates(rows: DataFrame, cosine: float = COSINE, pivots: int | None = None, prefix: int | None = None, least: int = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    fine = rows.where(usable()).select("vec_id", "label", "embedding")
    classes = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
    classes = shared.stage(classes.withColumn("class", F.xxhash64("label", "embedding")), "classes")
    width = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    counts = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    sizes = {r["d"]: r["n"] for r in counts.where((F.col("n") > BLOCK) | (F.col("d") == width["d"])).collect()} if width else {}
    parts = [_all_links(classes.where(~F.size("embedding").isin(list(sizes))).withColumn("d", F.size("embedding")), cosine)] if sizes else []
    for d, n in sizes.items():  # one size but in odd data
        some = classes.where(F.size("embedding") == d)
        sample = shared.first_by(some, "class", SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
        best, near = pivots_for(n)
        chosen = spread(unit_rows(sample), pivots or best)
        parts.append(_links(some, chosen, cosine, min(prefix or near, len(chosen)), least))
    found = None
    for p in parts:
        found = p if found is None else found.union(p)
    if found is None:
        found = spark.createDataFrame([], "class long, links long, root long")
    found = shared.stage(found, "links")
    together = shared.components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.select("class", "class_id", "n").join(degree, "class", "left").join(together.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(lowest, "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # the vectors themselves stay where they are: rows and classes meet by the hash
    good = fine.select(F.col("vec_id"), F.xxhash64("label", "embedding").alias("class")).join(named, "class").select("vec_id", "n_links", "component_id")
    odd = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(odd).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _all_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(class, links, root) of every pair of one label and length d, of which there are at most BLOCK."""

    def verify(batches):
        for unit in shared.runs(batches, "unit"):
            at: dict[tuple, list[int]] = {}
            for r, x in enumerate(zip(unit.column("label").to_pylist(), unit.column("d").to_pylist())):
                at.setdefault(x, []).append(r)
            for rows in at.values():  # one, unless hashes of units collide
                part = unit.take(rows)
                vectors = unit_rows(part.column("embedding").combine_chunks())
                p, q = np.nonzero(np.triu(vectors @ vectors.T >= cosine, 1))
                if not len(p):
                    continue
                ids, n = part.column("class").to_numpy(), part.column("n").to_numpy()
                links = np.bincount(p, n[q], len(ids)) + np.bincount(q, n[p], len(ids))
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[forest(len(ids), p, q)][some])], ["class", "links", "root"])

    sent = classes.select(F.xxhash64("label", "d").alias("unit"), "class", "label", "n", "d", "embedding")
    return sent.repartition("unit").sortWithinPartitions("unit").mapInArrow(shared.lean(verify), "class long, links long, root long")


def _links(classes: DataFrame, chosen: np.ndarray, cosine: float, prefix: int, least: int) -> DataFrame:
    """(class, links, root): for units that hold links, the number of vectors that each class links to
    and a class that it reaches."""
    if prefix < least or len(chosen) < 2:
        prefix = least = min(len(chosen), 2) or 1
    pivots = len(chosen)
    pairs = list(itertools.combinations(range(prefix), 2)) or [(0, 0)]

    def nearest(vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-(vectors @ chosen.T), axis=1, kind="stable")[:, :prefix]

    def describe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = nearest(unit_rows(batch.column("embedding")))
            keys = [np.minimum(near[:, a], near[:, b]) * pivots + np.maximum(near[:, a], near[:, b]) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("label"), shared.lists(list(np.stack(keys, 1).astype(np.int64)), pa.int64())], ["class", "label", "keys"])

    # lists and units are told by narrow rows; each vector then goes to its units once
    told = classes.select("class", "label", "embedding").mapInArrow(shared.lean(describe), f"class long, label {dict(classes.dtypes)['label']}, keys array<long>")
    told = shared.stage(told.select("class", "label", F.explode("keys").alias("key")), "keys")
    sizes = told.groupBy("label", "key").agg(F.count("*").alias("size")).where("size > 1")
    cut = told.join(sizes, ["label", "key"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    cut = cut.select("class", F.struct(F.xxhash64("label", "key", i, j).alias("unit"), "key", "block", (i != j).alias("apart")).alias("u"))
    units = cut.groupBy("class").agg(F.collect_list("u").alias("units"))
    sent = classes.select("class", "label", "n", "embedding").join(units, "class").select("class", "label", "n", "embedding", F.explode("units").alias("u"))
    sent = sent.select("u.*", "class", "label", "n", "embedding")

    def verify(batches):
        for unit in shared.runs(batches, "unit"):
            told = list(zip(unit.column("label").to_pylist(), unit.column("key").to_pylist()))
            seen = set(told)
            for label, key in seen:  # one, unless hashes of units collide
                part = unit if len(seen) == 1 else unit.take([r for r, x in enumerate(told) if x == (label, key)])
                vectors = unit_rows(part.column("embedding").combine_chunks())
                p, q = met(vectors, nearest, key, part.column("block").to_numpy(), part.column("apart")[0].as_py(), pivots, least, cosine)
                if not len(p):
                    continue
                ids, n = part.column("class").to_numpy(), part.column("n").to_numpy()
                links = np.bincount(p, n[q], len(ids)) + np.bincount(q, n[p], len(ids))
                root = forest(len(ids), p, q)
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root][some])], ["class", "links", "root"])

    return sent.repartition("unit").sortWithinPartitions("unit").mapInArrow(shared.lean(verify), "class long, links long, root long")


def op10_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= CAST('0.93' AS DOUBLE)),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) d USING (vec_id)
"""
