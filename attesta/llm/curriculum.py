"""Mixing sources to target weights along a time-varying curriculum.

Sources in code-point order, null last, take the weights in turn. A source's target is its weight's
share of all words, at most `most` times its own; the excess goes to the others by weight. Within a
source documents stand in the order of md5(doc_id), one after the other on an axis of words; the mix
takes the first `target` words of that axis repeated, so at most one copy in each source is partial.

A schedule says how a source's weight moves over training time 0 to 1: straight lines between knots.
Its integral is the cumulative demand for that source's words, and the inverse of that integral at
the middle of a copy is the copy's position. `training_order` sorts copies by position over ranges.

Sums run in two levels, by source and bucket of the hash and then within a bucket, so a source that
holds most rows is dealt over many tasks; rows of null doc_id have a bucket for each size. Words are
counted once, into a staged table. What one task reads whole is a row for each source.

Null text has size 0 and is never taken; nor is any document of size 0. Null doc_id stands last in
its source, by size. Repeated rows and rows of null doc_id each count, and each is taken by itself. Rows
of one doc_id, source and size are interchangeable. An empty table gives no rows. Extra columns are
ignored; `mixed_documents` returns them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

WEIGHTS, MOST = (5, 2, 1), 3
#: (time, weight) knots, in turn for sources in order: even, rising, falling, late bloom.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))


def in_turn(values: tuple, rank: Column) -> Column:
    at = F.pmod(rank - 1, F.lit(len(values)))
    out = F.when(at == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(at == i, v)
    return out


def time_of(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral reaches this share of its whole."""
    pieces = [(t, g, u - t, (h - g) / (u - t)) for (t, g), (u, h) in zip(schedule, schedule[1:])]
    areas = [width * (g + slope * width / 2) for _, g, width, slope in pieces]
    total, out, before = math.fsum(areas), None, 0.0
    for i, ((t, g, width, slope), area) in enumerate(zip(pieces, areas)):
        rest = share * F.lit(total) - F.lit(before)
        here = F.lit(t) + F.lit(2.0) * rest / (F.lit(g) + F.sqrt(F.greatest(F.lit(0.0), F.lit(g * g) + F.lit(2.0 * slope) * rest)))
        before += area
        if i < len(pieces) - 1:
            inside = share * F.lit(total) < F.lit(before)
            out = F.when(inside, here) if out is None else out.when(inside, here)
        else:
            out = here if out is None else out.otherwise(here)
    return out


def source_targets(sized: DataFrame, weights: tuple, most: int) -> DataFrame:
    """(source, source_size, rank, target): weights water-filled under the caps; one row a source."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    rows = rows.withColumn("weight", in_turn(tuple(F.lit(int(w)).cast("long") for w in weights), F.col("rank")))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    ratio = F.col("cap").cast("double") / F.col("weight").cast("double")
    by_ratio = W.orderBy(ratio, "rank")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / F.sum("weight").over(after).cast("double"))
    level = F.max(F.when(ratio >= F.col("level"), F.col("level"))).over(all_rows)
    target = F.least(F.col("cap").cast("double"), level * F.col("weight").cast("double"))
    return rows.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, schedules: tuple = SCHEDULES, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies array<struct<position, words>>) of each
    row; copies are what the mix takes of it, first to last. `row` names a column that tells rows apart
    and comes along as `row`."""
    n_words = F.coalesce(F.regexp_count("text", F.lit(shared.WORD)).cast("long"), F.lit(0).cast("long"))
    own = [F.col(row).alias("row")] if row else []
    sized = docs.select("doc_id", "source", n_words.alias("size"), *own).withColumn("key", F.md5(F.col("doc_id").cast("string")))
    sized = sized.withColumn("bucket", F.coalesce(F.substring("key", 1, 3), F.concat(F.lit("~"), F.lpad(F.col("size").cast("string"), 19, "0"))))
    sized = shared.stage(sized, "sized")
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    sums = sums.alias("l").join(source_targets(sized, weights, most).alias("r"), same).select("l.*", "r.source_size", "r.rank", "r.target")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *(["row"] if row else [])).rowsBetween(W.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.alias("l").join(shared.bounded(shared.stage(sums, "sums"), 512).alias("r"), same & (F.col("l.bucket") == F.col("r.bucket")))
    rows = rows.select("l.*", (F.col("inside") + F.col("offset")).alias("at"), "r.source_size", "r.rank", "r.target")
    demand = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    rows = rows.withColumn("demand", demand)
    copies = []
    for turn in range(most):
        start = F.col("at") + F.lit(turn) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("demand") - start))
        middle = (start.cast("double") + words.cast("double") / F.lit(2.0)) / F.col("demand").cast("double")
        position = F.round(in_turn(tuple(time_of(middle, s) for s in schedules), F.col("rank")), 9)
        copies.append(F.struct(F.when(words > 0, position).alias("position"), words.alias("words")))
    rows = rows.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", *(["row"] if row else []))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, sorted by position over ranges of it."""
    rows = mixed.select("*", F.explode("copies").alias("copy")).drop("copies")
    rows = rows.select("*", "copy.position", "copy.words").drop("copy")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def by_first_position(mixed: DataFrame) -> DataFrame:
    """The documents in order of their first copies; those not taken come last, by doc_id."""
    rows = mixed.withColumn("position", F.get("copies", F.lit(0))["position"])
    key = (F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())
    return rows.repartitionByRange(*key).sortWithinPartitions(*key)


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_first_position(mix(shared.documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with how much of each and where, in order of position. Columns of
    the mix replace those of the same names. Rows are told apart by a number that is written with them,
    so repeated rows and rows of null doc_id each meet what is taken of them."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = shared.stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plan = mix(numbered, row=row).where("taken > 0").select(F.col("row").alias(row), "size", "source_size", "target", "taken", "copies")
    own = [c for c in docs.columns if c not in plan.columns and c != "position"]
    return by_first_position(numbered.select(row, *own).join(shared.bounded(shared.stage(plan, "plan"), 256), row).drop(row))


def _time_sql(share: str, schedule: tuple) -> str:
    pieces = [(t, g, u - t, (h - g) / (u - t)) for (t, g), (u, h) in zip(schedule, schedule[1:])]
    areas = [width * (g + slope * width / 2) for _, g, width, slope in pieces]
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    total, before, cases = math.fsum(areas), 0.0, ""
    for i, ((t, g, _, slope), area) in enumerate(zip(pieces, areas)):
        rest = f"({share} * {d(total)} - {d(before)})"
        here = f"{d(t)} + {d(2.0)} * {rest} / ({d(g)} + sqrt(greatest({d(0.0)}, {d(g * g)} + {d(2.0 * slope)} * {rest})))"
        before += area
        cases += f"WHEN {share} * {d(total)} < {d(before)} THEN {here} " if i < len(pieces) - 1 else f"ELSE {here}"
    return f"CASE {cases} END" if len(pieces) > 1 else here


_TIMES = " ".join(f"WHEN {i} THEN {_time_sql('middle', s)}" for i, s in enumerate(SCHEDULES))
OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s1),
s3 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s2),
s4 AS (SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM s3),
s5 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s4),
s6 AS (SELECT source, source_size, rank, least(CAST(cap AS DOUBLE), max(CASE WHEN ratio >= level THEN level END) OVER () * CAST(weight AS DOUBLE)) AS target FROM s5),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.rank, s.target, CAST(floor(s.target + CAST('0.5' AS DOUBLE)) AS BIGINT) AS demand,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key NULLS LAST, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM sized d JOIN s6 s ON d.source IS NOT DISTINCT FROM s.source),
taken AS (
  SELECT *, greatest(0, least(size, demand - begins)) AS w1, greatest(0, least(size, demand - begins - source_size)) AS w2,
         greatest(0, least(size, demand - begins - 2 * source_size)) AS w3,
         (CAST(begins AS DOUBLE) + CAST(greatest(0, least(size, demand - begins)) AS DOUBLE) / CAST('2.0' AS DOUBLE)) / CAST(demand AS DOUBLE) AS middle FROM placed)
SELECT doc_id, size, source_size, target, CAST(w1 + w2 + w3 AS BIGINT) AS taken,
       CASE WHEN w1 > 0 THEN round(CASE (rank - 1) % {len(SCHEDULES)} {_TIMES} END, 9) END AS position
FROM taken
"""
