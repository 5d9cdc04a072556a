"""Licence scan: a trained paragraph classifier, confirmed by templates, in DataFrame functions only.

A paragraph is a run of lines that hold a word; what marks comments is no word. A notice is a run of
lines of one paragraph whose inner lines have fewer words than the longest template: one line, or one
wrapped over several. A softmax regression over sparse word n-grams of one to three words gives each
run a family or `unknown`, a class of its own. The family stands if its probability is `least` or more
and the run holds `overlap` of the two-word grams of one of the family's templates. Of notices of one
family that overlap the most similar is a row, then the shorter, then the earlier. A paragraph with
words of a template in which no notice is confirmed is a row of family unknown.

Every run of every paragraph is covered, but only those that can be confirmed are looked at: a text
that holds `overlap` of a template has one of certain grams of it, so many that no more may be missing.
Equal runs are classified once.

The classifier is trained on the driver: from the templates, changed at random (words dropped, other
words around), from the negatives below, and from a sample of at most LABELLED lines of the corpus,
labelled by how much of a template they hold: nearly all of one is its family, little of all is
unknown. A temperature fitted on held-out examples calibrates its probabilities.

Null and empty texts have no paragraphs. Rows of null doc_id keep their null. Repeated rows each count.
A notice repeated in a document is a row each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from typing import NamedTuple

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST, OVERLAP, UNKNOWN = 0.6, 0.6, "unknown"
#: Lines of the corpus that the classifier is fitted on, documents that they come from, and characters of a line.
LABELLED, SOURCES, LINE = 2000, 1000, 1000
#: Shares of a template from which a sampled line is of its family, and up to which it is of none.
SURE, FAR = 0.9, 0.3
#: Notices by which well-known licences are declared.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "Released under CC0 1.0 Universal, dedicated to the public domain",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "All rights reserved",
        "Copyright (c) the authors. All rights reserved",
    ),
}
#: Sentences with words of licence language that declare none.
NEGATIVES = (
    "He renewed his driving licence last week", "The licence fee for the station rose", "She has a licence to sell wine",
    "The public library is free of charge", "A general public meeting was held", "Permission to enter was granted to any person",
    "The version of the story was under dispute", "The work was released under pressure", "This work is subject to review",
    "Use of the software is described in the documentation", "the terms of the agreement were published", "copyright law is complex",
    "The warranty of the car is void", "Commons and lords met in parliament", "binary forms of words are with or without an ending",
    "The licence plate was read by the camera", "the Apache helicopter landed", "a Creative director at MIT spoke", "redistribution of land",
)
_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return [w for w in regex.split(_WORD, text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def pairs_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)} or set(words)


@functools.cache
def template_pairs() -> list[tuple[str, set[str]]]:
    return [(family, pairs_of(words_of(t))) for family, ts in TEMPLATES.items() for t in ts]


LONGEST = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)


# ---------------------------------------------------------------- the classifier


class Model(NamedTuple):
    """The temperature is taken into weights and biases."""

    classes: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray

    def shares(self, grams: set[str]) -> np.ndarray:
        """The probability of each class."""
        z = self.bias + sum((self.weights[g] for g in sorted(grams) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def weak_label(words: list[str]) -> str | None:
    """The family of which a line holds nearly a whole template, unknown if it holds little of any."""
    pairs = {" ".join(words[i : i + 2]) for i in range(len(words) - 1)} | set(words)
    share, family = max((len(p & pairs) / len(p), f) for f, p in template_pairs())
    return family if share >= SURE else UNKNOWN if share <= FAR else None


@functools.lru_cache(4)
def model(lines: tuple[str, ...] = ()) -> Model:
    """Fitted on the templates, the negatives and these lines."""
    rng = np.random.default_rng(7)
    classes = [*TEMPLATES, UNKNOWN]
    filler = sorted({w for t in NEGATIVES for w in words_of(t)}) + [f"w{i}" for i in range(200)]
    plain = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    some = lambda n, pool=filler: [pool[i] for i in rng.integers(0, len(pool), n)]
    examples: list[tuple[set[str], int]] = []
    for k, ts in enumerate(TEMPLATES.values()):
        for t in ts:
            for _ in range(40):
                w = [x for x in words_of(t) if rng.random() > 0.06]
                examples.append((grams_of(some(rng.integers(0, 6)) + w + some(rng.integers(0, 6))), k))
    for t in NEGATIVES:
        for _ in range(20):
            examples.append((grams_of(some(rng.integers(0, 6)) + words_of(t) + some(rng.integers(0, 6))), len(classes) - 1))
    for _ in range(500):
        examples.append((grams_of(some(rng.integers(1, 30))), len(classes) - 1))
        examples.append((grams_of(some(rng.integers(0, 5)) + some(rng.integers(1, 8), plain)), len(classes) - 1))
    names = {g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t))} | {g for t in NEGATIVES for g in grams_of(words_of(t))}
    sampled = [(grams_of(w), weak_label(w)) for w in map(words_of, lines)]
    examples += [(g, classes.index(label)) for g, label in sampled if label]
    common = Counter(g for grams, _ in sampled for g in grams)
    names |= {g for g, n in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:1000] if n >= 3}
    at = {g: i for i, g in enumerate(sorted(names))}
    x = np.zeros((len(examples), len(at)), np.float32)
    for i, (grams, _) in enumerate(examples):
        x[i, [at[g] for g in grams if g in at]] = 1
    y = np.array([k for _, k in examples])
    order = rng.permutation(len(y))
    train, held = order[len(y) // 5 :], order[: len(y) // 5]
    w, b = np.zeros((len(at), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    goal, seen = np.eye(len(classes), dtype=np.float32)[y][train], x[train]

    def share(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(150):
        gap = share(seen @ w + b) - goal
        w -= 4.0 * (seen.T @ gap / len(train) + 1e-4 * w)
        b -= 4.0 * gap.mean(0)
    z = x[held] @ w + b
    loss = lambda t: -np.log(share(z * t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    best = min((0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
    return Model(classes, {g: (w[i] * best).astype(np.float64) for g, i in at.items()}, (b * best).astype(np.float64))


def sampled_lines(docs: DataFrame, most: int = LABELLED, sources: int = SOURCES) -> tuple[str, ...]:
    """At most so many distinct lines of at most so many documents, the first by hashes."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().withColumn("hash", F.xxhash64("doc_id"))
    ids = shared.stage(shared.first_by(ids, "hash", sources, "doc_id").select("doc_id"), "sample")
    lines = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where((F.length("line") <= LINE) & F.col("line").rlike(r"[\p{L}\p{N}]")).distinct()
    return tuple(r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(most).collect())


# ---------------------------------------------------------------- runs of lines that may be notices


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")


def gram_array(words: Column, n: int) -> Column:
    count = F.size(words) - n + 1
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def needed_grams(overlap: float) -> set[str]:
    """Grams of which each text that holds `overlap` of a template has one: of every template, the longest
    of its grams, one more than may be missing."""
    kept = set()
    for _, pairs in template_pairs():
        least = next(k for k in range(len(pairs) + 1) if k >= overlap * len(pairs) - 1e-9)
        kept |= set(sorted(pairs, key=lambda g: (-len(g), g))[: len(pairs) - max(least, 1) + 1])
    return kept


@functools.cache
def needed_pattern(overlap: float) -> str:
    """A regular expression for any of these grams, their letters in a tree so that few are tried."""
    tree: dict = {}
    for gram in needed_grams(overlap):
        at = tree
        for c in gram:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        ways = [(_WORD if c == " " else c) + written(below) for c, below in sorted(at.items()) if c] + ([r"(?![\p{L}\p{N}])"] if "" in at else [])
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return r"(?<![\p{L}\p{N}])" + written(tree)


def candidate_runs(docs: DataFrame, overlap: float) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, paragraph, start, stop, text) of all runs of lines that may be confirmed, and of all
    paragraphs with words of a template. Lines count from 0; a paragraph is told by its first line."""
    gram = needed_pattern(overlap)
    some = docs.where(F.lower("text").rlike(gram)).select("doc_id", F.split("text", "\n").alias("lines"))
    some = shared.stage(some.withColumn("row", F.monotonically_increasing_id()), "licences")
    # blank lines, with one before the text and one after it, bound the paragraphs
    some = some.withColumn("sizes", F.transform("lines", lambda x: F.size(word_array(x))))
    places = F.sequence(F.lit(0), F.size("sizes") - 1)
    blank = F.concat(F.array(F.lit(-1)), F.filter(places, lambda i: F.get("sizes", i) == 0), F.array(F.size("sizes")))
    first = lambda h: F.aggregate("blank", F.lit(-1), lambda n, x: F.when(x < h, F.greatest(n, x)).otherwise(n)) + 1
    last = lambda h: F.aggregate("blank", F.size("sizes"), lambda n, x: F.when(x > h, F.least(n, x)).otherwise(n)) - 1
    # a gram lies in a line or goes over to the next one
    begins = lambda i: F.lower(F.array_join(F.slice("lines", i + 1, 2), "\n")).rlike(gram)
    hits = F.filter(places, lambda i: (F.get("sizes", i) > 0) & begins(i))
    some = some.withColumn("blank", blank).withColumn("hits", F.transform(hits, lambda h: F.struct(h.alias("hit"), first(h).alias("paragraph"), last(h).alias("last"))))
    text = lambda lines, start, stop: F.array_join(F.slice(lines, start + 1, stop - start + 1), "\n")
    whole = F.array_distinct(F.transform("hits", lambda h: F.struct(h["paragraph"].alias("start"), h["last"].alias("stop"))))
    whole = F.transform(whole, lambda p: F.struct(p["start"].alias("paragraph"), p["start"].alias("start"), p["stop"].alias("stop"), text("lines", p["start"], p["stop"]).alias("text")))
    whole = some.select("row", "doc_id", F.explode(whole).alias("p")).select("row", "doc_id", "p.*")
    # of each hit only the lines go on that a notice with it may reach
    base = lambda h: F.greatest(h["paragraph"], h["hit"] - LONGEST)
    near = lambda of, h: F.slice(of, base(h) + 1, F.least(h["last"], h["hit"] + LONGEST) - base(h) + 1)
    around = F.transform("hits", lambda h: F.struct(h["paragraph"].alias("paragraph"), base(h).alias("base"), (h["hit"] - base(h)).alias("hit"), near("lines", h).alias("lines"), near("sizes", h).alias("sizes")))
    runs = some.select("row", "doc_id", F.explode(around).alias("h")).select("row", "doc_id", "h.*")
    inner = lambda i, j: F.aggregate(F.slice("sizes", i + 2, F.greatest(j - i - 1, F.lit(0))), F.lit(0), lambda n, x: n + x)
    stops = lambda i: F.filter(F.sequence("hit", F.least(F.size("lines") - 1, i + LONGEST)), lambda j: inner(i, j) < LONGEST)
    one = lambda i, j: F.struct((F.col("base") + i).alias("start"), (F.col("base") + j).alias("stop"), text("lines", i, j).alias("text"))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.col("hit")), lambda i: F.transform(stops(i), lambda j: one(i, j))))
    runs = runs.select("row", "doc_id", "paragraph", F.explode(spans).alias("s")).select("row", "doc_id", "paragraph", "s.*")
    return runs.dropDuplicates(["row", "start", "stop"]), whole


# ---------------------------------------------------------------- the scan


def classified(distinct: DataFrame, fitted: Model) -> DataFrame:
    """(key, predicted, probability, p_unknown, similarity) of texts with different keys."""
    spark = distinct.sparkSession
    features = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in fitted.weights.items()], "gram string, weights array<double>")
    parts = [(family, i, g, len(pairs)) for i, (family, pairs) in enumerate(template_pairs()) for g in pairs]
    parts = spark.createDataFrame(parts, "family string, template int, gram string, size int")

    grams = distinct.withColumn("w", word_array(F.col("text")))
    grams = grams.select("key", F.explode(F.array_distinct(F.concat(F.col("w"), gram_array(F.col("w"), 2), gram_array(F.col("w"), 3)))).alias("gram"))
    classes, bias = fitted.classes, fitted.bias
    sums = [F.sum(F.get("weights", i)).alias(f"z{i}") for i in range(len(classes))]
    scored = distinct.select("key").join(grams.join(F.broadcast(features), "gram").groupBy("key").agg(*sums), "key", "left")
    z = [F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + F.lit(float(bias[i])) for i in range(len(classes))]
    top = F.greatest(*z)
    total = functools.reduce(lambda a, b: a + b, [F.exp(v - top) for v in z])
    name = F.lit(classes[-1])
    for i in range(len(classes) - 2, -1, -1):
        name = F.when(z[i] == top, classes[i]).otherwise(name)
    scored = scored.select("key", name.alias("predicted"), (F.lit(1.0) / total).alias("probability"), (F.exp(z[-1] - top) / total).alias("p_unknown"))
    alike = grams.join(F.broadcast(parts), "gram").groupBy("key", "family", "template").agg((F.count("*") / F.first("size")).alias("s"))
    alike = alike.groupBy("key", "family").agg(F.max("s").alias("similarity"))
    named = scored.join(alike.withColumnRenamed("family", "predicted"), ["key", "predicted"], "left")
    return named.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def with_classes(rows: DataFrame, fitted: Model) -> DataFrame:
    """The staged rows with what the classifier says of their texts, each different text told once. A text of very
    many rows is no hot key where the different ones are few."""
    keyed = rows.withColumn("key", F.md5("text"))
    told = shared.stage(classified(keyed.select("key", "text").dropDuplicates(["key"]), fitted), "classified")
    return keyed.join(shared.bounded(told, 128), "key").drop("key")


def scan(docs: DataFrame, least: float = LEAST, overlap: float = OVERLAP, fitted: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, start, stop, text, family, probability, similarity) of each notice, and of each
    paragraph that is unknown; paragraph, start and stop are lines, counted from 0."""
    docs = docs.where("text is not null").select("doc_id", "text")
    fitted = fitted or model(sampled_lines(docs))
    runs, whole = candidate_runs(docs, overlap)
    sure = (F.col("predicted") != UNKNOWN) & (F.col("probability") >= least) & (F.col("similarity") >= overlap)
    found = shared.stage(with_classes(shared.stage(runs, "runs"), fitted).where(sure), "found")
    # a notice stays that is the best of its family at each of its lines
    rank = F.struct("similarity", (F.col("start") - F.col("stop")).alias("short"), (-F.col("start")).alias("early"))
    best = found.select("row", "predicted", rank.alias("rank"), F.explode(F.sequence("start", "stop")).alias("line"))
    best = best.groupBy("row", "predicted", "line").agg(F.max("rank").alias("rank")).groupBy("row", "predicted", "rank").agg(F.count("*").alias("n"))
    best = best.where(F.col("n") == 1 - F.col("rank.short")).select("row", "predicted", (-F.col("rank.early")).alias("start"), (-F.col("rank.early") - F.col("rank.short")).alias("stop"))
    kept = found.join(best, ["row", "predicted", "start", "stop"])
    notices = kept.select("doc_id", "paragraph", "start", "stop", "text", F.col("predicted").alias("family"), "probability", "similarity")
    rest = shared.stage(whole.join(kept.select("row", "paragraph").distinct(), ["row", "paragraph"], "left_anti"), "rest")
    rest = with_classes(rest, fitted).select("doc_id", "paragraph", "start", "stop", "text", F.lit(UNKNOWN).alias("family"), F.col("p_unknown").alias("probability"), "similarity")
    return notices.unionByName(rest)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.documents(spark, sf_dir))
