"""Corpus analytics, retrieval metrics, round tallies, and quotations matched by their longest pieces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of composite numbers, of a document's own provisions, and of an act's number.
COMPOSITE = r"[0-9]+(?:[.,/:-][0-9]+)+"
PROVISION = r"(?i)\b(?:art|arts|inciso|al[ií]nea|par[aá]grafo)\b|§"
ACT_NUMBER = r"([0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{4,6})"


def profile(chunked: DataFrame, docs: DataFrame, key: str = "doc_id", most: int = 1200) -> DataFrame:
    """Counts of each document: code points, chunks, how they overlap, and what numbers it holds."""
    order = W.partitionBy(key).orderBy("ordinal")
    before = F.lag(F.struct("start", "end")).over(order)
    rows = chunked.select(key, "start", "end", before.alias("b"))
    n = F.col("end") - F.col("start")
    counts = rows.groupBy(key).agg(
        F.count("*").alias("chunks"), F.count_if(F.col("start") < F.col("b.end")).alias("overlapping"),
        F.count_if((F.col("start") >= F.col("b.start")) & (F.col("end") <= F.col("b.end"))).alias("redundant"),
        F.count_if(n > most).alias("oversized"), F.sum(n).cast("long").alias("chunk_code_points"),
    )
    own = docs.select(key, F.char_length("text").cast("long").alias("code_points"), F.regexp_count("text", F.lit(COMPOSITE)).cast("long").alias("composite_numbers"), F.regexp_count("text", F.lit(PROVISION)).cast("long").alias("provisions"))
    return own.join(counts, key, "left")


def citation_graph(docs: DataFrame, key: str = "doc_id", act: str = "act", text: str = "text") -> DataFrame:
    """(source, target, mentions): documents that name another's act number. Numbers are taken out of the
    texts and met by an equi-join, so no document is held against all others."""
    pattern = r"(?<![0-9.])([0-9][0-9.]*[0-9]|[0-9])(?![0-9])"
    named = docs.select(F.col(key).alias("source"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("number"))
    named = named.groupBy("source", "number").agg(F.count("*").alias("mentions"))
    acts = docs.where(F.col(act).isNotNull()).select(F.col(key).alias("target"), F.col(act).cast("string").alias("number"))
    return named.join(acts, "number").where("source <> target").groupBy("source", "target").agg(F.sum("mentions").alias("mentions"))


def retrieval_metrics(ranked: DataFrame, accepted: DataFrame, query: str, key: str, all_queries: DataFrame) -> DataFrame:
    """One row: hits within 1, 3 and 5 and the mean reciprocal rank of the first accepted passage."""
    first = ranked.join(accepted, [query, key], "left_semi").groupBy(query).agg(F.min("rank").alias("best"))
    rows = all_queries.select(query).distinct().join(first, query, "left")
    within = [F.count_if(F.col("best") <= k).alias(f"hit_{k}") for k in (1, 3, 5)]
    gain = F.coalesce(F.lit(1.0) / F.col("best").cast("double"), F.lit(0.0))
    return rows.agg(F.count("*").alias("queries"), *within, F.round(F.avg(gain), 6).alias("mrr"))


def page_scores(slices: DataFrame, query: str, page: str) -> DataFrame:
    """A page's score is that of its best slice."""
    return slices.groupBy(query, page).agg(F.max("score").alias("score"))


def round_tally(judged: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (answerable, verdict, refused, warned, chunk_known): what became of each question."""
    yes, v = F.col("answerable"), F.col("verdict")
    tally = {
        "correct": yes & (v == "correct"), "neighbour": yes & (v == "neighbour"), "missed": yes & ~v.isin("correct", "neighbour"),
        "refused": ~yes & F.col("refused"), "warned": ~yes & ~F.col("refused") & F.col("warned"), "confabulated": ~yes & ~F.col("refused") & ~F.col("warned"),
        "invented": ~F.coalesce(F.col("chunk_known"), F.lit(True)),
    }
    return judged.groupBy(*by).agg(F.count("*").alias("questions"), *(F.count_if(c).alias(n) for n, c in tally.items()))


#: Fixed value: how a quotation marks what it leaves out.
ELISION = re.compile(r"\(\s*\.\.\.\s*\)|\[\s*\.\.\.\s*\]")


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def quote_pieces(quote: str, passages: list[tuple[str, str]], least: int = 25) -> list[tuple[str, list[str]]]:
    """Cuts a quotation, white space and case aside, at its elisions and each part from left to right into
    the longest prefixes that stand in some passage, each with the passages that hold it; what is shorter
    than `least` is skipped by a character. No piece begins with a space."""
    out, passages = [], [(i, flat(t)) for i, t in passages]
    for part in ELISION.split(flat(quote)):
        part, at = part.rstrip(), 0
        while True:
            at += len(part) - at - len(part[at:].lstrip()) if part[at : at + 1] == " " else 0
            if len(part) - at < least:
                break
            holders = [(i, t) for i, t in passages if part[at : at + least] in t]
            if not holders:
                at += 1
                continue
            low, high = least, len(part) - at
            while low < high:  # a longer prefix is in no more passages than a shorter one
                middle = (low + high + 1) // 2
                low, high = (middle, high) if any(part[at : at + middle] in t for _, t in holders) else (low, middle - 1)
            piece = part[at : at + low]
            out.append((piece, [i for i, t in holders if piece in t]))
            at += low
    return out


def quotes_found(quotes: DataFrame, key: str = "quote_id", least: int = 25) -> DataFrame:
    """(key, piece, holders) for rows of (key, quote, passages array<struct<chunk_id, text>>)."""
    kind = dict(quotes.dtypes)[key]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, p, h) for k, q, ps in zip(frame[key], frame["quote"], frame["passages"]) for p, h in quote_pieces(q or "", [(x["chunk_id"], x["text"]) for x in ps], least)]
            yield pd.DataFrame(rows, columns=[key, "piece", "holders"])

    return quotes.select(key, "quote", "passages").mapInPandas(run, f"{key} {kind}, piece string, holders array<string>")
