"""What a workbench shows: which arm a page takes, what no citation covers, and text with its marks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K


def page_arm(text: Column, image: Column, least: int = K.MIN_USABLE_LETTERS) -> Column:
    """text if it has letters enough, else image if there is one, else dropped."""
    letters = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))
    return F.when(letters >= least, "text").when(image.isNotNull(), "image").otherwise("dropped")


def page_id(file: Column, page: Column) -> Column:
    return F.concat(file, F.lit("#p"), page.cast("string"))


def file_of(page_id: Column) -> Column:
    return F.regexp_extract(page_id, r"^(.*)#p[0-9]+$", 1)


def page_of(page_id: Column) -> Column:
    return F.regexp_extract(page_id, r"#p([0-9]+)$", 1).try_cast("int")


def is_pdf(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def looks_readable(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(txt|md|markdown|pdf)$")


def merged_corpus(added: DataFrame, restored: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """One row for each id: added beats restored, the last added wins, each at the id's first place."""
    both = added.withColumn("_new", F.lit(1)).unionByName(restored.where("trim(text) <> ''").withColumn("_new", F.lit(0)))
    per = W.partitionBy(key)
    last = F.row_number().over(per.orderBy(F.col("_new").desc(), F.col(order).desc()))
    first = F.min(F.struct((F.lit(1) - F.col("_new")).alias("late"), F.col(order).alias("place"))).over(per)
    return both.withColumn("_first", first).withColumn("_last", last).where("_last = 1").select(*added.columns, F.col("_first.place").alias("place"), (F.col("_first.late") == 0).alias("added"))


def uncovered(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of what no span covers, from (key, length) and (key, start, end)."""
    ends = texts.select(key, F.col("length").alias("start"), F.col("length").alias("end")).withColumn("last", F.lit(1))
    rows = spans.where("end > start").select(key, "start", "end", F.lit(0).alias("last")).unionByName(ends)
    before = W.partitionBy(key).orderBy("last", "start", "end").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    return rows.where("start > reached").select(key, F.col("reached").alias("start"), F.col("start").alias("end"))


def pieces(texts: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, start, end, kinds) of the elementary intervals between the ends of all marks, with the kinds
    that cover each; from (key, length) and (key, kind, start, end)."""
    cuts = marks.select(key, F.explode(F.array("start", "end")).alias("at")).union(texts.select(key, F.explode(F.array(F.lit(0), F.col("length"))).alias("at"))).distinct()
    cuts = cuts.withColumn("end", F.lead("at").over(W.partitionBy(key).orderBy("at"))).where("end is not null").select(key, F.col("at").alias("start"), "end")
    p, m = cuts.alias("p"), marks.alias("m")
    over = p.join(m, (F.col(f"p.{key}") == F.col(f"m.{key}")) & (F.col("m.start") <= F.col("p.start")) & (F.col("p.end") <= F.col("m.end")), "left")
    return over.groupBy(f"p.{key}", "p.start", "p.end").agg(F.concat_ws(",", F.array_sort(F.collect_set("m.kind"))).alias("kinds"))


def markers_in(text: Column) -> Column:
    """The numbers of all [n] in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda n: n.cast("int"))


def paragraphs_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\n{2,}"), lambda p: F.trim(p) != "")


def highlight_parts(text: Column, start: Column, end: Column) -> Column:
    """struct<before, inside, after>."""
    cut = lambda a, b: F.substring(text, a + 1, F.greatest(F.lit(0), b - a))
    return F.struct(cut(F.lit(0), start).alias("before"), cut(start, end).alias("inside"), cut(end, F.char_length(text)).alias("after"))


def snippet_of(text: Column, most: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def corpus_merge_sentence(lexical: int, dense: int, unattributed: int) -> str:
    total = lexical + dense + unattributed
    return f"{lexical + dense} of {total} clauses have a source: {lexical} by words, {dense} by meaning"


# ---------------------------------------------------------------- a markdown subset

_PREFIX = re.compile(r"^(?:#{1,6} |[-*+] |> )")
_PAIRS = ("**", "__", "*", "_")


def strip_markdown(text: str, protected: list[tuple[int, int]] = ()) -> tuple[str, list[tuple[int, str]]]:
    """The text without headings' marks, bullets, quotes and emphasis outside protected regions, and what
    was taken: (offset in the stripped text, removed). `restore_markdown` undoes it exactly."""
    inside = [False] * (len(text) + 1)
    for a, b in protected:
        inside[a:b] = [True] * (b - a)
    gone = [False] * len(text)
    at = 0
    for line in text.splitlines(keepends=True):
        m = _PREFIX.match(line)
        if m and not any(inside[at : at + m.end()]):
            gone[at : at + m.end()] = [True] * m.end()
        body, i = line.rstrip("\r\n"), m.end() if m else 0
        while i < len(body):
            for mark in _PAIRS:
                close = body.find(mark, i + len(mark) + 1) if body.startswith(mark, i) else -1
                ends = [*range(at + i, at + i + len(mark)), *range(at + close, at + close + len(mark))] if close > 0 else []
                if ends and body[i + len(mark)] not in " \t" and body[close - 1] not in " \t" and not any(inside[e] or gone[e] for e in ends):
                    for e in ends:
                        gone[e] = True
                    i += len(mark) - 1
                    break
            i += 1
        at += len(line)
    kept, removed, n = [], [], 0
    for i, c in enumerate(text):
        if not gone[i]:
            kept.append(c)
            n += 1
        elif removed and removed[-1][0] == n and i and gone[i - 1]:
            removed[-1] = (n, removed[-1][1] + c)
        else:
            removed.append((n, c))
    return "".join(kept), removed


def restore_markdown(stripped: str, removed: list[tuple[int, str]]) -> str:
    out, at = [], 0
    for place, what in removed:
        out += [stripped[at:place], what]
        at = place
    return "".join(out) + stripped[at:]
