"""Scalar functions as column expressions: positions, keys of words, weights, vectors and intervals."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

WORD_CLASS = r"[\p{L}\p{N}\p{M}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def d(x: float) -> Column:
    return F.lit(float(x))


# ---------------------------------------------------------------- positions


def code_points(text: Column | str) -> Column:
    return F.char_length(col(text)).cast("long")


def slice_code_points(text: Column | str, start: Column, end: Column | None = None) -> Column:
    """From start to end, 0-based, end-exclusive; negative ones count from the end, all are clamped."""
    text, n = col(text), F.char_length(col(text))
    place = lambda p: F.greatest(F.lit(0), F.least(n, F.when(p < 0, n + p).otherwise(p)))
    a, b = place(start), place(end) if end is not None else n
    return F.substring(text, a + 1, F.greatest(F.lit(0), b - a))


def utf8_bytes(text: Column | str) -> Column:
    return F.octet_length(col(text)).cast("long")


# ---------------------------------------------------------------- words


@functools.cache
def fold_table() -> tuple[str, str]:
    """Letters that composition, lower case and removal of marks turn into one other letter."""
    source, target = [], []
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xDFFF or unicodedata.category(c) in ("Cn", "Co"):
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x)[0] != "M")
        bare = unicodedata.normalize("NFC", bare)
        if len(bare) == 1 and bare != c.lower():
            source.append(c.lower() if len(c.lower()) == 1 else c)
            target.append(bare)
    pairs = dict(zip(source, target))
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column | str) -> Column:
    """The key of words without a Python worker; `segments.fold` defines it."""
    source, target = fold_table()
    text = col(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.regexp_replace(F.translate(F.lower(text), source, target), r"\p{M}", ""))


def class_words(text: Column | str) -> Column:
    """Folded runs of letters, digits and marks."""
    return F.regexp_extract_all(fold(text), F.lit(WORD_CLASS), F.lit(0))


def stem_plural(term: Column) -> Column:
    out, n = F.when((F.char_length(term) < 3) | ~term.endswith("s"), term), F.char_length(term)
    for ending, new, least, spared in K.PLURAL_RULES:
        fires = term.endswith(ending) & (n >= len(ending) + least)
        if spared:
            fires = fires & ~term.isin(*spared)
        out = out.when(fires, F.concat(F.substring(term, F.lit(1), n - len(ending)), F.lit(new)))
    return out.otherwise(term)


def numerals(terms: Column) -> Column:
    return F.filter(terms, lambda t: t.rlike("[0-9]"))


def has_negation(terms: Column, markers: tuple[str, ...] = K.NEGATION_MARKERS) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, markers)))


# ---------------------------------------------------------------- weights


def lucene_idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.log(d(1) + (n - df + d(0.5)) / (df + d(0.5)))


def classic_idf(n: Column, df: Column) -> Column:
    """The form that turns negative for words in more than half of the passages."""
    n, df = n.cast("double"), df.cast("double")
    return F.log((n - df + d(0.5)) / (df + d(0.5)))


def separation_weight(df: Column, n: Column) -> Column:
    return F.when(F.coalesce(df, F.lit(0)) <= 0, d(0)).otherwise(lucene_idf(n, df))


def sustain_weight(df: Column, n: Column) -> Column:
    return lucene_idf(n, F.greatest(F.coalesce(df, F.lit(0)), F.lit(1)))


def bm25_term(tf: Column, length: Column, df: Column, n: Column, average: Column, k1: float = K.BM25_K1, b: float = K.BM25_B) -> Column:
    tf = tf.cast("double")
    relative = F.when(average > 0, length.cast("double") / average).otherwise(d(1))
    score = lucene_idf(n, df) * (tf * d(k1 + 1)) / (tf + d(k1) * (d(1) - d(b) + d(b) * relative))
    return F.when((tf > 0) & (df > 0) & (n > 0), score).otherwise(d(0))


# ---------------------------------------------------------------- vectors


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), d(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different sizes")))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), d(0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column | str) -> Column:
    v = col(v)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(v) < K.MINIMUM_NORM)
    unit = F.transform(v, lambda x: x.cast("double") / norm(v))
    return F.when(bad, F.raise_error(F.lit("a vector that cannot be scaled to length 1"))).otherwise(unit)


# ---------------------------------------------------------------- intervals


def common_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap(same: Column, gold_start: Column, gold_end: Column, start: Column, end: Column) -> Column:
    """What two spans share against the shorter: 0 in different documents."""
    shared = common_length(gold_start, gold_end, start, end).cast("double")
    against = lambda n: F.when(n > 0, shared / n.cast("double")).otherwise(d(0))
    return F.when(same, F.greatest(against(gold_end - gold_start), against(end - start))).otherwise(d(0))


def centrality(start: Column, end: Column, chunk_start: Column, chunk_end: Column) -> Column:
    return F.least(start - chunk_start, chunk_end - end)
