"""Text functions that need Unicode tables or positions, as Arrow-batched functions of columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import segments as S

SPANS = "array<struct<start:int,end:int>>"


def _mapped(f, kind: str):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return F.pandas_udf(run, kind)


def nfc(text: Column) -> Column:
    """Canonical composition, for keys only: it changes lengths. Compatibility forms stay."""
    return _mapped(lambda t: unicodedata.normalize("NFC", t), "string")(text)


def fold(text: Column) -> Column:
    """The definition of a word's key; `columns.fold` is the fast form."""
    return _mapped(S.fold, "string")(text)


def content_hash(text: Column) -> Column:
    return _mapped(S.content_hash, "string")(text)


def match_spans(text: Column, pattern: str) -> Column:
    """All matches that do not overlap, as code-point spans."""
    return _mapped(lambda t: [{"start": a, "end": b} for a, b in S.match_spans(t, pattern)], SPANS)(text)


def terms(text: Column, tokenizer: S.Tokenizer = S.STEMMED) -> Column:
    """Terms in order, by the exact word rules, protected regions being single terms."""
    return _mapped(lambda t: [x.term for x in tokenizer.tokenize(t)], "array<string>")(text)


def mask_formulas(text: Column) -> Column:
    """The text with its formulas painted over."""
    return _mapped(lambda t: S.mask_formulas(t)[0], "string")(text)


def masked_abbreviations(text: Column, always=S.K.ABBREVIATIONS, numeric=S.K.NUMERIC_ABBREVIATIONS) -> Column:
    """Spans of the periods that end no sentence; the lists are a parameter."""
    return _mapped(lambda t: [{"start": a, "end": b} for a, b in S.abbreviation_periods(t, always, numeric)], SPANS)(text)


def recede(text: Column, start: Column, end: Column) -> Column:
    def run(t: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([S.recede_anchor(x, int(i), int(j)) for x, i, j in zip(t, a, b)])

    return F.pandas_udf(run, "int")(text, start, end)
