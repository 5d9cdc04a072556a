"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a hash of its code point. A trigram's vector
binds its three letters, the first rotated by two places, the second by one: their product. A text's
vector bundles its trigrams: their sum, each counted by the square root of its count. A language's
prototype bundles the vectors, scaled to length 1, of the texts that are known to be of it; the mean
of all prototypes, weighted equally, is what languages share and is taken off. The language of a text
is that of the prototype of greatest cosine, the score that cosine, not below 0.

Letters are lower-cased; runs of other characters count as one space. Text that is null or has no
letter is `und` with score 0. Texts of null language teach nothing. Where nothing can be learned
every prediction is `und`. Ties go to the language first in code-point order. Repeated rows each count.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DIMS, UNKNOWN = 1024, "und"
#: Code points of a text that are looked at together.
PIECE = 1 << 18
_CLASS: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """Of each code point: its lower case if that is one letter, else 32."""
    if not _CLASS:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _CLASS.append(table)
    return _CLASS[0]


def letters(points: np.ndarray) -> np.ndarray:
    """Their random vectors, one a row."""
    words = DIMS // 64
    seeds = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    bits = np.unpackbits(shared.mixed(shared.mixed(seeds)).view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :DIMS]


def bound(trigrams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, given as three code points of 21 bits each."""
    parts = np.stack([trigrams >> np.uint64(42), (trigrams >> np.uint64(21)) & np.uint64(0x1FFFFF), trigrams & np.uint64(0x1FFFFF)])
    points, at = np.unique(parts, return_inverse=True)
    vectors, at = letters(points), at.reshape(parts.shape)
    return np.roll(vectors, 2, 1)[at[0]] * np.roll(vectors, 1, 1)[at[1]] * vectors[at[2]]


def trigram_counts(text: str, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the whole text and how often they occur. Taken in pieces, each of which goes on
    from the two last letters of the one before, so the cuts change nothing."""
    table = letter_classes()
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    before = np.array([32], np.uint32)
    for at in range(0, max(1, len(text)), piece):
        new = table[np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), np.uint32)]
        new = np.concatenate([before, new, np.full(int(at + piece >= len(text)), 32, np.uint32)])
        new = new[np.append(True, (new[1:] != 32) | (new[:-1] != 32))].astype(np.uint64)
        before = new[-2:].astype(np.uint32)
        if len(new) < 3:
            continue
        f, n = np.unique((new[:-2] << np.uint64(42)) | (new[1:-1] << np.uint64(21)) | new[2:], return_counts=True)
        if len(found):
            f, place = np.unique(np.concatenate([found, f]), return_inverse=True)
            n = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        found, counts = f, n
    return found, counts


def bundles(texts: list[str | None], group: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, vectors of length 1) for groups of texts; zero where there is no letter."""
    at = 0
    while at < len(texts):
        some, n, to = [], 0, at
        while to < len(texts) and to - at < group and n < 1 << 22:
            some.append(trigram_counts(texts[to]) if texts[to] else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            n, to = n + (len(texts[to]) if texts[to] else 0), to + 1
        out = np.zeros((len(some), DIMS), np.float32)
        if any(len(f) for f, _ in some):
            distinct, where = np.unique(np.concatenate([f for f, _ in some]), return_inverse=True)
            owner = np.repeat(np.arange(len(some)), [len(f) for f, _ in some])
            weight = np.sqrt(np.concatenate([c for _, c in some])).astype(np.float32)
            for a in range(0, len(distinct), 4096):
                inside = (where >= a) & (where < a + 4096)
                m = np.zeros((len(some), min(4096, len(distinct) - a)), np.float32)
                m[owner[inside], where[inside] - a] = weight[inside]
                out += m @ bound(distinct[a : a + 4096]).astype(np.float32)
            norm = np.sqrt((out.astype(np.float64) ** 2).sum(1))
            out[norm > 0] /= norm[norm > 0, None].astype(np.float32)
        yield at, out
        at = to


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their prototypes, from rows of text and lang."""

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, vectors in bundles(batch.column("text").to_pylist()):
                named = np.array(langs[at : at + len(vectors)], object)
                for lang in set(named.tolist()):
                    mine = vectors[named == lang]
                    sums[lang] = sums.get(lang, 0) + np.append(np.rint(mine.astype(np.float64).sum(0) * (1 << 20)), (mine.any(1)).sum()).astype(np.int64)
        for lang, x in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(x)), "dim": pa.array(range(len(x)), pa.int32()), "x": pa.array(x)})

    rows = labelled.where("text is not null and lang is not null").select("lang", "text").mapInArrow(shared.lean(bundle), "lang string, dim int, x long")
    found = rows.groupBy("lang", "dim").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    learned = {r["lang"]: np.array([d["x"] for d in r["v"]], np.float64) for r in found.collect()}  # a vector for each language
    learned = {k: v[:-1] / np.linalg.norm(v[:-1]) for k, v in learned.items() if v[:-1].any()}
    langs = sorted(learned, key=lambda x: x.encode("utf-32-be"))
    matrix = np.array([learned[x] for x in langs]).reshape(len(langs), DIMS)
    if len(langs) > 1:
        matrix = matrix - matrix.mean(0)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    return langs, matrix.astype(np.float32)


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of each row, from its text alone."""
    kind = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)

    def predict(batches):
        for batch in batches:
            names, scores = [], []
            for _, vectors in bundles(batch.column("text").to_pylist()):
                cosines = vectors @ matrix.T if langs else np.zeros((len(vectors), 1), np.float32)
                best = cosines.argmax(1)
                known = vectors.any(1) & bool(langs)
                names += [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores += np.where(known, np.clip(cosines.max(1).astype(np.float64), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(shared.lean(predict), f"{kind}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = shared.documents(spark, sf_dir).withColumn("held_out", held_out)
    langs, matrix = prototypes(docs.where("not held_out"))
    rows = identify(docs, langs, matrix, ("doc_id", "held_out"))
    return rows.select("doc_id", "held_out", "lang_pred", "score")
