import functools
import math
import re
import zlib
from collections import Counter

import numpy as np

from attesta.llm import language as L
from attesta.llm import shared


def test_held_out_accuracy(spark, sf_dir):
    out = {r["doc_id"]: r for r in L.op5_language_id(spark, sf_dir).collect()}
    rows = shared.documents(spark, sf_dir).select("doc_id", "lang").collect()
    assert len(out) == len(rows)
    right = []
    for r in rows:
        got = out[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= got["score"] <= 1
        if got["held_out"]:
            right.append(got["lang_pred"] == r["lang"])
    assert len(right) > 20 and np.mean(right) > 0.95


def test_bundle_is_the_sum_of_bound_letters():
    """Against a vector made letter by letter."""
    text = "Ab, bA"
    letters = {c: L.letters(np.array([ord(c)]))[0].astype(int) for c in " ab"}
    plain, want = " ab ba ", np.zeros(L.DIMS)
    grams = [plain[i : i + 3] for i in range(len(plain) - 2)]
    for g in set(grams):
        a, b, c = (letters[x] for x in g)
        want += np.sqrt(grams.count(g)) * np.roll(a, 2) * np.roll(b, 1) * c
    (_, got), = L.bundles([text])
    assert np.allclose(got[0], want / np.linalg.norm(want), atol=1e-5)


def test_pieces_of_long_texts_agree():
    """The cuts between pieces change nothing, not even in runs of blanks."""
    text = "the quick brown fox, über naïve 💡 " * 50 + " " * 90 + "end"
    whole = dict(zip(*(x.tolist() for x in L.trigram_counts(text))))
    for n in (1, 2, 7, 64, 1000):
        assert dict(zip(*(x.tolist() for x in L.trigram_counts(text, n)))) == whole


def profile(text):
    """A text's vector, trigram by trigram."""
    flat = "".join(c.lower() if len(c.lower()) == 1 else c for c in (x if x.isalpha() else " " for x in text or ""))
    flat = re.sub(" +", " ", f" {flat} ")
    grams, total = Counter(flat[i : i + 3] for i in range(len(flat) - 2)), np.zeros(L.DIMS)
    for g, n in grams.items():
        a, b, c = (letter(x) for x in g)
        total += math.sqrt(n) * np.roll(a, 2) * np.roll(b, 1) * c
    return total / (np.linalg.norm(total) or 1)


@functools.cache
def letter(c):
    return L.letters(np.array([ord(c)]))[0].astype(float)


def test_against_brute_force(spark, sf_dir):
    """Every document of the smallest tables against profiles made in plain Python."""
    rows = shared.documents(spark, sf_dir).select("doc_id", "text", "lang").collect()
    vectors = {r["doc_id"]: profile(r["text"]) for r in rows}
    sums = {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    langs = sorted(sums)
    matrix = np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    matrix -= matrix.mean(0)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    for r in L.op5_language_id(spark, sf_dir).collect():
        cosines = matrix @ vectors[r["doc_id"]]
        if not vectors[r["doc_id"]].any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        assert abs(r["score"] - max(0, cosines.max())) < 1e-4
        assert r["lang_pred"] == langs[cosines.argmax()] or np.ptp(np.sort(cosines)[-2:]) < 1e-4


def test_odd_rows(spark, odd_docs, no_docs):
    langs, matrix = L.prototypes(odd_docs)
    assert langs == ["en", "fr"]
    out = L.identify(odd_docs, langs, matrix, ("doc_id", "n"))
    assert out.count() == odd_docs.count()
    for r in out.collect():
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in langs
    langs, matrix = L.prototypes(no_docs)
    assert langs == [] and {r["lang_pred"] for r in L.identify(odd_docs, langs, matrix).collect()} == {"und"}
    assert L.identify(no_docs, langs, matrix).count() == 0


def test_letters_of_late_extensions():
    table = L.letter_classes()
    assert all(table[ord(c)] == ord(c) for c in "\U00030000\U00031350\U000323AF") and table[0x10FFFF] == 32
