"""Substring de-duplication: seed and extend over winnowed anchors.

A window is `window` consecutive words of one document. A word goes if a window that covers it also
starts earlier in the input: in a document of smaller doc_id, or earlier in the same one.

1. Winnowing (Schleimer et al., 2003): each window owns the smallest hash among its grams of `gram`
   words, so equal windows own equal anchors. Anchors are about a seventh of the words.
2. Seed: anchors that occur once in the corpus are told to their documents; windows that own one of
   these cannot repeat.
3. Extend: the other anchors are extended both ways over all windows that they own, to a block. Where
   a 96-bit digest finds the block in an earlier document, all its windows are repeats. Only the
   earliest of equal blocks go on to the comparison window by window, again by digest. The earliest
   is a min that is taken in part before each shuffle, so a passage of very many documents costs one
   row for each task.
4. Repeated windows are merged into maximal runs and cut out of the text. The white space after a
   word goes with it.

All steps after the first share one shuffle of the texts. Null text counts as empty. Rows of null doc_id keep all
words and make no other row lose any. Repeated rows of one doc_id stand at the same place, so none is
earlier than the other; where one doc_id has different texts, they may keep words that they share
with others. Documents shorter than a window lose nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW, GRAM = 20, 8


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams the place of the smallest, the leftmost of equal ones."""
    n = len(grams) - width + 1
    low, span = grams, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    place = np.empty(n, np.int64)
    at = np.arange(n)
    for j in range(width - 1, -1, -1):
        np.copyto(place, at + j, where=grams[j : j + n] == low)
    return place


def anchored(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple]:
    """(row, words, number of the text among these words' texts, all their hashes, gram hashes of the row,
    owner of each of its windows) for rows with a window at least; places count from its first word."""
    for a, _, words in shared.text_slices(batch):
        each = shared.word_hashes(words)
        if len(each) < window:
            continue
        grams = shared.gram_hashes(each, gram)
        owner = owners(grams, window - gram + 1)
        for i in np.flatnonzero(np.diff(words.first) >= window):
            f, t = words.first[i], words.first[i + 1]
            yield a + int(i), words, int(i), each, grams[f : t - gram + 1], owner[f : t - window + 1] - f


class Digests:
    """Digests of 96 bits of any runs of words, from two running polynomials modulo 2^64."""

    def __init__(self, each: np.ndarray):
        n = len(each) + 1
        self.sums = [np.append(np.uint64(0), np.cumsum(w * _powers(base, n)[:-1])) for w, base in ((each, _BASES[0]), (shared.mixed(each ^ _BASES[2]), _BASES[1]))]
        self.back = [_powers(np.uint64(pow(int(b), -1, 1 << 64)), n) for b in _BASES[:2]]

    def of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (end - begin).astype(np.uint64) * _BASES[3]
        one, two = (shared.mixed((s[end] - s[begin]) * b[begin] + size) for s, b in zip(self.sums, self.back))
        return one.astype(np.int64), (two >> np.uint64(33)).astype(np.int32)


_BASES = shared._ROUNDS[:4]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def seeded(owner: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each anchor that occurs elsewhere too."""
    edge = np.append(0, np.flatnonzero(np.diff(owner)) + 1)
    place, last = owner[edge], np.append(edge[1:], len(owner)) - 1
    if len(single):
        again = ~np.isin(place, single)
        place, edge, last = place[again], edge[again], last[again]
    return place, edge, last


def windows_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All windows from first to last of each block."""
    n = last - first + 1
    return np.arange(n.sum()) + np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n)


def earliest_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Places of the first of equal digests, ascending."""
    order = np.lexsort((np.arange(len(one)), two, one))
    new = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)) if len(one) else np.zeros(0, bool)
    return np.sort(order[new])


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def seeds(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            d, h, p = [], [], []
            for row, _, _, _, grams, owner in anchored(batch, window, gram):
                found = np.unique(owner)
                d.append(np.full(len(found), ids[row], np.int64))
                h.append(grams[found].astype(np.int64))
                p.append(found.astype(np.int32))
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, d, p)], ["anchor", "doc_id", "place"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(shared.lean(seeds), "anchor long, doc_id long, place int")


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, repeats array<struct<start, end>>, kept_text) of each row: the maximal runs of
    words that go, and the text without them. Columns to carry come with them, as one struct `carried`."""
    shared.small_batches(docs.sparkSession)
    same = F.col("doc_id") == F.col("id")
    more = [F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")] if carry else []
    extra = ["carried"] if carry else []
    once = anchors(docs, window, gram).groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"), F.min("place").alias("place"))
    once = once.where("n = 1").groupBy("id").agg(F.collect_list("place").alias("single"))
    told = docs.select("doc_id", "text", *more).join(once.hint("shuffle_hash"), same, "left").drop("id")

    def emit(pick, *names):
        """Digests of what pick(the row's lists of these names, owner) gives, the first of equal ones."""

        def run(batches):
            for batch in batches:
                ids = batch.column("doc_id")
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                lists = [batch.column(c) for c in names]
                out, held, of, words_of = [], 0, None, None
                for row, words, i, each, _, owner in anchored(batch, window, gram):
                    if words is not words_of:
                        of, words_of = Digests(each), words
                    f = words.first[i]
                    place, begin, end = pick([_ints(x[row]) for x in lists], owner)
                    if not known[row] or not len(place):
                        continue
                    one, two = of.of(f + begin, f + end)
                    first = earliest_of(one, two)
                    out.append((one[first], two[first], np.full(len(first), ids[row], np.int64), place[first].astype(np.int32)))
                    held += len(first)
                    if held > 200_000:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

        return run

    def blocks(lists, owner):
        place, first, last = seeded(owner, lists[0])
        return place, first, last + window

    def windows(lists, owner):
        place, first, last = seeded(owner, lists[0])
        mine = np.isin(place, lists[1])
        starts = windows_of(first[mine], last[mine])
        return starts, starts, starts + window

    def firsts(rows: DataFrame, name: str) -> DataFrame:
        found = rows.groupBy("one", "two").agg(F.min("doc_id").alias("id"), F.min_by("place", "doc_id").alias("place"))
        return found.groupBy("id").agg(F.collect_list("place").alias(name)).hint("shuffle_hash")

    digests = "one long, two int, doc_id long, place int"
    # no filter or selection stands between the texts and their uses: all of them read the one exchange
    seeds = told.mapInArrow(shared.lean(emit(blocks, "single")), digests)
    told = told.join(firsts(seeds, "blocks"), same, "left").drop("id")
    extended = told.mapInArrow(shared.lean(emit(windows, "single", "blocks")), digests)
    final = told.join(firsts(extended, "earliest"), same, "left").drop("id")

    def cut(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            lists = [batch.column(c) for c in ("single", "earliest")]
            text = batch.column("text")
            data, offsets = shared.utf8(text)
            n_words = np.zeros(batch.num_rows, np.int64)
            for a, b in shared.slices(offsets):
                n_words[a:b] = np.diff(shared.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).first)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            kept: dict[int, str] = {}
            for row, words, i, _, _, owner in anchored(batch, window, gram):
                if not ids[row].is_valid:
                    continue
                single, earliest = (_ints(x[row]) for x in lists)
                _, first, last = seeded(owner, single)
                starts = windows_of(first, last)
                starts = starts[~np.isin(starts, earliest)]
                if not len(starts):
                    continue
                edge = np.flatnonzero(np.diff(starts) > window) + 1
                begin, end = starts[np.append(0, edge)], starts[np.append(edge - 1, len(starts) - 1)] + window
                spans[row] = [{"start": int(x), "end": int(y)} for x, y in zip(begin, end)]
                kept[row] = _without(words, i, begin, end)
            texts = text if not kept else pa.array([kept[r] if r in kept else t for r, t in enumerate(text.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), texts.cast(pa.string()), *(batch.column(c) for c in extra)],
                ["doc_id", "n_words", "repeats", "kept_text", *extra],
            )

    kind = "".join(f", {c} {final.schema[c].dataType.simpleString()}" for c in extra)
    return final.mapInArrow(shared.lean(cut), f"doc_id long, n_words long, repeats array<struct<start:int,end:int>>, kept_text string{kind}")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["one", "two", "doc_id", "place"])


def _ints(value: pa.Scalar) -> np.ndarray:
    return np.zeros(0, np.int64) if not value.is_valid else value.values.to_numpy(zero_copy_only=False)


def _without(words: shared.Words, i: int, begin: np.ndarray, end: np.ndarray) -> str:
    """The text of number i without the words from begin to end, of each run, and the white space after them."""
    f, t = words.first[i], words.first[i + 1]
    tail = words.start[t] if t < len(words.start) else len(words.data)
    starts = np.append(words.start[f:t], tail)
    data, at, out = words.data, words.start[f], []
    for b, e in zip(begin, end):
        out.append(data[at : starts[b]].tobytes())
        at = starts[e]
    if at < tail:
        out.append(data[at : words.end[t - 1]].tobytes())
    return b"".join(out).decode("utf-8", "surrogatepass")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_repeats(shared.documents(spark, sf_dir))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    kept = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE k > 1),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT x.doc_id, string_agg(x.x, ' ' ORDER BY x.p) AS t FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with their repeats cut out; n_chars, where there is one, follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = cut_repeats(docs, carry=others)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col("carried")[f"c{i}"] for i, c in enumerate(others)}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.size("repeats") > 0, F.char_length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(new["n_chars"])
    return rows.select(*[new[c].alias(c) for c in docs.columns])
