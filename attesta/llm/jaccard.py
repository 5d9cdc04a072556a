"""N-gram Jaccard join: T-occurrence search with DivideSkip over lists of rare shingles.

Two texts link when |A & B| * den >= num * |A | B| for their sets of k-word shingles.

1. A table of counts by hash bucket, of fixed size, tells frequent shingles from rare ones. It sums
   over all documents and only orders shingles, so it bears on cost and never on results.
2. Each text gives the size and digest of its set and its prefix: the rarest shingles in that order.
   Texts that link share a known part of their prefixes. Equal sets become one class, so copies need
   no comparison.
3. A shingle in the prefixes of two classes or more is a list. Classes of fewer lists than partners
   share are out, and of the others only the shortest lists are needed. Those with the same first class are
   searched together; long ones are cut into blocks by a hash and searched by pairs of blocks, very
   long ones into blocks that hang in a tree, each searched with its parent. That joins near copies of one text; only members of a long list that
   are still outside its main component are then held against all its blocks. The search gives
   candidates, and their components are the lists of a second search, over whole sets.
4. In a unit, each class asks for those that share T of its shingles: the short lists are merged by
   a heap, the long ones are probed by binary search (DivideSkip, Li et al., 2008). Pairs that are
   connected in their unit already are passed over; this drops links, not reachability.
5. Links between classes go to `components`.

Null or empty texts have an empty set and link with nothing. Texts of fewer than k words have one
shingle, the whole sequence. Rows that share a doc_id are one node. Rows of null doc_id are compared
as well where another row has the same set; their component is that row's. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BUCKETS = 1 << 20
#: Members of a block; blocks of a list up to which all pairs of them are units; blocks that hang on one.
BLOCK, PAIRS, FAN = 256, 16, 32
#: Bits of a hash that prefixes do without: they only find candidates, and less is shuffled.
CUT = 16
#: DivideSkip's weight of probing against merging.
MU = 0.01
#: What a member is to a unit: one of all that are compared; one that asks; in the list's main component;
#: outside it, but asking in another unit.
PLAIN, ASKS, MAIN, OTHER = range(4)


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text that has words."""
    for a, _, words in shared.text_slices(batch, lower=True):
        each = shared.word_hashes(words)
        grams = shared.gram_hashes(each, k)
        for i, (f, t) in enumerate(zip(words.first[:-1], words.first[1:])):
            if t - f >= k:
                yield a + i, np.unique(grams[f : t - k + 1])
            elif t > f:
                yield a + i, shared.gram_hashes(each[f:t], int(t - f))


def frequent_buckets(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shingle hashes that stand out of the noise of the others, and their counts. A bucket
    beyond the mean by 64 and six deviations holds a shingle of about so many texts or more."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            kept = [s for _, s in shingle_sets(batch, k)]
            if kept:
                total += np.bincount((np.concatenate(kept) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        yield shared.vector_rows(total)

    total = shared.summed_vector(docs.select("text").mapInArrow(shared.lean(count), "piece int, counts binary"), BUCKETS)
    mean = total.mean()
    found = np.flatnonzero(total > mean + 64 + 6 * math.sqrt(mean))
    return found.astype(np.uint64), total[found]


def signatures(docs: DataFrame, k: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray], cut: int = CUT) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, prefix, lost) of each row: set size, digest of the set, rarest shingles
    with cut hashes, and how many of those became equal by the cut."""
    buckets, counts = frequent

    def rare_first(s: np.ndarray, n: int) -> np.ndarray:
        if not len(buckets):
            return s[:n]
        b = s >> np.uint64(44)
        at = np.minimum(np.searchsorted(buckets, b), len(buckets) - 1)
        weight = np.where(buckets[at] == b, counts[at], 0)
        return s[np.lexsort((s, weight))[:n]]

    def sign(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            d = np.zeros((batch.num_rows, 2), np.int64)
            prefix, lost = [np.zeros(0, np.int64)] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
            for i, s in shingle_sets(batch, k):
                n[i] = len(s)
                d[i] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                rare = rare_first(s, len(s) - least_common(len(s), num, den) + prefix_share(len(s), num, den))
                prefix[i] = np.unique(rare >> np.uint64(cut)).astype(np.int64)
                lost[i] = len(rare) - len(prefix[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), shared.lists(prefix, pa.int64()), pa.array(lost)],
                ["doc_id", "n_shingles", "d1", "d2", "prefix", "lost"],
            )

    return docs.select("doc_id", "text").mapInArrow(shared.lean(sign), "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>, lost int")


# ---------------------------------------------------------------- search in a unit


def merged(short: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(member, number of lists that hold it), by a heap over the heads of the lists."""
    heap = [(x[0], i, 1) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    while heap:
        now, n = heap[0][0], 0
        while heap and heap[0][0] == now:
            _, i, at = heap[0]
            n += 1
            if at < len(short[i]):
                heapq.heapreplace(heap, (short[i][at], i, at + 1))
            else:
                heapq.heappop(heap)
        yield now, n


def divide_skip(lists: list[list[int]], t: int, skip) -> Iterator[tuple[int, int]]:
    """(member, occurrences) of members that at least t of the sorted lists hold; skip(member) rules
    members out before their long lists are probed."""
    if len(lists) < t or t < 1:
        return
    lists = sorted(lists, key=len)
    n_long = min(t - 1, int(t / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for member, n in merged(short):
        if n < t - n_long or skip(member):
            continue
        for left, x in enumerate(long):
            if n + len(long) - left < t:
                break
            at = bisect.bisect_left(x, member)
            n += at < len(x) and x[at] == member
        if n >= t:
            yield member, n


def least_common(n: int, num: int, den: int) -> int:
    """What a set of n shares with any that it links to."""
    return (num * n + den - 1) // den


def prefix_share(n: int, num: int, den: int) -> int:
    """Of a prefix of n - least_common + this many, rarest first, what two sets share that link, the
    smaller having n. It is 1 at least; more makes longer prefixes and far fewer false candidates."""
    return 1 + (n - least_common(n, num, den)) // 2


def unit_links(ids: list[int], sizes: list[int], sets: list[np.ndarray], num: int, den: int, prefixes: bool = False, roles: list[int] | None = None, lost: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among these sets; of prefixes, pairs that may link. Where some
    ask, only their links are wanted, and those in the main component are connected already. What a set
    lost by cut hashes it need not share."""
    order = sorted(range(len(sets)), key=lambda i: (sizes[i], ids[i]))
    sets, ids, sizes, lost = ([x[i] for i in order] for x in (sets, ids, sizes, lost or [0] * len(sets)))
    roles = [roles[i] for i in order] if roles else [PLAIN] * len(sets)
    some = ASKS in roles
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_by = n[token] > 1
    token, owner = token[shared_by], owner[shared_by]
    by_token = np.argsort(token, kind="stable")
    holders = np.split(owner[by_token], np.flatnonzero(np.diff(token[by_token])) + 1)
    lists = dict(zip(token[by_token][np.cumsum([0, *map(len, holders)][:-1])].tolist() if len(token) else [], (x.tolist() for x in holders)))
    tokens = np.split(token, np.searchsorted(owner, np.arange(1, len(sets))))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    main = [i for i, r in enumerate(roles) if r == MAIN]
    for i in main:
        root[i] = main[0]
    links, apart = [], len({find(i) for i in range(len(sets))})
    for q in range(len(sets)):
        if apart == 1:
            break
        if some and roles[q] != ASKS:
            continue
        n = sizes[q]
        if some:  # with any other: the smaller of the two has as many as they share at least
            least = prefix_share(least_common(n, num, den), num, den) if prefixes else least_common(n, num, den)
            mine = [[m for m in x if m != q] for x in map(lists.__getitem__, tokens[q].tolist())]
        else:  # with one as large or larger
            least = (prefix_share if prefixes else least_common)(n, num, den)
            mine = [x[bisect.bisect_right(x, q) :] for x in map(lists.__getitem__, tokens[q].tolist())]
        mine, least = [x for x in mine if x], max(1, least - lost[q])
        if len(mine) < least:
            continue
        here = find(q)
        for other, common in divide_skip(mine, least, lambda m: find(m) == here):
            small, large = sorted((n, sizes[other]))
            if small * den >= num * large if prefixes else common * den >= num * (small + large - common):
                links.append((ids[q], ids[other]))
                root[find(other)] = here = find(q)
                apart -= 1
    return links


# ---------------------------------------------------------------- the join


def tree_units(rows: DataFrame) -> DataFrame:
    """(u1, u2, id, role) of the first search, from (list, id, n). A list is cut into blocks. Each pair of
    a few blocks is a unit; more blocks hang in a tree, and each is searched together with its parent:
    as many units as blocks. Equal units come once."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    with_all = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o))
    first, last = F.col("block") * FAN + 1, F.least(F.col("block") * FAN + FAN, F.col("blocks") - 1)
    children = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("unit", F.explode(F.when(F.col("blocks") <= PAIRS, with_all).otherwise(F.concat(F.array("block"), children))))
    found = rows.groupBy("list", "unit").agg(F.array_sort(F.collect_set("id")).alias("members")).where("size(members) > 1").select("members").distinct()
    return found.select(F.xxhash64("members").alias("u1"), F.hash("members").alias("u2"), F.explode("members").alias("id"), F.lit(PLAIN).alias("role"))


def rest_units(rows: DataFrame) -> DataFrame:
    """(u1, u2, id, role) of the second search, from (list, id, n, ask, asking): blocks of those that ask
    against all blocks of their list."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("groups", F.ceil(F.col("asking") / BLOCK).cast("int"))
    pick = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    asking = rows.where("ask").withColumn("g", pick("groups")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = rows.withColumn("b", pick("blocks")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    role = F.when(F.col("ask"), OTHER).otherwise(MAIN)
    both = asking.select("list", "g", "b", "id", F.lit(ASKS).alias("role")).union(asked.select("list", "g", "b", "id", role.alias("role")))
    return both.select(F.xxhash64("list", "g", "b").alias("u1"), F.hash("list", "g", "b").alias("u2"), "id", "role")


def linked(lists: DataFrame, key: str, member: str, search) -> DataFrame:
    """(a, b): links that connect what is connected within the lists of (key, member) rows, by search(units).

    After the first search most of a long list of near copies is one component. Links inside it are not
    needed, so only the members outside it ask again, against the whole list.
    """
    sizes = lists.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    rows = shared.stage(lists.join(sizes, key).select(F.col(key).alias("list"), F.col(member).alias("id"), "n"), "lists")
    edges = shared.stage(search(tree_units(rows)), "links")
    long = rows.where(F.col("n") > BLOCK * PAIRS)
    if not long.head(1):
        return edges
    named = long.join(shared.components(edges), F.col("id") == F.col("node"), "left").select("list", "id", "n", F.coalesce("component", "id").alias("component"))
    parts = named.groupBy("list", "component").agg(F.count("*").alias("m"))
    main = parts.groupBy("list").agg(F.max_by("component", F.struct("m", "component")).alias("main"), (F.sum("m") - F.max("m")).alias("asking"))
    rest = named.join(main.where("asking > 0"), "list").select("list", "id", "n", "asking", (F.col("component") != F.col("main")).alias("ask"))
    rest = shared.stage(rest, "rest")
    return edges.union(search(rest_units(rest))) if rest.head(1) else edges


def searched(rows: DataFrame, find) -> DataFrame:
    """(a, b): what find(ids, sizes, sets, roles, lost) gives for each unit of UNIT rows."""

    def search(batches):
        for unit in shared.runs(batches, "u1"):
            parts: dict[int, dict] = {}
            for u2, i, role, n, gone, raw in zip(*(unit.column(c).to_pylist() for c in ("u2", "id", "role", "size", "lost", "shingles"))):
                part = parts.setdefault(u2, {})
                part[i, n, gone, raw] = min(part.get((i, n, gone, raw), role), role)  # who asks may be asked too
            for part in parts.values():
                if len(part) < 2:
                    continue
                ids, sizes, lost, sets = zip(*part)
                pairs = find(ids, sizes, [np.frombuffer(raw, np.uint64) for raw in sets], list(part.values()), lost)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

    return rows.repartition("u1").sortWithinPartitions("u1").mapInArrow(shared.lean(search), "a long, b long")


def packed(batches):
    """Arrays of longs as bytes."""
    for batch in batches:
        flat = [np.array(x, np.int64).tobytes() for x in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("u1", "u2", "id", "role", "size", "lost")] + [pa.array(flat, pa.binary())], ["u1", "u2", "id", "role", "size", "lost", "shingles"])


UNIT = "u1 long, u2 int, id long, role int, size long, lost int, shingles binary"


def candidates(signed: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of classes that share enough of their prefixes, or a path of these."""
    reps = signed.join(classes, ["d1", "d2"]).where("doc_id = class_id").withColumnRenamed("class_id", "rep")
    postings = reps.select("rep", F.explode("prefix").alias("token"))
    common = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    useful = postings.join(common, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("useful"))
    useful = useful.join(reps.select("rep", "n_shingles", "lost"), "rep")
    # partners share this many of what is left; so they share one of the rarest but for those
    own = f"({num} * n_shingles + {den - 1}) div {den}"
    least = F.expr(f"cast(greatest(1, 1 + (({own}) - ({num} * ({own}) + {den - 1}) div {den}) div 2 - lost) as int)")
    useful = useful.withColumn("least", least).where(F.size("useful") >= F.col("least"))
    keys = F.slice("useful", F.lit(1), F.size("useful") - F.col("least") + 1)
    useful = shared.stage(useful.select("rep", "n_shingles", "lost", F.col("useful.token").alias("tokens"), F.transform(keys, lambda u: u["token"]).alias("keys")), "useful")
    lists = useful.select("rep", F.explode("keys").alias("token"))
    firsts = lists.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1").select("token", "first")
    kept = useful.select(F.col("rep").alias("id"), F.col("n_shingles").alias("size"), "lost", "tokens")

    def search(units: DataFrame) -> DataFrame:
        rows = units.join(kept, "id").select("u1", "u2", "id", "role", "size", "lost", "tokens").mapInArrow(shared.lean(packed), UNIT)
        return searched(rows, lambda ids, sizes, sets, roles, lost: unit_links(ids, sizes, sets, num, den, True, roles, lost))

    return linked(lists.join(firsts, "token").select("first", "rep").distinct(), "first", "rep", search)


def links(docs: DataFrame, signed: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links between classes, each named by its smallest doc_id; between classes that link,
    directly or by others, there is a path of these."""
    groups = shared.components(candidates(signed, classes, num, den))

    def ship(batches):
        for batch in batches:
            ids, of = batch.column("doc_id").to_pylist(), batch.column("units").to_pylist()
            rows, held = [], 0
            for i, s in shingle_sets(batch, k):
                raw = s.tobytes()
                rows += [(u["u1"], u["u2"], ids[i], u["role"], len(s), 0, raw) for u in of[i]]
                held += len(raw)
                if held > 1 << 24:
                    yield _unit_rows(rows)
                    rows, held = [], 0
            if rows:
                yield _unit_rows(rows)

    def search(units: DataFrame) -> DataFrame:
        members = shared.stage(units.groupBy("id").agg(F.collect_list(F.struct("u1", "u2", "role")).alias("units")), "units")
        n_units, n_members = members.agg(F.sum(F.size("units")), F.count("*")).first()
        small = 24 * (n_units or 0) + 32 * n_members <= shared.BROADCAST_BYTES
        wanted = docs.select("doc_id", "text").join(F.broadcast(members) if small else members, F.col("doc_id") == F.col("id"))
        rows = wanted.select("doc_id", "text", "units").mapInArrow(shared.lean(ship), UNIT)
        return searched(rows, lambda ids, sizes, sets, roles, lost: unit_links(ids, sizes, sets, num, den, False, roles))

    return linked(groups, "component", "node", search)


def _unit_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["u1", "u2", "id", "role", "size", "lost", "shingles"])


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, cut: int = CUT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row: the size of its shingle set, the
    smallest doc_id with the same set and the smallest reachable by links."""
    shared.small_batches(docs.sparkSession)
    signed = shared.stage(signatures(docs, k, num, den, frequent_buckets(docs, k), cut), "signatures")
    # a table of its own, so that a class of very many copies can be split where it is joined
    classes = shared.stage(signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    found = shared.components(links(docs, signed, classes, k, num, den))
    rows = signed.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    rows = rows.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    own = F.coalesce("class_id", "doc_id")
    by_id = rows.select("doc_id", "n_shingles", own.alias("class_id"), F.coalesce("component", own).alias("component_id"))
    return by_id


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_components(shared.documents(spark, sf_dir), k=3, num=9, den=10)
    return rows.select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""


def one_of_each_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that name their component, one row each: one of each group of near copies. Rows of
    null doc_id cannot be told apart and go."""
    named = shared.stage(jaccard_components(docs), "components")
    rows = shared.without(docs.where("doc_id is not null"), named.where("doc_id <> component_id"))
    twice = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id")
    twice = shared.stage(twice, "repeated")
    if not twice.head(1):
        return rows
    again = rows.join(shared.bounded(twice, 48), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return shared.without(rows, twice).union(again)
