"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, the rest is lower-cased, and what stands between
letters, digits and placeholders splits tokens. Windows of `width` tokens of the templates of
documents and items meet in a hash join; items shorter than that are one window. Matched windows are
chained in the order of both texts, from one to the next at most SLACK tokens inserted or deleted. A
document holds an item if a chain has `share` of the item's windows. What stands in the slots that
the chain's windows cover must then be consistent: equal values of the item have equal values in the
document and unequal ones unequal, so a question with its numbers or names changed throughout is
caught, and prose that merely has the same shape is not. Adjacent names that face another number of
names are compared as one value.

A number is digits with . or , between them; a unit is one of UNITS after a number; a name is a
capitalised word after a lower-case letter, comma or semicolon and a space. In a second template every
capitalised word is a name, wherever it stands. Chains are made of the windows whose first templates
are equal, and again of those with windows where either template of the one equals either of the
other; a document holds an item if one of both is consistent. Windows of which more than half is
placeholders are no evidence.

A document that holds `share` of an item's windows holds one of any choice of more than the others. So
only an item's rarest windows, so many of them, bring documents and items together: a prompt that all
items begin with does not pair every document that has it with every item.

Null or empty texts, of either table, match nothing. Code points U+E001 to U+E004 of a text count as
spaces. Rows of null doc_id or item_id are left out. Repeated rows give their pair once. Extra columns
are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

WIDTH, SHARE, SLACK = 8, 0.5, 8
#: Bytes of benchmark windows, and of documents to verify, up to which they are broadcast; beyond it
#: they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Benchmark windows up to which documents' windows are tested before each becomes a row of the join.
IN_PLAN = 1 << 16
NAME, NUMBER, UNIT, FIRST = "\ue001", "\ue002", "\ue003", "\ue004"
#: Units of measure, money and time.
UNITS = "km|cm|mm|m|mi|ft|in|kg|g|mg|lb|lbs|oz|l|ml|mph|kmh|h|hr|hrs|hour|hours|min|mins|minute|minutes|s|sec|secs|second|seconds|day|days|week|weeks|month|months|year|years|percent|dollar|dollars|euro|euros|cent|cents|degrees"


#: Where a name begins: inside a sentence, and anywhere. What is seldom there is tried first.
INSIDE, ANYWHERE = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},;] )", r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}\p{M}" + NAME + r"])"


def marked(text: Column, name: str = INSIDE) -> Column:
    """The text in lower case with a placeholder before each slot's value."""
    return numbered(F.regexp_replace(text, name, NAME))


def numbered(text: Column) -> Column:
    """The text in lower case with a placeholder before each number and unit."""
    out = F.regexp_replace(F.lower(text), r"[.,](?=[0-9])(?<=[0-9].)", "")
    out = F.regexp_replace(out, r"(?=[0-9])(?<![\p{L}\p{N}" + NAME + r"])", NUMBER)
    out = F.regexp_replace(out, r"([0-9]) ?[" + NAME + FIRST + r"]?(?=(?:" + UNITS + r")(?![\p{L}\p{N}]))", "$1 " + UNIT)
    return F.when(text.rlike("[0-9]"), out).otherwise(F.lower(text))


def unmarked(text: Column) -> Column:
    """The text without code points that are placeholders here."""
    marks = NAME + NUMBER + UNIT + FIRST
    held = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])
    return F.when(held, F.translate(text, marks, " " * len(marks))).otherwise(text)


def tokens(marked_text: Column) -> Column:
    # what is not of a word in ASCII is looked up as what is not a letter, number or mark at all
    return F.array_remove(F.split(marked_text, r"[[\W_]&&[^\p{L}\p{N}\p{M}" + NAME + NUMBER + UNIT + FIRST + "]]+"), "")


def values_of(marked_text: Column) -> Column:
    """Tokens as they stand, names without their placeholder: they may face a word that has none."""
    return tokens(F.translate(marked_text, NAME, ""))


def slot_of(token: Column) -> Column:
    """The placeholder of a slot's token; null for others."""
    return F.when(token.startswith(NAME), NAME).when(token.startswith(NUMBER), NUMBER).when(token.startswith(UNIT), UNIT)


def template(marked_text: Column) -> Column:
    """Tokens with slots emptied: the placeholder stands alone."""
    return F.transform(tokens(marked_text), lambda t: F.coalesce(slot_of(t), t))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def hashes_of(shape: Column) -> Column:
    return F.transform(shape, lambda t: F.xxhash64(t))


def both_hashes(text: Column) -> Column:
    """(hashes, other): the token hashes of both templates, from one pass over the text. Most tokens sort
    before all placeholders, so one comparison tells them."""
    shape = tokens(numbered(F.regexp_replace(F.regexp_replace(text, INSIDE, NAME), ANYWHERE, FIRST)))
    plain = lambda t: F.when(t < NAME, F.xxhash64(t)).when(t.startswith(FIRST), F.xxhash64(F.substring(t, 2, 1 << 30))).otherwise(F.xxhash64(F.coalesce(slot_of(t), t)))
    other = lambda t, h: F.when((t < FIRST) | ~t.startswith(FIRST), h).otherwise(F.xxhash64(F.lit(NAME)))
    return let(shape, lambda x: let(F.transform(x, plain), lambda h: F.struct(h.alias("hashes"), F.zip_with(x, h, other).alias("other"))))


def rolled(hashes: Column, width: int) -> Column:
    """The hash of each window of a list of token hashes; what begins too late for a window has no meaning."""
    pair = lambda x, y, n: F.zip_with(x, F.slice(y, n + 1, F.greatest(F.size(y) - n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    if width == 1:
        return hashes
    if width % 2:
        return let(hashes, lambda h: pair(rolled(h, width - 1), h, width - 1))
    return let(rolled(hashes, width // 2), lambda h: pair(h, h, width // 2))


def windows(hashes: Column, other: Column, width: int, wanted=None) -> Column:
    """(hash, at, width, first) of each run of so many token hashes, and of each that the second template
    changes; of those only, if wanted(hash) is given, for which it holds."""
    n = F.size(hashes) - width + 1
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    one = lambda h, first: lambda i: F.struct(F.get(h, i - 1).alias("hash"), i.alias("at"), F.lit(width).alias("width"), F.lit(first).alias("first"))
    plain = lambda a: F.filter(places, lambda i: wanted(F.get(a, i - 1))) if wanted else places
    new = lambda a, b: lambda i: (F.get(a, i - 1) != F.get(b, i - 1)) & (wanted(F.get(b, i - 1)) if wanted else F.lit(True))
    both = lambda a, b: F.concat(F.transform(plain(a), one(a, True)), F.transform(F.filter(places, new(a, b)), one(b, False)))
    return let(rolled(hashes, width), lambda a: let(rolled(other, width), lambda b: both(a, b)))


def among(hashes: DataFrame):
    """A test whether a hash is one of these few, by a hash set that is part of the plan."""
    few = hashes.agg(F.collect_set("hash"))._jdf.first().getList(0)
    return lambda h: type(h)(h._jc.isInCollection(few))


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, n_windows, width, length, hash, place, first, slots, more_slots) of the items' windows that
    are evidence in the first template or in the second; the slots are those of either."""
    text = unmarked(F.col("text"))
    rows = items.where("item_id is not null and text is not null").select("item_id", marked(text).alias("m"), marked(text, ANYWHERE).alias("a"))
    rows = rows.select("item_id", values_of(F.col("m")).alias("values"), template(F.col("m")).alias("shape"), template(F.col("a")).alias("other")).where("size(shape) > 0")
    rows = rows.withColumn("width", F.least(F.size("shape"), F.lit(width)))
    rows = rows.withColumns({"hashes": hashes_of(F.col("shape")), "changed": hashes_of(F.col("other"))})
    slot = lambda t: t.isin(NAME, NUMBER, UNIT)
    each = F.coalesce(*[F.when(F.col("width") == w, windows(F.col("hashes"), F.col("changed"), w)) for w in range(1, width + 1)])
    slotted = lambda w: F.filter(F.slice(F.when(w["first"], F.col("shape")).otherwise(F.col("other")), w["at"], F.col("width")), slot)
    rows = rows.withColumn("windows", F.filter(each, lambda w: F.size(slotted(w)) * 2 <= F.col("width")))
    rows = rows.withColumns({"slots": slots_of(F.col("values"), F.col("shape")), "more_slots": slots_of(F.col("values"), F.col("other"))})
    n_windows = F.size(F.filter("windows", lambda w: w["first"])).cast("long")
    rows = rows.select("item_id", "width", F.size("shape").alias("length"), "slots", "more_slots", n_windows.alias("n_windows"), F.explode("windows").alias("w"))
    return rows.select("item_id", "width", "length", "slots", "more_slots", "n_windows", F.col("w.at").alias("place"), "w.first", "w.hash")


def seeds(wanted: DataFrame, share: float) -> DataFrame:
    """(width, hash, item_id) of the windows that bring documents and items together: those at an item's
    rarest places, one more place than a document that holds the item may lack."""
    common = wanted.withColumn("n_items", F.count("*").over(W.partitionBy("width", "hash")))
    places = common.groupBy("item_id", "n_windows", "place").agg(F.max("n_items").alias("n_items"))
    places = places.withColumn("nth", F.row_number().over(W.partitionBy("item_id").orderBy("n_items", "place")))
    rarest = places.where(F.col("nth") <= F.floor(F.col("n_windows") * F.lit(1 - share)) + 1).select("item_id", "place")
    return wanted.join(rarest, ["item_id", "place"]).select("width", "hash", "item_id").distinct()


def name_marks(shape: Column) -> Column:
    """A letter a token: n if it is a name."""
    return F.array_join(F.transform(shape, lambda t: F.when(t == NAME, "n").otherwise(".")), "")


def name_run(marks: Column, at: Column) -> Column:
    """(start, length) of the adjacent names around a token, or of the token alone."""
    start = F.least(F.length(F.rtrim(F.substring(marks, F.lit(1), at), F.lit("n"))) + 1, at)
    rest = F.substring(marks, at, F.length(marks))
    stop = F.greatest(at + F.length(rest) - F.length(F.ltrim(rest, F.lit("n"))), at + 1)
    return F.struct(start.alias("start"), (stop - start).alias("length"))


def joined(values: Column, run: Column) -> Column:
    return F.array_join(F.slice(values, run["start"], run["length"]), " ")


def slots_of(values: Column, shape: Column) -> Column:
    """(place, value, run, names) of each slot: run is where the adjacent names lie, names what they are."""
    at = F.filter(F.sequence(F.lit(1), F.size(shape)), lambda i: F.get(shape, i - 1).isin(NAME, NUMBER, UNIT))
    one = lambda i, run: F.struct(i.alias("place"), F.get(values, i - 1).alias("value"), run.alias("run"), joined(values, run).alias("names"))
    return let(name_marks(shape), lambda m: F.transform(at, lambda i: let(name_run(m, i), lambda run: one(i, run))))


def runs(shift: Column, places: Column) -> Column:
    """(end, last, first, shift) of the runs of adjacent places, given in order."""
    first = F.filter(places, lambda p, i: ~F.coalesce(F.get(places, i - 1) == p - 1, F.lit(False)))
    last = F.filter(places, lambda p, i: ~F.coalesce(F.get(places, i + 1) == p + 1, F.lit(False)))
    return F.zip_with(first, last, lambda a, b: F.struct((b + shift).alias("end"), b.alias("last"), a.alias("first"), shift.alias("shift")))


_CHAIN = "array<struct<n:int,last:int,end:int,parts:array<struct<shift:int,first:int,last:int>>>>"


def chains(found: Column, length: Column, need: Column) -> Column:
    """The chains of `need` windows or more, the longest that ends with each run. Of what may come before
    a run, only chains that end within the item's length and SLACK before it are looked at: no other links."""

    def step(state: Column, r: Column) -> Column:
        near = F.filter(state["live"], lambda c: c["end"] >= r["end"] - length - SLACK)
        fits = F.filter(near, lambda c: (c["last"] < r["last"]) & (c["end"] < r["end"]) & (F.abs(c["end"] - c["last"] - r["shift"]) <= SLACK))
        first = lambda c: F.greatest(r["first"], c["last"] + 1, c["end"] + 1 - r["shift"])
        ways = F.transform(fits, lambda c: F.struct((c["n"] + r["last"] - first(c) + 1).alias("n"), (-F.abs(c["end"] - c["last"] - r["shift"])).alias("even"), first(c).alias("first"), c["parts"].alias("parts")))
        alone = F.struct((r["last"] - r["first"] + 1).alias("n"), F.lit(0).alias("even"), r["first"].alias("first"), F.expr("cast(array() as array<struct<shift:int,first:int,last:int>>)").alias("parts"))
        part = lambda w: F.struct(r["shift"].alias("shift"), w["first"].alias("first"), r["last"].alias("last"))
        new = let(F.coalesce(F.array_max(ways), alone), lambda w: F.struct(w["n"].alias("n"), r["last"].alias("last"), r["end"].alias("end"), F.concat(w["parts"], F.array(part(w))).alias("parts")))
        return let(new, lambda c: F.struct(F.concat(near, F.array(c)).alias("live"), F.when(c["n"] >= need, F.concat(state["done"], F.array(c))).otherwise(state["done"]).alias("done")))

    none = F.expr(f"cast(named_struct('live', array(), 'done', array()) as struct<live:{_CHAIN},done:{_CHAIN}>)")
    return F.aggregate(F.array_sort(F.flatten(F.transform(found, lambda f: runs(f["shift"], f["places"])))), none, step, lambda state: state["done"])


def consistent(parts: Column, size: Column, slots: Column, values: Column, marks: Column) -> Column:
    """Whether what stands in the slots that a chain covers corresponds one to one."""

    def faced(s: Column, at: Column) -> Column:
        def pair(run: Column) -> Column:
            alike = s["run"]["length"] == run["length"]
            mine = F.when(alike, s["value"]).otherwise(s["names"])
            theirs = F.when(alike, F.get(values, run["start"] + s["place"] - s["run"]["start"] - 1)).otherwise(joined(values, run))
            return F.struct(mine.alias("mine"), theirs.alias("theirs"))

        return let(name_run(marks, at), pair)

    covered = lambda p: F.filter(slots, lambda s: s["place"].between(p["first"], p["last"] + size - 1))
    faces = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.transform(covered(p), lambda s: faced(s, s["place"] + p["shift"])))))
    n_of = lambda pairs, side: F.size(F.array_distinct(F.transform(pairs, lambda f: f[side])))
    return let(faces, lambda pairs: (n_of(pairs, "mine") == F.size(pairs)) & (n_of(pairs, "theirs") == F.size(pairs)))


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots) of the documents that hold an item."""
    wanted = shared.stage(item_windows(items, width), "items")
    n, widths = wanted.agg(F.count("*"), F.sort_array(F.collect_set("width"))).first()
    small = n * 256 <= BROADCAST_BYTES
    sent = F.broadcast if small else lambda rows: rows
    keys = wanted.select("width", "hash", "item_id", "place", "length", "n_windows", F.col("first").alias("item_first"))
    text = unmarked(F.col("text"))
    hashed = docs.where("doc_id is not null and text is not null").select("doc_id", both_hashes(text).alias("h")).select("doc_id", "h.hashes", "h.other")
    wanted_hash = among(keys) if 0 < n <= IN_PLAN else None
    each = F.concat(*[windows(F.col("hashes"), F.col("other"), w, wanted_hash) for w in (widths or [width])])
    found = hashed.select("doc_id", F.explode(each).alias("w")).select("doc_id", "w.hash", "w.at", "w.width", "w.first")
    found = shared.stage(found.join(sent(keys.select("width", "hash").distinct()), ["width", "hash"]), "windows")
    pairs = found.join(sent(seeds(wanted, share)), ["width", "hash"]).select("doc_id", "item_id").distinct()
    found = found.join(pairs, "doc_id").join(sent(keys), ["item_id", "width", "hash"])
    first = F.col("first") & F.col("item_first")
    found = found.groupBy("doc_id", "item_id", "length", "n_windows", (F.col("at") - F.col("place")).alias("shift")).agg(F.array_sort(F.collect_set(F.when(first, F.col("place")))).alias("places"), F.array_sort(F.collect_set("place")).alias("all"))
    found = found.groupBy("doc_id", "item_id", "length", "n_windows").agg(F.collect_list(F.struct("shift", "places")).alias("found"), F.collect_list(F.struct("shift", F.col("all").alias("places"))).alias("all"))
    either = F.array(F.struct(F.lit(True).alias("first"), F.col("found").alias("found")), F.struct(F.lit(False).alias("first"), F.col("all").alias("found")))
    found = found.withColumn("e", F.explode(F.when(F.col("found") == F.col("all"), F.slice(either, 1, 1)).otherwise(either))).select("doc_id", "item_id", "length", "n_windows", "e.*")
    need = F.col("n_windows") * F.lit(share)
    found = found.where(F.size(F.array_distinct(F.flatten("found.places"))) >= need)
    found = found.select("doc_id", "item_id", "n_windows", "first", F.explode(chains(F.col("found"), F.col("length"), need)).alias("c"))
    found = shared.stage(found.select("doc_id", "item_id", "n_windows", "first", F.col("c.n").cast("long").alias("n_matched"), "c.parts").distinct(), "matches")
    slots = wanted.select("item_id", F.col("width").alias("size"), "slots", "more_slots").dropDuplicates(["item_id"])
    found = found.join(slots.select("item_id", "size", F.size("slots").cast("long").alias("n_slots"), F.size("more_slots").alias("n_more")), "item_id")
    empty = F.when(F.col("first"), F.col("n_slots") == 0).otherwise(F.col("n_more") == 0)
    plain = found.where(empty).select("item_id", "doc_id", "n_windows", "n_matched", "n_slots")
    slotted = found.where(~empty).join(slots.select("item_id", "slots", "more_slots"), "item_id").withColumn("checked", F.when(F.col("first"), F.col("slots")).otherwise(F.col("more_slots")))
    n_slotted = slotted.count()
    if n_slotted:
        slotted = slotted.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n_windows", "first", "n_matched", "parts", "size", "checked", "n_slots")).alias("found"))
        values = docs.select("doc_id", "text").join(F.broadcast(slotted) if n_slotted * 4096 <= BROADCAST_BYTES else slotted, "doc_id")
        marks = [name_marks(template(marked(text, n))).alias(c) for c, n in (("marks", INSIDE), ("more_marks", ANYWHERE))]
        values = values.select("doc_id", "found", values_of(marked(text)).alias("v"), *marks)
        values = values.select("doc_id", F.explode("found").alias("f"), "v", "marks", "more_marks").withColumn("marks", F.when(F.col("f.first"), F.col("marks")).otherwise(F.col("more_marks")))
        fits = values.where(consistent(F.col("f.parts"), F.col("f.size"), F.col("f.checked"), F.col("v"), F.col("marks")))
        plain = plain.unionByName(fits.select("f.item_id", "doc_id", "f.n_windows", "f.n_matched", "f.n_slots"))
    return plain.groupBy("doc_id", "item_id", "n_windows", "n_slots").agg(F.max("n_matched").alias("n_matched"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaks(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "item_id", "n_matched", "n_windows", "n_slots")


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return shared.without(docs, leaks(docs, items))
