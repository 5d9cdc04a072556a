"""The ruler: recorded citations against gold spans, by overlap; parse checks; validity of labels.

Spans are (document_id, start, end). Problems come as rows, all at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

KINDS = ("code", "url", "formula", "enumerator", "abbreviation")


def byte_places(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, byte_start, byte_end) of each code point: what byte offsets are looked up in."""
    rows = texts.select(key, F.posexplode(F.split(F.col(text), "")).alias("ord", "ch")).where("ch <> ''")
    end = F.sum(F.octet_length("ch")).over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("byte_end", end).select(key, "ord", (F.col("byte_end") - F.octet_length("ch")).alias("byte_start"), "byte_end")


def to_code_points(text: Column, offset: Column, edge: str) -> Column:
    """The code point at a byte offset of a text: inside one, a start goes back and an end on."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset)
    following = F.substring(F.encode(text, "UTF-8"), offset + 1, F.lit(1))
    inside = F.hex(following).rlike("^[89AB]")
    whole = F.char_length(F.regexp_replace(F.hex(head), "(?:[89AB][0-9A-F])|([0-7C-F][0-9A-F])", "$1")) / 2
    whole = whole.cast("int")
    return F.when(inside, whole - 1 if edge == "start" else whole).otherwise(whole)


def located(snippets: DataFrame, docs: DataFrame, snippet: str = "snippet_id", text: str = "snippet", doc: str = "doc_id") -> DataFrame:
    """(snippet, doc, start, end) of every place where a snippet stands in a text; occurrences may overlap.

    A snippet's longest word that has others on both sides must be a whole word of the text, so documents
    and snippets meet by an equi-join on that word. Only snippets of two words or fewer, a stated set, are
    held against every text.
    """
    words = lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    asked = snippets.select(snippet, F.col(text).alias("_s")).where("_s <> ''").withColumn("_w", words(F.col("_s")))
    inner = F.slice("_w", F.lit(2), F.greatest(F.lit(0), F.size("_w") - 2))
    asked = asked.withColumn("_key", F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"])
    keyed, bare = asked.where("_key is not null").drop("_w"), asked.where("_key is null").select(snippet, "_s")
    met = docs.select(doc, F.explode(F.array_distinct(words(F.col("text")))).alias("_key")).join(keyed, "_key").select(doc, snippet, "_s").distinct()
    rows = met.join(docs.select(doc, "text"), doc).select(snippet, "_s", doc, "text").where(F.contains("text", "_s"))
    rows = rows.union(docs.select(doc, "text").join(bare, F.contains("text", "_s")).select(snippet, "_s", doc, "text"))
    n = F.char_length("_s")
    starts = F.filter(F.sequence(F.lit(1), F.char_length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n) == F.col("_s"))
    return rows.select(snippet, doc, F.explode(starts).alias("at"), n.alias("n")).select(snippet, doc, (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col("n")).alias("end"))


def ambiguity(snippets: DataFrame, places: DataFrame, snippet: str = "snippet_id", doc: str = "doc_id") -> DataFrame:
    """(snippet, kind, occurrences, documents): exact, ambiguous or not_found."""
    found = places.groupBy(snippet).agg(F.count("*").alias("occurrences"), F.countDistinct(doc).alias("documents"))
    rows = snippets.select(snippet).join(found, snippet, "left")
    n = F.coalesce("occurrences", F.lit(0))
    return rows.select(snippet, F.when(n == 0, "not_found").when(n == 1, "exact").otherwise("ambiguous").alias("kind"), n.alias("occurrences"), F.coalesce("documents", F.lit(0)).alias("documents"))


def resolve_origin(hints: DataFrame, documents: DataFrame, custom: str = "custom", title: str = "title") -> DataFrame:
    """Adds document_id and in_fixture: by the custom name first, then by the title."""
    d1, d2 = (documents.select(F.col("document_id").alias(f"d{i}"), F.col("in_fixture").alias(f"f{i}")) for i in (1, 2))
    rows = hints.join(d1, F.col(custom) == F.col("d1"), "left").join(d2, F.col(title) == F.col("d2"), "left")
    known = F.when(F.col("d1").isNotNull(), F.col("f1")).otherwise(F.col("f2"))
    return rows.select(*hints.columns, F.coalesce("d1", "d2").alias("document_id"), F.coalesce(known, F.lit(False)).alias("in_fixture"))


def matched_segment(markers: DataFrame, segments: DataFrame, fixture: str = "fixture") -> DataFrame:
    """(fixture, marker, segment) of greatest intersection in the same part; of equals the earlier."""
    m, s = markers.alias("m"), segments.alias("s")
    shared = C.common_length(F.col("m.start"), F.col("m.end"), F.col("s.start"), F.col("s.end"))
    rows = m.join(s, (F.col(f"m.{fixture}") == F.col(f"s.{fixture}")) & (F.col("m.part") == F.col("s.part")) & (shared > 0))
    order = W.partitionBy(f"m.{fixture}", "m.marker").orderBy(shared.desc(), F.col("s.start"), F.col("s.segment"))
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select(f"m.{fixture}", "m.marker", "s.segment", shared.cast("long").alias("shared"))


def best_gold(sources: DataFrame, golds: DataFrame, keys: list[str]) -> DataFrame:
    """The source of each marker that overlaps a gold span most; ties go to the first source, then the first gold."""
    s, g = sources.alias("s"), golds.alias("g")
    on = [F.col(f"s.{k}") == F.col(f"g.{k}") for k in keys]
    o = C.overlap(F.col("s.document_id") == F.col("g.document_id"), F.col("g.start"), F.col("g.end"), F.col("s.start"), F.col("s.end"))
    rows = s.join(g, on).withColumn("overlap", o)
    order = W.partitionBy(*[f"s.{k}" for k in keys], "s.marker").orderBy(F.col("overlap").desc(), F.col("s.source"), F.col("g.gold"))
    rows = rows.withColumn("place", F.row_number().over(order)).where("place = 1")
    return rows.select(*[f"s.{k}" for k in keys], "s.marker", "s.source", "g.gold", "overlap", ((F.col("s.end") - F.col("s.start")).cast("double") / (F.col("g.end") - F.col("g.start")).cast("double")).alias("granularity"))


def class_mass(spans: DataFrame, regions: DataFrame, span: str = "span", doc: str = "doc_id", digits: int | None = None) -> DataFrame:
    """(span, each kind, plain): the shares of a span that protected regions take; zeros for an empty span."""
    s, r = spans.alias("s"), regions.alias("r")
    rows = s.join(r, (F.col(f"s.{doc}") == F.col(f"r.{doc}")) & (F.col("r.start") < F.col("s.end")) & (F.col("s.start") < F.col("r.end")), "left")
    n = (F.col("s.end") - F.col("s.start")).cast("double")
    part = F.when(F.col("r.kind").isNotNull() & (n > 0), C.common_length(F.col("s.start"), F.col("s.end"), F.col("r.start"), F.col("r.end")).cast("double") / n).otherwise(C.d(0))
    tidy = (lambda c: F.round(c, digits)) if digits else (lambda c: c)
    sums = [tidy(F.sum(F.when(F.col("r.kind") == k, part).otherwise(C.d(0)))).alias(k) for k in KINDS]
    plain = tidy(F.max(F.when(n > 0, C.d(1)).otherwise(C.d(0))) - F.sum(part))
    return rows.groupBy(f"s.{span}").agg(*sums, plain.alias("plain"))


def class_columns(masses: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """(by, class, gold, scored, ambiguous, not_located, scored_over_gold, gold_spans) of each kind and plain.

    Masses are (by, bucket, each kind, plain), a row a span; a bucket without spans has mean 0, and there is
    no ratio where the gold spans hold nothing of a class. One aggregation; classes become rows after it."""
    buckets = ("gold", "scored", "ambiguous", "not_located")
    tidy = (lambda c: F.round(c, digits)) if digits else (lambda c: c)
    of = lambda b: F.col("bucket") == b
    classes = (*KINDS, "plain")
    means = [F.coalesce(F.avg(F.when(of(b), F.col(k))), C.d(0)).alias(f"{b}_{k}") for k in classes for b in buckets]
    sums = masses.groupBy(*by).agg(*means, *(F.count_if(of("gold") & (F.col(k) > 0)).alias(f"spans_{k}") for k in classes))
    rows = [
        F.struct(
            F.lit(k).alias("class"), *(tidy(F.col(f"{b}_{k}")).alias(b) for b in buckets),
            F.when(F.col(f"gold_{k}") != 0, tidy(F.col(f"scored_{k}") / F.col(f"gold_{k}"))).alias("scored_over_gold"), F.col(f"spans_{k}").alias("gold_spans"),
        )
        for k in classes
    ]
    return sums.select(*by, F.inline(F.array(*rows)))


def marker_states(markers: DataFrame, threshold: float = K.OVERLAP_THRESHOLD) -> DataFrame:
    """Adds state (sourceless, bucket, scored), partial, choice and correct to rows of (raw_chunks, sources,
    located, overlap, segment)."""
    state = F.when(F.col("sources") == 0, "sourceless").when(F.col("located") == 0, "bucket").otherwise("scored")
    partial = (F.col("located") > 0) & ((F.col("raw_chunks") > F.col("sources")) | (F.col("located") < F.col("sources")))
    correct = (state == "scored") & F.col("segment").isNotNull() & (F.coalesce("overlap", C.d(0)) >= threshold)
    return markers.withColumns({"state": state, "partial": partial, "choice": (state == "scored") & (F.col("located") > 1), "correct": correct})


def scored(states: DataFrame, segments: DataFrame, fixture: str = "fixture") -> DataFrame:
    """The counters of each fixture. A segment whose markers all fell in buckets is indeterminate and
    leaves the denominator."""
    cites = states.groupBy(fixture).agg(
        F.count_if("correct").alias("citations_correct"), F.count_if(F.col("state") == "scored").alias("citations_scored"),
        F.count_if("partial").alias("partial_supports"), F.count_if("choice").alias("choice_supports"),
        F.count_if(F.col("state") == "sourceless").alias("sourceless"), F.count_if(F.col("raw_chunks") > 1).alias("multi_source_supports"),
        F.sum(F.when(F.col("state") == "scored", F.coalesce("overlap", C.d(0)))).alias("overlap_sum"),
    )
    on = states.where("segment is not null").groupBy(fixture, "segment").agg(F.bool_or("correct").alias("covered"), F.bool_and(F.col("state") != "scored").alias("bucketed"))
    each = segments.select(fixture, "segment").join(on, [fixture, "segment"], "left")
    covered, lost = F.coalesce("covered", F.lit(False)), F.coalesce("bucketed", F.lit(False))
    cover = each.groupBy(fixture).agg(F.count_if(covered).alias("segments_covered"), F.count_if(~covered & lost).alias("segments_indeterminate"), F.count_if(~(~covered & lost)).alias("segments_sustained"))
    return cites.join(cover, fixture, "full")


def run_report(scores: DataFrame, by: list[str], min_scored: int = K.MIN_SCORED_CITATIONS) -> DataFrame:
    """Sums over fixtures, divided only then; whether there is enough to publish."""
    sums = scores.groupBy(*by).agg(F.count("*").alias("answers"), *(F.sum(c).alias(c) for c in scores.columns if c not in by and c != "fixture" and c != "overlap_sum"), F.sum("overlap_sum").alias("overlap_sum"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a).cast("double") / F.col(b).cast("double"), 6))
    return sums.withColumns({
        "precision": rate("citations_correct", "citations_scored"), "coverage": rate("segments_covered", "segments_sustained"),
        "mean_overlap": rate("overlap_sum", "citations_scored"), "sample_sufficient": F.col("citations_scored") >= min_scored,
    }).drop("overlap_sum")


def recorded_at(rows: DataFrame, by: list[str], at: str = "recorded_at") -> DataFrame:
    """When a run was recorded: one moment, or the first and the last."""
    return rows.groupBy(*by).agg(F.when(F.min(at) == F.max(at), F.min(at)).otherwise(F.concat_ws("/", F.min(at), F.max(at))).alias("recorded_at"))


def parse_checks(supports: DataFrame) -> DataFrame:
    """Adds violation and length_delta to rows of (part_text, start_byte, end_byte, segment_text), absent
    starts being 0."""
    start = F.coalesce("start_byte", F.lit(0))
    total = F.octet_length("part_text")
    delta = F.col("end_byte") - start - F.octet_length("segment_text")
    a, b = to_code_points(F.col("part_text"), start, "start"), to_code_points(F.col("part_text"), F.col("end_byte"), "end")
    outside = (start < 0) | (start > total) | (F.col("end_byte") < 0) | (F.col("end_byte") > total)
    text = F.substring(F.col("part_text"), a + 1, F.greatest(F.lit(0), b - a))
    violation = (
        F.when(F.col("part_text").isNull(), "missing_part").when(F.col("end_byte").isNull(), "missing_end").when(F.col("segment_text").isNull(), "missing_text")
        .when(outside, "position").when(text != F.col("segment_text"), "position").when(delta != 0, "length")
    )
    return supports.withColumns({"violation": violation, "length_delta": delta.cast("long")})


# ---------------------------------------------------------------- validity


def manifest_problems(entries: DataFrame, present: DataFrame, licences: list[str], prefix: str = "labeled-") -> DataFrame:
    """(id, problem) of a manifest of (id, path, kind, license, derived_from array<string>)."""
    def say(rows: DataFrame, problem: str, key: str = "id") -> DataFrame:
        return rows.select(F.col(key).alias("id"), F.lit(problem).alias("problem"))

    origins = entries.where("kind = 'derived'").select("id", F.explode("derived_from").alias("origin"))
    known = entries.select(F.col("id").alias("origin"), F.col("kind").alias("origin_kind")).distinct()
    named = origins.join(known, "origin", "left")
    labels = entries.where((F.col("kind") == "derived") & F.startswith(F.col("id"), F.lit(prefix))).select("id", F.substring(F.col("id"), F.lit(len(prefix) + 1), F.char_length("id")).alias("raw"), "derived_from")
    raws = entries.select(F.col("id").alias("raw"), F.col("kind").alias("raw_kind"), F.col("derived_from").alias("raw_from"))
    filed = labels.join(raws, "raw", "left")
    same = F.array_sort(F.array_distinct("derived_from")) == F.array_sort(F.array_distinct("raw_from"))
    parts = [
        say(entries.groupBy("id").count().where("count > 1"), "id appears more than once"),
        say(entries.groupBy("path").count().where("count > 1"), "path is declared more than once", "path"),
        say(present.join(entries, "path", "left_anti"), "file has no entry", "path"),
        say(entries.join(present, "path", "left_anti"), "entry points at no file"),
        say(entries.where((F.col("kind") == "source") & ~F.coalesce(F.col("license").isin(*licences), F.lit(False))), "license is not allowed"),
        say(entries.where((F.col("kind") == "source") & F.col("derived_from").isNotNull()), "source declares origins"),
        say(entries.where((F.col("kind") == "derived") & F.col("license").isNotNull()), "derived declares a license"),
        say(entries.where((F.col("kind") == "derived") & (F.coalesce(F.size("derived_from"), F.lit(0)) <= 0)), "derived names no source"),
        say(named.where("origin_kind is null"), "derived names an unknown source"),
        say(named.where("origin_kind <> 'source'"), "derived names what is no source"),
        say(filed.where("raw_kind is null"), "label has no response"),
        say(filed.where(F.col("raw_kind").isNotNull() & ((F.col("raw_kind") != "derived") | ~F.coalesce(same, F.lit(False)))), "label and response disagree on origins"),
    ]
    return reduce(DataFrame.unionByName, parts)


def label_problems(labels: DataFrame, segments: DataFrame, golds: DataFrame, labelers: list[str]) -> DataFrame:
    """(fixture, segment, problem) of labels (fixture, labeled_by, n_parts), their segments (fixture, segment,
    part, start, end) and gold spans (fixture, segment, document_id, start, end, allowed)."""
    none = F.lit(None).cast("int")
    order = W.partitionBy("fixture", "part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    last = segments.withColumn("last", F.max("end").over(order))
    say = lambda rows, problem, seg="segment": rows.select("fixture", (F.col(seg) if isinstance(seg, str) else seg).cast("int").alias("segment"), F.lit(problem).alias("problem"))
    parts = [
        say(labels.where(~F.coalesce(F.col("labeled_by").isin(*labelers), F.lit(False))), "signer is not known", none),
        say(segments.join(labels.select("fixture", "n_parts"), "fixture").where("part < 0 or part >= n_parts"), "part does not exist"),
        say(segments.where("end <= start"), "span is empty"),
        say(last.where("start < last"), "starts before the last one ends"),
        say(segments.join(golds, ["fixture", "segment"], "left_anti"), "has no source"),
        say(golds.where("not allowed"), "source is not an origin"),
        say(golds.where("end <= start"), "source span is empty"),
    ]
    return reduce(DataFrame.unionByName, parts)


def label_matches(labels: DataFrame, recordings: DataFrame) -> DataFrame:
    """(id) of labels that differ from the recording they are filed against, in id or in parts."""
    rows = labels.alias("l").join(recordings.alias("r"), F.col("l.filed_as") == F.col("r.id"), "left")
    return rows.where(~(F.col("l.id").eqNullSafe(F.col("r.id")) & F.col("l.parts").eqNullSafe(F.col("r.parts")))).select("l.id")
