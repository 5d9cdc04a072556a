"""A measured round as one batch job: recordings and labels in, one report for each variant out.

Recordings follow `sources.corpus.RECORDING`, labels `LABEL`; documents are (document_id, text) and
fixtures (fixture, document_id) name the documents that each recorded answer was derived from.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources import corpus
from . import analyze, ruler


def refuse_unknown(fixtures: DataFrame, documents: DataFrame) -> None:
    lost = fixtures.join(documents, "document_id", "left_anti").head(1)
    if lost:
        raise ValueError(f"{lost[0]['fixture']} derives from {lost[0]['document_id']}, which the round does not have")


def parse(recorded: DataFrame, documents: DataFrame, fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(markers, sources). Markers: (fixture, marker, part, start, end, raw_chunks, violation, length_delta,
    snapped_start, snapped_end); sources: (fixture, marker, source, document_id of the origin, resolved_by,
    in_fixture, kind, located_in, start, end, snippet where it was not found, whether all places are in one document)."""
    refuse_unknown(fixtures, documents)
    checked = ruler.parse_checks(corpus.supports(recorded)).withColumnsRenamed({"id": "fixture", "support": "marker"})
    text, a, b = F.col("part_text"), F.col("start_byte"), F.col("end_byte")
    start, end = ruler.to_code_points(text, a, "start"), ruler.to_code_points(text, b, "end")
    inside = lambda o: F.coalesce(F.hex(F.substring(F.encode(text, "UTF-8"), o + 1, F.lit(1))).rlike("^[89AB]"), F.lit(False))
    markers = checked.select("fixture", "marker", "part", start.alias("start"), end.alias("end"), F.size("indices").alias("raw_chunks"), "violation", "length_delta", inside(a).alias("snapped_start"), inside(b).alias("snapped_end"), (b.between(0, F.octet_length(text)) & a.between(0, F.octet_length(text))).alias("placed"), "indices", "chunks")
    kept = markers.where(F.coalesce(F.col("placed"), F.lit(False)) & ~F.coalesce(F.col("violation").isin("missing_part", "missing_end", "missing_text"), F.lit(False)))
    each = kept.select("fixture", "marker", F.posexplode("indices").alias("place", "i"), "chunks").withColumn("c", F.get("chunks", F.col("i"))["retrievedContext"])
    custom = F.get(F.filter("c.customMetadata", lambda m: m["key"] == "documentId"), F.lit(0))["stringValue"]
    hints = each.where("c.text is not null").select("fixture", "marker", F.col("place").alias("source"), F.col("c.text").alias("snippet"), custom.alias("custom"), F.col("c.title").alias("title"))
    known = documents.select("document_id")
    by = lambda c: hints.select("fixture", "marker", "source", F.col(c).alias("document_id")).join(known, "document_id")
    one, two = by("custom").withColumnRenamed("document_id", "d1"), by("title").withColumnRenamed("document_id", "d2")
    rows = hints.join(one, ["fixture", "marker", "source"], "left").join(two, ["fixture", "marker", "source"], "left")
    rows = rows.withColumn("document_id", F.coalesce("d1", "d2")).withColumn("resolved_by", F.when(F.col("d1").isNotNull(), "customMetadata").when(F.col("d2").isNotNull(), "title"))
    rows = rows.join(fixtures.select("fixture", "document_id", F.lit(True).alias("f")), ["fixture", "document_id"], "left").withColumn("in_fixture", F.coalesce("f", F.lit(False)))
    # where to look: in the fixture's documents, or in the other document that the origin names
    own = rows.where(F.col("document_id").isNull() | F.col("in_fixture")).select("fixture", "marker", "source", "snippet").join(fixtures.withColumnRenamed("document_id", "look"), "fixture")
    other = rows.where(F.col("document_id").isNotNull() & ~F.col("in_fixture")).select("fixture", "marker", "source", "snippet", F.col("document_id").alias("look"))
    looks = own.select("fixture", "marker", "source", "snippet", "look").union(other).join(documents.withColumnRenamed("document_id", "look"), "look")
    n = F.char_length("snippet")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("text") - n + 1)), lambda i: F.substring(F.col("text"), i, n) == F.col("snippet"))
    hits = looks.where((n > 0) & F.contains("text", "snippet")).select("fixture", "marker", "source", "look", F.explode(at).alias("at"), n.alias("n"))
    places = hits.groupBy("fixture", "marker", "source").agg(F.count("*").alias("places"), F.count_distinct("look").alias("texts"), F.min(F.struct("look", "at", "n")).alias("first"))
    rows = rows.join(places, ["fixture", "marker", "source"], "left")
    kind = F.when(F.col("places").isNull(), "not_found").when(F.col("places") == 1, "exact").otherwise("ambiguous")
    sources = rows.select("fixture", "marker", "source", "document_id", "resolved_by", "in_fixture", kind.alias("kind"), F.col("first.look").alias("located_in"), (F.col("first.at") - 1).alias("start"), (F.col("first.at") - 1 + F.col("first.n")).alias("end"), F.when(kind == "not_found", F.col("snippet")).alias("snippet"), (F.col("texts") == 1).alias("same_document"))
    return markers.drop("indices", "chunks"), sources


def label_rows(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, golds) of labels."""
    each = labels.select(F.col("id").alias("fixture"), F.posexplode("segments").alias("segment", "s"))
    segments = each.select("fixture", "segment", F.col("s.partIndex").alias("part"), F.col("s.textSpan.start").alias("start"), F.col("s.textSpan.end").alias("end"))
    golds = each.select("fixture", "segment", F.posexplode("s.sourceSpans").alias("gold", "g")).select("fixture", "segment", "gold", F.col("g.documentId").alias("document_id"), F.col("g.span.start").alias("start"), F.col("g.span.end").alias("end"))
    return segments, golds


def marked(markers: DataFrame, sources: DataFrame, labels: DataFrame, threshold: float = K.OVERLAP_THRESHOLD) -> DataFrame:
    """The state of each marker, and which source stands for it: the picked one if it overlaps a gold span, else the
    first that was located."""
    segments, golds = label_rows(labels)
    kept = markers.where(F.coalesce(F.col("placed"), F.lit(False)))
    at = ruler.matched_segment(kept, segments).select("fixture", "marker", "segment")
    exact = sources.where("kind = 'exact'").select("fixture", "marker", "source", F.col("located_in").alias("document_id"), "start", "end")
    best = ruler.best_gold(exact.join(at, ["fixture", "marker"]), golds, ["fixture", "segment"]).select("fixture", "marker", "overlap", F.col("source").alias("picked"))
    counts = sources.groupBy("fixture", "marker").agg(F.count("*").alias("sources"), F.count_if(F.col("kind") == "exact").alias("located"), F.min(F.when(F.col("kind") == "exact", F.col("source"))).alias("first"))
    rows = kept.join(counts, ["fixture", "marker"], "left").na.fill(0, ["sources", "located"]).join(at, ["fixture", "marker"], "left").join(best, ["fixture", "marker"], "left")
    chosen = F.when(F.coalesce("overlap", F.lit(0.0)) > 0, F.col("picked")).otherwise(F.col("first"))
    return ruler.marker_states(rows, threshold).withColumn("chosen", chosen)


def score(markers: DataFrame, sources: DataFrame, labels: DataFrame, threshold: float = K.OVERLAP_THRESHOLD) -> DataFrame:
    """The counters of each fixture."""
    segments, golds = label_rows(labels)
    states = marked(markers, sources, labels, threshold)
    lost, many = F.col("kind") == "not_found", F.col("kind") == "ambiguous"
    by = lambda how: F.count_if(lost & (F.col("resolved_by") == how))
    buckets = sources.groupBy("fixture").agg(F.count_if(lost).alias("not_located"), by("customMetadata").alias("lost_by_custom"), by("title").alias("lost_by_title"), F.count_if(many).alias("ambiguous"), F.count_if(many & F.col("same_document")).alias("ambiguous_in_one"), F.count_if(lost & (F.col("document_id").isNull() | ~F.col("in_fixture"))).alias("unmatched_document"))
    differed = states.where((F.coalesce("overlap", F.lit(0.0)) > 0) & (F.col("picked") != F.col("first"))).groupBy("fixture").agg(F.count("*").alias("pick_differed"))
    outside = states.where("state = 'scored'").withColumn("source", F.col("chosen")).join(sources.select("fixture", "marker", "source", "document_id", "in_fixture"), ["fixture", "marker", "source"])
    outside = outside.where(F.col("document_id").isNotNull() & ~F.col("in_fixture")).groupBy("fixture").agg(F.count("*").alias("outside_fixture"))
    parts = [ruler.scored(states, segments), buckets, differed, outside, golds.groupBy("fixture").agg(F.count("*").alias("gold_spans"))]
    return reduce(lambda x, y: x.join(y, "fixture", "left"), parts).na.fill(0)


def violations(markers: DataFrame) -> DataFrame:
    """Tallies of each fixture; whether all length differences are one more."""
    v, delta = F.col("violation"), F.col("length_delta")
    wrong = F.coalesce(delta != 0, F.lit(False))
    return markers.groupBy("fixture").agg(
        F.count_if(wrong).alias("length"), F.count_if(v == "position").alias("position"), F.count_if(v == "missing_part").alias("missing_part"),
        F.count_if(v.isin("missing_end", "missing_text")).alias("missing_field"), F.count_if("snapped_start").alias("snapped_starts"), F.count_if("snapped_end").alias("snapped_ends"),
        F.coalesce(F.bool_and(F.when(wrong, delta == 1)), F.lit(False)).alias("all_plus_one"),
    )


def refuse_unequal(scores: DataFrame, recorded: DataFrame) -> None:
    """Scores and recordings must be of the same answers, one of each, before any number is made."""
    both = scores.groupBy("fixture").agg(F.count("*").alias("s")).join(recorded.groupBy(F.col("id").alias("fixture")).agg(F.count("*").alias("r")), "fixture", "full")
    s, r, wrong = both.agg(F.sum("s"), F.sum("r"), F.count_if(~(F.col("s").eqNullSafe(1) & F.col("r").eqNullSafe(1)))).first()
    if wrong:
        raise ValueError(f"{s or 0} scores of {r or 0} recordings: {wrong} answers do not have one of each")


def header_differs(meta: dict) -> Column:
    """Whether a recording's header is another than the run's, in any of the fields that the run states: model,
    storeEmbeddingModel, storeChunking (maxTokensPerChunk, maxOverlapTokens), and recordedAt, a moment or `first/last`."""
    stated = {k: meta[k] for k in ("model", "storeEmbeddingModel") if k in meta} | {f"storeChunking.{k}": v for k, v in meta.get("storeChunking", {}).items()}
    first, _, last = meta.get("recordedAt", "").partition("/")
    same = [F.col(c).eqNullSafe(F.lit(v)) for c, v in stated.items()]
    if first:
        same.append(F.coalesce(F.col("recordedAt").between(first, last or first), F.lit(False)))
    return ~reduce(Column.__and__, same, F.lit(True))


def report(scores: DataFrame, markers: DataFrame, recorded: DataFrame, variants: DataFrame, meta: dict | None = None) -> DataFrame:
    """One row for each variant: sums, rates, gates. Publishable is what has no violation and no recording
    whose header is another; documents are not named where too many snippets match none."""
    refuse_unequal(scores, recorded)
    grounded = (F.coalesce(F.size("groundingMetadata.groundingChunks"), F.lit(0)) > 0) | (F.coalesce(F.size("groundingMetadata.groundingSupports"), F.lit(0)) > 0)
    headed = recorded.select(F.col("id").alias("fixture"), "recordedAt", F.greatest(F.coalesce("usageMetadata.toolUsePromptTokenCount", "usageMetadata.tool_use_prompt_token_count", F.lit(0)), F.lit(0)).alias("tool_tokens"), *[header_differs(meta or {}).alias("differs"), grounded.alias("grounded")])
    heads = headed.join(variants, "fixture").groupBy("variant").agg(F.count_if(F.col("tool_tokens") > 0).alias("tool_used"), F.count_if((F.col("tool_tokens") > 0) & ~F.col("grounded")).alias("empty_metadata"), F.count_if("differs").alias("meta_mismatch"))
    broken = violations(markers).join(variants, "fixture").groupBy("variant").agg(*(F.sum(c).alias(c) for c in ("length", "position", "missing_part", "missing_field", "snapped_starts", "snapped_ends")), F.bool_and("all_plus_one").alias("all_plus_one"))
    out = ruler.run_report(scores.join(variants, "fixture"), ["variant"]).join(broken, "variant", "left").join(heads, "variant", "left")
    out = out.join(ruler.recorded_at(headed.join(variants, "fixture"), ["variant"], "recordedAt"), "variant", "left")
    clean = (F.col("length") == 0) & (F.col("position") == 0) & (F.col("missing_part") == 0) & (F.col("missing_field") == 0) & (F.col("meta_mismatch") == 0)
    held = (F.col("not_located") == 0) | (F.col("unmatched_document") / F.col("not_located") <= K.MAX_UNMATCHED_RATIO)
    return out.withColumns({"publishable": clean, "by_document_held": held})


def run_round(recorded: DataFrame, labels: DataFrame, documents: DataFrame, fixtures: DataFrame, variants: DataFrame, meta: dict | None = None) -> DataFrame:
    """Labels are checked first, all problems at once; then every recording is parsed, scored and summed."""
    filed = recorded.select("id", "parts")
    wrong = ruler.label_matches(labels.select("id", F.col("id").alias("filed_as"), "parts"), filed).collect()
    if wrong:
        raise ValueError("labels differ from their recordings: " + ", ".join(sorted(r[0] for r in wrong)))
    markers, sources = parse(recorded, documents, fixtures)
    out = report(score(markers, sources, labels), markers, recorded, variants, meta)
    column = F.struct("gold", "scored", "ambiguous", "not_located", "scored_over_gold", "gold_spans")
    columns = class_report(markers, sources, labels, documents, variants).groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("class", column))).alias("by_class"))
    return out.join(columns, "variant", "left")


def masses(markers: DataFrame, sources: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(fixture, bucket, each kind, plain), a row for each gold span, each source that stands for a scored marker,
    the first place of each ambiguous snippet, and each snippet that was not found, by its own regions."""
    _, golds = label_rows(labels)
    key = lambda bucket, *names: F.struct("fixture", F.lit(bucket).alias("bucket"), *(F.col(a).cast("long").alias(b) for a, b in zip(names, ("x", "y"))))
    named = golds.select(key("gold", "segment", "gold").alias("span"), "document_id", "start", "end")
    stood = marked(markers, sources, labels).where("state = 'scored'").select("fixture", "marker", F.col("chosen").alias("source"))
    place = [F.col("located_in").alias("document_id"), F.col("start"), F.col("end")]
    named = named.unionByName(sources.join(stood, ["fixture", "marker", "source"], "left_semi").select(key("scored", "marker", "source").alias("span"), *place))
    named = named.unionByName(sources.where("kind = 'ambiguous'").select(key("ambiguous", "marker", "source").alias("span"), *place))
    lost = sources.where("kind = 'not_found'").select(key("not_located", "marker", "source").alias("span"), F.to_json(F.struct("fixture", "marker", "source")).alias("document_id"), F.col("snippet").alias("text"))
    whole = lost.select("span", "document_id", F.lit(0).alias("start"), F.char_length("text").alias("end"))
    by = lambda spans, texts: ruler.class_mass(spans, analyze.regions(analyze.analyze(texts, "document_id", with_tokens=False), "document_id"), doc="document_id")
    both = by(named, documents.select("document_id", "text")).unionByName(by(whole, lost.select("document_id", "text")))
    return both.select("span.fixture", "span.bucket", *ruler.KINDS, "plain")


def class_report(markers: DataFrame, sources: DataFrame, labels: DataFrame, documents: DataFrame, variants: DataFrame) -> DataFrame:
    """The columns by class of each variant."""
    return ruler.class_columns(masses(markers, sources, labels, documents).join(variants, "fixture"), ["variant"], 6)


def not_located_by_document(sources: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant, document_id, not_located) of snippets that none of the fixture's documents holds, by the document that their
    origin names. A variant of which too many name none has no rows."""
    rows = sources.where("kind = 'not_found'").join(variants, "fixture")
    unmatched = F.col("document_id").isNull() | ~F.col("in_fixture")
    named = rows.groupBy("variant").agg((F.count_if(unmatched) / F.count("*") <= K.MAX_UNMATCHED_RATIO).alias("held")).where("held").select("variant")
    return rows.where(~unmatched).join(named, "variant", "left_semi").groupBy("variant", "document_id").agg(F.count("*").alias("not_located"))


def gold_mass(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(span, each kind, plain) of every gold span, by the protected regions of its document."""
    _, golds = label_rows(labels)
    regions = analyze.regions(analyze.analyze(documents, "document_id", with_tokens=False), "document_id")
    spans = golds.withColumn("span", F.concat_ws("/", "fixture", "segment", "gold"))
    return ruler.class_mass(spans, regions, doc="document_id")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Scores recorded answers against labels.")
    for name in ("recordings", "labels", "documents", "fixtures", "out"):
        p.add_argument(f"--{name}", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    documents = corpus.text_directory(spark, a.documents).withColumnRenamed("doc_id", "document_id")
    fixtures = spark.read.schema("fixture string, document_id string, variant string").json(a.fixtures)
    recorded, labels = corpus.recordings(spark, a.recordings), corpus.labels(spark, a.labels)
    out = run_round(recorded, labels, documents, fixtures.select("fixture", "document_id"), fixtures.select("fixture", "variant").distinct())
    corpus.report_sink(out, a.out)


if __name__ == "__main__":
    main()
