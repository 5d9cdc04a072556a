import re

import pytest

from attesta.llm import decontaminate as D
from attesta.llm import shared


def test_whole_table(spark, sf_dir):
    """Items that stand in documents, letter case and punctuation aside; a tenth of random prose is not flagged."""
    docs = {r[0]: r[1] for r in shared.documents(spark, sf_dir).select("doc_id", "text").collect()}
    items = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()}
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if flat(x) in flat(t)}
    assert want and {(r["doc_id"], r["item_id"]) for r in D.op6_template_decontamination(spark, sf_dir).collect()} == want


ITEM = "A train leaves Boston at 60 mph and, Smith says, another leaves Denver at 90 mph. When will both trains have travelled 450 km in all?"


def found(spark, *texts, item=ITEM):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    return sorted(r["doc_id"] for r in D.leaks(docs, items).collect())


def test_new_numbers_names_and_units(spark):
    changed = ITEM.replace("60", "1,250").replace("90", "75.5").replace("Smith", "Jones").replace("450 km", "300 mi")
    uneven = ITEM.replace("450", "60").replace("60", "60")  # two different numbers of the item become one
    assert found(spark, ITEM, "Before. " + changed + " After.", uneven, "A train leaves town. Both trains travelled.") == [0, 1]


def test_share_of_windows(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    assert found(spark, " ".join(words[:20]), " ".join(words[:14]), item.upper(), item.replace(" ", " - "), item=item) == [0, 2, 3]


def test_words_inserted_and_deleted(spark):
    """Windows on both sides of an edit add up; in another order, or far apart, they do not."""
    words = [f"w{i}" for i in range(30)]
    more, less = " ".join(words[:15] + ["new"] + words[15:]), " ".join(words[:14] + words[15:])
    turned, apart = " ".join(words[15:] + words[:15]), " ".join(words[:15] + [f"x{i}" for i in range(40)] + words[15:])
    assert found(spark, more, less, turned, apart, item=" ".join(words)) == [0, 1]
    row = D.leaks(spark.createDataFrame([(0, more)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).first()
    assert (row["n_matched"], row["n_windows"]) == (16, 23)


def test_names_of_more_or_fewer_words(spark):
    longer = ITEM.replace("Denver", "New York")
    assert found(spark, longer, longer.replace("450", "60")) == [0]  # two numbers of the item become one
    assert found(spark, ITEM, ITEM.replace("Denver", "Salt Lake City"), item=longer) == [0, 1]


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Tom eats 2. How many apples has Tom left?"
    new = item.replace("Tom", "Anna").replace("5", "9").replace("2", "4")
    two = new.replace("has Anna", "has Mary")  # one name of the item becomes two
    assert found(spark, new, two, "So: (" + new + ")", "Once\n" + new, item.lower(), item=item) == [0, 2, 3, 4]
    assert found(spark, "Anna has 7 red apples", "Anna has 7 green apples", "(Anna has 7 red apples)", item="Tom has 5 red apples") == [0, 2]


def test_first_words_that_change_apart(spark):
    """The same first word of sentences may face different ones where the rest is literally there."""
    item = "The w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14. The w15 w16 w17 w18 w19 w20 w21."
    assert found(spark, item.replace(". The", ". Some").replace("w21.", "w21. The"), item=item) == [0]


def test_slots_outside_matched_windows(spark):
    """The document holds the first twenty tokens; `Smith` comes again where it goes on with other text."""
    words = [f"w{i}x" for i in range(30)]  # a name follows a letter
    words[11] = words[22] = "Smith"
    other = [f"y{i}x" for i in range(10)]
    assert found(spark, " ".join(words[:20] + other), " ".join(words[:14] + other), item=" ".join(words)) == [0]


def test_prompt_common_to_all_items(spark):
    """Items that begin alike: the common windows count, but pair no document with an item by themselves."""
    prompt = " ".join(f"p{i}" for i in range(12))
    items = spark.createDataFrame([(i, prompt + " " + " ".join(f"q{i}x{j}" for j in range(14))) for i in range(5)], "item_id long, text string")
    half = prompt + " " + " ".join(f"q3x{j}" for j in range(6))  # 11 of 19 windows
    docs = spark.createDataFrame([(0, prompt + " and so on"), (1, half), (2, items.first()["text"])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in D.leaks(docs, items).collect()) == [(1, 3, 11), (2, 0, 19)]
    seeds = D.seeds(D.item_windows(items, 8), 0.5)
    assert seeds.groupBy("hash").count().where("count > 1").count() == 0 and seeds.count() == 5 * 10


def test_placeholders_in_texts(spark):
    words = " ".join(f"w{i}" for i in range(20))
    assert found(spark, words.replace("w5 ", "w5 \ue001 "), words.replace("w5", "\ue002w5"), item=words) == [0, 1]


def test_short_items(spark):
    assert found(spark, "say one two three four now", "one two three", "one two three four", item="One two three, four!") == [0, 2]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "w0 w1 w2 w3"), (3, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.leaks(odd_docs, items).collect()) == [(1, 3), (2, 3), (3, 3)]
    kept = D.without_leaks(spark, odd_docs, items)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in odd_docs.collect() if r["doc_id"] not in (1, 2, 3))
    assert D.leaks(no_docs, items).count() == 0 and D.leaks(odd_docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("text,shape", [("Ann met, Bob 3.5 km off", f"ann met {D.NAME} {D.NUMBER} {D.UNIT} off"), ("It is 1,000kg. Then 5 apples", f"it is {D.NUMBER} {D.UNIT} then {D.NUMBER} apples")])
def test_templates(spark, text, shape):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(D.template(D.marked(F.col("t")))).first()
    assert " ".join(row[0]) == shape
