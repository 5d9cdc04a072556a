import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    # names that the operators use inside themselves
    + [T.StructField(c, T.StringType()) for c in ("n", "id", "size", "key", "units", "rep", "kept", "anchor", "bucket", "position", "target", "taken", "copies", "kept_text", "single")]
)


def words(*numbers, prefix="w"):
    return " ".join(f"{prefix}{i}" for i in numbers)


LONG = words(*range(60_000), prefix="long")


def rows():
    base = words(*range(60))
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace("w30", "x30"), "en", "b"),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \t\n ", "en", "c"),
        (7, "one", "en", "c"),
        (8, "ONE", "en", "c"),
        (9, "one two", "fr", "c"),
        (10, LONG, "en", "d"),
        (None, base, "en", "d"),
        (None, None, "en", "d"),
        (12, "naïve 💡 " * 30, "fr", None),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([r + ("clash",) * 15 for r in rows()], DOC).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
