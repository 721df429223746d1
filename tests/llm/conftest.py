import pytest
from pyspark.sql import types as T

#: Nulls, empty texts, ties, repeated rows, a long text, and columns that clash with results and internals.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("score", T.StringType()), ("__text", T.StringType()), ("bits", T.StringType()), ("__id", T.StringType()), ("_marks", T.StringType()))])


def prose(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * 17) % 4001}" for i in range(n)) + "."


@pytest.fixture(scope="session")
def rows():
    long = prose(5, 20_000)
    texts = [(1, prose(1, 200)), (2, prose(1, 200)), (3, prose(1, 199) + " changed."), (4, prose(2, 120)), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (None, "no id here at all"), (10, long), (11, "Ünï — code 漢字 🙂 text"), (12, prose(3, 90)), (12, prose(3, 90))]
    return [(i, t, "en", "s", len(t or ""), "x", "y", "z", "i", "m") for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
