import pytest
from pyspark.sql import types as T

#: Rows that every operator on documents must take: nulls in every column, empty, blank, repeated and tied rows.
HARD = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w", "en", "s0", 45),
    (2, None, "en", "s1", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "en", "s1", 4),
    (None, "a text without an id, of some words that nobody else has", "en", "s2", 10),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w", "en", "s3", 45),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w", "en", "s3", 45),
    (6, "?? !! 123", "xx", "s4", 9),
    (7, "x" * 5000, "de", "s5", 5000),
    (8, "Ein Satz. " * 30_000, "de", "s5", 300_000),
    (9, "日本語 ünïcödé 🙂 it's we'll   end\r\n", "fr", "s6", 20),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("score", "node", "ids", "row", "line", "n_removed", "kept", "part")],
])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def hard(spark):
    return frame(spark, HARD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def vocabulary():
    from contrail.llm.packing import vocabulary

    return vocabulary()
