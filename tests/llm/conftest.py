import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
     T.StructField("_id", T.StringType()), T.StructField("ids", T.StringType())] 
)

LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(20000))
LINE = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day"


def rows():
    texts = [
        (1, f"{LINE}\nfirst own line with quite a few words in it"),
        (2, f"{LINE.replace('quick', 'quick')}\nsecond different line that stays where it is"),
        (3, None), (4, ""), (5, " \n\t\n "), (6, LONG), (7, f"{LINE}\nfirst own line with quite a few words in it"),
        (7, f"{LINE}\nfirst own line with quite a few words in it"), (None, "no id here but some words that count"), (None, None),
        (8, "Ünïcode ☃ text 😀 with\nmail bob.smith@example.com and +1 (972) 555-6416"), (9, "x" * 3000), (10, "!!! ### !!!"), (11, "one"),
    ]
    return [(i, t, "en" if (i or 0) % 2 else "de", "s", len(t) if t is not None else None, "clash", "c", None) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    data = [(i, int(i % 3 > 0), int(i % 4 == 1)) for i in range(1, 12)] + [(None, 1, 1), (4, None, None)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
