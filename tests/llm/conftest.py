import pytest
from pyspark.sql import types as T

CLASHES = (
    "size", "n", "key", "label", "stratum", "digest", "kept", "shard", "copies", "node", "_id", "_row_no", "_copy", "row", "turn", "slice", "codes", "tag", "runs", "base", "stratum0", "_own"
)  # names the operators use inside
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in CLASHES]
)
LONG = " ".join(f"word{i % 97}x{i // 7}" for i in range(5000))
EDGES = [
    (1, "a b c d e f g", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (None, "a b  c\td e f g", "en", None), (5, "a b c d e f g", "de", "s2"),
    (5, "a b c d e f g", "de", "s2"), (6, LONG, "en", "s2"), (7, LONG + " tail", "en", "s3"), (8, " \n\x0b\f\r ", "fr", "s3"), (9, "Ünïcode 日本 😀 x", "fr", ""),
    (None, None, None, None), (10, "x" * 50000, "en", "s1"), (11, "\\ <s>[INST] $%& </s>", "en", "s1"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in EDGES], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
