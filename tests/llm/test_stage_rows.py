"""Stages keep whole rows: clashing names, keys of any type, repeated rows."""

import pytest
from pyspark.sql import functions as F

from repeatwise.llm.exact import drop_exact_copies, exact_copies
from repeatwise.llm.mixing import mix_sources, mixed_documents
from repeatwise.llm.ngram_join import drop_similar, similar_sets
from repeatwise.llm.quality import kept_documents

WORDS = [f"word{i}" for i in range(90)]
TEXTS = [" ".join(WORDS), " ".join(WORDS), " ".join(WORDS[:88] + ["other", "end"]), " ".join(f"own{i}" for i in range(70)), None, ""]
NAMES = ("_id", "_row_no", "_copy", "row", "key", "turn", "node", "text2")


def frame(spark, keys, kind):
    rows = [(k, t, "en", "s", *[f"{name} of {i}" for name in NAMES]) for i, (k, t) in enumerate(zip(keys, TEXTS))]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES))


KEYS = [("long", [5, 3, 4, 9, 8, 7]), ("long", [5, 5, None, 9, 9, None]), ("string", list("ebcdaf")), ("double", [1.2, 1.1, 1.15, 2.0, 3.0, 4.0])]


@pytest.mark.parametrize("kind,keys", KEYS)
def test_exact(spark, kind, keys):
    df = frame(spark, keys, kind)
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns and kept.count() == 4
    rows = {tuple(r) for r in df.collect()}
    assert all(tuple(r) in rows for r in kept.collect())
    order = lambda k: (k is None, k)
    assert min(keys[:2], key=order) in {r.doc_id for r in kept.collect() if r.text == TEXTS[0]}
    assert sum(r.kept for r in exact_copies(df).collect()) == 4


@pytest.mark.parametrize("kind,keys", KEYS)
def test_similar(spark, kind, keys):
    df = frame(spark, keys, kind)
    kept = drop_similar(df)
    assert kept.columns == df.columns
    rows = {tuple(r) for r in df.collect()}
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == 4 and set(got) <= rows and len([r for r in got if r[1] in TEXTS[:3]]) == 1
    labels = similar_sets(df).collect()
    assert len(labels) == 6 and sum(r.first for r in labels) == 4


@pytest.mark.parametrize("kind,keys", KEYS)
def test_mixed(spark, kind, keys):
    df = frame(spark, keys, kind)
    taken = mixed_documents(df)
    assert taken.columns == df.columns
    rows = {tuple(r) for r in df.collect()}
    got = [tuple(r) for r in taken.collect()]
    assert set(got) <= rows and len(got) == sum(r.copies for r in mix_sources(df).collect())


def test_kept_rows_are_whole(spark):
    df = frame(spark, KEYS[0][1], "long")
    kept = kept_documents(df)
    rows = {tuple(r) for r in df.collect()}
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= rows and kept.count() >= 3


def test_one_column_is_key_and_text(spark):
    df = spark.createDataFrame([("a b c",), ("a  b c",), ("d",)], "body string")
    assert drop_exact_copies(df, "body", "body").count() == 2 and drop_similar(df, "body", "body").count() == 2
    assert {r["body"] for r in exact_copies(df, "body", "body").select(F.col("body")).collect()} == {"a b c", "a  b c", "d"}
