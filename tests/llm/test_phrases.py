import hashlib
from collections import Counter

import pytest

from repeatwise.llm.phrases import remove_repeats


def brute(rows, window=50):
    first, split = {}, []
    for key, text in rows:
        w = (text or "").encode().split()
        split.append((key, w))
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), set()).add(key)
    out = Counter()
    for key, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if any(k is not None and (key is None or k < key) for k in first[tuple(w[j : j + window])]):
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(df, **settings):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, **settings).collect())


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(k[2] for k in want) > 0
    assert found(documents) == want


def test_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert found(edges) == brute(rows)
    assert remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("window,phrase", [(50, 8), (12, 12), (10, 3)])
def test_overlaps_and_borders(spark, window, phrase):
    w = [f"w{i}" for i in range(200)]
    rows = [
        (4, " ".join(w)), (2, " ".join(w[30:90])), (3, " ".join(w[80:140])), (9, " ".join(["x"] + w[20:70] + ["y"] + w[10:59] + ["z"])), (7, " ".join(["a"] * 120)), (8, " ".join(["a"] * 60)), (11, " ".join(w[30:90])),
        (12, " ".join(w[:49])), (13, " ".join(w[150:] + w[:50])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, window=window, phrase=phrase) == brute(rows, window)


def test_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}" if i % 3 == 0 else f"own {i} words") for i in range(900)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_automata_are_the_only_source(monkeypatch):
    """Without what the automaton locates no window is a candidate; with it, every occurrence of a pattern is found."""
    import pyarrow as pa

    from repeatwise.llm import phrases
    from repeatwise.llm.words import Words

    w = [f"w{i}" for i in range(40)]
    texts = pa.array([" ".join(w), " ".join(["x"] + w[5:30] + w[5:9]), "w5 w6", None])
    words = Words(texts)
    letters = phrases._letters(words)
    pattern = letters[5:9].astype("<u4").tobytes()
    assert sorted(phrases.locate(words, [pattern, pattern], 4).tolist()) == [5, 41, 66]
    assert len(phrases.locate(words, [], 4)) == 0
    leads = next(phrases._leaders(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), texts], ["key", "text"])]), 10, 4))
    lists = pa.array([leads.column("words").to_pylist()] * 4, pa.list_(pa.binary()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), texts, pa.array([False] * 4), lists], ["key", "text", "null_key", "phrases"])

    class Context:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(phrases.TaskContext, "get", lambda: Context)
    assert len(next(phrases._shards(iter([batch]), 10, 4)).column("open")[0]) == 2
    monkeypatch.setattr(phrases, "locate", lambda *_: __import__("numpy").zeros(0, int))
    assert len(next(phrases._shards(iter([batch]), 10, 4)).column("open")[0]) == 0


@pytest.mark.parametrize("kind", ["string", "double"])
def test_other_kinds_of_keys(spark, kind):
    w = [f"w{i}" for i in range(80)]
    keys = ["b", "a", "c", None] if kind == "string" else [1.2, 1.1, 1.25, None]
    rows = [(keys[0], " ".join(w)), (keys[1], " ".join(w[:60])), (keys[2], " ".join(w[10:70])), (keys[3], " ".join(w[20:])), (keys[3], " ".join(w[20:]))]
    assert found(spark.createDataFrame(rows, f"doc_id {kind}, text string")) == brute(rows)
