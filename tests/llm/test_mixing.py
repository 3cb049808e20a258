import re
from collections import defaultdict

import pytest

from repeatwise.llm.mixing import mix_sources, mixed_documents


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in out]
        full = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) >= cap * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)


def check(df):
    rows = mix_sources(df).collect()
    source = {}
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r.source] += words(r.text)
        source.setdefault((r.doc_id, words(r.text)), []).append(r.source)
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    assert len(rows) == df.count()
    by_total = {(sizes[s], round(want[s], 3)): s for s in sizes}
    for r in rows:
        s = by_total[r.source_size, round(r.target, 3)]
        assert s in source[r.doc_id, r["size"]]
        assert 0 <= r.copies <= 2
        taken[s] += r.copies * r["size"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.6 * largest[s] if len(sizes) < 8 else 30), s
    return {(r.doc_id, r["size"]): r.copies for r in rows}


def test_targets_are_met_and_reruns_agree(documents):
    assert check(documents) == check(documents.repartition(7))


def test_edges(edges, nothing):
    check(edges)
    assert mix_sources(nothing).count() == 0
    mixed = mixed_documents(edges)
    assert mixed.columns == edges.columns
    assert mixed.count() == sum(r.copies for r in mix_sources(edges).collect())


def test_hot_source_and_copies(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'w w w', repeat('v ', CAST(id % 50 AS int))) AS text", "IF(id % 2 = 0, 'a', CAST(id % 5 AS string)) AS source")
    check(df)


@pytest.mark.parametrize("text", [None, ""])
def test_no_words_at_all(spark, text):
    df = spark.createDataFrame([(1, text, "a"), (2, text, None)], "doc_id long, text string, source string")
    assert [r.copies for r in mix_sources(df).collect()] == [1, 1]
