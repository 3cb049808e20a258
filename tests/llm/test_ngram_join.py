import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from repeatwise.llm import ngram_join
from repeatwise.llm.common import smallest_labels
from repeatwise.llm.ngram_join import PrefixTree, connect, drop_similar, front_length, least_size, linked, needed, prefix_length, similar_sets, size_code

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k=5):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Components over row numbers, then the smallest key of each."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, o in shared.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    least = {}
    for i, (k, _) in enumerate(rows):
        keys = [x for x in (least.get(find(i)), k) if x is not None]
        least[find(i)] = min(keys, default=None)
    return Counter((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def check(df, **settings):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in similar_sets(df, **settings).collect()) == want
    return want


def test_documents(documents):
    want = check(documents)
    assert len({c for _, _, c in want}) < sum(want.values())


def test_edges(edges, nothing):
    check(edges)
    assert similar_sets(nothing).count() == 0
    kept = drop_similar(edges)
    assert kept.columns == edges.columns
    assert kept.filter("text IS NULL OR text = ''").count() == 3  # empty sets are linked with nothing


@pytest.mark.parametrize("chunk", [1000, 7])
def test_near_copies_and_chains(spark, chunk):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(120):  # one large group, edited more and more
        w = list(base)
        for _ in range(1 + i % 6):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**6), " ".join(w)))
    w = [f"c{i}" for i in range(200)]
    for i in range(25):  # a chain whose ends are far apart
        w[i * 8 : i * 8 + 4] = [f"n{i}{j}" for j in range(4)]
        rows.append((2_000_000 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(3_000_000 + i, passage + " " + " ".join(f"q{i}w{j}" for j in range(i % 40))) for i in range(80)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), chunk=chunk)


def test_prefix_length():
    for n in range(1, 400):
        assert needed(n) <= prefix_length(n) <= n
        for m in range(n, 5 * n // 4 + 1):  # the least overlap of a linked pair leaves enough shared shingles in both prefixes
            overlap = -(-4 * (n + m) // 9)
            assert overlap - min(n - prefix_length(n), m - prefix_length(m)) >= needed(n) or overlap > n
            assert abs(size_code(n) - size_code(m)) <= 3
    assert prefix_length(0) == 0
    codes = np.array([size_code(n) for n in range(1, 5000)])
    assert (least_size(codes) <= np.arange(1, 5000)).all()


def test_tree_finds_all_links():
    rng = np.random.default_rng(5)
    for _ in range(30):
        width = int(rng.integers(5, 60))
        base = [np.sort(rng.choice(width, size=int(rng.integers(1, width)), replace=False)) for _ in range(4)]
        sets = {tuple(np.setxor1d(base[int(rng.integers(4))], rng.choice(width, size=int(rng.integers(0, 4)))).tolist()) for _ in range(40)} - {()}
        sets = [np.array(s) for s in sets]
        tree = PrefixTree(sets)
        for q in sets:
            flags = np.zeros(width, np.int64)
            flags[q] = 1
            got = {tree.order[i] for i in tree.linked_with(q, flags, np.ones(len(sets), bool))}
            assert got == {i for i, s in enumerate(sets) if linked(len(np.intersect1d(q, s)), len(q), len(s))}
        ids = np.arange(len(sets))
        groups = connect([s.astype(np.uint64) for s in sets], ids, np.ones(len(sets), bool))
        assert (groups == groups[groups]).all()


def test_labels(spark):
    chain = [(i, i + 1) for i in range(300, 360)] + [(9, 8), (8, 9), (5, 1), (5, 2)]
    got = {r.node: r.label for r in smallest_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 300 for i in range(300, 361)} | {8: 8, 9: 8, 1: 1, 2: 1, 5: 1}


def spied(monkeypatch):
    """Tables that the join writes, by label."""
    tables, write = {}, ngram_join.written

    def spy(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(ngram_join, "written", spy)
    return tables


def test_unlinked_pages_of_a_template_do_not_meet(spark, monkeypatch):
    """400 pages share 80% of their words, Jaccard about 0.66: hardly any are compared. Linked pages of them still are."""
    tables = spied(monkeypatch)
    shared = " ".join(f"t{i}" for i in range(240))
    rows = [(i, shared + " " + " ".join(f"o{i}w{j}" for j in range(60))) for i in range(400)]
    want = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert len({c for _, _, c in want}) == 400
    assert tables["buckets"].count() < 40  # a few, by collisions in the sketch
    rows += [(1000 + i, rows[i][1].replace(f"o{i}w3 ", "").replace("t239 ", f"z{i} ")) for i in range(0, 400, 4)]
    rows += [(2000 + i, " ".join(f"t{j}" for j in range(i, 240))) for i in range(0, 60, 2)]
    assert len({c for _, _, c in check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))}) > 390


def test_mixed_frequencies(spark):
    """Pages whose common shingles are rare, frequent in front and frequent behind at once, over many sizes."""
    rng = random.Random(11)
    blocks = [[f"k{b}w{i}" for i in range(24)] for b in range(30)]
    rows = []
    for i in range(700):
        w = [x for b in rng.sample(range(30 if i % 3 else 8), 2 + i % 7) for x in blocks[b]] + [f"u{i}x{j}" for j in range(rng.randrange(12))]
        for _ in range(3):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            w[rng.randrange(len(w))] = f"r{rng.randrange(300)}"
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=50)


def test_visits_hold_two_chunks_at_most(spark):
    """However many sets of a bucket the leader does not reach, one group holds a chunk and a slice of about a chunk."""
    stored = spark.range(1, 2000).select(F.lit(0).cast("long").alias("leader"), F.col("id").alias("node"), F.lit(20).cast("long").alias("chunks"), F.pmod(F.xxhash64("id"), F.lit(20)).alias("chunk"), F.lit("x").alias("text"))
    met = stored.select("leader", "chunk", "node", F.col("node").alias("head"))
    groups = ngram_join.visits(stored, met, 100).groupBy("leader", "chunk", "slice").count().collect()
    assert len(groups) == 400 and max(r["count"] for r in groups) < 300
    pairs = ngram_join.visits(stored.filter("node < 200"), met.filter("node < 200"), 100)
    home = stored.select("node", F.col("chunk").alias("home"))
    a, b = pairs.filter("visitor").alias("a"), pairs.filter("NOT visitor").alias("b")
    met_pairs = {(r.x, r.y) for r in a.join(b, ["leader", "chunk", "slice"]).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).collect()}
    chunks = {r.node: r.home for r in home.filter("node < 200").collect()}
    assert met_pairs == {(x, y) for x in chunks for y in chunks if chunks[x] != chunks[y]}


def test_front_length():
    for n in range(1, 400):
        for m in range(n, 5 * n // 4 + 1):
            overlap = -(-4 * (n + m) // 9)
            assert overlap > n or (n - overlap < front_length(n) and m - overlap < front_length(m))
            c, d = np.array([size_code(n)], np.uint8), np.array([size_code(m)], np.uint8)
            one, none = np.ones(1, np.uint64), np.zeros(1, np.int64)
            assert set(ngram_join.in_windows(one, none, c)[0].tolist()) & set(ngram_join.in_windows(one, none, d)[0].tolist())
