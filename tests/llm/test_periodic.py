import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from repeatwise.llm.periodic import find_runs, periodic_runs
from repeatwise.llm.queries import op12
from repeatwise.llm.words import mix

LEAST = 24


def brute(words, least=LEAST):
    """All runs by comparing the words at every period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)  # periods grow, so the smallest stays
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_fast(words, least=LEAST):
    x, n, found = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int), len(words), {}
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(np.int8)
        edges = np.diff(same)
        for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if e + q - s >= max(least, 3 * q):
                found.setdefault((int(s), int(e + q)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(texts, least=LEAST):
    words = [t.split() for t in texts]
    flat = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") for ws in words for w in ws]
    x = mix(np.array(flat, np.uint64))
    bounds = np.cumsum([0] + [len(w) for w in words])
    out = [[] for _ in texts]
    for s, e, q in find_runs(x, bounds, least):
        d = int(np.searchsorted(bounds, s, side="right") - 1)
        assert e <= bounds[d + 1]
        out[d].append((int(s - bounds[d]), int(e - s), int(q)))
    return out


PART = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=60), st.integers(1, 12), st.integers(0, 30))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PART, max_size=4), min_size=1, max_size=3), st.sampled_from([3, 24]))
def test_runs_of_repetitive_texts(plan, least):
    """Concatenated powers with fractional ends over a small alphabet, several texts side by side."""
    texts = []
    for parts in plan:
        words = []
        for unit, times, rest in parts:
            words += unit * times + unit[: rest % len(unit)]
        texts.append(" ".join(words))
    assert runs_of(texts, least) == [brute_fast(t.split(), least) for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(20, 900), st.integers(3, 9), st.integers(1, 4))
def test_large_periods(seed, period, times, kinds):
    rng = np.random.default_rng(seed)
    # a period that itself holds powers, so that scales meet highly periodic regions
    unit = [w for _ in range(kinds) for w in list(rng.integers(0, 3, max(1, period // (8 * kinds)))) * 6 + list(rng.integers(0, 50, max(1, period // (4 * kinds))))]
    words = [str(w) for w in list(rng.integers(0, 50, 17)) + (unit * times)[: len(unit) * times - int(rng.integers(0, len(unit)))] + list(rng.integers(0, 50, 23))]
    assert runs_of([" ".join(words)]) == [brute_fast(words)]


def test_fibonacci_and_thue_morse():
    f, g = "a", "ab"
    while len(g) < 3000:
        f, g = g, g + f
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    for s in (g, t, "a" * 5000, "ab" * 2500, ("a" * 40 + "b") * 60):
        assert runs_of([" ".join(s)], 3) == [brute_fast(list(s), 3)]
    assert brute(list(g[:300]), 3) == brute_fast(list(g[:300]), 3)


def collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_edge_rows(edges, nothing, spark):
    rows = edges.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = brute_fast(words)
        want.append((r.doc_id, len(words), runs, collapsed(words, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(edges).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic_runs(nothing).collect() == []
    clash = edges.select(F.col("text").alias("key"), F.col("doc_id").alias("runs"))
    assert periodic_runs(clash, "runs", "key").count() == len(rows)


def test_one_long_text(spark):
    long = spark.createDataFrame([("k", "x " + "ab cd ef " * 300_000 + "y")], "name string, text string")
    (r,) = periodic_runs(long, "name").collect()
    assert [tuple(x) for x in r.runs] == [(1, 900_000, 3)] and r.collapsed == "x ab cd ef y" and r.n_words == 900_002


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, texts):
    seen = 0
    for r in op12(spark, "/root/testdata/sf0.001").collect():
        words = planted(r.doc_id, texts[r.doc_id])
        runs = brute_fast(words)
        seen += len(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert seen > 10
