import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repeatwise.llm.quality import FEATURES, LEAST_SPREAD, P, chi_square_quantile, kept_documents, quality_verdicts, robust_estimates


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeat = len({i + d for i, x in enumerate(windows) if often[x] > 1 for d in range(3)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def check(df):
    got = quality_verdicts(df).collect()
    want = Counter((r.doc_id, *base(r.text)) for r in df.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    return got


def test_statistics_and_verdicts(spark, documents):
    got = check(documents)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.98
    assert {r.doc_id: r.kept for r in got} == {r.doc_id: r.kept for r in quality_verdicts(documents.repartition(5)).collect()}


def test_edges(edges, nothing):
    check(edges)
    assert quality_verdicts(nothing).count() == 0
    assert kept_documents(edges).columns == edges.columns


def test_repeats_inside_a_text(spark):
    rows = [(1, "a b c a b c"), (2, "a a a a"), (3, "x y z q x y z"), (4, "l\nl\n\n \nl \nm"), (5, "a b")]
    check(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string"))


def test_estimates_withstand_outliers(spark):
    """A fifth of far points hardly moves the estimate, whose median distance is that of a chi-square."""
    rng = np.random.default_rng(1)
    clean = rng.normal(0, 1, (4000, P)) * [1, 0.5, 0.3, 0.4, 0.6] + [5, 2, 1, 1, 2]
    far = clean[:1000] + [0, 6, 5, 5, 6]
    rows = np.vstack([clean, far]).tolist()
    df = spark.createDataFrame([("g", *r) for r in rows], ["stratum", *FEATURES])
    (m,) = robust_estimates(df).collect()
    assert np.allclose([m[f"m{i}"] for i in range(P)], [5, 2, 1, 1, 2], atol=0.15)
    for i in range(P):
        spread = np.sqrt(sum(m[f"l{i}{j}"] ** 2 for j in range(i + 1)) * max(m["scale"], 1))
        assert 0.7 < spread / np.hypot(clean[:, i].std(), LEAST_SPREAD[i]) < 1.4


def test_chi_square_quantile():
    assert chi_square_quantile(0.5, 4) == pytest.approx(3.357, rel=0.01)
    assert chi_square_quantile(0.99, 4) == pytest.approx(13.277, rel=0.01)


def test_copies_do_not_pull(spark):
    """A third of equal texts in one source leaves the verdicts of the others alone."""
    normal = [(i, " ".join(f"w{(i * 31 + j * 7) % 997}q{j % (3 + i % 5)}" for j in range(60 + i % 200)), "en", "s") for i in range(600)]
    copies = [(1000 + i, " ".join(f"v{j}" for j in range(80)), "en", "s") for i in range(300)]
    schema = "doc_id long, text string, lang string, source string"
    alone = {r.doc_id: r.kept for r in quality_verdicts(spark.createDataFrame(normal, schema)).collect()}
    with_copies = {r.doc_id: r.kept for r in quality_verdicts(spark.createDataFrame(normal + copies, schema)).collect()}
    assert np.mean([alone[i] == with_copies[i] for i in alone]) > 0.99


def test_each_statistic_rejects_alone(spark):
    """Texts with heavy repeats, duplicate lines or symbols that pass the base rules are rejected, clean ones stay."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 8))))
    words = lambda n: [word() for _ in range(n)]
    clean = [(i, "\n".join(" ".join(words(8)) for _ in range(int(rng.integers(8, 30))))) for i in range(400)]
    planted = []
    for i in range(4):
        once, again = words(80), words(20)
        planted.append((1000 + i, " ".join(again + once[:40] + again + once[40:44])))  # 38% repeated words in one line
        planted.append((2000 + i, "\n".join(x for _ in range(18) for x in ("menu", " ".join(words(8))))))  # 17 of 36 lines, no repeated words
        planted.append((3000 + i, " ".join(w + "#|" * (j % 7 == 0) for j, w in enumerate(words(120)))))  # 5% symbols
    df = spark.createDataFrame([(*r, "en", "s") for r in clean + planted], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_verdicts(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert np.mean([got[i].kept for i, _ in clean]) > 0.98
    assert not any(got[i].kept for i, _ in planted)


def test_verdicts_change_smoothly_with_size(spark):
    """The same outlier in groups of all sizes: its distance grows with what is known of the group, and no size switches the rule."""
    rng = np.random.default_rng(5)
    words = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 8)))) for _ in range(n)]
    schema, distances = "doc_id long, text string, lang string, source string", {}
    bad = " ".join(w + "#|" * (j % 5 == 0) for j, w in enumerate(words(120)))
    pool = [" ".join(words(int(rng.integers(60, 200)))) for _ in range(420)]
    for size in (3, 190, 210):
        rows = [(i, t, "en", "s") for i, t in enumerate(pool[:size])] + [(9999, bad, "en", "s")]
        got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(rows, schema)).collect()}
        distances[size] = got[9999].distance
        assert np.mean([got[i].kept for i in range(size)]) > 0.97
    d = [distances[s] for s in (3, 190, 210)]
    assert d[0] < d[1] and d[2] / d[1] < 1.5 and not got[9999].kept
