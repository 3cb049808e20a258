import math
import zlib
from collections import Counter

from repeatwise.llm.interpolation import score_texts

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    tokens = [(k, (t or "").encode().translate(LOWER).split() + [None]) for k, t in rows]
    held = lambda k: zlib.crc32(("null" if k is None else str(k)).encode()) % 10 == 0
    c = Counter(w for k, ws in tokens for w in ws if not held(k))
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    want = Counter((k, held(k), len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 5)) for k, ws in tokens)
    got = score_texts(df).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    return got


def test_documents(documents):
    held = [r for r in check(documents) if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_log_probabilities(spark):
    """Over all words of a small vocabulary the probabilities after one context add up to no more than one."""
    train = [(i, " ".join("ab"[(i + j) % 2] for j in range(5))) for i in range(200)]
    probes = [(1000 + i, w) for i, w in enumerate(["a", "b", "new"])]
    rows = check(spark.createDataFrame(train + probes, "doc_id long, text string"))
    scores = {r.doc_id: r.score for r in rows}
    end = min(scores.values())
    assert 0 < sum(10 ** scores[k] for k, _ in probes) < 1 and end < 0


def test_edges(edges, nothing):
    check(edges)
    assert score_texts(nothing).count() == 0
