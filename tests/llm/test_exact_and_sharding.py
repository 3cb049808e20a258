import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from repeatwise.llm.exact import drop_exact_copies, exact_copies
from repeatwise.llm.sharding import balanced_tree, descend, shard_rows


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_copies(df, **settings):
    rows = df.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r.text)].append(r.doc_id)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    want = Counter((r.doc_id, least[plain(r.text)], len(groups[plain(r.text)]), hashlib.sha256(plain(r.text).encode()).hexdigest()) for r in rows)
    got = exact_copies(df, **settings).collect()
    assert Counter((r.doc_id, r.keep_key, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_key for r in kept)


def test_exact_copies(documents, edges, nothing):
    check_copies(documents)
    check_copies(documents, support=0.2)  # nothing is frequent
    check_copies(edges)
    check_copies(edges, support=0.01)
    assert exact_copies(nothing).count() == 0
    kept = drop_exact_copies(edges)
    assert kept.columns == edges.columns and kept.count() == len({plain(r.text) for r in edges.collect()})


def test_all_rows_equal(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "'same text' AS text")
    assert drop_exact_copies(df).collect() == [(0, "same text")]


def check_shards(df):
    rows = shard_rows(df, balanced_tree(8), balanced_tree(9)).collect()
    source = df.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard <= 7 and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_shards(documents, edges, nothing):
    rows = check_shards(documents)
    assert min(Counter(r.shard for r in rows).values()) > 0.4 * len(rows) / 8
    check_shards(edges)
    assert shard_rows(nothing, balanced_tree(8), balanced_tree(9)).count() == 0


def draw(key, level, children):
    """The documented draw, with the public hash."""
    import math

    def seed(text, start):
        return xxhash.xxh64_intdigest(text.encode(), seed=start)

    scores = []
    for name, weight in children:
        u = ((seed(f"{level}:{name}", seed(key, 42)) >> 11) + 0.5) * 2.0**-53
        scores.append((-math.log(u) / weight, name))
    return min(scores)[1] if len(scores) > 1 else scores[0][1]


def test_descent_and_movement(spark):
    tree = {"r0": {"k0": {0: 1.0, 1: 2.0}, "k1": {2: 1.0}}, "r1": {"k2": {3: 1.0, 4: 1.0}}}
    heavier = {"r0": {"k0": {0: 1.0, 1: 4.0}, "k1": {2: 1.0}}, "r1": {"k2": {3: 1.0, 4: 1.0}}}
    keys = spark.range(4000).selectExpr("CAST(id AS string) AS by")
    rows = descend(descend(keys, tree, ["by"]), heavier, ["by"], "new_").collect()
    for r in rows[:300]:
        region = draw(r.by, "region", [("r0", 4.0), ("r1", 2.0)])
        rack = draw(r.by, f"rack of {region}", [("k0", 3.0), ("k1", 1.0)] if region == "r0" else [("k2", 2.0)])
        shard = draw(r.by, f"shard of {rack}", [(s, w) for s, w in tree[region][rack].items()])
        assert (r.region, r.rack, r.shard) == (region, rack, shard)
    share = Counter(r.shard for r in rows)
    assert abs(share[1] / 4000 - 2 / 6) < 0.03
    for r in rows:  # weights rose in r0 and k0 only: nothing moves between other shards or out of the subtree
        if r.shard != r.new_shard:
            assert r.new_region == "r0" and (r.region == "r1" or r.new_rack == "k0") and (r.rack != "k0" or r.new_shard == 1)
