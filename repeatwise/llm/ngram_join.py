"""Jaccard join of n-gram sets by prefix filtering and prefix trees.

1. A first pass makes each document's set of shingles; equal sets are one node. A counting sketch of fixed size estimates how
   many documents hold a shingle.
2. All sets are ordered alike, rare shingles first. Two sets with enough in common share several shingles among the first of each
   (its prefix; ``needed`` says how many), and the first of those lies in the ``front_length`` first of each. Slices of documents
   send their prefix shingles to key ranges, which count for every two documents the shingles they share; couples that share
   enough, their frequent shingles counted as shared, meet in the bucket of the smaller one. The documents that have a frequent
   shingle in front meet in the bucket of the smallest of them, by windows of sizes; a slice sends such a shingle once, and its other
   documents join that leader by key, so no range gathers them.
3. The sets of a bucket are stored in a prefix tree, in one order for the bucket. Each set walks the tree: what a path has in common
   with it is counted once for all sets below, and subtrees are left out when their remaining length cannot reach the bound or
   when all their sets are already connected with it. Buckets over ``CHUNK`` sets are split; sets the leader does not reach
   visit the other chunks, in slices of a chunk's size, so a task holds two chunks at most.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import identified, parallelism, smallest_labels
from .words import Words, grams, mix, ragged, text_slices

SHINGLE = 5
WIDTH = 1 << 20  # counters of the sketch
BLOCK = 1 << 14
CHUNK = 1000  # sets compared in one tree
SMALL = 32  # documents of a key up to which pairs are counted; documents with a more frequent key in front meet in the bucket of the smallest
SLICE = 8_000_000  # bytes of text handled at a time
_U = np.uint64


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence is the one shingle of a text with fewer than ``k`` words."""
    hashes = grams(words.hashes, k)
    sets = []
    for first, stop in zip(words.first.tolist(), words.first[1:].tolist()):
        n = stop - first
        if n >= k:
            sets.append(np.unique(hashes[first : stop - k + 1]))
        else:
            sets.append(mix(grams(words.hashes[first:stop], n) ^ _U(n)) if n else np.zeros(0, _U))
    return sets


def needed(n):
    """How many prefix shingles two linked sets of at least ``n`` shingles share."""
    return 1 + n // 20


def prefix_length(n: int) -> int:
    """Two sets with fewer than ``needed`` shingles in common among so many first ones cannot reach 4/5 of their union."""
    return n - -(-4 * n // 5) + needed(n) if n else 0


def front_length(n: int) -> int:
    """The first shingle that two linked sets share is among so many first ones of each: the rest is too short for all they share."""
    return n - -(-4 * n // 5) + 1 if n else 0


def linked(overlap, n, m):
    """100 * intersection >= 80 * union."""
    return 9 * overlap >= 4 * (n + m)


# -- passes over the documents


def _describe(batches, k: int):
    """Rows with size and digest of each set, then the counters of the task's sketch in blocks."""
    sketch = np.zeros(WIDTH, np.int64)
    names = ["_id", "n", "digest", "block", "counts"]
    for batch, texts in text_slices(batches, SLICE):
        sets = shingle_sets(Words(texts, lower=True), k)
        sketch += np.bincount((np.concatenate(sets) & _U(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *none], names)
    if sketch.any():
        blocks = [zstandard.compress(b.tobytes()) for b in np.split(sketch, WIDTH // BLOCK)]
        none = pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.binary())
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names)


def _add_blocks(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[block] = sums.get(block, 0) + np.frombuffer(zstandard.decompress(counts), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])


def _prefixes(batches, sketch: np.ndarray, k: int):
    """For each slice of documents the entries (key, id, size code, whether in front) of their prefixes, sorted by key and id.

    Equal sets of a slice are there once, with the smallest id.
    """
    for batch, texts in text_slices(batches, SLICE):
        first: dict[bytes, tuple[int, np.ndarray]] = {}
        for i, s in zip(batch.column(0).to_pylist(), shingle_sets(Words(texts, lower=True), k)):
            if len(s) and i < first.get(d := hashlib.blake2b(s.tobytes(), digest_size=16).digest(), (i + 1,))[0]:
                first[d] = i, s
        if first:
            keys = [s[np.lexsort((s, sketch[(s & _U(WIDTH - 1)).astype(np.int64)]))[: prefix_length(len(s))]] for _, s in first.values()]
            counts = [len(x) for x in keys]
            ids = np.repeat(np.array([i for i, _ in first.values()], np.int64), counts)
            codes = np.repeat(np.array([size_code(len(s)) for _, s in first.values()], np.uint8), counts)
            front = np.concatenate([np.arange(c) < front_length(len(s)) for c, (_, s) in zip(counts, first.values())])
            keys = np.concatenate(keys)
            order = np.lexsort((ids, keys))
            yield keys[order], ids[order], codes[order], front[order]


def size_code(n: int) -> int:
    """Size in steps of an eighth of a power of two: sizes within 5 : 4 differ by 3 steps at most."""
    return math.floor(8 * math.log2(n))


def least_size(code: np.ndarray) -> np.ndarray:
    return np.floor(2.0 ** (code / 8) + 1e-6).astype(np.int64)


def in_windows(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by (key, window of size codes), sorted: the mixed key, the id and the entry's place. A window has eight codes and the
    three that follow, so sizes within 5 : 4 have one in common."""
    window = codes.astype(np.int64) // 8
    second = np.flatnonzero((codes % 8 < 3) & (window > 0))
    place = np.concatenate([np.arange(len(keys)), second])
    both = mix(keys[place] ^ mix(np.concatenate([window, window[second] - 1]).astype(_U)))
    order = np.lexsort((ids[place], both))
    return both[order], ids[place][order], place[order]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _sums(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their counts."""
    order = np.argsort(ids, kind="stable")
    starts, _ = _groups(ids[order])
    return ids[order][starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _packed(which: np.ndarray, ranges: int, columns: list[np.ndarray]) -> list[list[bytes]]:
    """Bytes of each column for each range; ``which`` is ascending."""
    cuts = np.searchsorted(which, np.arange(ranges + 1))
    return [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for x in columns]


def _by_document(ids: np.ndarray, counts: np.ndarray, ranges: int) -> list[list[bytes]]:
    """How many frequent keys each document has, for each range of documents."""
    ids, counts = _sums(ids, counts)
    part = _parts(mix(ids.view(_U)), ranges)
    order = np.argsort(part, kind="stable")
    return _packed(part[order], ranges, [ids[order], counts[order].astype(np.uint32)])


def _ask(batches, sketch: np.ndarray, k: int, ranges: int):
    """Prefix entries of each slice by key range. Of a key with over SMALL documents in the slice only the smallest goes and the smallest
    of each window with the key in front, marked; how many such keys a document has goes to the document's range. The documents that have
    such a key in front follow in a row of their own (range -1), by key and window: what was left out and what is offered later come
    from one slice."""
    for keys, ids, codes, front in _prefixes(batches, sketch, k):
        starts, sizes = _groups(keys)
        many = np.repeat(sizes > SMALL, sizes)
        keep = ~many
        keep[starts] = True
        inside = np.flatnonzero(many & front)
        mixed, members, place = in_windows(keys[inside], ids[inside], codes[inside])
        keep[inside[place[_groups(mixed)[0]]]] = True
        documents = _by_document(ids[many], np.ones(many.sum(), np.int64), ranges)
        keys, ids, codes, front, many = keys[keep], ids[keep], codes[keep], front[keep], many[keep]
        columns = _packed(_parts(keys, ranges), ranges, [keys, ids, codes, front, many]) + documents
        full = [r for r in range(ranges) if columns[0][r] or documents[0][r]]
        rest = [mixed.tobytes(), members.tobytes(), *[None] * (len(columns) - 2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *full], pa.int32())] + [pa.array([x, *[c[r] for r in full]], pa.binary()) for x, c in zip(rest, columns)],
            ["range", "keys", "ids", "codes", "front", "many", "docs", "frequent"],
        )


PAIR, LARGE, KEY = 0, 1, 2
_ANSWER = "kind int, key long, a long, b long, part int, firsts binary, seconds binary, shared binary, need binary, docs binary, frequent binary"


def _parts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _answer(table: pa.Table, ranges: int) -> pa.Table:
    """What a range's keys say: pairs of documents with the number of keys they share (keys of up to SMALL documents) and the number of
    larger keys of each document, packed for each range of documents, (leader, member) of larger keys in front, and the leaders
    of keys that a slice did not send in full."""
    kinds = (("keys", _U), ("ids", np.int64), ("codes", np.uint8), ("front", bool), ("many", bool), ("docs", np.int64), ("frequent", np.uint32))
    keys, ids, codes, front, many, docs, frequent = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in kinds)
    order = np.lexsort((ids, keys))
    keys, ids, codes, front, many = keys[order], ids[order], codes[order], front[order], many[order]
    starts, sizes = _groups(keys)
    marked = np.add.reduceat(many, starts) > 0 if len(starts) else np.zeros(0, bool)
    large = marked | (sizes > SMALL)

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, SMALL + 1):
        own = starts[(sizes == m) & ~large]
        if len(own):
            i, j = np.triu_indices(m, 1)
            left.append((own[:, None] + i).ravel()), right.append((own[:, None] + j).ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    near = np.abs(codes[left].astype(np.int64) - codes[right]) <= 3
    left, right = left[near], right[near]
    a, b, need = ids[left], ids[right], needed(least_size(np.minimum(codes[left], codes[right])))
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    shared = np.diff(np.append(new, len(a)))
    a, b, need = a[new], b[new], need[new]
    part = _parts(mix(a.view(_U)), ranges)
    order = np.argsort(part, kind="stable")
    packed = _packed(part[order], ranges, [a[order], b[order], shared[order].astype(np.uint32), need[order].astype(np.uint32)])
    here = np.repeat(large, sizes)
    lone = here & ~many  # the others were counted by their slices
    packed += _by_document(np.concatenate([docs, ids[lone]]), np.concatenate([frequent.astype(np.int64), np.ones(lone.sum(), np.int64)]), ranges)
    full = [r for r in range(ranges) if packed[0][r] or packed[4][r]]

    inside = np.flatnonzero(here & front)
    mixed, members, place = in_windows(keys[inside], ids[inside], codes[inside])
    begin, counts = _groups(mixed)
    leader = np.repeat(members[begin], counts)
    pairs = np.unique(np.stack([leader, members], axis=1)[leader != members], axis=0).reshape(-1, 2)
    sent = begin[np.add.reduceat(np.repeat(marked, sizes)[inside[place]], begin) > 0] if len(begin) else begin
    kinds = np.repeat([PAIR, LARGE, KEY], [len(full), len(pairs), len(sent)])
    none = len(pairs) + len(sent)
    columns = [
        pa.array(kinds, pa.int32()), pa.array(np.concatenate([np.zeros(len(full) + len(pairs), np.int64), mixed[sent].view(np.int64)])),
        pa.array(np.concatenate([np.zeros(len(full), np.int64), pairs[:, 0], members[sent]])), pa.array(np.concatenate([np.zeros(len(full), np.int64), pairs[:, 1], members[sent]])),
        pa.array(full + [None] * none, pa.int32()), *[pa.array([x[r] for r in full] + [None] * none, pa.binary()) for x in packed],
    ]
    return pa.table(columns, ["kind", "key", "a", "b", "part", "firsts", "seconds", "shared", "need", "docs", "frequent"])


def _couples(table: pa.Table) -> pa.Table:
    """Pairs of one range that share as many prefix keys as they need in all, if they share all frequent keys of the first."""
    kinds = (("firsts", np.int64), ("seconds", np.int64), ("shared", np.uint32), ("need", np.uint32), ("docs", np.int64), ("frequent", np.uint32))
    *parts, docs, frequent = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in kinds)
    order = np.lexsort((parts[1], parts[0]))
    a, b, shared, need = (x[order] for x in parts)
    if not len(a):
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    shared = np.add.reduceat(shared.astype(np.int64), new)
    docs, frequent = _sums(docs, frequent.astype(np.int64))
    if len(docs):
        at = np.minimum(np.searchsorted(docs, a[new]), len(docs) - 1)
        shared += np.where(docs[at] == a[new], frequent[at], 0)
    enough = shared >= need[new]
    return pa.table({"a": pa.array(a[new][enough]), "b": pa.array(b[new][enough])})


def _others(batches):
    """Rows of range -1 unpacked: documents with a key in front that their slice did not send in full, by key and window."""
    for batch in batches:
        for keys, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(ids, np.int64))], ["key", "member"])


SLOTS = 1 << 25  # bits that say which documents may be needed: 4 MB, whatever the input


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) & _U(SLOTS - 1)).astype(np.int64)


def _mark(batches):
    """Bits of a task's ids, in compressed blocks."""
    wanted = np.zeros(SLOTS, bool)
    for batch in batches:
        wanted[_slots(batch.column(0).to_numpy(zero_copy_only=False))] = True
    if wanted.any():
        blocks = np.split(np.packbits(wanted), 64)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([zstandard.compress(b.tobytes()) for b in blocks], pa.binary())], ["block", "bits"])


def _merge_marks(batches):
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            merged[block] = merged.get(block, 0) | np.frombuffer(zstandard.decompress(bits), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(merged.keys(), pa.int32()), pa.array([b.tobytes() for b in merged.values()], pa.binary())], ["block", "bits"])


def _marked(batches, bits: np.ndarray):
    """Rows whose id may be needed."""
    for batch in batches:
        slot = _slots(batch.column(0).to_numpy(zero_copy_only=False))
        yield batch.filter(pa.array((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1))


def needed_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` that ``ids`` may name: a bit table of fixed size keeps most others out of the coming shuffle."""
    blocks = ids.mapInArrow(_mark, "block int, bits binary").repartition("block").mapInArrow(_merge_marks, "block int, bits binary")
    bits = np.zeros(SLOTS // 8, np.uint8)
    for row in blocks.collect():  # SLOTS bits at most
        bits[row["block"] * len(bits) // 64 : (row["block"] + 1) * len(bits) // 64] = np.frombuffer(row["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    return texts.mapInArrow(lambda b: _marked(b, shared.value), texts.schema)


# -- prefix trees


class PrefixTree:
    """Sets of small numbers, each in ascending order, stored by their common beginnings.

    A tree node holds the numbers between its parent's depth and its own; ``low`` to ``high`` are the sets below it (sets are kept in
    dictionary order), ``short`` and ``long`` the least and greatest of their sizes, ``whole`` a set that ends here.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in sets])
        common = np.zeros(len(sets) + 1, np.int64)  # with the set before
        for i in range(1, len(sets)):
            n = min(len(sets[i - 1]), len(sets[i]))
            differ = np.flatnonzero(sets[i - 1][:n] != sets[i][:n])
            common[i] = differ[0] if len(differ) else n
        rows, parts = [], []
        self.children: list[list[int]] = []
        todo = [(0, len(sets), 0, -1)]
        while todo:
            low, high, above, parent = todo.pop()
            depth = int(common[low + 1 : high].min()) if high - low > 1 else len(sets[low])
            me = len(rows)
            whole = low if len(sets[low]) == depth else -1
            part = sets[low][above:depth]
            sizes = self.sizes[low:high]
            rows.append((low, high, depth, int(part[-1]) if len(part) else -1, sizes.min(), sizes.max(), whole))
            parts.append(part)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            begin = low + (whole >= 0)
            if begin < high:
                cuts = [begin, *(begin + 1 + np.flatnonzero(common[begin + 1 : high] == depth)).tolist(), high]
                todo += [(a, b, depth, me) for a, b in zip(cuts, cuts[1:])]
        self.low, self.high, self.depth, self.last, self.short, self.long, self.whole = (np.array(x) for x in zip(*rows))
        self.count = np.array([len(p) for p in parts])
        self.begin = np.cumsum(self.count) - self.count
        self.numbers = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        kids = np.array([len(c) for c in self.children])
        self.kid_begin, self.kid_count = np.cumsum(kids) - kids, kids
        self.kids = np.array([c for x in self.children for c in x], np.int64)

    def linked_with(self, query: np.ndarray, flags: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places (in dictionary order) of the wanted sets that are linked with ``query``; ``flags`` marks its numbers."""
        n = len(query)
        below = np.concatenate([[0], np.cumsum(wanted)])
        nodes, shared, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            size = np.minimum(self.long[nodes], 5 * n // 4)
            alive = (below[self.high[nodes]] > below[self.low[nodes]]) & (5 * size >= 4 * n) & (size >= self.short[nodes])
            nodes, shared = nodes[alive], shared[alive]
            if not len(nodes):
                break
            counts = self.count[nodes]
            hits = np.concatenate([[0], np.cumsum(flags[self.numbers[ragged(self.begin[nodes], counts)]])])
            ends = np.cumsum(counts)
            shared = shared + hits[ends] - hits[ends - counts]
            done = self.whole[nodes]
            at_end = (done >= 0) & linked(shared, n, self.depth[nodes])
            found.append(done[at_end][wanted[done[at_end]]])
            rest = n - np.searchsorted(query, self.last[nodes], side="right")  # numbers of the query that may still come
            best = np.clip(self.depth[nodes] + rest, self.short[nodes], np.minimum(self.long[nodes], 5 * n // 4))
            able = linked(shared + np.minimum(rest, best - self.depth[nodes]), n, best) & (self.kid_count[nodes] > 0)
            nodes, shared = nodes[able], shared[able]
            counts = self.kid_count[nodes]
            shared = np.repeat(shared, counts)
            nodes = self.kids[ragged(self.kid_begin[nodes], counts)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets in numbers of one order: shingles that most sets of the bucket hold come first."""
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(rank[place], cuts)], len(values)


def connect(sets: list[np.ndarray], groups: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """Groups of the sets after all links that an asking set has; ``groups`` says which sets are already connected."""
    sets, width = _numbered(sets)
    tree = PrefixTree(sets)
    order = np.array(tree.order)
    groups = groups[order].copy()
    asks = asking[order]
    flags = np.zeros(width, np.int64)
    for at in np.flatnonzero(asks):
        wanted = groups != groups[at]
        wanted[:at] &= ~asks[:at]  # pairs of asking sets are met once
        if not wanted.any():
            continue
        query = sets[order[at]]
        flags[query] = 1
        for other in tree.linked_with(query, flags, wanted):
            a, b = sorted((groups[at], groups[other]))
            if a != b:
                groups[groups == b] = a
        flags[query] = 0
    out = np.empty_like(groups)
    out[order] = groups
    return out


def _sets(table: pa.Table, k: int) -> list[np.ndarray]:
    """Sets of a chunk. Texts travel rather than sets: they are smaller."""
    return shingle_sets(Words(table.column("text").combine_chunks(), lower=True), k)


def _compare(table: pa.Table, k: int) -> pa.Table:
    """Group of each set of a chunk: the smallest connected id."""
    ids = table.column("node").to_numpy()
    sets = _sets(table, k)
    groups = connect(sets, ids, np.ones(len(ids), bool))
    return pa.table({"leader": table.column("leader"), "chunk": table.column("chunk"), "node": table.column("node"), "head": pa.array(groups, pa.int64())})


def _visit(table: pa.Table, k: int) -> pa.Table:
    """Links between a slice of visitors from other chunks and the sets of a chunk, as (a, b)."""
    heads = table.column("head").to_numpy()
    visitor = table.column("visitor").to_numpy(zero_copy_only=False)
    if not visitor.any() or visitor.all():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sets = _sets(table, k)
    groups = connect(sets, heads, visitor)
    moved = np.unique(np.stack([groups, heads], axis=1)[groups != heads], axis=0).reshape(-1, 2)
    return pa.table({"a": pa.array(moved[:, 0].copy(), pa.int64()), "b": pa.array(moved[:, 1].copy(), pa.int64())})


def visits(stored: DataFrame, met: DataFrame, chunk: int) -> DataFrame:
    """Texts that meet after the chunks: sets that the leader does not reach, in slices of about ``chunk``, at each other chunk.

    A ``leader, chunk, slice`` holds the sets of one chunk and one slice of visitors, however many visitors the bucket has.
    """
    large = stored.filter("chunks > 1")
    away = met.filter("head <> leader AND node <> leader").join(large.select("leader", "chunk", "node", "chunks"), ["leader", "chunk", "node"])
    slices = written(away.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("slices")), "slices")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["leader", "chunk", "slice", "node", "head", "text"]
    homes = large.join(met, ["leader", "chunk", "node"]).join(slices, "leader").withColumn("slice", every("slices")).select(*columns, F.lit(False).alias("visitor"))
    moved = away.join(large.select("leader", "chunk", "node", "text"), ["leader", "chunk", "node"]).join(slices, "leader").withColumnRenamed("chunk", "home")
    moved = moved.withColumn("slice", F.pmod(F.xxhash64("node"), "slices")).withColumn("chunk", every("chunks")).filter("chunk <> home")
    return homes.union(moved.select(*columns, F.lit(True).alias("visitor")))


def similar_sets(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.8 or more.

    Returns ``_id, <key>, n_shingles, component_id, first``, one row per row of ``df`` (``first``: the row with the smallest ``_id`` of its
    component; ``_id`` identifies the row, see ``identified``); ``component_id`` is the smallest key, of any type, that links reach.
    Shingles are ``k`` consecutive words with A-Z lower-cased; a shorter text is one shingle; a text without words (null, empty) has an
    empty set and is linked with nothing. Repeated rows have equal sets and so one component; rows with null keys take part, and a
    component without any other key has a null id. Other columns are ignored; empty tables give no rows. All links between different sets
    count: candidates have no cap, and every set of a bucket is compared with every other unless the two are already connected.
    """
    return _similar(identified(df.select(df[key], df[text]), key, text=text), k, chunk).withColumnRenamed("key", key)


def _similar(docs: DataFrame, k: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """``similar_sets`` of rows ``_id, key, text``."""
    spark = docs.sparkSession
    texts = docs.select("_id", "text")
    described = written(texts.mapInArrow(lambda b: _describe(b, k), "_id long, n long, digest binary, block int, counts binary"), "sets")
    blocks = described.filter("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_add_blocks, "block int, counts binary")
    sketch = np.zeros(WIDTH, np.int64)
    for row in blocks.collect():  # WIDTH counters at most
        sketch[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    shared_sketch = spark.sparkContext.broadcast(sketch)

    rows = described.filter("block IS NULL").select("_id", "n", "digest")
    heads = rows.filter("n > 0").groupBy("digest").agg(F.min("_id").alias("node"))
    nodes = written(rows.join(heads, "digest", "left").select("_id", "n", F.coalesce("node", "_id").alias("node")), "nodes")

    ranges = parallelism(docs)
    questions = texts.mapInArrow(lambda b: _ask(b, shared_sketch.value, k, ranges), "range int, keys binary, ids binary, codes binary, front binary, many binary, docs binary, frequent binary")
    questions = written(questions, "questions")  # read twice, so both readings see the same slices
    answers = written(questions.filter("range >= 0").groupBy("range").applyInArrow(lambda t: _answer(t, ranges), _ANSWER), "answers")
    node = lambda c: nodes.select(F.col("_id").alias(c), F.col("node").alias(f"node_{c}"))
    counted = answers.filter(F.col("kind") == PAIR).select("part", "firsts", "seconds", "shared", "need", "docs", "frequent").groupBy("part").applyInArrow(_couples, "a long, b long")
    counted = counted.join(node("a"), "a").join(node("b"), "b").filter("node_a <> node_b")
    couples = written(counted.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "couples")
    # couples whose documents both go to the bucket of one smaller partner need no bucket of their own
    smallest = couples.groupBy("b").agg(F.min("a").alias("lead"))
    kept = couples.join(smallest, "b").join(smallest.select(F.col("b").alias("a"), F.col("lead").alias("lead_a")), "a", "left")
    kept = kept.filter("a = lead OR coalesce(lead_a, a) <> lead").select(F.col("a").alias("leader"), F.col("b").alias("node"))

    others = questions.filter("range = -1").select("keys", "ids").mapInArrow(_others, "key long, member long")
    more = others.join(answers.filter(F.col("kind") == KEY).select("key", "a"), "key").select("a", F.col("member").alias("b"))
    frequent = answers.filter(F.col("kind") == LARGE).select("a", "b").union(more).distinct().join(node("b"), "b")
    frequent = frequent.filter("a <> node_b").select(F.col("a").alias("leader"), F.col("node_b").alias("node"))
    pairs = written(kept.union(frequent).distinct(), "pairs")

    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    members = pairs.join(sizes, "leader").select("leader", "node", "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    leaders = sizes.select("leader", F.col("leader").alias("node"), "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    places = members.union(leaders)
    wanted = needed_texts(texts, pairs.select("node").union(pairs.select("leader"))).withColumnRenamed("_id", "node")
    # places grow with the input, so they are never broadcast
    stored = written(places.hint("merge").join(wanted, "node"), "buckets")
    met = stored.groupBy("leader", "chunk").applyInArrow(lambda t: _compare(t, k), "leader long, chunk long, node long, head long")
    met = written(met, "met")
    edges = met.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))

    across = visits(stored, met, chunk).groupBy("leader", "chunk", "slice").applyInArrow(lambda t: _visit(t, k), "a long, b long")

    labels = smallest_labels(edges.union(across))
    named = nodes.join(docs.select("_id", "key"), "_id")
    by_node = named.groupBy("node").agg(F.min("key").alias("key"), F.min("_id").alias("head"))
    by_node = written(by_node.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"), "key", "head"), "heads")
    components = written(by_node.groupBy("component").agg(F.min("key").alias("component_id"), F.min("head").alias("head")), "components")
    # written tables on both sides of each join, so that Spark can split the rows of one large component or node
    where = written(by_node.select("node", "component").join(components, "component").drop("component"), "where")
    return named.join(where, "node").select("_id", "key", F.col("n").alias("n_shingles"), "component_id", (F.col("_id") == F.col("head")).alias("first"))


def drop_similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` without all but the first of each component (see ``similar_sets``), with all their columns, whatever their names."""
    marked = identified(df, key, text=text)
    dropped = _similar(marked.select("_id", "key", "text")).filter(~F.col("first")).select("_id")
    return marked.join(dropped, "_id", "left_anti").select("row.*")
