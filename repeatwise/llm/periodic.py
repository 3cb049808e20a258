"""Periodic runs of words found through string synchronising sets.

A run is a maximal stretch of words whose smallest period ``q`` goes into it at least three times.

* Small periods (up to ``DIRECT``) are found by comparing the words with themselves ``q`` places on: the highly periodic regions.
* For larger ones, at each scale ``t`` = 8, 16, 32, ... every stretch of ``t`` words has a hash. Position ``i`` is selected if the
  smallest hash among the stretches that begin in ``i .. i + t`` begins at ``i`` or ``i + t``; stretches inside a region with a period of at
  most ``t / 3``, known from smaller scales, do not take part. The choice depends on the next ``2 t`` words only, so equal stretches
  are selected alike, at about ``2 / t`` of all positions.
* A run with ``1.5 t <= q < 3 t`` holds a selected position whose ``2 t`` words occur again ``q`` words later: the words the two
  copies share are at least ``2 q`` long, and if no position were selected there, they would have a period of at most ``t / 3``
  throughout, so ``q`` would not be the smallest. Pairs of selected positions with equal contexts at such a distance propose it.
* Every proposal is extended to both sides by comparing hashes of stretches, longest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Words, _MUL, mix, ragged, text_slices

DIRECT = 11  # periods compared directly; the first scale, 8, proposes periods from 12
LEAST_SCALE = 8
SLICE = 2_000_000  # bytes of text searched at once
_KEPT = 3  # every third power of two is kept for extending proposals
_NONE = np.uint64(2**64 - 1)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and past-the-end of every run of True."""
    edges = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _direct(x: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all stretches with a period up to ``DIRECT`` at least three times as long."""
    found = []
    for q in range(1, min(DIRECT, len(x) - 1) + 1):
        begin, end = _stretches((x[:-q] == x[q:]) & (np.arange(q, len(x)) < stop[:-q]))
        keep = end - begin >= 2 * q
        found.append(np.stack([begin[keep], end[keep] + q, np.full(int(keep.sum()), q)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _selected(hashes: np.ndarray, scale: int, stop: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Synchronising positions at one scale, in order; ``hashes`` are those of the stretches of ``scale`` words."""
    n = len(hashes)
    inside = regions[(regions[:, 2] * 3 <= scale) & (regions[:, 1] - regions[:, 0] >= scale)]
    value = hashes
    if len(inside):
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, inside[:, 0], 1)
        np.add.at(change, inside[:, 1] - scale + 1, -1)
        value = np.where(np.cumsum(change[:n]) > 0, _NONE, hashes)
    least, size = value, 1
    while size < scale:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[:-1], least[1:])  # scale + 1 stretches
    here = np.arange(len(least))
    chosen = (least != _NONE) & ((least == value[: len(least)]) | (least == value[scale : scale + len(least)]))
    return np.flatnonzero(chosen & (here + 2 * scale <= stop[: len(least)]))


def _proposals(places: np.ndarray, contexts: np.ndarray, scale: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances from 1.5 to 3 scales of selected positions of one text with equal contexts."""
    at, distance, step = [], [], 1
    while step < len(places):
        gap = places[step:] - places[:-step]
        if gap.min() >= 3 * scale:
            break
        good = (gap < 3 * scale) & (2 * gap >= 3 * scale) & (contexts[step:] == contexts[:-step]) & (places[step:] < stop[places[:-step]])
        at.append(places[:-step][good]), distance.append(gap[good])
        step += 1
    return (np.concatenate(at), np.concatenate(distance)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _chains(at: np.ndarray, distance: np.ndarray, scale: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last position and distance of proposals whose contexts overlap: they describe one stretch."""
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    new = np.ones(len(at), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (at[1:] > at[:-1] + 2 * scale) | (start[at[1:]] != start[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1], distance[first]


def _extended(levels: list[tuple[int, np.ndarray]], left: np.ndarray, right: np.ndarray, distance: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rows (start, end, period): the widest stretch around each chain in which words ``distance`` apart are equal."""
    first, last = start[left], stop[right] - distance  # limits of the left copy
    for size, hashes in reversed(levels):
        for ends, step in ((right, size), (left, -size)):
            live = np.arange(len(ends))
            while len(live):
                lo = ends[live] if step > 0 else ends[live] - size
                room = (lo + size <= last[live]) if step > 0 else (lo >= first[live])
                live, lo = live[room], lo[room]
                live = live[hashes[lo] == hashes[lo + distance[live]]]
                ends[live] += step
    return np.stack([left, right + distance, distance], axis=1)


def find_runs(x: np.ndarray, bounds: np.ndarray, least_length: int) -> np.ndarray:
    """Rows (start, end, period) of all runs in texts of word hashes; text ``d`` is ``x[bounds[d]:bounds[d + 1]]``."""
    if len(x) < 3:
        return np.zeros((0, 3), np.int64)
    sizes = np.diff(bounds)
    start, stop = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    regions = _direct(x, stop)
    longest, size, hashes, power, levels = int(sizes.max()), 1, x, 0, [(1, x)]
    while 9 * size <= 2 * longest or size < LEAST_SCALE:  # a run at this scale has at least 4.5 scales
        if 2 * size > len(x):
            break
        twice = mix(hashes[:-size] * _MUL + hashes[size:])
        if size >= LEAST_SCALE:
            places = _selected(hashes, size, stop, regions)
            at, distance = _proposals(places, twice[places], size, stop)
            if len(at):
                grown = _extended(levels, *_chains(at, distance, size, start), start, stop)
                regions = np.concatenate([regions, np.unique(grown[grown[:, 1] - grown[:, 0] >= 3 * grown[:, 2]], axis=0)])
        hashes, size, power = twice, size * 2, power + 1
        if power % _KEPT == 0:
            levels.append((size, hashes))
    regions = regions[regions[:, 1] - regions[:, 0] >= least_length]
    regions = regions[np.lexsort((regions[:, 2], regions[:, 1], regions[:, 0]))]
    smallest = np.ones(len(regions), bool)  # of the periods of one stretch the smallest is its own
    smallest[1:] = (regions[1:, :2] != regions[:-1, :2]).any(axis=1)
    regions = regions[smallest]
    return regions[np.lexsort((regions[:, 2], regions[:, 0]))]


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Texts of the kept words joined by one space."""
    sizes = (words.ends - words.starts)[kept] + 1
    padded = np.append(words.bytes, np.uint8(32))
    data = padded[ragged(words.starts[kept], sizes)]
    ends = np.cumsum(sizes)
    data[ends - 1] = 32
    running = np.concatenate([[0], np.cumsum(kept)])
    counts = running[words.first[1:]] - running[words.first[:-1]]
    last = np.cumsum(counts)[counts > 0] - 1  # the last kept word of a text has no space behind it
    solid = np.ones(len(data), bool)
    solid[ends[last] - 1] = False
    bounds = np.concatenate([[0], np.cumsum(sizes - np.isin(np.arange(len(sizes)), last))])
    offsets = np.concatenate([[0], bounds[np.cumsum(counts)]])
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[solid].tobytes()))


def _search(batches, least_length: int):
    for batch, texts in text_slices(batches, SLICE):
        words = Words(texts)
        runs = find_runs(words.hashes, words.first, least_length)
        begin, end, period = runs.T
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, begin + period, 1)
        np.add.at(change, end, -1)
        document = np.searchsorted(words.first, begin, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (begin - words.first[document], end - begin, period)], ["start", "length", "period"])
        cuts = np.searchsorted(begin, words.first)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), _joined(words, np.cumsum(change[:-1]) == 0).cast(pa.string())],
            ["key", "n_words", "runs", "collapsed"],
        )


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 24) -> DataFrame:
    """Periodic runs of every whole text: ``<key>, n_words, runs, collapsed``, one row for each row of ``df``.

    ``runs`` lists (start, length, period) in words from 0, by start, then period: every stretch of at least ``least_length`` words
    and three times its smallest period that no neighbouring word extends. ``collapsed`` is the text without the words that any
    run holds behind its first period, words joined by one space.

    Words are compared by the hashes of ``Words``. Null and empty texts have no words; keys of any type may be null or repeat; other
    columns are ignored; empty tables give no rows. There is no shuffle; a text is searched in one task, in memory for its words.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    layout = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(lambda batches: _search(batches, least_length), layout).withColumnRenamed("key", key)
