"""Bigram language model with deleted interpolation.

``P(w | u) = a[b] c(u, w) / c(u) + b[b] c(w) / N + c[b] / (V + 1)`` with maximum-likelihood estimates from counts and weights for
each bucket ``b`` of the context's frequency. The weights are learned by expectation-maximisation: a tenth of the training texts is
deleted from the counts and the weights are those under which it is likeliest.

Texts are packed into slices. A slice asks each key range once for the counts of its distinct words and word pairs and adds its own
counts at the same time, so a frequent word or pair is one entry for each slice, and no count table is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .common import parallelism
from .words import END, Words, mix, text_slices

SLICE = 8_000_000  # bytes of text handled at a time
HELD_OUT, DELETED = 0, 1  # crc32(key) mod 10 of texts never learned from, and of those that teach the weights
START = np.uint64(0xA0761D6478BD642F)
BUCKETS = 64
_U = np.uint64
_MUL = _U(0xE7037ED1A0B428DB)


class Tokens:
    """Tokens of a slice (each text's words, then the end): distinct words and pairs in order, and each token's place among them."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        self.first = words.first + np.arange(len(texts) + 1)
        ends = self.first[1:] - 1
        tokens = np.empty(int(self.first[-1]), _U)
        inside = np.ones(len(tokens), bool)
        inside[ends] = False
        tokens[inside] = words.hashes
        tokens[ends] = END
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first[:-1]] = START
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.pairs, at, self.pair = np.unique(mix(before * _MUL + tokens), return_index=True, return_inverse=True)
        self.pair_word = self.word[at]  # second word of each pair
        places = np.searchsorted(self.words, before[at])
        places[places == len(self.words)] = 0
        self.pair_context = np.where(self.words[places] == before[at], places, -1)  # first word of each pair, -1 for the start
        self.end = int(np.searchsorted(self.words, END))


def _pack(batches):
    """Rows of texts packed by class: (slice, learned, deleted, keys, held_out, texts)."""
    number = TaskContext.get().partitionId() << 32
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch, texts in text_slices(batches, SLICE):
        tenth = batch.column(2).to_numpy(zero_copy_only=False)
        for deleted in (False, True):
            mine = np.flatnonzero((tenth == DELETED) == deleted)
            if len(mine):
                own = texts.take(pa.array(mine))
                sizes = np.diff(np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1])
                data = own.buffers()[2]
                raw = data.to_pybytes()[: int(sizes.sum())] if data is not None else b""
                columns = [number, deleted, squeeze.compress(raw), sizes.tobytes(), (tenth[mine] == HELD_OUT).tobytes()]
                keys = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), batch.column(0).take(pa.array(mine)))
                yield pa.RecordBatch.from_arrays([*[pa.array([c]) for c in columns], keys], ["slice", "deleted", "texts", "sizes", "held_out", "keys"])
                number += 1


def _texts(row: dict) -> pa.Array:
    sizes = np.frombuffer(row["sizes"], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["texts"]) if sizes.sum() else b""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(raw))


WORD, PAIR, TOTAL = 0, 1, 2


def _ask(batches, ranges: int):
    for batch in batches:
        for row in batch.to_pylist():
            tokens = Tokens(_texts(row))
            learned = np.repeat(~np.frombuffer(row["held_out"], bool), np.diff(tokens.first))
            rows = []
            for kind, keys, place in ((WORD, tokens.words, tokens.word), (PAIR, tokens.pairs, tokens.pair)):
                counts = np.bincount(place, weights=learned, minlength=len(keys)).astype(np.uint32)
                which = ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
                cuts = np.searchsorted(which, np.arange(ranges + 1))
                rows += [(row["slice"], row["deleted"], kind, r, keys[a:b].tobytes(), counts[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["slice", "deleted", "kind", "range", "keys", "counts"])


def _answer(table: pa.Table) -> pa.Table:
    """Counts of each slice's keys over all learned texts and without the deleted ones, then the totals of the range's words."""
    kind, number = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
    keys = [np.frombuffer(x, _U) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    sizes = np.array([len(x) for x in keys])
    deleted = table.column("deleted").to_numpy()
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint32)
    kept = np.bincount(place, weights=counts * ~np.repeat(deleted, sizes), minlength=len(distinct)).astype(np.uint32)
    rows, at = [], 0
    for slice_no, gone, n in zip(table.column("slice").to_pylist(), deleted, sizes):
        mine = place[at : at + n]
        at += n
        rows.append((slice_no, kind, number, every[mine].tobytes(), kept[mine].tobytes() if gone else b"", 0, 0, 0, 0))
    if kind == WORD:
        rows.append((None, TOTAL, number, b"", b"", int(every.sum()), int((every > 0).sum()), int(kept.sum()), int((kept > 0).sum())))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["slice", "kind", "range", "every", "kept", "n", "v", "n_kept", "v_kept"])


_ANSWER = "slice long, kind int, range int, every binary, kept binary, n long, v long, n_kept long, v_kept long"


def _counts(answers: list[dict], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a slice's words and pairs from its answers, which come by kind and range."""
    ordered = sorted(answers, key=lambda a: (a["kind"], a["range"]))
    return tuple(np.frombuffer(b"".join(a[name] for a in ordered if a["kind"] == kind), np.uint32).astype(np.int64) for kind in (WORD, PAIR))


def _estimates(tokens: Tokens, words: np.ndarray, pairs: np.ndarray, n: int, v: int):
    """Bucket, conditional and unconditional estimate of each distinct pair."""
    context = np.where(tokens.pair_context >= 0, words[tokens.pair_context], words[tokens.end])  # as many starts as ends
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return bucket, pairs / np.maximum(context, 1), words[tokens.pair_word] / max(n, 1)


def _events(batches, n: int, v: int):
    """Bucket, estimates and number of each distinct pair of the deleted texts, from the counts without them."""
    for batch in batches:
        for row in batch.to_pylist():
            tokens = Tokens(_texts(row))
            bucket, two, one = _estimates(tokens, *_counts(row["answers"], "kept"), n, v)
            seen = np.bincount(tokens.pair, minlength=len(tokens.pairs))
            values = bucket.astype(np.uint8), two.astype(np.float32), one.astype(np.float32), seen.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], ["bucket", "two", "one", "seen"])


def _expect(batches, weights: np.ndarray, v: int):
    """Expected number of events that each estimate explains, by bucket."""
    sums = np.zeros((3, BUCKETS))
    for batch in batches:
        for row in batch.to_pylist():
            bucket = np.frombuffer(row["bucket"], np.uint8)
            parts = np.stack([np.frombuffer(row["two"], np.float32), np.frombuffer(row["one"], np.float32), np.full(len(bucket), 1 / (v + 1))]) * weights[:, bucket]
            parts *= np.frombuffer(row["seen"], np.uint32) / np.maximum(parts.sum(axis=0), 1e-300)
            sums += np.stack([np.bincount(bucket, weights=p, minlength=BUCKETS) for p in parts])
    yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), *[pa.array(s) for s in sums]], ["bucket", "two", "one", "none"])


def learn_weights(events: DataFrame, v: int, tolerance: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (3 x BUCKETS) by expectation-maximisation; stops when no weight of a bucket with events moves by ``tolerance``."""
    weights = np.full((3, BUCKETS), 1 / 3)
    for _ in range(rounds):
        sums = np.zeros((3, BUCKETS))
        expected = events.mapInArrow(lambda b: _expect(b, weights, v), "bucket int, two double, one double, none double")
        for row in expected.groupBy("bucket").agg(F.sum("two"), F.sum("one"), F.sum("none")).collect():  # BUCKETS rows
            sums[:, row[0]] = row[1:]
        total = sums.sum(axis=0)
        moved = np.where(total > 0, sums / np.maximum(total, 1e-300), weights)
        done = np.abs(moved - weights).max() < tolerance
        weights = moved
        if done:
            break
    # every estimate keeps a trifle, so that no word is impossible
    weights = np.maximum(weights, 1e-6)
    return weights / weights.sum(axis=0)


def _score(batches, weights: np.ndarray, n: int, v: int):
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("keys"))
        for at, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
            tokens = Tokens(_texts(row))
            words, pairs = _counts(row["answers"], "every")
            bucket, two, one = _estimates(tokens, words, pairs, n, v)
            pair_score = np.log10(weights[0][bucket] * two + weights[1][bucket] * one + weights[2][bucket] / (v + 1))
            word_base = np.log10((words + 0.1) / (n + 0.1 * (v + 1)))
            first = tokens.first[:-1]
            sums = [np.add.reduceat(x, first) for x in (pair_score[tokens.pair], word_base[tokens.word], (words > 0)[tokens.word].astype(np.int64))]
            score, base, known = sums
            yield pa.RecordBatch.from_arrays(
                [keys[at].values, pa.array(np.frombuffer(row["held_out"], bool)), pa.array(np.diff(tokens.first)), pa.array(known), pa.array(base), pa.array(score)],
                ["key", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of every whole text: ``<key>, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Texts whose ``crc32(key as text) mod 10`` is 0 (``held_out``) are never learned from. Tokens are words with A-Z lower-cased and one end
    for each text; null texts count as empty, null keys as the text ``null``. ``n_known`` counts tokens seen in training, ``train_tokens``
    all training tokens, ``base_score`` is the unigram score with 0.1 added to each count. Each row of ``df`` is scored by itself,
    repeated rows get equal scores; other columns are ignored; empty tables give no rows. Words and pairs are known by 64-bit hashes.
    """
    kind = df.schema[key].dataType.simpleString()
    tenth = F.crc32(F.coalesce(df[key].cast("string"), F.lit("null")).cast("binary")) % 10
    rows = df.select(df[key].alias("key"), df[text].alias("text"), tenth.cast("int").alias("tenth"))
    slices = written(rows.mapInArrow(_pack, f"slice long, deleted boolean, texts binary, sizes binary, held_out binary, keys array<{kind}>"), "slices")
    ranges = parallelism(df)
    asked = slices.drop("keys").mapInArrow(lambda b: _ask(b, ranges), "slice long, deleted boolean, kind int, range int, keys binary, counts binary")
    answers = written(asked.groupBy("kind", "range").applyInArrow(_answer, _ANSWER), "counts")
    totals = answers.filter(F.col("kind") == TOTAL).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n_kept", "v_kept")]).first()
    n, v, n_kept, v_kept = totals

    to_slice = answers.filter(F.col("kind") != TOTAL)
    packed = lambda rows: rows.groupBy("slice").agg(F.collect_list(F.struct("kind", "range", "every", "kept")).alias("answers"))
    deleted = slices.filter("deleted").drop("keys")
    events = deleted.join(packed(to_slice.join(deleted.select("slice"), "slice", "left_semi")), "slice").mapInArrow(lambda b: _events(b, n_kept, v_kept), "bucket binary, two binary, one binary, seen binary")
    weights = learn_weights(written(events, "events"), v_kept)
    scored = slices.join(packed(to_slice.drop("kept").withColumn("kept", F.lit(b""))), "slice").mapInArrow(
        lambda b: _score(b, weights, n, v), f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
