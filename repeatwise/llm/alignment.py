"""Alignment of two tokenizers over the same bytes, labelled by pointer jumping.

The tokens of both tokenizers tile the bytes of a text. Each token points to the overlapping token that reaches farthest right;
successors are doubled until every token holds the terminal token of its component, and tokens with one terminal form a group.

1. A text is cut at single spaces where neither tokenizer can join the two sides, and each distinct piece, with the space in front of it, is
   encoded and aligned once.
   A slice of documents keeps its documents as numbers of pieces beside the groups of its distinct pieces as text.
2. The pairs of all slices are summed by a shuffle; a pair is there once a slice however often it occurs, so hot pairs stay small.
3. Each slice gets its pairs' counts back, reads the linked ids from the text of its groups and puts its documents together.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import written
from .token_counts import PATTERN, encode
from .words import ragged, text_slices

SLICE = 2_000_000  # bytes of text that share a list of pieces
CACHE = 100_000  # distinct pieces kept between slices
FRESH = 10_000  # pieces encoded at a time
SPACE = "▁"
#: Characters before and behind a single space at which no token of a byte-level vocabulary goes on: no blank is among them, and all of those
#: beyond ASCII are letters or signs by any table of characters.
PLAIN = "!-~À-ſ"
CUT = re.compile(f"(?<=[{PLAIN}])(?= [{PLAIN}])")
#: Texts that begin and end with such a character and hold no others but ASCII control characters and spaces.
SOUND = re.compile(f"[{PLAIN}](?:[\x00-\x1f {PLAIN}]*[{PLAIN}])?")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Vocabulary:
    """Bytes of every token, one after another."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[ids], self.sizes[ids])]


class ByteLevel(_Vocabulary):
    """A byte-level vocabulary; special tokens inside texts are plain text.

    Merges whose order is that of the merged tokens' ids are done by rank, which is several times faster; characters on whose class
    tables could differ are left to the vocabulary's own library.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        spell = lambda name: bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        super().__init__([spell(n) for n in names])
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"][a + b] for a, b in pairs]
        self.ranks = None
        if merged == sorted(merged) and len(merged) + 256 == len(model["vocab"]):
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={spell(n): i for n, i in model["vocab"].items()}, special_tokens={})

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each with a space in front, and their numbers. Sound pieces are joined and encoded together: no token goes over a cut."""
        sound = np.array([self.ranks is not None and SOUND.fullmatch(p) is not None for p in pieces], bool)
        joined = [" " + p for p, s in zip(pieces, sound) if s]
        first = np.array(encode(self.ranks, "".join(joined)) if joined else [], np.int64)
        ends = np.cumsum([len(p.encode()) for p in joined])
        first_counts = np.diff(np.searchsorted(np.cumsum(self.sizes[first]), ends, side="right"), prepend=0)
        other = [" " + p for p, s in zip(pieces, sound) if not s]
        second, second_counts = _flat([found.ids for found in self.library.encode_batch_fast(other, add_special_tokens=False)])
        counts = np.zeros(len(pieces), np.int64)
        counts[sound], counts[~sound] = first_counts, second_counts
        starts = np.cumsum(counts) - counts
        ids = np.empty(len(first) + len(second), np.int64)
        ids[ragged(starts[sound], first_counts)] = first
        ids[ragged(starts[~sound], second_counts)] = second
        return ids, counts


class Pieces(_Vocabulary):
    """A piece model, which puts a space before each text by itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)])
        #: A piece with a space behind another character could go on over a cut.
        self.cuts = not any(SPACE in n.lstrip(SPACE) for n in names)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.library.encode(pieces, num_threads=1))


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Terminal token of every token, A's tokens first, then B's; both lists of ends grow and end at the same byte.

    A token points to the overlapping token with the greatest end, of two such tokens to A's, and to itself if none reaches farther.
    Doubling halves the length of every chain, so a component of n tokens takes about log2(n) rounds.
    """
    n = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)  # tokens that hold the last byte of each
    successor = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor
        successor = farther


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group number of each A and each B token, and the A and B tokens that end together (one pair a group)."""
    n = len(ends_a)
    last = terminals(ends_a, ends_b)
    heads = np.flatnonzero(last[:n] == np.arange(n))
    group = np.searchsorted(heads, last)
    return group[:n], group[n:], heads, np.searchsorted(ends_b, ends_a[heads])


def rendered(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text ``a1,a2|b1;a3|b2,b3;`` in bytes, and where each group ends in it."""
    total = len(a) + len(b)
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
    ids, marks = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    marks[place_a[np.flatnonzero(np.diff(group_a, append=-1))]] = ord("|")
    ends = place_b[np.flatnonzero(np.diff(group_b, append=-1))]
    marks[ends] = ord(";")
    digits = len(str(max(int(ids.max()), 1))) if total else 1
    grid = np.empty((total, digits + 1), np.uint8)
    for k in range(digits):
        grid[:, digits - 1 - k] = ids // 10**k % 10 + ord("0")
    grid[:, digits] = marks
    shown = np.ones((total, digits + 1), bool)
    for k in range(1, digits):
        shown[:, digits - 1 - k] = ids >= 10**k
    return grid[shown], np.cumsum(shown.sum(axis=1))[ends]


def linked(groups: np.ndarray) -> np.ndarray:
    """Id pairs (A's in the upper half) that end each of the groups in the bytes of ``a1,a2|b1;a3|b2,b3;``."""

    def ids_before(ends: np.ndarray) -> np.ndarray:
        ids, scale, at = np.zeros(len(ends), np.int64), 1, ends - 1
        more = np.ones(len(ends), bool)
        while True:
            digit = groups[np.maximum(at, 0)].astype(np.int64) - ord("0")
            more &= (at >= 0) & (digit >= 0) & (digit < 10)
            if not more.any():
                return ids
            ids[more] += digit[more] * scale
            scale, at = scale * 10, at - 1

    return ids_before(np.flatnonzero(groups == ord("|"))) << 32 | ids_before(np.flatnonzero(groups == ord(";")))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each of the consecutive parts of ``values`` with the given numbers of values."""
    running = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


class _Numbers(dict):
    """Numbers of pieces; a new piece takes the next one. ``unsound`` are those at whose ends a text may not be cut."""

    def __init__(self):
        self.unsound: set[int] = set()

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        if SOUND.fullmatch(piece) is None:
            self.unsound.add(number)
        return number


class Aligner:
    """Pieces seen so far: their groups as text, their numbers of tokens and groups, and their linked id pairs."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.forget()

    def forget(self) -> None:
        self.number, self.texts = _Numbers(), []
        self.n_a = self.n_b = self.n_groups = self.pairs = self.at = np.zeros(0, np.int64)
        self.whole = np.zeros(0, bool)

    def numbers(self, text: str) -> list[int]:
        """Numbers of the pieces of a text. A piece is without the space in front of it."""
        if not text:
            return []
        if not self.b.cuts:
            return [self.number[text]]
        found = list(map(self.number.__getitem__, text.split(" ")))
        if self.number.unsound.isdisjoint(found):  # every space may be cut at
            return found
        return [self.number[piece[1:]] for piece in CUT.split(" " + text)]

    def learn(self) -> None:
        """Encode and align the pieces numbered since the last call, ``FRESH`` at a time."""
        fresh = list(self.number)[len(self.texts) :]
        parts = [self._aligned(fresh[i : i + FRESH]) for i in range(0, len(fresh), FRESH)]
        if not parts:
            return
        n_a, n_b, n_groups, pairs, whole = (np.concatenate(x) for x in zip(*parts))
        self.at = np.concatenate([self.at, len(self.pairs) + np.cumsum(n_groups) - n_groups])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.n_a, self.n_b, self.n_groups = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)))
        self.whole = np.concatenate([self.whole, whole])

    def _aligned(self, fresh: list[str]) -> tuple[np.ndarray, ...]:
        a, n_a = self.a.encode(fresh)
        b, n_b = self.b.encode(fresh)
        want = [b" " + f.encode() for f in fresh]
        sizes = np.array([len(w) for w in want], np.int64)
        data = np.frombuffer(b"".join(want), np.uint8)
        whole = self._spelt(self.a, a, n_a, data, sizes) & self._spelt(self.b, b, n_b, data, sizes)
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        group_a, group_b, end_a, end_b = align(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]))
        text, text_ends = rendered(a, b, group_a, group_b)
        owner = np.repeat(np.arange(len(fresh)), n_a)[end_a]  # no group crosses a piece: both tokenizers end there
        n_groups = np.bincount(owner, minlength=len(fresh))
        raw = text.tobytes().decode()
        stops = np.concatenate([[0], text_ends])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        self.texts += [raw[x : max(x, y - 1)] for x, y in zip(stops, stops[1:])]
        return n_a, n_b, n_groups, a[end_a] << 32 | b[end_b], whole

    @staticmethod
    def _spelt(side: _Vocabulary, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each piece spell its bytes and none of them is empty."""
        long = _sums(side.sizes[ids], counts)
        good = (long == sizes) & (_sums(side.sizes[ids] == 0, counts) == 0)
        starts = np.cumsum(sizes) - sizes
        mine = side.spell(ids[np.repeat(good, counts)])
        same = mine == data[ragged(starts[good], sizes[good])]
        good[good] = _sums(~same, sizes[good]) == 0
        return good


def _encoded(batches, path_a: str, path_b: str, schema: pa.Schema):
    aligner = Aligner(path_a, path_b)
    base = TaskContext.get().partitionId() << 32
    for n, (batch, column) in enumerate(text_slices(batches, SLICE)):
        if len(aligner.number) > CACHE:
            aligner.forget()
        numbers, counts = _flat([aligner.numbers(text) for text in column.to_pylist()])
        aligner.learn()
        document = np.repeat(np.arange(len(column)), counts)
        broken = np.zeros(len(column), bool)
        broken[document[~aligner.whole[numbers]]] = True
        numbers, counts = numbers[~broken[document]], np.where(broken, 0, counts)
        own, local, times = np.unique(numbers, return_inverse=True, return_counts=True)
        links = aligner.n_groups[own]
        pairs, link = np.unique(aligner.pairs[ragged(aligner.at[own], links)], return_inverse=True)
        weights = np.zeros(len(pairs), np.int64)
        np.add.at(weights, link, np.repeat(times, links))
        lists = {"sizes": counts, "codes": local, "texts": [aligner.texts[i] for i in own], "n_a": aligner.n_a[own], "n_b": aligner.n_b[own], "n_links": links}
        packed = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(lists.values(), _PACKED)], schema=_PACKED)
        keys = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), batch.column(0))
        row = [pa.array([base + n]), keys, pa.array([_compressed(packed)], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([weights], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(row, schema)], schema=schema)


#: What a slice keeps for itself: pieces of each document, and text and numbers of each distinct piece. Its links are read from the text.
_PACKED = pa.schema([("sizes", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), *[(c, pa.list_(pa.int32())) for c in ("n_a", "n_b", "n_links")]])


def _compressed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _put_together(rows: pa.Table, answers: pa.Table, schema: pa.Schema) -> pa.Table:
    """Documents of one slice from its list of pieces and the counts of its pairs."""
    packed = pa.ipc.open_stream(rows.column("packed")[0].as_buffer()).read_all()
    keys = pc.list_flatten(rows.column("keys"))

    def values(name: str) -> np.ndarray:
        return pc.list_flatten(packed.column(name)).to_numpy()

    n_links = values("n_links").astype(np.int64)
    texts = pc.list_flatten(packed.column("texts")).to_pylist()
    shown = "".join([t + ";" for t in texts if t]).encode()
    pairs = answers.column("pair").to_numpy()
    order = np.argsort(pairs)
    link = np.searchsorted(pairs, linked(np.frombuffer(shown, np.uint8)), sorter=order)
    count = answers.column("pair_count").to_numpy()[order]
    best = answers.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    scores = {"n_a": values("n_a"), "n_b": values("n_b"), "n_groups": n_links, "n_links": n_links,
              "n_best": _sums(best[link], n_links), "count_sum": _sums(count[link], n_links)}
    codes, sizes = values("codes"), values("sizes")
    ends = np.cumsum(sizes).tolist()
    order = codes.tolist()
    groups = [";".join([texts[c] for c in order[a:b]]) for a, b in zip([0, *ends[:-1]], ends)]
    out = {"key": keys, **{k: pa.array(_sums(v[codes], sizes), pa.int64()) for k, v in scores.items()}, "groups": pa.array(groups, pa.large_string())}
    return pa.table([out[f.name] for f in schema], names=schema.names).cast(schema)


def align_documents(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token alignment of a byte-level vocabulary A (over space + text) and a piece model B (which adds the space) for every whole text.

    Returns ``<key>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, one row for each row of ``df``. ``groups`` is
    ``a1,a2|b1;a3|b2,b3``: ids in order between the bytes where tokens of both end. A link is a pair of tokens that end together; an id
    pair's count is the number of such links in all texts; ``n_best`` are the links whose count is the highest of their B id, ties
    included; ``count_sum`` sums the counts over the links.

    Null and empty texts, and texts that either tokenizer does not spell byte for byte, have zeros and empty ``groups``. Keys of any
    type may be null or repeat, repeated rows count each for themselves, other columns are ignored, and empty tables give no rows.
    A text is handled in one task however long it is; a slice holds about ``SLICE`` bytes or one longer text.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    layout = f"slice long, keys array<{kind}>, packed binary, pairs array<bigint>, times array<bigint>"
    encoded_schema = to_arrow_schema(StructType.fromDDL(layout))
    slices = written(rows.mapInArrow(lambda batches: _encoded(batches, path_a, path_b, encoded_schema), layout), "alignment")

    lists = slices.select("slice", "pairs", "times")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    found = lists.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("pair_count"))
    counts = written(found.withColumn("b", b_id), "pairs")
    highest = counts.groupBy("b").agg(F.max("pair_count").alias("highest"))
    judged = counts.join(highest, "b").select("pair", "pair_count", (F.col("pair_count") == F.col("highest")).alias("best"))
    asked = lists.select(F.col("slice").alias("of"), F.explode("pairs").alias("pair"))
    answers = asked.join(judged, "pair").select("of", "pair", "pair_count", "best")

    result = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    result_schema = to_arrow_schema(StructType.fromDDL(result))
    whole = slices.select("slice", "keys", "packed").groupBy("slice").cogroup(answers.groupBy("of"))
    return whole.applyInArrow(lambda mine, theirs: _put_together(mine, theirs, result_schema), result).withColumnRenamed("key", key)
