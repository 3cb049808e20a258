"""SentencePiece encoding and decoding that keeps track of the original bytes.

A text is normalised by the longest prefix that the model's compiled character map knows, and each normalised byte remembers
its place in the source. The normalised text falls into units no piece can cross; the model's merges segment each distinct unit
once, and every piece is projected back to a span of source bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .words import ragged, text_slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 400_000  # distinct units kept between batches
SLICE = 2_000_000  # bytes of text encoded before rows are given out


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """Compiled character map: a double-array trie over UTF-8 prefixes, then the replacements it points to."""

    def __init__(self, compiled: bytes = b""):
        self.units: tuple[int, ...] = ()
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.replacements = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and what replaces it."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, place = found
        return size, self.replacements[place : self.replacements.index(b"\0", place)]


def _char_size(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.pieces, self.kinds = [], []
        norm, train = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                train = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if USER in self.kinds or train.get(24, 0):
            raise ValueError("models with user-defined symbols or spaces as suffixes are not supported")
        self.map = CharacterMap(norm.get(2, b""))
        self.dummy_prefix, self.squeeze, escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.space = SPACE if escape else " "
        self.begin, self.end = train.get(41, 1), train.get(42, 2)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.sizes = np.array([1 if k == BYTE else 0 if k == CONTROL else len(p.encode()) for p, k in zip(self.pieces, self.kinds)])
        long = [p for p in self.pieces if len(p) > 1]
        if any(self.space in p.lstrip(self.space) for p in long) or any(p.startswith(self.space * 2) and p.strip(self.space) for p in long):
            raise ValueError("pieces that hold a space inside are not supported")
        # no piece of several characters holds a line break, and none goes on after a word into a space: both end a unit
        breaks = "".join(c for c in "\n\r\t" if not any(c in p for p, k in zip(self.pieces, self.kinds) if len(p) > 1 and k == NORMAL))
        stop = re.escape(breaks)
        self.unit = re.compile(f"[{stop}]|{self.space}*[^{self.space}{stop}]+|{self.space}+" if breaks else f"{self.space}*[^{self.space}]+|{self.space}+")
        self.breaks = breaks
        # stands before a unit without a space; the character map must leave it alone, and no piece goes on behind it
        self.lead = next(c for c in "\n\ue000" if not self.map.units or self.map.longest(c.encode(), 0) is None)

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(self.kinds[i], self.pieces[i].replace(self.space, " ").encode())

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text, and for each of its bytes and its end the source byte it comes from.

        None stands for the alignment of a text that only gained the dummy prefix and wider spaces (see ``sources``).
        """
        if not self.map.units and not self.squeeze:
            return ((self.space if self.dummy_prefix and text else "") + text.replace(" ", self.space)), None
        data, out, source, at = text.encode(), bytearray(), [], 0
        while at < len(data):
            known = self.map.longest(data, at) if self.map.units else None
            size, put = known if known else (_char_size(data[at]), data[at : at + _char_size(data[at])])
            out += put
            source += [at] * len(put)
            at += size
        source.append(len(data))
        if self.squeeze:  # no space at either end, one between words
            keep = [i for i, b in enumerate(out) if b != 32 or (i > 0 and out[i - 1] != 32)]
            while keep and out[keep[-1]] == 32:
                source[-1] = source[keep.pop()]
            source = [source[i] for i in keep] + source[-1:]
            out = bytearray(out[i] for i in keep)
        if self.dummy_prefix and out:
            out, source = b" " + out, source[:1] + source
        wide = self.space.encode()
        spread = [(len(wide) if b == 32 else 1) for b in out] + [1]
        return bytes(out).replace(b" ", wide).decode(), np.repeat(source, spread)

    def sources(self, text: str, normal: str, aligned: np.ndarray | None) -> np.ndarray:
        """Source byte of each normalised byte and of the end."""
        if aligned is not None:
            return aligned
        data = text.encode()
        if not data:
            return np.zeros(1, np.int64)
        spread = np.where(np.frombuffer(data, np.uint8) == 32, len(self.space.encode()), 1)
        source = np.repeat(np.arange(len(data)), spread)
        return np.concatenate([np.zeros(len(normal.encode()) - len(source), np.int64), source, [len(data)]])

    def segment(self, units: list[str]) -> list[list[int]]:
        """Piece ids of units. The library puts a space before a text, so a unit that has none goes behind ``lead``."""
        plain = [u[1:].replace(self.space, " ") if u[:1] == self.space and len(u) > 1 and self.dummy_prefix else None for u in units]
        ids: list = [None] * len(units)
        easy = [i for i, p in enumerate(plain) if p]
        for i, found in zip(easy, self.library.encode([plain[i] for i in easy], num_threads=1)):
            ids[i] = found
        hard = [i for i in range(len(units)) if ids[i] is None]
        lead = self.library.encode(self.lead)
        for i, found in zip(hard, self.library.encode([self.lead + units[i].replace(self.space, " ") for i in hard], num_threads=1)):
            ids[i] = found[len(lead) :]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; bytes that form no character become U+FFFD each, as in the library."""
        parts, run, first = [], bytearray(), True
        for i in [*ids, self.begin]:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            if run:
                parts.append(_bytes_to_text(bytes(run)))
                run, first = bytearray(), False
            if self.kinds[i] != CONTROL:
                piece = self.surface[i].decode()
                parts.append(piece[1:] if first and self.dummy_prefix and self.kinds[i] == NORMAL and piece[:1] == " " else piece)
                first = False
        return "".join(parts)


def _bytes_to_text(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


class Encoder:
    """Encodes batches of texts; the ids of units seen before are looked up."""

    def __init__(self, path: str, ends: bool = True):
        self.model, self.ends = PieceModel(path), ends
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.at, self.n, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def _learn(self, fresh: list[str]) -> None:
        ids = self.model.segment(fresh)
        for unit in fresh:
            self.code[unit] = len(self.code)
        n = np.array([len(x) for x in ids], np.int64)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.int32)])
        surface = self.model.surface
        self.bytes += [b"".join([surface[i] for i in x]) for x in ids]

    def batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, str, np.ndarray | None]]:
        """For each text its ids, its decoded bytes, the normalised text and the alignment."""
        if len(self.code) > CACHE:
            self._forget()
        model, code = self.model, self.code
        normals = [model.normalise(text) for text in texts]
        split = [model.unit.findall(normal) for normal, _ in normals]
        fresh: dict[str, None] = {}
        for units in split:
            fresh |= dict.fromkeys(units)
        if new := [u for u in fresh if u not in code]:
            self._learn(new)
        for units, (normal, aligned) in zip(split, normals):
            codes = [code[u] for u in units]
            picked = np.array(codes, np.int64)
            ids = self.flat[ragged(self.at[picked], self.n[picked])] if len(picked) else np.zeros(0, np.int32)
            if self.ends:
                ids = np.concatenate([[np.int32(model.begin)], ids, [np.int32(model.end)]]).astype(np.int32)
            decoded = b"".join([self.bytes[c] for c in codes])
            yield ids, decoded[1:] if model.dummy_prefix and decoded[:1] == b" " else decoded, normal, aligned

    def spans(self, ids: np.ndarray, text: str, normal: str, aligned: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last source byte of each piece; the pieces of one character's bytes share its bytes out in order."""
        ends = np.cumsum(self.model.sizes[ids])
        source = self.model.sources(text, normal, aligned)
        return source[ends - self.model.sizes[ids]], source[ends]


def _pieces(batches, path: str):
    encoder = Encoder(path)
    for batch, column in text_slices(batches, SLICE):
        texts = column.to_pylist()
        ids, begins, ends, decoded = [], [], [], []
        for text, (i, d, normal, aligned) in zip(texts, encoder.batch(texts)):
            b, e = encoder.spans(i, text, normal, aligned)
            ids.append(i), begins.append(b.astype(np.int32)), ends.append(e.astype(np.int32)), decoded.append(d.decode())
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, begins, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(decoded, pa.string())], ["key", "ids", "begins", "ends", "decoded"])


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every whole text with begin and end ids: ``<key>, ids, begins, ends, decoded``.

    ``begins`` and ``ends`` are the source bytes of each piece; begin and end ids and the dummy prefix have empty spans or
    share the first space. Null texts count as empty (begin and end ids only). Each row of ``df`` gives one row; keys may be null
    or repeat; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    out = rows.mapInArrow(lambda batches: _pieces(batches, path), f"key {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def _digests(batches, path: str):
    hex_of = lambda data: hashlib.sha256(data).hexdigest()
    for batch in _pieces(batches, path):
        ids, begins, ends = (batch.column(c) for c in ("ids", "begins", "ends"))
        cuts = ids.offsets.to_numpy()
        flat = [x.values.to_numpy().astype("<u4") for x in (ids, begins, ends)]
        each = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        columns = [
            pa.array(np.diff(cuts), pa.int64()), pa.array([hex_of(flat[0][a:b].tobytes()) for a, b in each], pa.string()),
            pa.array([hex_of(flat[1][a:b].tobytes() + flat[2][a:b].tobytes()) for a, b in each], pa.string()),
            pa.array([hex_of(d.encode()) for d in batch.column("decoded").to_pylist()], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"])


def encoded_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``encode_documents`` gives, as digests: ``<key>, n_tokens, ids_sha256, spans_sha256`` (ids, and all begins and then all ends, as
    little-endian 32-bit numbers), ``decoded_sha256``. Rows, nulls and other columns as there."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(lambda batches: _digests(batches, path), f"key {kind}, n_tokens long, ids_sha256 string, spans_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
