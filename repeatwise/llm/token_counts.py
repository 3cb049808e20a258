"""Token counts of fields and sections from one encoding of the whole document.

The fields of a document are joined and encoded once. Tokens tile the bytes of the document, so the ends of tokens and the ends of
sections are two sorted lists, and an interval join of the two (binary search) says which sections each token touches. A token
that crosses a boundary is allocated by a rule.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .words import texts_of

#: Splits a text before merges; the pattern that belongs to the public byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
JOINT = "\n"  # stands between fields and belongs to the field before it
RULES = ("first", "last", "most")
SLICE = 2_000_000  # bytes of text encoded before rows are given out


def load_encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoding of a rank file and the number of bytes of each token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


#: White space of the pattern, in the order of code points (fixed values).
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANKS = re.compile(f"[{BLANKS}]{{50000,}}")


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text as ``encode_ordinary`` gives them, however long its runs of blanks.

    The library's matcher fails on runs of about a million. Of a run the pattern takes all blanks as one piece if the text ends there, else all
    but the last, which goes with what follows; so the text is cut there and the piece merged by itself.
    """
    ids, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : stop])
        at = stop
    return ids + encoding.encode_ordinary(text[at:])


def owners(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it crosses a boundary; both lists of ends are sorted and end at the same byte.

    ``first``: the section of its first byte; ``last``: of its last byte; ``most``: the one with most of its bytes, the earlier of equals.
    """
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = first != last
    if rule == "first" or not crossing.any():
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    section_starts = np.concatenate([[0], section_ends[:-1]])
    for t in np.flatnonzero(crossing):
        touched = np.arange(first[t], last[t] + 1)
        share = np.minimum(section_ends[touched], token_ends[t]) - np.maximum(section_starts[touched], starts[t])
        out[t] = touched[np.argmax(share)]
    return out, crossing


def _sections(fields: list[bytes], separator: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the sections in the joined document, the field of each and its number there. A section keeps its separator."""
    ends, field, number, at = [], [], [], 0
    for i, data in enumerate(fields):
        place = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(place == separator[0]) + 1
        stops = cuts if len(cuts) and cuts[-1] == len(data) else np.append(cuts, len(data))
        stops = at + stops
        at += len(data) + (i < len(fields) - 1)
        stops[-1] = at  # the joint
        ends.append(stops), field.append(np.full(len(stops), i)), number.append(np.arange(len(stops)))
    return np.concatenate(ends), np.concatenate(field), np.concatenate(number)


def _count(batches, path: str, names: list[str], rule: str):
    encoding, sizes = load_encoding(path)

    def rows(keys, columns):
        place, field, number, tokens, crossing, n_bytes = [], [], [], [], [], []
        for d, texts in enumerate(zip(*columns)):
            whole = JOINT.join(texts)
            ends, which, no = _sections([t.encode() for t in texts], b"\n")
            token_ends = np.cumsum(sizes[np.array(encode(encoding, whole), np.int64)]) if whole else np.zeros(0, np.int64)
            if len(token_ends):
                filled = np.flatnonzero(np.diff(ends, prepend=0))  # empty sections own nothing
                own, cross = owners(token_ends, ends[filled], rule)
                own = filled[own]
            else:
                own, cross = np.zeros(0, np.int64), np.zeros(0, bool)
            place.append(np.full(len(ends), d)), field.append(which), number.append(no)
            tokens.append(np.bincount(own, minlength=len(ends))), crossing.append(np.bincount(own[cross], minlength=len(ends)))
            n_bytes.append(np.diff(ends, prepend=0))
        place, field, number, tokens, crossing, n_bytes = (np.concatenate(x) for x in (place, field, number, tokens, crossing, n_bytes))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(place)), pa.array(names).take(pa.array(field)), pa.array(number, pa.int32()), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64())],
            ["key", "field", "section", "n_bytes", "n_tokens", "n_crossing"],
        )

    for batch in batches:
        columns = [texts_of(c) for c in batch.columns[1:]]
        total = sum(np.diff(np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]) for c in columns) if len(batch) else np.zeros(0)
        for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(np.cumsum(total) // SLICE)) + 1):
            if len(part):
                yield rows(batch.column(0).slice(part[0], len(part)), [c.slice(part[0], len(part)).to_pylist() for c in columns])


def section_tokens(df: DataFrame, path: str, fields: tuple[str, ...] = ("text",), key: str = "doc_id", rule: str = "first") -> DataFrame:
    """Tokens of every line of every field: ``<key>, field, section, n_bytes, n_tokens, n_crossing``.

    The fields of a row, joined by line breaks, are encoded once and whole. A section is a line with its break; a field without text (null
    or empty) is one empty section. ``n_tokens`` counts the tokens allocated to the section by ``rule`` (see ``owners``), ``n_crossing``
    those of them that also hold bytes of another section. Each row of ``df`` is counted by itself, so repeated keys repeat; other
    columns are ignored; empty tables give no rows. A text is encoded in one task, however long it or its runs of blanks are.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), *[df[f].alias(f"f{i}") for i, f in enumerate(fields)])
    names = list(fields)
    out = rows.mapInArrow(lambda batches: _count(batches, path, names, rule), f"key {kind}, field string, section int, n_bytes long, n_tokens long, n_crossing long")
    return out.withColumnRenamed("key", key)


def document_tokens(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sums of ``section_tokens`` by document and field."""
    return sections.groupBy(key, "field").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_crossing").alias("n_crossing"))
