"""Removal of passages that an earlier document already holds, located by sharded Aho-Corasick automata.

1. Every window of 50 words has a leading phrase: of its 8-word phrases the one with the smallest hash. Equal windows have equal
   leading phrases, so only windows whose phrase leads windows of two documents can recur. Phrases are counted by a shuffle.
2. Each shard of documents compiles an automaton of the confirmed phrases that lead windows of its documents, with their words as the count
   brought them, and streams its documents through it; where a window's leading phrase is located, the window is a candidate. The hits
   are the only places considered.
3. Shards send the keys of their candidate windows, once each with the smallest document, to key ranges and get back the smallest
   document of all. Windows that a smaller document holds are removed.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numbering import number_rows
from ..session import written
from .common import parallelism
from .words import Words, grams, mix, text_slices

WINDOW = 50
PHRASE = 8
SHARD_BYTES = 3_000_000  # text of one automaton
LAST = 2**63 - 1  # stands for a null key
_U = np.uint64


def window_starts(words: Words, window: int) -> np.ndarray:
    """Mask of the words at which a window of one text begins."""
    stop = np.repeat(words.first[1:], words.counts)
    return np.arange(len(words)) + window <= stop


def leading_phrases(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and for each phrase position the smallest hash among the phrases of the window that begins there."""
    hashes = grams(words.hashes, phrase)
    span = window - phrase + 1
    least, size = hashes, 1
    while size * 2 <= span:
        least, size = np.minimum(least[: len(least) - size], least[size:]), size * 2
    if size < span:
        more = span - size
        least = np.minimum(least[: max(len(least) - more, 0)], least[more:])
    return hashes, least


def window_keys(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit keys of the windows that begin at ``starts``."""
    high = grams(words.hashes, window)[starts]
    low = grams(mix(words.hashes ^ _U(0xD6E8FEB86659FD93)), window)[starts]
    return high, (low >> _U(32)).astype(np.uint32)


def _leaders(batches, window: int, phrase: int):
    for batch, texts in text_slices(batches, 16_000_000):
        words = Words(texts)
        starts = np.flatnonzero(window_starts(words, window))
        if not len(starts):
            continue
        _, least = leading_phrases(words, window, phrase)
        doc = np.repeat(np.arange(len(texts)), words.counts)[starts]
        leads = least[starts]
        new = np.ones(len(leads), bool)
        new[1:] = (leads[1:] != leads[:-1]) | (doc[1:] != doc[:-1])
        keys = batch.column(0).to_numpy(zero_copy_only=False)[doc[new]]
        # the words of each phrase, from the first place in its window where it begins
        letters, place = _letters(words), _leading_places(words, window, phrase)[starts[new]]
        spelt = np.stack([letters[place + j] for j in range(phrase)], axis=1).astype("<u4")
        cells = pa.Array.from_buffers(pa.binary(4 * phrase), len(spelt), [None, pa.py_buffer(spelt.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(leads[new].view(np.int64)), pa.array(keys, pa.int64()), cells], ["phrase", "key", "words"])


def _letters(words: Words) -> np.ndarray:
    """Words as letters of an automaton's alphabet: 32 bits of their hashes."""
    return (mix(words.hashes) >> _U(33)).astype(np.int64)


def _leading_places(words: Words, window: int, phrase: int) -> np.ndarray:
    """For each phrase position, where the leading phrase of the window that begins there begins."""
    hashes = grams(words.hashes, phrase)
    span = window - phrase + 1
    best, size = np.arange(len(hashes)), 1
    lower = lambda a, b: np.where(hashes[b] < hashes[a], b, a)
    while size * 2 <= span:
        best, size = lower(best[: len(best) - size], best[size:]), size * 2
    if size < span:
        more = span - size
        best = lower(best[: max(len(best) - more, 0)], best[more:])
    return best


def locate(words: Words, patterns: list[bytes], phrase: int) -> np.ndarray:
    """Positions of all occurrences of the patterns (letters of ``phrase`` words each), found by an Aho-Corasick automaton over all texts."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for pattern in patterns:
        automaton.add_word(tuple(np.frombuffer(pattern, "<u4").tolist()))
    if not len(automaton):
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    letters, found = _letters(words).tolist(), []
    for first, stop in zip(words.first.tolist(), words.first[1:].tolist()):
        if stop - first >= phrase:
            found += [first + end for end, _ in automaton.iter(tuple(letters[first:stop]))]
    return np.array(found, np.int64) - (phrase - 1)


_SHARD = "shard long, done array<struct<key:bigint,null_key:boolean,n_words:bigint,sha256:string>>, open array<struct<key:bigint,null_key:boolean,text:string,starts:binary>>"
_DONE = pa.struct([("key", pa.int64()), ("null_key", pa.bool_()), ("n_words", pa.int64()), ("sha256", pa.string())])
_OPEN = pa.struct([("key", pa.int64()), ("null_key", pa.bool_()), ("text", pa.string()), ("starts", pa.binary())])


def _shards(batches, window: int, phrase: int):
    """One row for each shard: documents without a candidate are done, others go on with the places of their candidates."""
    number = TaskContext.get().partitionId() << 32
    for batch, texts in text_slices(batches, SHARD_BYTES):
        words = Words(texts)
        lists = batch.column(3).combine_chunks() if isinstance(batch.column(3), pa.ChunkedArray) else batch.column(3)
        patterns = sorted(set(lists.flatten().to_pylist()))
        candidate = np.zeros(len(words), bool)
        if patterns:
            hashes, least = leading_phrases(words, window, phrase)
            located = locate(words, patterns, phrase)
            starts = np.flatnonzero(window_starts(words, window))
            candidate[starts] = np.isin(least[starts], np.unique(hashes[located]))
        done, going_on = [], []
        for d, (key, null, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts.to_pylist())):
            first, stop = words.first[d], words.first[d + 1]
            starts = np.flatnonzero(candidate[first:stop])
            if len(starts):
                going_on.append({"key": key, "null_key": null, "text": text, "starts": starts.astype("<i4").tobytes()})
            else:
                kept = b" ".join(text.encode().split())
                done.append({"key": key, "null_key": null, "n_words": int(stop - first), "sha256": hashlib.sha256(kept).hexdigest()})
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([done], pa.list_(_DONE)), pa.array([going_on], pa.list_(_OPEN))], ["shard", "done", "open"])
        number += 1


def _candidates(documents: list[dict], window: int) -> tuple[Words, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and candidate starts of a shard's open documents, the distinct window keys in order, and each candidate's place among them."""
    words = Words(pa.array([d["text"] for d in documents], pa.large_string()))
    starts = [np.frombuffer(d["starts"], "<i4") + first for d, first in zip(documents, words.first)]
    high, low = window_keys(words, np.concatenate(starts), window)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    owner = np.repeat([d["key"] for d in documents], [len(s) for s in starts])
    first = np.full(int(new.sum()), LAST)
    np.minimum.at(first, place, owner)
    return words, starts, high[order][new], low[order][new], place, first


def _requests(batches, window: int, ranges: int):
    for batch in batches:
        for shard, documents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not documents:
                continue
            _, _, high, low, _, first = _candidates(documents, window)
            which = ((high >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
            cuts = np.searchsorted(which, np.arange(ranges + 1))
            full = [(r, cuts[r], cuts[r + 1]) for r in range(ranges) if cuts[r + 1] > cuts[r]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(full)), pa.array([r for r, _, _ in full], pa.int32())]
                + [pa.array([x[a:b].tobytes() for _, a, b in full], pa.binary()) for x in (high, low, first)],
                ["shard", "range", "high", "low", "first"],
            )


def _least_documents(table: pa.Table) -> pa.Table:
    """For each request of one key range, the smallest document of each of its keys."""
    parts = [[np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in (("high", _U), ("low", np.uint32), ("first", np.int64))]
    sizes = [len(x) for x in parts[0]]
    high, low, first = (np.concatenate(x) for x in parts)
    order = np.lexsort((first, low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    least = np.empty(len(order), np.int64)
    least[order] = first[order][new][np.cumsum(new) - 1]
    answers = [x.tobytes() for x in np.split(least, np.cumsum(sizes)[:-1])]
    return pa.table({"shard": table.column("shard"), "range": table.column("range"), "least": pa.array(answers, pa.binary())})


_RESULT = "key long, null_key boolean, n_words long, n_removed long, kept string"


def _remove(batches, window: int):
    for batch in batches:
        for documents, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, starts, _, _, place, _ = _candidates(documents, window)
            least = np.concatenate([np.frombuffer(a["least"], np.int64) for a in sorted(answers, key=lambda a: a["range"])])[place]
            at, rows = 0, []
            for d, own in zip(documents, starts):
                first = words.first[len(rows)]
                mine = least[at : at + len(own)]
                at += len(own)
                split = d["text"].encode().split()
                cover = np.zeros(len(split) + 1, np.int64)
                gone = own[mine < d["key"]] - first
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = b" ".join([w for w, k in zip(split, keep.tolist()) if k]) if len(gone) else b" ".join(split)
                rows.append((d["key"], d["null_key"], len(split), int(len(split) - keep.sum()), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()))], ["key", "null_key", "n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, texts: bool = True) -> DataFrame:
    """Texts of ``df`` without the words of windows that also begin in a document with a smaller key.

    Returns ``<key>, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept`` for documents with candidate windows (null for
    all others: nothing was removed). Kept words are joined by one space. Windows are judged on the input. Null texts have no words; a
    null key is larger than any other, and documents of one key do not remove each other. Keys that are no whole numbers are compared
    by their order. Other columns are ignored; empty tables give no rows; a text is handled whole in one task, however long. Window keys
    have 96 bits.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        places = number_rows(df.select(df[key].alias("own_key")).filter("own_key IS NOT NULL").distinct(), ["own_key"], "place")
        numbered = df.select(df[key].alias("own_key"), df[text].alias("text")).join(places, "own_key", "left").select("place", "text")
        found = remove_repeats(numbered, "place", "text", window, phrase, texts)
        return found.join(places, "place", "left").select(F.col("own_key").alias(key), *[c for c in found.columns if c != "place"])
    docs = df.select(F.coalesce(df[key].cast("long"), F.lit(LAST)).alias("key"), df[text].alias("text"), df[key].isNull().alias("null_key"))
    leads = written(docs.select("key", "text").mapInArrow(lambda b: _leaders(b, window, phrase), "phrase long, key long, words binary"), "leads")
    twice = leads.groupBy("phrase").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a < b").select("phrase")
    lists = leads.join(twice, "phrase").groupBy("key").agg(F.collect_set("words").alias("phrases"))
    routed = docs.join(lists, "key", "left").select("key", "text", "null_key", F.coalesce("phrases", F.array().cast("array<binary>")).alias("phrases"))
    shards = written(routed.mapInArrow(lambda b: _shards(b, window, phrase), _SHARD), "shards")

    ranges = parallelism(df)
    going_on = shards.filter(F.size("open") > 0).select("shard", "open")
    requests = going_on.mapInArrow(lambda b: _requests(b, window, ranges), "shard long, range int, high binary, low binary, first binary")
    answers = requests.groupBy("range").applyInArrow(_least_documents, "shard long, range int, least binary")
    gathered = answers.groupBy("shard").agg(F.collect_list(F.struct("range", "least")).alias("answers"))
    removed = going_on.join(gathered, "shard").select("open", "answers").mapInArrow(lambda b: _remove(b, window), _RESULT)

    done = shards.select(F.explode("done").alias("d")).select("d.key", "d.null_key", "d.n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept"), F.col("d.sha256").alias("kept_sha256"))
    both = removed.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).union(done)
    names = ["n_words", "n_removed", "kept_sha256"] + (["kept"] if texts else [])
    return both.select(F.when(~F.col("null_key"), F.col("key")).alias(key), *names)
