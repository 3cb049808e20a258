import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st

from repeatwise.llm import alignment
from repeatwise.llm.alignment import Aligner, align, align_documents, byte_alphabet, linked, rendered, terminals
from repeatwise.llm.queries import op11, tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
LIBRARY_A = tokenizers.Tokenizer.from_file(A)
LIBRARY_A.encode_special_tokens = True
LIBRARY_B = sentencepiece.SentencePieceProcessor(model_file=B)
ALPHABET = byte_alphabet()


def plain(text):
    """Groups and links of one text by comparing every byte offset; None without tokens."""
    if not text:
        return None
    a, b = LIBRARY_A.encode(" " + text, add_special_tokens=False), LIBRARY_B.encode(text)
    bytes_a = [bytes(ALPHABET[c] for c in t) for t in a.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if LIBRARY_B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, LIBRARY_B.id_to_piece(i)) for i in b)]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    shared, groups, links = sorted(set(ends_a) & set(ends_b)), [], []
    ids, i, j = a.ids, 0, 0
    for stop in shared:
        k, m = ends_a.index(stop, i) + 1, ends_b.index(stop, j) + 1
        groups.append((ids[i:k], b[j:m]))
        links.append((ids[k - 1], b[m - 1]))
        i, j = k, m
    return ids, b, groups, links


def brute(texts):
    found = [plain(t) for t in texts]
    counts = Counter(pair for f in found if f for pair in f[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, m)) + "|" + ",".join(map(str, t)) for m, t in f[2])
        out.append((len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[p] == highest[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), text))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.randoms())
def test_pointer_jumping_labels_components(sizes, random):
    ends_a = np.cumsum(sizes)
    total = int(ends_a[-1])
    ends_b = np.array(sorted({total, *random.sample(range(1, total + 1), random.randint(1, total))}))
    group_a, group_b, last_a, last_b = align(ends_a, ends_b)
    shared = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert group_a.tolist() == [sum(s < e for s in shared) for e in ends_a] and group_b.tolist() == [sum(s < e for s in shared) for e in ends_b]
    assert ends_a[last_a].tolist() == ends_b[last_b].tolist() == shared
    assert (terminals(ends_a, ends_b)[last_a] == last_a).all()
    text, ends = rendered(np.arange(len(ends_a)), np.arange(len(ends_b)) * 997, group_a, group_b)
    parts = [(",".join(str(i) for i in np.flatnonzero(group_a == g)), ",".join(str(i * 997) for i in np.flatnonzero(group_b == g))) for g in range(len(shared))]
    assert text.tobytes().decode() == "".join(f"{x}|{y};" for x, y in parts) and text[ends - 1].tobytes() == b";" * len(shared)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ  's'1.,▁é日😀ßſ×\xa0\n\t\r\x0b\x00  \u0085<|>", max_size=60))
def test_cut_texts_encode_like_whole_ones(text):
    aligner = Aligner.__new__(Aligner)
    aligner.a, aligner.b = SIDES
    aligner.forget()
    aligner.number["word"], aligner.number["é"]
    numbers = aligner.numbers(text)
    parts = [list(aligner.number)[n] for n in numbers]
    assert "".join(" " + p for p in parts) == (" " + text if text else "")
    assert [i for side in SIDES for i in side.encode(parts)[0].tolist()] == (LIBRARY_A.encode(" " + text, add_special_tokens=False).ids + LIBRARY_B.encode(text) if text else [])
    aligner.learn()
    assert len(aligner.texts) == len(aligner.number) == len(aligner.whole)


SIDES = alignment.ByteLevel(A), alignment.Pieces(B)


def test_edge_rows(edges, nothing, spark):
    rows = edges.select("doc_id", "text").collect()
    got = Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in align_documents(edges, A, B).collect())
    assert got == Counter((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows])))
    assert align_documents(nothing, A, B).collect() == []
    odd = ["a▁b", "<|endoftext|> </s> <s> <0x41>", "x" * 30000, " " * 70000 + "a", "\n" * 50000, "▁", " ", "ok ok ok"]
    df = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(odd)], "name string, slice string, pairs string").withColumnRenamed("slice", "body")
    found = {r["name"]: tuple(r[f] for f in FIELDS) for r in align_documents(df, A, B, "name", "body").collect()}
    assert [found[str(i)] for i in range(len(odd))] == brute(odd)


def test_small_slices_give_the_same(documents, texts, monkeypatch):
    """Counts are those of the whole corpus, however documents fall into slices."""
    want = dict(zip(texts, brute(texts.values())))
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in align_documents(documents.repartition(5), A, B).collect()} == want
    few = Aligner(A, B)
    assert few.b.cuts


def test_links_are_read_from_groups():
    """A slice keeps no links beside its groups: the ids that end a group's text are its pair."""
    text = b"1,22|50000,4;32000|0;7|8,9,31999;"
    assert linked(np.frombuffer(text, np.uint8)).tolist() == [22 << 32 | 4, 32000 << 32, 7 << 32 | 31999]
    assert linked(np.frombuffer(b"", np.uint8)).tolist() == []
    assert "links" not in alignment._PACKED.names and alignment.SLICE <= 2_000_000 and alignment.CACHE <= 100_000


def test_query(spark, texts):
    for r in op11(spark, "/root/testdata/sf0.001").collect():
        *counts, groups = brute([texts[r.doc_id]])[0]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links] == counts[:4] and r.n_links >= r.n_best and r.count_sum >= r.n_links
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 2_000_000 + "x", "x " * 500_000])
def test_long_texts(text):
    aligner = Aligner(A, B)
    numbers = aligner.numbers(text)
    aligner.learn()
    assert aligner.whole[numbers].all()
