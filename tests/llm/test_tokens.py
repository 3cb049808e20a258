import hashlib

import numpy as np
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st

from repeatwise.llm.pieces import CharacterMap, Encoder, PieceModel, encode_documents, encoded_digests
from repeatwise.llm.queries import tokenizer
from repeatwise.llm import token_counts
from repeatwise.llm.token_counts import document_tokens, encode, load_encoding, owners, section_tokens

MODEL = tokenizer("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ENCODER = Encoder(MODEL)
ODD = st.text(alphabet="ab ▁\n\t\r\x00é日😀.1", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=20)), max_size=4))
def test_encoding_is_the_library_s(texts):
    for text, (ids, decoded, normal, aligned) in zip(texts, ENCODER.batch(texts)):
        want = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want
        assert decoded.decode() == LIBRARY.decode(want) == ENCODER.model.decode(want)
        begins, ends = ENCODER.spans(ids, text, normal, aligned)
        data = text.encode()
        assert (begins <= ends).all() and (begins[1:] >= begins[:-1]).all() and (not data or ends[-1] == len(data))
        for i, a, b in zip(ids[1:-1].tolist(), begins[1:-1], ends[1:-1]):
            assert data[a:b] in (ENCODER.model.surface[i], ENCODER.model.surface[i][1:]) or "▁" in text  # the dummy prefix has no source


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12))
def test_decoding_any_ids(ids):
    assert ENCODER.model.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_character_map(rule):
    """Longest-prefix normalisation with alignment, against the library's normaliser."""
    from repeatwise.llm.pieces import _fields

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(_fields(library.serialized_normalizer_spec()))
    model = object.__new__(PieceModel)
    model.map, model.dummy_prefix, model.squeeze, model.space = CharacterMap(spec[2]), bool(spec.get(3, 1)), bool(spec.get(4, 1)), "▁"
    for text in ["ＡＢＣ ①  ㍿  x", "  a　b​c\t", "ﬁ Å Å ｶﾞ", "日本㎏ é", "", "   ", "À B", "tÜßx ½"]:
        normal, aligned = model.normalise(text)
        want = library.normalize(text)
        assert normal.replace("▁", " ").strip(" ") == want.replace("▁", " ").strip(" ")
        assert len(aligned) == len(normal.encode()) + 1 and (np.diff(aligned) >= 0).all()


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def test_model_with_a_character_map(tmp_path):
    """The given vocabulary with another normaliser: ids and text are the library's, spans cover the source bytes in order."""
    from repeatwise.llm.pieces import _fields

    raw = open(MODEL, "rb").read()
    compiled = dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()))[2]
    norm = dict(_fields(raw))[3] + b"\x12" + varint(len(compiled)) + compiled
    path = tmp_path / "mapped.model"
    path.write_bytes(raw + b"\x1a" + varint(len(norm)) + norm)
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=str(path)), Encoder(str(path))
    assert encoder.model.map.units
    texts = ["ＡＢＣ ① plain", "half ｶﾞ and ﬁne", "Å é a\tb", "", " two  spaces ", "㍿ x", "日本㎏", "a" * 50 + " " + "Ｂ" * 50]
    for text, (ids, decoded, normal, aligned) in zip(texts, encoder.batch(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want and decoded.decode() == library.decode(want)
        begins, ends = encoder.spans(ids, text, normal, aligned)
        assert (begins <= ends).all() and (begins[1:] >= begins[:-1]).all() and ends.max(initial=0) <= len(text.encode())


def test_documents_as_pieces(documents, texts, edges, nothing):
    spans = {}
    for r in encoded_digests(documents, MODEL).collect():
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
        spans[r.doc_id] = r.spans_sha256
    for r in encode_documents(documents, MODEL).collect():
        assert spans[r.doc_id] == hashlib.sha256(np.array(r.begins + r.ends, "<u4").tobytes()).hexdigest()
    rows = encode_documents(edges, MODEL).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == sorted((str(r.doc_id), LIBRARY.encode(r.text or "", add_bos=True, add_eos=True), r.text or "") for r in edges.collect())
    assert all(len(r.begins) == len(r.ends) == len(r.ids) for r in rows)
    assert encode_documents(nothing, MODEL).count() == encoded_digests(nothing, MODEL).count() == 0


# -- token counts

RANKS = tokenizer("byte_bpe_50k.tiktoken")


def by_hand(fields, rule):
    """Sections by code points, from another library's offsets of the same vocabulary."""
    plain = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    whole = "\n".join(fields)
    owner, counts = [], {}
    for f, text in enumerate(fields):
        lines = text.split("\n")
        if len(lines) > 1 and lines[-1] == "":
            lines.pop()
        for n, line in enumerate(lines):
            counts[f, n] = [0, 0]
            last = n == len(lines) - 1
            own = line + ("\n" if not last or text.endswith("\n") else "") + ("\n" if last and f < len(fields) - 1 else "")
            owner += [(f, n)] * len(own)
    assert len(owner) == len(whole)
    for a, b in plain.encode(whole, add_special_tokens=False).offsets:
        spans = owner[a:b]
        best = {"first": spans[0], "last": spans[-1], "most": max(dict.fromkeys(spans), key=spans.count)}[rule]
        counts[best][0] += 1
        counts[best][1] += len(set(spans)) > 1
    return counts


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_sections_against_another_library(spark, rule):
    rows = [(1, "Title\n\n\n here", "Body of it\n\n \n and more\n"), (2, None, "x\n\n\n\ny"), (3, "", ""), (4, "plain ascii", None), (5, "\n", "\n\n  z")]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string")
    got = {(r.doc_id, ["title", "text"].index(r.field), r.section): [r.n_tokens, r.n_crossing] for r in section_tokens(df, RANKS, ("title", "text"), rule=rule).collect()}
    want = {(k, f, n): c for k, *fields in rows for (f, n), c in by_hand([x or "" for x in fields], rule).items()}
    assert got == want


def test_documents_as_sections(documents, texts, edges, nothing):
    plain = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    sums = {r.doc_id: r for r in document_tokens(section_tokens(documents, RANKS)).collect()}
    assert set(sums) == set(texts)
    for k, t in texts.items():
        assert sums[k].n_tokens == len(plain.encode(t or "", add_special_tokens=False).ids)
    assert section_tokens(nothing, RANKS).count() == 0
    got = section_tokens(edges, RANKS).groupBy("doc_id").sum("n_bytes").collect()
    assert len(got) == len({r.doc_id for r in edges.collect()})


def test_owners():
    tokens, sections = np.array([2, 5, 9, 12]), np.array([3, 8, 12])
    assert owners(tokens, sections, "first")[0].tolist() == [0, 0, 1, 2]
    assert owners(tokens, sections, "last")[0].tolist() == [0, 1, 2, 2]
    assert owners(tokens, sections, "most")[0].tolist() == [0, 1, 1, 2]
    assert owners(tokens, sections, "most")[1].tolist() == [False, True, True, False]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.'s \n\t\r\x0b\xa0\u2003\u3000é", max_size=40))
def test_blank_runs_merged_apart(text):
    """With runs of three cut out already, ids stay those of the whole text."""
    import re

    long, token_counts.LONG_BLANKS = token_counts.LONG_BLANKS, re.compile(f"[{token_counts.BLANKS}]{{3,}}")
    try:
        assert encode(ENCODING, text) == ENCODING.encode_ordinary(text)
    finally:
        token_counts.LONG_BLANKS = long


ENCODING = load_encoding(RANKS)[0]


def test_very_long_blank_runs(spark):
    """Runs on which the library's matcher stops the process, at the end of a text and inside."""
    plain = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = [(1, " " * 2_500_000), (2, "a\n" + "\n" * 2_500_000 + "b c"), (3, "x" + " \n" * 700_000 + " y"), (4, None)]
    got = {r.doc_id: r.n_tokens for r in document_tokens(section_tokens(spark.createDataFrame(rows, "doc_id long, text string"), RANKS)).collect()}
    assert got == {k: len(plain.encode(t or "", add_special_tokens=False).ids) for k, t in rows}
