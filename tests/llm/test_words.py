import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from repeatwise.llm.words import Words, grams, ragged, text_slices

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aBcZé日😀 \t\n\x0b\f\r\x00_", max_size=40)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.booleans())
def test_words_match_the_pattern(texts, lower):
    words = Words(pa.array(["skipped word", *texts], pa.string()).slice(1), lower)
    seen = {}
    for d, text in enumerate(texts):
        want = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        got = range(words.first[d], words.first[d + 1])
        assert [words.bytes[words.starts[i] : words.ends[i]].tobytes() for i in got] == want
        for i, w in zip(got, want):
            plain = bytes(b + 32 if lower and 65 <= b <= 90 else b for b in w)
            assert seen.setdefault(plain, words.hashes[i]) == words.hashes[i]
    assert len(set(seen.values())) == len(seen)


def test_grams_and_ragged():
    h = np.arange(1, 10, dtype=np.uint64)
    assert len(grams(h, 3)) == 7 and len(grams(h, 10)) == 0
    assert grams(h[2:], 3)[0] == grams(h, 3)[2]
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 37 % 90) for i in range(50)])], ["k", "t"])
    parts = [part.column(0).to_pylist() for part, _ in text_slices([batch, batch.slice(0, 0)], 200)]
    assert sum(parts, []) == list(range(50)) and len(parts) > 5
