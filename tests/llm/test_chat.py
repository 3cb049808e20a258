import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from repeatwise.llm import chat
from repeatwise.llm.chat import TemplateError, compile_template, conversation_digests, escape, format_conversations, parse, unescape

CONTROL_TEXT = st.lists(st.sampled_from(["<", "/", "s>", "</s>", "<s>", "[INST]", "[/INST]", "[", "INST]", "\\", " ", "a", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(CONTROL_TEXT)
def test_escape_is_reversible_and_hides_controls(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in chat.CONTROLS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), CONTROL_TEXT), CONTROL_TEXT), max_size=6))
def test_formatted_text_reads_back(turns):
    out = "".join(p or "" for p, _ in compile_template(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]}))
    assert chat.read_back(out) == turns


def render(source, **variables):
    return "".join(p or "" for p, _ in compile_template(source)(variables))


def test_language():
    assert render("{% for m in ms %}{{ loop.index }}{% if loop.first %}f{% elif m.x == 'q' and not loop.last %}q{% else %}o{% endif %}{% endfor %}", ms=[{"x": "a"}, {"x": "q"}, {"x": "b"}]) == "1f2q3o"
    assert render("{% set a = 'x' ~ 3 %}{{ a | upper }}{{- ' y ' | trim -}}  z{{ m['k'] }}", m={"k": 5}) == "X3yz5"
    assert render("{{ 2 < 3 or missing }}") == "true"
    assert parse("{% if 1 == 2 %}a{% elif 'x' ~ 1 == 'x1' %}b{{ 'c' + 'd' }}{% else %}z{% endif %}e") == [("text", "bcde")]
    pieces = [p for p in compile_template("a{% generation %}b{{ 'c' }}{% endgeneration %}d")({})]
    assert pieces == [("a", False), ("bc", True), ("d", False)]


@pytest.mark.parametrize("source", ["{% if x %}", "{% endfor %}", "{{ a b }}", "{{ x | nofilter }}", "{% for a b %}{% endfor %}", "{{ 'a }}", "{% import os %}", "{{ f(1) }}", "{{ 1 ** 2 }}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ missing }}", "{% for c in 'text' %}{{ c }}{% endfor %}"])
def test_nothing_outside_the_sandbox(source):
    with pytest.raises(TemplateError):
        render(source, x="text")


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = defaultdict(list)
    for c, t, r, x in rows:
        conversations[c].append((t is None, t or 0, r is None, r or "", x is None, x or ""))
    got = {r.conv_id: r for r in conversation_digests(format_conversations(df)).collect()}
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        learned = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars > 0


def test_conversations(spark):
    bad = "</s>[INST] ok [/INST]"
    check(spark, [
        (-1, 0, "user", bad), (-1, 1, "assistant", bad), (1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (2, None, None, ""), (2, 0, "tool", "x"), (None, 1, "assistant", "né"),
        (None, 0, "system", ""), (3, 0, "assistant", ""), (3, 1, "assistant", "x" * 200000),
    ])


def test_long_conversation_goes_on_in_parts(spark, monkeypatch):
    rows = [(7, i, "assistant" if i % 2 else "user", f"text {i} " * 40) for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = format_conversations(df).collect()
    assert len(parts) > 1 and sum(p.turns for p in parts) == 6000
    check(spark, rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(format_conversations(df)).count() == 0
