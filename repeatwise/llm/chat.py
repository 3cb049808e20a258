"""Chat formatting: a sandboxed template language, parsed to a tree, folded and turned into Python closures.

The language has text, ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in list %} {% endfor %}``,
``{% set x = e %}`` and ``{% generation %} {% endgeneration %}``, which marks what a model learns to write. Expressions know
strings, whole numbers, ``true false none``, names, ``a.b`` and ``a['b']`` (keys of dictionaries only), ``loop.first loop.last
loop.index``, ``== != < > <= >= in``, ``and or not``, ``+`` and ``~``, and the filters in ``FILTERS``. No Python attribute,
call or import can be reached from a template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Control strings of the template below; texts must not hold them as they are.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'assistant' %}<s>assistant {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<s>{{ m.role | escape }}[INST] {{ m.text | escape }} [/INST]{% endif %}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string and before each backslash."""
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {"escape": lambda v: escape(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v)}


class TemplateError(ValueError):
    pass


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else str(value)


# -- parsing: expressions become ("const", v), ("name", n), ("key", e, e), ("op", name, e...), ("filter", name, e)

_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((("number", "string", "word", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted is not None and self.peek() != wanted:
            raise TemplateError(f"{wanted or 'an expression'} expected")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.peek() == "or":
            self.take()
            tree = fold(("op", "or", tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.peek() == "and":
            self.take()
            tree = fold(("op", "and", tree, self.negated()))
        return tree

    def negated(self):
        if self.peek() == "not":
            self.take()
            return fold(("op", "not", self.negated()))
        tree = self.sum()
        while self.peek() in _COMPARE:
            sign = self.take()[1]
            tree = fold(("op", sign, tree, self.sum()))
        return tree

    def sum(self):
        tree = self.filtered()
        while self.peek() in ("+", "~"):
            sign = self.take()[1]
            tree = fold(("op", sign, tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.value()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = fold(("filter", name, tree))
        return tree

    def value(self):
        kind, token = self.take()
        if kind == "number":
            tree = ("const", int(token))
        elif kind == "string":
            tree = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        elif token == "(":
            tree = self.either()
            self.take(")")
        elif kind == "word":
            tree = ("const", _WORDS[token]) if token in _WORDS else ("name", token)
        else:
            raise TemplateError(f"unexpected {token!r}")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                tree = ("key", tree, ("const", self.take()[1]))
            else:
                tree = ("key", tree, self.either())
                self.take("]")
        return tree


_COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}
_OPERATIONS = _COMPARE | {"+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a}


def fold(tree):
    """Constant of an expression whose parts are all constant."""
    if tree[0] in ("op", "filter") and all(part[0] == "const" for part in tree[2:]):
        return ("const", _closure(tree)({}))
    if tree[0] == "op" and tree[1] in ("and", "or") and tree[2][0] == "const":
        return tree[3] if bool(tree[2][1]) == (tree[1] == "and") else tree[2]
    return tree


def _closure(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]

        def look(scope):
            if name not in scope:
                raise TemplateError(f"no variable {name!r}")
            return scope[name]

        return look
    parts = [_closure(part) for part in tree[1 if kind == "key" else 2 :]]
    if kind == "key":
        whole, key = parts

        def get(scope):
            value, k = whole(scope), key(scope)
            if not isinstance(value, dict):
                raise TemplateError(f"{k!r} of something that is no dictionary")
            return value.get(k)

        return get
    if kind == "filter":
        apply, (inner,) = FILTERS[tree[1]], parts
        return lambda scope: apply(inner(scope))
    if tree[1] == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if tree[1] == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    operation = _OPERATIONS[tree[1]]
    if len(parts) == 1:
        return lambda scope: operation(parts[0](scope))
    left, right = parts
    return lambda scope: operation(left(scope), right(scope))


# -- statements: ("text", s), ("put", e), ("if", [(e, body)...]), ("for", name, e, body), ("set", name, e), ("generation", body)

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)


def parse(source: str) -> list[tuple]:
    """Tree of a template with constants folded: texts next to each other are joined, branches that cannot be taken are gone."""
    parts, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if m[1] or m[4] else text))
        parts.append(("put", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        trim, at = bool(m[3] or m[6]), m.end()
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    position = 0

    def body(*ends: str) -> tuple[list[tuple], str, str]:
        nonlocal position
        out: list[tuple] = []

        def add(node):
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)

        while position < len(parts):
            kind, content = parts[position]
            position += 1
            if kind == "text":
                add(("text", content))
                continue
            if kind == "put":
                tree = _Expression(content).whole()
                add(("text", _text(tree[1])) if tree[0] == "const" else ("put", tree))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return out, word, rest
            if word == "if":
                branches, test, otherwise = [], _Expression(rest).whole(), False
                while True:
                    inner, word, rest = body("endif") if otherwise else body("elif", "else", "endif")
                    if test != ("const", False) and not (test[0] == "const" and not test[1]):
                        branches.append((test, inner))
                    if word == "endif":
                        break
                    otherwise = word == "else"
                    test = ("const", True) if otherwise else _Expression(rest).whole()
                if branches and branches[0][0][0] == "const":
                    for node in branches[0][1]:
                        add(node)
                elif branches:
                    add(("if", branches))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"for {rest!r}")
                add(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"set {rest!r}")
                add(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                add(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", ""

    return body()[0]


Piece = tuple[str | None, bool]  # text, and whether a model learns to write it
CUT: Piece = (None, False)  # a place between loop items, where the output may be cut


def _statements(nodes: list[tuple], learned: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_statement(node, learned) for node in nodes]

    def run(scope):
        for step in steps:
            yield from step(scope)

    return run


def _statement(node: tuple, learned: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], learned)
        return lambda scope: (piece,)
    if kind == "put":
        value = _closure(node[1])
        return lambda scope: ((_text(value(scope)), learned),)
    if kind == "generation":
        return _statements(node[1], True)
    if kind == "set":
        name, value = node[1], _closure(node[2])

        def store(scope):
            scope[name] = value(scope)
            return ()

        return store
    if kind == "if":
        branches = [(_closure(test), _statements(inner, learned)) for test, inner in node[1]]

        def choose(scope):
            for test, inner in branches:
                if test(scope):
                    return inner(scope)
            return ()

        return choose
    name, items, inner = node[1], _closure(node[2]), _statements(node[3], learned)

    def repeat(scope):
        found = items(scope)
        if isinstance(found, (str, dict)):
            raise TemplateError("for needs a list")
        index, ahead = 0, iter(found)
        item = next(ahead, None)
        while item is not None:
            following = next(ahead, None)
            index += 1
            inside = {**scope, name: item, "loop": {"index": index, "first": index == 1, "last": following is None}}
            yield from inner(inside)
            yield CUT
            item = following

    return repeat


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """Function from variables to the pieces of the output. Lists are read one item ahead, so they may be iterators."""
    return _statements(parse(source), False)


PART = 1_000_000  # characters from which a conversation's output goes on in a further row


def _parts(batches: Iterable[pa.RecordBatch], template: str):
    render = compile_template(template)

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    stream = rows()
    row = next(stream, None)
    names = ["conv", "part", "formatted", "starts", "ends", "turns"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
    done: list[tuple] = []

    def flush():
        nonlocal done, size
        cols, done, size = list(zip(*done)), [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    size = 0
    while row is not None:
        first = row[0]
        turns = 0

        def messages():
            nonlocal row, turns
            while row is not None and row[0] == first:
                message = {"role": row[2], "text": row[3] or ""}
                row = next(stream, None)
                turns += 1
                yield message

        text, starts, ends, length, part = [], [], [], 0, 0
        for piece, learned in render({"messages": messages()}):
            if piece is not None:
                if learned and piece:
                    starts.append(length)
                    ends.append(length + len(piece))
                text.append(piece)
                length += len(piece)
            elif length >= PART:
                done.append((first, part, "".join(text), starts, ends, 0))
                text, starts, ends, length, part = [], [], [], 0, part + 1
                yield flush()
        for _ in messages():  # turns the template did not ask for
            pass
        done.append((first, part, "".join(text), starts, ends, turns))
        size += length
        if size >= PART or len(done) >= 5000:
            yield flush()
    if done:
        yield flush()


def format_conversations(df: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Render every conversation: ``<conv>, part, formatted, starts, ends, turns``.

    ``starts`` and ``ends`` are the learned spans in characters of ``formatted``. A conversation is one row; one longer than a million
    characters goes on in rows ``part`` 1, 2, ..., cut between loop items, and its last row holds the number of turns (others 0).
    Turns come in order of ``turn`` (null last), ties by role and text; repeated turns are rendered again. Null texts are empty,
    null roles are none to the template. Rows without a conversation form one. ``<conv>`` is a whole number.

    Turns are sorted inside partitions and streamed, so a conversation of any length needs the memory of one part.
    """
    rows = df.select(df[conv].cast("long").alias("conv"), df[turn].alias("turn"), df[role].alias("role"), df[text].alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    schema = "conv long, part int, formatted string, starts array<int>, ends array<int>, turns long"
    return ordered.mapInArrow(lambda batches: _parts(batches, template), schema).withColumnRenamed("conv", conv)


_TURN = re.compile(r"<s>(?:((?:(?!</?s>|\[/?INST\]).)*)\[INST\] ((?:(?!</?s>|\[/?INST\]).)*) \[/INST\]|assistant ((?:(?!</?s>|\[/?INST\]).)*)</s>)", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the output of ``TEMPLATE``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
        turns.append(("assistant", unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _conversation_digests(batches):
    state = None
    for batch in batches:
        out = []
        for conv, part, formatted, starts, ends, turns in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                if state is not None:
                    out.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_back(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(starts, ends):
                learned = unescape(formatted[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(formatted)
        if out:
            yield _digest_rows(out)
    if state is not None:
        yield _digest_rows([state])


def _digest_rows(states):
    cols = list(zip(*((c, n, t.hexdigest(), k, s.hexdigest(), f) for c, n, t, k, s, f in states)))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of conversations read back from the rows of ``format_conversations`` (its rows of a conversation lie together)."""
    rows = formatted.select(conv, "part", "formatted", "starts", "ends", "turns")
    return rows.mapInArrow(_conversation_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
