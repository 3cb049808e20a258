"""Secret scan: fixed patterns, and windows of high Shannon entropy over strings of one character class.

Only DataFrame functions run here, and there is no shuffle. Candidate strings are the longest runs of a class's characters. A window
slides over each: one character enters and one leaves, their two counts change, and with them the sum of ``c * log2(c)`` that
the entropy is made of. A candidate is reported from its first to its last window that reaches the class's bits, unless the
allow-list knows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Patterns whose matches are always reported: kind, pattern, group whose length counts, least length (fixed values).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the longest runs, of which shorter ones do not count
)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class CharacterClass:
    """Characters of a kind of secret, the window that slides over their runs, the bits a window must reach, and what runs must not match."""

    kind: str
    characters: str
    window: int
    bits: float
    without: str = "$^"

    @property
    def pattern(self) -> str:
        return "[" + "".join("\\" + c if c in "-+/" else c for c in self.characters) + "]{%d,}" % self.window


#: Random strings of these classes reach about 3.5 and 4.0 bits in a window of 20; joined words of prose stay near 3.3.
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", 20, 3.0),
    CharacterClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_-", 20, 3.7, without="^[0-9A-Fa-f]+$"),
)
#: Candidates that match one of these are no secrets.
ALLOWED = (
    "(?i)example|sample|dummy|placeholder|changeme",
    "(?i)0123456789|1234567890|abcdefghij",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs
    r"(?i)^sha(1|256|384|512)-",  # checksums of resources
)
#: A secret has digits between letters; words, numbers, paths and dates have not.
MIXED = "[A-Za-z][0-9]+[A-Za-z]"
BLOCK = 512  # windows of a candidate looked at in one go
_SCALE = 1_000_000  # entropies are summed in whole numbers, so that windows do not drift


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spread(reach: int) -> Callable[[Column], Column]:
    """Adds to each value the 31 values that lie ``reach``, 2 ``reach``, ... places before it."""

    def add(whole: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(31))
        added = F.transform(whole, lambda x, i: F.aggregate(steps, x, lambda s, j: s + F.coalesce(F.get(whole, i - j * reach), F.lit(0))))
        return F.when(F.size(whole) > reach, added).otherwise(whole)

    return add


def running_sums(values: Column) -> Column:
    """Sums of an array's values up to each place, in rounds of 31 additions to each value, each reaching 32 times as far as the one before."""
    for k in range(6):
        values = _let(values, _spread(32**k))
    return values


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (start, text, value) with starts in code points from 0; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def placed(parts: Column) -> Column:
        between, hits = parts["between"], parts["hits"]
        # a match begins behind all text between matches and all matches before it
        widths = F.transform(hits, lambda h, i: (F.length(F.get(between, i)) + F.length(h)).cast("long"))
        return _let(running_sums(widths), lambda ends: F.transform(hits, lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"), h.alias("text"), (F.get(parts["values"], i) if group else h).alias("value"))))

    parts = F.struct(F.split(text, pattern, -1).alias("between"), found.alias("hits"), (value if group else F.lit(None)).alias("values"))
    return F.when(text.rlike(pattern), _let(parts, placed))


def densest(candidate: Column, kind: CharacterClass) -> Column:
    """Windows of a candidate that reach the bits: struct (first, last, spread), null if none.

    ``first`` and ``last`` are the start of the first and the end of the last of them, ``spread`` the least sum of ``c * log2(c)``,
    scaled. Candidates are cut into blocks that overlap by a window less one character, so that no array grows with a candidate's square.
    """
    width = kind.window
    weight = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0) for c in range(width + 1)])
    limit = math.floor(width * (math.log2(width) - kind.bits) * _SCALE)
    none = F.lit(None).cast("int")
    start = F.struct(
        F.array_repeat(F.lit(0), len(kind.characters)).alias("counts"), F.lit(0).alias("sum"), none.alias("first"), none.alias("last"), none.alias("spread"))

    def scan(block: Column) -> Column:
        letters = F.transform(F.split(block, ""), lambda c: F.call_function("locate", c, F.lit(kind.characters)) - 1)

        def step(state: Column, i: Column, whole: Column) -> Column:
            enter, leave = F.get(whole, i), F.get(whole, i - width)  # no character leaves before the window is full
            gone = F.get(state["counts"], leave)
            total = state["sum"] - F.coalesce(F.get(weight, gone) - F.get(weight, gone - 1), F.lit(0))
            held = F.get(state["counts"], enter) - F.when(enter == leave, 1).otherwise(0)
            total = total + F.get(weight, held + 1) - F.get(weight, held)
            counts = F.transform(state["counts"], lambda c, j: c + F.when(j == enter, 1).otherwise(0) - F.when(j == leave, 1).otherwise(0))

            def moved(sum_: Column) -> Column:
                good = (i >= width - 1) & (sum_ <= limit)
                return F.struct(
                    counts.alias("counts"), sum_.alias("sum"),
                    F.when(good & state["first"].isNull(), i - width + 1).otherwise(state["first"]).alias("first"),
                    F.when(good, i + 1).otherwise(state["last"]).alias("last"),
                    F.when(good, F.least(state["spread"], sum_)).otherwise(state["spread"]).alias("spread"))

            return _let(total, moved)

        return _let(letters, lambda whole: F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), start, lambda state, i: step(state, i, whole), lambda s: F.struct(
            s["first"].alias("first"), s["last"].alias("last"), s["spread"].alias("spread"))))

    blocks = F.regexp_extract_all(candidate, F.lit("(?=(.{1,%d})).{1,%d}" % (BLOCK + width - 1, BLOCK)), F.lit(1))
    passing = F.filter(F.transform(blocks, lambda b, j: _let(scan(b), lambda s: F.struct((s["first"] + j * BLOCK).alias("first"), (s["last"] + j * BLOCK).alias("last"), s["spread"].alias("spread")))),
                       lambda s: s["first"].isNotNull())
    return _let(passing, lambda p: F.when(F.size(p) > 0, F.struct(
        F.array_min(F.transform(p, lambda s: s["first"])).alias("first"), F.array_max(F.transform(p, lambda s: s["last"])).alias("last"), F.array_min(F.transform(p, lambda s: s["spread"])).alias("spread"))))


def _base_spans(text: Column) -> Column:
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        good = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
        kinds.append(F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["text"])).alias("end"), F.lit(None).cast("double").alias("bits"))))
    return _together(kinds)


def _entropy_spans(text: Column, classes: tuple[CharacterClass, ...], allowed: tuple[str, ...]) -> Column:
    kinds = []
    for rank, kind in enumerate(classes, start=len(BASE)):

        def known(m: Column, kind: CharacterClass = kind) -> Column:
            found = ~m["text"].rlike(MIXED) | m["text"].rlike(kind.without)
            for pattern in allowed:
                found = found | m["text"].rlike(pattern)
            return found

        candidates = F.filter(matches(text, kind.pattern), lambda m: ~known(m))
        dense = F.filter(F.transform(candidates, lambda m: F.struct(m["start"].alias("start"), densest(m["text"], kind).alias("w"))), lambda d: d["w"].isNotNull())
        kinds.append(F.transform(dense, lambda d: F.struct(
            (d["start"] + d["w"]["first"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.kind).alias("kind"), (d["start"] + d["w"]["last"]).alias("end"),
            (F.lit(math.log2(kind.window)) - d["w"]["spread"] / (_SCALE * kind.window)).alias("bits"))))
    return _together(kinds)


def _together(kinds: list[Column]) -> Column:
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,bits:double>>")
    return F.array_sort(F.concat(empty, *[F.coalesce(k, empty) for k in kinds]))


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Secrets in every whole text: ``<key>, base, added``, one row for each row of ``df``.

    Both are arrays of (start, rank, kind, end, bits), sorted by start and then by kind, in code points, end exclusive. ``base`` holds the
    matches of ``BASE``: leftmost ones that do not overlap within a kind, with matches that are too short used up but dropped.
    ``added`` holds the spans of high entropy of each class with the greatest entropy of a window, without those inside a span of ``base``;
    the allow-list suppresses candidates of this kind only.

    Null and empty texts have none. Keys of any type may be null or repeat; other columns are ignored; empty tables give no rows. A
    text is searched in one task; its matches are placed in steps that grow with n log n and windows are counted block by block.
    """
    rows = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    found = rows.select("key", _base_spans(F.col("text")).alias("base"), _entropy_spans(F.col("text"), classes, allowed).alias("dense"))
    fresh = F.filter("dense", lambda d: ~F.exists("base", lambda b: (b["start"] <= d["start"]) & (b["end"] >= d["end"])))
    return found.select(F.col("key").alias(key), "base", fresh.alias("added"))


def span_text(spans: Column) -> Column:
    """Print form ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
