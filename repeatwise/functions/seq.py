"""Column expressions on bases, qualities and tracts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PHRED_OFFSET = 33


def phred_array(qual: Column) -> Column:
    """Phred+33 string to an array of integer qualities."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - F.lit(PHRED_OFFSET))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def reverse_complement(seq: Column) -> Column:
    """Complement of ACGT in either case, every other letter becomes N, read backwards."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def rotate_left(unit: Column, by: Column) -> Column:
    return F.concat(F.substring(unit, by + 1, F.length(unit)), F.substring(unit, F.lit(1), by))


def tract_sequence(unit: Column, length: Column) -> Column:
    """Bases of a tract: whole units, then the part of one that is left."""
    size = F.length(unit)
    whole = F.floor(length / size).cast("int")
    return F.concat(F.repeat(unit, whole), F.substring(unit, F.lit(1), (length % size).cast("int")))


def solexa_to_sanger(qual: Column) -> Column:
    """Solexa log-odds string (offset 64) to Phred+33, truncating towards zero.

    The translation table is computed once on the driver for the 63 printable codes 64..126.
    """
    import math

    source = "".join(chr(c) for c in range(64, 127))
    target = "".join(
        chr(int(-10 * math.log10(1 / (10 ** ((c - 64) / 10) + 1)) + PHRED_OFFSET)) for c in range(64, 127)
    )
    return F.translate(qual, source, target)


def clip(text: Column, start: Column, stop: Column) -> Column:
    """Bases start..stop (1-based, inclusive), limited to the text."""
    first = F.greatest(start, F.lit(1))
    return F.substring(text, first, F.greatest(stop - first + 1, F.lit(0)))
