"""Read preparation: trims, gates, encodings and tallies, as row expressions over ``reads``."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import seq as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

MIN_QUALITY = 20
MIN_DETECT_LENGTH = 10
MAX_N = 3


def trim_barcode(df: DataFrame, size: int) -> DataFrame:
    """Drop the first ``size`` bases; a read no longer than that becomes one low-quality N of usable length 0."""
    fits = F.length("seq") > size
    tail = lambda c: F.substring(F.col(c), F.lit(size + 1), F.length(c))
    return df.select(
        *[c for c in df.columns if c not in ("seq", "qual")],
        F.when(fits, tail("seq")).otherwise("N").alias("seq"),
        F.when(fits, tail("qual")).otherwise("#").alias("qual"),
        F.when(fits, F.length("seq") - size).otherwise(0).alias("usable"),
    )


STEP = 1 << 20  # characters of qualities walked at a time


def area_cuts(codes: np.ndarray, sizes: np.ndarray, min_quality: int) -> np.ndarray:
    """Bases cut from the 3' end of each of the strings (none empty) whose code points lie one after another in ``codes``."""
    deficits = min_quality + 33 - codes[::-1].astype(np.int64)
    lengths = sizes[::-1]
    starts = np.cumsum(lengths) - lengths
    inside = lambda running, own: running - np.repeat(running[starts] - own[starts], lengths)
    area = inside(np.cumsum(deficits), deficits)
    stopped = (area < 0).astype(np.int64)
    alive = inside(np.cumsum(stopped), stopped) == 0
    best = np.maximum.reduceat(np.where(alive, area, 0), starts)
    seen = np.arange(len(area)) - np.repeat(starts, lengths) + 1
    peak = alive & (area == np.repeat(best, lengths))
    first = np.minimum.reduceat(np.where(peak, seen, len(area) + 1), starts)
    return np.where(best > 0, first, 0)[::-1]


def _trim_area(qual: Column, min_quality: int) -> Column:
    """Kept length under the running-sum rule: walk from the 3' end, cut where the deficit peaks."""

    def cuts(column: pa.Array) -> pa.Array:
        texts = column.cast(pa.large_string()).fill_null("").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.where(sizes == 0, int(min_quality + 33 > 0), 0)  # an empty string counts as one base of code 0
        filled = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[filled])
        for part in np.split(filled, np.flatnonzero(np.diff(ends // STEP)) + 1):
            if len(part):
                codes = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
                out[part] = area_cuts(codes, sizes[part], min_quality)
        return pa.array(out.astype(np.int32))

    return F.length(qual) - F.arrow_udf(cuts, "int")(qual)


def kept_length(qual: Column, style: str, min_quality: int = MIN_QUALITY) -> Column:
    """Bases kept from the 5' end for trim styles none, area, first_bad and last_good."""
    low = "[" + "".join("\\" + chr(c) for c in range(33, 33 + min_quality) if not chr(c).isalnum())
    low += "".join(chr(c) for c in range(33, 33 + min_quality) if chr(c).isalnum()) + "]"
    if style == "none":
        return F.length(qual)
    if style == "area":
        return _trim_area(qual, min_quality)
    if style == "first_bad":
        return F.length(F.regexp_replace(qual, low + "(?s).*$", ""))
    if style == "last_good":
        return F.length(F.regexp_replace(qual, low + "+$", ""))
    raise ValueError(f"unknown trim style {style!r}")


def trim(df: DataFrame, style: str, min_quality: int = MIN_QUALITY) -> DataFrame:
    """Quality trim; keeps the raw strings as ``raw_seq``/``raw_qual``."""
    kept = df.withColumn("kept", kept_length(F.col("qual"), style, min_quality))
    return kept.select(
        *[c for c in df.columns if c not in ("seq", "qual")], F.col("seq").alias("raw_seq"), F.col("qual").alias("raw_qual"), "kept",
        F.substring(F.col("seq"), F.lit(1), F.col("kept")).alias("seq"), F.substring(F.col("qual"), F.lit(1), F.col("kept")).alias("qual"),
    )


def detect_gate(df: DataFrame, min_length: int = MIN_DETECT_LENGTH, max_n: int = MAX_N) -> DataFrame:
    """Flag reads worth searching; the others stay in the table without tracts."""
    return df.withColumn("n_count", S.count_char(F.col("raw_seq"), "N")).withColumn(
        "detect", (F.col("kept") >= min_length) & (F.col("n_count") < max_n)
    )


def passed_reads(df: DataFrame, paired: bool) -> DataFrame:
    """Sequencer filter: own flag, or the flags of both mates."""
    if not paired:
        return df.filter("passed")
    bad = df.filter(~F.col("passed")).select("read_id").distinct()
    return df.join(bad, "read_id", "left_anti")


def pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per complete pair, whatever the order of the input."""
    side = lambda mate: df.filter(F.col("mate") == mate).select(
        "read_id", *[F.col(c).alias(f"{c}_{mate}") for c in columns]
    )
    return side(1).join(side(2), "read_id")


def mate_violations(df: DataFrame) -> DataFrame:
    """Names that are not exactly one first and one second mate."""
    return df.groupBy("read_id").agg(
        F.count_if(F.col("mate") == 1).alias("firsts"), F.count_if(F.col("mate") == 2).alias("seconds")
    ).filter((F.col("firsts") != 1) | (F.col("seconds") != 1))


def with_tract_only(reads: DataFrame) -> DataFrame:
    """Keep reads of pairs in which either mate holds a tract; reads carry their tracts. Mates meet by name, one of each."""
    mates = reads.withColumn("held", F.max(F.size("tracts") > 0).over(Window.partitionBy("read_id")))
    return mates.filter("held").drop("held")


def guess_encoding(df: DataFrame) -> DataFrame:
    """Quality encoding per file from all its reads, in one partial aggregate."""
    votes = df.groupBy("file").agg(
        F.max(F.col("qual").rlike("[!-:]")).alias("low"), F.max(F.col("qual").rlike("[K-h]")).alias("high")
    )
    return votes.select("file", F.when(F.col("low"), "phred33").when(F.col("high"), "phred64").otherwise("unknown").alias("encoding"))


def validate_fastq(df: DataFrame) -> DataFrame:
    """Violations per file over raw four-line records ``file, l1, l2, l3, l4``."""
    return df.groupBy("file").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.coalesce(F.col("l1").startswith("@"), F.lit(False))).alias("bad_header"),
        F.count_if(~F.coalesce(F.col("l2").rlike("^[ACGTN]+$"), F.lit(False))).alias("bad_sequence"),
        F.count_if(~F.coalesce(F.col("l3").startswith("+"), F.lit(False))).alias("bad_separator"),
        F.count_if(F.col("l4").isNull()).alias("incomplete"),
    )


def length_mismatches(df: DataFrame) -> DataFrame:
    return df.filter(F.length("seq") != F.length("qual"))


def tallies(df: DataFrame, min_length: int = MIN_DETECT_LENGTH, max_n: int = MAX_N) -> DataFrame:
    """In/out counts of the preparation step from a trimmed and gated table, in one partial aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("reads_in"),
        F.sum(F.length("raw_seq") - F.col("kept")).cast("long").alias("trimmed_bases"),
        F.count_if(F.col("kept") < min_length).alias("too_short"),
        F.count_if((F.col("kept") >= min_length) & (F.col("n_count") >= max_n)).alias("too_many_n"),
        F.count_if(F.col("detect")).alias("submitted"),
    )


def parse_header(header: Column) -> Column:
    """Read name, mate and filter flag from ``name N:Y/N:...`` or ``name/N`` headers; a header without a mate digit has a null mate."""
    spaced = header.contains(" ")
    tail = F.substring_index(header, " ", -1)
    return F.struct(
        F.when(spaced, F.substring_index(header, " ", 1)).otherwise(F.substring_index(header, "/", 1)).alias("name"),
        F.when(spaced, F.regexp_extract(header, r"^[^ ]* (\d)", 1)).otherwise(F.right(header, F.lit(1))).try_cast("int").alias("mate"),
        F.when(spaced, F.regexp_extract(header, r"^[^ ]* .(?:.)(.)", 1) != "Y").otherwise(F.lit(True)).alias("passed"),
    )
