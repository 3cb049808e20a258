"""Perfect tandem tracts: detection, flanks, condensed sequences and the offset index.

Detection is exact and needs no shuffle for reads. A tract of period ``p`` is a maximal run of bases equal to the
base ``p`` places before. Long sequences are cut into blocks that carry ``max_unit`` bases of left context, the
blocks are dealt out by a shuffle and searched on their own, and only runs that reach a block border meet again (a
window over at most a few rows per block). The cut itself is one pass in the task that holds the sequence.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import seq as S
from ..functions.scan import exclusive_scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

ISLAND_BLOCK = 1 << 20  # positions of a sequence whose tracts are put together in one window


@dataclass(frozen=True)
class Thresholds:
    """Detection thresholds; values below the floors fall back to the defaults."""

    min_unit: int = 1
    max_unit: int = 6
    min_length: int = 8
    min_units: int = 3

    def checked(self) -> "Thresholds":
        base = Thresholds()
        lo = self.min_unit if 1 <= self.min_unit <= 100 else base.min_unit
        hi = self.max_unit if lo <= self.max_unit <= 100 else max(base.max_unit, lo)
        return Thresholds(
            lo, hi,
            self.min_length if self.min_length >= 4 else base.min_length,
            self.min_units if self.min_units >= 2 else base.min_units,
        )

    def shortest(self, period: int) -> int:
        """Shortest tract of this period that can be reported."""
        return max(self.min_length, self.min_units * period, self.max_unit + period)


def blocks(df: DataFrame, keys: list[str], seq: str, size: int, *others: str) -> DataFrame:
    """Cut sequences (and strings parallel to them) into blocks in one linear pass.

    Adds ``blk`` (0-based), ``first`` (1-based position of the first base) and ``is_last``.
    """
    pieces = [F.regexp_extract_all(F.col(c), F.lit("(?s).{1,%d}" % size), 0).alias(c) for c in (seq, *others)]
    cut = df.select(*keys, *pieces).withColumn("n_blk", F.size(seq))
    return cut.select(*keys, "n_blk", F.posexplode(F.arrays_zip(seq, *others))).select(
        *keys,
        F.col("pos").alias("blk"),
        (F.col("pos") * size + 1).cast("long").alias("first"),
        (F.col("pos") == F.col("n_blk") - 1).alias("is_last"),
        *[F.col(f"col.{c}").alias(c) for c in (seq, *others)],
    )


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop (inclusive) of every run of True."""
    edges = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


_ACGT = np.zeros(256, bool)
_ACGT[list(b"ACGT")] = True


STEP = 1 << 20  # bytes of text searched at a time


def _steps(batch: pa.RecordBatch, seq: str, size: int = STEP) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in order, in parts of at most ``size`` bytes of text (or one row): the search takes many times the room of its text."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(seq)).to_numpy(zero_copy_only=False).astype(float))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _joined(column: pa.Array, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a column one after another with ``gap`` zero bytes around each, where each begins, and their lengths.

    One byte stands for one character: characters beyond ASCII become ``?``, which is no base.
    """
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if len(data) and data.max() > 127:
        texts = [t.encode("ascii", "replace") for t in column.to_pylist()]
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    else:
        sizes = np.diff(ends)
    offsets = np.cumsum(sizes + gap) - sizes
    joined = np.zeros(int(sizes.sum()) + gap * (len(sizes) + 1), np.uint8)
    joined[np.arange(len(data)) + np.repeat(gap * np.arange(1, len(sizes) + 1), sizes)] = data
    return joined, offsets, sizes


def _search(joined: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, contexts: np.ndarray, lasts: np.ndarray, continued: np.ndarray, limits: Thresholds):
    """Runs of all periods in one batch: one comparison per period over the joined bytes. Limits are applied to complete runs."""
    usable = _ACGT[joined]
    own = usable
    if contexts.any():
        own = usable.copy()
        for at, size in zip(offsets[contexts > 0], contexts[contexts > 0]):
            own[at : at + size] = False
    found = []
    for period in range(1, limits.max_unit + 1):
        same = np.zeros(len(joined), bool)
        same[period:] = (joined[period:] == joined[:-period]) & own[period:]
        begin, end = _runs(same)
        row = np.searchsorted(offsets, begin, side="right") - 1
        left = (begin - offsets[row] - period < contexts[row]) & continued[row]
        right = (end - offsets[row] == sizes[row] - 1) & ~lasts[row]
        keep = (end - begin + 1 >= limits.max_unit) | left | right
        found.append(np.stack([row, begin - offsets[row] - period, end - offsets[row], np.full_like(begin, period), left | right])[:, keep])
    row, start, stop, period, border = np.concatenate(found, axis=1)
    # smallest period wins among runs that describe the same bases and are complete in this block
    order = np.lexsort((period, stop, start, border, row))
    row, start, stop, period, border = (a[order] for a in (row, start, stop, period, border))
    keep = np.ones(len(row), bool)
    keep[1:] = ~((row[1:] == row[:-1]) & (start[1:] == start[:-1]) & (stop[1:] == stop[:-1]) & (border[1:] == 0) & (border[:-1] == 0))
    length = stop - start + 1
    keep &= (border == 1) | ((length >= limits.min_length) & (length // period >= limits.min_units) & (period >= limits.min_unit))
    return row[keep], start[keep], stop[keep], period[keep], border[keep].astype(bool)


def _slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """String column of the slices ``data[begin : begin + size]``."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    places = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[places].tobytes()))


def _tract_rows(df: DataFrame, keys: list[str], seq: str, limits: Thresholds) -> DataFrame:
    """Runs per block, from frames that hold ``seq``, ``ctx`` (bases of context), ``first``, ``blk``, ``is_last``."""
    names = list(keys)
    fields = [df.schema[k] for k in names] + [
        T.StructField("blk", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
        T.StructField("period", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("border", T.BooleanType()),
    ]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _steps(whole, seq)):
            joined, offsets, sizes = _joined(batch.column(seq), limits.max_unit)
            contexts = batch.column("ctx").to_numpy().astype(np.int64)
            first = batch.column("first").to_numpy()
            blk = batch.column("blk").to_numpy()
            row, start, stop, period, border = _search(
                joined, offsets, sizes, contexts, batch.column("is_last").to_numpy(zero_copy_only=False), blk > 0, limits
            )
            shift = first[row] - contexts[row]
            begin = np.maximum(start, 0)
            units = _slices(joined, offsets[row] + begin, np.minimum(start + period, sizes[row]) - begin)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(at) for k in names]
                + [
                    pa.array(blk[row].astype(np.int32)), pa.array(start + shift), pa.array(stop + shift),
                    pa.array(period.astype(np.int32)), units, pa.array(border),
                ],
                names=[f.name for f in fields],
            )

    return df.mapInArrow(search, T.StructType(fields))


def detect(df: DataFrame, keys: list[str], seq: str, limits: Thresholds = Thresholds(), block: int | None = None) -> DataFrame:
    """Perfect tandem tracts: ``keys, start, stop, length, unit`` (1-based, inclusive).

    ``block=None`` searches every row whole (reads: no shuffle at all). With ``block`` long sequences are split.
    """
    limits = limits.checked()
    upper = df.select(*keys, F.upper(F.col(seq)).alias(seq))
    if block is None:
        rows = _tract_rows(
            upper.withColumn("ctx", F.lit(0)).withColumn("first", F.lit(1).cast("long")).withColumn("blk", F.lit(0)).withColumn("is_last", F.lit(True)),
            keys, seq, limits,
        )
    else:
        size = max(block, limits.max_unit)
        context = limits.max_unit
        # previous block's tail travels with the block, taken from the same row: no shuffle
        cut = upper.select(*keys, F.regexp_extract_all(F.col(seq), F.lit("(?s).{1,%d}" % size), 0).alias("parts"))
        pieces = cut.select(*keys, F.size("parts").alias("n_blk"), F.posexplode(F.transform(
            F.arrays_zip(F.col("parts").alias("now"), F.concat(F.array(F.lit("")), F.col("parts")).alias("before")),
            lambda z: F.struct(F.right(z["before"], F.lit(context)).alias("tail"), z["now"].alias("body")),
        ))).filter(F.col("col.body").isNotNull())
        # the blocks of one long sequence are searched by many tasks
        return detect_blocks(pieces.select(
            *keys, F.col("pos").alias("blk"), (F.col("pos") * size + 1).cast("long").alias("first"),
            (F.col("pos") == F.col("n_blk") - 1).alias("is_last"), F.length("col.tail").alias("ctx"),
            F.concat("col.tail", "col.body").alias(seq),
        ).repartition(*keys, "blk"), keys, seq, limits)
    return _passing(rows, keys, limits)


def detect_blocks(pieces: DataFrame, keys: list[str], seq: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """Tracts of sequences that come as blocks: ``keys, blk, first`` (1-based), ``is_last, ctx`` and ``seq``, upper case, which begins with the ``ctx``
    (``max_unit``, or all there are) bases before the block."""
    limits = limits.checked()
    rows = _tract_rows(pieces, keys, seq, limits)
    return _passing(_join_borders(rows, keys, limits), keys, limits)


def _passing(rows: DataFrame, keys: list[str], limits: Thresholds) -> DataFrame:
    return rows.select(*keys, "start", "stop", (F.col("stop") - F.col("start") + 1).alias("length"), "unit").filter(
        (F.col("length") >= limits.min_length)
        & (F.floor(F.col("length") / F.length("unit")) >= limits.min_units)
        & (F.length("unit") >= limits.min_unit)
    )


def _join_borders(rows: DataFrame, keys: list[str], limits: Thresholds) -> DataFrame:
    """Join runs that continue over a block border and settle the smallest period among them.

    Complete runs keep a group of their own block, so no window or group ever holds a whole chromosome of tracts.
    """
    part = F.when(F.col("border"), F.lit(-1)).otherwise(F.col("blk"))
    # run positions (not tract positions) are what continues: run start = tract start + period
    by = Window.partitionBy(*keys, "period", "part").orderBy("start")
    marked = rows.withColumn("part", part).withColumn(
        "new", F.when(F.lag("stop").over(by) + 1 == F.col("start") + F.col("period"), 0).otherwise(1)
    )
    runs = marked.withColumn("grp", F.sum("new").over(by)).groupBy(*keys, "part", "period", "grp").agg(
        F.min_by("unit", "start").alias("unit"), F.min("start").alias("start"), F.max("stop").alias("stop")
    )
    whole = runs.filter(F.col("stop") - F.col("start") - F.col("period") + 1 >= limits.max_unit)
    return whole.groupBy(*keys, "start", "stop").agg(F.min_by("unit", "period").alias("unit"))


def sensitivity(tracts: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Shortest reportable length per period beside what the data holds."""
    limits = limits.checked()
    floor = F.greatest(F.lit(limits.min_length), F.lit(limits.min_units) * F.col("period"), F.lit(limits.max_unit) + F.col("period"))
    return tracts.groupBy(F.length("unit").alias("period")).agg(
        F.count(F.lit(1)).alias("n_tracts"), F.min("length").alias("shortest_found")
    ).withColumn("shortest_detectable", floor)


def mark_terminal(tracts: DataFrame, seq_length: str) -> DataFrame:
    """``passed`` is false, and the unit lower case, for tracts that touch either end of the (trimmed) read."""
    terminal = (F.col("start") == 1) | (F.col("stop") == F.col(seq_length))
    return tracts.withColumn("passed", ~terminal).withColumn("unit", F.when(terminal, F.lower("unit")).otherwise(F.col("unit")))


def flanks(df: DataFrame, seq: str, size: int = 30) -> DataFrame:
    """5' and 3' flank, clipped to the sequence, and a snapshot with the tract in upper case."""
    text = F.col(seq)
    front = S.clip(text, F.col("start") - size, F.col("start") - 1)
    rear = S.clip(text, F.col("stop") + 1, F.col("stop") + size)
    return df.withColumn("front_flank", front).withColumn("rear_flank", rear).withColumn(
        "snapshot", F.concat(F.lower(front), F.upper(S.clip(text, F.col("start"), F.col("stop"))), F.lower(rear))
    )


def islands(tracts: DataFrame, keys: list[str], block: int = ISLAND_BLOCK) -> DataFrame:
    """Union of tracts: overlapping or adjacent ones become one island.

    Blocks of positions are searched on their own. A block is given how far earlier tracts reach, which tells which of its tracts begin an
    island, and then where the last island before it begins, to which its tracts before the first own beginning belong.
    """
    placed = _blocked(tracts.select(*keys, "start", "stop"), keys, block)
    here = Window.partitionBy(*keys, "blk").orderBy("start", "stop")
    reaches = exclusive_scan(placed.groupBy(*keys, "blk").agg(F.max("stop").alias("value")), keys, "max")
    reach = F.greatest(F.max("stop").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry"))
    headed = placed.join(reaches, [*keys, "blk"], "left").withColumn("reach", reach).withColumn(
        "head", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), F.col("start")))
    parts = headed.withColumn("head", F.max("head").over(here.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "blk", "head").agg(F.max("stop").alias("stop"))
    heads = exclusive_scan(parts.groupBy(*keys, "blk").agg(F.max("head").alias("value")), keys, "max")
    whole = parts.join(heads, [*keys, "blk"], "left").withColumn("start", F.coalesce("head", "carry"))
    return whole.groupBy(*keys, "start").agg(F.max("stop").alias("stop"))


def _blocked(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows dealt out by key and block of positions; the steps of a scan share this one shuffle."""
    return rows.withColumn("blk", F.floor((F.col("start") - 1) / block)).repartition(*keys, "blk")


def offset_index(tracts: DataFrame, keys: list[str], block: int = ISLAND_BLOCK) -> DataFrame:
    """One row per island: condensed position of the base after it, and bases removed so far (summed block by block)."""
    placed = _blocked(islands(tracts, keys, block), keys, block)
    bases = F.col("stop") - F.col("start") + 1
    before = exclusive_scan(placed.groupBy(*keys, "blk").agg(F.sum(bases).alias("value")), keys, "sum")
    here = Window.partitionBy(*keys, "blk").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    removed = F.sum(bases).over(here) + F.coalesce("carry", F.lit(0))
    return placed.join(before, [*keys, "blk"], "left").withColumn("offset", removed).select(
        *keys, (F.col("stop") - F.col("offset") + 1).alias("position"), "offset"
    )


def condense(seqs: DataFrame, tracts: DataFrame, keys: list[str], columns: list[str], block: int = 1 << 14) -> DataFrame:
    """Excise all tracts from parallel strings, block by block (a read is one block).

    Output per (keys, blk): the condensed strings; concatenating blocks in order gives the condensed sequence.
    """
    pieces = blocks(seqs, keys, columns[0], block, *columns[1:])
    cuts = islands(tracts, keys).select(
        *keys, "start", "stop",
        F.explode(F.sequence(F.floor((F.col("start") - 1) / block).cast("int"), F.floor((F.col("stop") - 1) / block).cast("int"))).alias("blk"),
    ).withColumn("base", F.col("blk").cast("long") * block)
    local = cuts.groupBy(*keys, "blk").agg(
        F.array_sort(F.collect_list(F.struct(
            F.greatest(F.col("start") - F.col("base"), F.lit(1)).cast("int").alias("s"),
            F.least(F.col("stop") - F.col("base"), F.lit(block)).cast("int").alias("e"),
        ))).alias("cuts")
    )
    joined = pieces.join(local, [*keys, "blk"], "left")
    stops = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["e"]))
    starts = F.concat(F.transform("cuts", lambda c: c["s"]), F.array(F.length(columns[0]) + 1))

    def excised(name: str) -> Column:
        keep = F.zip_with(stops, starts, lambda e, s: F.substring(F.col(name), e + 1, s - e - 1))
        return F.when(F.col("cuts").isNull(), F.col(name)).otherwise(F.array_join(keep, ""))

    return joined.select(*keys, "blk", *[excised(c).alias(c) for c in columns])


def carry_tracts(reads: DataFrame, seq: str = "seq", limits: Thresholds = Thresholds()) -> DataFrame:
    """Reads with all their columns and ``tracts``, the array of their tracts (start, stop, length, unit) by start: one pass, no shuffle."""
    limits = limits.checked()
    names = reads.columns
    fields = [T.StructField(n, t) for n, t in (("start", T.LongType()), ("stop", T.LongType()), ("length", T.LongType()), ("unit", T.StringType()))]
    schema = T.StructType([*reads.schema.fields, T.StructField("tracts", T.ArrayType(T.StructType(fields)))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _steps(whole, "_upper")):
            joined, offsets, sizes = _joined(batch.column("_upper"), limits.max_unit)
            n = batch.num_rows
            row, start, stop, period, _ = _search(joined, offsets, sizes, np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool), limits)
            tracts = pa.StructArray.from_arrays(
                [pa.array(start + 1), pa.array(stop + 1), pa.array(stop - start + 1), _slices(joined, offsets[row] + start, period)], [f.name for f in fields])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(ends), tracts)], names=[*names, "tracts"])

    return reads.withColumn("_upper", F.upper(seq)).mapInArrow(search, schema)


def with_tracts(reads: DataFrame, tracts: DataFrame, keys: list[str]) -> DataFrame:
    """Attach tracts that are kept in a table of their own; reads without tracts get an empty list. Reads at hand carry theirs (``carry_tracts``)."""
    listed = tracts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "length", "unit"))).alias("tracts"))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,length:bigint,unit:string>>")
    return reads.join(listed, keys, "left").withColumn("tracts", F.coalesce("tracts", empty))


def each_tract(reads: DataFrame) -> DataFrame:
    """One row per carried tract: the read's columns, then the tract's."""
    return reads.select(*[c for c in reads.columns if c != "tracts"], F.inline("tracts"))


def condensed(text: Column, tracts: Column) -> Column:
    """Text of a read without the bases that its tracts cover."""
    zero = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("last"))

    def step(a: Column, t: Column) -> Column:
        gap = F.greatest(t["start"] - a["last"] - 1, F.lit(0)).cast("int")
        return F.struct(
            F.concat(a["done"], F.substring(text, (a["last"] + 1).cast("int"), gap)).alias("done"), F.greatest(a["last"], t["stop"]).cast("long").alias("last"))

    return F.aggregate(tracts, zero, step, lambda a: F.concat(a["done"], F.substring(text, (a["last"] + 1).cast("int"), F.length(text))))


def tract_quality(df: DataFrame, qual: str) -> DataFrame:
    """Quality substring of a tract with its mean and population standard deviation."""
    text = F.substring(F.col(qual), F.col("start").cast("int"), F.col("length").cast("int"))
    scores = S.phred_array(text)
    total = F.aggregate(scores, F.lit(0.0), lambda a, q: a + q)
    mean = total / F.col("length")
    spread = F.aggregate(S.phred_array(F.col("tract_qual")), F.lit(0.0), lambda a, q: a + (q - F.col("qual_mean")) * (q - F.col("qual_mean")))
    return df.withColumn("tract_qual", text).withColumn("qual_mean", mean).withColumn(
        "qual_sd", F.sqrt(spread / F.col("length"))
    )


def tract_text(unit: Column, start: Column, length: Column) -> Column:
    """Print form ``unit:start:length``."""
    return F.concat_ws(":", unit, start.cast("string"), length.cast("string"))


def parse_tract_text(text: Column) -> Column:
    part = F.split(text, ":", 4)
    return F.struct(part[0].alias("unit"), part[1].cast("long").alias("start"), part[2].cast("long").alias("length"), F.get(part, F.lit(3)).alias("qual"))


def subsequence(seqs: DataFrame, ranges: DataFrame, key: str, seq: str) -> DataFrame:
    """Bases start..stop of the named sequence for every range.

    The sequence side is cut to blocks and each range asks only for the blocks it touches, so a chromosome string
    is never copied once per range.
    """
    size = 1 << 14
    pieces = blocks(seqs, [key], seq, size)
    asked = ranges.withColumn("rid", F.xxhash64(key, "start", "stop")).select(
        key, "start", "stop", F.explode(F.sequence(F.floor((F.col("start") - 1) / size).cast("int"), F.floor((F.col("stop") - 1) / size).cast("int"))).alias("blk")
    ).distinct()
    part = S.clip(F.col(seq), (F.col("start") - F.col("first") + 1).cast("int"), (F.col("stop") - F.col("first") + 1).cast("int"))
    return asked.join(pieces, [key, "blk"]).groupBy(key, "start", "stop").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", part.alias("s")))), lambda p: p["s"]), "").alias("bases")
    )
