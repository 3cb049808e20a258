"""Placing read tracts on the genome: as-of offsets, strand remap, coordinates and tags."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import seq as S
from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def attach_tracts(alignments: DataFrame, tracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alignments with their tract list, and the tracts whose read has no alignment (an error frame)."""
    keys = ["read_id", "mate"]
    return alignments.join(tracts, keys, "left"), tracts.join(alignments.select(*keys).distinct(), keys, "left_anti")


def mappable(df: DataFrame) -> Column:
    return F.col("mapped") & (F.col("mapq") > 0)


def asof_offsets(reads: DataFrame, index: DataFrame, chrom: str, at: str, ranges: int | None = None) -> DataFrame:
    """Largest index position at or below ``at``: adds ``index_position`` and ``offset`` (0 before the first one).

    Reads and index share one range partitioning over (chromosome, position, index first), so each range is a sorted merge that remembers
    the last index row it has passed; reads at one busy position may fall into several ranges. One row per range, its last index row,
    is carried over the ranges that follow, for reads that come before the first index row of theirs.
    """
    spark = reads.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = reads.withColumn("_at", F.col(at).cast("long")).withColumn("_salt", F.xxhash64(*reads.columns)).withColumn("_offset", F.lit(None).cast("long"))
    theirs = index.select(F.col(chrom), F.col("position").cast("long").alias("_at"), F.lit(-(2**63)).alias("_salt"), F.col("offset").cast("long").alias("_offset"))
    both = written(mine.unionByName(theirs, allowMissingColumns=True).withColumn("_read", F.col("_offset").isNull()), "asof-rows")
    ranged = both.repartitionByRange(n, chrom, "_at", "_read", "_salt").sortWithinPartitions(chrom, "_at", "_read")
    columns = reads.columns
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in reads.schema.fields], T.StructField("index_position", T.LongType()), T.StructField("_offset", T.LongType()),
        T.StructField("_read", T.BooleanType()), T.StructField("_range", T.IntegerType())])
    merged = written(ranged.mapInArrow(lambda batches: _merge(batches, columns, chrom, to_arrow_schema(schema)), schema), "asof")
    tails = merged.filter(~F.col("_read")).select("_range", F.struct(F.col(chrom).alias("chrom"), F.col("index_position").alias("position"), F.col("_offset").alias("offset")).alias("tail"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = spark.range(n).select(F.col("id").cast("int").alias("_range")).join(tails, "_range", "left").select("_range", F.last("tail", ignorenulls=True).over(earlier).alias("_given"))
    given = F.when(F.col("index_position").isNull() & (F.col("_given.chrom") == F.col(chrom)), F.col("_given"))
    return merged.filter("_read").join(F.broadcast(starts), "_range", "left").withColumn("_given", given).select(
        *columns, F.coalesce("index_position", "_given.position").alias("index_position"), F.coalesce("_offset", "_given.offset", F.lit(0)).alias("offset"))


def _merge(batches: Iterator[pa.RecordBatch], columns: list[str], chrom: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reads of one sorted range with the last index row of their chromosome so far, then one row for the range's last index row."""
    here = TaskContext.get().partitionId()
    last = None  # chromosome, position and offset
    for batch in batches:
        is_read = batch.column("_read").to_numpy(zero_copy_only=False)
        place = np.maximum.accumulate(np.where(is_read, -1, np.arange(len(is_read))))
        known = pa.array(np.maximum(place, 0), mask=place < 0)
        names, at, offset = batch.column(chrom), batch.column("_at"), batch.column("_offset")
        found = [column.take(known) for column in (names, at, offset)]
        if last is not None:
            found = [pc.fill_null(f, value) if value.is_valid else f for f, value in zip(found, last)]
        same = pc.fill_null(pc.equal(found[0], names), False)
        reads = pa.array(is_read)
        out = [*[batch.column(c) for c in columns], *[pc.if_else(same, f, pa.scalar(None, pa.int64())) for f in found[1:]], reads, pa.array(np.full(len(is_read), here, np.int32))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema)], schema=schema).filter(reads)
        if place[-1:].max(initial=-1) >= 0:
            last = [column[int(place[-1])] for column in (names, at, offset)]
    if last is not None:
        tail = {chrom: last[0], "index_position": last[1], "_offset": last[2], "_read": pa.scalar(False), "_range": pa.scalar(here, pa.int32())}
        yield pa.RecordBatch.from_arrays([pa.array([tail[f.name].as_py() if f.name in tail else None], f.type) for f in schema], schema=schema)


def leading_bases(tracts: Column) -> Column:
    """Bases covered by tracts that follow each other from base 1 on, overlaps counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(True).alias("going"))

    def step(a: Column, t: Column) -> Column:
        joins = a["going"] & (t["start"] <= a["reach"] + 1)
        return F.struct(F.when(joins, F.greatest(a["reach"], t["stop"])).otherwise(a["reach"]).cast("long").alias("reach"), joins.alias("going"))

    return F.aggregate(tracts, zero, step, lambda a: a["reach"])


def genome_offset(df: DataFrame, start: str) -> DataFrame:
    """Apply the boundary rule: a read that starts on an index position gives back its leading tract bases."""
    exact = F.col("index_position") == F.col(start)
    back = F.when(exact, leading_bases(F.col("tracts"))).otherwise(F.lit(0))
    return df.withColumn("read_offset", F.when(mappable(df), F.col("offset") - back))


def original_length(condensed_length: Column, tracts: Column) -> Column:
    """Read length before excision: condensed length plus tract bases, each base once."""
    zero = F.struct(condensed_length.cast("long").alias("n"), F.lit(0).cast("long").alias("last"))
    return F.aggregate(
        tracts, zero,
        lambda a, t: F.struct(
            (a["n"] + F.greatest(t["stop"] - F.greatest(a["last"], t["start"] - 1), F.lit(0))).cast("long").alias("n"),
            F.greatest(a["last"], t["stop"]).cast("long").alias("last"),
        ),
        lambda a: a["n"],
    )


def turned_tracts(tracts: Column, read_length: Column, reverse: Column, qual: Column | None = None) -> Column:
    """Carried tracts of a reverse-strand read in forward coordinates: mirrored, unit in the new phase, quality reversed; others as they are.

    With ``qual`` each tract gets its part of the read's quality.
    """
    def quality(t: Column) -> list[Column]:
        return [] if qual is None else [F.substring(qual, t["start"].cast("int"), t["length"].cast("int")).alias("tract_qual")]

    def turn(t: Column) -> Column:
        phase = (t["length"] % F.length(t["unit"])).cast("int")
        return F.struct(
            (read_length - t["stop"] + 1).cast("long").alias("start"), (read_length - t["start"] + 1).cast("long").alias("stop"), t["length"].alias("length"),
            S.reverse_complement(S.rotate_left(t["unit"], phase)).alias("unit"), *[F.reverse(q).alias("tract_qual") for q in quality(t)])

    def same(t: Column) -> Column:
        return F.struct(*[t[c].alias(c) for c in ("start", "stop", "length", "unit")], *quality(t))

    return F.array_sort(F.when(reverse, F.transform(tracts, turn)).otherwise(F.transform(tracts, same)))


def soft_clip(cigar: Column, reverse: Column) -> Column:
    """Clipped bases at the read's own 5' end."""
    lead, trail = F.regexp_extract(cigar, r"^(\d+)S", 1), F.regexp_extract(cigar, r"(\d+)S$", 1)
    text = F.when(reverse, trail).otherwise(lead)
    return F.coalesce(F.nullif(text, F.lit("")).cast("int"), F.lit(0))


def genome_start(df: DataFrame, start: Column | None = None) -> Column:
    """Genome coordinate of a tract: 0-based position + tract start + offset - soft clip."""
    return F.col("pos") + (F.col("start") if start is None else start) + F.col("read_offset") - soft_clip(F.col("cigar"), F.col("reverse"))


def original_position(df: DataFrame) -> Column:
    return F.col("pos") + F.col("read_offset") - soft_clip(F.col("cigar"), F.col("reverse")) + 1


def tags(df: DataFrame, chrom: Column) -> DataFrame:
    """Reads that carry placed tracts, with coordinate (``mc``) and quality (``mu``) tag text."""
    mc = F.transform("tracts", lambda t: F.concat_ws(":", chrom, t["unit"], genome_start(df, t["start"]).cast("string"), t["length"].cast("string")))
    mu = F.transform("tracts", lambda t: F.concat_ws(":", t["unit"], t["start"].cast("string"), t["tract_qual"]))
    return df.withColumn("mc", F.array_join(mc, "|")).withColumn("mu", F.array_join(mu, "|"))


def parse_tags(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tags back to one row per tract: both lists in step. A ``|`` is a legal quality, so the quality tag is cut only before a unit and a place."""
    zipped = F.arrays_zip(F.split("mc", r"\|").alias("c"), F.split("mu", r"\|(?=[A-Za-z]+:\d+:)").alias("q"))
    one = df.select(*keys, F.posexplode(zipped)).withColumn("c", F.split("col.c", ":")).withColumn("q", F.split("col.q", ":", 3))
    return one.select(
        *keys, F.col("pos").alias("tract_no"), F.col("c")[0].alias("chrom"), F.col("c")[1].alias("motif"),
        F.col("c")[2].cast("long").alias("genome_start"), F.col("c")[3].cast("long").alias("length"),
        F.col("q")[1].cast("long").alias("read_start"), F.col("q")[2].alias("tract_qual"),
    )


def tracts_from_name(name: Column) -> Column:
    """Bare name and tract structs out of ``name|unit:start:length[:qual]|...``."""
    parts = F.split(name, r"\|(?=[A-Za-z]+:\d+:\d+)")
    cells = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, ":", 4))
    return F.struct(
        parts[0].alias("bare_name"),
        F.transform(cells, lambda c: F.struct(
            c[0].alias("unit"), c[1].cast("long").alias("start"), c[2].cast("long").alias("length"), F.get(c, F.lit(3)).alias("qual")
        )).alias("tracts"),
    )


def consistent(tracts: Column) -> Column:
    """All tracts carry a quality string of their own length, or none does."""
    sized = F.forall(tracts, lambda t: F.length(t["qual"]) == t["length"])
    none = F.forall(tracts, lambda t: t["qual"].isNull())
    return F.coalesce(sized, F.lit(False)) | none


def restore(condensed: Column, tracts: Column) -> Column:
    """Full read sequence: tracts written back into the condensed sequence at their own places."""
    zero = F.struct(F.lit("").alias("done"), F.lit(1).alias("used"), F.lit(0).cast("long").alias("last"))

    def step(a: Column, t: Column) -> Column:
        gap = F.greatest(t["start"] - a["last"] - 1, F.lit(0)).cast("int")
        again = F.greatest(a["last"] - t["start"] + 1, F.lit(0)).cast("int")
        whole = S.tract_sequence(t["unit"], t["length"])
        return F.struct(
            F.concat(a["done"], F.substring(condensed, a["used"], gap), F.substring(whole, again + 1, F.length(whole))).alias("done"),
            (a["used"] + gap).alias("used"), F.greatest(a["last"], t["stop"]).cast("long").alias("last"),
        )

    return F.aggregate(tracts, zero, step, lambda a: F.concat(a["done"], F.substring(condensed, a["used"], F.length(condensed))))
