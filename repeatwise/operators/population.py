"""Merging profiles of all people into locus and allele tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbering import number_rows

LOCUS = ["chrom", "start", "motif"]
MIN_TOP = 10
MIN_SHARE = 0.5


def locus_index(profiles: DataFrame) -> DataFrame:
    """People, top and total coverage, reference length and longest length seen per locus, over the union of all profiles."""
    per_person = profiles.groupBy(*LOCUS, "person_id").agg(F.sum("n").alias("n"), F.max("ref_length").alias("ref_length"), F.max("length").alias("longest"))
    return per_person.groupBy(*LOCUS).agg(
        F.count(F.lit(1)).alias("pop_count"), F.max("n").alias("max_count"), F.sum("n").alias("sum_count"), F.max("ref_length").alias("ref_length"), F.max("longest").alias("longest")
    )


def reference_tally(index: DataFrame) -> DataFrame:
    return index.agg(F.count_if(F.col("ref_length") > 0).alias("added"), F.count_if(F.col("ref_length") == 0).alias("skipped"))


def cells(profiles: DataFrame) -> DataFrame:
    """Sparse cell per (locus, person) as a map, and its text ``n;lengths;counts``."""
    packed = profiles.groupBy(*LOCUS, "person_id").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("length"), F.col("n")))).alias("c")
    )
    text = F.concat_ws(
        ";", F.col("n").cast("string"), F.array_join(F.transform("c", lambda x: x["length"].cast("string")), ","),
        F.array_join(F.transform("c", lambda x: x["n"].cast("string")), ","),
    )
    return packed.select(*LOCUS, "person_id", text.alias("cell"))


ABSENT = "0;;"


TILE = 256  # people whose cells of a locus are put together at a time


def tiled_rows(cells: DataFrame, keys: list[str], people: DataFrame, n_people: int, value: str, absent: str, sep: str) -> DataFrame:
    """One text per key with a cell per person in column order: ``keys, row``; absent people get ``absent``.

    Tiles of a key and ``TILE`` columns sort what they hold and fill the gaps before, between and after; the tiles of a key are stitched
    in the same way. The work is linear in people. Only this export is as wide as the cohort.
    """
    def filled(items: Column, first: Column, n: Column, place, text, hole) -> Column:
        """Texts of sorted items with the holes between them, for the places ``first`` to ``first + n - 1``."""
        def one(item: Column, i: Column) -> Column:
            before = F.when(i > 0, place(F.get(items, i - 1)) + 1).otherwise(first)
            return F.concat(F.repeat(F.lit(hole + sep), (place(item) - before).cast("int")), text(item))

        rest = first + n - 1 - place(F.get(items, F.size(items) - 1))
        return F.concat(F.array_join(F.transform(items, one), sep), F.repeat(F.lit(sep + hole), rest.cast("int")))

    last = (n_people - 1) // TILE
    placed = cells.join(people, "person_id").withColumn("tile", F.floor(F.col("col_no") / TILE).cast("int"))
    packed = placed.groupBy(*keys, "tile").agg(F.array_sort(F.collect_list(F.struct(F.col("col_no").cast("int").alias("c"), F.col(value).cast("string").alias("t")))).alias("items"))
    width = F.when(F.col("tile") == last, n_people - last * TILE).otherwise(TILE)
    texts = packed.select(*keys, "tile", filled(F.col("items"), F.col("tile") * TILE, width, lambda x: x["c"], lambda x: x["t"], absent).alias("t"))
    # the last tile may be narrower, so it is added where a key has none
    hole, end = sep.join([absent] * TILE), sep.join([absent] * (n_people - last * TILE))
    whole = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tile", "t"))).alias("tiles"))
    closed = F.when(F.get("tiles", F.size("tiles") - 1)["tile"] == last, F.col("tiles")).otherwise(F.array_append("tiles", F.struct(F.lit(last).alias("tile"), F.lit(end).alias("t"))))
    return whole.withColumn("tiles", closed).select(*keys, filled(F.col("tiles"), F.lit(0), F.lit(last + 1), lambda x: x["tile"], lambda x: x["t"], hole).alias("row"))


def matrix_rows(cell_table: DataFrame, people: DataFrame, n_people: int) -> DataFrame:
    """Locus rows with one cell per person in column order, absent people as ``0;;``; ``people`` holds (person_id, col_no 0..n-1)."""
    return tiled_rows(cell_table, LOCUS, people, n_people, "cell", ABSENT, "\t").withColumnRenamed("row", "cells")


def relation_code(relation: Column) -> Column:
    return (
        F.when(relation == "mother", 1).when(relation == "father", 2).when(relation.isin("proband", "self"), 3)
        .when(relation.isin("sibling", "s2"), 4).otherwise(5)
    )


def person_columns(person: DataFrame) -> DataFrame:
    """Dense column number (from 0) by family, then mother, father, proband, sibling, other."""
    coded = person.withColumn("rel_code", relation_code(F.col("relation")))
    return number_rows(coded, ["family_id", "rel_code", "person_id"], "col_no")


def missing_people(person: DataFrame, profiles: DataFrame) -> DataFrame:
    return person.join(profiles.select("person_id").distinct(), "person_id", "left_anti")


def well_covered(index: DataFrame, n_people: int, top: int = MIN_TOP, share: float = MIN_SHARE, mean: float = 0.0) -> DataFrame:
    """Loci whose best person has ``top`` reads, seen in ``share`` of people, with mean coverage of at least ``mean``."""
    return index.filter(
        (F.col("max_count") >= top) & (F.col("pop_count") >= n_people * share) & (F.col("sum_count") / F.col("pop_count") >= mean)
    )


def parse_cells(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Cell text to one row per observed length."""
    parts = F.split(cell, ";")
    zipped = F.arrays_zip(F.split(parts[1], ",").alias("l"), F.split(parts[2], ",").alias("c"))
    return rows.filter(F.col(cell) != ABSENT).select(*keys, F.explode(zipped).alias("z")).select(
        *keys, F.col("z.l").cast("int").alias("length"), F.col("z.c").cast("long").alias("n")
    )


def allele_index(profiles: DataFrame) -> DataFrame:
    """Per-allele people, top and total, with the number of alleles of the locus; ``length`` 0 is the locus total."""
    alleles = profiles.groupBy(*LOCUS, "length").agg(
        F.count(F.lit(1)).alias("pop_count"), F.max("n").alias("max_count"), F.sum("n").alias("sum_count")
    )
    counted = alleles.groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("num_lengths"))
    totals = profiles.groupBy(*LOCUS, "person_id").agg(F.sum("n").alias("n")).groupBy(*LOCUS).agg(
        F.lit(0).alias("length"), F.count(F.lit(1)).alias("pop_count"), F.max("n").alias("max_count"), F.sum("n").alias("sum_count")
    )
    return alleles.unionByName(totals).join(counted, LOCUS)


def dense_rows(counts: DataFrame, keys: list[str], people: DataFrame, n_people: int) -> DataFrame:
    """Allele rows as zero-filled comma lists over people in column order."""
    return tiled_rows(counts, keys, people, n_people, "n", "0", ",").withColumnRenamed("row", "counts")


def flank_histogram(reads: DataFrame, complete_only: bool = False) -> DataFrame:
    """Reads per (locus, flank, person, length); ``complete_only`` leaves out flanks cut by the read end."""
    kept = reads.filter(~F.col("flank").contains("#")) if complete_only else reads
    return kept.groupBy(*LOCUS, "flank", "person_id", "length").agg(F.count(F.lit(1)).alias("n"))


def flank_listing(reads: DataFrame, floor: int) -> DataFrame:
    return reads.groupBy(*LOCUS, "person_id", "flank").agg(F.count(F.lit(1)).alias("flank_count")).filter(F.col("flank_count") >= floor)


def main_modes(counts: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """Two most frequent lengths per person and their counts (equal counts: shorter first)."""
    top = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(length))
    ranked = counts.withColumn("rk", F.row_number().over(top)).filter(F.col("rk") <= 2)
    pick = lambda rk, c: F.max(F.when(F.col("rk") == rk, F.col(c)))
    return ranked.groupBy(*keys).agg(
        pick(1, length).alias("mode1"), pick(2, length).alias("mode2"), pick(1, "n").alias("count1"), pick(2, "n").alias("count2")
    )


def modes_by_share(counts: DataFrame, locus: list[str], cutoff: float, min_reads: int = 0, length: str = "length") -> DataFrame:
    """People per length among lengths that hold ``cutoff`` of a person's reads."""
    total = F.sum("n").over(Window.partitionBy(*locus, "person_id"))
    share = F.col("n") / F.greatest(total, F.lit(1))
    return counts.withColumn("share", share).filter((F.col("share") >= cutoff) & (F.col("n") >= min_reads)).groupBy(*locus, length).agg(
        F.count(F.lit(1)).alias("people")
    )
