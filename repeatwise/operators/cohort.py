"""Cohort preparation: exclusions, families and subgroups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbering import number_rows
from .population import relation_code

ROLES = ["mother", "father", "proband", "sibling"]


def drop_chromosomes(loci: DataFrame, names: list[str]) -> DataFrame:
    return loci.filter(~F.col("chrom").isin(names))


def locus_numbers(loci: DataFrame) -> DataFrame:
    """Dense locus numbers (from 1) in genome order, and a stable hash id that survives added loci."""
    from .profile import chrom_number

    ordered = loci.withColumn("chrom_no", chrom_number(F.col("chrom")))
    return number_rows(ordered, ["chrom_no", "start", "motif"], "row0").select(
        *loci.columns, (F.col("row0") + 1).alias("locus_row"), F.xxhash64("chrom", "start", "motif").alias("locus_hash")
    )


def add_sex(person: DataFrame, report: DataFrame) -> DataFrame:
    """Sex from the sample report by sample id (first match in report order)."""
    first = report.groupBy("sample_id").agg(F.min_by("sex", "report_row").alias("sex"))
    return person.join(first, person["person_id"] == first["sample_id"], "left").drop("sample_id")


def other_sample_families(person: DataFrame, wanted: str = "whole blood") -> DataFrame:
    """Families with at least one sample of another type."""
    return person.filter(~F.col("sample_type").contains(wanted)).select("family_id").distinct()


def exclude_families(df: DataFrame, families: DataFrame) -> DataFrame:
    return df.join(families, "family_id", "left_anti")


def exclude_people(df: DataFrame, people: DataFrame) -> DataFrame:
    return df.join(people, "person_id", "left_anti")


def locus_counts(allele_cov: DataFrame) -> DataFrame:
    """People with coverage and total coverage per locus."""
    per_person = allele_cov.groupBy("locus_id", "person_id").agg(F.sum("n").alias("n"))
    return per_person.groupBy("locus_id").agg(F.count_if(F.col("n") > 0).alias("pop_count"), F.sum("n").alias("sum_count"))


def excluded_union(*reasons: DataFrame) -> DataFrame:
    """Union of exclusion reasons with the reasons listed."""
    both = reasons[0]
    for other in reasons[1:]:
        both = both.unionByName(other)
    return both.groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def with_role(person: DataFrame) -> DataFrame:
    code = relation_code(F.col("relation"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES], F.lit("other")), code)
    return person.withColumn("rel_code", code).withColumn("role", role)


def families(person: DataFrame) -> DataFrame:
    """One row per family with the person in each of the four roles."""
    return with_role(person).groupBy("family_id").agg(
        *[F.min(F.when(F.col("role") == r, F.col("person_id"))).alias(r) for r in ROLES]
    )


SUBGROUPS = {"all": [1, 2, 3, 4, 5], "parents": [1, 2], "children": [3, 4], "mother": [1], "father": [2], "proband": [3], "sibling": [4]}


def subgroup(person: DataFrame, name: str) -> DataFrame:
    return with_role(person).filter(F.col("rel_code").isin(SUBGROUPS[name]))


def family_members(person: DataFrame) -> DataFrame:
    """For every person the members of the person's family, by role order."""
    other = with_role(person).select("family_id", F.col("person_id").alias("member_id"), F.col("rel_code").alias("member_code"))
    return person.select("person_id", "family_id").join(other, "family_id")


def locus_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Loci first..last; on a table partitioned by locus bucket this prunes files."""
    return df.filter(F.col("locus_id").between(first, last))


def autosomal(loci: DataFrame) -> DataFrame:
    return loci.filter(F.col("chrom").rlike("[0-9]$"))


def family_genotypes(genotypes: DataFrame, person: DataFrame, wanted: DataFrame) -> DataFrame:
    """Genotypes of the wanted families over all loci."""
    members = person.join(wanted, "family_id", "left_semi").select("person_id", "family_id")
    return genotypes.join(members, "person_id")
