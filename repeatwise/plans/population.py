"""Queries on the population merge and the count matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import population as PO
from ..operators import profile as P
from ..registry import oracle, query
from ..session import scratch_path
from ..sources.text import read_person_files, write_person_files
from .profiles import PROFILE, located, profiles

LOCUS = "chrom, start, motif"
VIEWS = "obs ref_tract"
PER = f"per AS (SELECT {LOCUS}, person_id, SUM(n) AS n, MAX(ref_length) AS ref_length, MAX(length) AS longest FROM prof GROUP BY {LOCUS}, person_id)"
INDEX = f"pop AS (SELECT {LOCUS}, COUNT(*) AS pop_count, MAX(n) AS max_count, SUM(n) AS sum_count, MAX(ref_length) AS ref_length, MAX(longest) AS longest FROM per GROUP BY {LOCUS})"
BASE = PROFILE + [PER, INDEX]
CAST = "CAST(pop_count AS BIGINT) AS pop_count, CAST(max_count AS BIGINT) AS max_count, CAST(sum_count AS BIGINT) AS sum_count"


@query("po01_merged_profiles", oracle(VIEWS, f"SELECT {LOCUS}, length, CAST(SUM(n) AS BIGINT) AS n, CAST(COUNT(*) AS BIGINT) AS people FROM prof GROUP BY {LOCUS}, length", BASE))
def _(v):
    return profiles(v).groupBy(*PO.LOCUS, "length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("people"))


@query("po02_locus_index", oracle(VIEWS, f"SELECT {LOCUS}, {CAST}, ref_length, longest FROM pop", BASE))
def _(v):
    return PO.locus_index(profiles(v))


@query("po03_motifs_per_position", oracle(VIEWS, "SELECT chrom, start, CAST(COUNT(*) AS BIGINT) AS motifs, string_agg(motif, ',' ORDER BY motif) AS list FROM pop GROUP BY chrom, start", BASE))
def _(v):
    return PO.locus_index(profiles(v)).groupBy("chrom", "start").agg(
        F.count(F.lit(1)).alias("motifs"), F.array_join(F.sort_array(F.collect_set("motif")), ",").alias("list"))


@query("po04_reference_only", oracle(VIEWS, "SELECT CAST(COUNT(*) FILTER (ref_length > 0) AS BIGINT) AS added, CAST(COUNT(*) FILTER (ref_length = 0) AS BIGINT) AS skipped FROM pop", BASE))
def _(v):
    return PO.reference_tally(PO.locus_index(profiles(v)))


@query("io36_skipped_sites", oracle(VIEWS, f"SELECT {LOCUS} FROM pop WHERE ref_length = 0", BASE))
def _(v):
    return PO.locus_index(profiles(v)).filter("ref_length = 0").select(*PO.LOCUS)


CELLS = f"""cell AS (SELECT {LOCUS}, person_id, SUM(n) || ';' || string_agg(CAST(length AS VARCHAR), ',' ORDER BY length) || ';' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY length) AS cell
  FROM prof GROUP BY {LOCUS}, person_id)"""
COLUMNS = """cols AS (SELECT *, CASE relation WHEN 'mother' THEN 1 WHEN 'father' THEN 2 WHEN 'self' THEN 3 ELSE 4 END AS rel_code,
  CAST(row_number() OVER (ORDER BY family_id, CASE relation WHEN 'mother' THEN 1 WHEN 'father' THEN 2 WHEN 'self' THEN 3 ELSE 4 END, person_id) - 1 AS INT) AS col_no FROM person)"""


@query("po05_sparse_cells", oracle(VIEWS, f"SELECT {LOCUS}, person_id, cell FROM cell", BASE + [CELLS]))
def _(v):
    return PO.cells(profiles(v))


@query("po06_matrix_rows", oracle(VIEWS + " person", f"""SELECT {LOCUS}, string_agg(COALESCE(cell, '0;;'), chr(9) ORDER BY col_no) AS cells FROM (SELECT DISTINCT {LOCUS} FROM cell) l CROSS JOIN cols
  LEFT JOIN cell USING ({LOCUS}, person_id) GROUP BY {LOCUS}""", BASE + [CELLS, COLUMNS]))
def _(v):
    people = PO.person_columns(v.person)
    return PO.matrix_rows(PO.cells(profiles(v)), people.select("person_id", "col_no"), people.count())


@query("po07_person_columns", oracle("person", "SELECT person_id, family_id, rel_code, col_no FROM cols", [COLUMNS]))
def _(v):
    return PO.person_columns(v.person).select("person_id", "family_id", "rel_code", "col_no")


@query("po08_people_without_profile", oracle(VIEWS + " person", "SELECT person_id, family_id, relation FROM person WHERE person_id NOT IN (SELECT person_id FROM prof WHERE length > 14)", BASE))
def _(v):
    # people who have no profile file: files hold the long alleles only here, so that some people are missing
    path = scratch_path(v.spark, "profiles")
    write_person_files(profiles(v).filter("length > 14"), path)
    found = read_person_files(v.spark, path, "chrom STRING, start INT, motif STRING, length INT, n BIGINT, ref_length INT", ["person_id"])
    return PO.missing_people(v.person, found).select("person_id", "family_id", "relation")


@query("po08_missing_people", oracle("person", "SELECT person_id, family_id, relation FROM person WHERE person_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_tax = 0.08 AND l_discount > 0.09)"))
def _(v):
    seen = v.lineitem.filter("l_tax = 0.08 AND l_discount > 0.09").select(F.col("l_suppkey").alias("person_id"))
    return PO.missing_people(v.person, seen).select("person_id", "family_id", "relation")


@query("po09_well_covered", oracle(VIEWS + " person", f"SELECT {LOCUS}, {CAST}, ref_length, longest FROM pop WHERE max_count >= 4 AND pop_count >= 0.3 * (SELECT COUNT(*) FROM person) AND sum_count / pop_count >= 1.5", BASE))
def _(v):
    return PO.well_covered(PO.locus_index(profiles(v)), v.person.count(), top=4, share=0.3, mean=1.5)


@query("po10_cells_to_rows", oracle(VIEWS, f"SELECT {LOCUS}, person_id, length, CAST(n AS BIGINT) AS n FROM prof", BASE))
def _(v):
    return PO.parse_cells(PO.cells(profiles(v)), [*PO.LOCUS, "person_id"], "cell")


@query("po11_locus_totals", oracle(VIEWS, f"SELECT {LOCUS}, person_id, CAST(n AS BIGINT) AS n FROM per", BASE))
def _(v):
    return profiles(v).groupBy(*PO.LOCUS, "person_id").agg(F.sum("n").alias("n"))


ALLELES = f"""al AS (SELECT {LOCUS}, length, COUNT(*) AS pop_count, MAX(n) AS max_count, SUM(n) AS sum_count FROM prof GROUP BY {LOCUS}, length
  UNION ALL SELECT {LOCUS}, 0, pop_count, max_count, sum_count FROM pop), nl AS (SELECT {LOCUS}, COUNT(*) - 1 AS num_lengths FROM al GROUP BY {LOCUS})"""


@query("po12_allele_index", oracle(VIEWS, f"SELECT {LOCUS}, length, {CAST}, CAST(num_lengths AS BIGINT) AS num_lengths FROM al JOIN nl USING ({LOCUS})", BASE + [ALLELES]))
def _(v):
    return PO.allele_index(profiles(v))


@query("po13_dense_allele_rows", oracle("allele_cov person", """SELECT locus_id, allele_len, string_agg(CAST(COALESCE(n, 0) AS VARCHAR), ',' ORDER BY col_no) AS counts FROM (SELECT DISTINCT locus_id, allele_len FROM allele_cov) a
  CROSS JOIN cols LEFT JOIN allele_cov USING (locus_id, allele_len, person_id) GROUP BY locus_id, allele_len""", [COLUMNS]))
def _(v):
    people = PO.person_columns(v.person)
    return PO.dense_rows(v.allele_cov, ["locus_id", "allele_len"], people.select("person_id", "col_no"), people.count())


@query("po14_flank_histogram", oracle(VIEWS, f"SELECT {LOCUS}, flank, person_id, length, CAST(COUNT(*) AS BIGINT) AS n FROM kept WHERE NOT contains(flank, '#') GROUP BY ALL", BASE))
def _(v):
    return PO.flank_histogram(P.dedup_reads(located(v)), complete_only=True)


@query("po15_all_histogram", oracle(VIEWS, f"SELECT {LOCUS}, person_id, length, CAST(COUNT(*) AS BIGINT) AS n FROM kept GROUP BY {LOCUS}, person_id, length", BASE))
def _(v):
    return PO.flank_histogram(P.dedup_reads(located(v)).withColumn("flank", F.lit("all"))).drop("flank")


@query("po16_main_modes", oracle("allele_cov", """SELECT locus_id, person_id, MAX(CASE WHEN rk = 1 THEN allele_len END) AS mode1, MAX(CASE WHEN rk = 2 THEN allele_len END) AS mode2,
  CAST(MAX(CASE WHEN rk = 1 THEN n END) AS BIGINT) AS count1, CAST(MAX(CASE WHEN rk = 2 THEN n END) AS BIGINT) AS count2
  FROM (SELECT *, row_number() OVER (PARTITION BY locus_id, person_id ORDER BY n DESC, allele_len) AS rk FROM allele_cov) GROUP BY locus_id, person_id"""))
def _(v):
    return PO.main_modes(v.allele_cov, ["locus_id", "person_id"], "allele_len")


@query("po17_modes_by_share", oracle("allele_cov", """SELECT locus_id, allele_len, CAST(COUNT(*) AS BIGINT) AS people FROM (SELECT *, n / SUM(n) OVER (PARTITION BY locus_id, person_id) AS s FROM allele_cov)
  WHERE s >= 0.3 AND n >= 2 GROUP BY locus_id, allele_len"""))
def _(v):
    return PO.modes_by_share(v.allele_cov, ["locus_id"], 0.3, 2, "allele_len")


@query("po18_flank_listing", oracle(VIEWS, f"SELECT {LOCUS}, person_id, flank, CAST(COUNT(*) AS BIGINT) AS flank_count FROM kept GROUP BY {LOCUS}, person_id, flank HAVING COUNT(*) >= 2", BASE))
def _(v):
    return PO.flank_listing(P.dedup_reads(located(v)), 2)
