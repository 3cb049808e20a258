"""Queries on cohort preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import coverage as CV
from ..registry import oracle, query
from .coverage import RANK_ONE, TOTALS
from .coverage import fitted as coverage_fit
from .genotypes import start_genotypes
from .sql import start_calls

ROLED = """roled AS (SELECT *, CASE relation WHEN 'mother' THEN 'mother' WHEN 'father' THEN 'father' WHEN 'self' THEN 'proband' ELSE 'sibling' END AS role FROM person)"""
EXCLUDED = """low AS (SELECT person_id FROM (SELECT person_id, SUM(n) AS total FROM allele_cov GROUP BY person_id) WHERE total < (SELECT AVG(t) - 2 * stddev_samp(t) FROM (SELECT SUM(n) AS t FROM allele_cov GROUP BY person_id)))"""


@query("co01_drop_chromosomes", oracle("locus", "SELECT locus_id, chrom, start FROM locus WHERE chrom NOT IN ('chr21', 'chr22', 'chrX', 'chrY')"))
def _(v):
    return C.drop_chromosomes(v.locus, ["chr21", "chr22", "chrX", "chrY"]).select("locus_id", "chrom", "start")


@query("co02_locus_numbers", oracle("locus", "SELECT locus_id, CAST(row_number() OVER (ORDER BY CAST(replace(chrom, 'chr', '') AS INT), start, unit) AS INT) AS locus_row FROM locus"))
def _(v):
    return C.locus_numbers(v.locus.withColumnRenamed("unit", "motif")).select("locus_id", "locus_row")


@query("co03_add_sex", oracle("person", """SELECT p.person_id, r.sex FROM person p LEFT JOIN (SELECT user_id AS sample_id, arg_min(CASE WHEN value > 50 THEN 'M' ELSE 'F' END, event_id) AS sex FROM events GROUP BY user_id) r
  ON p.person_id = r.sample_id"""))
def _(v):
    report = v.events.select(F.col("user_id").alias("sample_id"), F.when(F.col("value") > 50, "M").otherwise("F").alias("sex"), F.col("event_id").alias("report_row"))
    return C.add_sex(v.person.drop("sex"), report).select("person_id", "sex")


@query("co04_other_sample_families", oracle("person", "SELECT DISTINCT family_id FROM person WHERE NOT contains(sample_type, 'whole blood')"))
def _(v):
    return C.other_sample_families(v.person)


@query("co05_exclude_families", oracle("person bad_family", "SELECT person_id, family_id, relation FROM person WHERE family_id NOT IN (SELECT family_id FROM bad_family)"))
def _(v):
    return C.exclude_families(v.person, v.bad_family).select("person_id", "family_id", "relation")


@query("co06_locus_counts_after_exclusion", oracle("person bad_family allele_cov", """SELECT locus_id, CAST(COUNT(DISTINCT person_id) AS BIGINT) AS pop_count, CAST(SUM(n) AS BIGINT) AS sum_count FROM allele_cov
  WHERE person_id NOT IN (SELECT person_id FROM person JOIN bad_family USING (family_id)) GROUP BY locus_id"""))
def _(v):
    flagged = v.person.join(v.bad_family, "family_id", "left_semi").select("person_id")
    return C.locus_counts(C.exclude_people(v.allele_cov, flagged))


@query("co07_drop_people", oracle("person bad_family allele_cov", """SELECT locus_id, person_id, allele_len, CAST(n AS BIGINT) AS n FROM allele_cov WHERE person_id NOT IN (SELECT person_id FROM person JOIN bad_family USING (family_id))"""))
def _(v):
    flagged = v.person.join(v.bad_family, "family_id", "left_semi").select("person_id")
    return C.exclude_people(v.allele_cov, flagged)


@query("co08_exclusion_union", oracle("person bad_family allele_cov", """SELECT person_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT person_id, 'low coverage' AS reason FROM low
  UNION SELECT person_id, 'sample type' FROM person WHERE NOT contains(sample_type, 'whole blood') UNION SELECT person_id, 'bad family' FROM person JOIN bad_family USING (family_id)) GROUP BY person_id""", [EXCLUDED]))
def _(v):
    low = CV.low_coverage_people(CV.person_totals(v.allele_cov)).select("person_id", F.lit("low coverage").alias("reason"))
    kind = v.person.filter(~F.col("sample_type").contains("whole blood")).select("person_id", F.lit("sample type").alias("reason"))
    bad = v.person.join(v.bad_family, "family_id", "left_semi").select("person_id", F.lit("bad family").alias("reason"))
    return C.excluded_union(low, kind, bad)


@query("co09_families", oracle("person", """SELECT family_id, MAX(CASE WHEN role = 'mother' THEN person_id END) AS mother, MAX(CASE WHEN role = 'father' THEN person_id END) AS father,
  MAX(CASE WHEN role = 'proband' THEN person_id END) AS proband, MAX(CASE WHEN role = 'sibling' THEN person_id END) AS sibling FROM roled GROUP BY family_id""", [ROLED]))
def _(v):
    return C.families(v.person)


@query("co10_subgroups", oracle("person", """SELECT 'parents' AS grp, person_id FROM roled WHERE role IN ('mother', 'father') UNION ALL SELECT 'children', person_id FROM roled WHERE role IN ('proband', 'sibling')
  UNION ALL SELECT role, person_id FROM roled UNION ALL SELECT 'all', person_id FROM roled""", [ROLED]))
def _(v):
    parts = [C.subgroup(v.person, g).select(F.lit(g).alias("grp"), "person_id") for g in C.SUBGROUPS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("co11_family_members", oracle("person", "SELECT a.person_id, a.family_id, b.person_id AS member_id FROM person a JOIN person b USING (family_id)"))
def _(v):
    return C.family_members(v.person).drop("member_code")


@query("co12_locus_range", oracle("allele_cov", "SELECT locus_id, CAST(SUM(n) AS BIGINT) AS n FROM allele_cov WHERE locus_id BETWEEN 10 AND 29 GROUP BY locus_id"))
def _(v):
    return C.locus_range(v.allele_cov, 10, 29).groupBy("locus_id").agg(F.sum("n").alias("n"))


@query("co13_autosomal_loci", oracle("locus", "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM locus WHERE regexp_matches(chrom, '[0-9]$')"))
def _(v):
    return C.autosomal(v.locus).agg(F.count(F.lit(1)).alias("n"))


@query("co14_role_sex", oracle("person", "SELECT role, sex, CAST(COUNT(*) AS BIGINT) AS n FROM roled GROUP BY role, sex", [ROLED]))
def _(v):
    return C.with_role(v.person).groupBy("role", "sex").agg(F.count(F.lit(1)).alias("n"))


@query("co15_family_genotypes", oracle("person bad_family allele_cov", """SELECT locus_id, person_id, family_id, CAST(SUM(n) AS BIGINT) AS n FROM allele_cov JOIN person USING (person_id) WHERE family_id IN (SELECT family_id FROM bad_family) GROUP BY ALL"""))
def _(v):
    return C.family_genotypes(v.allele_cov, v.person, v.bad_family).groupBy("locus_id", "person_id", "family_id").agg(F.sum("n").alias("n"))


@query("co15_genotypes_of_families", oracle("allele_cov expected person bad_family", """SELECT locus_id, person_id, family_id, allele_1, allele_2, round(confidence, 6) AS confidence FROM geno JOIN person USING (person_id)
  WHERE family_id IN (SELECT family_id FROM bad_family)""", start_calls()))
def _(v):
    calls = C.family_genotypes(start_genotypes(v), v.person, v.bad_family)
    return calls.select("locus_id", "person_id", "family_id", "allele_1", "allele_2", F.round("confidence", 6).alias("confidence"))


@query("co08_all_exclusions", oracle("person allele_cov", """SELECT person_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (
  SELECT person_id, 'low coverage' AS reason FROM totals WHERE total < (SELECT AVG(total) - 2 * stddev_samp(total) FROM totals)
  UNION SELECT person_id, 'poor fit' FROM (SELECT person_id, corr(cov, exp_cov) AS c FROM fitted GROUP BY person_id) WHERE c < 0.8
  UNION SELECT person_id, 'sample type' FROM person WHERE NOT contains(sample_type, 'whole blood')) GROUP BY person_id""", [TOTALS] + RANK_ONE))
def _(v):
    low = CV.low_coverage_people(CV.person_totals(v.allele_cov)).select("person_id", F.lit("low coverage").alias("reason"))
    poor = CV.poor_fit_people(CV.person_fit(*coverage_fit(v))).select("person_id", F.lit("poor fit").alias("reason"))
    kind = v.person.filter(~F.col("sample_type").contains("whole blood")).select("person_id", F.lit("sample type").alias("reason"))
    return C.excluded_union(low, poor, kind)
