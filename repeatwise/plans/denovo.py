"""Queries on de novo and violation analysis. Input: scores and genotypes of the unfitted model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as AN
from ..operators import cohort as C
from ..operators import denovo as DN
from ..operators.cohort import ROLES
from ..registry import oracle, query
from .families import start_scores
from .genotypes import start_genotypes
from .sql import family_ctes, start_calls

VIEWS = "allele_cov expected person"
TRIO, OBEY, KIN = 0.5, 0.01, 0.1
BASE = start_calls() + family_ctes()
A8 = "least(mother_1, mother_2, father_1, father_2, proband_1, proband_2, sibling_1, sibling_2)"
CASES = f"""cases AS MATERIALIZED (SELECT * FROM (SELECT *, (CASE WHEN proband_trio >= {TRIO} AND proband_obedience <= {OBEY} AND proband_kinship >= {KIN} THEN 1 ELSE 0 END
  + CASE WHEN sibling_trio >= {TRIO} AND sibling_obedience <= {OBEY} AND sibling_kinship >= {KIN} THEN 2 ELSE 0 END) AS who FROM fam WHERE {A8} >= 0) WHERE who > 0)"""
MEMBERS = """members AS MATERIALIZED (SELECT c.locus_id, c.family_id, c.who, r.role, r.sex, g.* EXCLUDE (locus_id) FROM cases c JOIN roled r USING (family_id) JOIN geno g ON g.locus_id = c.locus_id AND g.person_id = r.person_id
  WHERE role IN ('mother', 'father') OR (role = 'proband' AND who IN (1, 3)) OR (role = 'sibling' AND who IN (2, 3))),
  metrics AS MATERIALIZED (SELECT locus_id, family_id, who, 1 - product(1 - p_null) AS case_null, product(noise_fit) AS case_noise_fit, product(allele_fit) AS case_allele_fit, product(confidence) AS case_confidence, MAX(eps) AS eps FROM members GROUP BY ALL)"""
CHILD = "CASE who WHEN 1 THEN [proband_1, proband_2] WHEN 2 THEN [sibling_1, sibling_2] ELSE [proband_1, proband_2, sibling_1, sibling_2] END"
CLASSIFIED = f"""classified AS MATERIALIZED (SELECT *, CASE WHEN len(fresh) = 0 THEN 'omission' ELSE 'commission' END AS violation, list_sort(CASE WHEN len(fresh) = 0 THEN one_sided ELSE fresh END) AS dn FROM (
  SELECT *, list_filter(child, lambda x: NOT list_contains([mother_1, mother_2, father_1, father_2], x)) AS fresh,
    list_filter(child, lambda x: (list_contains([mother_1, mother_2], x) AND NOT list_contains([father_1, father_2], x)) OR (list_contains([father_1, father_2], x) AND NOT list_contains([mother_1, mother_2], x))) AS one_sided
  FROM (SELECT *, list_distinct({CHILD}) AS child FROM cases)))"""
FULL = BASE + [CASES, MEMBERS, CLASSIFIED]
KEYS = ["locus_id", "family_id"]


def cases(v):
    return DN.candidates(start_scores(v), TRIO, OBEY, KIN)


def parents(v):
    return C.subgroup(v.person, "parents")


@query("dn01_candidates", oracle(VIEWS, "SELECT locus_id, family_id, round(proband_obedience, 6) AS po, round(sibling_obedience, 6) AS so FROM cases", FULL))
def _(v):
    return cases(v).select(*KEYS, F.round("proband_obedience", 6).alias("po"), F.round("sibling_obedience", 6).alias("so"))


@query("dn02_who", oracle(VIEWS, "SELECT locus_id, family_id, who FROM cases", FULL))
def _(v):
    return cases(v).select(*KEYS, "who")


METRICS = "round(case_null, 6) AS case_null, round(case_noise_fit, 6) AS case_noise_fit, round(case_allele_fit, 6) AS case_allele_fit, round(case_confidence, 6) AS case_confidence"
METRIC_COLS = ["case_null", "case_noise_fit", "case_allele_fit", "case_confidence"]


def metrics(v):
    return DN.trio_metrics(cases(v), start_genotypes(v), v.person)


@query("dn03_case_metrics", oracle(VIEWS, f"SELECT locus_id, family_id, who, {METRICS} FROM metrics", FULL))
def _(v):
    return metrics(v).select(*KEYS, "who", *[F.round(c, 6).alias(c) for c in METRIC_COLS])


@query("dn04_quality_filter", oracle(VIEWS + " bad_family", "SELECT locus_id, family_id, who FROM metrics WHERE eps <= 0.17 AND case_null < 0.9 AND case_noise_fit > 1e-6 AND case_allele_fit > 1e-4 AND family_id NOT IN (SELECT family_id FROM bad_family)", FULL))
def _(v):
    return DN.quality_filter(metrics(v), v.bad_family, 0.17, 0.9, 1e-6, 1e-4).select(*KEYS, "who")


@query("dn05_ranked_cases", oracle(VIEWS, """SELECT locus_id, family_id, score, row_number() OVER (ORDER BY score, locus_id, family_id) - 1 AS place FROM
  (SELECT *, round(CASE who WHEN 1 THEN proband_obedience WHEN 2 THEN sibling_obedience ELSE least(proband_obedience, sibling_obedience) END, 9) AS score FROM cases)""", FULL))
def _(v):
    return DN.ranked(cases(v)).select(*KEYS, "score", "place")


@query("dn06_violation_type", oracle(VIEWS, "SELECT locus_id, family_id, who, violation FROM classified", FULL))
def _(v):
    return DN.classify(cases(v)).select(*KEYS, "who", "violation")


@query("dn07_violating_alleles", oracle(VIEWS, "SELECT locus_id, family_id, array_to_string(dn, ',') AS alleles FROM classified", FULL))
def _(v):
    return DN.classify(cases(v)).select(*KEYS, F.array_join(F.col("dn_alleles").cast("array<string>"), ",").alias("alleles"))


EQUAL = " + ".join(f"CASE WHEN {r}_{i} = g{r}.allele_{i} THEN 1 ELSE 0 END" for r in ROLES for i in (1, 2))
JOINS = " ".join(f"LEFT JOIN (SELECT family_id, locus_id, allele_1, allele_2 FROM geno JOIN roled USING (person_id) WHERE role = '{r}') g{r} USING (locus_id, family_id)" for r in ROLES)


@query("dn08_concordance", oracle(VIEWS, f"SELECT locus_id, family_id, {EQUAL} AS equal_alleles FROM fam {JOINS}", FULL))
def _(v):
    return DN.concordant(start_scores(v), start_genotypes(v), v.person).select(*KEYS, "equal_alleles")


@query("dn09_low_obedience", oracle(VIEWS, f"SELECT locus_id, family_id FROM fam WHERE (proband_obedience <= 0.005 OR sibling_obedience <= 0.005) AND {A8} >= 0", FULL))
def _(v):
    return DN.low_obedience(start_scores(v)).select(*KEYS)


LABELS = """labels_ AS (SELECT *, CASE w WHEN 1 THEN proband_obedience WHEN 2 THEN sibling_obedience ELSE greatest(proband_obedience, sibling_obedience) END AS obedience,
  CASE w WHEN 1 THEN proband_kinship WHEN 2 THEN sibling_kinship ELSE greatest(proband_kinship, sibling_kinship) END AS swap_score FROM
  (SELECT *, CASE WHEN proband_obedience <= 0.005 THEN 1 ELSE 0 END + CASE WHEN sibling_obedience <= 0.005 THEN 2 ELSE 0 END AS w FROM fam) WHERE w > 0)"""


@query("dn10_violator_labels", oracle(VIEWS, "SELECT locus_id, family_id, w AS who, round(obedience, 6) AS obedience, round(swap_score, 6) AS swap_score FROM labels_", FULL + [LABELS]))
def _(v):
    return DN.label_violators(start_scores(v)).select(*KEYS, "who", F.round("obedience", 6).alias("obedience"), F.round("swap_score", 6).alias("swap_score"))


FIELDS = ["allele_1", "allele_2", "allele_1_cov", "allele_2_cov", "rest_cov"]
FLOATS = ["confidence", "allele_fit", "noise_fit", "p_null", "exp_allele_cov"]
WIDE = ", ".join([f"MAX(CASE WHEN role = '{r}' THEN {f} END) AS {r}_{f}" for r in ROLES for f in FIELDS] + [f"round(MAX(CASE WHEN role = '{r}' THEN {f} END), 5) AS {r}_{f}" for r in ROLES for f in FLOATS])


@query("dn11_wide_records", oracle(VIEWS + " locus", f"SELECT locus_id, family_id, chrom, start, unit, ref_length, {WIDE} FROM cases JOIN roled USING (family_id) JOIN geno USING (locus_id, person_id) JOIN locus USING (locus_id) GROUP BY ALL", FULL))
def _(v):
    wide = DN.member_records(start_genotypes(v), v.person, FIELDS + FLOATS)
    full = cases(v).select(*KEYS).join(wide, KEYS).join(v.locus, "locus_id")
    return full.select(*[F.round(c, 5).alias(c) if any(c.endswith("_" + f) for f in FLOATS) else F.col(c) for c in full.columns])


@query("dn12_locus_diversity", oracle(VIEWS, """SELECT locus_id, CAST(COUNT(DISTINCT a) FILTER (a > 0) AS BIGINT) AS diversity, CAST(ANY_VALUE(np) AS BIGINT) AS non_null_parents FROM (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM geno)
  JOIN (SELECT locus_id, COUNT(*) FILTER (allele_1 > 0 AND allele_2 > 0 AND role IN ('mother', 'father')) AS np FROM geno JOIN roled USING (person_id) GROUP BY locus_id) USING (locus_id) GROUP BY locus_id""", FULL))
def _(v):
    return DN.locus_diversity(start_genotypes(v), parents(v))


COPIES = """pg AS (SELECT * FROM geno JOIN roled USING (person_id) WHERE {role} allele_1 > 0 AND allele_2 > 0), pn AS (SELECT locus_id, COUNT(*) AS nn FROM pg GROUP BY locus_id),
  pc AS (SELECT locus_id, a, COUNT(*) AS copies FROM (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM pg) GROUP BY locus_id, a)"""
FREQ = """SELECT locus_id, family_id, who, violation, x.allele, CAST(COALESCE(copies, 0) AS BIGINT) AS copies, round(COALESCE(copies, 0) / (2 * nn), 6) AS frequency
  FROM (SELECT *, unnest(dn) AS allele FROM classified) x LEFT JOIN pn USING (locus_id) LEFT JOIN pc ON pc.locus_id = x.locus_id AND pc.a = x.allele""".replace("SELECT locus_id, family_id, who", "SELECT x.locus_id, family_id, who", 1)


@query("dn13_parental_frequency", oracle(VIEWS, FREQ, FULL + [COPIES.format(role="role IN ('mother', 'father') AND")]))
def _(v):
    return DN.violation_frequency(cases(v), start_genotypes(v), parents(v)).withColumn("frequency", F.round("frequency", 6))


HELD = """held AS (SELECT DISTINCT locus_id, family_id, role, sex, unnest([allele_1, allele_2]) AS allele FROM geno JOIN roled USING (person_id)),
  inh AS (SELECT locus_id, allele, COUNT(*) FILTER (role = 'mother') AS mother_occ, COUNT(*) FILTER (role = 'father') AS father_occ, COUNT(*) FILTER (role = 'proband' AND sex = 'M' AND par) AS proband_m_inherited,
    COUNT(*) FILTER (role = 'proband' AND sex = 'F' AND par) AS proband_f_inherited, COUNT(*) FILTER (role = 'sibling' AND sex = 'M' AND par) AS sibling_m_inherited, COUNT(*) FILTER (role = 'sibling' AND sex = 'F' AND par) AS sibling_f_inherited
    FROM (SELECT h.*, EXISTS (SELECT 1 FROM held p WHERE p.locus_id = h.locus_id AND p.family_id = h.family_id AND p.allele = h.allele AND p.role IN ('mother', 'father')) AS par FROM held h) GROUP BY locus_id, allele)"""


@query("dn14_inheritance", oracle(VIEWS, "SELECT x.locus_id, x.family_id, x.who, x.allele, i.* EXCLUDE (locus_id, allele) FROM (SELECT *, unnest(dn) AS allele FROM classified) x JOIN inh i ON i.locus_id = x.locus_id AND i.allele = x.allele", FULL + [HELD]))
def _(v):
    return DN.violation_inheritance(cases(v), start_genotypes(v), v.person)


@query("dn15_insertion_deletion", oracle(VIEWS + " locus", "SELECT c.locus_id, family_id, CASE WHEN list_max(dn) > ref_length THEN 'I' WHEN list_max(dn) < ref_length THEN 'D' END AS indel FROM classified c JOIN locus USING (locus_id)", FULL))
def _(v):
    return DN.insertion_or_deletion(cases(v), v.locus).select(*KEYS, "indel")


@query("dn16_combined_score", oracle(VIEWS, "SELECT locus_id, family_id, round((1 - case_null) * case_allele_fit * case_noise_fit * case_confidence, 7) AS case_score FROM metrics", FULL))
def _(v):
    return DN.combined_score(metrics(v)).select(*KEYS, F.round("case_score", 7).alias("case_score"))


@query("dn17_phred", oracle(VIEWS, "SELECT locus_id, family_id, round(-10 * log10(obedience), 4) AS phred, round(-10 * log10(CASE WHEN w = 3 THEN least(proband_obedience, sibling_obedience) ELSE obedience END), 4) AS phred_low FROM labels_", FULL + [LABELS]))
def _(v):
    return DN.phred_scores(DN.label_violators(start_scores(v))).select(*KEYS, F.round("phred", 4).alias("phred"), F.round("phred_low", 4).alias("phred_low"))


@query("dn18_population_frequency", oracle(VIEWS, FREQ, FULL + [COPIES.format(role="")]))
def _(v):
    return DN.violation_frequency(cases(v), start_genotypes(v)).withColumn("frequency", F.round("frequency", 6))


@query("dn19_legacy_filter", oracle(VIEWS, f"""SELECT locus_id, family_id, who, round(CASE who WHEN 1 THEN proband_obedience WHEN 2 THEN sibling_obedience ELSE (proband_obedience + sibling_obedience) / 2 END, 6) AS score FROM
  (SELECT *, CASE WHEN proband_obedience <= 0.005 THEN 1 ELSE 0 END + CASE WHEN sibling_obedience <= 0.005 THEN 2 ELSE 0 END AS who FROM fam WHERE {A8} >= 0)
  JOIN (SELECT locus_id, family_id, COUNT(*) FILTER (exp_allele_cov > 5) AS c, MAX(eps) AS e, SUM(CASE WHEN allele_1 = -1 THEN 1 ELSE 0 END + CASE WHEN allele_2 = -1 THEN 1 ELSE 0 END) AS nulls FROM geno JOIN roled USING (person_id) GROUP BY ALL) USING (locus_id, family_id)
  WHERE who > 0 AND c = 4 AND e <= 0.15 AND nulls = 0""", FULL))
def _(v):
    return DN.legacy_filter(start_scores(v), start_genotypes(v), v.person).select(*KEYS, "who", F.round("score", 6).alias("score"))


@query("dn20_child_genotype_frequency", oracle(VIEWS, """SELECT c.locus_id, c.family_id, c.who, CAST(COUNT(*) AS BIGINT) AS geno_all, CAST(COUNT(*) FILTER (role IN ('mother', 'father')) AS BIGINT) AS geno_parents FROM cases c
  JOIN (SELECT * FROM geno JOIN roled USING (person_id)) g ON g.locus_id = c.locus_id AND ((c.who IN (1, 3) AND g.allele_1 = proband_1 AND g.allele_2 = proband_2) OR (c.who IN (2, 3) AND g.allele_1 = sibling_1 AND g.allele_2 = sibling_2)) GROUP BY ALL""", FULL))
def _(v):
    return DN.child_genotype_frequency(cases(v), start_genotypes(v), parents(v))


CONTEXT = """feat AS (SELECT chrom, start, MIN(CASE WHEN kind = 'exon' THEN info END) AS exon, MIN(CASE WHEN kind = 'intron' THEN info END) AS intron, MIN(CASE WHEN kind = 'mirna' THEN info END) AS mirna, MIN(CASE WHEN kind = 'utr' THEN info END) AS utr FROM annotation GROUP BY chrom, start),
  ann AS (SELECT l.*, exon, intron, mirna, utr FROM locus l LEFT JOIN feat USING (chrom, start)),
  ctx AS (SELECT locus_id, CASE WHEN exon IS NOT NULL THEN 'exon' WHEN intron IS NOT NULL THEN 'intron' WHEN utr IS NOT NULL THEN 'UTR' WHEN mirna IS NOT NULL THEN 'miRNA' ELSE 'intergenic' END AS context FROM ann)"""


def contexts(v):
    return AN.annotate(v.locus, v.annotation).select("locus_id", AN.context().alias("context"))


@query("dn21_violation_tally", oracle(VIEWS + " locus annotation", """SELECT sex, violation, context, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE who WHEN 1 THEN p WHEN 2 THEN s ELSE p || '/' || s END AS sex, violation, context FROM classified
  JOIN (SELECT family_id, MAX(CASE WHEN role = 'proband' THEN sex END) AS p, MAX(CASE WHEN role = 'sibling' THEN sex END) AS s FROM roled GROUP BY family_id) USING (family_id) JOIN ctx USING (locus_id)) GROUP BY CUBE (sex, violation, context)""", FULL + [CONTEXT]))
def _(v):
    return DN.tally(cases(v), v.person, contexts(v))


@query("dn22_single_child_subset", oracle(VIEWS + " locus annotation", """SELECT l.locus_id, l.family_id, l.w AS who FROM labels_ l JOIN metrics m USING (locus_id, family_id) JOIN classified c USING (locus_id, family_id) JOIN ctx ON ctx.locus_id = l.locus_id
  WHERE -10 * log10(obedience) >= 30 AND context IN ('exon') AND l.w < 3 AND c.who = l.w AND c.violation = 'commission' AND m.eps < 0.1 AND case_confidence > 0.5""", FULL + [LABELS, CONTEXT]))
def _(v):
    labelled = DN.label_violators(start_scores(v))
    same = labelled.join(cases(v).select(*KEYS, F.col("who").alias("case_who")), KEYS).filter("who = case_who")
    return DN.single_child_subset(same, metrics(v), contexts(v), 30, 0.1, 0.5).select(*KEYS, "who")


PAIRS = """pairs_ AS MATERIALIZED (SELECT locus_id, family_id, who, a AS compare_1, CASE WHEN a <> b THEN b WHEN a <> ref_length THEN ref_length ELSE (SELECT r.allele_len FROM rk r WHERE r.locus_id = z.locus_id AND r.allele_len <> z.a ORDER BY r.r LIMIT 1) END AS compare_2
  FROM (SELECT locus_id, family_id, who, ref_length, CASE WHEN who = 2 THEN sibling_1 ELSE proband_1 END AS a, CASE WHEN who = 2 THEN sibling_2 ELSE proband_2 END AS b FROM cases JOIN locus USING (locus_id)) z)"""


@query("dn23_comparison_pair", oracle(VIEWS + " locus", "SELECT * FROM pairs_", FULL + [PAIRS]))
def _(v):
    return DN.comparison_pair(cases(v), v.locus, v.allele_cov)


@query("dn24_other_coverage", oracle(VIEWS + " locus", """SELECT p.locus_id, p.family_id, a.person_id, CAST(SUM(CASE WHEN allele_len NOT IN (compare_1, compare_2) THEN n ELSE 0 END) AS BIGINT) AS cov_other
  FROM pairs_ p JOIN allele_cov a USING (locus_id) JOIN roled r ON r.person_id = a.person_id AND r.family_id = p.family_id GROUP BY ALL""", FULL + [PAIRS]))
def _(v):
    pairs = DN.comparison_pair(cases(v), v.locus, v.allele_cov)
    return DN.other_coverage(pairs, v.allele_cov, v.person).select(*KEYS, "person_id", "cov_other")
