"""Queries on cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as AN
from ..operators import cohort as C
from ..operators import denovo as DN
from ..operators import genotype as G
from ..operators import population as PO
from ..operators import stats as ST
from ..registry import oracle, query
from .denovo import CONTEXT, FULL, LABELS
from .families import start_scores
from .genotypes import EM, fitted, start_genotypes
from .sql import start_calls

VIEWS = "allele_cov expected"
FAMILY = "allele_cov expected person"
GENO = start_calls()
ROLED = "roled AS (SELECT person_id, family_id, sex, CASE relation WHEN 'mother' THEN 'mother' WHEN 'father' THEN 'father' WHEN 'self' THEN 'proband' ELSE 'sibling' END AS role FROM person)"
PAR = GENO + [ROLED]


@query("st01_null_frequency", oracle(VIEWS, """SELECT locus_id, round(AVG(CASE WHEN allele_1 > 0 AND allele_2 < 0 THEN 1 ELSE 0 END), 6) AS single_null, round(AVG(CASE WHEN allele_1 < 0 THEN 1 ELSE 0 END), 6) AS double_null FROM geno GROUP BY locus_id""", GENO))
def _(v):
    return ST.locus_summary(start_genotypes(v)).select("locus_id", F.round("single_null", 6).alias("single_null"), F.round("double_null", 6).alias("double_null"))


@query("st02_called_alleles", oracle(VIEWS, "SELECT locus_id, CAST(COUNT(DISTINCT a) FILTER (a > 0) AS INT) AS n_alleles FROM (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM geno) GROUP BY locus_id", GENO))
def _(v):
    return ST.locus_summary(start_genotypes(v)).select("locus_id", "n_alleles")


@query("st03_het_share", oracle(VIEWS, "SELECT locus_id, round(AVG(CASE WHEN allele_1 > 0 AND allele_2 > 0 AND allele_1 <> allele_2 THEN 1 ELSE 0 END), 6) AS het_share FROM geno GROUP BY locus_id", GENO))
def _(v):
    return ST.locus_summary(start_genotypes(v)).select("locus_id", F.round("het_share", 6).alias("het_share"))


@query("st04_iteration_frequency", oracle(VIEWS, "SELECT CAST(n_iter AS INT) AS n_iter, CAST(COUNT(*) AS BIGINT) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM m_end), 6) AS share FROM m_end GROUP BY n_iter", EM))
def _(v):
    return ST.iteration_frequency(G.locus_models(fitted(v)[1])).withColumn("share", F.round("share", 6))


# error rates of the fitted loci, to 8 places so that the last bits of a sum do not decide between bins
RATES = """rates AS (SELECT locus_id, round(eps, 8) AS eps FROM m_end)"""


def rates(v):
    return G.locus_models(fitted(v)[1]).select("locus_id", F.round("eps", 8).alias("eps"))


@query("st05_error_histogram", oracle(VIEWS, "SELECT CAST(floor(round(log10(eps) / 0.05, 6)) AS BIGINT) AS log_bin, CAST(floor(round(eps / 0.01, 6)) AS BIGINT) AS linear_bin, CAST(COUNT(*) AS BIGINT) AS n FROM rates GROUP BY 1, 2", EM + [RATES]))
def _(v):
    return ST.error_bins(rates(v))


@query("st06_error_by_motif", oracle(VIEWS + " locus", "SELECT CAST(floor(round(log10(eps) / 0.05, 6)) AS BIGINT) AS log_bin, CAST(length(unit) AS INT) AS motif_len, CAST(COUNT(*) AS BIGINT) AS n FROM rates JOIN locus USING (locus_id) GROUP BY 1, 2", EM + [RATES]))
def _(v):
    return ST.error_by_motif(rates(v), v.locus.select("locus_id", F.length("unit").alias("motif_len")))


@query("st07_error_by_reference_length", oracle(VIEWS + " locus", """SELECT motif_len, ref_length, log_bin, n, round(len_share, 6) AS len_share FROM (SELECT *, SUM(n) OVER (PARTITION BY motif_len, ref_length) / SUM(n) OVER (PARTITION BY motif_len) AS len_share FROM
  (SELECT length(unit) AS motif_len, ref_length, CAST(floor(round(log10(eps) / 0.05, 6)) AS BIGINT) AS log_bin, COUNT(*) AS n FROM rates JOIN locus USING (locus_id) GROUP BY 1, 2, 3)) WHERE len_share > 0.001""", EM + [RATES]))
def _(v):
    loci = v.locus.select("locus_id", "ref_length", F.length("unit").alias("motif_len"))
    return ST.error_by_reference_length(rates(v), loci).withColumn("len_share", F.round("len_share", 6))


@query("st08_bias_distribution", oracle(VIEWS + " locus", """SELECT alleles, CAST(COUNT(*) AS BIGINT) AS n, round(AVG(b), 5) AS mean_bias, round(median(b), 5) AS median_bias FROM (SELECT b, unnest(['all', CASE WHEN allele_len = ref_length THEN 'reference' ELSE 'non_reference' END]) AS alleles
  FROM b_end JOIN rk USING (locus_id, r) JOIN locus USING (locus_id)) GROUP BY alleles""", EM))
def _(v):
    d = ST.bias_distribution(G.allele_biases(fitted(v)[1]), v.locus)
    return d.select("alleles", "n", F.round("mean_bias", 5).alias("mean_bias"), F.round("median_bias", 5).alias("median_bias"))


MEDS = ["confidence", "allele_fit", "noise_fit", "p_null"]
MED_SQL = ", ".join(f"round(median(round({c}, 6)), 8) AS median_{c}" for c in MEDS)


@query("st09_medians", oracle(VIEWS, f"""SELECT 'all' AS level, NULL::BIGINT AS locus_id, NULL::BIGINT AS person_id, {MED_SQL} FROM geno UNION ALL SELECT 'locus', locus_id, NULL, {MED_SQL} FROM geno GROUP BY locus_id
  UNION ALL SELECT 'person', NULL, person_id, {MED_SQL} FROM geno GROUP BY person_id""", GENO))
def _(v):
    m = ST.medians(start_genotypes(v), MEDS)
    return m.select("level", "locus_id", "person_id", *[F.round(f"median_{c}", 8).alias(f"median_{c}") for c in MEDS])


HIST_SQL = " UNION ALL ".join(f"SELECT '{c}' AS measure, CAST(floor(round(round({c}, 7) / 0.05, 6)) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS n FROM geno GROUP BY 2" for c in MEDS)


@query("st09_histograms", oracle(VIEWS, HIST_SQL, GENO))
def _(v):
    return ST.histograms(start_genotypes(v).select(*[F.round(c, 7).alias(c) for c in MEDS]), MEDS)


@query("st10_coverage_by_context", oracle(VIEWS + " locus annotation", "SELECT person_id, context = 'exon' AS exonic, median(total) AS median_cov, CAST(COUNT(*) AS BIGINT) AS n_loci FROM geno JOIN ctx USING (locus_id) GROUP BY 1, 2", GENO + [CONTEXT]))
def _(v):
    ctx = AN.annotate(v.locus, v.annotation).select("locus_id", AN.context().alias("context"))
    return ST.coverage_by_context(start_genotypes(v).select("locus_id", "person_id", "total"), ctx)


HWE = """par AS (SELECT g.* FROM geno g JOIN roled USING (person_id) WHERE role IN ('mother', 'father')),
  psz AS (SELECT locus_id, COUNT(*) AS parents, COUNT(*) FILTER (allele_1 > 0 AND allele_2 > 0) AS n FROM par GROUP BY locus_id),
  af AS (SELECT locus_id, a, COUNT(*) AS copies FROM (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM par WHERE allele_1 > 0 AND allele_2 > 0) GROUP BY ALL),
  am AS (SELECT locus_id, COUNT(*) AS m FROM af GROUP BY locus_id),
  ob AS (SELECT locus_id, least(allele_1, allele_2) AS x, greatest(allele_1, allele_2) AS y, COUNT(*) AS o FROM par WHERE allele_1 > 0 AND allele_2 > 0 GROUP BY ALL),
  ex AS (SELECT a.locus_id, n, COALESCE(o, 0) AS o, CASE WHEN a.a = b.a THEN (a.copies / (2 * n)) * (a.copies / (2 * n)) * n ELSE 2 * (a.copies / (2 * n)) * (b.copies / (2 * n)) * n END AS e
    FROM af a JOIN af b ON a.locus_id = b.locus_id AND a.a <= b.a JOIN psz ON psz.locus_id = a.locus_id LEFT JOIN ob ON ob.locus_id = a.locus_id AND ob.x = a.a AND ob.y = b.a),
  hw AS (SELECT p.locus_id, parents, n AS non_null, COALESCE(m, 0) AS n_alleles, CASE WHEN n >= parents * 0.5 THEN CASE WHEN m = 1 THEN 0.0 ELSE s END END AS score, CASE WHEN n >= parents * 0.5 THEN CASE WHEN m = 1 THEN 0 ELSE m * (m + 1) / 2 - m END END AS df
    FROM psz p LEFT JOIN am USING (locus_id) LEFT JOIN (SELECT locus_id, SUM((o - e) * (o - e) / e) AS s FROM ex GROUP BY locus_id) USING (locus_id))"""


@query("st11_hardy_weinberg", oracle(FAMILY, "SELECT locus_id, CAST(parents AS BIGINT) AS parents, CAST(non_null AS BIGINT) AS non_null, CAST(n_alleles AS BIGINT) AS n_alleles, round(score, 5) AS score, CAST(df AS BIGINT) AS df FROM hw", PAR + [HWE]))
def _(v):
    return ST.hardy_weinberg(start_genotypes(v), C.subgroup(v.person, "parents")).drop("p_value").withColumn("score", F.round("score", 5))


# Upper tail of chi-square for whole degrees: a finite sum, and for odd degrees the complementary error function of sqrt(h), h = score / 2, by the
# series erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum of (2 x^2)^n * x / (2 n + 1)!!, whose terms are all positive.
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda j: exp((j + 0.5) * ln(h) - h + 2 * j * ln(2) + lgamma(j + 1) - lgamma(2 * j + 2))))"
_SUM = "COALESCE(list_sum(list_transform(range(0, CAST(df // 2 AS BIGINT)), lambda j: exp((j + (df % 2) / 2.0) * ln(h) - h - lgamma(j + (df % 2) / 2.0 + 1)))), 0)"
TAIL = f"""pv AS MATERIALIZED (SELECT locus_id, CASE WHEN df = 0 THEN 1.0 ELSE least(1.0, CASE WHEN df % 2 = 0 OR h > 36 THEN 0 ELSE 1 - ({_ERF}) END + {_SUM}) END AS p_value, df
  FROM (SELECT locus_id, CAST(df AS BIGINT) AS df, greatest(score / 2, 1e-300) AS h FROM hw WHERE score IS NOT NULL))"""
PVALUE = oracle(FAMILY, "SELECT locus_id, round(p_value, 6) AS p_value FROM pv WHERE df > 0", PAR + [HWE, TAIL])


@query("st11_hwe_p_value", PVALUE)
@query("st11_hwe_p_values", PVALUE)
def _(v):
    h = ST.hardy_weinberg(start_genotypes(v), C.subgroup(v.person, "parents"))
    return h.filter("df > 0 AND score IS NOT NULL").select("locus_id", F.round("p_value", 6).alias("p_value"))


ENDS = """ctx2 AS (SELECT locus_id, CASE WHEN exon IS NOT NULL THEN 'exon' WHEN intron IS NOT NULL THEN 'intron' WHEN contains(utr, 'utr5') THEN '5u' WHEN contains(utr, 'utr3') THEN '3u' WHEN mirna IS NOT NULL THEN 'mirna' ELSE 'intergenic' END AS c FROM ann)"""
HET = "CAST(COUNT(*) FILTER (h AND c = '{c}') AS BIGINT) AS het_{n}"


BALANCED = oracle(FAMILY + " locus annotation", "SELECT person_id, " + ", ".join(HET.format(c=c, n=n) for c, n in [("exon", "exon"), ("3u", "utr_3"), ("5u", "utr_5"), ("intron", "intron"), ("mirna", "mirna"), ("intergenic", "intergenic")])
    + " FROM (SELECT person_id, c, allele_1 > 0 AND allele_2 > 0 AND allele_1 <> allele_2 AS h FROM geno JOIN pv USING (locus_id) JOIN ctx2 USING (locus_id) WHERE p_value > 0.05) GROUP BY person_id", PAR + [HWE, TAIL, CONTEXT, ENDS])


@query("st12_het_loci_by_context", BALANCED)
@query("st12_het_loci_in_equilibrium", BALANCED)
def _(v):
    g = start_genotypes(v)
    ctx = AN.annotate(v.locus, v.annotation).select("locus_id", AN.context("by_end").alias("context"))
    return ST.het_loci(g, ST.hardy_weinberg(g, C.subgroup(v.person, "parents")), ctx)


@query("st13_loci_by_context", oracle("locus annotation", "SELECT context, CAST(COUNT(*) AS BIGINT) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM ctx), 6) AS share FROM ctx GROUP BY context", [CONTEXT]))
def _(v):
    ctx = AN.annotate(v.locus, v.annotation).select("locus_id", AN.context().alias("context"))
    return ST.loci_by_context(ctx).withColumn("share", F.round("share", 6))


@query("st14_genotype_matrix", oracle(VIEWS, "SELECT locus_id, allele_1, allele_2, CAST(COUNT(*) AS BIGINT) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY locus_id), 6) AS frequency FROM geno GROUP BY locus_id, allele_1, allele_2", GENO))
def _(v):
    return ST.genotype_matrix(start_genotypes(v)).withColumn("frequency", F.round("frequency", 6))


SHARE = 0.2
RARE = f"""prl AS (SELECT locus_id, COUNT(*) AS parents, COUNT(*) FILTER (allele_1 > 0 AND allele_2 > 0) AS nn FROM geno JOIN roled USING (person_id) WHERE role IN ('mother', 'father') GROUP BY locus_id),
  cps AS (SELECT locus_id, a AS allele, COUNT(*) AS copies FROM (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM geno JOIN roled USING (person_id) WHERE role IN ('mother', 'father') AND allele_1 > 0 AND allele_2 > 0) GROUP BY ALL),
  rare AS (SELECT locus_id, allele, copies, parents, nn FROM cps JOIN prl USING (locus_id) WHERE nn >= parents * 0.5 AND {{cond}})"""


@query("st15_rare_alleles", oracle(FAMILY, "SELECT locus_id, allele, CAST(copies AS BIGINT) AS copies FROM rare", PAR + [RARE.format(cond=f"copies <= nn * {SHARE}")]))
def _(v):
    return ST.rare_alleles(start_genotypes(v), v.person, SHARE).select("locus_id", "allele", "copies")


TRANS = """fm AS (SELECT g.*, family_id, role, sex, confidence > {c} AND allele_fit > {a} AND noise_fit > {n} AND p_null < {p} AS good FROM geno g JOIN roled USING (person_id)),
  gl AS (SELECT locus_id, COUNT(DISTINCT person_id) AS good_parents, COUNT(DISTINCT al) AS good_alleles FROM (SELECT locus_id, person_id, unnest([allele_1, allele_2]) AS al FROM fm WHERE good AND role IN ('mother', 'father')) GROUP BY locus_id),
  want AS (SELECT DISTINCT r.locus_id, r.allele, family_id FROM rare r JOIN fm ON fm.locus_id = r.locus_id AND r.allele IN (allele_1, allele_2) AND role IN ('mother', 'father') AND allele_1 > 0 AND allele_2 > 0 WHERE family_id NOT IN (SELECT family_id FROM bad_family)),
  trans AS (SELECT w.locus_id, w.family_id, w.allele, bool_and(good) AS ok, COUNT(*) AS members, MAX(CASE WHEN role = 'proband' THEN sex END) || MAX(CASE WHEN role = 'sibling' THEN sex END) AS family_type,
    SUM(CASE WHEN role = 'mother' THEN cp END) AS mother_copies, SUM(CASE WHEN role = 'father' THEN cp END) AS father_copies, SUM(CASE WHEN role = 'proband' THEN cp END) AS proband_copies, SUM(CASE WHEN role = 'sibling' THEN cp END) AS sibling_copies
    FROM want w JOIN (SELECT * FROM fm) f USING (locus_id, family_id), LATERAL (SELECT CASE WHEN allele_1 = w.allele THEN 1 ELSE 0 END + CASE WHEN allele_2 = w.allele THEN 1 ELSE 0 END AS cp) GROUP BY w.locus_id, w.family_id, w.allele)"""
TRANS_OUT = """SELECT t.locus_id, family_id, allele, family_type, CAST(mother_copies AS BIGINT) AS mother_copies, CAST(father_copies AS BIGINT) AS father_copies, CAST(proband_copies AS BIGINT) AS proband_copies, CAST(sibling_copies AS BIGINT) AS sibling_copies,
  CAST(good_parents AS BIGINT) AS good_parents, CAST(good_alleles AS BIGINT) AS good_alleles FROM trans t LEFT JOIN gl USING (locus_id) WHERE ok AND members = 4"""
LIMITS = dict(confidence=0.4, allele_fit=1e-5, noise_fit=1e-5, p_null=0.7)
SQL_LIMITS = dict(c=0.4, a=1e-5, n=1e-5, p=0.7)
LOOSE = dict(confidence=0.3, allele_fit=1e-7, noise_fit=1e-6, p_null=0.8)
SQL_LOOSE = dict(c=0.3, a=1e-7, n=1e-6, p=0.8)


def transmitted(v):
    g = start_genotypes(v)
    return ST.transmissions(g, v.person, ST.rare_alleles(g, v.person, SHARE), v.bad_family, **LIMITS)


TRANSMITTED = PAR + [RARE.format(cond=f"copies <= nn * {SHARE}"), TRANS.format(**SQL_LIMITS)]


@query("st16_transmissions", oracle(FAMILY + " bad_family", TRANS_OUT, TRANSMITTED))
def _(v):
    return transmitted(v)


@query("st17_ultra_rare", oracle(FAMILY + " bad_family", TRANS_OUT, PAR + [RARE.format(cond="copies = 1"), TRANS.format(**SQL_LOOSE)]))
def _(v):
    g = start_genotypes(v)
    return ST.transmissions(g, v.person, ST.rare_alleles(g, v.person, exactly=1), v.bad_family, **LOOSE)


@query("st18_good_parents", oracle(FAMILY + " bad_family", "SELECT DISTINCT t.locus_id, CAST(good_parents AS BIGINT) AS good_parents, CAST(good_alleles AS BIGINT) AS good_alleles FROM trans t LEFT JOIN gl USING (locus_id) WHERE ok AND members = 4", TRANSMITTED))
def _(v):
    return transmitted(v).select("locus_id", "good_parents", "good_alleles").distinct()


@query("st19_family_types", oracle(FAMILY + " bad_family", "SELECT family_type, CAST(COUNT(*) AS BIGINT) AS n FROM trans WHERE ok AND members = 4 GROUP BY family_type", TRANSMITTED))
def _(v):
    return transmitted(v).groupBy("family_type").agg(F.count(F.lit(1)).alias("n"))


@query("st20_rare_tallies", oracle(FAMILY, """SELECT CAST(COUNT(*) FILTER (nn < parents * 0.5) AS BIGINT) AS too_many_nulls, CAST((SELECT COUNT(DISTINCT locus_id) FROM rare) AS BIGINT) AS rare_allele_loci,
  CAST(COUNT(*) FILTER (nn >= parents * 0.5) AS BIGINT) AS passed FROM prl""", PAR + [RARE.format(cond=f"copies <= nn * {SHARE}")]))
def _(v):
    return ST.rare_tallies(start_genotypes(v), v.person, SHARE)


@query("st21_phred_histogram", oracle(FAMILY, "SELECT CAST(floor(round(-10 * log10(obedience), 6)) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS n FROM labels_ WHERE -10 * log10(obedience) > 0 GROUP BY 1", FULL + [LABELS]))
def _(v):
    return ST.phred_histogram(DN.phred_scores(DN.label_violators(start_scores(v))))


LOCUS_TABLE = """SELECT m.locus_id, CAST(k AS INT) AS k, CAST(locus_total AS BIGINT) AS locus_total, single_null, double_null, het_share, CAST(called_copies AS BIGINT) AS called_copies, CAST(called_alleles AS BIGINT) AS called_alleles FROM kk m
  JOIN (SELECT locus_id, round(AVG(CASE WHEN allele_1 > 0 AND allele_2 < 0 THEN 1 ELSE 0 END), 6) AS single_null, round(AVG(CASE WHEN allele_1 < 0 THEN 1 ELSE 0 END), 6) AS double_null,
    round(AVG(CASE WHEN allele_1 > 0 AND allele_2 > 0 AND allele_1 <> allele_2 THEN 1 ELSE 0 END), 6) AS het_share FROM geno GROUP BY locus_id) USING (locus_id)
  JOIN (SELECT locus_id, COUNT(*) FILTER (a >= 8) AS called_copies, COUNT(DISTINCT a) FILTER (a >= 8) AS called_alleles FROM (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM geno) GROUP BY locus_id) USING (locus_id)"""


@query("st22_locus_table", oracle(VIEWS, LOCUS_TABLE, GENO))
def _(v):
    g = start_genotypes(v)
    models = G.start_model(G.ranked_alleles(v.allele_cov)).select("locus_id", "k", "locus_total")
    t = ST.locus_table(models, ST.locus_summary(g), G.called_counts(g, v.allele_cov))
    return t.select("locus_id", "k", "locus_total", "called_copies", "called_alleles", *[F.round(c, 6).alias(c) for c in ("single_null", "double_null", "het_share")])


@query("st23_length_matrix", oracle("allele_cov person", "SELECT locus_id, person_id, allele_len, CAST(SUM(n) AS BIGINT) AS n FROM allele_cov JOIN roled USING (person_id) WHERE role IN ('mother', 'father') GROUP BY ALL", [ROLED]))
def _(v):
    return ST.length_matrix(v.allele_cov, v.person, C.SUBGROUPS["parents"])


@query("st24_family_length_matrix", oracle(FAMILY, """SELECT locus_id, family_id, role, allele_len, CAST(n AS BIGINT) AS n, (CASE WHEN allele_len = allele_1 THEN 1 ELSE 0 END + CASE WHEN allele_len = allele_2 THEN 1 ELSE 0 END) * exp_allele_cov AS expected_reads
  FROM allele_cov JOIN geno USING (locus_id, person_id) JOIN roled USING (person_id)""", PAR))
def _(v):
    return ST.family_length_matrix(v.allele_cov, start_genotypes(v), v.person)


@query("st23_people_order", oracle("allele_cov person", "SELECT person_id, CAST(SUM(n) AS BIGINT) AS n, role FROM allele_cov JOIN roled USING (person_id) GROUP BY person_id, role", [ROLED]))
def _(v):
    order = PO.person_columns(v.person).select("person_id", "rel_code")
    role = F.element_at(F.array(*[F.lit(r) for r in C.ROLES]), F.col("rel_code"))
    return v.allele_cov.join(order, "person_id").groupBy("person_id", role.alias("role")).agg(F.sum("n").alias("n"))
