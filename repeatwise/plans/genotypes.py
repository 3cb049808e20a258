"""Queries on the genotyper."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import genotype as G
from ..registry import oracle, query
from ..session import written
from .sql import START_EPS, call_ctes, em_ctes, genotype_ctes, posterior_ctes, start_calls

VIEWS = "allele_cov expected"
BASE = genotype_ctes()
POST = posterior_ctes(START_EPS)
KEYS = ["locus_id", "person_id"]


def coverage_input(v, cov: str = "allele_cov", expected: str = "expected"):
    """Person rows and ranked alleles, put together once for the fit, the calls and the memberships of all queries on this data."""

    def make():
        seen = written(getattr(v, cov), cov)
        loci = written(G.ranked_alleles(seen), "loci")
        return written(G.person_rows(seen, v.over(expected, **{cov: seen}), loci), "person-rows"), loci

    return v.stored(f"{cov}-rows", make)


def start(v, eps: float = START_EPS):
    """Packed rows and the unfitted model."""
    rows, loci = coverage_input(v)
    return rows, G.start_model(loci, eps)


def start_genotypes(v):
    """Genotype records of the unfitted model: the input of the family, de novo and statistics queries."""
    return v.stored("start-genotypes", lambda: G.calls(*start(v)))


def start_posteriors(v):
    return G.posteriors(*start(v))


def start_pairs(v, eps: float = START_EPS):
    return G.pair_rows(G.scored(*start(v, eps)))


@query("gt01_allele_ranks", oracle(VIEWS, "SELECT locus_id, allele_len, CAST(r AS BIGINT) AS r FROM rk", BASE))
def _(v):
    return G.ranked_alleles(v.allele_cov).select("locus_id", F.posexplode("lens").alias("i", "allele_len")).select("locus_id", "allele_len", (F.col("i") + 1).cast("long").alias("r"))


@query("gt02_person_coverage", oracle(VIEWS, "SELECT locus_id, person_id, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM cn JOIN pe USING (locus_id, person_id)", BASE))
def _(v):
    rows, _ = start(v)
    return rows.select(*KEYS, "total", F.posexplode("n").alias("i", "n")).select(*KEYS, (F.col("i") + 1).cast("long").alias("r"), "n", "total")


@query("gt03_pair_states", oracle(VIEWS, """SELECT locus_id, person_id, CAST(r1 AS INT) AS r1, CAST(r2 AS INT) AS r2, CAST(a1 AS BIGINT) AS a1, CAST(a2 AS BIGINT) AS a2, CAST(total AS BIGINT) AS total, CAST(err AS BIGINT) AS err,
  CAST(c1 AS INT) AS c1, CAST(c2 AS INT) AS c2, exp_cov FROM st""", BASE))
def _(v):
    return start_pairs(v).select(*KEYS, "r1", "r2", "a1", "a2", "total", "err", "c1", "c2", "exp_cov")


@query("gt04_pair_probabilities", oracle(VIEWS, "SELECT locus_id, person_id, CAST(r1 AS INT) AS r1, CAST(r2 AS INT) AS r2, round(p, 6) AS prob, round(ll, 6) AS ll FROM post", POST))
def _(v):
    return start_pairs(v).select(*KEYS, "r1", "r2", F.round("prob", 6).alias("prob"), F.round("ll", 6).alias("ll"))


DEGENERATE = posterior_ctes(1e-200)


@query("gt05_degenerate_people", oracle(VIEWS, "SELECT locus_id, person_id, round(p, 6) AS double_null, z = 0 AS unexplained FROM post WHERE r1 = k + 1", DEGENERATE))
def _(v):
    scored = G.scored(*start(v, 1e-200))
    rows = scored.select(*KEYS, "k", "z", F.get(G.memberships(scored), F.size("pairs") - 1).alias("p"))
    return rows.select(*KEYS, F.round("p", 6).alias("double_null"), (F.col("z") == 0).alias("unexplained"))


@query("gt06_initial_weights", oracle(VIEWS, "SELECT locus_id, CAST(COUNT(*) AS BIGINT) AS pairs, CAST(COUNT(*) AS DOUBLE) AS total_weight FROM prs GROUP BY locus_id", BASE))
def _(v):
    _, model = start(v)
    return model.select("locus_id", F.size("w").cast("long").alias("pairs"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total_weight"))


SUMS = """sums AS MATERIALIZED (SELECT locus_id, pair_no, r1, r2, SUM(p) / COUNT(*) AS nw, SUM(p * err) AS e, SUM(p * total) AS tt, SUM(p * a1) AS n1, SUM(p * c1 * exp_cov) AS d1, SUM(p * a2) AS n2, SUM(p * c2 * exp_cov) AS d2,
  SUM(ll) AS score FROM post GROUP BY locus_id, pair_no, r1, r2)"""
BIAS = """nb AS (SELECT locus_id, r, greatest(COALESCE(CASE WHEN SUM(d) > 0 THEN SUM(n) / SUM(d) END, 0), 1e-7) AS b FROM (SELECT locus_id, r1 AS r, nw * n1 AS n, nw * d1 AS d FROM sums
  UNION ALL SELECT locus_id, r2, nw * n2, nw * d2 FROM sums WHERE r1 < r2) GROUP BY locus_id, r)"""


@query("gt07_pair_weights", oracle(VIEWS, "SELECT locus_id, CAST(r1 AS INT) AS r1, CAST(r2 AS INT) AS r2, round(nw, 6) AS weight FROM sums", POST + [SUMS]))
def _(v):
    rows, model = start(v)
    return G.batched_sums(G.packed_people(rows), model).select("locus_id", "r1", "r2", F.round(F.col("member") / F.col("people"), 6).alias("weight"))


def one_round(v):
    rows, model = start(v)
    return rows, model, G.maximised(G.batched_sums(G.packed_people(rows), model), model)


@query("gt08_error_rate", oracle(VIEWS, "SELECT locus_id, round(CASE WHEN x > 0 THEN x ELSE 1.0 / locus_total END, 6) AS eps FROM (SELECT locus_id, SUM(nw * e) / SUM(nw * tt) AS x FROM sums GROUP BY locus_id) JOIN kk USING (locus_id)", POST + [SUMS]))
def _(v):
    return one_round(v)[2].select("locus_id", F.round("new_eps", 6).alias("eps"))


@query("gt09_allele_bias", oracle(VIEWS, "SELECT locus_id, allele_len, round(b, 6) AS bias FROM nb JOIN rk USING (locus_id, r)", POST + [SUMS, BIAS]))
def _(v):
    _, model, step = one_round(v)
    return G.allele_biases(step.join(model.select("locus_id", "lens"), "locus_id").withColumnRenamed("new_bias", "bias")).withColumn("bias", F.round("bias", 6))


@query("gt10_biased_pairs", oracle(VIEWS, """SELECT p.locus_id, CAST(p.r1 AS INT) AS r1, CAST(p.r2 AS INT) AS r2, round(CASE WHEN p.r1 <= k THEN x.b ELSE 1 END, 6) AS bias_1, round(CASE WHEN p.r2 <= k THEN y.b ELSE 1 END, 6) AS bias_2
  FROM (SELECT DISTINCT locus_id, r1, r2 FROM st) p JOIN kk USING (locus_id) LEFT JOIN nb x ON x.locus_id = p.locus_id AND x.r = p.r1 LEFT JOIN nb y ON y.locus_id = p.locus_id AND y.r = p.r2""", POST + [SUMS, BIAS]))
def _(v):
    _, model, step = one_round(v)
    pairs = model.select("locus_id", F.explode(G.pair_list(F.col("k"))).alias("p")).join(step.select("locus_id", "new_bias"), "locus_id")
    b = lambda r: F.round(F.coalesce(F.get("new_bias", F.col(f"p.{r}") - 1), F.lit(1.0)), 6)
    return pairs.select("locus_id", F.col("p.r1").cast("int").alias("r1"), F.col("p.r2").cast("int").alias("r2"), b("r1").alias("bias_1"), b("r2").alias("bias_2"))


@query("gt11_model_score", oracle(VIEWS, "SELECT locus_id, round(SUM(score), 3) AS score FROM sums GROUP BY locus_id", POST + [SUMS]))
def _(v):
    return one_round(v)[2].select("locus_id", F.round("score", 3).alias("score"))


EM = em_ctes()


def fitted(v):
    """Packed rows and the fitted model."""
    rows, loci = coverage_input(v)
    return rows, v.stored("em-model", lambda: G.em(rows, loci))


@query("gt12_em_models", oracle(VIEWS, "SELECT locus_id, CAST(k AS INT) AS k, CAST(locus_total AS BIGINT) AS locus_total, round(eps, 6) AS eps, CAST(n_iter AS INT) AS n_iter FROM m_end", EM))
def _(v):
    return G.locus_models(fitted(v)[1]).withColumn("eps", F.round("eps", 6))


EM_CALLS = EM + [
    "em_l AS MATERIALIZED (SELECT st.*, w_used AS w, " + "{ll} AS ll FROM st JOIN m_end m USING (locus_id) JOIN w_end ww USING (locus_id, pair_no) LEFT JOIN b_end x ON x.locus_id = st.locus_id AND x.r = st.r1 LEFT JOIN b_end y ON y.locus_id = st.locus_id AND y.r = st.r2)",
    "post AS MATERIALIZED (SELECT *, CASE WHEN z > 0 THEN w * exp(ll) / z WHEN r1 = k + 1 THEN 1.0 ELSE 0.0 END AS p FROM (SELECT *, SUM(w * exp(ll)) OVER (PARTITION BY locus_id, person_id) AS z FROM em_l))",
    "fit_m AS (SELECT locus_id, eps, n_iter FROM m_end)", "fit_b AS (SELECT locus_id, r, b FROM b_end)",
]
from .sql import log_likelihood  # noqa: E402

EM_CALLS = [c.replace("{ll}", log_likelihood("COALESCE(x.b_used, 1)", "COALESCE(y.b_used, 1)", "eps_used")) for c in EM_CALLS] + call_ctes("post", "fit")
RECORD = """SELECT locus_id, person_id, allele_1, allele_2, round(confidence, 5) AS confidence, allele_1_cov, allele_2_cov, rest_cov, round(exp_allele_cov, 5) AS exp_allele_cov, round(exp_err, 5) AS exp_err, round(p_null, 5) AS p_null,
  round(allele_fit, 5) AS allele_fit, round(noise_fit, 5) AS noise_fit, n_iter FROM geno"""


def rounded(genotypes, digits: int = 5):
    doubles = ["confidence", "exp_allele_cov", "exp_err", "p_null", "allele_fit", "noise_fit"]
    return genotypes.select(*KEYS, "allele_1", "allele_2", "allele_1_cov", "allele_2_cov", "rest_cov", "n_iter", *[F.round(c, digits).alias(c) for c in doubles])


@query("gt20_em_genotypes", oracle(VIEWS, RECORD, EM_CALLS))
def _(v):
    return rounded(G.calls(*fitted(v)))


START = start_calls()


@query("gt13_likeliest_genotype", oracle(VIEWS, "SELECT locus_id, person_id, allele_1, allele_2 FROM geno", START))
def _(v):
    return start_genotypes(v).select(*KEYS, "allele_1", "allele_2")


@query("gt14_confidence", oracle(VIEWS, "SELECT locus_id, person_id, round(confidence, 6) AS confidence FROM geno", START))
def _(v):
    return start_genotypes(v).select(*KEYS, F.round("confidence", 6).alias("confidence"))


@query("gt15_null_probability", oracle(VIEWS, "SELECT locus_id, person_id, round(p_null, 6) AS p_null FROM geno", START))
def _(v):
    return start_genotypes(v).select(*KEYS, F.round("p_null", 6).alias("p_null"))


@query("gt16_call_coverage", oracle(VIEWS, "SELECT locus_id, person_id, allele_1_cov, allele_2_cov, rest_cov FROM geno", START))
def _(v):
    return start_genotypes(v).select(*KEYS, "allele_1_cov", "allele_2_cov", "rest_cov")


@query("gt17_allele_fit", oracle(VIEWS, "SELECT locus_id, person_id, round(allele_fit, 6) AS allele_fit FROM geno", START))
def _(v):
    return start_genotypes(v).select(*KEYS, F.round("allele_fit", 6).alias("allele_fit"))


@query("gt18_noise_fit", oracle(VIEWS, "SELECT locus_id, person_id, round(noise_fit, 6) AS noise_fit FROM geno", START))
def _(v):
    return start_genotypes(v).select(*KEYS, F.round("noise_fit", 6).alias("noise_fit"))


@query("gt19_expected_columns", oracle(VIEWS, "SELECT locus_id, person_id, exp_allele_cov, round(exp_err, 6) AS exp_err FROM geno", START))
def _(v):
    return start_genotypes(v).select(*KEYS, "exp_allele_cov", F.round("exp_err", 6).alias("exp_err"))


@query("gt21_called_counts", oracle(VIEWS, """SELECT locus_id, allele_len, CAST(COUNT(a) AS BIGINT) AS num_called FROM rk LEFT JOIN (SELECT locus_id, allele_1 AS a FROM geno UNION ALL SELECT locus_id, allele_2 FROM geno) g
  USING (locus_id) GROUP BY locus_id, allele_len""".replace("COUNT(a)", "COUNT(*) FILTER (a = allele_len AND a >= 8)"), START))
def _(v):
    return G.called_counts(start_genotypes(v), v.allele_cov)


@query("gt22_em_biases", oracle(VIEWS, "SELECT locus_id, allele_len, round(b, 5) AS bias FROM b_end JOIN rk USING (locus_id, r)", EM))
def _(v):
    return G.allele_biases(fitted(v)[1]).withColumn("bias", F.round("bias", 5))


@query("gt23_parental_frequency", oracle(VIEWS + " person", "SELECT locus_id, CAST(r1 AS INT) AS r1, CAST(r2 AS INT) AS r2, round(SUM(p), 5) AS parent_freq FROM post JOIN person USING (person_id) WHERE relation IN ('mother', 'father') GROUP BY ALL", POST))
def _(v):
    return G.parental_frequency(*start(v), C.subgroup(v.person, "parents")).withColumn("parent_freq", F.round("parent_freq", 5))
