"""Queries on the coverage model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as CV
from ..registry import oracle, query

COV = ["locus_id", "person_id"]
TOTALS = "totals AS (SELECT person_id, CAST(SUM(n) AS BIGINT) AS total FROM allele_cov GROUP BY person_id)"
# per-allele coverage
MODEL = ["pa AS (SELECT locus_id, person_id, SUM(n) / 2.0 AS cov FROM allele_cov GROUP BY locus_id, person_id)"]


@query("cm01_person_totals", oracle("allele_cov", "SELECT person_id, total FROM totals", [TOTALS]))
def _(v):
    return CV.person_totals(v.allele_cov)


@query("cm02_person_means", oracle("allele_cov", "SELECT person_id, round(total / (SELECT COUNT(DISTINCT locus_id) FROM allele_cov), 6) AS mean_cov FROM totals", [TOTALS]))
def _(v):
    n_loci = v.allele_cov.select("locus_id").distinct().count()
    return CV.person_means(v.allele_cov, n_loci).withColumn("mean_cov", F.round("mean_cov", 6))


@query("cm03_per_allele_coverage", oracle("allele_cov", "SELECT locus_id, person_id, cov FROM pa", MODEL))
def _(v):
    return CV.per_allele(v.allele_cov)


# leading right singular vector by power iteration, unrolled
def _power(rounds: int = 40) -> list[str]:
    ctes = ["v0 AS MATERIALIZED (SELECT DISTINCT person_id, 1.0::DOUBLE AS v FROM pa)"]
    for i in range(1, rounds + 1):
        ctes += [
            f"y{i} AS MATERIALIZED (SELECT locus_id, SUM(cov * v) AS y FROM pa JOIN v{i - 1} USING (person_id) GROUP BY locus_id)",
            f"u{i} AS MATERIALIZED (SELECT person_id, SUM(cov * y) AS v FROM pa JOIN y{i} USING (locus_id) GROUP BY person_id)",
            f"v{i} AS MATERIALIZED (SELECT person_id, v / (SELECT sqrt(SUM(v * v)) FROM u{i}) AS v FROM u{i})",
        ]
    last = rounds
    return ctes + [f"yl AS MATERIALIZED (SELECT locus_id, SUM(cov * v) AS y FROM pa JOIN v{last} USING (person_id) GROUP BY locus_id)"]


RANK_ONE = MODEL[:1] + _power() + [
    "r AS MATERIALIZED (SELECT locus_id, person_id, y * v AS raw FROM yl CROSS JOIN v40)",
    "low AS MATERIALIZED (SELECT MIN(raw) AS least FROM r WHERE raw > 0)",
    "fitted AS MATERIALIZED (SELECT locus_id, person_id, cov, CASE WHEN raw < 0 THEN least ELSE raw END AS exp_cov FROM pa JOIN r USING (locus_id, person_id), low)",
]


def fitted(v):
    """Per-allele coverage and its rank-one expectation."""
    return CV.per_allele(v.allele_cov), v.stored("rank-one", lambda: CV.expected_coverage(CV.per_allele(v.allele_cov), 1))


@query("cm04_leading_singular_value", oracle("allele_cov", "SELECT 1 AS component, round(sqrt(SUM(y * y)), 4) AS singular_value FROM yl", MODEL[:1] + _power()))
def _(v):
    return CV.singular_values(CV.per_allele(v.allele_cov), 1).withColumn("singular_value", F.round("singular_value", 4))


@query("cm05_component_choice")
def _(v):
    k = CV.choose_components(CV.per_allele(v.allele_cov))
    return CV.singular_values(CV.per_allele(v.allele_cov), k)


@query("cm06_rank_one_expected", oracle("allele_cov", """SELECT locus_id, person_id, round(CASE WHEN raw < 0 THEN least ELSE raw END, 4) AS exp_cov FROM r, low""", RANK_ONE))
def _(v):
    return CV.expected_coverage(CV.per_allele(v.allele_cov), 1).withColumn("exp_cov", F.round("exp_cov", 4))


@query("cm06_rank_three_expected")
def _(v):
    return CV.expected_coverage(CV.per_allele(v.allele_cov), 3)


@query("cm07_overall_fit", oracle("allele_cov", "SELECT round(corr(cov, exp_cov), 6) AS corr, round(sqrt(AVG((exp_cov - cov) * (exp_cov - cov))), 6) AS rmse FROM fitted", RANK_ONE))
def _(v):
    return CV.fit(*fitted(v)).select(F.round("corr", 6).alias("corr"), F.round("rmse", 6).alias("rmse"))


@query("cm08_person_fit", oracle("allele_cov", "SELECT person_id, round(corr(cov, exp_cov), 6) AS corr FROM fitted GROUP BY person_id HAVING SUM(cov) > 0", RANK_ONE))
def _(v):
    return CV.person_fit(*fitted(v)).withColumn("corr", F.round("corr", 6))


@query("cm09_low_coverage_people", oracle("allele_cov", "SELECT person_id, total FROM totals WHERE total < (SELECT AVG(total) - 2 * stddev_samp(total) FROM totals)", [TOTALS]))
def _(v):
    return CV.low_coverage_people(CV.person_totals(v.allele_cov))


@query("cm10_poor_fit_people", oracle("allele_cov", "SELECT person_id, round(c, 6) AS corr FROM (SELECT person_id, corr(cov, exp_cov) AS c FROM fitted GROUP BY person_id) WHERE c < 0.8", RANK_ONE))
def _(v):
    return CV.poor_fit_people(CV.person_fit(*fitted(v))).withColumn("corr", F.round("corr", 6))


@query("cm11_observed_over_expected", oracle("allele_cov", "SELECT locus_id, person_id, allele_len, round(n / exp_cov, 5) AS ratio FROM allele_cov JOIN fitted USING (locus_id, person_id)", RANK_ONE))
def _(v):
    _, expected = fitted(v)
    return CV.observed_over_expected(v.allele_cov, expected).select(*COV, "allele_len", F.round("ratio", 5).alias("ratio"))


@query("cm12_total_coverage_histogram", oracle("allele_cov", """SELECT CAST(floor(round(log10(total) / 0.01, 6)) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM totals), 6) AS share FROM totals GROUP BY 1""", [TOTALS]))
def _(v):
    totals = CV.person_totals(v.allele_cov)
    return CV.binned(totals, F.round(F.log10("total") / F.lit(0.01), 6), 1.0).withColumn("share", F.round("share", 6))


@query("cm12_mean_coverage_histogram", oracle("allele_cov", """SELECT CAST(floor(round(total / (SELECT COUNT(DISTINCT locus_id) FROM allele_cov) / 0.1, 6)) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM totals), 6) AS share FROM totals GROUP BY 1""", [TOTALS]))
def _(v):
    means = CV.person_means(v.allele_cov, v.allele_cov.select("locus_id").distinct().count())
    return CV.binned(means, F.round(F.col("mean_cov") / F.lit(0.1), 6), 1.0).withColumn("share", F.round("share", 6))
