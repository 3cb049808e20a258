"""Queries on Mendelian family scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import family as FM
from ..operators import genotype as G
from ..operators.cohort import ROLES
from ..registry import oracle, query
from .genotypes import start, start_posteriors
from .sql import START_EPS, family_ctes, posterior_ctes

VIEWS = "allele_cov expected person"
POST = posterior_ctes(START_EPS)
FAM = POST + family_ctes()
KEYS = ["locus_id", "family_id"]


def start_scores(v, most=None):
    return v.stored(f"start-scores-{most}", lambda: FM.family_scores(start_posteriors(v), v.person, most))


TRIPLES = """gp AS (SELECT n, a, b FROM (SELECT DISTINCT k + 1 AS n FROM kk), (SELECT unnest(range(1, (SELECT MAX(k) + 2 FROM kk))) AS a), (SELECT unnest(range(1, (SELECT MAX(k) + 2 FROM kk))) AS b) WHERE a <= b AND b <= n),
  tr AS (SELECT m.n, m.a AS m1, m.b AS m2, f.a AS f1, f.b AS f2, c.a AS c1, c.b AS c2 FROM gp m JOIN gp f USING (n) JOIN gp c USING (n) WHERE (c.a IN (m.a, m.b) AND c.b IN (f.a, f.b)) OR (c.b IN (m.a, m.b) AND c.a IN (f.a, f.b))),
  tp AS (SELECT n, COUNT(*) AS c FROM tr GROUP BY n)"""


@query("fm01_mendel_triples", oracle(VIEWS, "SELECT locus_id, CAST(c AS BIGINT) AS triples FROM kk JOIN tp ON tp.n = k + 1", POST + [TRIPLES]))
def _(v):
    _, model = start(v)
    return model.select("locus_id", F.size(FM.mendel_triples(F.col("k") + 1)).cast("long").alias("triples"))


@query("fm01_mendel_triple_rows", oracle(VIEWS, "SELECT CAST(n AS INT) AS n, " + ", ".join(f"CAST({x} AS INT) AS {x}" for x in ("m1", "m2", "f1", "f2", "c1", "c2")) + " FROM tr", POST + [TRIPLES]))
def _(v):
    _, model = start(v)
    counts = model.select((F.col("k") + 1).cast("int").alias("n")).distinct()
    return counts.select("n", F.explode(FM.mendel_triples(F.col("n"))).alias("t")).select("n", *[F.col(f"t.{x}").cast("int").alias(x) for x in ("m1", "m2", "f1", "f2", "c1", "c2")])


@query("fm02_candidate_genotypes", oracle(VIEWS, "SELECT locus_id, CAST((k + 1) * (k + 2) / 2 AS BIGINT) AS candidates FROM kk", POST))
def _(v):
    _, model = start(v)
    return model.select("locus_id", F.size(G.pair_list(F.col("k"))).cast("long").alias("candidates"))


@query("fm02_candidate_genotype_rows", oracle(VIEWS, "SELECT locus_id, CAST(a AS INT) AS r1, CAST(b AS INT) AS r2 FROM kk JOIN gp ON gp.n = k + 1", POST + [TRIPLES]))
def _(v):
    _, model = start(v)
    return model.select("locus_id", F.explode(G.pair_list(F.col("k"))).alias("p")).select("locus_id", F.col("p.r1").cast("int").alias("r1"), F.col("p.r2").cast("int").alias("r2"))


@query("fm03_trio_allele_order", oracle(VIEWS, "SELECT locus_id, family_id, child, string_agg(CAST(r AS VARCHAR), ',' ORDER BY pos) AS ranks FROM top GROUP BY locus_id, family_id, child", FAM))
def _(v):
    fam = FM.family_rows(start_posteriors(v), v.person).filter("mother IS NOT NULL AND father IS NOT NULL")
    trios = [fam.filter(F.col(c).isNotNull()).select(*KEYS, F.lit(c).alias("child"), F.array_join(FM.trio_alleles(c).cast("array<string>"), ",").alias("ranks")) for c in ("proband", "sibling")]
    return trios[0].union(trios[1])


@query("fm04_member_genotypes", oracle(VIEWS, "SELECT locus_id, family_id, " + ", ".join(f"{r}_{i}" for r in ROLES for i in (1, 2)) + " FROM fam", FAM))
def _(v):
    return FM.likely_alleles(FM.family_rows(start_posteriors(v), v.person)).select(*KEYS, *[f"{r}_{i}" for r in ROLES for i in (1, 2)])


@query("fm05_trio_probability", oracle(VIEWS, "SELECT locus_id, family_id, round(proband_trio, 6) AS proband_trio, round(sibling_trio, 6) AS sibling_trio FROM fam", FAM))
def _(v):
    fam = FM.likely_alleles(FM.family_rows(start_posteriors(v), v.person))
    return fam.select(*KEYS, F.round("proband_trio", 6).alias("proband_trio"), F.round("sibling_trio", 6).alias("sibling_trio"))


def _rounded(df, names):
    return df.select(*KEYS, *[F.round(n, 6).alias(n) for n in names])


@query("fm06_obedience", oracle(VIEWS, "SELECT locus_id, family_id, round(proband_obedience, 6) AS proband_obedience, round(sibling_obedience, 6) AS sibling_obedience FROM fam", FAM))
def _(v):
    return _rounded(start_scores(v), ["proband_obedience", "sibling_obedience"])


@query("fm06_obedience_six_alleles", oracle(VIEWS, "SELECT locus_id, family_id, round(proband_obedience, 6) AS proband_obedience, round(sibling_obedience, 6) AS sibling_obedience FROM fam", POST + family_ctes(6)))
def _(v):
    return _rounded(start_scores(v, 6), ["proband_obedience", "sibling_obedience"])


@query("fm06_obedience_all_alleles", oracle(VIEWS, "SELECT locus_id, family_id, round(proband_obedience, 6) AS proband_obedience, round(sibling_obedience, 6) AS sibling_obedience FROM fam", FAM))
def _(v):
    return _rounded(start_scores(v), ["proband_obedience", "sibling_obedience"])


@query("fm07_kinship", oracle(VIEWS, "SELECT locus_id, family_id, round(proband_kinship, 6) AS proband_kinship, round(sibling_kinship, 6) AS sibling_kinship FROM fam", FAM))
def _(v):
    return _rounded(start_scores(v), ["proband_kinship", "sibling_kinship"])


SCORES = ["proband_trio", "sibling_trio", "proband_obedience", "sibling_obedience", "proband_kinship", "sibling_kinship"]


@query("fm08_family_scores", oracle(VIEWS, "SELECT locus_id, family_id, " + ", ".join(f"{r}_{i}" for r in ROLES for i in (1, 2)) + ", " + ", ".join(f"round({s}, 6) AS {s}" for s in SCORES) + " FROM fam", FAM))
def _(v):
    return start_scores(v).select(*KEYS, *[f"{r}_{i}" for r in ROLES for i in (1, 2)], *[F.round(s, 6).alias(s) for s in SCORES])
