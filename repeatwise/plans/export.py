"""Queries on VCF columns and pipeline accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import accounting as AC
from ..operators import profile as P
from ..operators import vcf as V
from ..registry import oracle, query
from .genotypes import start_genotypes
from .profiles import PROFILE, TALLY
from .sql import start_calls

VIEWS = "allele_cov expected locus"
KEYS = ["locus_id", "person_id"]
SEQ = "substring(repeat(unit, CAST({n} AS BIGINT)), 1, CAST({n} AS BIGINT))"
CALLS = """gl AS MATERIALIZED (SELECT g.*, l.chrom, l.start, l.unit, l.ref_length, list_distinct(list_filter([allele_1, allele_2], lambda a: a > 0 AND a <> l.ref_length)) AS al0 FROM geno g JOIN locus l USING (locus_id)),
  gv AS MATERIALIZED (SELECT *, CASE WHEN len(al0) = 2 THEN [allele_1, allele_2] ELSE al0 END AS alts FROM gl)"""
GT = """CASE WHEN len(alts) = 0 THEN '0/0' ELSE (CASE WHEN allele_1 = ref_length THEN '0' WHEN allele_1 > 0 THEN CAST(list_position(alts, allele_1) AS VARCHAR) ELSE '-1' END) || '/' ||
  (CASE WHEN allele_2 = ref_length THEN '0' WHEN allele_2 > 0 THEN CAST(list_position(alts, allele_2) AS VARCHAR) ELSE '-1' END) END"""
ALT = f"CASE WHEN len(alts) = 0 THEN '.' ELSE array_to_string(list_transform(alts, lambda n: {SEQ.format(n='n')}), ',') END"
COUNTS = "lc AS (SELECT locus_id, COUNT(*) AS pop_count, SUM(t) AS sum_count, MAX(t) AS top_count FROM (SELECT locus_id, person_id, SUM(n) AS t FROM allele_cov GROUP BY ALL) GROUP BY locus_id)"
FULL = start_calls() + [CALLS, COUNTS]


def with_locus(v):
    return start_genotypes(v).join(v.locus, "locus_id")


def locus_counts(v):
    per = v.allele_cov.groupBy(*KEYS).agg(F.sum("n").alias("t"))
    return per.groupBy("locus_id").agg(F.count(F.lit(1)).alias("pop_count"), F.sum("t").alias("sum_count"), F.max("t").alias("top_count"))


@query("vc01_reference_sequence", oracle("locus", f"SELECT locus_id, {SEQ.format(n='ref_length')} AS ref FROM locus"))
def _(v):
    return v.locus.select("locus_id", S.tract_sequence(F.col("unit"), F.col("ref_length")).alias("ref"))


@query("vc02_alt", oracle(VIEWS, f"SELECT locus_id, person_id, {ALT} AS alt FROM gv", FULL))
def _(v):
    return with_locus(v).select(*KEYS, V.alt_text().alias("alt"))


@query("vc03_genotype_index", oracle(VIEWS, f"SELECT locus_id, person_id, {GT} AS gt, allele_1 || '/' || allele_2 AS gb FROM gv", FULL))
def _(v):
    return with_locus(v).select(*KEYS, V.genotype_index().alias("gt"), V.base_pair_genotype().alias("gb"))


@query("vc04_quality", oracle(VIEWS, "SELECT locus_id, person_id, round(CASE WHEN 1 - round(confidence, 6) > 0 THEN -10 * log10(1 - round(confidence, 6)) ELSE 100 END, 4) AS qual FROM gv", FULL))
def _(v):
    # confidence to 6 places, so that the last bits of a sum do not decide between 99 and 100
    return with_locus(v).withColumn("confidence", F.round("confidence", 6)).select(*KEYS, F.round(V.quality(), 4).alias("qual"))


INFO = "'END=' || (start + ref_length - 1) || ';RL=' || ref_length || ';RU=' || unit || ';POP=' || pop_count || ';SUM=' || sum_count || ';TOP=' || top_count || ';NR=' || CAST(CAST(round(log10(eps), 2) AS DECIMAL(20, 2)) AS VARCHAR)"


@query("vc05_info", oracle(VIEWS, f"SELECT DISTINCT locus_id, {INFO} AS info FROM gv JOIN lc USING (locus_id)", FULL))
def _(v):
    return with_locus(v).select("locus_id", "start", "ref_length", "unit", "eps").distinct().join(locus_counts(v), "locus_id").select("locus_id", V.info_text().alias("info"))


SEEN = "array_to_string(CASE WHEN allele_1 = allele_2 THEN list_filter([allele_1], lambda a: a > 0) ELSE list_filter([allele_1, allele_2], lambda a: a > 0) END, ',')"


def _dec(x):
    return f"CAST(CAST(round({x}, 3) AS DECIMAL(20, 3)) AS VARCHAR)"


SAMPLE = (
    f"{GT} || ':' || allele_1 || '/' || allele_2 || ':' || {_dec('confidence')} || ':' || {_dec('exp_allele_cov')} || ':' || {_dec('allele_fit')} || ':' || {_dec('noise_fit')} || ':' || allele_1_cov || ':' || allele_2_cov || ':' || rest_cov"
    f" || ':' || CASE WHEN p_null > 0 THEN {_dec('-10 * log10(p_null)')} ELSE 'inf' END || ':' || (allele_1_cov + allele_2_cov + rest_cov) || ':' || {SEEN}"
)


@query("vc06_sample_values", oracle(VIEWS, f"SELECT locus_id, person_id, {SAMPLE} AS sample FROM gv", FULL))
def _(v):
    return with_locus(v).select(*KEYS, V.sample_text().alias("sample"))


@query("vc07_depth_and_seen", oracle(VIEWS, f"SELECT locus_id, person_id, CAST(allele_1_cov + allele_2_cov + rest_cov AS BIGINT) AS depth, {SEEN} AS seen FROM gv", FULL))
def _(v):
    return with_locus(v).select(*KEYS, V.depth().alias("depth"), V.seen().alias("seen"))


FIELD_ROWS = ", ".join(f"('INFO', '{i}', '{t}')" for i, _, t, _ in V.INFO_FIELDS) + ", " + ", ".join(f"('FORMAT', '{i}', '{t}')" for i, _, t, _ in V.FORMAT_FIELDS)


@query("vc08_header_fields", oracle(VIEWS, f"SELECT chrom, kind, id, type, CAST(COUNT(*) AS BIGINT) AS records FROM gv, (VALUES {FIELD_ROWS}) f(kind, id, type) GROUP BY ALL", FULL))
def _(v):
    fields = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("id"), F.lit(t).alias("type")) for k, fs in (("INFO", V.INFO_FIELDS), ("FORMAT", V.FORMAT_FIELDS)) for i, _, t, _ in fs])
    per_chrom = with_locus(v).groupBy("chrom").agg(F.count(F.lit(1)).alias("records"))
    return per_chrom.select("chrom", "records", F.explode(fields).alias("f")).select("chrom", "f.kind", "f.id", "f.type", "records")


@query("vc09_person_calls", oracle(VIEWS, f"SELECT locus_id, person_id, chrom, start AS pos, {SEQ.format(n='ref_length')} AS ref, {ALT} AS alt, {INFO} AS info, {SAMPLE} AS sample FROM gv JOIN lc USING (locus_id)", FULL))
def _(v):
    return V.records(start_genotypes(v), v.locus, locus_counts(v)).select(*KEYS, "chrom", "pos", "ref", "alt", "info", "sample")


STAGES = ["click", "error", "purchase", "signup", "view"]
IN_OUT = ", ".join(f"CAST(SUM(CASE WHEN stage = '{s}' THEN n_{d} ELSE 0 END) AS BIGINT) AS {s}_{d}" for s in STAGES for d in ("in", "out"))


@query("pc01_stage_counts", oracle("stage_count", f"SELECT person_id, {IN_OUT} FROM stage_count GROUP BY person_id"))
def _(v):
    return AC.in_out_by_person(v.stage_count, STAGES)


# the thirteen columns of the counter report (fixed names and order)
OUTCOMES = {
    "ReadsIn": "reads_in", "DiscordantOverlappingReadFragment": "discordantOverlappingReadFragment", "DisparateCoord": "disparateCoord", "HasMS": "hasMS",
    "LowCoverage": "lowCoverage", "LowMapQ": "lowMapQ", "MsInPCRDuplicates": "msInPCRDuplicates", "NonReference": "nonReference",
    "OverlappingReadFragment": "overlappingReadFragment", "Reported": "reported", "Unmapped": "unmapped", "WrongUnit": "wrongUnit", "ReadsOut": "reads_out",
}


@query("pc02_outcome_report", oracle("obs ref_tract", "SELECT person_id, " + ", ".join(f'CAST("{old}" AS BIGINT) AS {new}' for new, old in OUTCOMES.items()) + f" FROM ({TALLY})", PROFILE))
def _(v):
    counts = P.outcome_counts(v.obs, v.ref_tract)
    return counts.select("person_id", *[F.col(old).cast("long").alias(new) for new, old in OUTCOMES.items()])


@query("pc04_error_scan", oracle("person", """SELECT p.person_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_errors, CASE WHEN n IS NULL THEN 'No errors' ELSE 'ERRORS' END AS status FROM person p
  LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM events WHERE contains(event_type || ' ' || props, 'rror') GROUP BY user_id) e ON e.user_id = p.person_id"""))
def _(v):
    lines = v.events.select(F.col("user_id").alias("person_id"), F.concat_ws(" ", "event_type", "props").alias("line"))
    return AC.error_scan(v.person, lines)


@query("pc05_stage_consistency", oracle("stage_count", f"""SELECT person_id, {' AND '.join(f'{s}_out <= {s}_in' for s in STAGES)} AS shrinks, {' AND '.join(f'{b}_in = {a}_out' for a, b in zip(STAGES, STAGES[1:]))} AS chained FROM w""", [f"w AS (SELECT person_id, {IN_OUT} FROM stage_count GROUP BY person_id)"]))
def _(v):
    return AC.stage_consistency(AC.in_out_by_person(v.stage_count, STAGES), STAGES)


@query("io34_stage_counters", oracle("stage_count", "SELECT stage, CAST(SUM(n_in) AS BIGINT) AS n_in, CAST(SUM(n_out) AS BIGINT) AS n_out FROM stage_count GROUP BY stage"))
def _(v):
    return v.stage_count.groupBy("stage").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
