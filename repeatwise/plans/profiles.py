"""Queries on per-person profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..operators import accounting as AC
from ..operators import profile as P
from ..operators import tracts as TR
from ..registry import oracle, query
from .sql import tract_ctes
from .tracts import ID, carried

KEY = "person_id, chrom, start, motif"
GOOD = "good AS (SELECT * FROM obs WHERE mapped AND mapq >= 30 AND NOT mate_elsewhere AND regexp_full_match(motif, '[ACGT]+'))"
ONE = f"""one AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, MIN(length) OVER p AS lo, MAX(length) OVER p AS hi, COUNT(*) OVER p AS reads FROM good
  WINDOW w AS (PARTITION BY {KEY}, read_name ORDER BY obs_id), p AS (PARTITION BY {KEY}, read_name)) WHERE rn = 1)"""
MERGED = f"""merged AS (SELECT * FROM one WHERE lo = hi), depth AS (SELECT {KEY}, COUNT(*) AS c FROM one GROUP BY {KEY}),
  covered AS (SELECT m.* FROM merged m JOIN depth USING ({KEY}) WHERE c >= 2),
  located AS (SELECT c.*, COALESCE(r.length, 0) AS ref_length FROM covered c LEFT JOIN ref_tract r ON c.chrom = r.chrom AND c.start = r.start WHERE r.unit IS NULL OR r.unit = c.motif)"""
SETS = f"""ends AS (SELECT *, least(pos, mate_pos) AS lo_pos, greatest(pos, mate_pos) AS hi_pos FROM located),
  sized AS (SELECT *, COUNT(*) OVER s AS size, bool_or(is_dup) OVER s AS flagged,
    MIN(length) OVER s = MAX(length) OVER s AS one_length,
    row_number() OVER (PARTITION BY {KEY}, lo_pos, hi_pos ORDER BY is_dup, CASE WHEN is_dup THEN 0 ELSE -mapq END, obs_id) AS rep
    FROM ends WINDOW s AS (PARTITION BY {KEY}, lo_pos, hi_pos)),
  kept AS (SELECT * FROM sized WHERE NOT (flagged AND size > 1) OR (one_length AND rep = 1)),
  prof AS (SELECT {KEY}, length, ref_length, n FROM (SELECT *, SUM(n) OVER (PARTITION BY {KEY}) AS total FROM
    (SELECT {KEY}, length, MAX(ref_length) AS ref_length, COUNT(*) AS n FROM kept GROUP BY {KEY}, length)) WHERE total > 1)"""
PROFILE = [GOOD, ONE, MERGED, SETS]


def located(v):
    """Usable, mate-merged, covered observations with their reference length."""
    good = P.usable(v.obs)
    return P.with_reference(P.covered(P.merge_mates(good, "flank"), good), v.ref_tract)


def profiles(v):
    """Long profile of all people with reference length."""
    rows = P.profile(located(v))
    return P.with_reference(rows, v.ref_tract).select(*P.KEY, "length", "n", "ref_length")


@query("pr01_fate", oracle("obs", r"""SELECT CASE WHEN NOT mapped THEN 'unmapped' WHEN mapq < 30 THEN 'lowMapQ' WHEN mate_elsewhere THEN 'disparateCoord'
  WHEN NOT regexp_full_match(motif, '[ACGT]+') THEN 'badUnit' ELSE 'kept' END AS fate, CAST(COUNT(*) AS BIGINT) AS n FROM obs GROUP BY 1"""))
def _(v):
    return v.obs.groupBy(P.fate().alias("fate")).agg(F.count(F.lit(1)).alias("n"))


@query("pr02_usable_observations", oracle("obs", "SELECT obs_id, person_id, motif, length FROM good", [GOOD]))
def _(v):
    return P.usable(v.obs).select("obs_id", "person_id", "motif", "length")


@query("pr03_locus_groups", oracle("obs", f"SELECT {KEY}, CAST(COUNT(*) AS BIGINT) AS n FROM good GROUP BY {KEY}", [GOOD]))
def _(v):
    return P.usable(v.obs).groupBy(*P.KEY).agg(F.count(F.lit(1)).alias("n"))


@query("pr04_merge_mates", oracle("obs", f"SELECT {KEY}, read_name, obs_id, length FROM one WHERE lo = hi", [GOOD, ONE]))
def _(v):
    return P.merge_mates(P.usable(v.obs)).select(*P.KEY, "read_name", "obs_id", "length")


@query("io17_discordant_mates", oracle("obs", f"SELECT g.obs_id, g.read_name, g.length FROM good g JOIN one o USING ({KEY}, read_name) WHERE o.lo <> o.hi", [GOOD, ONE]))
def _(v):
    return P.discordant_mates(P.usable(v.obs)).select("obs_id", "read_name", "length")


@query("pr05_bare_name", oracle("obs", "SELECT CAST(read_name AS VARCHAR) AS bare_name, CAST(COUNT(*) AS BIGINT) AS n FROM obs GROUP BY 1"))
def _(v):
    name = F.concat_ws("|", F.col("read_name").cast("string"), F.concat_ws(":", "motif", F.col("length").cast("string")))
    return v.obs.select(F.substring_index(name, "|", 1).alias("bare_name")).groupBy("bare_name").agg(F.count(F.lit(1)).alias("n"))


@query("pr06_covered_loci", oracle("obs ref_tract", f"SELECT {KEY}, obs_id FROM covered", [GOOD, ONE, MERGED]))
def _(v):
    good = P.usable(v.obs)
    return P.covered(P.merge_mates(good), good).select(*P.KEY, "obs_id")


@query("pr07_reference_lookup", oracle("obs ref_tract", f"SELECT {KEY}, obs_id, ref_length FROM located", [GOOD, ONE, MERGED]))
def _(v):
    return located(v).select(*P.KEY, "obs_id", "ref_length")


@query("pr08_duplicate_sets", oracle("obs ref_tract", f"""SELECT {KEY}, lo_pos, hi_pos, CAST(COUNT(*) AS BIGINT) AS size, bool_or(is_dup) AS flagged, CAST(COUNT(DISTINCT length) AS BIGINT) AS n_lengths
  FROM ends GROUP BY {KEY}, lo_pos, hi_pos HAVING bool_or(is_dup) AND COUNT(*) > 1""", PROFILE))
def _(v):
    return P.set_summary(P.duplicate_sets(located(v))).filter("active").drop("active")


@query("pr09_representatives", oracle("obs ref_tract", f"SELECT {KEY}, obs_id, length FROM kept", PROFILE))
def _(v):
    return P.dedup_reads(located(v)).select(*P.KEY, "obs_id", "length")


@query("pr10_keep_duplicates", oracle("obs ref_tract", f"""SELECT {KEY}, length, CAST(n AS BIGINT) AS n FROM (SELECT *, SUM(n) OVER (PARTITION BY {KEY}) AS total FROM
  (SELECT {KEY}, length, COUNT(*) AS n FROM located GROUP BY {KEY}, length)) WHERE total > 1""", PROFILE))
def _(v):
    return P.profile(located(v), keep_duplicates=True)


@query("pr11_profile", oracle("obs ref_tract", f"SELECT {KEY}, length, CAST(n AS BIGINT) AS n, ref_length FROM prof", PROFILE))
def _(v):
    return profiles(v)


@query("pr12_histogram", oracle("obs ref_tract", f"""SELECT {KEY}, MAX(length) AS longest, array_to_string(list_transform(range(1, MAX(length) + 1),
  lambda i: COALESCE(list_sum(list_transform(list({{'l': length, 'n': n}}), lambda x: CASE WHEN x.l = i THEN CAST(x.n AS BIGINT) ELSE 0 END)), 0)), ',') AS histogram FROM prof GROUP BY {KEY}""", PROFILE))
def _(v):
    return P.histograms(profiles(v), P.KEY)


@query("pr13_modal_length", oracle("obs ref_tract", f"SELECT {KEY}, length AS mode FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY n DESC, length) AS rk FROM prof) WHERE rk = 1", PROFILE))
def _(v):
    return P.modal_length(profiles(v), P.KEY)


DUPS = f"""modes AS (SELECT {KEY}, length AS mode FROM (SELECT {KEY}, length, row_number() OVER (PARTITION BY {KEY} ORDER BY COUNT(*) DESC, length) AS rk FROM located GROUP BY {KEY}, length) WHERE rk = 1),
  setlen AS (SELECT {KEY}, lo_pos, hi_pos, length, COUNT(*) AS n, bool_or(is_dup) AS d, MAX(ref_length) AS ref_length FROM ends GROUP BY {KEY}, lo_pos, hi_pos, length),
  dups AS (SELECT {KEY}, length(motif) AS motif_length, MAX(ref_length) AS ref_length, lo_pos, hi_pos, round((SUM(n) - MAX(n)) / SUM(n), 6) AS off_mode_share, CAST(SUM(n) AS BIGINT) AS size,
    array_to_string(list_transform(range(1, MAX(length) + 1), lambda i: list_sum(list_transform(list({{'l': length, 'n': n}}), lambda x: CASE WHEN x.l = i THEN CAST(x.n AS BIGINT) ELSE 0 END))), ',') AS histogram
    FROM setlen GROUP BY {KEY}, lo_pos, hi_pos HAVING bool_or(d) AND SUM(n) > 1)"""


@query("pr14_duplicate_statistics", oracle("obs ref_tract", f"SELECT d.*, m.mode AS profile_mode FROM dups d LEFT JOIN modes m USING ({KEY})", PROFILE + [DUPS]))
def _(v):
    report = P.duplicate_report(located(v).drop("ref_length"), v.ref_tract)
    return report.withColumn("off_mode_share", F.round("off_mode_share", 6))


@query("pc03_replicate_counts", oracle("obs ref_tract", """SELECT person_id, CAST(COUNT(*) AS BIGINT) AS sets, CAST(COUNT(*) FILTER (off_mode_share > 0) AS BIGINT) AS discordant,
  CAST(COUNT(*) FILTER (size = 2) AS BIGINT) AS pairs FROM dups GROUP BY person_id""", PROFILE + [DUPS]))
def _(v):
    return AC.replicate_counts(P.duplicate_report(located(v).drop("ref_length"), v.ref_tract))


@query("pr15_flank_haplotype", oracle("reads", """SELECT read_id, mate, CAST(start AS BIGINT) AS start, lpad(substring(seq, CAST(greatest(start - 5, 1) AS BIGINT), CAST(least(start - 1, 5) AS BIGINT)), 5, '#')
  || rpad(substring(seq, CAST(stop + 1 AS BIGINT), 5), 5, '#') AS flank FROM tracts JOIN reads USING (read_id, mate)""", tract_ctes("reads", "read_id, mate")))
def _(v):
    t = TR.each_tract(carried(v))
    return t.select(*ID, "start", P.flank_haplotype(t, "seq").alias("flank"))


FLANKS = f"""fl AS (SELECT {KEY}, flank, COUNT(*) AS c FROM kept GROUP BY {KEY}, flank)"""


@query("pr16_flank_counts", oracle("obs ref_tract", f"SELECT {KEY}, CAST(COUNT(*) AS BIGINT) AS num_flanks FROM fl GROUP BY {KEY}", PROFILE + [FLANKS]))
def _(v):
    return P.dedup_reads(located(v)).groupBy(*P.KEY, "flank").agg(F.count(F.lit(1)).alias("c")).groupBy(*P.KEY).agg(F.count(F.lit(1)).alias("num_flanks"))


@query("pr17_flank_rank", oracle("obs ref_tract", f"""SELECT {KEY}, flank, CAST(c AS BIGINT) AS flank_count, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY c DESC, flank DESC) AS BIGINT) AS "rank" FROM fl""", PROFILE + [FLANKS]))
def _(v):
    return P.flank_table(P.dedup_reads(located(v))).filter("rank > 0").select(*P.KEY, "flank", "flank_count", "rank")


FLANK_ROWS = f"""cells AS (SELECT {KEY}, flank, length, COUNT(*) AS n FROM kept GROUP BY {KEY}, flank, length UNION ALL SELECT {KEY}, 'all', length, COUNT(*) FROM kept GROUP BY {KEY}, length),
  span AS (SELECT {KEY}, MAX(length) AS top, COUNT(DISTINCT flank) - 1 AS num_flanks FROM cells GROUP BY {KEY}),
  flank_rows AS (SELECT {KEY}, flank, CAST(SUM(n) AS BIGINT) AS flank_count, CAST(ANY_VALUE(num_flanks) AS BIGINT) AS num_flanks,
    CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN flank = 'all' THEN 0 ELSE 1 END, SUM(n) DESC, flank DESC) - 1 AS BIGINT) AS "rank",
    array_to_string(list_transform(range(1, ANY_VALUE(top) + 1), lambda i: list_sum(list_transform(list({{'l': length, 'n': n}}), lambda x: CASE WHEN x.l = i THEN CAST(x.n AS BIGINT) ELSE 0 END))), ',') AS histogram
    FROM cells JOIN span USING ({KEY}) GROUP BY {KEY}, flank)"""


@query("pr18_flank_histogram", oracle("obs ref_tract", f"""SELECT {KEY}, flank, histogram FROM flank_rows WHERE "rank" > 0""", PROFILE + [FLANK_ROWS]))
def _(v):
    return P.flank_table(P.dedup_reads(located(v))).filter("rank > 0").select(*P.KEY, "flank", "histogram")


@query("pr19_profile_rows", oracle("obs ref_tract", "SELECT * FROM flank_rows", PROFILE + [FLANK_ROWS]))
def _(v):
    return P.flank_table(P.dedup_reads(located(v)))


@query("pr20_read_names", oracle("obs ref_tract", f"SELECT {KEY}, 0 AS part, string_agg(CAST(read_name AS VARCHAR), ',' ORDER BY CAST(read_name AS VARCHAR)) AS names FROM kept GROUP BY {KEY}", PROFILE))
def _(v):
    return P.read_names(P.dedup_reads(located(v)), P.KEY)


@query("pr21_genome_order", oracle("obs", """SELECT chrom, start, motif, CAST(row_number() OVER (ORDER BY CAST(replace(chrom, 'chr', '') AS INT), start, length(motif), motif) - 1 AS BIGINT) AS place
  FROM (SELECT DISTINCT chrom, start, motif FROM good)""", [GOOD]))
def _(v):
    loci = P.usable(v.obs).select("chrom", "start", "motif").distinct()
    keyed = loci.withColumn("c", P.chrom_number(F.col("chrom"))).withColumn("ml", F.length("motif"))
    return number_rows(keyed, ["c", "start", "ml", "motif"], "place").select("chrom", "start", "motif", "place")


@query("pr22_chromosome_number", oracle("obs", """SELECT chrom, CASE chrom WHEN 'chrX' THEN 23 WHEN 'chrY' THEN 24 WHEN 'chrMT' THEN 25 ELSE CAST(replace(chrom, 'chr', '') AS INT) END AS number, CAST(COUNT(*) AS BIGINT) AS n
  FROM (SELECT CASE WHEN chrom = 'chr22' THEN 'chrX' WHEN chrom = 'chr21' THEN 'chrY' WHEN chrom = 'chr20' THEN 'chrMT' ELSE chrom END AS chrom FROM obs) GROUP BY 1, 2"""))
def _(v):
    chrom = F.when(F.col("chrom") == "chr22", "chrX").when(F.col("chrom") == "chr21", "chrY").when(F.col("chrom") == "chr20", "chrMT").otherwise(F.col("chrom"))
    return v.obs.select(chrom.alias("chrom")).groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).withColumn("number", P.chrom_number(F.col("chrom")))


TALLY = f"""SELECT r.*, COALESCE(m.a, 0) AS "overlappingReadFragment", COALESCE(m.b, 0) AS "discordantOverlappingReadFragment", COALESCE(l.lc, 0) AS "lowCoverage", COALESCE(l.nr, 0) AS "nonReference",
  COALESCE(l.wu, 0) AS "wrongUnit", COALESCE(d.size, 0) AS "msInPCRDuplicates", COALESCE(p.loci, 0) AS reported, COALESCE(p.n, 0) AS reads_out FROM
  (SELECT person_id, CAST(COUNT(*) AS BIGINT) AS reads_in, CAST(COUNT(*) FILTER (f = 1) AS BIGINT) AS unmapped, CAST(COUNT(*) FILTER (f = 2) AS BIGINT) AS "lowMapQ",
    CAST(COUNT(*) FILTER (f = 3) AS BIGINT) AS "disparateCoord", CAST(COUNT(*) FILTER (f = 4) AS BIGINT) AS "badUnit", CAST(COUNT(*) FILTER (f = 5) AS BIGINT) AS kept, CAST(COUNT(*) FILTER (f >= 4) AS BIGINT) AS "hasMS"
    FROM (SELECT person_id, CASE WHEN NOT mapped THEN 1 WHEN mapq < 30 THEN 2 WHEN mate_elsewhere THEN 3 WHEN NOT regexp_full_match(motif, '[ACGT]+') THEN 4 ELSE 5 END AS f FROM obs) GROUP BY person_id) r
  LEFT JOIN (SELECT person_id, CAST(SUM(CASE WHEN lo = hi THEN reads - 1 ELSE 0 END) AS BIGINT) AS a, CAST(SUM(CASE WHEN lo <> hi THEN reads - 1 ELSE 0 END) AS BIGINT) AS b FROM one GROUP BY person_id) m USING (person_id)
  LEFT JOIN (SELECT person_id, CAST(COUNT(*) FILTER (c < 2) AS BIGINT) AS lc, CAST(COUNT(*) FILTER (c >= 2 AND t.unit IS NULL) AS BIGINT) AS nr, CAST(COUNT(*) FILTER (c >= 2 AND t.unit <> motif) AS BIGINT) AS wu
    FROM depth LEFT JOIN ref_tract t ON depth.chrom = t.chrom AND depth.start = t.start GROUP BY person_id) l USING (person_id)
  LEFT JOIN (SELECT person_id, CAST(COUNT(*) AS BIGINT) AS size FROM sized WHERE flagged AND size > 1 GROUP BY person_id) d USING (person_id)
  LEFT JOIN (SELECT person_id, CAST(COUNT(DISTINCT (chrom, start, motif)) AS BIGINT) AS loci, CAST(SUM(n) AS BIGINT) AS n FROM prof GROUP BY person_id) p USING (person_id)"""


@query("pr23_outcome_counts", oracle("obs ref_tract", TALLY, PROFILE))
def _(v):
    return P.outcome_counts(v.obs, v.ref_tract)
