"""Queries on read preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import reads as R
from ..operators import tracts as TR
from ..registry import oracle, query
from .sql import tract_ctes

ID = ["read_id", "mate"]
# one row per base quality, and the kept length of each trim style, as plain SQL
QUALS = """q AS (SELECT read_id, mate, length(qual) AS n, unnest(range(1, length(qual) + 1)) AS i,
  ascii(unnest(string_split(qual, ''))) - 33 AS v FROM reads)"""
AREA = """walk AS (SELECT read_id, mate, n, i, SUM(20 - v) OVER (PARTITION BY read_id, mate ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS area FROM q),
  lived AS (SELECT *, MAX(CASE WHEN area < 0 THEN i ELSE 0 END) OVER (PARTITION BY read_id, mate) AS stop_at FROM walk),
  best AS (SELECT read_id, mate, n, MAX(CASE WHEN i > stop_at AND area > 0 THEN area END) AS top FROM lived GROUP BY ALL),
  kept AS (SELECT b.read_id, b.mate, COALESCE(MAX(l.i) - 1, b.n) AS kept FROM best b
    LEFT JOIN lived l ON l.read_id = b.read_id AND l.mate = b.mate AND l.i > l.stop_at AND l.area = b.top GROUP BY b.read_id, b.mate, b.n)"""
GATE = """gated AS (SELECT r.read_id, r.mate, r.seq, r.qual, kept, length(r.seq) - length(replace(r.seq, 'N', '')) AS n_count
  FROM reads r JOIN kept USING (read_id, mate))"""


@query("rp01_trim_barcode", oracle("reads", """SELECT read_id, mate, CASE WHEN length(seq) > 6 THEN substring(seq, 7) ELSE 'N' END AS seq,
  CASE WHEN length(seq) > 6 THEN substring(qual, 7) ELSE '#' END AS qual, CASE WHEN length(seq) > 6 THEN length(seq) - 6 ELSE 0 END AS usable FROM reads"""))
def _(v):
    return R.trim_barcode(v.reads, 6).select(*ID, "seq", "qual", "usable")


@query("rp02_solexa_recode", oracle("", """SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), ''),
  lambda c: chr(CAST(trunc(-10 * log10(1 / (pow(10, (ascii(c) - 64) / 10.0) + 1)) + 33) AS INT))), '') AS qual FROM documents
  WHERE regexp_matches(lower(text), '[a-z]')"""))
def _(v):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return v.documents.select("doc_id", letters.alias("raw")).filter(F.length("raw") > 0).select("doc_id", S.solexa_to_sanger(F.col("raw")).alias("qual"))


def _trimmed(v, style):
    return R.trim(v.reads, style).select(*ID, "kept", "seq", "qual")


@query("rp03_trim_area", oracle("reads", "SELECT read_id, mate, kept, substring(seq, 1, kept) AS seq, substring(qual, 1, kept) AS qual FROM reads JOIN kept USING (read_id, mate)", [QUALS, AREA]))
def _(v):
    return _trimmed(v, "area")


FIRST_BAD = "kept AS (SELECT read_id, mate, COALESCE(MIN(CASE WHEN v < 20 THEN i END) - 1, MAX(n)) AS kept FROM q GROUP BY read_id, mate)"
LAST_GOOD = "kept AS (SELECT read_id, mate, COALESCE(MAX(CASE WHEN v >= 20 THEN i END), 0) AS kept FROM q GROUP BY read_id, mate)"
PLAIN = "SELECT read_id, mate, kept, substring(seq, 1, kept) AS seq, substring(qual, 1, kept) AS qual FROM reads JOIN kept USING (read_id, mate)"


@query("rp04_trim_first_bad", oracle("reads", PLAIN, [QUALS, FIRST_BAD]))
def _(v):
    return _trimmed(v, "first_bad")


@query("rp05_trim_last_good", oracle("reads", PLAIN, [QUALS, LAST_GOOD]))
def _(v):
    return _trimmed(v, "last_good")


@query("rp06_trim_styles", oracle("reads", f"""SELECT style, CAST(SUM(kept) AS BIGINT) AS kept, CAST(COUNT(*) AS BIGINT) AS n_reads FROM (
  SELECT 'area' AS style, kept FROM kept UNION ALL SELECT 'none', length(qual) FROM reads
  UNION ALL SELECT 'first_bad', k FROM (SELECT COALESCE(MIN(CASE WHEN v < 20 THEN i END) - 1, MAX(n)) AS k FROM q GROUP BY read_id, mate)
  UNION ALL SELECT 'last_good', k FROM (SELECT COALESCE(MAX(CASE WHEN v >= 20 THEN i END), 0) AS k FROM q GROUP BY read_id, mate)) GROUP BY style""", [QUALS, AREA]))
def _(v):
    # one scan: the four results are columns of the same row, unpivoted after the aggregate
    styles = ["none", "area", "first_bad", "last_good"]
    sums = v.reads.agg(F.count(F.lit(1)).alias("n_reads"), *[F.sum(R.kept_length(F.col("qual"), s)).alias(s) for s in styles])
    return sums.unpivot("n_reads", styles, "style", "kept")


@query("rp07_count_n", oracle("reads", "SELECT read_id, mate, CAST(length(seq) - length(replace(seq, 'N', '')) AS BIGINT) AS n_count FROM reads"))
def _(v):
    return v.reads.select(*ID, S.count_char(F.col("seq"), "N").cast("long").alias("n_count"))


@query("rp08_detection_gate", oracle("reads", "SELECT read_id, mate, kept, n_count, kept >= 10 AND n_count < 3 AS detect FROM gated", [QUALS, AREA, GATE]))
def _(v):
    return R.detect_gate(R.trim(v.reads, "area")).select(*ID, "kept", "n_count", "detect")


@query("rp09_filter_gate", oracle("reads", """SELECT lang, CAST(COUNT(*) FILTER (passed) AS BIGINT) AS single, CAST(COUNT(*) FILTER (both_ok) AS BIGINT) AS paired
  FROM (SELECT lang, passed, bool_and(passed) OVER (PARTITION BY read_id) AS both_ok FROM reads) GROUP BY lang"""))
def _(v):
    reads = v.reads.select("read_id", "lang", "passed")
    single = R.passed_reads(reads, paired=False).groupBy("lang").agg(F.count(F.lit(1)).alias("single"))
    paired = R.passed_reads(reads, paired=True).groupBy("lang").agg(F.count(F.lit(1)).alias("paired"))
    langs = reads.select("lang").distinct()
    return langs.join(single, "lang", "left").join(paired, "lang", "left").na.fill(0)


@query("rp10_reads_with_tracts", oracle("reads", "SELECT read_id, mate FROM reads WHERE read_id IN (SELECT read_id FROM tracts)", tract_ctes("reads", "read_id, mate")))
def _(v):
    return R.with_tract_only(TR.carry_tracts(v.reads)).select(*ID)


@query("rp11_guess_encoding", oracle("reads", r"""SELECT file, CASE WHEN bool_or(regexp_matches(qual, '[!-:]')) THEN 'phred33'
  WHEN bool_or(regexp_matches(qual, '[K-h]')) THEN 'phred64' ELSE 'unknown' END AS encoding
  FROM (SELECT lang AS file, qual FROM reads) GROUP BY file"""))
def _(v):
    return R.guess_encoding(v.reads.withColumnRenamed("lang", "file"))


@query("rp12_validate_fastq", oracle("reads", r"""SELECT lang AS file, CAST(COUNT(*) AS BIGINT) AS records, CAST(COUNT(*) FILTER (mate = 2 AND k > 50) AS BIGINT) AS bad_header,
  CAST(COUNT(*) FILTER (NOT regexp_full_match(CASE WHEN passed THEN seq ELSE lower(seq) END, '[ACGTN]+')) AS BIGINT) AS bad_sequence,
  CAST(COUNT(*) FILTER (NOT passed) AS BIGINT) AS bad_separator, CAST(0 AS BIGINT) AS incomplete FROM reads GROUP BY lang"""))
def _(v):
    r = v.reads
    raw = r.select(
        F.col("lang").alias("file"), F.concat(F.when((F.col("mate") == 2) & (F.col("k") > 50), ">").otherwise("@"), F.col("read_id").cast("string")).alias("l1"),
        F.when(F.col("passed"), F.col("seq")).otherwise(F.lower("seq")).alias("l2"), F.when(F.col("passed"), "+").otherwise("-").alias("l3"), F.col("qual").alias("l4"),
    )
    return R.validate_fastq(raw)


@query("rp13_length_mismatch", oracle("", """SELECT doc_id, length(s) AS n_seq, length(q) AS n_qual FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s,
  regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS q FROM documents) WHERE length(s) <> length(q)"""))
def _(v):
    d = v.documents.select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("seq"), F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("qual"))
    return R.length_mismatches(d).select("doc_id", F.length("seq").alias("n_seq"), F.length("qual").alias("n_qual"))


@query("rp14_tallies", oracle("reads", """SELECT CAST(COUNT(*) AS BIGINT) AS reads_in, CAST(SUM(length(seq) - kept) AS BIGINT) AS trimmed_bases,
  CAST(COUNT(*) FILTER (kept < 10) AS BIGINT) AS too_short, CAST(COUNT(*) FILTER (kept >= 10 AND n_count >= 3) AS BIGINT) AS too_many_n,
  CAST(COUNT(*) FILTER (kept >= 10 AND n_count < 3) AS BIGINT) AS submitted FROM gated""", [QUALS, AREA, GATE]))
def _(v):
    return R.tallies(R.detect_gate(R.trim(v.reads, "area")))


@query("io04_paired_reads", oracle("reads", """SELECT a.read_id, a.seq AS seq_1, b.seq AS seq_2 FROM reads a JOIN reads b ON a.read_id = b.read_id AND a.mate = 1 AND b.mate = 2
  WHERE a.passed AND b.passed"""))
def _(v):
    return R.pairs(R.passed_reads(v.reads, paired=True), ["seq"])


@query("io05_mate_violations", oracle("reads", """SELECT read_id, CAST(COUNT(*) FILTER (mate = 1) AS BIGINT) AS firsts, CAST(COUNT(*) FILTER (mate = 2) AS BIGINT) AS seconds
  FROM reads GROUP BY read_id HAVING COUNT(*) FILTER (mate = 1) <> 1 OR COUNT(*) FILTER (mate = 2) <> 1"""))
def _(v):
    return R.mate_violations(v.reads)


@query("io03_header_parse", oracle("reads", "SELECT CAST(read_id AS VARCHAR) AS name, mate, passed, CAST(COUNT(*) AS BIGINT) AS n FROM reads GROUP BY ALL"))
def _(v):
    plain = F.concat_ws("/", F.col("read_id").cast("string"), F.col("mate").cast("string"))
    spaced = F.concat(F.col("read_id").cast("string"), F.lit(" "), F.col("mate").cast("string"), F.lit(":"), F.when(F.col("passed"), "N").otherwise("Y"), F.lit(":0:ACGT"))
    header = F.when(F.col("passed") & (F.col("k") > 10), plain).otherwise(spaced)
    h = v.reads.select(R.parse_header(header).alias("h"))
    return h.groupBy("h.name", "h.mate", "h.passed").agg(F.count(F.lit(1)).alias("n"))
