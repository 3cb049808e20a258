"""Queries on tract detection and derived sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracts as TR
from ..registry import oracle, query
from .sql import index_ctes, island_ctes, tract_ctes

DOC = ["doc_id"]
ID = ["read_id", "mate"]
BLOCK = 1 << 14
DOC_TRACTS = tract_ctes("dna", "doc_id")
READ_TRACTS = tract_ctes("reads", "read_id, mate")


def doc_tracts(v, limits=TR.Thresholds()):
    return TR.detect(v.dna, DOC, "seq", limits, block=BLOCK)


def read_tracts(v):
    return TR.detect(v.reads, ID, "seq")


BY_PERIOD = """SELECT CAST(length(unit) AS INT) AS period, CAST(COUNT(*) AS BIGINT) AS n_tracts, round(AVG(length), 6) AS mean_length FROM tracts GROUP BY length(unit)"""


@query("md01_tracts_by_period", oracle("dna", BY_PERIOD, DOC_TRACTS))
def _(v):
    return doc_tracts(v).groupBy(F.length("unit").alias("period")).agg(F.count(F.lit(1)).alias("n_tracts"), F.round(F.avg("length"), 6).alias("mean_length"))


ALL = "SELECT {k}, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(length AS BIGINT) AS length, unit FROM tracts"


@query("md01_sequence_tracts", oracle("dna", ALL.format(k="doc_id"), DOC_TRACTS))
def _(v):
    return doc_tracts(v)


@query("md01_read_tracts", oracle("reads", ALL.format(k="read_id, mate"), READ_TRACTS))
def _(v):
    return read_tracts(v)


@query("md02_strict_thresholds", oracle("dna", ALL.format(k="doc_id"), tract_ctes("dna", "doc_id", min_length=10, min_units=4)))
def _(v):
    return doc_tracts(v, TR.Thresholds(min_length=10, min_units=4))


@query("md03_threshold_fallback", oracle("dna", BY_PERIOD, DOC_TRACTS))
def _(v):
    t = doc_tracts(v, TR.Thresholds(min_unit=0, max_unit=0, min_length=2, min_units=1))
    return t.groupBy(F.length("unit").alias("period")).agg(F.count(F.lit(1)).alias("n_tracts"), F.round(F.avg("length"), 6).alias("mean_length"))


@query("md04_sensitivity", oracle("dna", """SELECT length(unit) AS period, CAST(COUNT(*) AS BIGINT) AS n_tracts, CAST(MIN(length) AS BIGINT) AS shortest_found,
  greatest(8, 3 * length(unit), 6 + length(unit)) AS shortest_detectable FROM tracts GROUP BY length(unit)""", DOC_TRACTS))
def _(v):
    return TR.sensitivity(doc_tracts(v))


TERMINAL = """marked AS (SELECT t.*, r.seq, r.qual, NOT (start = 1 OR stop = length(r.seq)) AS passed FROM tracts t JOIN reads r USING (read_id, mate))"""


def carried(v):
    """Reads that carry their tracts."""
    return TR.carry_tracts(v.reads.select(*ID, "seq", "qual"))


def _with_reads(v):
    return TR.each_tract(carried(v))


@query("md05_terminal_tracts", oracle("reads", """SELECT read_id, mate, CAST(start AS BIGINT) AS start, CASE WHEN passed THEN unit ELSE lower(unit) END AS unit, passed FROM marked""", READ_TRACTS + [TERMINAL]))
def _(v):
    return TR.mark_terminal(_with_reads(v).withColumn("n", F.length("seq")), "n").select(*ID, "start", "unit", "passed")


@query("md06_flanks", oracle("dna", """SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
  substring(seq, CAST(greatest(start - 30, 1) AS BIGINT), CAST(start - greatest(start - 30, 1) AS BIGINT)) AS front_flank, substring(seq, CAST(stop + 1 AS BIGINT), 30) AS rear_flank
  FROM tracts JOIN dna USING (doc_id)""", DOC_TRACTS))
def _(v):
    return flanked(v).select("doc_id", "start", "stop", "front_flank", "rear_flank")


def flanked(v):
    """Flanks of sequence tracts: each tract asks for its neighbourhood only, block by block."""
    ranges = doc_tracts(v).select("doc_id", "start", "stop", "unit", F.greatest(F.col("start") - 30, F.lit(1)).alias("a"), (F.col("stop") + 30).alias("b"))
    around = TR.subsequence(v.dna, ranges.select("doc_id", F.col("a").alias("start"), F.col("b").alias("stop")), "doc_id", "seq")
    local = ranges.join(around.select("doc_id", F.col("start").alias("a"), F.col("stop").alias("b"), "bases"), ["doc_id", "a", "b"])
    shifted = local.select("doc_id", (F.col("start") - F.col("a") + 1).cast("int").alias("start"), (F.col("stop") - F.col("a") + 1).cast("int").alias("stop"), "bases", "a")
    return TR.flanks(shifted, "bases").withColumn("start", F.col("start") + F.col("a") - 1).withColumn("stop", F.col("stop") + F.col("a") - 1)


@query("md07_snapshot", oracle("dna", """SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
  lower(substring(seq, CAST(greatest(start - 30, 1) AS BIGINT), CAST(start - greatest(start - 30, 1) AS BIGINT))) || substring(seq, CAST(start AS BIGINT), CAST(length AS BIGINT)) || lower(substring(seq, CAST(stop + 1 AS BIGINT), 30)) AS snapshot
  FROM tracts JOIN dna USING (doc_id)""", DOC_TRACTS))
def _(v):
    return flanked(v).select("doc_id", "start", "stop", "snapshot")


CONDENSED = """SELECT {k}, md5(string_agg(b, '' ORDER BY i)) AS seq_md5, CAST(COUNT(*) AS BIGINT) AS n FROM bases s WHERE NOT EXISTS
  (SELECT 1 FROM covered c WHERE {on} AND c.i = s.i) GROUP BY {k}"""


@query("md08_condensed_sequences", oracle("dna", CONDENSED.format(k="doc_id", on="c.doc_id = s.doc_id"),
    DOC_TRACTS + ["covered AS (SELECT DISTINCT doc_id, unnest(range(CAST(start AS BIGINT), CAST(stop + 1 AS BIGINT))) AS i FROM tracts)"]))
def _(v):
    parts = TR.condense(v.dna, doc_tracts(v), DOC, ["seq"], BLOCK)
    # a document is small here, so its blocks are put together for the check; the sinks write block by block
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "seq"))), lambda b: b["seq"]), "").alias("s"))
    return whole.filter(F.length("s") > 0).select("doc_id", F.md5("s").alias("seq_md5"), F.length("s").cast("long").alias("n"))


@query("md08_condensed_reads", oracle("reads", """SELECT read_id, mate, string_agg(b, '' ORDER BY i) AS seq, string_agg(substring(qual, i, 1), '' ORDER BY i) AS qual
  FROM bases s JOIN reads USING (read_id, mate) WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.read_id = s.read_id AND c.mate = s.mate AND c.i = s.i) GROUP BY read_id, mate""",
    READ_TRACTS + ["covered AS (SELECT DISTINCT read_id, mate, unnest(range(CAST(start AS BIGINT), CAST(stop + 1 AS BIGINT))) AS i FROM tracts)"]))
def _(v):
    short = carried(v).select(*ID, *[TR.condensed(F.col(c), F.col("tracts")).alias(c) for c in ("seq", "qual")])
    return short.filter(F.length("seq") > 0)


@query("md09_offset_index", oracle("dna", 'SELECT doc_id, CAST(position AS BIGINT) AS position, CAST("offset" AS BIGINT) AS "offset" FROM offset_index', DOC_TRACTS + island_ctes("doc_id") + index_ctes("doc_id")))
def _(v):
    return TR.offset_index(doc_tracts(v), DOC)


@query("md10_tract_quality", oracle("reads", "SELECT read_id, mate, CAST(start AS BIGINT) AS start, substring(qual, CAST(start AS BIGINT), CAST(length AS BIGINT)) AS tract_qual FROM tracts JOIN reads USING (read_id, mate)", READ_TRACTS))
def _(v):
    return TR.tract_quality(_with_reads(v), "qual").select(*ID, "start", "tract_qual")


@query("md11_quality_spread", oracle("reads", """SELECT read_id, mate, CAST(start AS BIGINT) AS start, round(AVG(x), 6) AS qual_mean, round(stddev_pop(x), 6) AS qual_sd FROM (
  SELECT read_id, mate, start, ascii(unnest(string_split(substring(qual, CAST(start AS BIGINT), CAST(length AS BIGINT)), ''))) - 33 AS x FROM tracts JOIN reads USING (read_id, mate)) GROUP BY ALL""", READ_TRACTS))
def _(v):
    t = TR.tract_quality(_with_reads(v), "qual")
    return t.select(*ID, "start", F.round("qual_mean", 6).alias("qual_mean"), F.round("qual_sd", 6).alias("qual_sd"))


@query("md12_passing_tracts", oracle("reads", """SELECT read_id, mate, CAST(COUNT(*) AS BIGINT) AS n_tracts, CAST(COUNT(*) FILTER (passed) AS BIGINT) AS n_passed FROM marked GROUP BY read_id, mate""", READ_TRACTS + [TERMINAL]))
def _(v):
    inner = F.filter("tracts", lambda t: (t["start"] > 1) & (t["stop"] < F.length("seq")))
    return carried(v).select(*ID, F.size("tracts").cast("long").alias("n_tracts"), F.size(inner).cast("long").alias("n_passed")).filter("n_tracts > 0")


@query("md13_tract_text", oracle("dna", """SELECT doc_id, unit || ':' || start || ':' || length AS text, unit, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM tracts""", DOC_TRACTS))
def _(v):
    t = doc_tracts(v).select("doc_id", TR.tract_text(F.col("unit"), F.col("start"), F.col("length")).alias("text"))
    return t.withColumn("x", TR.parse_tract_text(F.col("text"))).select("doc_id", "text", "x.unit", "x.start", "x.length")


@query("md14_subsequence", oracle("dna", "SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, substring(seq, CAST(start AS BIGINT), CAST(length AS BIGINT)) AS bases FROM tracts JOIN dna USING (doc_id)", DOC_TRACTS))
def _(v):
    return TR.subsequence(v.dna, doc_tracts(v), "doc_id", "seq")


@query("md15_genome_table", oracle("dna", "SELECT doc_id, length(seq) AS bases, round(length(seq) / SUM(length(seq)) OVER (), 9) AS share FROM dna"))
def _(v):
    sizes = v.dna.select("doc_id", F.length("seq").cast("long").alias("bases"))
    total = sizes.agg(F.sum("bases")).first()[0]
    return sizes.withColumn("share", F.round(F.col("bases") / F.lit(total), 9))
