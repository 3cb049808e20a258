"""Queries on placing tracts on the genome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recoord as RC
from ..operators import tracts as TR
from ..registry import oracle, query
from ..sources.text import annotated_name
from .sql import index_ctes, island_ctes, tract_ctes
from .tracts import DOC, carried, doc_tracts, read_tracts

ID = ["read_id", "mate"]
READ_TRACTS = tract_ctes("reads", "read_id, mate")
DOC_INDEX = tract_ctes("dna", "doc_id", prefix="d") + island_ctes("doc_id", "dtracts") + index_ctes("doc_id")

# tracts of the read in alignment orientation: found again on the reverse complement, so it checks the remap itself
TURNED = """turned AS (SELECT a.read_id, a.mate, CASE WHEN reverse THEN read_length - t.stop + 1 ELSE t.start END AS start,
    CASE WHEN reverse THEN read_length - t.start + 1 ELSE t.stop END AS stop, t.length,
    CASE WHEN reverse THEN substring(reverse(translate(seq, 'ACGT', 'TGCA')), CAST(read_length - t.stop + 1 AS BIGINT), length(t.unit)) ELSE t.unit END AS unit,
    CASE WHEN reverse THEN reverse(substring(qual, CAST(t.start AS BIGINT), CAST(t.length AS BIGINT))) ELSE substring(qual, CAST(t.start AS BIGINT), CAST(t.length AS BIGINT)) END AS tract_qual
  FROM tracts t JOIN alignments a USING (read_id, mate))"""
LEAD = """cover AS (SELECT read_id, mate, start, stop, MAX(stop) OVER (PARTITION BY read_id, mate ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turned),
  lead AS (SELECT read_id, mate, MAX(stop) AS bases FROM (SELECT *, SUM(CASE WHEN start > COALESCE(reach, 0) + 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY read_id, mate ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM cover) WHERE g = 0 GROUP BY read_id, mate)"""
PLACED = """placed AS (SELECT a.*, o.position AS index_position, COALESCE(o."offset", 0) AS found, COALESCE(l.bases, 0) AS bases
  FROM alignments a ASOF LEFT JOIN offset_index o ON a.doc_id = o.doc_id AND a.pos + 1 >= o.position LEFT JOIN lead l USING (read_id, mate)),
  offsets AS (SELECT *, CASE WHEN mapped AND mapq > 0 THEN found - CASE WHEN index_position = pos + 1 THEN bases ELSE 0 END END AS read_offset,
    COALESCE(TRY_CAST(CASE WHEN reverse THEN regexp_extract(cigar, '([0-9]+)S$', 1) ELSE regexp_extract(cigar, '^([0-9]+)S', 1) END AS BIGINT), 0) AS clip FROM placed)"""
FULL = READ_TRACTS + [TURNED, LEAD] + DOC_INDEX + [PLACED]


def turned(v, *carry):
    """Alignments that carry their tracts in alignment orientation."""
    found = TR.carry_tracts(v.alignments)
    tracts = RC.turned_tracts(F.col("tracts"), F.col("read_length"), F.col("reverse"), F.col("qual"))
    return found.select(*(carry or ID), tracts.alias("tracts"))


def placed(v):
    """Alignments with tract list, as-of offset and final read offset."""
    listed = turned(v, *ID, "doc_id", "pos", "mapq", "mapped", "reverse", "cigar", (F.col("pos") + 1).alias("at"))
    return RC.genome_offset(RC.asof_offsets(listed, TR.offset_index(doc_tracts(v), DOC), "doc_id", "at"), "at")


@query("ri01_attach_tracts", oracle("alignments", "SELECT a.read_id, a.mate, a.pos, CAST(t.start AS BIGINT) AS start, t.unit FROM alignments a LEFT JOIN tracts t USING (read_id, mate)", READ_TRACTS))
def _(v):
    joined, _ = RC.attach_tracts(v.alignments.select(*ID, "pos"), read_tracts(v).select(*ID, "start", "unit"))
    return joined


@query("ri01_unmatched_tracts", oracle("alignments", "SELECT read_id, mate, CAST(start AS BIGINT) AS start FROM tracts WHERE (read_id, mate) NOT IN (SELECT (read_id, mate) FROM alignments WHERE mapped)", READ_TRACTS))
def _(v):
    _, missing = RC.attach_tracts(v.alignments.filter("mapped"), read_tracts(v).select(*ID, "start"))
    return missing


@query("ri02_mappable", oracle("alignments", "SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS reads, CAST(COUNT(*) FILTER (mapped AND mapq > 0) AS BIGINT) AS mappable FROM alignments GROUP BY doc_id"))
def _(v):
    return v.alignments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("reads"), F.count_if(RC.mappable(None)).alias("mappable"))


@query("ri03_asof_offset", oracle("alignments dna", """SELECT read_id, mate, CAST(o.position AS BIGINT) AS index_position, CAST(COALESCE(o."offset", 0) AS BIGINT) AS "offset"
  FROM alignments a ASOF LEFT JOIN offset_index o ON a.doc_id = o.doc_id AND a.pos + 1 >= o.position""", DOC_INDEX))
def _(v):
    al = v.alignments.select(*ID, "doc_id", (F.col("pos") + 1).alias("at"))
    return RC.asof_offsets(al, TR.offset_index(doc_tracts(v), DOC), "doc_id", "at").select(*ID, "index_position", "offset")


@query("ri04_read_offset", oracle("alignments dna", "SELECT read_id, mate, CAST(read_offset AS BIGINT) AS read_offset FROM offsets", FULL))
def _(v):
    return placed(v).select(*ID, "read_offset")


@query("ri05_leading_tract_bases", oracle("alignments", "SELECT read_id, mate, CAST(COALESCE(bases, 0) AS BIGINT) AS bases FROM alignments LEFT JOIN lead USING (read_id, mate)", READ_TRACTS + [TURNED, LEAD]))
def _(v):
    return turned(v).select(*ID, RC.leading_bases(F.col("tracts")).alias("bases"))


@query("ri06_original_length", oracle("alignments", "SELECT read_id, mate, read_length FROM alignments"))
def _(v):
    short = TR.carry_tracts(v.alignments.select(*ID, "seq")).withColumn("seq", TR.condensed(F.col("seq"), F.col("tracts")))
    return short.select(*ID, RC.original_length(F.length("seq"), F.col("tracts")).alias("read_length"))


@query("ri07_reverse_remap", oracle("alignments", "SELECT read_id, mate, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, unit, tract_qual FROM turned", READ_TRACTS + [TURNED]))
def _(v):
    return TR.each_tract(turned(v)).select(*ID, "start", "stop", "unit", "tract_qual")


@query("ri08_genome_start", oracle("alignments dna", """SELECT read_id, mate, t.unit, CAST(t.length AS BIGINT) AS length, CAST(pos + t.start + read_offset - clip AS BIGINT) AS genome_start
  FROM turned t JOIN offsets USING (read_id, mate) WHERE read_offset IS NOT NULL""", FULL))
def _(v):
    return _on_genome(v).select(*ID, "unit", "length", "genome_start")


def _on_genome(v):
    rows = TR.each_tract(placed(v).filter(F.col("read_offset").isNotNull()))
    return rows.withColumn("genome_start", RC.genome_start(rows))


TAGS = """tagged AS (SELECT read_id, mate, string_agg('doc' || doc_id || ':' || t.unit || ':' || (pos + t.start + read_offset - clip) || ':' || t.length, '|' ORDER BY t.start, t.stop) AS mc,
  string_agg(t.unit || ':' || t.start || ':' || t.tract_qual, '|' ORDER BY t.start, t.stop) AS mu, CAST(MAX(pos + read_offset - clip + 1) AS BIGINT) AS op
  FROM turned t JOIN offsets USING (read_id, mate) WHERE read_offset IS NOT NULL GROUP BY read_id, mate)"""


def _tags(v):
    reads = placed(v).filter(F.col("read_offset").isNotNull() & (F.size("tracts") > 0))
    tagged = RC.tags(reads, F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return tagged.select(*ID, "mc", "mu", RC.original_position(reads).cast("long").alias("op"))


@query("ri09_tags", oracle("alignments dna", "SELECT read_id, mate, mc, mu, op FROM tagged", FULL + [TAGS]))
def _(v):
    return _tags(v)


@query("ri10_parse_tags", oracle("alignments dna", """SELECT read_id, mate, 'doc' || doc_id AS chrom, t.unit AS motif, CAST(pos + t.start + read_offset - clip AS BIGINT) AS genome_start,
  CAST(t.length AS BIGINT) AS length, CAST(t.start AS BIGINT) AS read_start, t.tract_qual FROM turned t JOIN offsets USING (read_id, mate) WHERE read_offset IS NOT NULL""", FULL))
def _(v):
    return RC.parse_tags(_tags(v), ID).drop("tract_no")


@query("ri11_tracts_from_name", oracle("reads", """SELECT CAST(read_id AS VARCHAR) || '/' || mate AS bare_name, unit, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  substring(qual, CAST(start AS BIGINT), CAST(length AS BIGINT)) AS qual, TRUE AS consistent FROM tracts JOIN reads USING (read_id, mate)""", READ_TRACTS))
def _(v):
    listed = carried(v)
    name = annotated_name(F.concat_ws("/", F.col("read_id").cast("string"), F.col("mate").cast("string")), F.col("tracts"), F.col("qual"))
    parsed = listed.select(RC.tracts_from_name(name).alias("x")).select("x.bare_name", "x.tracts", RC.consistent(F.col("x.tracts")).alias("consistent"))
    return parsed.select("bare_name", "consistent", F.explode("tracts").alias("t")).select("bare_name", "t.*", "consistent")


@query("ri12_restore_read", oracle("reads", "SELECT read_id, mate, seq FROM reads WHERE length(seq) > 0"))
def _(v):
    short = carried(v).filter(F.length("seq") > 0).withColumn("seq", TR.condensed(F.col("seq"), F.col("tracts")))
    return short.select(*ID, RC.restore(F.col("seq"), F.col("tracts")).alias("seq"))
