"""Queries on text sources and sinks: whole tables are written to the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import cohort as C
from ..operators import denovo as DN
from ..operators import genotype as G
from ..operators import population as PO
from ..operators import profile as P
from ..operators import stats as ST
from ..operators import tracts as TR
from ..operators import vcf as V
from ..registry import oracle, query
from ..session import scratch_path, written
from ..sources import text as IO
from .denovo import FULL, LABELS, cases
from .export import ALT, CALLS, COUNTS, GT, INFO, SAMPLE, SEQ, locus_counts
from .families import SCORES, start_scores
from .fitted import genotypes as em_genotypes
from .fitted import scores as em_scores
from .genotypes import EM_CALLS, fitted, start_genotypes
from .population import ALLELES, BASE, CELLS, COLUMNS
from .population import CAST as INDEX_CAST
from .population import VIEWS as OBS
from .profiles import DUPS, FLANK_ROWS, KEY, PROFILE, located, profiles
from .sql import family_ctes, index_ctes, island_ctes, start_calls, tract_ctes
from .statistics import FAMILY, PAR, RARE, SHARE, TRANS_OUT, TRANSMITTED, transmitted
from .tracts import BLOCK, DOC, carried, doc_tracts, flanked

ID = ["read_id", "mate"]
DOC_TRACTS = tract_ctes("dna", "doc_id")
READ_TRACTS = tract_ctes("reads", "read_id, mate")


def _path(v, label):
    return scratch_path(v.spark, label)


@query("io01_fasta", oracle("dna", "SELECT 'doc' || doc_id AS chrom, seq FROM dna WHERE length(seq) > 0"))
def _(v):
    path = _path(v, "fasta")
    named = v.dna.filter(F.length("seq") > 0).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), F.lower("seq").alias("seq"))
    IO.write_fasta(named, path)
    return IO.read_fasta(v.spark, path)


@query("io01_fasta_tracts", oracle("dna", "SELECT 'doc' || doc_id AS chrom, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(length AS BIGINT) AS length, unit FROM tracts", DOC_TRACTS))
def _(v):
    path = _path(v, "fasta")
    IO.write_fasta(v.dna.filter(F.length("seq") > 0).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), F.lower("seq").alias("seq")), path)
    found = TR.detect_blocks(IO.read_fasta_blocks(v.spark, path, BLOCK), ["rec", "chrom"], "seq")
    return found.drop("rec")


@query("io02_fastq", oracle("reads", "SELECT CAST(read_id AS VARCHAR) AS read_id, mate, passed, seq, qual FROM reads"))
def _(v):
    path = _path(v, "fastq")
    name = F.concat(F.col("read_id").cast("string"), F.lit(" "), F.col("mate").cast("string"), F.lit(":"), F.when(F.col("passed"), "N").otherwise("Y"), F.lit(":0"))
    IO.write_fastq(v.reads.select(name.alias("name"), "seq", "qual"), path)
    return IO.fastq_reads(IO.read_fastq(v.spark, path)).select("read_id", "mate", "passed", "seq", "qual")


def _named(v):
    return doc_tracts(v).withColumn("chrom", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))


@query("io06_reference_tracts", oracle("dna", "SELECT 'doc' || doc_id AS chrom, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, CAST(length AS INT) AS length, unit FROM tracts", DOC_TRACTS))
def _(v):
    path = _path(v, "tracts")
    IO.write_ref_tracts(_named(v), path)
    return IO.read_ref_tracts(v.spark, path)


@query("io07_reference_sink", oracle("dna", """SELECT 'doc' || doc_id || chr(9) || start || chr(9) || stop || chr(9) || length || chr(9) || unit || chr(9) || substring(seq, CAST(start AS BIGINT), CAST(length AS BIGINT)) AS line FROM tracts JOIN dna USING (doc_id)""", DOC_TRACTS))
def _(v):
    path = _path(v, "tract-sink")
    bases = TR.subsequence(v.dna, doc_tracts(v), "doc_id", "seq").withColumnRenamed("bases", "snapshot")
    IO.write_ref_tracts(_named(v).join(bases, ["doc_id", "start", "stop"]), path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("io07_reference_flanks", oracle("dna", """SELECT 'doc' || doc_id || chr(9) || start || chr(9) || stop || chr(9) || length || chr(9) || unit || chr(9) || front || chr(9) || rear || chr(9) || lower(front) || bases || lower(rear) AS line FROM
  (SELECT *, substring(seq, CAST(greatest(start - 30, 1) AS BIGINT), CAST(start - greatest(start - 30, 1) AS BIGINT)) AS front, substring(seq, CAST(stop + 1 AS BIGINT), 30) AS rear,
    substring(seq, CAST(start AS BIGINT), CAST(length AS BIGINT)) AS bases FROM tracts JOIN dna USING (doc_id))""", DOC_TRACTS))
def _(v):
    path = _path(v, "tract-flanks")
    around = flanked(v).select("doc_id", "start", "stop", "front_flank", "rear_flank", "snapshot")
    IO.write_ref_tracts(_named(v).join(around, ["doc_id", "start", "stop"]), path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


INDEX = DOC_TRACTS + island_ctes("doc_id") + index_ctes("doc_id")


def _index(v):
    return TR.offset_index(doc_tracts(v), DOC).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), "position", "offset")


@query("io08_offset_source", oracle("dna", """SELECT 'doc' || doc_id AS chrom, CAST(position AS BIGINT) AS position, CAST("offset" AS BIGINT) AS "offset" FROM offset_index""", INDEX))
def _(v):
    path = _path(v, "offsets")
    IO.write_offset_index(_index(v), path)
    return IO.read_offset_index(v.spark, path)[0]


@query("io09_offset_sink", oracle("dna", """SELECT 'doc' || doc_id AS name, string_agg(CAST(position AS VARCHAR), chr(9) ORDER BY position) AS positions, string_agg(CAST("offset" AS VARCHAR), chr(9) ORDER BY position) AS offsets FROM offset_index GROUP BY doc_id""", INDEX))
def _(v):
    path = _path(v, "offset-sink")
    IO.write_offset_index(_index(v), path)
    line = F.split("value", "\n")
    return v.spark.read.text(path, lineSep="\n\n").select(line[0].alias("name"), line[1].alias("positions"), line[2].alias("offsets"))


def _listed(v):
    return carried(v)


CELL = "unit || ':' || start || ':' || length || ':' || substring(qual, CAST(start AS BIGINT), CAST(length AS BIGINT))"


@query("io10_sidecar_source", oracle("reads", "SELECT CAST(read_id AS VARCHAR) AS read_id, mate, unit, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, substring(qual, CAST(start AS BIGINT), CAST(length AS BIGINT)) AS qual FROM reads LEFT JOIN tracts USING (read_id, mate)", READ_TRACTS))
def _(v):
    path = _path(v, "sidecar")
    IO.write_sidecar(_listed(v), path)
    return IO.read_sidecar(v.spark, path)


@query("io11_sidecar_sink", oracle("reads", f"SELECT read_id || '/' || mate || COALESCE('|' || cells, '') AS line FROM reads LEFT JOIN (SELECT read_id, mate, string_agg({CELL}, '|' ORDER BY start, stop) AS cells FROM tracts JOIN reads USING (read_id, mate) GROUP BY ALL) USING (read_id, mate)", READ_TRACTS))
def _(v):
    path = _path(v, "sidecar-sink")
    IO.write_sidecar(_listed(v), path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("io12_annotated_fastq", oracle("reads", f"SELECT '@' || read_id || COALESCE('|' || cells, '') AS l1, seq AS l2, '+' || read_id AS l3, qual AS l4 FROM reads LEFT JOIN (SELECT read_id, mate, string_agg({CELL}, '|' ORDER BY start, stop) AS cells FROM tracts JOIN reads USING (read_id, mate) GROUP BY ALL) USING (read_id, mate)", READ_TRACTS))
def _(v):
    path = _path(v, "annotated")
    name = IO.annotated_name(F.col("read_id").cast("string"), F.col("tracts"), F.col("qual"))
    IO.write_fastq(_listed(v).select(name.alias("name"), "seq", "qual"), path)
    return IO.read_fastq(v.spark, path).select("l1", "l2", "l3", "l4")


@query("io13_condensed_fastq", oracle("reads", """SELECT '@' || read_id AS l1, COALESCE(s, 'N') AS l2, '+' || read_id AS l3, COALESCE(q, 'B') AS l4 FROM reads LEFT JOIN (SELECT read_id, mate, string_agg(b, '' ORDER BY i) AS s, string_agg(substring(qual, i, 1), '' ORDER BY i) AS q
  FROM bases x JOIN reads USING (read_id, mate) WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.read_id = x.read_id AND c.mate = x.mate AND c.i = x.i) GROUP BY read_id, mate) USING (read_id, mate)""",
    READ_TRACTS + ["covered AS (SELECT DISTINCT read_id, mate, unnest(range(CAST(start AS BIGINT), CAST(stop + 1 AS BIGINT))) AS i FROM tracts)"]))
def _(v):
    path = _path(v, "condensed")
    short = carried(v).select(F.col("read_id").cast("string").alias("name"), *[TR.condensed(F.col(c), F.col("tracts")).alias(c) for c in ("seq", "qual")])
    IO.write_fastq(IO.condensed_fastq(short, "name"), path)
    return IO.read_fastq(v.spark, path).select("l1", "l2", "l3", "l4")


def _profile_files(v, *columns):
    path = _path(v, "profiles")
    reads = written(P.dedup_reads(located(v)), "profile-reads")  # read for the rows and for the names
    IO.write_profiles(P.with_reference(P.with_read_names(P.flank_table(reads), reads), v.ref_tract), path)
    return IO.read_profiles(v.spark, path, *columns)


@query("io14_profile_sink", oracle(OBS, f"""SELECT {KEY}, flank, flank_count, CAST(num_flanks AS INT) AS num_flanks, CAST("rank" AS INT) AS "rank", histogram FROM flank_rows""", PROFILE + [FLANK_ROWS]))
def _(v):
    return _profile_files(v, *P.KEY, "flank", "flank_count", "num_flanks", "rank", "histogram")


@query("io14_profile_read_names", oracle(OBS, f"""SELECT {KEY}, flank, names AS read_names FROM flank_rows JOIN (SELECT {KEY}, flank, string_agg(CAST(read_name AS VARCHAR), ',' ORDER BY CAST(read_name AS VARCHAR)) AS names
  FROM (SELECT {KEY}, flank, read_name FROM kept UNION ALL SELECT {KEY}, 'all', read_name FROM kept) GROUP BY {KEY}, flank) USING ({KEY}, flank)""", PROFILE + [FLANK_ROWS]))
def _(v):
    return _profile_files(v, *P.KEY, "flank", "read_names")


@query("io15_profile_source", oracle(OBS, f"SELECT {KEY}, length, CAST(COUNT(*) AS BIGINT) AS n FROM kept GROUP BY {KEY}, length", PROFILE))
def _(v):
    return IO.profile_lengths(_profile_files(v, *P.KEY, "ref_length", "rank", "histogram")).select(*P.KEY, "length", "n")


@query("io16_duplicate_sink", oracle(OBS, "SELECT person_id, CAST(COUNT(*) AS BIGINT) AS sets, CAST(SUM(size) AS BIGINT) AS reads FROM (SELECT person_id, chrom, start, motif, lo_pos, hi_pos, COUNT(*) AS size FROM ends GROUP BY ALL HAVING bool_or(is_dup) AND COUNT(*) > 1) GROUP BY person_id", PROFILE))
def _(v):
    path = _path(v, "duplicates")
    P.duplicate_report(located(v).drop("ref_length"), v.ref_tract).write.csv(path, sep="\t")
    schema = "person_id BIGINT, chrom STRING, start INT, motif STRING, motif_length INT, ref_length INT, lo_pos INT, hi_pos INT, mode INT, share DOUBLE, size BIGINT, histogram STRING"
    return v.spark.read.csv(path, sep="\t", schema=schema).groupBy("person_id").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("reads"))


@query("io16_duplicate_rows", oracle(OBS, f"SELECT d.*, m.mode AS profile_mode FROM dups d LEFT JOIN modes m USING ({KEY})", PROFILE + [DUPS]))
def _(v):
    path = _path(v, "duplicates")
    P.duplicate_report(located(v).drop("ref_length"), v.ref_tract).write.csv(path, sep="\t")
    schema = "person_id BIGINT, chrom STRING, start INT, motif STRING, motif_length INT, ref_length INT, lo_pos INT, hi_pos INT, profile_mode INT, off_mode_share DOUBLE, size BIGINT, histogram STRING"
    return v.spark.read.csv(path, sep="\t", schema=schema).withColumn("off_mode_share", F.round("off_mode_share", 6))


@query("io18_population_columns", oracle("person", "SELECT col_no, person_id, family_id, relation FROM cols", [COLUMNS]))
def _(v):
    path = _path(v, "person-columns")
    PO.person_columns(v.person).select("col_no", "person_id", "family_id", "relation").write.csv(path, sep="\t")
    return v.spark.read.csv(path, sep="\t", schema="col_no BIGINT, person_id BIGINT, family_id INT, relation STRING")


@query("io18_population_counts", oracle(OBS + " person", """SELECT chrom || chr(9) || start || chr(9) || motif || chr(9) || string_agg(COALESCE(cell, '0;;'), chr(9) ORDER BY col_no) AS line FROM (SELECT DISTINCT chrom, start, motif FROM cell) l CROSS JOIN cols
  LEFT JOIN cell USING (chrom, start, motif, person_id) GROUP BY chrom, start, motif""", BASE + [CELLS, COLUMNS]))
def _(v):
    path = _path(v, "population-counts")
    people = PO.person_columns(v.person).select("person_id", "col_no")
    rows = PO.matrix_rows(PO.cells(profiles(v)), people, people.count())
    rows.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), "motif", "cells").alias("value")).write.text(path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("io18_population_tables", oracle(OBS, f"SELECT chrom, start, motif, {INDEX_CAST}, ref_length, longest FROM pop", BASE))
def _(v):
    return written(PO.locus_index(profiles(v)), "population")


@query("io19_count_matrix_source", oracle(OBS, "SELECT chrom, start, motif, CAST(SUM(n) AS BIGINT) AS n, CAST(COUNT(DISTINCT person_id) AS BIGINT) AS people FROM prof GROUP BY ALL", BASE))
def _(v):
    path = _path(v, "cells")
    PO.cells(profiles(v)).write.csv(path, sep="\t")
    raw = v.spark.read.csv(path, sep="\t", schema="chrom STRING, start INT, motif STRING, person_id BIGINT, cell STRING")
    long = PO.parse_cells(raw, [*PO.LOCUS, "person_id"], "cell")
    return long.groupBy(*PO.LOCUS).agg(F.sum("n").alias("n"), F.count_distinct("person_id").alias("people"))


def _info(v):
    path = _path(v, "locus-info")
    reference = PO.locus_index(profiles(v)).select(*PO.LOCUS, "ref_length")
    index = PO.allele_index(profiles(v)).join(reference, PO.LOCUS)
    index.select(*[c.split()[0] for c in IO.LOCUS_INFO_SCHEMA.split(", ")]).write.csv(path, sep="\t")
    return IO.read_locus_info(v.spark, path)


@query("io20_allele_matrix_sink", oracle("allele_cov", "SELECT locus_id, person_id, allele_len, CAST(n AS BIGINT) AS n FROM allele_cov"))
def _(v):
    path = _path(v, "alleles")
    IO.write_partitioned(v.allele_cov, path, "locus_id", 10)
    return v.spark.read.parquet(path).drop("locus_bucket")


@query("io21_locus_info_source", oracle(OBS, f"SELECT chrom, start, motif, length, {INDEX_CAST}, CAST(num_lengths AS BIGINT) AS num_lengths, ref_length FROM al JOIN nl USING (chrom, start, motif) JOIN (SELECT chrom, start, motif, ref_length FROM pop) USING (chrom, start, motif)", BASE + [ALLELES]))
def _(v):
    return _info(v)


@query("io21_locus_rows", oracle(OBS, """SELECT chrom, start, motif, CAST(place AS BIGINT) AS first_row FROM (SELECT *, row_number() OVER (ORDER BY CAST(replace(chrom, 'chr', '') AS INT), start, length(motif), motif, length) - 1 AS place FROM al) WHERE length = 0""", BASE + [ALLELES]))
def _(v):
    return IO.locus_rows(_info(v))


@query("io22_allele_slice", oracle("allele_cov locus", "SELECT locus_id, person_id, allele_len, CAST(n AS BIGINT) AS n FROM allele_cov JOIN locus USING (locus_id) WHERE locus_id BETWEEN 15 AND 34 AND chrom NOT IN ('chr21', 'chr22')".replace("SELECT locus_id", "SELECT allele_cov.locus_id").replace("WHERE locus_id", "WHERE allele_cov.locus_id")))
def _(v):
    path, first, last, width = _path(v, "alleles"), 15, 34, 10
    IO.write_partitioned(v.allele_cov, path, "locus_id", width)
    stored = v.spark.read.parquet(path).filter(F.col("locus_bucket").between(first // width, last // width)).drop("locus_bucket")
    kept = C.drop_chromosomes(v.locus, ["chr21", "chr22"]).select("locus_id")
    return C.locus_range(stored, first, last).join(kept, "locus_id", "left_semi")


@query("io23_total_coverage", oracle("allele_cov locus", "SELECT locus_id, person_id, CAST(SUM(n) AS BIGINT) AS n FROM allele_cov JOIN locus USING (locus_id) WHERE chrom NOT IN ('chr21', 'chr22') GROUP BY locus_id, person_id"))
def _(v):
    kept = C.drop_chromosomes(v.locus, ["chr21", "chr22"]).select("locus_id")
    return v.allele_cov.join(kept, "locus_id", "left_semi").groupBy("locus_id", "person_id").agg(F.sum("n").alias("n"))


@query("io24_people", oracle("person", "SELECT person_id, family_id, relation, rel_code FROM cols", [COLUMNS]))
def _(v):
    path = _path(v, "people")
    v.person.select("person_id", "family_id", "relation").write.csv(path, sep="\t")
    return IO.read_people(v.spark, path)


@query("io25_sample_report", oracle("person", "SELECT person_id, sex, CASE WHEN family_id > 0 THEN sample_type END AS sample_type FROM person"))
def _(v):
    path = _path(v, "report")
    kind = F.when(F.col("family_id") > 0, F.col("sample_type"))
    # ragged: the last field is missing where it has no value
    line = F.concat_ws("\t", F.col("person_id").cast("string"), "sex", kind)
    IO.write_report(v.person.select(line.alias("value")), "person_id\tsex\tsample_type", path)
    return IO.read_report(v.spark, path, "person_id BIGINT, sex STRING, sample_type STRING")


@query("io26_quad_report", oracle("person bad_family", "SELECT 'auSSC' || family_id AS family_id, TRUE AS flagged FROM (SELECT DISTINCT family_id FROM person WHERE sample_type = 'whole blood') WHERE family_id IN (SELECT family_id FROM bad_family)"))
def _(v):
    path = _path(v, "quads")
    fam = v.person.select("family_id", "sample_type").distinct().join(v.bad_family.withColumn("bad", F.lit("failed")), "family_id", "left")
    quad = F.concat(F.lit("auSSC"), F.col("family_id").cast("string"), F.lit("-"), F.regexp_replace("sample_type", " ", ""))
    fam.select(quad.alias("quad_id"), F.coalesce("bad", F.lit("OK")).alias("status")).write.csv(path, sep="\t", header=True)
    _, bad = IO.quad_report(IO.read_report(v.spark, path, "quad_id STRING, status STRING"))
    return bad.select("family_id", F.lit(True).alias("flagged"))


@query("io27_bed_and_gene_ids", oracle("annotation gene_id", "SELECT chrom, start, info, kind, CAST((SELECT COUNT(*) FROM gene_id) AS BIGINT) AS genes FROM annotation"))
def _(v):
    ids, tracks = _path(v, "genes"), None
    v.gene_id.write.csv(ids, sep="\t")
    genes = IO.read_gene_ids(v.spark, ids).count()
    for kind in ("exon", "intron", "mirna", "utr"):  # one file for each track
        bed = _path(v, f"bed-{kind}")
        v.annotation.filter(F.col("kind") == kind).select("chrom", "start", (F.col("start") + 1).alias("stop"), "info").write.csv(bed, sep="\t")
        track = IO.read_bed(v.spark, bed, kind).select("chrom", "start", "info", F.lit(kind).alias("kind"), F.lit(genes).cast("long").alias("genes"))
        tracks = track if tracks is None else tracks.union(track)
    return tracks


@query("io28_genotype_store", oracle("allele_cov expected", "SELECT locus_id, person_id, allele_1, allele_2 FROM geno", start_calls()))
def _(v):
    path = _path(v, "genotype-store")
    IO.write_partitioned(start_genotypes(v), path, "locus_id", 10)
    return v.spark.read.parquet(path).select("locus_id", "person_id", "allele_1", "allele_2")


@query("io29_family_score_store", oracle(FAMILY, "SELECT locus_id, family_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in SCORES) + " FROM fam", FULL))
def _(v):
    path = _path(v, "score-store")
    IO.write_partitioned(start_scores(v), path, "locus_id", 10)
    return v.spark.read.parquet(path).select("locus_id", "family_id", *[F.round(s, 6).alias(s) for s in SCORES])


@query("io30_violation_table", oracle(FAMILY, "SELECT locus_id, family_id, CAST(w AS INT) AS who FROM labels_ WHERE w = 1 UNION ALL SELECT locus_id, family_id, CAST(w AS INT) FROM labels_ WHERE w > 1", FULL + [LABELS]))
def _(v):
    path = _path(v, "violations")
    rows = DN.label_violators(start_scores(v)).select("locus_id", "family_id", "who")
    IO.append_run(rows.filter("who = 1"), path, "proband")
    IO.append_run(rows.filter("who > 1"), path, "others")
    IO.append_run(rows.filter("who = 1"), path, "proband")  # a run repeated counts once
    return IO.read_runs(v.spark, path, "locus_id INT, family_id INT, who INT")


@query("io31_rare_allele_sink", oracle(FAMILY + " bad_family", TRANS_OUT, TRANSMITTED))
def _(v):
    path = _path(v, "rare")
    rows = transmitted(v)
    IO.append_run(rows, path, "all")
    return IO.read_runs(v.spark, path, rows.schema)


@query("io32_vcf_sink", oracle("allele_cov expected locus person", f"""SELECT person_id, CAST(COUNT(*) + {len(V.INFO_FIELDS) + len(V.FORMAT_FIELDS) + 4} AS BIGINT) AS lines, CAST(COUNT(*) AS BIGINT) AS records, CAST(COUNT(*) FILTER (len(alts) > 0) AS BIGINT) AS with_alt FROM gv GROUP BY person_id""", start_calls() + [CALLS, COUNTS]))
def _(v):
    path = _path(v, "vcf")
    IO.write_vcf(V.records(start_genotypes(v), v.locus, locus_counts(v)), path, v.person)
    lines = v.spark.read.text(path)
    body = ~F.col("value").startswith("#")
    return lines.groupBy(F.col("person_id").cast("long").alias("person_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(body).alias("records"), F.count_if(body & (F.split("value", "\t")[4] != ".")).alias("with_alt"))


HEADER = ", ".join("'" + h.replace("'", "''") + "'" for h in ["##fileformat=VCFv4.1", "##source=repeatwise"] + [f'##{k}=<ID={i},Number={n},Type={t},Description="{d}">' for k, fs in (("INFO", V.INFO_FIELDS), ("FORMAT", V.FORMAT_FIELDS)) for i, n, t, d in fs])
NAMES = "'#' || array_to_string(['CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'SAMPLE'], chr(9))"


@query("io32_vcf_text", oracle("allele_cov expected locus person", f"""SELECT person_id, chrom || chr(9) || start || chr(9) || '.' || chr(9) || {SEQ.format(n='ref_length')} || chr(9) || {ALT} || chr(9) || '.' || chr(9) || {INFO} || chr(9) || '{":".join(f[0] for f in V.FORMAT_FIELDS)}' || chr(9) || {SAMPLE} AS line FROM gv JOIN lc USING (locus_id)
  UNION ALL SELECT person_id, unnest([{HEADER}, {NAMES}, '##personInfo=<IndividualID=' || person_id || ',FamilyID=' || family_id || '>']) FROM person WHERE person_id IN (SELECT person_id FROM gv)""", start_calls() + [CALLS, COUNTS]))
def _(v):
    # every line of every file but for QUAL, whose last digits hang on the last bits of the confidence (vc04_quality)
    path = _path(v, "vcf")
    IO.write_vcf(V.records(start_genotypes(v), v.locus, locus_counts(v)), path, v.person)
    lines = v.spark.read.text(path)
    cells = F.split("value", "\t")
    line = F.when(F.col("value").startswith("#"), F.col("value")).otherwise(F.concat_ws("\t", F.slice(cells, 1, 5), F.slice(cells, 7, 4)))
    return lines.select(F.col("person_id").cast("long").alias("person_id"), line.alias("line"))


SUMMARY = {
    "bias_rates": "SELECT locus_id, CAST(allele_len AS BIGINT) AS other, b AS value FROM b_end JOIN rk USING (locus_id, r)", "error_rates": "SELECT locus_id, NULL, eps FROM m_end", "em_iterations": "SELECT locus_id, NULL, n_iter FROM m_end",
    "single_null": "SELECT locus_id, NULL, AVG(CASE WHEN allele_1 > 0 AND allele_2 < 0 THEN 1 ELSE 0 END) FROM geno GROUP BY locus_id", "double_null": "SELECT locus_id, NULL, AVG(CASE WHEN allele_1 < 0 AND allele_2 < 0 THEN 1 ELSE 0 END) FROM geno GROUP BY locus_id",
    "alleles_per_locus": "SELECT locus_id, NULL, COUNT(DISTINCT a) FILTER (a > 0) FROM (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM geno) GROUP BY locus_id",
    "het_share": "SELECT locus_id, NULL, AVG(CASE WHEN allele_1 > 0 AND allele_2 > 0 AND allele_1 <> allele_2 THEN 1 ELSE 0 END) FROM geno GROUP BY locus_id",
    "confidence": "SELECT locus_id, person_id, confidence FROM geno", "allele_fit": "SELECT locus_id, person_id, allele_fit FROM geno", "noise_fit": "SELECT locus_id, person_id, noise_fit FROM geno",
    "null_probability": "SELECT locus_id, person_id, p_null FROM geno", "locus_coverage": "SELECT locus_id, person_id, total FROM geno",
    "proband_de_novo_scores": "SELECT locus_id, family_id, proband_obedience FROM fam", "sibling_de_novo_scores": "SELECT locus_id, family_id, sibling_obedience FROM fam",
}
SUMMARY_SQL = " UNION ALL ".join(f"SELECT '{name}' AS dataset, locus_id, other, round(CAST(value AS DOUBLE), 5) AS value FROM ({sql}) t(locus_id, other, value)" for name, sql in SUMMARY.items())


@query("io33_summary_tables", oracle("allele_cov expected person", SUMMARY_SQL, EM_CALLS + family_ctes()))
def _(v):
    path, g, model = _path(v, "summaries"), em_genotypes(v), fitted(v)[1]
    IO.write_tables(ST.summary_tables(g, em_scores(v), G.locus_models(model), G.allele_biases(model)), path)
    parts = []
    for name in SUMMARY:
        table = v.spark.read.parquet(f"{path}/{name}")
        other = next((c for c in ("allele_len", "person_id", "family_id") if c in table.columns), None)
        other = F.col(other) if other else F.lit(None)
        parts.append(table.select(F.lit(name).alias("dataset"), "locus_id", other.cast("long").alias("other"), F.round(F.col("value").cast("double"), 5).alias("value")))
    return reduce(DataFrame.unionByName, parts)


@query("io33_summary_store", oracle("allele_cov expected", "SELECT locus_id, round(AVG(CASE WHEN allele_1 > 0 AND allele_2 > 0 AND allele_1 <> allele_2 THEN 1 ELSE 0 END), 6) AS het_share FROM geno GROUP BY locus_id", start_calls()))
def _(v):
    return written(ST.locus_summary(start_genotypes(v)), "summary").select("locus_id", F.round("het_share", 6).alias("het_share"))


@query("io35_updated_locus_info", oracle("allele_cov expected", "SELECT locus_id, allele_len, CAST(COUNT(*) FILTER (a = allele_len AND a >= 8) AS BIGINT) AS num_called, MAX(round(b, 5)) AS bias FROM rk LEFT JOIN b_end USING (locus_id, r) LEFT JOIN (SELECT locus_id, unnest([allele_1, allele_2]) AS a FROM geno) USING (locus_id) GROUP BY locus_id, allele_len", EM_CALLS))
def _(v):
    rows, model = fitted(v)
    called = G.called_counts(G.calls(rows, model), v.allele_cov)
    merged = written(called.join(G.allele_biases(model), ["locus_id", "allele_len"], "left"), "locus-info")
    return merged.withColumn("bias", F.round("bias", 5))
