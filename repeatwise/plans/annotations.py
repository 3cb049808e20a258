"""Queries on genomic context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import annotate as AN
from ..registry import oracle, query
from .denovo import CONTEXT

VIEWS = "locus annotation gene_id"
IDS = """ids AS (SELECT locus_id, 'exon' AS kind, unnest(regexp_split_to_array(exon, '[;,]')) AS id FROM ann WHERE exon IS NOT NULL UNION ALL SELECT locus_id, 'intron', unnest(regexp_split_to_array(intron, '[;,]')) FROM ann WHERE intron IS NOT NULL
  UNION ALL SELECT locus_id, 'mirna', unnest(regexp_split_to_array(mirna, '[;,]')) FROM ann WHERE mirna IS NOT NULL UNION ALL SELECT locus_id, 'utr', unnest(regexp_split_to_array(utr, '[;,]')) FROM ann WHERE utr IS NOT NULL)"""
TRANSLATED = """genes AS (SELECT ref_gene AS key, MIN(gene) AS gene FROM gene_id GROUP BY 1 UNION ALL SELECT ccds, MIN(gene) FROM gene_id WHERE ccds <> '-' GROUP BY 1),
  keyed AS (SELECT locus_id, kind, id, CASE WHEN kind = 'mirna' THEN NULL WHEN id LIKE 'CCDS%' THEN split_part(id, '_', 1) ELSE split_part(id, '_', 1) || '_' || split_part(id, '_', 2) END AS key,
    CASE WHEN kind = 'mirna' THEN 1 WHEN id LIKE 'CCDS%' THEN CAST(split_part(id, '_', 3) AS INT) + 1 ELSE CAST(split_part(id, '_', 4) AS INT) END AS feature_no,
    CASE WHEN kind = 'utr' THEN substring(split_part(id, '_', 3), 4, 1) END AS which FROM ids WHERE kind <> 'mirna' OR contains(id, 'Name')),
  translated AS (SELECT DISTINCT locus_id, kind, CASE WHEN kind = 'mirna' THEN replace(id, 'Name=hsa-', '') WHEN id LIKE 'NR%' THEN gene || ' (ncRNA)' ELSE gene END AS gene, feature_no, which FROM keyed LEFT JOIN genes USING (key))"""
ALL = [CONTEXT, IDS, TRANSLATED]


def annotated(v):
    return AN.annotate(v.locus, v.annotation)


@query("an01_feature_lookup", oracle(VIEWS, "SELECT locus_id, chrom, start, exon, intron, mirna, utr FROM ann", ALL))
def _(v):
    return annotated(v).select("locus_id", "chrom", "start", "exon", "intron", "mirna", "utr")


@query("an02_split_ids", oracle(VIEWS, "SELECT locus_id, id FROM ids WHERE kind = 'exon'", ALL))
def _(v):
    return AN.split_ids(annotated(v), "exon")


@query("an02_split_all_ids", oracle(VIEWS, "SELECT locus_id, kind, id FROM ids", ALL))
def _(v):
    rows = annotated(v)
    parts = [AN.split_ids(rows, kind).select("locus_id", F.lit(kind).alias("kind"), "id") for kind in ("exon", "intron", "mirna", "utr")]
    return reduce(DataFrame.unionByName, parts)


@query("an03_gene_names", oracle(VIEWS, "SELECT locus_id, gene, feature_no FROM translated WHERE kind = 'exon' UNION ALL SELECT locus_id, gene, feature_no FROM translated WHERE kind = 'intron'", ALL))
def _(v):
    return AN.translate_ids(AN.split_ids(annotated(v), "exon"), v.gene_id).unionByName(AN.translate_ids(AN.split_ids(annotated(v), "intron"), v.gene_id))


@query("an04_mirna_names", oracle(VIEWS, "SELECT locus_id, gene, feature_no FROM translated WHERE kind = 'mirna'", ALL))
def _(v):
    return AN.translate_mirna(AN.split_ids(annotated(v), "mirna"))


@query("an05_utr_genes", oracle(VIEWS, "SELECT locus_id, gene, feature_no, which FROM translated WHERE kind = 'utr'", ALL))
def _(v):
    return AN.translate_utr(AN.split_ids(annotated(v), "utr"), v.gene_id)


@query("an06_context", oracle(VIEWS, "SELECT locus_id, context FROM ctx", ALL))
def _(v):
    return annotated(v).select("locus_id", AN.context().alias("context"))


@query("an07_context_by_utr_end", oracle(VIEWS, """SELECT locus_id, CASE WHEN exon IS NOT NULL THEN 'exon' WHEN intron IS NOT NULL THEN 'intron' WHEN contains(utr, 'utr5') THEN '5'' UTR' WHEN contains(utr, 'utr3') THEN '3'' UTR'
  WHEN mirna IS NOT NULL THEN 'miRNA' ELSE 'intergenic' END AS context FROM ann""", ALL))
def _(v):
    return annotated(v).select("locus_id", AN.context("by_end").alias("context"))


@query("an08_context_coding_first", oracle(VIEWS, """SELECT locus_id, CASE WHEN exon IS NOT NULL THEN 'exon' WHEN mirna IS NOT NULL THEN 'miRNA' WHEN utr IS NOT NULL THEN 'UTR' WHEN intron IS NOT NULL THEN 'intron' ELSE 'intergenic' END AS context FROM ann""", ALL))
def _(v):
    return annotated(v).select("locus_id", AN.context("coding_first").alias("context"))


TEXT = """pieces AS (SELECT locus_id, CASE kind WHEN 'exon' THEN 1 WHEN 'intron' THEN 2 WHEN 'utr' THEN 3 ELSE 4 END AS o, COALESCE(gene, '') AS g,
  CASE WHEN kind IN ('exon', 'intron') THEN concat_ws(' ', gene, kind || CASE WHEN COUNT(*) > 1 THEN 's' ELSE '' END, string_agg(CAST(feature_no AS VARCHAR), '/' ORDER BY feature_no)) WHEN kind = 'utr' THEN COALESCE(gene, 'NA') || ' ' || MIN(which) || ''' UTR' ELSE gene END AS t
  FROM translated GROUP BY locus_id, kind, gene)"""


@query("an09_annotation_text", oracle(VIEWS, """SELECT locus_id, COALESCE(t, 'Intergenic') AS annotation FROM locus LEFT JOIN (SELECT locus_id, string_agg(t, '; ' ORDER BY o, g, t) AS t FROM (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY o, g, t) AS rk FROM pieces)
  WHERE rk <= 3 GROUP BY locus_id) USING (locus_id)""", ALL + [TEXT]))
def _(v):
    return AN.annotation_text(AN.all_annotations(annotated(v), v.gene_id), v.locus)


@query("an10_all_annotations", oracle(VIEWS, "SELECT locus_id, kind, gene, feature_no, which FROM translated", ALL))
def _(v):
    return AN.all_annotations(annotated(v), v.gene_id)


@query("an11_exon_distance", oracle(VIEWS, """SELECT l.locus_id, CAST(d.distance AS INT) AS distance FROM locus l LEFT JOIN (SELECT CONCAT('chr', 1 + (p_partkey % 100) % 22) AS chrom, 1000 + (p_partkey % 100) * 40 AS start, MIN(p_size) AS distance FROM part GROUP BY 1, 2) d
  ON l.chrom = d.chrom AND l.start = d.start"""))
def _(v):
    d = v.part.select(F.expr("concat('chr', 1 + (p_partkey % 100) % 22)").alias("chrom"), F.expr("CAST(1000 + (p_partkey % 100) * 40 AS INT)").alias("start"), F.col("p_size").alias("distance"))
    return AN.exon_distance(v.locus, d).select("locus_id", "distance")
