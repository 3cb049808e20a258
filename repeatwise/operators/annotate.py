"""Genomic context of loci from feature tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ["exon", "intron", "mirna", "utr"]


def annotate(loci: DataFrame, features: DataFrame) -> DataFrame:
    """One column per feature kind, matched by exact (chrom, start); several features at a place give the least id."""
    wide = features.groupBy("chrom", "start").agg(*[F.min(F.when(F.col("kind") == k, F.col("info"))).alias(k) for k in KINDS])
    return loci.join(wide, ["chrom", "start"], "left")


def split_ids(annotated: DataFrame, kind: str) -> DataFrame:
    """Multi-valued feature text to one id per row."""
    return annotated.filter(F.col(kind).isNotNull()).select("locus_id", F.explode(F.split(kind, "[;,]")).alias("id"))


def _gene_lookup(gene_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_ref = gene_ids.groupBy(F.col("ref_gene").alias("gene_key")).agg(F.min("gene").alias("gene"))
    by_ccds = gene_ids.filter("ccds <> '-'").groupBy(F.col("ccds").alias("gene_key")).agg(F.min("gene").alias("gene"))
    return by_ref, by_ccds


def translate_ids(ids: DataFrame, gene_ids: DataFrame) -> DataFrame:
    """Exon and intron ids to gene names and feature numbers.

    ``CCDSn_kind_i`` counts from 0, ``NM_n_kind_i`` and ``NR_n_kind_i`` from 1; NR genes are non-coding.
    """
    part = F.split("id", "_")
    is_ccds, is_ref = F.col("id").startswith("CCDS"), F.col("id").rlike("^N[MR]")
    keyed = ids.filter(is_ccds | is_ref).select(
        "locus_id", "id", F.when(is_ccds, part[0]).otherwise(F.concat_ws("_", part[0], F.get(part, F.lit(1)))).alias("gene_key"),
        F.when(is_ccds, F.get(part, F.lit(2)).cast("int") + 1).otherwise(F.get(part, F.lit(3)).cast("int")).alias("feature_no"),
        (part[0] == "NR").alias("noncoding"),
    )
    by_ref, by_ccds = _gene_lookup(gene_ids)
    genes = by_ref.unionByName(by_ccds)
    return keyed.join(genes, "gene_key", "left").select(
        "locus_id", F.when(F.col("noncoding"), F.concat("gene", F.lit(" (ncRNA)"))).otherwise(F.col("gene")).alias("gene"), "feature_no"
    ).distinct()


def translate_mirna(ids: DataFrame) -> DataFrame:
    return ids.filter(F.col("id").contains("Name")).select(
        "locus_id", F.regexp_replace("id", "Name=hsa-", "").alias("gene"), F.lit(1).alias("feature_no")
    ).distinct()


def translate_utr(ids: DataFrame, gene_ids: DataFrame) -> DataFrame:
    """UTR ids to gene, feature number and which end (5 or 3)."""
    part = F.split("id", "_")
    by_ref, _ = _gene_lookup(gene_ids)
    keyed = ids.select(
        "locus_id", F.concat_ws("_", part[0], F.get(part, F.lit(1))).alias("gene_key"), F.get(part, F.lit(3)).cast("int").alias("feature_no"),
        F.substring(F.get(part, F.lit(2)), 4, 1).alias("which"), (part[0] == "NR").alias("noncoding"),
    )
    return keyed.join(by_ref, "gene_key", "left").select(
        "locus_id", F.when(F.col("noncoding"), F.concat("gene", F.lit(" (ncRNA)"))).otherwise(F.col("gene")).alias("gene"), "feature_no", "which"
    ).distinct()


def all_annotations(annotated: DataFrame, gene_ids: DataFrame) -> DataFrame:
    """Every translated annotation of every locus, one row each."""
    none = F.lit(None).cast("string")
    parts = [
        translate_ids(split_ids(annotated, "exon"), gene_ids).withColumn("which", none).withColumn("kind", F.lit("exon")),
        translate_ids(split_ids(annotated, "intron"), gene_ids).withColumn("which", none).withColumn("kind", F.lit("intron")),
        translate_mirna(split_ids(annotated, "mirna")).withColumn("which", none).withColumn("kind", F.lit("mirna")),
        translate_utr(split_ids(annotated, "utr"), gene_ids).withColumn("kind", F.lit("utr")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _chain(order: list[tuple[Column, str]]) -> Column:
    expr = F.when(order[0][0], order[0][1])
    for cond, label in order[1:]:
        expr = expr.when(cond, label)
    return expr.otherwise("intergenic")


def _has(kind: str) -> Column:
    return F.col(kind).isNotNull()


def context(variant: str = "standard") -> Column:
    """Single context of a locus by precedence.

    standard: exon, intron, UTR, miRNA; by_end: exon, intron, 5' UTR, 3' UTR, miRNA; coding_first: exon, miRNA, UTR, intron.
    """
    if variant == "standard":
        return _chain([(_has("exon"), "exon"), (_has("intron"), "intron"), (_has("utr"), "UTR"), (_has("mirna"), "miRNA")])
    if variant == "by_end":
        return _chain([
            (_has("exon"), "exon"), (_has("intron"), "intron"), (F.col("utr").contains("utr5"), "5' UTR"),
            (F.col("utr").contains("utr3"), "3' UTR"), (_has("mirna"), "miRNA")])
    if variant == "coding_first":
        return _chain([(_has("exon"), "exon"), (_has("mirna"), "miRNA"), (_has("utr"), "UTR"), (_has("intron"), "intron")])
    raise ValueError(f"unknown precedence {variant!r}")


def annotation_text(all_rows: DataFrame, loci: DataFrame, most: int = 3) -> DataFrame:
    """Readable text per locus, at most ``most`` genes: exons, then introns, UTRs, miRNAs; none is Intergenic."""
    order = F.element_at(F.create_map(F.lit("exon"), F.lit(1), F.lit("intron"), F.lit(2), F.lit("utr"), F.lit(3), F.lit("mirna"), F.lit(4)), F.col("kind"))
    genes = all_rows.groupBy("locus_id", "kind", "gene").agg(
        F.array_sort(F.collect_list("feature_no")).alias("numbers"), F.min("which").alias("which")
    )
    numbers = F.array_join(F.col("numbers").cast("array<string>"), "/")
    piece = (
        F.when(F.col("kind").isin("exon", "intron"), F.concat_ws(" ", "gene", F.concat(F.col("kind"), F.when(F.size("numbers") > 1, "s").otherwise("")), numbers))
        .when(F.col("kind") == "utr", F.concat(F.coalesce("gene", F.lit("NA")), F.lit(" "), F.col("which"), F.lit("' UTR"))).otherwise(F.col("gene"))
    )
    texts = genes.select("locus_id", F.struct(order.alias("o"), F.coalesce("gene", F.lit("")).alias("g"), piece.alias("t")).alias("x")).groupBy("locus_id").agg(
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, most), lambda x: x["t"]), "; ").alias("text")
    )
    return loci.select("locus_id").join(texts, "locus_id", "left").select("locus_id", F.coalesce("text", F.lit("Intergenic")).alias("annotation"))


def exon_distance(loci: DataFrame, distances: DataFrame) -> DataFrame:
    """Attach a distance by exact (chrom, start); loci without an entry keep null."""
    return loci.join(distances.groupBy("chrom", "start").agg(F.min("distance").alias("distance")), ["chrom", "start"], "left")
