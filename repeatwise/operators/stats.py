"""Cohort statistics over genotype tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.mathx import chi_square_p
from ..functions.selection import exact_quantiles
from ..session import written
from .cohort import ROLES, with_role


def locus_summary(genotypes: DataFrame) -> DataFrame:
    """Null-call shares, distinct called alleles and heterozygote share per locus, from counts per genotype."""
    cells = genotypes.groupBy("locus_id", "allele_1", "allele_2").agg(F.count(F.lit(1)).alias("c"))
    a, b, c = F.col("allele_1"), F.col("allele_2"), F.col("c")
    share = lambda cond: F.sum(F.when(cond, c).otherwise(0)) / F.sum(c)
    sums = cells.groupBy("locus_id").agg(
        share((a > 0) & (b < 0)).alias("single_null"), share((a < 0) & (b < 0)).alias("double_null"),
        share((a > 0) & (b > 0) & (a != b)).alias("het_share"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(a, b), lambda x: x > 0))))).alias("n_alleles"),
    )
    return sums


def summary_tables(genotypes: DataFrame, scores: DataFrame, models: DataFrame, biases: DataFrame) -> dict[str, DataFrame]:
    """The datasets of the cohort summary. Vectors hold one value for each locus (biases: and allele), matrices one row for each cell."""
    loci = locus_summary(genotypes)
    vectors = {"single_null": "single_null", "double_null": "double_null", "alleles_per_locus": "n_alleles", "het_share": "het_share"}
    cells = {"confidence": "confidence", "allele_fit": "allele_fit", "noise_fit": "noise_fit", "null_probability": "p_null", "locus_coverage": "total"}
    out = {"bias_rates": biases.select("locus_id", "allele_len", F.col("bias").alias("value")), "error_rates": models.select("locus_id", F.col("eps").alias("value"))}
    out |= {name: loci.select("locus_id", F.col(c).alias("value")) for name, c in vectors.items()}
    out["em_iterations"] = models.select("locus_id", F.col("n_iter").alias("value"))
    out |= {name: genotypes.select("locus_id", "person_id", F.col(c).alias("value")) for name, c in cells.items()}
    for child in ("proband", "sibling"):
        out[f"{child}_de_novo_scores"] = scores.select("locus_id", "family_id", F.col(f"{child}_obedience").alias("value"))
    return out


def iteration_frequency(models: DataFrame) -> DataFrame:
    total = models.count()
    return models.groupBy("n_iter").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(total)).alias("share"))


def log_bin(x: Column, step: float = 0.05) -> Column:
    """Integer bin of log10(x)."""
    return F.floor(F.round(F.log10(x) / F.lit(step), 6)).cast("long")


def error_bins(models: DataFrame, step: float = 0.05) -> DataFrame:
    return models.groupBy(log_bin(F.col("eps"), step).alias("log_bin"), F.floor(F.round(F.col("eps") / F.lit(0.01), 6)).cast("long").alias("linear_bin")).agg(F.count(F.lit(1)).alias("n"))


def error_by_motif(models: DataFrame, loci: DataFrame) -> DataFrame:
    """Loci per log error bin and motif length, one row for each."""
    return models.join(loci, "locus_id").groupBy(log_bin(F.col("eps")).alias("log_bin"), "motif_len").agg(F.count(F.lit(1)).alias("n"))


def error_by_reference_length(models: DataFrame, loci: DataFrame, least: float = 0.001) -> DataFrame:
    """Log error bin by reference length inside each motif length, rare reference lengths dropped."""
    cells = models.join(loci, "locus_id").groupBy("motif_len", "ref_length", log_bin(F.col("eps")).alias("log_bin")).agg(F.count(F.lit(1)).alias("n"))
    by_len = F.sum("n").over(Window.partitionBy("motif_len", "ref_length")) / F.sum("n").over(Window.partitionBy("motif_len"))
    return cells.withColumn("len_share", by_len).filter(F.col("len_share") > least)


def bias_distribution(biases: DataFrame, loci: DataFrame) -> DataFrame:
    """Mean and median bias over all, reference and other alleles."""
    kind = F.when(F.col("allele_len") == F.col("ref_length"), "reference").otherwise("non_reference")
    tagged = biases.join(loci.select("locus_id", "ref_length"), "locus_id").withColumn("kind", kind)
    values = written(tagged.select("bias", F.explode(F.array("kind", F.lit("all"))).alias("alleles")), "biases")
    means = values.groupBy("alleles").agg(F.count(F.lit(1)).alias("n"), F.avg("bias").alias("mean_bias"))
    return means.join(exact_quantiles(values, ["alleles"], "bias").withColumnRenamed("quantile", "median_bias"), "alleles")


def medians(genotypes: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Medians overall, per locus and per person.

    ``percentile`` with a frequency keeps one entry per distinct rounded value, so the overall group is bounded by
    the number of distinct values, and partial aggregation runs before the shuffle.
    """
    sets = None
    for level, keys in (("all", []), ("locus", ["locus_id"]), ("person", ["person_id"])):
        part = genotypes.groupBy(*keys).agg(*[F.percentile(F.round(c, digits), F.lit(0.5)).alias(f"median_{c}") for c in columns])
        part = part.select(
            F.lit(level).alias("level"), *[F.col(k).cast("long").alias(k) if k in keys else F.lit(None).cast("long").alias(k) for k in ("locus_id", "person_id")],
            *[f"median_{c}" for c in columns],
        )
        sets = part if sets is None else sets.unionByName(part)
    return sets


def histograms(genotypes: DataFrame, columns: list[str], step: float = 0.05) -> DataFrame:
    """Counts of each column in bins of ``step``, one row for each column and bin, in one shuffle of partial counts."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.floor(F.round(F.col(c) / F.lit(step), 6)).cast("long").alias("bin")) for c in columns]))
    return genotypes.select(values.alias("x")).groupBy("x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def coverage_by_context(cov: DataFrame, contexts: DataFrame) -> DataFrame:
    """Median locus coverage per person, exon and other loci apart."""
    tagged = cov.join(contexts, "locus_id", "left").withColumn("exonic", F.coalesce(F.col("context") == "exon", F.lit(False)))
    return tagged.groupBy("person_id", "exonic").agg(F.percentile("total", F.lit(0.5)).alias("median_cov"), F.count(F.lit(1)).alias("n_loci"))


def hardy_weinberg(genotypes: DataFrame, parents: DataFrame) -> DataFrame:
    """Chi-square test per locus over parents without nulls.

    No result when over half of the parents have a null; p = 1 with a single allele. Sums run over observed
    genotypes only: expected counts of genotypes nobody has sum to parents minus the expected counts of the others.
    """
    par = genotypes.join(parents.select("person_id"), "person_id", "left_semi")
    cells = par.groupBy("locus_id", "allele_1", "allele_2").agg(F.count(F.lit(1)).alias("o"))
    ok = (F.col("allele_1") > 0) & (F.col("allele_2") > 0)
    sizes = cells.groupBy("locus_id").agg(F.sum("o").alias("parents"), F.sum(F.when(ok, F.col("o")).otherwise(0)).alias("n"))
    good = cells.filter(ok).select("locus_id", F.least("allele_1", "allele_2").alias("x"), F.greatest("allele_1", "allele_2").alias("y"), "o")
    merged = good.groupBy("locus_id", "x", "y").agg(F.sum("o").alias("o"))
    freq = merged.select("locus_id", F.explode(F.array("x", "y")).alias("a"), "o").groupBy("locus_id", "a").agg(F.sum("o").alias("copies"))
    n_alleles = freq.groupBy("locus_id").agg(F.count(F.lit(1)).alias("m"))
    one = merged.join(sizes, "locus_id").join(freq.select("locus_id", F.col("a").alias("x"), F.col("copies").alias("cx")), ["locus_id", "x"]).join(
        freq.select("locus_id", F.col("a").alias("y"), F.col("copies").alias("cy")), ["locus_id", "y"])
    n = F.col("n")
    px, py = F.col("cx") / (2 * n), F.col("cy") / (2 * n)
    e = F.when(F.col("x") == F.col("y"), px * px * n).otherwise(2 * px * py * n)
    scored = one.withColumn("e", e).groupBy("locus_id").agg(
        F.max("n").alias("n"), F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("seen"), F.sum("e").alias("e_seen"))
    out = sizes.select("locus_id", "parents").join(scored, "locus_id", "left").join(n_alleles, "locus_id", "left")
    score = F.col("seen") + F.greatest(F.col("n") - F.col("e_seen"), F.lit(0.0))
    df = (F.col("m") * (F.col("m") + 1) / 2 - F.col("m")).cast("long")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= F.col("parents") * 0.5
    return out.select(
        "locus_id", "parents", F.coalesce("n", F.lit(0)).alias("non_null"), F.coalesce("m", F.lit(0)).alias("n_alleles"),
        F.when(enough, F.when(F.col("m") == 1, 0.0).otherwise(score)).alias("score"),
        F.when(enough, F.when(F.col("m") == 1, 0).otherwise(df)).alias("df"),
        F.when(enough, F.when(F.col("m") == 1, 1.0).otherwise(chi_square_p(F.coalesce(score, F.lit(0.0)), F.coalesce(df, F.lit(0))))).alias("p_value"),
    )


CONTEXTS = ["exon", "3' UTR", "5' UTR", "intron", "miRNA", "intergenic"]


def het_loci(genotypes: DataFrame, hwe: DataFrame, contexts: DataFrame, least_p: float = 0.05) -> DataFrame:
    """Heterozygous loci per person and context, loci in equilibrium only."""
    fine = hwe.filter(F.col("p_value") > least_p).select("locus_id").join(contexts, "locus_id", "left").select("locus_id", F.coalesce("context", F.lit("intergenic")).alias("context"))
    het = (F.col("allele_1") > 0) & (F.col("allele_2") > 0) & (F.col("allele_1") != F.col("allele_2"))
    rows = genotypes.select("locus_id", "person_id", het.alias("het")).join(fine, "locus_id")
    return rows.groupBy("person_id").agg(*[
        F.count_if(F.col("het") & (F.col("context") == c)).alias("het_" + c.lower().replace("' ", "_").replace("3_utr", "utr_3").replace("5_utr", "utr_5")) for c in CONTEXTS
    ])


def loci_by_context(contexts: DataFrame) -> DataFrame:
    total = contexts.count()
    return contexts.groupBy("context").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(total)).alias("share"))


def genotype_matrix(genotypes: DataFrame) -> DataFrame:
    cells = genotypes.groupBy("locus_id", "allele_1", "allele_2").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("locus_id")))


def _passes(confidence: float, allele_fit: float, noise_fit: float, p_null: float) -> Column:
    return (F.col("confidence") > confidence) & (F.col("allele_fit") > allele_fit) & (F.col("noise_fit") > noise_fit) & (F.col("p_null") < p_null)


def parent_loci(genotypes: DataFrame, person: DataFrame) -> DataFrame:
    """Parents and parents without nulls per locus."""
    par = genotypes.join(with_role(person).filter("rel_code <= 2").select("person_id"), "person_id", "left_semi")
    return par.groupBy("locus_id").agg(F.count(F.lit(1)).alias("parents"), F.count_if((F.col("allele_1") > 0) & (F.col("allele_2") > 0)).alias("non_null"))


def rare_alleles(genotypes: DataFrame, person: DataFrame, share: float = 0.01, exactly: int | None = None) -> DataFrame:
    """Alleles with few copies among parents (at most ``share`` of them, or ``exactly`` that many)."""
    loci = parent_loci(genotypes, person).filter(F.col("non_null") >= F.col("parents") * 0.5)
    par = genotypes.join(with_role(person).filter("rel_code <= 2").select("person_id"), "person_id", "left_semi").filter("allele_1 > 0 and allele_2 > 0")
    copies = par.select("locus_id", F.explode(F.array("allele_1", "allele_2")).alias("allele")).groupBy("locus_id", "allele").agg(F.count(F.lit(1)).alias("copies"))
    joined = copies.join(loci, "locus_id")
    return joined.filter(F.col("copies") == exactly) if exactly is not None else joined.filter(F.col("copies") <= F.col("non_null") * share)


def transmissions(
    genotypes: DataFrame, person: DataFrame, rare: DataFrame, bad_families: DataFrame,
    confidence: float = 0.99, allele_fit: float = 1e-5, noise_fit: float = 1e-3, p_null: float = 0.02,
) -> DataFrame:
    """Families in which a parent carries a rare allele and all members pass: copies per member, family type."""
    roles = with_role(person).filter("role <> 'other'").select("person_id", "family_id", "role", "sex", "rel_code")
    good = F.coalesce(_passes(confidence, allele_fit, noise_fit, p_null), F.lit(False))
    fam = genotypes.join(roles, "person_id").withColumn("good", good)
    locus = fam.filter("rel_code <= 2 and good").select("locus_id", "person_id", F.explode(F.array("allele_1", "allele_2")).alias("a")).groupBy("locus_id", "a").agg(F.count(F.lit(1)).alias("c"))
    locus = locus.groupBy("locus_id").agg((F.sum("c") / 2).cast("long").alias("good_parents"), F.count(F.lit(1)).alias("good_alleles"))
    # families that carry a rare allele in a parent, found by equality on (locus, allele)
    holders = fam.filter("rel_code <= 2 and allele_1 > 0 and allele_2 > 0").select("locus_id", "family_id", F.explode(F.array_distinct(F.array("allele_1", "allele_2"))).alias("allele"))
    wanted = holders.join(rare.select("locus_id", "allele", "copies"), ["locus_id", "allele"]).distinct().join(bad_families, "family_id", "left_anti")
    copies = lambda r: F.sum(F.when(F.col("role") == r, (F.col("allele_1") == F.col("allele")).cast("int") + (F.col("allele_2") == F.col("allele")).cast("int")))
    records = wanted.join(fam, ["locus_id", "family_id"]).groupBy("locus_id", "family_id", "allele").agg(
        F.every("good").alias("all_good"), F.count(F.lit(1)).alias("members"), *[copies(r).alias(f"{r}_copies") for r in ROLES],
        F.concat(F.max(F.when(F.col("role") == "proband", F.col("sex"))), F.max(F.when(F.col("role") == "sibling", F.col("sex")))).alias("family_type"),
    )
    return records.filter("all_good and members = 4").join(locus, "locus_id", "left").drop("all_good", "members")


def rare_tallies(genotypes: DataFrame, person: DataFrame, share: float = 0.01) -> DataFrame:
    loci = parent_loci(genotypes, person)
    rare = rare_alleles(genotypes, person, share).select("locus_id").distinct().withColumn("rare", F.lit(True))
    return loci.join(rare, "locus_id", "left").agg(
        F.count_if(F.col("non_null") < F.col("parents") * 0.5).alias("too_many_nulls"), F.count_if("rare").alias("rare_allele_loci"),
        F.count_if(F.col("non_null") >= F.col("parents") * 0.5).alias("passed"),
    )


def phred_histogram(phred_rows: DataFrame) -> DataFrame:
    return phred_rows.filter((F.col("phred") > 0) & (F.col("phred") < float("inf"))).groupBy(F.floor(F.round("phred", 6)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def locus_table(models: DataFrame, summary: DataFrame, called: DataFrame) -> DataFrame:
    """One row per locus with error rate, null and heterozygote shares and called copies."""
    copies = called.groupBy("locus_id").agg(F.sum("num_called").alias("called_copies"), F.count_if(F.col("num_called") > 0).alias("called_alleles"))
    return models.join(summary, "locus_id").join(copies, "locus_id")


def length_matrix(allele_cov: DataFrame, person: DataFrame, codes: list[int]) -> DataFrame:
    """Reads per person and allele length of each locus for a subgroup, one row for each length that was read."""
    chosen = with_role(person).filter(F.col("rel_code").isin(codes)).select("person_id")
    return allele_cov.join(chosen, "person_id", "left_semi").groupBy("locus_id", "person_id", "allele_len").agg(F.sum("n").alias("n"))


def family_length_matrix(allele_cov: DataFrame, genotypes: DataFrame, person: DataFrame) -> DataFrame:
    """Members' reads per length with the expected reads of called alleles (copies times expected coverage)."""
    roles = with_role(person).filter("role <> 'other'").select("person_id", "family_id", "role")
    g = genotypes.select("locus_id", "person_id", "allele_1", "allele_2", "exp_allele_cov")
    joined = allele_cov.join(g, ["locus_id", "person_id"]).join(roles, "person_id")
    copies = (F.col("allele_len") == F.col("allele_1")).cast("int") + (F.col("allele_len") == F.col("allele_2")).cast("int")
    return joined.select("locus_id", "family_id", "role", "allele_len", "n", (copies * F.col("exp_allele_cov")).alias("expected_reads"))
