"""De novo and Mendelian-violation analysis on family scores and genotype records.

Population counts of an allele come from pre-aggregated tables that violations look up by (locus, allele), so the
work grows with the number of violations and not with violations times people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbering import number_rows
from .cohort import ROLES, with_role

ALLELES = [f"{r}_{i}" for r in ROLES for i in (1, 2)]
PARENT_ALLELES = ALLELES[:4]


def null_count() -> Column:
    total: Column = F.lit(0)
    for a in ALLELES:
        total = total + (F.col(a) < 0).cast("int")
    return total


def _who(proband: Column, sibling: Column) -> Column:
    return F.coalesce(proband, F.lit(False)).cast("int") + 2 * F.coalesce(sibling, F.lit(False)).cast("int")


def candidates(scores: DataFrame, trio: float = 0.99, obedience: float = 1e-4, kinship: float = 0.8) -> DataFrame:
    """Confident, disobedient, truly related trios without nulls; ``who`` is 1 proband, 2 sibling, 3 both."""
    flag = lambda c: (F.col(f"{c}_trio") >= trio) & (F.col(f"{c}_obedience") <= obedience) & (F.col(f"{c}_kinship") >= kinship)
    return scores.filter(null_count() == 0).withColumn("who", _who(flag("proband"), flag("sibling"))).filter("who > 0")


def low_obedience(scores: DataFrame, threshold: float = 5e-3) -> DataFrame:
    """Every family with a low score in either child and no null member."""
    return scores.filter(
        ((F.col("proband_obedience") <= threshold) | (F.col("sibling_obedience") <= threshold)) & (null_count() == 0)
    )


def label_violators(scores: DataFrame, threshold: float = 5e-3) -> DataFrame:
    """``who`` 1/2/3, obedience (both: the larger) and swap score (both: the larger)."""
    who = _who(F.col("proband_obedience") <= threshold, F.col("sibling_obedience") <= threshold)
    pick = lambda s: F.when(F.col("who") == 1, F.col(f"proband_{s}")).when(F.col("who") == 2, F.col(f"sibling_{s}")).otherwise(
        F.greatest(f"proband_{s}", f"sibling_{s}"))
    return scores.withColumn("who", who).filter("who > 0").withColumn("obedience", pick("obedience")).withColumn("swap_score", pick("kinship"))


def role_in_case(role: Column, who: Column) -> Column:
    """Members that count in a case: parents and the violating child or children."""
    return role.isin("mother", "father") | ((role == "proband") & who.isin(1, 3)) | ((role == "sibling") & who.isin(2, 3))


def case_members(cases: DataFrame, genotypes: DataFrame, person: DataFrame) -> DataFrame:
    roles = with_role(person).filter("role <> 'other'").select("person_id", "family_id", "role", "sex")
    return cases.select("locus_id", "family_id", "who").join(roles, "family_id").filter(role_in_case(F.col("role"), F.col("who"))).join(
        genotypes, ["locus_id", "person_id"]
    )


def trio_metrics(cases: DataFrame, genotypes: DataFrame, person: DataFrame) -> DataFrame:
    """Joint null probability, noise fit, allele fit and confidence over the members of a case."""
    return case_members(cases, genotypes, person).groupBy("locus_id", "family_id", "who").agg(
        (1 - F.product(1 - F.col("p_null"))).alias("case_null"), F.product("noise_fit").alias("case_noise_fit"),
        F.product("allele_fit").alias("case_allele_fit"), F.product("confidence").alias("case_confidence"), F.max("eps").alias("eps"),
    )


def quality_filter(
    metrics: DataFrame, bad_families: DataFrame, max_eps: float = 0.17, max_null: float = 0.01, noise: float = 1e-3, allele: float = 1e-5
) -> DataFrame:
    return metrics.filter(
        (F.col("eps") <= max_eps) & (F.col("case_null") < max_null) & (F.col("case_noise_fit") > noise) & (F.col("case_allele_fit") > allele)
    ).join(bad_families, "family_id", "left_anti")


def case_score(cases: DataFrame, both: str = "min") -> DataFrame:
    """Score of a case: the child's obedience; for both children the smaller, or the mean."""
    pair = F.least("proband_obedience", "sibling_obedience") if both == "min" else (F.col("proband_obedience") + F.col("sibling_obedience")) / 2
    return cases.withColumn(
        "score", F.when(F.col("who") == 1, F.col("proband_obedience")).when(F.col("who") == 2, F.col("sibling_obedience")).otherwise(pair)
    )


def ranked(cases: DataFrame, digits: int = 9) -> DataFrame:
    """All cases with their ``place`` (from 0) by score (rounded to ``digits``), locus and family."""
    scored = case_score(cases).withColumn("score", F.round("score", digits))
    return number_rows(scored, ["score", "locus_id", "family_id"], "place")


def _array(names: list[str]) -> Column:
    return F.array(*[F.col(n) for n in names])


def child_alleles() -> Column:
    pro, sib = _array(ALLELES[4:6]), _array(ALLELES[6:8])
    return F.array_distinct(F.when(F.col("who") == 1, pro).when(F.col("who") == 2, sib).otherwise(F.concat(pro, sib)))


def classify(cases: DataFrame) -> DataFrame:
    """``violation`` (omission: all child alleles occur in the parents; else commission) and the alleles behind it."""
    mother, father = _array(ALLELES[:2]), _array(ALLELES[2:4])
    child = child_alleles()
    fresh = F.array_except(child, F.concat(mother, father))
    one_sided = F.array_union(
        F.array_except(F.array_intersect(child, mother), father), F.array_except(F.array_intersect(child, father), mother)
    )
    omission = F.size(fresh) == 0
    return cases.withColumn("violation", F.when(omission, "omission").otherwise("commission")).withColumn(
        "dn_alleles", F.array_sort(F.when(omission, one_sided).otherwise(fresh))
    )


def concordant(scores: DataFrame, genotypes: DataFrame, person: DataFrame) -> DataFrame:
    """Number of equal alleles (out of 8) between the family calls and the individual calls."""
    wide = member_records(genotypes, person, ["allele_1", "allele_2"])
    pairs = [(f"{r}_{i}", f"{r}_allele_{i}") for r in ROLES for i in (1, 2)]
    equal: Column = F.lit(0)
    for a, b in pairs:
        equal = equal + F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))
    return scores.join(wide, ["locus_id", "family_id"]).withColumn("equal_alleles", equal).select(*scores.columns, "equal_alleles")


def member_records(genotypes: DataFrame, person: DataFrame, fields: list[str]) -> DataFrame:
    """Wide record per (locus, family): the fields of all four members side by side, in one shuffle.

    All fields of a role come from one person, of several siblings the one with the smallest id (see ``families``).
    """
    roles = with_role(person).filter("role <> 'other'").select("person_id", "family_id", "role")
    both = genotypes.select("locus_id", "person_id", *fields).join(roles, "person_id")
    wide = both.groupBy("locus_id", "family_id").agg(
        *[F.min_by(F.struct(*fields), F.when(F.col("role") == r, F.col("person_id"))).alias(r) for r in ROLES]
    )
    return wide.select("locus_id", "family_id", *[F.col(f"{r}.{f}").alias(f"{r}_{f}") for r in ROLES for f in fields])


def locus_diversity(genotypes: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct called alleles of a locus and its parents without null alleles."""
    flagged = genotypes.join(parents.select("person_id", F.lit(True).alias("is_parent")), "person_id", "left")
    both = flagged.select(
        "locus_id", F.explode(F.array(
            F.struct(F.col("allele_1").alias("a"), F.lit(0).alias("w")), F.struct(F.col("allele_2").alias("a"), F.lit(1).alias("w")))).alias("s"),
        (F.col("is_parent") & (F.col("allele_1") > 0) & (F.col("allele_2") > 0)).alias("ok"),
    )
    cells = both.groupBy("locus_id", F.col("s.a").alias("a")).agg(F.count_if((F.col("s.w") == 0) & F.col("ok")).alias("ok"))
    return cells.groupBy("locus_id").agg(F.count_if(F.col("a") > 0).alias("diversity"), F.sum("ok").alias("non_null_parents"))


def allele_copies(genotypes: DataFrame) -> DataFrame:
    """Copies of each allele among people whose both alleles are called."""
    good = genotypes.filter((F.col("allele_1") > 0) & (F.col("allele_2") > 0))
    return good.select("locus_id", F.explode(F.array("allele_1", "allele_2")).alias("allele")).groupBy("locus_id", "allele").agg(F.count(F.lit(1)).alias("copies"))


def genotype_counts(genotypes: DataFrame) -> DataFrame:
    return genotypes.groupBy("locus_id", "allele_1", "allele_2").agg(F.count(F.lit(1)).alias("n"))


def violation_frequency(cases: DataFrame, genotypes: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Copies and frequency of each violating allele, among parents (or everyone when ``parents`` is None)."""
    base = genotypes if parents is None else genotypes.join(parents.select("person_id"), "person_id", "left_semi")
    good = base.filter((F.col("allele_1") > 0) & (F.col("allele_2") > 0)).groupBy("locus_id").agg(F.count(F.lit(1)).alias("non_null"))
    one = classify(cases).select("locus_id", "family_id", "who", "violation", F.explode("dn_alleles").alias("allele"))
    return one.join(allele_copies(base), ["locus_id", "allele"], "left").join(good, "locus_id", "left").select(
        "locus_id", "family_id", "who", "violation", "allele", F.coalesce("copies", F.lit(0)).alias("copies"),
        (F.coalesce("copies", F.lit(0)) / (2 * F.col("non_null"))).alias("frequency"),
    )


def child_genotype_frequency(cases: DataFrame, genotypes: DataFrame, parents: DataFrame) -> DataFrame:
    """People (and parents) with the child's genotype; for both children with either genotype."""
    in_all, in_parents = genotype_counts(genotypes), genotype_counts(genotypes.join(parents.select("person_id"), "person_id", "left_semi"))
    wanted = cases.select("locus_id", "family_id", "who", F.explode(F.array_distinct(F.when(F.col("who") == 1, F.array(F.struct(F.col("proband_1").alias("a"), F.col("proband_2").alias("b"))))
        .when(F.col("who") == 2, F.array(F.struct(F.col("sibling_1").alias("a"), F.col("sibling_2").alias("b"))))
        .otherwise(F.array(F.struct(F.col("proband_1").alias("a"), F.col("proband_2").alias("b")), F.struct(F.col("sibling_1").alias("a"), F.col("sibling_2").alias("b")))))).alias("g")
    ).select("locus_id", "family_id", "who", F.col("g.a").alias("allele_1"), F.col("g.b").alias("allele_2"))
    keys = ["locus_id", "allele_1", "allele_2"]
    both = wanted.join(in_all.withColumnRenamed("n", "n_all"), keys, "left").join(in_parents.withColumnRenamed("n", "n_par"), keys, "left")
    return both.groupBy("locus_id", "family_id", "who").agg(
        F.sum(F.coalesce("n_all", F.lit(0))).alias("geno_all"), F.sum(F.coalesce("n_par", F.lit(0))).alias("geno_parents")
    )


def carriers(genotypes: DataFrame, person: DataFrame) -> DataFrame:
    """One row per (locus, person, distinct called allele) with family, role and sex."""
    roles = with_role(person).filter("role <> 'other'").select("person_id", "family_id", "role", "sex")
    return genotypes.select("locus_id", "person_id", F.explode(F.array_distinct(F.array("allele_1", "allele_2"))).alias("allele")).join(roles, "person_id")


def inheritance(genotypes: DataFrame, person: DataFrame) -> DataFrame:
    """Per (locus, allele): mothers and fathers that carry it, and carrying children of a carrying parent by role and sex.

    Families are combined to one row each before the locus-wide sums, so popular alleles are summed in every task.
    """
    held = carriers(genotypes, person).groupBy("locus_id", "allele", "family_id").agg(
        F.max(F.col("role") == "mother").alias("m"), F.max(F.col("role") == "father").alias("f"),
        *[F.max((F.col("role") == r) & (F.col("sex") == s)).alias(f"{r}_{s}") for r in ("proband", "sibling") for s in ("M", "F")],
    )
    parent = F.col("m") | F.col("f")
    return held.groupBy("locus_id", "allele").agg(
        F.count_if("m").alias("mother_occ"), F.count_if("f").alias("father_occ"),
        *[F.count_if(F.col(f"{r}_{s}") & parent).alias(f"{r}_{s.lower()}_inherited") for r in ("proband", "sibling") for s in ("M", "F")],
    )


def violation_inheritance(cases: DataFrame, genotypes: DataFrame, person: DataFrame) -> DataFrame:
    one = classify(cases).select("locus_id", "family_id", "who", F.explode("dn_alleles").alias("allele"))
    return one.join(inheritance(genotypes, person), ["locus_id", "allele"], "left").na.fill(0)


def insertion_or_deletion(cases: DataFrame, loci: DataFrame) -> DataFrame:
    """I or D by the longest violating allele against the reference length; null when equal or none."""
    top = F.array_max("dn_alleles")
    return classify(cases).join(loci.select("locus_id", "ref_length"), "locus_id").withColumn(
        "indel", F.when(top > F.col("ref_length"), "I").when(top < F.col("ref_length"), "D")
    )


def combined_score(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("case_score", (1 - F.col("case_null")) * F.col("case_allele_fit") * F.col("case_noise_fit") * F.col("case_confidence"))


def phred(p: Column) -> Column:
    """-10 log10 p, infinite for p = 0."""
    return F.when(p > 0, -10 * F.log10(p)).otherwise(F.lit(float("inf")))


def phred_scores(labelled: DataFrame) -> DataFrame:
    """Phred of the obedience score: ``phred`` uses the larger of both children, ``phred_low`` the smaller."""
    low = F.when(F.col("who") == 3, F.least("proband_obedience", "sibling_obedience")).otherwise(F.col("obedience"))
    return labelled.withColumn("phred", phred(F.col("obedience"))).withColumn("phred_low", phred(low))


def legacy_filter(scores: DataFrame, genotypes: DataFrame, person: DataFrame, threshold: float = 5e-3, max_eps: float = 0.15, min_cov: float = 5.0) -> DataFrame:
    """Older rule: low noise, all four members covered and without nulls; both children count with their mean."""
    cases = scores.filter(null_count() == 0).withColumn(
        "who", _who(F.col("proband_obedience") <= threshold, F.col("sibling_obedience") <= threshold)).filter("who > 0")
    roles = with_role(person).filter("role <> 'other'").select("person_id", "family_id")
    members = genotypes.join(roles, "person_id").groupBy("locus_id", "family_id").agg(
        F.count_if(F.col("exp_allele_cov") > min_cov).alias("covered"), F.max("eps").alias("eps"),
        F.sum((F.col("allele_1") == -1).cast("int") + (F.col("allele_2") == -1).cast("int")).alias("nulls"),
    )
    kept = cases.join(members, ["locus_id", "family_id"]).filter((F.col("covered") == 4) & (F.col("eps") <= max_eps) & (F.col("nulls") == 0))
    return case_score(kept, both="mean")


def tally(cases: DataFrame, person: DataFrame, contexts: DataFrame) -> DataFrame:
    """Violations by child sex, kind and context, with all subtotals."""
    sexes = with_role(person).groupBy("family_id").agg(
        *[F.max(F.when(F.col("role") == r, F.col("sex"))).alias(r[0]) for r in ("proband", "sibling")])
    sex = F.when(F.col("who") == 1, F.col("p")).when(F.col("who") == 2, F.col("s")).otherwise(F.concat_ws("/", "p", "s"))
    full = classify(cases).join(sexes, "family_id").join(contexts, "locus_id", "left").select(sex.alias("sex"), "violation", F.coalesce("context", F.lit("intergenic")).alias("context"))
    return full.cube("sex", "violation", "context").agg(F.count(F.lit(1)).alias("n"))


def single_child_subset(labelled: DataFrame, metrics: DataFrame, contexts: DataFrame, min_phred: float = 60, max_eps: float = 0.1, confidence: float = 0.95) -> DataFrame:
    """Strong exonic commissions in one child."""
    return phred_scores(classify(labelled)).join(metrics.drop("who"), ["locus_id", "family_id"]).join(contexts, "locus_id").filter(
        (F.col("phred") >= min_phred) & (F.col("context") == "exon") & (F.col("who") < 3) & (F.col("violation") == "commission")
        & (F.col("eps") < max_eps) & (F.col("case_confidence") > confidence)
    )


def comparison_pair(cases: DataFrame, loci: DataFrame, allele_cov: DataFrame) -> DataFrame:
    """Two alleles to compare for the child: its own, or for a homozygote the reference (or best covered other) allele."""
    a, b = (F.when(F.col("who") == 2, F.col(f"sibling_{i}")).otherwise(F.col(f"proband_{i}")) for i in (1, 2))
    totals = allele_cov.groupBy("locus_id", "allele_len").agg(F.sum("n").alias("t"))
    ranked_ = totals.withColumn("rk", F.row_number().over(Window.partitionBy("locus_id").orderBy(F.desc("t"), "allele_len"))).filter("rk <= 2")
    best = ranked_.groupBy("locus_id").agg(
        F.max(F.when(F.col("rk") == 1, F.col("allele_len"))).alias("best1"), F.max(F.when(F.col("rk") == 2, F.col("allele_len"))).alias("best2"))
    df = cases.select("locus_id", "family_id", "who", a.alias("own_1"), b.alias("own_2")).join(loci.select("locus_id", "ref_length"), "locus_id").join(best, "locus_id")
    other = F.when(F.col("own_1") != F.col("ref_length"), F.col("ref_length")).when(F.col("best1") != F.col("own_1"), F.col("best1")).otherwise(F.col("best2"))
    return df.select("locus_id", "family_id", "who", F.col("own_1").alias("compare_1"), F.when(F.col("own_1") != F.col("own_2"), F.col("own_2")).otherwise(other).alias("compare_2"))


def other_coverage(pairs: DataFrame, allele_cov: DataFrame, person: DataFrame) -> DataFrame:
    """Reads of every family member on neither of the two compared alleles.

    The join key is (locus, person of the case's family), so a popular locus is not multiplied by all its cases.
    """
    members = pairs.select("locus_id", "family_id", "compare_1", "compare_2").distinct().join(person.select("person_id", "family_id"), "family_id")
    joined = allele_cov.join(members, ["locus_id", "person_id"])
    pick = lambda c: F.sum(F.when(F.col("allele_len") == F.col(c), F.col("n")).otherwise(0))
    return joined.groupBy("locus_id", "family_id", "person_id", "compare_1", "compare_2").agg(
        pick("compare_1").alias("cov_1"), pick("compare_2").alias("cov_2"), F.sum("n").alias("total")
    ).withColumn("cov_other", F.col("total") - F.col("cov_1") - F.when(F.col("compare_1") != F.col("compare_2"), F.col("cov_2")).otherwise(0))
