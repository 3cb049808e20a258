"""Mendelian scores of families from genotype memberships.

The obedience score sums P(mother) P(father) P(child) over all triples in which the child can inherit its two
alleles. Instead of listing triples, a child pair (x, y) needs only four numbers per parent: the chance to carry x,
to carry y, and to be exactly (x, y). With x < y the chance is
``carry_m(x) carry_f(y) + carry_m(y) carry_f(x) - pair_m(x, y) pair_f(x, y)``, with x = y ``carry_m(x) carry_f(x)``.
So one row per (locus, family) is scored in place and nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.mathx import trio_udf
from ..session import written
from .cohort import ROLES, with_role
from .genotype import BATCH, NULL_ALLELE, best_pair, pair_list

MISSING = -2


def family_rows(post: DataFrame, person: DataFrame) -> DataFrame:
    """One row per (locus, family) with the membership array of each role; of several siblings the one with the smallest id (see ``families``)."""
    roles = with_role(person).filter(F.col("role") != "other").select("person_id", "family_id", "role")
    both = post.join(roles, "person_id")
    return both.groupBy("locus_id", "family_id").agg(
        F.first("k").alias("k"), F.first("lens").alias("lens"),
        *[F.min_by("p", F.when(F.col("role") == r, F.col("person_id"))).alias(r) for r in ROLES],
    ).withColumn("pairs", pair_list(F.col("k")))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def allele_share(p: Column) -> Column:
    """Probability mass of each allele: half of every slot it fills."""
    return F.transform(F.sequence(F.lit(1), F.col("k") + 1), lambda a: _sum(F.zip_with(
        "pairs", p, lambda s, x: x * ((s["r1"] == a).cast("int") + (s["r2"] == a).cast("int")) / 2)))


def trio_alleles(child: str, most: int | None = None) -> Column:
    """Ranks by mean share in mother, father and child (equal: lower rank first), at most ``most`` of them."""
    shares = [allele_share(F.col(m)) for m in ("mother", "father", child)]
    ranks = F.sequence(F.lit(1), F.col("k") + 1)
    order = F.array_sort(F.transform(ranks, lambda a: F.struct(
        (-F.round((F.get(shares[0], a - 1) + F.get(shares[1], a - 1) + F.get(shares[2], a - 1)) / 3, 9)).alias("o"), a.alias("a"))))
    picked = F.transform(order, lambda x: x["a"])
    return picked if most is None else F.slice(picked, 1, most)


def trio_scores(fam: DataFrame, child: str, most: int | None = None) -> DataFrame:
    """Obedience of a trio and its kinship score: the best obedience after swapping the child with a parent."""
    scored = fam.withColumn("trio", trio_udf(most)("k", "mother", "father", child))
    return scored.withColumn(f"{child}_obedience", F.col("trio.obedience")).withColumn(f"{child}_kinship", F.col("trio.kinship")).drop("trio")


def likely_alleles(fam: DataFrame) -> DataFrame:
    """Likeliest genotype of every member (-1 null allele, -2 member missing) and its probability."""
    out = fam
    for r in ROLES:
        out = out.withColumn("best", F.get("pairs", best_pair(F.col(r)) - 1))  # a column of its own, so it is looked for once
        for slot, rank in ((1, "r1"), (2, "r2")):
            length = F.coalesce(F.get("lens", F.col("best")[rank] - 1), F.lit(NULL_ALLELE))
            out = out.withColumn(f"{r}_{slot}", F.when(F.col(r).isNull(), MISSING).otherwise(length).cast("int"))
        out = out.withColumn(f"{r}_p", F.array_max(r)).drop("best")
    for child in ("proband", "sibling"):
        out = out.withColumn(f"{child}_trio", F.col("mother_p") * F.col("father_p") * F.col(f"{child}_p"))
    return out


SCORE_COLUMNS = [f"{r}_{i}" for r in ROLES for i in (1, 2)] + [f"{c}_{s}" for s in ("trio", "obedience", "kinship") for c in ("proband", "sibling")]


def family_scores(post: DataFrame, person: DataFrame, most: int | None = None) -> DataFrame:
    """Family score table over all loci and families; trios with a missing member have no score."""
    fam = likely_alleles(family_rows(post, person))
    for child in ("proband", "sibling"):
        fam = trio_scores(fam, child, most)
    # stored once: later filters must not be pushed into (and repeat) the score expressions
    return written(fam.select("locus_id", "family_id", *SCORE_COLUMNS), "family-scores", BATCH)


def mendel_triples(most: Column) -> Column:
    """All (mother, father, child) pairs over ``most`` alleles in which the child inherits one allele of each."""
    pairs = pair_list(most - 1)
    return F.array_distinct(F.flatten(F.flatten(F.transform(pairs, lambda m: F.transform(pairs, lambda f: F.transform(
        F.array(F.struct(m["r1"].alias("a"), f["r1"].alias("b")), F.struct(m["r1"].alias("a"), f["r2"].alias("b")),
                F.struct(m["r2"].alias("a"), f["r1"].alias("b")), F.struct(m["r2"].alias("a"), f["r2"].alias("b"))),
        lambda c: F.struct(m["r1"].alias("m1"), m["r2"].alias("m2"), f["r1"].alias("f1"), f["r2"].alias("f2"),
                           F.least(c["a"], c["b"]).alias("c1"), F.greatest(c["a"], c["b"]).alias("c2"))))))))
