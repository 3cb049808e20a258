"""Genotype calling by expectation maximisation over (locus, person) rows.

One row holds a person's reads per allele of a locus. A locus row (the *model*) holds genotype weights, allele
biases and the error rate. Each round joins the model to the person rows, scores all allele pairs inside the row,
and sums memberships per (locus, pair) with a partial aggregate, so a locus that owns a third of all rows is
combined in every task before anything is shuffled. Only the small model travels between rounds; it is written to
the shared folder each time, which cuts the lineage.

Allele ranks run 1..k by total coverage; rank k+1 is the null allele (no reads expected). Pairs are numbered in
order of (second rank, first rank), which is also the order in which ties are resolved.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.mathx import SUM_COLUMNS, TIE_DIGITS, block_calls, block_sums, pair_log_likelihood, pair_order
from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

START_ERROR = 0.001
STOP_DELTA = 10.0
MAX_ROUNDS = 25
MAX_ERROR = 0.4
MIN_BIAS = 1e-7
NULL_ALLELE = -1
PEOPLE = 1024  # people of one locus packed in a row
BATCH = "8m"  # rows with arrays that Python gets at a time: a batch is held several times over, outside the heap and in Python


def ranked_alleles(allele_cov: DataFrame) -> DataFrame:
    """Per locus: allele lengths by total coverage (equal: shorter first), their number and the total coverage."""
    totals = allele_cov.groupBy("locus_id", "allele_len").agg(F.sum("n").alias("total"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("o"), F.col("allele_len"))))
    return totals.groupBy("locus_id").agg(F.transform(listed, lambda x: x["allele_len"]).alias("lens"), F.sum("total").alias("locus_total")).withColumn("k", F.size("lens"))


def person_rows(allele_cov: DataFrame, expected: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """Packed rows ``locus_id, person_id, n[k], total, exp_raw, exp_cov`` for everyone with an expected coverage."""
    loci = loci if loci is not None else ranked_alleles(allele_cov)
    packed = allele_cov.groupBy("locus_id", "person_id").agg(
        F.map_from_entries(F.collect_list(F.struct("allele_len", "n"))).alias("by_len"), F.sum("n").alias("total")
    )
    full = expected.join(packed, ["locus_id", "person_id"], "left").join(loci.select("locus_id", "lens"), "locus_id")
    reads = F.transform("lens", lambda l: F.coalesce(F.try_element_at("by_len", l), F.lit(0).cast("long")))
    return full.select(
        "locus_id", "person_id", reads.alias("n"), F.coalesce("total", F.lit(0).cast("long")).alias("total"),
        F.col("exp_cov").cast("double").alias("exp_raw"), F.greatest(F.col("exp_cov").cast("double"), F.lit(1.0)).alias("exp_cov"),
    )


def pair_list(k: Column) -> Column:
    """All pairs r1 <= r2 over ranks 1..k+1, numbered by (r2, r1)."""
    ranks = F.sequence(F.lit(1), k + 1)
    return F.flatten(F.transform(ranks, lambda r2: F.transform(F.sequence(F.lit(1), r2), lambda r1: F.struct(r1.alias("r1"), r2.alias("r2")))))


def start_model(loci: DataFrame, error: float = START_ERROR) -> DataFrame:
    """Model before the first round: weight 1 for each pair, bias 1, given error rate."""
    ones = F.transform(pair_list(F.col("k")), lambda s: F.lit(1.0))
    flat = F.transform(F.sequence(F.lit(1), F.col("k")), lambda r: F.lit(1.0))
    return loci.select(
        "locus_id", "lens", "k", "locus_total", ones.alias("w"), flat.alias("bias"), F.lit(error).alias("eps"),
        ones.alias("w_used"), flat.alias("bias_used"), F.lit(error).alias("eps_used"),
        F.lit(None).cast("double").alias("old_score"), F.lit(0).alias("n_iter"), F.lit(True).alias("active"), F.lit(False).alias("converged"),
    )


def _observed(r1: Column, r2: Column, k: Column) -> dict[str, Column]:
    """Reads and copy numbers of a pair from the packed row."""
    het = (r1 < r2) & (r2 <= k)
    n = F.col("n")
    a1 = F.when(r1 <= k, F.get(n, r1 - 1)).otherwise(F.lit(0).cast("long"))
    a2 = F.when(het, F.get(n, r2 - 1)).otherwise(F.lit(0).cast("long"))
    c1 = F.when(r1 > k, 0).when(r1 == r2, 2).otherwise(1)
    return {"a1": a1, "a2": a2, "c1": c1, "c2": F.when(het, 1).otherwise(0), "err": F.col("total") - a1 - a2}


def scored(rows: DataFrame, model: DataFrame, used: bool = False) -> DataFrame:
    """Rows with the log-likelihood of every pair (``ll``), the pair list (``pairs``) and the normaliser (``z``).

    ``used`` takes the parameters of the last expectation step instead of the newest ones.
    """
    tail = "_used" if used else ""
    both = rows.join(model, "locus_id").withColumn("pairs", pair_list(F.col("k")))
    ll = pair_log_likelihood("n", "total", "exp_cov", "bias" + tail, "eps" + tail)
    return both.withColumn("ll", ll).withColumn(
        "z", F.aggregate(F.zip_with("w" + tail, "ll", lambda w, l: w * F.exp(l)), F.lit(0.0), lambda a, x: a + x)
    )


def memberships(df: DataFrame, used: bool = False) -> Column:
    """Probability of each pair; a person whom no pair explains is double null."""
    weight = F.col("w_used" if used else "w")
    null_only = F.transform("pairs", lambda s: F.when(s["r1"] == F.col("k") + 1, 1.0).otherwise(0.0))
    return F.when(F.col("z") > 0, F.zip_with(weight, "ll", lambda w, l: w * F.exp(l) / F.col("z"))).otherwise(null_only)


def pair_rows(df: DataFrame) -> DataFrame:
    """One row per (locus, person, pair) with observed, expected and membership columns."""
    one = df.withColumn("p", memberships(df)).select(
        "locus_id", "person_id", "n", "total", "exp_cov", "k", "w", "bias",
        F.posexplode(F.arrays_zip("pairs", "ll", "p")).alias("pos", "s"),
    ).select("*", F.col("s.pairs.r1").alias("r1"), F.col("s.pairs.r2").alias("r2"), F.col("s.ll").alias("pair_ll"), F.col("s.p").alias("prob"))
    o = _observed(F.col("r1"), F.col("r2"), F.col("k"))
    return one.select(
        "locus_id", "person_id", "k", F.col("pos").alias("pair_no"), "r1", "r2", "total", "exp_cov", F.get("w", F.col("pos")).alias("weight"),
        F.col("pair_ll").alias("ll"), "prob", *[c.alias(name) for name, c in o.items()],
    )


def pair_sums(pairs: DataFrame) -> DataFrame:
    """Membership sums per (locus, pair): everything the maximisation step needs."""
    p, e = F.col("prob"), F.col("exp_cov")
    return pairs.groupBy("locus_id", "pair_no", "r1", "r2").agg(
        F.count(F.lit(1)).alias("people"), F.sum(p).alias("member"), F.sum(p * F.col("err")).alias("err_sum"), F.sum(p * F.col("total")).alias("tot_sum"),
        F.sum(p * F.col("a1")).alias("num1"), F.sum(p * F.col("c1") * e).alias("den1"),
        F.sum(p * F.col("a2")).alias("num2"), F.sum(p * F.col("c2") * e).alias("den2"),
        F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("ll")).otherwise(0.0)).alias("score"),
    )


def packed_people(rows: DataFrame, size: int = PEOPLE) -> DataFrame:
    """Person rows packed into one row per locus and block of about ``size`` people, with flat arrays; written once.

    People are dealt to blocks by a hash, so a locus that owns a third of all rows is many rows here, and a block never holds more than a few
    standard deviations above ``size``.
    """
    blocks = max(1, -(-rows.select("person_id").distinct().count() // size))
    block = F.pmod(F.xxhash64("person_id"), F.lit(blocks)).alias("block")
    listed = rows.groupBy("locus_id", block).agg(F.array_sort(F.collect_list(F.struct("person_id", "total", "exp_raw", "exp_cov", "n"))).alias("x"))
    flat = listed.select("locus_id", "block", "x.person_id", "x.total", "x.exp_raw", "x.exp_cov", F.flatten("x.n").alias("n"))
    return written(flat.sortWithinPartitions("locus_id"), "people")  # the grouping has dealt them out


def _array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def batched_sums(people: DataFrame, model: DataFrame) -> DataFrame:
    """``pair_sums`` without a row per person and pair: every packed row is summed per pair where it is.

    The model meets one row per block of people, and only sums are shuffled, so the share of one locus in the rows does not matter.
    """
    both = people.join(model.select("locus_id", "w", "bias", "eps"), "locus_id").select("locus_id", "n", "total", "exp_cov", "w", "bias", "eps")
    names = ["locus_id", "pair_no", "r1", "r2", *SUM_COLUMNS]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                total = _array(batch, "total", i)
                sums = block_sums(_array(batch, "n", i).reshape(len(total), -1), total, _array(batch, "exp_cov", i), _array(batch, "w", i), _array(batch, "bias", i), batch.column("eps")[i].as_py())
                first, second = pair_order(len(batch.column("bias")[i]))
                locus = batch.column("locus_id").take(pa.array(np.full(len(first), i)))
                slots = [pa.array(x.astype(np.int32)) for x in (np.arange(len(first)), first + 1, second + 1)]
                yield pa.RecordBatch.from_arrays([locus, *slots, *[pa.array(np.asarray(sums[c], float)) for c in SUM_COLUMNS]], names=names)

    kind = people.schema["locus_id"].dataType.simpleString()
    fields = f"locus_id {kind}, pair_no INT, r1 INT, r2 INT, " + ", ".join(f"{c} DOUBLE" for c in SUM_COLUMNS)
    return both.mapInArrow(run, fields).groupBy("locus_id", "pair_no", "r1", "r2").agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS])


def maximised(sums: DataFrame, loci: DataFrame) -> DataFrame:
    """New weights, error rate and biases per locus from the pair sums, and the score of the old model."""
    w = F.col("member") / F.col("people")
    packed = sums.withColumn("new_w", w).groupBy("locus_id").agg(
        F.array_sort(F.collect_list(F.struct("pair_no", "r1", "r2", "new_w", "num1", "den1", "num2", "den2"))).alias("ms"),
        F.sum(F.col("new_w") * F.col("err_sum")).alias("e"), F.sum(F.col("new_w") * F.col("tot_sum")).alias("t"), F.sum("score").alias("score"),
    ).join(loci.select("locus_id", "k", "locus_total"), "locus_id")

    def slot(rank: Column, name: str) -> Column:
        return F.aggregate("ms", F.lit(0.0), lambda a, m: a + m["new_w"] * (
            F.when(m["r1"] == rank, m[f"{name}1"]).when(m["r2"] == rank, m[f"{name}2"]).otherwise(0.0)))

    def ratio(rank: Column) -> Column:
        num, den = slot(rank, "num"), slot(rank, "den")
        return F.greatest(F.coalesce(F.try_divide(num, den), F.lit(0.0)), F.lit(MIN_BIAS))

    eps = F.coalesce(F.try_divide(F.col("e"), F.col("t")), F.lit(0.0))
    return packed.select(
        "locus_id", F.transform("ms", lambda m: m["new_w"]).alias("new_w"), F.transform(F.sequence(F.lit(1), F.col("k")), ratio).alias("new_bias"),
        F.when(eps > 0, eps).otherwise(1.0 / F.col("locus_total")).alias("new_eps"), "score",
    )


def em(rows: DataFrame, loci: DataFrame, max_rounds: int = MAX_ROUNDS, delta: float = STOP_DELTA) -> DataFrame:
    """Fit all loci; each stops on its own (small score change: ``converged``; or round limit, or error rate too high).

    The driver only asks how many loci are still moving; when half of the stored ones are done, the rest is written anew.
    """
    model = written(start_model(loci), "model")
    people = packed_people(rows)
    kept = model.count()
    for turn in range(max_rounds + 1):
        moving = model.filter("active")
        step = maximised(batched_sums(people, moving), moving)
        both = moving.join(step, "locus_id")
        if turn == 0:
            go, old = F.lit(True), F.col("score") + 2 * delta
        else:
            go = (F.abs(F.col("score") - F.col("old_score")) > delta) & (F.col("n_iter") < max_rounds) & (F.col("eps") < MAX_ERROR)
            old = F.col("score")
        pick = lambda new, now: F.when(go, F.col(new)).otherwise(F.col(now)).alias(now)
        moved = both.select(
            "locus_id", "lens", "k", "locus_total", pick("new_w", "w"), pick("new_bias", "bias"), pick("new_eps", "eps"),
            *[F.when(go, F.col(c)).otherwise(F.col(f"{c}_used")).alias(f"{c}_used") for c in ("w", "bias", "eps")],
            F.when(go, old).otherwise(F.col("score")).alias("old_score"), F.when(go, F.col("n_iter") + 1).otherwise(F.col("n_iter")).alias("n_iter"),
            go.alias("active"), (F.col("converged") if turn == 0 else F.abs(F.col("score") - F.col("old_score")) <= delta).alias("converged"),
        )
        model = written(moved.unionByName(model.filter("not active")), "model", BATCH)
        left = model.filter("active").count()
        if not left:
            break
        if 2 * left <= kept:  # finished loci are no longer read
            people, kept = written(people.join(model.filter("active").select("locus_id"), "locus_id", "left_semi"), "people"), left
    return model


def best_pair(p: Column) -> Column:
    """Number (1-based) of the likeliest pair, first of equals."""
    rounded = F.transform(p, lambda x: F.round(x, TIE_DIGITS))
    return F.array_position(rounded, F.array_max(rounded)).cast("int")


def posteriors(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Membership array per (locus, person) from the last expectation step."""
    df = scored(rows, model, used=True)
    return df.select("locus_id", "person_id", "k", "lens", memberships(df, used=True).alias("p"))


CALL = (
    "person_id {person}, allele_1 INT, allele_2 INT, confidence DOUBLE, allele_1_cov BIGINT, allele_2_cov BIGINT, rest_cov BIGINT, exp_allele_cov DOUBLE, exp_err DOUBLE, "
    "p_null DOUBLE, total BIGINT, eps DOUBLE, n_iter INT, allele_fit DOUBLE, noise_fit DOUBLE"
)


def calls(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Genotype record per (locus, person) with confidence, coverage split, fits and null probability: one pass over the packed people."""
    used = model.select("locus_id", "lens", "w_used", "bias_used", "eps_used", "bias", "eps", "n_iter")
    both = packed_people(rows).drop("block").join(used, "locus_id")
    fields = f"locus_id {rows.schema['locus_id'].dataType.simpleString()}, " + CALL.format(person=rows.schema["person_id"].dataType.simpleString())
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                total, expected = _array(batch, "total", i), _array(batch, "exp_cov", i)
                eps = batch.column("eps")[i].as_py()
                c = block_calls(
                    _array(batch, "n", i).reshape(len(total), -1), total, expected, _array(batch, "w_used", i), _array(batch, "bias_used", i), batch.column("eps_used")[i].as_py(), _array(batch, "bias", i), eps)
                lens = np.append(_array(batch, "lens", i), NULL_ALLELE).astype(np.int32)
                out = {
                    "locus_id": batch.column("locus_id").take(pa.array(np.full(len(total), i))), "person_id": batch.column("person_id")[i].values, "allele_1": lens[c["first"]], "allele_2": lens[c["second"]],
                    "confidence": c["confidence"], "allele_1_cov": c["a1"], "allele_2_cov": c["a2"], "rest_cov": c["rest"], "exp_allele_cov": _array(batch, "exp_raw", i), "exp_err": eps * total,
                    "p_null": c["p_null"], "total": total, "eps": np.full(len(total), eps), "n_iter": np.full(len(total), batch.column("n_iter")[i].as_py(), np.int32),
                    "allele_fit": c["allele_fit"], "noise_fit": c["noise_fit"],
                }
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in (out[n] for n in names)], names=names)

    # stored once: every analysis reads this table, and filters on it must not repeat the likelihoods
    return written(both.mapInArrow(run, fields), "genotypes", BATCH)


def called_counts(genotypes: DataFrame, allele_cov: DataFrame) -> DataFrame:
    """How often each allele of a locus was called (lengths from 8 up), 0 for alleles never called."""
    alleles = allele_cov.select("locus_id", "allele_len").distinct()
    called = genotypes.select("locus_id", F.explode(F.array("allele_1", "allele_2")).alias("allele_len")).filter("allele_len >= 8")
    counts = called.groupBy("locus_id", "allele_len").agg(F.count(F.lit(1)).alias("num_called"))
    return alleles.join(counts, ["locus_id", "allele_len"], "left").na.fill(0, ["num_called"])


def allele_biases(model: DataFrame) -> DataFrame:
    return model.select("locus_id", F.explode(F.arrays_zip("lens", "bias")).alias("b")).select("locus_id", F.col("b.lens").alias("allele_len"), F.col("b.bias").alias("bias"))


def locus_models(model: DataFrame) -> DataFrame:
    return model.select("locus_id", "k", "locus_total", "eps", "n_iter")


def parental_frequency(rows: DataFrame, model: DataFrame, parents: DataFrame) -> DataFrame:
    """Sum of memberships over parents per pair."""
    own = rows.join(parents.select("person_id"), "person_id", "left_semi")
    return batched_sums(packed_people(own), model).select("locus_id", "r1", "r2", F.col("member").alias("parent_freq"))
