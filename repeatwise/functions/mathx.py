"""Vectorised genotype likelihoods and exact tests; all work on Arrow batches."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

def log_factorials(top: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1)))))


_CELLS = 250_000  # largest work matrix per step; a step holds a dozen of them
TIE_DIGITS = 9  # memberships that agree in so many digits are equal


def poisson_two_sided(x: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Exact two-sided Poisson p: mass of all counts no likelier than the one seen. Rate 0: 1 for x = 0, else 0."""
    x, rate = np.asarray(x, np.int64), np.asarray(rate, float)
    out = np.where(x == 0, 1.0, 0.0)
    live = np.flatnonzero(rate > 0)
    if not len(live):
        return out
    reach = np.maximum(x[live], rate[live])
    need = np.ceil(2 * reach + 40 * np.sqrt(reach + 1) + 40).astype(np.int64)
    order = live[np.argsort(need, kind="stable")]
    need = np.sort(need, kind="stable")
    at = 0
    while at < len(order):
        step = max(1, min(1000, int(_CELLS // max(need[min(at + 1000, len(order) - 1)], 1))))
        rows = order[at : at + step]
        top = int(need[at + len(rows) - 1])
        lf = log_factorials(max(top, int(x[rows].max())))
        k = np.arange(top + 1)
        r = rate[rows][:, None]
        logp = k * np.log(r) - r - lf[: top + 1]
        seen = x[rows] * np.log(rate[rows]) - rate[rows] - lf[x[rows]]
        p = np.where(logp <= (seen + math.log1p(1e-7))[:, None], np.exp(logp), 0.0).sum(axis=1)
        out[rows] = np.minimum(p, 1.0)
        at += len(rows)
    return out


def binomial_upper(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= x) for X ~ Binomial(n, p)."""
    x, n, p = np.asarray(x, np.int64), np.asarray(n, np.int64), np.asarray(p, float)
    out = np.where(x <= 0, 1.0, np.where(p >= 1, 1.0, 0.0))
    live = np.flatnonzero((x > 0) & (p > 0) & (p < 1))
    order = live[np.argsort(n[live], kind="stable")]
    at = 0
    while at < len(order):
        ahead = int(n[order[min(at + 1000, len(order) - 1)]])
        rows = order[at : at + max(1, min(1000, int(_CELLS // max(ahead, 1))))]
        top = int(n[rows].max())
        lf = log_factorials(top)
        k = np.arange(top + 1)
        nn, pp = n[rows][:, None], p[rows][:, None]
        inside = (k >= x[rows][:, None]) & (k <= nn)
        rest = np.maximum(nn - k, 0)
        logp = lf[nn] - lf[k] - lf[rest] + k * np.log(pp) + rest * np.log1p(-pp)
        out[rows] = np.minimum(np.where(inside, np.exp(logp), 0.0).sum(axis=1), 1.0)
        at += len(rows)
    return out


def chi_square_upper(score: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X >= score) for chi-square with whole ``df`` by the finite sums for even and odd degrees.

    Terms are added as logarithms, so large scores and degrees neither underflow nor overflow; all scores with the same degrees
    are summed together.
    """
    score, df = np.asarray(score, float), np.asarray(df, np.int64)
    out = np.ones(len(score))
    for d in np.unique(df[(df > 0) & (score > 0)]):
        at = np.flatnonzero((df == d) & (score > 0))
        half = score[at][:, None] / 2
        steps = np.arange(d // 2) + (d % 2) / 2  # exponents of half in the sum
        logs = -half + steps * np.log(half) - np.array([math.lgamma(x + 1) for x in steps])
        top = logs.max(axis=1, initial=-np.inf)
        safe = np.where(np.isfinite(top), top, 0.0)
        total = np.exp(safe) * np.exp(logs - safe[:, None]).sum(axis=1)
        if d % 2:
            total += np.array([math.erfc(math.sqrt(h)) for h in half[:, 0]])
        out[at] = np.minimum(total, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def poisson_p(x: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(poisson_two_sided(x.to_numpy(), rate.to_numpy()))


@F.pandas_udf(T.DoubleType())
def binomial_p(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_upper(x.to_numpy(), n.to_numpy(), p.to_numpy()))


@F.pandas_udf(T.DoubleType())
def chi_square_p(score: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi_square_upper(score.to_numpy(), df.to_numpy()))


def pair_order(k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second slot (from 0) of every pair over k alleles and the null allele, by (second, first)."""
    second = np.repeat(np.arange(k + 1), np.arange(1, k + 2))
    first = np.concatenate([np.arange(r + 1) for r in range(k + 1)])
    return first, second


def likelihoods(reads: np.ndarray, total: np.ndarray, expected: np.ndarray, bias: np.ndarray, eps: np.ndarray) -> np.ndarray:
    """Log-likelihood of every pair for people (rows) at loci with the same number of alleles (columns).

    One copy of an allele expects ``expected * bias`` reads, two copies twice that, the null allele none; reads on
    other alleles are binomial errors.
    """
    rows, k = reads.shape
    lf = log_factorials(int(total.max(initial=0)))
    own = expected[:, None] * bias
    fixed = lf[reads]
    null = np.zeros((rows, 1))
    single = np.hstack([reads * np.log(own) - own - fixed, null])
    double = np.hstack([reads * np.log(2 * own) - 2 * own - fixed, null])
    seen = np.hstack([reads, np.zeros((rows, 1), np.int64)])
    first, second = pair_order(k)
    het = first != second
    good = seen[:, first] + np.where(het, seen[:, second], 0)
    errors = total[:, None] - good
    noise = lf[total][:, None] - lf[errors] - lf[good] + errors * np.log(eps)[:, None] + good * np.log(np.maximum(1 - eps, 1e-300))[:, None]
    return np.where(het, single[:, first] + single[:, second], double[:, first]) + noise


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pair_log_likelihood(n: pd.Series, total: pd.Series, expected: pd.Series, bias: pd.Series, eps: pd.Series) -> pd.Series:
    sizes = n.map(len).to_numpy()
    out = np.empty(len(n), object)
    for k in np.unique(sizes):
        at = np.flatnonzero(sizes == k)
        step = max(1, _CELLS // ((k + 1) * (k + 2) // 2))
        for lo in range(0, len(at), step):
            rows = at[lo : lo + step]
            table = likelihoods(
                np.stack(n.iloc[rows].to_list()).astype(np.int64), total.iloc[rows].to_numpy(np.int64), expected.iloc[rows].to_numpy(float),
                np.stack(bias.iloc[rows].to_list()).astype(float), eps.iloc[rows].to_numpy(float),
            )
            for row, values in zip(rows, table):
                out[row] = values
    return pd.Series(out)


SUM_COLUMNS = ["people", "member", "err_sum", "tot_sum", "num1", "den1", "num2", "den2", "score"]


def locus_sums(reads, total, expected, weight, bias, eps) -> dict[str, np.ndarray]:
    """Membership sums per pair over the people of one locus in one batch (weights, biases and error rate are the locus's)."""
    rows, k = reads.shape
    ll = likelihoods(reads, total, expected, np.broadcast_to(bias, (rows, k)), np.full(rows, eps))
    raw = weight * np.exp(ll)
    z = raw.sum(axis=1, keepdims=True)
    first, second = pair_order(k)
    null_only = (first == k).astype(float)
    p = np.where(z > 0, raw / np.where(z > 0, z, 1), null_only)
    seen = np.hstack([reads, np.zeros((rows, 1), np.int64)])
    het = (first != second) & (second < k)
    copies = np.where(first == k, 0, np.where(first == second, 2, 1))
    a1, a2 = seen[:, first], np.where(het, seen[:, second], 0)
    return {
        "people": np.full(len(first), float(rows)), "member": p.sum(axis=0), "err_sum": (p * (total[:, None] - a1 - a2)).sum(axis=0), "tot_sum": p.T @ total,
        "num1": (p * a1).sum(axis=0), "den1": copies * (p.T @ expected), "num2": (p * a2).sum(axis=0), "den2": het * (p.T @ expected),
        "score": np.where(weight > 0, weight * ll, 0.0).sum(axis=0),
    }


def block_sums(reads, total, expected, weight, bias, eps) -> dict[str, np.ndarray]:
    """``locus_sums`` of a block of people, worked off in steps of bounded size."""
    step = max(1, _CELLS // len(weight))
    sums: dict[str, np.ndarray] = {}
    for lo in range(0, len(total), step):
        part = locus_sums(reads[lo : lo + step], total[lo : lo + step], expected[lo : lo + step], weight, bias, eps)
        sums = part if not sums else {c: sums[c] + part[c] for c in SUM_COLUMNS}
    return sums


def block_calls(reads, total, expected, weight, bias_used, eps_used, bias, eps) -> dict[str, np.ndarray]:
    """Genotype call of every person of a block: likeliest pair (first of equals), its coverage, null mass, and exact fits.

    Memberships use the parameters of the last expectation step, expected reads and errors the newest ones.
    """
    k = reads.shape[1]
    first, second = pair_order(k)
    step = max(1, _CELLS // len(first))
    parts = []
    for lo in range(0, len(total), step):
        r, t, e = reads[lo : lo + step], total[lo : lo + step], expected[lo : lo + step]
        raw = weight * np.exp(likelihoods(r, t, e, np.broadcast_to(bias_used, (len(t), k)), np.full(len(t), eps_used)))
        z = raw.sum(axis=1, keepdims=True)
        p = np.where(z > 0, raw / np.where(z > 0, z, 1), (first == k).astype(float))
        best = np.floor(p * 10**TIE_DIGITS + 0.5).argmax(axis=1)
        parts.append((best, p.max(axis=1), p[:, second == k].sum(axis=1)))
    best, confidence, p_null = (np.concatenate(x) for x in zip(*parts))
    one, two = first[best], second[best]
    het = (one < two) & (two < k)
    seen = np.hstack([reads, np.zeros((len(total), 1), np.int64)])
    people = np.arange(len(total))
    a1, a2 = seen[people, one], np.where(het, seen[people, two], 0)
    copies = np.where(one == k, 0, np.where(one == two, 2, 1))
    biased = np.append(bias, 1.0)
    rate1, rate2 = copies * expected * biased[one], het * expected * biased[two]
    rest = total - a1 - a2
    fit = poisson_two_sided(a1, rate1) * poisson_two_sided(a2, rate2)
    noise = np.where(total > 0, binomial_upper(rest, total, np.full(len(total), eps)), 0.0)
    return {"first": one, "second": two, "confidence": confidence, "p_null": p_null, "a1": a1, "a2": a2, "rest": rest, "allele_fit": fit, "noise_fit": noise}


def obedience(mother: np.ndarray, father: np.ndarray, child: np.ndarray, holds: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Chance that the child inherits one allele of each parent; see the family operators for the closed form."""
    m, f = mother @ holds, father @ holds
    both = m[:, first] * f[:, second] + m[:, second] * f[:, first] - mother * father
    return (child * np.where(first == second, m[:, first] * f[:, first], both)).sum(axis=1)


def trio_table(mother: np.ndarray, father: np.ndarray, child: np.ndarray, k: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Obedience and kinship of trios (rows) at loci with ``k`` alleles, over the ``most`` commonest alleles of each trio."""
    first, second = pair_order(k)
    slots = np.zeros((len(first), k + 1))
    np.add.at(slots, (np.arange(len(first)), first), 0.5)
    np.add.at(slots, (np.arange(len(first)), second), 0.5)
    if most is not None and most < k + 1:
        share = np.round((mother + father + child) @ slots / 3, 9)
        top = np.argsort(-share, axis=1, kind="stable")[:, :most]
        allowed = np.zeros(share.shape, bool)
        np.put_along_axis(allowed, top, True, axis=1)
        keep = allowed[:, first] & allowed[:, second]
        mother, father, child = mother * keep, father * keep, child * keep
    holds = (slots > 0).astype(float)
    swaps = obedience(child, father, mother, holds, first, second), obedience(mother, child, father, holds, first, second)
    return obedience(mother, father, child, holds, first, second), np.maximum(*swaps)


def trio_udf(most: int | None):
    """Arrow UDF over the membership arrays of a trio; null where a member is missing."""

    @F.pandas_udf(T.StructType([T.StructField("obedience", T.DoubleType()), T.StructField("kinship", T.DoubleType())]))
    def score(k: pd.Series, mother: pd.Series, father: pd.Series, child: pd.Series) -> pd.DataFrame:
        out = np.full((len(k), 2), np.nan)
        whole = (mother.notna() & father.notna() & child.notna()).to_numpy()
        sizes = k.to_numpy()
        for size in np.unique(sizes[whole]):
            at = np.flatnonzero(whole & (sizes == size))
            step = max(1, _CELLS // ((size + 1) * (size + 2) // 2))
            for lo in range(0, len(at), step):
                rows = at[lo : lo + step]
                out[rows, 0], out[rows, 1] = trio_table(*[np.stack(m.iloc[rows].to_list()) for m in (mother, father, child)], int(size), most)
        table = pd.DataFrame(out, columns=["obedience", "kinship"]).astype(object)
        return table.where(pd.notna(table), None)

    return score
