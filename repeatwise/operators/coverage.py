"""Coverage model: expected coverage per allele from a low-rank fit of the locus by person matrix.

The matrix is never dense and never leaves the executors. Its leading right singular vectors come from block Krylov
iteration written as joins and sums over the long table: multiply by the person vectors, sum per locus, multiply
back, sum per person. Only a matrix of the size of the basis (``MAX_BASIS`` at most, both ways) visits the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbering import number_rows
from ..session import written

MAX_COMPONENTS = 30


def person_totals(allele_cov: DataFrame) -> DataFrame:
    return allele_cov.groupBy("person_id").agg(F.sum("n").alias("total"))


def person_means(allele_cov: DataFrame, n_loci: int) -> DataFrame:
    """Mean locus coverage; loci without reads count as zero."""
    return allele_cov.groupBy("person_id").agg((F.sum("n") / F.lit(n_loci)).alias("mean_cov"))


def per_allele(allele_cov: DataFrame) -> DataFrame:
    """Locus coverage divided by two: the coverage one allele should have."""
    return allele_cov.groupBy("locus_id", "person_id").agg((F.sum("n") / 2.0).alias("cov"))


def _vec(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(k)]


def _product(cov: DataFrame, vectors: DataFrame, key: str, other: str, k: int, out: str = "v") -> DataFrame:
    """Rows ``other, out0..``: the matrix times the vectors ``key, v0..``."""
    return cov.join(vectors, key).groupBy(other).agg(*[F.sum(F.col("cov") * F.col(v)).alias(y) for v, y in zip(_vec("v", k), _vec(out, k))])


def _apply(cov: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Rows ``locus_id, y0..`` of A V for the person table ``person_id, v0..``."""
    return _product(cov, vectors, "person_id", "locus_id", k, "y")


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)


def _gram(table: DataFrame, names: list[str]) -> np.ndarray:
    """Small Gram matrix of the named columns: every task adds up its outer products, the entries are summed by a shuffle."""
    k = len(names)

    def outer(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, names)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    cells = table.select(*[F.col(n).cast("double").alias(n) for n in names]).mapInArrow(outer, "cell int, value double")
    out = np.zeros(k * k)
    for cell, value in cells.groupBy("cell").agg(F.sum("value")).collect():  # k x k numbers
        out[cell] = value
    return out.reshape(k, k)


def _rotate(table: DataFrame, key: str, names: list[str], matrix: np.ndarray, out: list[str]) -> DataFrame:
    """New columns = old columns times a small matrix; columns of ``table`` that are not named stay beside them."""
    rest = [c for c in table.columns if c not in {key, *names, *out}]

    def turn(batches):
        for batch in batches:
            x = _matrix(batch, names) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(key), *[batch.column(c) for c in rest], *[pa.array(x[:, j]) for j in range(len(out))]], [key, *rest, *out])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, *rest, *names).mapInArrow(turn, ", ".join([f"{key} {kind}", *[f"{n} double" for n in [*rest, *out]]]))


def _whitening(gram: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Small matrix that makes columns with this Gram matrix orthonormal; directions lost to rank, or no longer than ``least``, are dropped."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    kept = (values > max(values[0], 1e-300) * 1e-12) & (values > least * least)
    return vectors[:, kept] / np.sqrt(values[kept])


MAX_BASIS = 160  # columns of the basis before it is put together anew
LOST = 1e-6  # squared singular values below this share of the largest are lost to rank


def singular_vectors(cov: DataFrame, k: int, extra: int = 8, tolerance: float = 1e-9, rounds: int = 200, seed: int = 7) -> tuple[DataFrame, np.ndarray, float]:
    """Leading ``k`` right singular vectors (``person_id, v0..``), singular values of the long matrix ``cov``, and the residual.

    Block Krylov iteration in the space of loci or of people, whichever are fewer: every round multiplies the newest block forth and back,
    adds what is new to an orthonormal basis, and takes the values of the matrix over the whole basis. The basis holds the space after
    at most its dimension over the block size rounds, whatever the gaps between the values; a basis of ``MAX_BASIS`` columns begins anew from its
    leading vectors. Rounds go on until no leading value moves by more than ``tolerance`` of the largest; the residual is the last such move, 0 when
    nothing new is left. A matrix that has not settled after ``rounds`` is an error.
    """
    cov = cov.filter(F.col("locus_id").isNotNull() & F.col("person_id").isNotNull())
    cov = written(cov.select("locus_id", "person_id", F.col("cov").cast("double").alias("cov")), "cov")  # read twice per round
    n_people, n_loci = cov.select(F.count_distinct("person_id"), F.count_distinct("locus_id")).first()
    key, other = ("locus_id", "person_id") if n_loci < n_people else ("person_id", "locus_id")
    size = min(k + extra, n_people, n_loci)
    start = [(F.pmod(F.xxhash64(F.lit(seed + j), key), F.lit(2000003)) / 1000001.5 - 1).alias(f"v{j}") for j in range(size)]
    block = written(cov.select(key).distinct().select(key, *start), "v")
    turn = _whitening(_gram(block, _vec("v", size)))
    block, new = _rotate(block, key, _vec("v", size), turn, _vec("v", turn.shape[1])), turn.shape[1]
    basis, m = None, 0  # key, q0.. (orthonormal), w0.. (each multiplied forth and back)
    last, residual = np.zeros(0), np.inf
    for _ in range(rounds):
        block = written(block, "v")
        image = _product(cov, _product(cov, block, key, other, new), other, key, new, "x")
        added = block.join(image, key).select(key, *[F.col(f"v{j}").alias(f"q{m + j}") for j in range(new)], *[F.col(f"x{j}").alias(f"w{m + j}") for j in range(new)])
        basis = written(added if basis is None else basis.join(added, key), "basis")
        m += new
        gram = _gram(basis, _vec("q", m) + _vec("w", m))
        white = _whitening(gram[:m, :m])
        within = white.T @ gram[:m, m:] @ white
        squares, turn = np.linalg.eigh((within + within.T) / 2)
        order = np.argsort(squares)[::-1]
        squares, turn = np.maximum(squares[order], 0), white @ turn[:, order]
        lead = squares[:k][squares[:k] > squares[0] * LOST]
        found = np.sqrt(lead)
        if len(found) == len(last):
            residual = float(np.abs(found - last).max() / max(found[0], 1e-300))
        last = found
        if residual <= tolerance:
            break
        # what the newest images add to the basis, made orthogonal to it twice
        names = _vec("q", m) + _vec("x", new)
        away = np.vstack([-white @ white.T @ gram[:m, 2 * m - new:], np.eye(new)])
        rest = basis.select(key, *_vec("q", m), *[F.col(f"w{m - new + j}").alias(f"x{j}") for j in range(new)])
        rest = _rotate(rest, key, names, np.hstack([np.eye(m + new)[:, :m], away]), names)
        twice = _gram(rest, names)
        again = np.vstack([-white @ white.T @ twice[:m, m:], np.eye(new)])
        turned = _whitening(again.T @ twice @ again, squares[0] * 1e-11)
        if not turned.shape[1]:
            residual = 0.0
            break
        if m + turned.shape[1] > MAX_BASIS and m > size:
            top = min(size, turn.shape[1])
            block, new, basis, m = _rotate(basis.select(key, *_vec("q", m)), key, _vec("q", m), turn[:, :top], _vec("v", top)), top, None, 0
        else:
            new = turned.shape[1]
            block = _rotate(rest, key, names, again @ turned, _vec("v", new))
    else:
        raise RuntimeError(f"the singular values still move by {residual:.1e} after {rounds} rounds")
    size = len(last)
    vectors = written(_rotate(basis.select(key, *_vec("q", m)), key, _vec("q", m), turn[:, :size], _vec("v", size)), "v")
    if key == "locus_id":
        longer = _product(cov, vectors, key, other, size)
        vectors = written(longer.select(other, *[(F.col(f"v{j}") / F.lit(float(last[j]))).alias(f"v{j}") for j in range(size)]), "v")
    return vectors, last, residual


def singular_values(cov: DataFrame, k: int) -> DataFrame:
    """``component, singular_value`` from the fitted vectors: the length of the matrix along each."""
    vectors, values, _ = singular_vectors(cov, k)
    size = len(values)
    lengths = _apply(cov, vectors, size).select(F.posexplode(F.array(*_vec("y", size))).alias("component", "y"))
    return lengths.groupBy((F.col("component") + 1).alias("component")).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("singular_value"))


def numbered_cells(cov: DataFrame) -> DataFrame:
    """Cells with a dense number ``cell``, stored."""
    return written(number_rows(cov.select("locus_id", "person_id", "cov"), ["locus_id", "person_id"], "cell"), "cells")


def resampled(cov: DataFrame, seed: int, cells: DataFrame | None = None) -> DataFrame:
    """Matrix of the same shape whose cells are drawn with replacement from the cells of ``cov``.

    Cells are numbered densely and every cell draws the number of the cell whose value it takes. Deterministic for a seed.
    Several draws share the numbered ``cells``.
    """
    cells = numbered_cells(cov) if cells is None else cells
    n = cells.count()
    drawn = cells.select("locus_id", "person_id", F.pmod(F.xxhash64(F.lit(seed), "cell"), F.lit(n)).alias("cell"))
    return drawn.join(cells.select("cell", "cov"), "cell").select("locus_id", "person_id", "cov")


def choose_components(cov: DataFrame, draws: int = 5, most: int = MAX_COMPONENTS) -> int:
    """Largest k whose singular value beats the same value of every resampled matrix; at least 1."""
    cov = written(cov, "cov")
    cells = numbered_cells(cov)
    _, observed, _ = singular_vectors(cov, most, tolerance=1e-4)
    beats = np.ones(len(observed), bool)
    for seed in range(draws):
        _, random, _ = singular_vectors(resampled(cov, seed, cells), most, tolerance=1e-4)
        size = min(len(observed), len(random))
        beats[:size] &= observed[:size] > random[:size]
    hits = np.flatnonzero(beats)
    return int(hits[-1]) + 1 if len(hits) else 1


SIDE = 256  # people, or loci, of a block about; the product is made for each pair of blocks
PAIRS = 64  # pairs of blocks that a task makes at most, about


def _product_rows(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """``locus_id, person_id, raw``: the rows ``locus_id, y0..`` times the rows ``person_id, v0..``.

    A block of people is packed once and copied for each block of loci only, so copies grow with the result over ``SIDE``. The packed side is far
    larger than its file and would be taken for one to broadcast, so the pairs are merged and dealt to a number of tasks that grows with them.
    """
    loci, people = (max(1, -(-df.count() // SIDE)) for df in (left, right))
    pairs = loci * people
    tasks = min(pairs, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    listed = right.select(F.struct("person_id", F.array(*_vec("v", size)).alias("v")).alias("p"))
    packed = listed.groupBy(dealt("p.person_id", people).alias("block")).agg(F.collect_list("p").alias("ps")).select("block", "ps", every(loci).alias("loci"))
    keyed = left.select("locus_id", F.array(*_vec("y", size)).alias("y"), dealt("locus_id", loci).alias("loci"), every(people).alias("block"))
    both = keyed.repartition(tasks, "loci", "block").hint("merge").join(packed.repartition(tasks, "loci", "block"), ["loci", "block"])
    dot = F.aggregate(F.zip_with("y", F.col("p.v"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return both.select("locus_id", "y", F.explode("ps").alias("p")).select("locus_id", "p.person_id", dot.alias("raw"))


def expected_coverage(cov: DataFrame, k: int) -> DataFrame:
    """Rank-k expected coverage for every (locus, person): project locus rows on V_k and multiply back.

    Negative values become the smallest positive one.
    """
    cov = written(cov, "cov")
    vectors, values, _ = singular_vectors(cov, k)
    size = len(values)
    left = written(_apply(cov, vectors, size), "left")  # counted and read
    wide = written(_product_rows(left, vectors, size), "expected")
    floor = wide.filter("raw > 0").agg(F.min("raw")).first()[0]
    return wide.select("locus_id", "person_id", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("exp_cov"))


def fit(cov: DataFrame, expected: DataFrame) -> DataFrame:
    """Overall correlation and root mean square error."""
    both = cov.join(expected, ["locus_id", "person_id"])
    return both.agg(F.corr("cov", "exp_cov").alias("corr"), F.sqrt(F.avg((F.col("exp_cov") - F.col("cov")) * (F.col("exp_cov") - F.col("cov")))).alias("rmse"))


def person_fit(cov: DataFrame, expected: DataFrame) -> DataFrame:
    """Correlation per person, for people with coverage."""
    both = cov.join(expected, ["locus_id", "person_id"])
    return both.groupBy("person_id").agg(F.corr("cov", "exp_cov").alias("corr"), F.sum("cov").alias("total")).filter("total > 0").drop("total")


def low_coverage_people(totals: DataFrame) -> DataFrame:
    """People whose total is below mean - 2 sd; the two scalars are read once."""
    mean, sd = totals.agg(F.avg("total"), F.stddev_samp("total")).first()
    limit = mean - 2 * sd if sd is not None else float("-inf")
    return totals.filter(F.col("total") < limit)


def poor_fit_people(fits: DataFrame, least: float = 0.8) -> DataFrame:
    return fits.filter(F.col("corr") < least)


def observed_over_expected(allele_cov: DataFrame, expected: DataFrame) -> DataFrame:
    return allele_cov.join(expected, ["locus_id", "person_id"]).withColumn("ratio", F.col("n") / F.col("exp_cov"))


def binned(df: DataFrame, value: Column, step: float, name: str = "bin") -> DataFrame:
    """Histogram with relative counts; bins are integers ``floor(value / step)``."""
    counts = df.groupBy(F.floor(value / F.lit(step)).cast("long").alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.withColumn("share", F.col("n") / F.lit(total))
