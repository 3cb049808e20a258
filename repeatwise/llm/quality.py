"""Quality rules by robust multivariate outliers; only DataFrame functions run here.

Each text gives a vector of transformed statistics. For every (language, source) a minimum-covariance-determinant estimate of
mean and covariance is found by concentration steps, and texts far from it in Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import word_array

SYMBOLS = "#*$%&|<>"
#: Transformed statistics. Length comes first: the verdict uses the distance of the others given the length.
FEATURES = ["ln_words", "ln_word_length", "root_symbols", "root_dup_lines", "root_repeats"]
#: Least spread of each statistic, so that one that hardly varies in a group rejects nobody for a trifle. With the default tail each
#: judged statistic can reject alone: about a third of repeated words or duplicate lines, or 4% symbols, in a group without any.
LEAST_SPREAD = [0.3, 0.1, 0.04, 0.12, 0.12]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
P = len(FEATURES)
BINS = 32  # of distances, for each factor of e
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def normal_quantile(p: float) -> float:
    low, high = -12.0, 12.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def chi_square_quantile(p: float, df: int) -> float:
    """Wilson-Hilferty approximation."""
    a = 2 / (9 * df)
    return df * (1 - a + normal_quantile(p) * math.sqrt(a)) ** 3


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of each whole text (null: all 0).

    ``n_lines`` counts lines with a word, ``n_dup_lines`` those equal to an earlier line; ``n_repeat_words`` counts words inside
    3-word windows that occur twice or more in the text. Windows are compared by a 64-bit hash within one text.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    df = df.withColumns({"_words": word_array(F.col(text)), "_lines": lines})
    w, n = F.col("_words"), F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("_windows", F.when(n >= 3, F.sort_array(windows)))
    s = F.col("_windows")
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    df = df.withColumn("_found", F.sort_array(F.transform(twice, lambda x: x["i"])))
    found = F.col("_found")
    covered = F.aggregate(
        F.transform(found, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(found, k - 1)))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(plain, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("_words", "_lines", "_windows", "_found")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "ln_words": F.log(n.cast("double")),
        "ln_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "root_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "root_dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "root_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def _factored(model: DataFrame, keys: list[str], floor: float = 1.0) -> DataFrame:
    """Means and the Cholesky factor of each covariance (``c<i><j>``), with ``floor`` times the squared least spreads added to the diagonal."""
    for i in range(P):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}") + F.lit(floor * LEAST_SPREAD[i] ** 2 if i == j else 0.0))
            model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(LEAST_SPREAD[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = reduce(lambda a, i: a + 2 * F.log(F.col(f"l{i}{i}")), range(P), F.lit(0.0))
    return model.select(*keys, "n", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], log_det.alias("log_det"))


#: Mean and spread of each statistic that hold where there are no texts to learn from: wide enough that nothing is rejected.
PRIOR = ((5.7, 1.7, 0.1, 0.1, 0.3), (1.5, 1.0, 0.4, 0.5, 0.5))
#: Distinct vectors with which the estimate of a group weighs as much as what it is drawn to.
PRIOR_ROWS = 200


def _moments(models: DataFrame, level: int) -> DataFrame:
    """Means and scaled covariances of the estimates, with columns named for their level."""
    cov = {(i, j): F.col("scale") * reduce(lambda a, k: a + F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(1, j + 1), F.col(f"l{i}0") * F.col(f"l{j}0")) for i, j in PAIRS}
    return models.select(F.col("stratum").alias(f"stratum{level}"), F.col("n").alias(f"n{level}"), *[F.col(f"m{i}").alias(f"m{i}_{level}") for i in range(P)], *[c.alias(f"c{i}{j}_{level}") for (i, j), c in cov.items()])


def drawn_together(places: DataFrame, models: DataFrame, prior_rows: int) -> DataFrame:
    """Estimates ``m<i>``, ``l<i><j>`` for each row of ``places`` (``stratum0, stratum1, ...`` from the narrowest group to all texts).

    The moments of a group are mixed with those of the next wider one, mixed before in the same way, and those of all texts with ``PRIOR``. A
    group of ``n`` distinct vectors has the weight ``n^2 / (n^2 + prior_rows^2)``, which goes smoothly with its size.
    """
    levels = sum(c.startswith("stratum") for c in places.columns)
    for level in range(levels):
        places = places.join(_moments(models, level), f"stratum{level}")
    wide = {f"m{i}": F.lit(PRIOR[0][i]) for i in range(P)} | {f"c{i}{j}": F.lit(PRIOR[1][i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    for level in reversed(range(levels)):
        own = F.col(f"n{level}") * F.col(f"n{level}") / (F.col(f"n{level}") * F.col(f"n{level}") + float(prior_rows) ** 2)
        places = places.withColumn("_own", own).withColumns({f"_{k}": c for k, c in wide.items()})
        apart = {i: F.col(f"m{i}_{level}") - F.col(f"_m{i}") for i in range(P)}
        mixed = {f"m{i}": F.col("_own") * F.col(f"m{i}_{level}") + (1 - F.col("_own")) * F.col(f"_m{i}") for i in range(P)}
        mixed |= {f"c{i}{j}": F.col("_own") * F.col(f"c{i}{j}_{level}") + (1 - F.col("_own")) * F.col(f"_c{i}{j}") + F.col("_own") * (1 - F.col("_own")) * apart[i] * apart[j] for i, j in PAIRS}
        places = places.withColumns(mixed)
        wide = {k: F.col(k) for k in wide}
    keys = [c for c in places.columns if c in ("_lang", "_source")]
    return _factored(places.withColumn("n", F.col("n0")), keys, floor=0.0).drop("n", "log_det")


def _scores(df: DataFrame) -> DataFrame:
    """Add ``y0..``: the vector with the mean taken off and the Cholesky factor divided out."""
    for i in range(P):
        df = df.withColumn(f"y{i}", reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(FEATURES[i]) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return df


def _squares(first: int) -> Column:
    return reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(first, P), F.lit(0.0))


def _bin(square: Column) -> Column:
    return F.floor(F.log(F.greatest(square, F.lit(1e-6))) * BINS).cast("int")


def _quantile_bins(counts: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """Smallest bin of each key up to which at least ``share`` of the counts lie."""
    upto = Window.partitionBy(*keys).orderBy("bin")
    every = Window.partitionBy(*keys)
    run = counts.withColumns({"upto": F.sum("n").over(upto), "every": F.sum("n").over(every)})
    return run.filter(F.col("upto") >= F.ceil(F.col("every") * share)).groupBy(*keys).agg(F.min("bin").alias(name))


def _starts(vectors: DataFrame) -> DataFrame:
    """Two deterministic starts of each stratum: medians with quartile spreads, without and with the correlations of squashed values."""
    long = vectors.select("stratum", F.posexplode(F.array(*[F.floor(F.col(f) * 512).cast("int") for f in FEATURES])).alias("i", "bin"))
    counts = written(long.groupBy("stratum", "i", "bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    low, mid, high = (_quantile_bins(counts, ["stratum", "i"], share, name) for share, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high")))
    spread = low.join(mid, ["stratum", "i"]).join(high, ["stratum", "i"]).groupBy("stratum").agg(
        *[F.max(F.when(F.col("i") == i, (F.col("mid") + 0.5) / 512)).alias(f"m{i}") for i in range(P)],
        *[F.max(F.when(F.col("i") == i, F.greatest((F.col("high") - F.col("low")) / 512 / 1.349, F.lit(LEAST_SPREAD[i] / 2)))).alias(f"s{i}") for i in range(P)],
    )
    spread = _small(spread, "spreads")
    squashed = vectors.join(spread, "stratum").select("stratum", *[F.tanh((F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"t{i}") for i, f in enumerate(FEATURES)])
    corr = squashed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.try_divide(F.covar_pop(f"t{i}", f"t{j}"), F.stddev_pop(f"t{i}") * F.stddev_pop(f"t{j}")), F.lit(0.0)).alias(f"r{i}{j}") for i, j in PAIRS if i != j])
    both = spread.join(corr, "stratum").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    cov = {f"c{i}{j}": F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else F.when(F.col("start") == 1, F.col(f"r{i}{j}") * 0.95).otherwise(0.0)) for i, j in PAIRS}
    return _factored(both.withColumns(cov), ["stratum", "start"])


def _concentrate(vectors: DataFrame, model: DataFrame, coverage: float) -> DataFrame:
    """One concentration step: moments of the ``coverage`` share of vectors nearest to the present estimate."""
    scored = _scores(vectors.join(model.drop("n"), "stratum")).withColumn("bin", _bin(_squares(0)))
    sums = scored.groupBy("stratum", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"a{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"b{i}{j}") for i, j in PAIRS]
    )
    keys = ["stratum", "start"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumns({"before": before, "every": F.sum("n").over(Window.partitionBy(*keys))}).filter(F.col("before") < F.col("every") * coverage)
    moments = near.groupBy(*keys).agg(
        F.max("every").alias("n"), F.sum("n").alias("k"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(P)], *[F.sum(f"b{i}{j}").alias(f"b{i}{j}") for i, j in PAIRS]
    )
    moments = moments.withColumns({f"m{i}": F.col(f"a{i}") / F.col("k") for i in range(P)})
    return _factored(moments.withColumns({f"c{i}{j}": F.col(f"b{i}{j}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS}), keys)


def _small(df: DataFrame, label: str) -> DataFrame:
    """A table with a row or two for each stratum, written in a few files: its size on disk then says that it may be broadcast,
    and the vectors of a large stratum need not meet in one task to be joined with it."""
    return written(df.coalesce(8), label)


def robust_estimates(vectors: DataFrame, coverage: float = 0.75, steps: int = 6) -> DataFrame:
    """Minimum-covariance-determinant estimate of every ``stratum``: means ``m<i>``, Cholesky factor ``l<i><j>``, ``n`` and ``scale``.

    ``vectors`` holds distinct statistic vectors. Distances are binned (``BINS`` for each factor of e), so a step is one
    aggregation whose state is bounded, whatever share of the rows a stratum holds. Of the two starts the one with the smaller
    determinant stays; ``scale`` (1 or more, as the nearest vectors spread less than all) makes the median squared distance that of a chi-square.
    """
    model = _small(_starts(vectors), "start")
    for step in range(steps):
        model = _small(_concentrate(vectors, model, coverage), f"step{step}")
    best = model.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("log_det", "start"))).filter("place = 1").drop("place", "start")
    best = _small(best, "best")
    scored = _scores(vectors.join(best.drop("n"), "stratum")).select("stratum", _bin(_squares(1)).alias("bin"))
    middle = _quantile_bins(scored.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")), ["stratum"], 0.5, "middle")
    scale = F.greatest(F.exp((F.col("middle") + 0.5) / BINS) / F.lit(chi_square_quantile(0.5, P - 1)), F.lit(1.0))
    return best.join(middle, "stratum").withColumn("scale", scale).drop("middle")


def quality_verdicts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", coverage: float = 0.75, prior_rows: int = PRIOR_ROWS, tail: float = 1e-4, carry: list[str] | None = None) -> DataFrame:
    """``df`` with its statistics, ``base_failed``, ``distance`` (robust, squared, null if the base rules failed) and ``kept``.

    A text that fails the base rules is rejected. Others are judged by the estimate of their (language, source), drawn towards that of their
    language and that towards all texts (see ``drawn_together``): the fewer distinct vectors a group has, the more, without a step at any
    size. Rejected is a text whose distance given its length exceeds the chi-square quantile that leaves ``tail``. Each distinct
    vector counts once, so copies do not pull an estimate. Null languages and sources are values of their own, null and empty texts
    fail the base rules, repeated rows get equal verdicts, empty tables give no rows; texts count whole, however long. Texts are read once:
    the columns to ``carry`` (default: all) and the statistics are written to the shared folder. Columns of ``df`` named as a result column or
    starting with ``_`` are replaced.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = statistics(df, text).withColumns(transformed()).withColumns({"base_failed": base_failed(), "_lang": known(lang), "_source": known(source)})
    if carry is not None:
        rows = rows.select(*carry, *STATISTICS, *FEATURES, "base_failed", "_lang", "_source")
    rows = written(rows, "statistics")
    levels = F.array(F.concat_ws(" ", F.lit("source"), "_lang", "_source"), F.concat_ws(" ", F.lit("lang"), "_lang"), F.lit("all"))
    vectors = rows.filter(~F.col("base_failed")).select(F.explode(levels).alias("stratum"), *FEATURES).distinct()
    vectors = written(vectors, "vectors")
    models = _small(robust_estimates(vectors, coverage), "estimates")
    places = rows.filter(~F.col("base_failed")).select("_lang", "_source").distinct().select("_lang", "_source", *[levels[i].alias(f"stratum{i}") for i in range(3)])
    chosen = _small(drawn_together(_small(places, "places"), models, prior_rows), "chosen")
    judged = _scores(rows.join(chosen, ["_lang", "_source"], "left"))
    distance = F.when(~F.col("base_failed"), _squares(1))
    judged = judged.withColumn("distance", distance)
    limit = chi_square_quantile(1 - tail, P - 1)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)
    return judged.withColumn("kept", kept).drop("_lang", "_source", *FEATURES, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], *[f"y{i}" for i in range(P)])


def kept_documents(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``df`` that the rules keep, with all their columns."""
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df[text].alias("text"), df[lang].alias("lang"), df[source].alias("source"))
    return quality_verdicts(whole, carry=["_row"]).filter("kept").select("_row.*")
