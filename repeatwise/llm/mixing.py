"""Mixing sources to target weights by entropy balancing.

Each document gets a rate in (0, cap) that stays as close to 1 as the token constraints of the sources allow (least relative
entropy). The dual of that problem has one multiplier per source, and its solution is the exponential tilt
``rate = cap * sigmoid(offset + multiplier * size / mean size)``. Newton steps solve the dual; each step is one aggregation over
the distinct (source, size) cells. Rates are then rounded to whole copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .common import identified, ranked, word_array

MAX_STEPS = 200


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources from ``stratum, source, n_docs, source_size``.

    Sources in order of code points, null last, take the weights in turn and divide ``share`` of all sizes among them; a target
    stops at ``cap`` times its source's size and the excess goes to the others by weight. The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    everything = Window.partitionBy()
    wide = sizes.withColumn("weight", weight).withColumns({
        "limit": F.col("source_size") * F.lit(cap),
        "wanted": F.sum("source_size").over(everything) * F.lit(share),
        "all_weight": F.sum("weight").over(everything),
    })
    before = Window.orderBy(F.col("limit") / F.col("weight"), "stratum").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumns({
        "limit_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    full = F.col("limit") * (F.col("all_weight") - F.col("weight_before")) <= (F.col("wanted") - F.col("limit_before")) * F.col("weight")
    wide = wide.withColumn("full", full)
    left = F.col("wanted") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    weight_left = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.try_divide(F.col("weight") * left, weight_left))
    return wide.select("stratum", "n_docs", "source_size", target.alias("target"), "full")


def _rate(multiplier, size, mean, cap: float):
    offset = -F.log(F.lit(cap - 1.0))
    return F.lit(cap) / (1 + F.exp(-(offset + multiplier * size / mean)))


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-7) -> DataFrame:
    """Multipliers of the sources: ``stratum, multiplier, mean_size, full`` plus the columns of ``targets``.

    Damped Newton: a step that leaves the bracket of the root is replaced by its middle, or by a doubled step while one side is open.
    """
    state = written(
        targets.withColumns({
            "mean_size": F.greatest(F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)), F.lit(1.0)),
            "multiplier": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"),
            "settled": F.col("full") | (F.col("target") <= 0),
        }), "dual")
    for step in range(MAX_STEPS):
        if state.filter(~F.col("settled")).isEmpty():
            return state
        open_ones = state.filter(~F.col("settled"))
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean_size"), cap)
        sums = cells.join(open_ones.select("stratum", "multiplier", "mean_size"), "stratum").groupBy("stratum").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean_size") * rate * (1 - rate / cap)).alias("slope"),
        )
        m, gap = F.col("multiplier"), F.col("target") - F.col("taken")
        low = F.when(gap > 0, m).otherwise(F.col("low"))
        high = F.when(gap <= 0, m).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, m + gap / F.col("slope"))
        wide = F.when(gap > 0, F.greatest(m * 2, m + 4)).otherwise(F.least(m * 2, m - 4))
        inside = (newton > F.coalesce(low, newton - 1)) & (newton < F.coalesce(high, newton + 1)) & (F.abs(newton - m) <= F.abs(wide - m))
        middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(wide)
        near = F.abs(gap) <= F.col("target") * tolerance
        moved = state.join(sums, "stratum", "left").select(
            "stratum", "n_docs", "source_size", "target", "full", "mean_size",
            F.when(F.col("settled") | near, m).when(inside, newton).otherwise(middle).alias("multiplier"),
            F.when(F.col("settled"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("settled"), F.col("high")).otherwise(high).alias("high"),
            (F.col("settled") | near).alias("settled"),
        )
        state = written(moved.select(state.columns), f"dual{step}")
    raise RuntimeError(f"the dual did not settle in {MAX_STEPS} steps")


def _round_source(cells, cap: int):
    """Whole copies of each cell of one source: largest sizes first, what rounding leaves over is passed on to the next size."""
    cells = cells.sort_values("size", ascending=False)
    owed, copies = 0.0, []
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"]):
        if size == 0:
            copies.append(n)
            continue
        owed += n * rate * size
        k = min(max(round(owed / size), 0), cap * n)
        owed -= k * size
        copies.append(k)
    return cells.assign(copies=copies)[["stratum", "size", "copies"]]


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Copies of every row of ``df`` so that the words taken from each source come near its target.

    Returns ``_row_no, <key>, size, source_size, target, rate, copies``. ``size`` is the number of words (null text: 0); documents
    without words are taken once and count nothing. A null source is a source of its own. Rates depend on source and size
    alone; within one (source, size) cell the documents that get a copy more are chosen by a hash of the key, ties by row, so
    reruns agree. Keys of any type may be null or repeat; rows are numbered here. Empty tables give no rows; other columns, whatever their
    names, are ignored; a text counts whole, however long.

    The dual and the rounding work on cells: one row per distinct size of a source, bounded by the longest document and not by
    the number of documents.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"), df[source].alias("source")).withColumn("_id", F.monotonically_increasing_id())
    return _mixed(rows, weights, share, cap).withColumnRenamed("key", key)


def _mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``mix_sources`` of rows ``_id, key, text, source``."""
    rows = written(docs.select(
        F.col("_id").alias("_row_no"), "key", F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("stratum"),
        F.size(word_array(F.col("text"))).cast("long").alias("size"),
    ), "sizes")
    cells = written(rows.groupBy("stratum", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "cells")
    sizes = cells.groupBy("stratum").agg(F.first("source").alias("source"), F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = solve_dual(cells, written(source_targets(sizes, weights, share, cap), "targets"), cap)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean_size"), cap))
    rated = cells.drop("source").join(solved.select("stratum", "source_size", "target", "multiplier", "mean_size", "full"), "stratum").withColumn("rate", rate)
    whole = rated.select("stratum", "size", "n", "rate").groupBy("stratum").applyInPandas(lambda pdf: _round_source(pdf, cap), "stratum string, size long, copies long")
    plan = written(rated.select("stratum", "size", "n", "rate", "source_size", "target").join(whole, ["stratum", "size"]), "copies")
    turns = ranked(rows.withColumn("spread", F.xxhash64("key")), ["stratum", "size"], ["spread", "key", "_row_no"], "turn")
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("turn") < F.col("copies") % F.col("n")).cast("long")
    return turns.join(plan, ["stratum", "size"]).select(
        "_row_no", "key", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", copies.cast("long").alias("copies")
    )


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """Rows of ``df``, with all their columns, whatever their names, each as often as the mix takes it (see ``mix_sources``)."""
    marked = identified(df, key, text=text, source=source)
    copies = _mixed(marked, **settings).filter("copies > 0")
    turns = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("turn")
    return marked.join(copies.select(F.col("_row_no").alias("_id"), turns), "_id").select("row.*")
