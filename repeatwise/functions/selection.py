"""Exact quantiles of large groups by distributed selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written

SLOTS = 4096


def exact_quantiles(values: DataFrame, keys: list[str], column: str, share: float = 0.5) -> DataFrame:
    """Quantile of ``column`` in each group, interpolated between its two neighbours in rank: ``keys, quantile``. Nulls do not count.

    Each round counts the values still in question in ``SLOTS`` slots between their least and greatest, keeps the slot that holds the rank, and
    narrows the limits to the least and greatest value in it, until both are equal. The least and the greatest value never share a slot, so
    every round narrows; counts are partial before the shuffle, and no group ever holds its values.
    """
    known = values.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("x"))
    place = (F.col("n") - 1) * F.lit(share)
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranks = F.array(F.struct(F.floor(place).alias("rank"), (1 - place + F.floor(place)).alias("part")), F.struct(F.ceil(place).alias("rank"), (place - F.floor(place)).alias("part")))
    sought = sizes.select(*keys, "lo", "hi", F.posexplode(ranks).alias("side", "r")).select(*keys, "side", "lo", "hi", "r.rank", "r.part")
    sought = written(sought, "ranks")
    while not sought.filter("lo < hi").isEmpty():
        slot = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLOTS), F.lit(SLOTS - 1))
        inside = known.join(sought.filter("lo < hi"), keys).filter("x >= lo AND x <= hi").withColumn("slot", slot)
        counts = inside.groupBy(*keys, "side", "rank", "part", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "side").orderBy("slot"))  # at most SLOTS rows
        held = counts.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        narrowed = held.select(*keys, "side", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "part")
        sought = written(narrowed.unionByName(sought.filter("lo = hi")), "ranks")
    return sought.groupBy(*keys).agg(F.sum(F.col("lo") * F.col("part")).alias("quantile"))
