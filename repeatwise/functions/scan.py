"""Segmented scans over long sequences in two levels, so that no task holds all rows of one sequence.

Rows are cut into blocks of positions. Each block gives one summary; summaries are scanned in groups of ``FAN`` blocks, the groups are
carried over to later groups, and each block starts from what it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

FAN = 1024  # summaries scanned in one window
_HOW = {"max": F.max, "sum": F.sum}


def exclusive_scan(blocks: DataFrame, keys: list[str], how: str) -> DataFrame:
    """From one row per block (``keys, blk, value``): ``keys, blk, carry``, the maximum or sum of the values of all earlier blocks (null: none).

    A group of ``FAN`` blocks meets the totals of earlier groups by a join; a sequence has one group for each ``FAN`` blocks.
    """
    combine = _HOW[how]
    grouped = blocks.withColumn("_group", F.floor(F.col("blk") / FAN))
    inside = Window.partitionBy(*keys, "_group").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = grouped.groupBy(*keys, "_group").agg(combine("value").alias("_total"))
    earlier = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_group").alias("_before"), F.col("_total").alias("_given"))
    meets = (F.col("_group") > F.col("_before"))
    for k in keys:
        meets = meets & (F.col(k) == F.col(f"_{k}"))
    given = totals.select(*keys, "_group").join(earlier, meets).groupBy(*keys, "_group").agg(combine("_given").alias("_given"))
    scanned = grouped.withColumn("_inside", combine("value").over(inside)).join(given, [*keys, "_group"], "left")
    both = F.greatest("_inside", "_given") if how == "max" else F.when(
        F.col("_inside").isNotNull() | F.col("_given").isNotNull(), F.coalesce("_inside", F.lit(0)) + F.coalesce("_given", F.lit(0)))
    return scanned.select(*keys, "blk", both.alias("carry"))
