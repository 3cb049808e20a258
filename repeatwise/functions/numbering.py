"""Dense numbering in a given order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in ``order``.

    Rows are range-partitioned and written once, numbered inside each range, and shifted by the number of rows in
    earlier ranges; only one small row per range is handled together.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("size"))
    earlier = sizes.withColumn("shift", F.sum("size").over(Window.orderBy("range_no")) - F.col("size")).select("range_no", "shift")
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(earlier, "range_no").select(
        *df.columns, (F.col("inside") + F.col("shift")).cast("long").alias(name)
    )
