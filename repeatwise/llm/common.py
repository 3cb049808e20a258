"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import written

SPACES = " \t\n\x0b\f\r"  # separators of words: [\x20\x09-\x0D]


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def numbered(df: DataFrame, name: str = "_row_no") -> DataFrame:
    """``df`` written to the shared folder with a row number that identifies each of its rows, repeated rows too."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 in ``order``, however many rows one key has.

    Rows are cut into ranges over (keys, order), so a large key spans many ranges. Each range numbers its own rows; one row
    for each key and range carries how many rows of the key lie in earlier ranges. ``keys`` must hold no nulls.
    """
    ranged = written(df.repartitionByRange(parallelism(df), *keys, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*keys, "range_no").agg(F.count(F.lit(1)).alias("rows_here"))
    earlier = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "range_no", F.coalesce(F.sum("rows_here").over(earlier), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy(*keys, "range_no").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(shifts, [*keys, "range_no"]).select(*df.columns, (F.col("inside") + F.col("shift")).cast("long").alias(name))


def identified(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """Rows of ``df`` as ``_id, row, key`` and the columns asked for under their new names.

    ``row`` is a struct of all columns, so their names clash with nothing. ``_id`` is a whole number that identifies the row: the key where it is
    a whole number, unique and never null; else rows are numbered and written.
    """
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[key].alias("key"), *[df[c].alias(name) for name, c in columns.items()])
    if isinstance(df.schema[key].dataType, T.IntegralType):
        keys = whole.groupBy("key").count()
        if keys.filter(F.col("key").isNull() | (F.col("count") > 1)).isEmpty():
            return whole.withColumn("_id", F.col("key").cast("long"))
    return numbered(whole, "_id")


def smallest_labels(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges ``a, b``: ``node, label``, the label being the smallest node of the component.

    Labels go along edges and are then looked up once more (a node takes the label of its label), so long chains halve each round.
    Each round is written to the shared folder, and the driver asks one yes/no question.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        passed = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head"))
        moved = written(passed.join(heads, "label").select("node", "old", F.least("label", "head").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels
