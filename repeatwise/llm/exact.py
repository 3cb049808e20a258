"""Exact deduplication: frequent digests are found by Misra-Gries counters and removed map-side, the rest by a shuffle.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import SPACES, identified, numbered

#: Share of all rows from which a digest counts as frequent; the Misra-Gries summary holds at most 1 / SUPPORT digests.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """Text with each run of separators replaced by one space; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.regexp_replace(plain, " {2,}", " ")


def exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """Label each row of ``df`` with the row of equal text that stays.

    Returns ``_row_no, <key>, keep_key, group_size, kept, text_sha256``, one row per row of ``df``, which are numbered here. Texts are
    equal when they are identical after ``normalised``, however long; of equal texts the row with the smallest key stays (keys of any
    type; null keys come last, among repeated rows with one key exactly one stays). Null and empty texts form one group. Empty
    tables give no rows; other columns, whatever their names, are ignored.
    """
    rows = numbered(df.select(df[key].alias("key"), _digest(df[text])))
    return _labelled(rows, support).withColumnRenamed("key", key)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest")


def _labelled(rows: DataFrame, support: float) -> DataFrame:
    """Labels of written rows ``_row_no, key, digest``.

    The Misra-Gries summary (at most ``1 / support`` digests) holds every digest with more than ``support`` of all rows.
    An exact count confirms its entries, and the winners of the confirmed ones are broadcast: their rows are settled where
    they are read. No other digest has more than ``support`` of the rows, so the window over the remaining ones is even.
    """
    rank = F.struct(F.col("key").isNull().alias("last"), F.col("key").alias("key"), F.col("_row_no").alias("_row_no"))

    summary = rows.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], support)
    candidates = summary.select(F.explode("digest_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    counted = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("winner"))
    winners = written(counted.filter("group_size > 1"), "winners")  # at most 1 / support rows

    frequent = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    others = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    others = others.withColumns({"group_size": F.count(F.lit(1)).over(same), "winner": F.min(rank).over(same)})
    return frequent.select(*others.columns).union(others).select(
        "_row_no",
        "key",
        F.col("winner.key").alias("keep_key"),
        "group_size",
        (F.col("_row_no") == F.col("winner._row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` that stay (see ``exact_copies``), with all their columns, whatever their names."""
    marked = identified(df, key, text=text)
    rows = written(marked.select(F.col("_id").alias("_row_no"), "key", _digest(F.col("text"))), "digests")
    dropped = _labelled(rows, SUPPORT).filter(~F.col("kept")).select(F.col("_row_no").alias("_id"))
    return marked.join(dropped, "_id", "left_anti").select("row.*")
