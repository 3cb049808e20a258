"""Stage counters and error scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def in_out_by_person(counts: DataFrame, stages: list[str]) -> DataFrame:
    """Reads in and out per person, one pair of columns per stage (stages are known, so no pivot scan)."""
    return counts.groupBy("person_id").agg(*[
        F.sum(F.when(F.col("stage") == s, F.col(c)).otherwise(0)).alias(f"{s}_{c[2:]}") for s in stages for c in ("n_in", "n_out")
    ])


def replicate_counts(duplicates: DataFrame) -> DataFrame:
    """Duplicate sets per person: all, discordant ones, pairs."""
    return duplicates.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("sets"), F.count_if(F.col("off_mode_share") > 0).alias("discordant"), F.count_if(F.col("size") == 2).alias("pairs")
    )


def error_scan(people: DataFrame, log_lines: DataFrame) -> DataFrame:
    """Error lines per person; people without any say so."""
    hits = log_lines.filter(F.col("line").rlike("rror")).groupBy("person_id").agg(F.count(F.lit(1)).alias("n_errors"))
    return people.select("person_id").join(hits, "person_id", "left").select(
        "person_id", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.when(F.col("n_errors").isNull(), "No errors").otherwise("ERRORS").alias("status")
    )


def stage_consistency(wide: DataFrame, stages: list[str]) -> DataFrame:
    """Whether each stage hands on no more reads than it took, and what the next stage took."""
    ok = F.lit(True)
    for s in stages:
        ok = ok & (F.col(f"{s}_out") <= F.col(f"{s}_in"))
    chain = F.lit(True)
    for a, b in zip(stages, stages[1:]):
        chain = chain & (F.col(f"{b}_in") == F.col(f"{a}_out"))
    return wide.select("person_id", ok.alias("shrinks"), chain.alias("chained"))
