"""Helpers shared by the file readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION = ["_file", "_block", "_row"]


def with_position(df: DataFrame) -> DataFrame:
    """Add the file, split offset and running number of each line: the order records stand in the files.

    Called directly on a file scan, where the running number grows along each split.
    """
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def state_file_filter(suffix: str, states: list[str] | None) -> str:
    """Glob for the landed files of some states (by file name prefix), or of all."""
    if not states:
        return f"*{suffix}"
    return "{" + ",".join(s.lower() for s in states) + "}*" + suffix


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds, null when none does. A rule that is null does not hold."""
    reason = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        reason = reason.when(condition, name)
    return reason


def ingest_metrics(df: DataFrame) -> DataFrame:
    """Rows loaded and skipped per reason, as (outcome, n)."""
    return df.groupBy(F.coalesce("reject_reason", F.lit("loaded")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


def change_metrics(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row counts before and after a merge, and keys added, as (outcome, n)."""
    b = before.agg(F.count(F.lit(1)).alias("n")).select(F.lit("before").alias("outcome"), "n")
    a = after.agg(F.count(F.lit(1)).alias("n")).select(F.lit("after").alias("outcome"), "n")
    added = after.select(key).join(before.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return b.unionByName(a).unionByName(added.select(F.lit("added").alias("outcome"), "n"))
