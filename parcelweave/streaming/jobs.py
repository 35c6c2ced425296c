"""Incremental address refresh and daily query popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelweave.operators.upsert import last_by_position, upsert_parcels
from parcelweave.sources.addresses import SUFFIX, parse_addresses
from parcelweave.sources.landed import POSITION, accepted, state_file_filter
from parcelweave.session import materialize
from parcelweave.sources.tables import Tables


def refresh_addresses(
    tables: Tables, path: str, checkpoint: str, as_of: Column, states: list[str] | None = None,
    policy: str = "address", suffix: str = SUFFIX,
) -> StreamingQuery:
    """Merge address files that came in since the last run into the parcels, then stop.

    A batch rewrites only the states it touches: those of its rows and those its parcels were in before. Merging the
    same batch again after a failure gives the same rows, so a replayed batch does no harm.
    """
    spark = tables.spark
    lines = spark.readStream.option("pathGlobFilter", state_file_filter(suffix, states)).text(path)
    files = lines.select("value", "_metadata.file_path", "_metadata.file_block_start")

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = parse_addresses(batch.select(
            "value", F.col("file_path").alias("_file"), F.col("file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row")))
        staging = materialize(last_by_position(accepted(rows), "parcel_id", POSITION), "refresh-batch")
        parcels = tables.read("parcels")
        before = parcels.join(staging.select("parcel_id"), "parcel_id", "left_semi")
        touched = [r["state"] for r in staging.select("state").union(before.select("state")).distinct().collect()]
        if None in touched:  # rows without a state have no folder of their own name
            tables.overwrite("parcels", upsert_parcels(parcels, staging, policy, as_of))
        elif touched:
            merged = upsert_parcels(parcels.filter(F.col("state").isin(touched)), staging, policy, as_of)
            tables.replace_states("parcels", merged, touched)

    return (
        files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def daily_popularity(log: DataFrame) -> DataFrame:
    """Queries per entity and day."""
    return log.filter(F.col("entity_id").isNotNull()).groupBy(
        F.to_date("queried_at").alias("day"), "entity_id").agg(F.count(F.lit(1)).alias("n_queries"))


def keep_popularity(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the daily counts of a log stream as a table of increments, one folder per batch number.

    There is no watermark and no state: a row counts whenever it comes, and a replayed batch overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        daily_popularity(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id:09d}")

    return (
        log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_popularity(spark: SparkSession, out: str) -> DataFrame:
    """The count of each day and entity over all batches."""
    return spark.read.parquet(out).groupBy("day", "entity_id").agg(F.sum("n_queries").alias("n_queries"))
