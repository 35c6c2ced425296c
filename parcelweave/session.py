"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for; a cluster's own values win where they are set at submit time.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(app: str = "parcelweave", cores: str | int = "*", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass the session that spark-submit made."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("PARCELWEAVE_DRIVER_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": "8",
        **SQL_SETTINGS,
        **(extra or {}),
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_WORKDIRS: dict[str, str] = {}


def workdir(spark: SparkSession) -> str:
    """Folder for intermediate tables: under `spark.checkpoint.dir`, or a temporary one in local mode."""
    app_id = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/parcelweave-{app_id}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if app_id not in _LOCAL_WORKDIRS:
        _LOCAL_WORKDIRS[app_id] = tempfile.mkdtemp(prefix="parcelweave-")
    return _LOCAL_WORKDIRS[app_id]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; called before a vectorised UDF is used."""
    app_id = spark.sparkContext.applicationId
    if app_id not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="parcelweave-"), "parcelweave")
        shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(f"{archive}.zip")
        _SHIPPED.add(app_id)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition into the configured number of shuffle partitions, whatever the size.

    For rows that are small but cost much work downstream: adaptive execution would gather them into a few tasks by
    their bytes. A following aggregate or distinct on the same columns needs no shuffle of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


# Spark removes the shuffle files of a write when it ends; otherwise they stay until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def for_a_write(spark: SparkSession, **settings: str) -> Iterator[None]:
    """`settings`, with "__" for a dot, while a table is written in here. The write leaves no shuffle files: nothing reads
    them again once the table stands."""
    wanted = {SHUFFLE_CLEANUP: "true"} | {name.replace("__", "."): value for name, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _written(df: DataFrame, name: str) -> str:
    path = f"{workdir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with for_a_write(df.sparkSession):
        df.write.mode("error").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a parquet table in the working folder and read it back.

    Cuts the lineage at a point several branches share: a lost executor re-reads files instead of recomputing
    the spatial or fuzzy join, and later joins plan with the table's real size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name))


@contextmanager
def aside(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """`df` as a table like that of `materialize`, which is deleted at the end."""
    spark, path = df.sparkSession, _written(df, name)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# Rows of a table made by `bucketed` that go to one bucket, and the most buckets Spark takes.
ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 100_000


def bucketed(df: DataFrame, keys: list[str], name: str, rows: int) -> DataFrame:
    """Write `df`, of about `rows` rows, as a table bucketed and sorted by `keys`, and read it.

    Joins on the keys need no exchange of it. It is dealt to its buckets before it is written, one file each.
    """
    spark = df.sparkSession
    table = f"parcelweave_{name}_{uuid.uuid4().hex}"
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET)))
    with for_a_write(spark):
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option(
            "path", f"{workdir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
