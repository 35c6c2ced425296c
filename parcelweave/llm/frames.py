"""Helpers every operator of this folder shares: carried columns, sized chunks of a batch, shared tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave import session
from parcelweave.session import materialize

__all__ = ["materialize", "ship_package", "carried", "restored", "chunks", "texts_of", "table", "crc_of_id", "schema_of",
           "labelled_sample", "released", "text_digest"]

# Text bytes that one vectorised step handles at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
# Spark's own bound of a batch that goes to or from a Python worker is 64 MB; a session that keeps it gets this one.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARKS_BATCH, OWN_BATCH = 64 << 20, str(4 << 20)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers and bound the batches they hold."""
    session.ship_package(spark)
    if spark.conf.get(BATCH_SETTING) in (f"{SPARKS_BATCH}b", str(SPARKS_BATCH)):
        spark.conf.set(BATCH_SETTING, OWN_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def text_digest(text: str) -> Column:
    """128 bits that tell texts apart; null has none, and is told from the empty text."""
    return F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b""))


def carried(df: DataFrame, *apart: str, name: str = "_rest") -> Column:
    """All columns but `apart` as one struct, so that no name of the input can clash with an operator's own."""
    taken = {c.lower() for c in apart}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))).alias(name)


def restored(df: DataFrame, like: DataFrame, new: dict[str, Column], name: str = "_rest", **own: Column) -> DataFrame:
    """The columns of `like` in their order, then `new`; a new column replaces an input column of its name.

    `own` gives the input columns that were kept apart from the carried struct.
    """
    fresh = {c.lower() for c in new}
    apart = {c.lower(): v for c, v in own.items()}
    kept = [apart.get(c.lower(), F.col(name)[c]).alias(c) for c in like.columns if c.lower() not in fresh]
    return df.select(*kept, *[v.alias(c) for c, v in new.items()])


def schema_of(df: DataFrame, drop: tuple[str, ...] = (), add: str = "") -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop]
    return ", ".join(fields + ([add] if add else []))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `limit` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


@contextmanager
def released(*forget) -> Iterator[None]:
    """Calls `forget` and gives memory back at the end of a task: its Python worker goes on to tasks of other stages."""
    pa.set_memory_pool(pa.system_memory_pool())  # what the C library frees can be trimmed
    try:
        yield
    finally:
        for call in forget:
            call()
        gc.collect()
        _trim()


def _trim() -> None:
    """Ask the C library, where it can, to return freed heap pages to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, sample: int) -> DataFrame:
    """(at, text, label) of the first `sample` labelled documents by the hash of their id, one row each.

    Of several labels of an id the largest counts, of several texts the one with the least hash.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(label).cast("double").alias("label"))
    ids = docs.select(F.col(doc_id).alias("id")).distinct().join(known, "id")
    chosen = ids.withColumn("at", F.xxhash64("id")).orderBy("at", "id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most `sample` ids and labels are shared; an id of many rows is folded to one where its rows are read.
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "at", "label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).select("at", "text", "label")
