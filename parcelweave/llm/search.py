"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size, each against all rows. A block scores every row and counts scores into
histograms, which rounds refine around each query's kth largest score until it is known exactly; one more pass keeps the
rows above it and, of those at it, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.llm.frames import materialize, ship_package

SCALE = 1024
TOP = 10
BINS = 4096
# Queries that one round serves, and rows that are scored at once.
BLOCK_QUERIES = 4096
SCORE_ROWS = 2048


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double; rows without a vector of finite components are left out."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(vec_id).isNotNull() & v.isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; a vector of another width scores as if it ended (or went on with zeros) there."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for row, part in zip(out, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        row[:min(width, len(part))] = part[:width]
    return out


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact while every sum stays below 2^53; beyond, integers are used."""
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1]
    if most < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _pass(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, emit, schema: str) -> DataFrame:
    """emit(scores, own, row ids) for each set of rows; `own` marks a query's own row, which takes no part."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SCORE_ROWS):
                part = batch.slice(at, SCORE_ROWS)
                rows = part.column("id").to_numpy()
                yield emit(_scores(_matrix(part.column("v"), queries.shape[1]), queries), ids[:, None] == rows[None, :], rows)

    return vectors.mapInArrow(run, schema)


def _kth_scores(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The kth largest score of each query and how many rows lie above it; a query with fewer rows gets the least score.

    A round counts the scores within [low, low + width * BINS) into BINS bins; rows above are counted as one bin. Only the
    upper bins of a set of rows that hold its own k largest scores are sent on, as lower ones cannot hold the kth of all.
    """
    reach = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    bound = np.floor(np.sqrt(reach) * np.sqrt((queries * queries).sum(axis=1))).astype(np.int64) + 1
    low, span = -bound, 2 * bound + 1
    above = np.zeros(len(ids), dtype=np.int64)
    while True:
        width = -(-span // BINS)

        def count(scores: np.ndarray, own: np.ndarray, rows: np.ndarray, low=low, width=width, span=span) -> pa.RecordBatch:
            inside = ~own & (scores >= low[:, None]) & (scores < (low + span)[:, None])
            bins = np.where(inside, (scores - low[:, None]) // width[:, None], -1)
            largest = -np.partition(-bins, min(k, bins.shape[1]) - 1, axis=1)[:, min(k, bins.shape[1]) - 1]
            query, row = np.nonzero((bins >= 0) & (bins >= largest[:, None]))
            key, n = np.unique(query * (BINS + 1) + bins[query, row], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key // (BINS + 1)), pa.array(key % (BINS + 1)), pa.array(n)],
                                              names=["query", "bin", "n"])

        found = _pass(vectors, ids, queries, count, "query bigint, bin bigint, n bigint").groupBy("query", "bin").agg(
            F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        found = found.withColumn("upto", F.sum("n").over(down))
        need = vectors.sparkSession.createDataFrame(
            [(i, int(k - a)) for i, a in enumerate(above)], "query bigint, need bigint")
        # The highest bin that reaches k, or the lowest one there is; one row per query of the block.
        chosen = found.join(F.broadcast(need), "query").groupBy("query").agg(
            F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("upto") - F.col("n")).alias("before")))).alias("hit"),
            F.min("bin").alias("least"), F.min_by(F.col("upto") - F.col("n"), "bin").alias("rest")).collect()
        done = (width == 1).all()
        for row in chosen:
            q = row["query"]
            at, before = (row["hit"]["bin"], row["hit"]["before"]) if row["hit"] else (row["least"], row["rest"])
            low[q] += at * width[q]
            above[q] += before
        span = width
        if done:
            return low, above


def _chosen(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> DataFrame:
    """(query, id, score): every row above the kth score, and of the ties at it the k smallest ids of each row set."""

    def keep(scores: np.ndarray, own: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        over = ~own & (scores > kth[:, None])
        query, row = np.nonzero(over)
        ties = ~own & (scores == kth[:, None])
        order = np.argsort(rows, kind="stable")
        sorted_ties = ties[:, order]
        first = sorted_ties & (np.cumsum(sorted_ties, axis=1) <= k)
        tied_query, tied_at = np.nonzero(first)
        query, row = np.concatenate((query, tied_query)), np.concatenate((row, order[tied_at]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[query]), pa.array(rows[row]), pa.array(scores[query, row])], names=["query_id", "vec_id", "score"])

    return _pass(vectors, ids, queries, keep, "query_id bigint, vec_id bigint, score bigint")


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products with `rows`, ties to smaller ids.

    `queries` has the columns of `rows`; a query's own id takes no part (all rows of it, if it is repeated; a repeated
    query counts once, with its first vector by components). Rows whose vector is null or has a null or non-finite
    component take no part on either side. Fewer than k rows give all of them, no query an empty result. Inner
    products must fit into 63 bits. Query blocks are bounded, so what a task is sent does not follow the input; `rows`
    is read once per block and round.
    """
    spark = rows.sparkSession
    ship_package(spark)
    vectors = materialize(integer_vectors(rows, vec_id, vector), "vectors")
    asked = integer_vectors(queries, vec_id, vector).groupBy("id").agg(F.min("v").alias("v"))
    numbered = materialize(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(
        max(1, -(-asked.count() * 5 // (4 * block)))))), "queries")
    result = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    for number in sorted(r["block"] for r in numbered.select("block").distinct().collect()):
        own = numbered.where(F.col("block") == number).orderBy("id").collect()  # about `block` rows
        ids = np.array([r["id"] for r in own], dtype=np.int64)
        width = max(len(r["v"]) for r in own)
        matrix = np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in own])
        kth, _ = _kth_scores(vectors, ids, matrix, k)
        result = result.union(_chosen(vectors, ids, matrix, kth, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
