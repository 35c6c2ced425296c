"""Product codes of vectors by equal-average nearest-neighbour search.

A vector is cut into parts; each part position has a codebook, refined in rounds of assignment and averaging. The search
sorts a codebook's entries by component sum and walks outward from a part's own sum: the squared gap between two sums,
over the dimension, never exceeds the squared distance, so the walk ends where that gap strictly exceeds the best one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.frames import carried, materialize, restored, schema_of, ship_package

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
# Vectors that one step of the search holds.
SEARCH_ROWS = 4096


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the lower index, and its squared distance."""
    dim = values.shape[1]
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sums = entries.sum(axis=1)[order]
    own = values.sum(axis=1)
    best = np.full(len(values), np.iinfo(np.int64).max // max(dim, 1), dtype=np.int64)
    index = np.full(len(values), len(entries), dtype=np.int64)
    right = np.searchsorted(sums, own)
    left = right - 1
    at = np.arange(len(values))
    while len(at):
        low, high, mine = left[at], right[at], own[at]
        none_low, none_high = low < 0, high == len(sums)
        gap_low = mine - sums[np.maximum(low, 0)]
        gap_high = sums[np.minimum(high, len(sums) - 1)] - mine
        up = ~none_high & (none_low | (gap_high < gap_low))
        gap = np.where(up, gap_high, gap_low)
        on = ~(none_low & none_high) & (gap * gap <= best[at] * dim)
        at, up = at[on], up[on]
        entry = order[np.where(up, right[at], left[at])]
        apart = values[at] - entries[entry]
        far = (apart * apart).sum(axis=1)
        better = (far < best[at]) | ((far == best[at]) & (entry < index[at]))
        best[at[better]], index[at[better]] = far[better], entry[better]
        right[at[up]] += 1
        left[at[~up]] -= 1
    return index, best


def _integers(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; a shorter vector goes on with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    # Sums and products of the search must fit into 63 bits, for a part as wide as the vector.
    if np.abs(out).max(initial=0.0) * 2 * max(width, 1) >= 2.0**31:
        raise ValueError("a vector component is too large for integer codes")
    return out.astype(np.int64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SEARCH_ROWS):
            yield batch.slice(at, SEARCH_ROWS)


def _averaged(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: each entry is the floored average of its parts, an unused one stays.

    A task adds up its own parts, so it sends one row an entry at most; so many rows reach the driver.
    """
    parts, size, dim = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, size, dim), dtype=np.int64)
        counts = np.zeros((parts, size), dtype=np.int64)
        for rows in _steps(batches):
            values = _integers(rows.column("_v"), parts * dim, scale)
            for p in range(parts):
                part = values[:, p * dim:(p + 1) * dim]
                index, _ = nearest(part, books[p])
                np.add.at(sums[p], index, part)
                counts[p] += np.bincount(index, minlength=size)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = kept.select("_v").mapInArrow(add, "part bigint, entry bigint, n bigint, sums array<bigint>")
    # With no component there is nothing to average.
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
    out = books.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def _first_books(kept: DataFrame, vec_id: str, width: int, parts: int, size: int, scale: int) -> np.ndarray:
    first = kept.select(vec_id, "_v").orderBy(F.col(vec_id).asc_nulls_last(), "_v").limit(size).collect()
    lists = pa.array([r["_v"] for r in first], pa.list_(pa.float64()))
    return _integers(lists, width, scale).reshape(len(first), parts, width // parts).transpose(1, 0, 2)


def vector_codes(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """`rows` without the vector, with `code error label_error codebooks_sha256`.

    Components become floor(scale * x). A codebook starts as that part of the `size` smallest ids (null ids last, rows
    of one id by vector; fewer rows give fewer entries). Each round assigns every part to its nearest entry, ties to the
    lower index, and averages. `code` has two hex digits a part, `error` the final squared distances, `label_error` their
    sum over rows of the same label, null being one. Rows whose vector is null or holds a null or non-finite component
    are dropped. All vectors are taken as long as the longest one, rounded up to whole parts, shorter ones going on with
    zeros. Repeated rows count each time, an empty table gives an empty result, an input column named like a new one is
    replaced. Scaled components must stay below 2^30 / width; larger ones raise an error. Only codebooks
    (parts x size entries) pass through the driver.
    """
    if not 0 < size <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    ship_package(rows.sparkSession)
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(v.isNotNull() & ~bad).select(
        F.col(vec_id).alias("_id"), F.col(label).alias("_label"), v.cast("array<double>").alias("_v"),
        carried(rows, vector))
    longest = kept.agg(F.max(F.size("_v"))).first()[0] or 0
    books = _first_books(kept, "_id", -(-longest // parts) * parts, parts, size, scale)
    for _ in range(rounds):
        books = _averaged(kept, books, scale)
    _, _, dim = books.shape
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _steps(batches):
            values = _integers(chunk.column("_v"), parts * dim, scale)
            codes, error = np.empty((len(values), parts), dtype=np.uint8), np.zeros(len(values), dtype=np.int64)
            for p in range(parts):
                index, far = nearest(values[:, p * dim:(p + 1) * dim], books[p])
                codes[:, p] = index
                error += far
            names = [c.tobytes().hex() for c in codes]
            own = chunk.select(["_label", "_rest"])
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(names, pa.string()), pa.array(error)], names=["_label", "_rest", "_code", "_error"])

    slim = kept.select("_v", "_label", "_rest")
    coded = materialize(slim.mapInArrow(encode, schema_of(slim, ("_v",), "_code string, _error bigint")), "vector-codes")
    # Both sides of the join are written tables, so a label of very many rows can be split between tasks.
    sums = materialize(coded.groupBy("_label").agg(F.sum("_error").alias("_sum")), "label-errors").withColumnRenamed(
        "_label", "_label2")
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_label2")))
    return restored(out, rows.drop(vector), {
        "code": F.col("_code"), "error": F.col("_error"), "label_error": F.col("_sum"),
        "codebooks_sha256": F.lit(digest)})


def _check_sql() -> str:
    """The same in SQL, for vectors of one length that whole parts divide."""
    far = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""near{n} AS (
  SELECT r, p, best[1] AS d, best[2] AS e FROM (
    SELECT a.r, a.p, min([{far}, b.e]) AS best FROM parts a JOIN book{n} b USING (p) GROUP BY a.r, a.p))""")
        if n < ROUNDS:
            steps.append(f"""book{n + 1} AS (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS v FROM (
      SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS s
      FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts JOIN near{n} USING (r, p))
      GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return f"""
WITH ints AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT r, p, c[p * len(c) // {PARTS} + 1:(p + 1) * len(c) // {PARTS}] AS v FROM ints, unnest(range({PARTS})) AS t(p)),
book0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES}),
{''',
'''.join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN ints USING (r), digest
"""


CHECK_SQL = _check_sql()
