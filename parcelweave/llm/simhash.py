"""SimHash near-duplicates by one-wildcard segment variants.

A fingerprint of 64 bits is cut into two halves. Fingerprints at most two bits apart differ by at most one bit in one
half, so they share a variant of that half with the differing bit blanked (any variant, if the half is equal). Variants
meet in an equality join, and the bit distance is verified there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.llm.components import components
from parcelweave.llm.frames import carried, chunks, materialize, released, restored, schema_of, ship_package, text_digest, texts_of
from parcelweave.llm.words import split_words

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def _majorities(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """The fingerprint of each text as unsigned 64 bits."""
    words = split_words([t.lower() for t in texts])
    counts = np.diff(words.first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    ends_at = np.cumsum(shingles)
    start = np.repeat(words.first[:-1] - (ends_at - shingles), shingles) + np.arange(ends_at[-1] if len(ends_at) else 0)
    last = np.minimum(start + shingle, np.repeat(words.first[1:], shingles)) - 1
    data, digest = words.data, xxhash.xxh64_intdigest
    spans = zip(words.starts[start].tolist(), words.ends[last].tolist(), strict=True)
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(start))
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        begins = (ends_at - shingles)[full]
        sums = np.empty((len(full), 64), dtype=np.int64)
        for byte in range(8):  # bit 8 * byte + k of a hash is bit k of this byte
            part = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
            bits = np.unpackbits(part, bitorder="little").reshape(-1, 8)
            sums[:, 8 * byte:8 * byte + 8] = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        ones = 2 * sums > shingles[full][:, None]
        out[full] = (ones.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """`docs` without its text, with `_fp`, the fingerprint as a signed long. Null text has no words: zero."""
    ship_package(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, text):
                    found = pa.array(_majorities(texts_of(rows, text), shingle, seed).view(np.int64))
                    kept = rows.drop_columns([text])
                    yield pa.RecordBatch.from_arrays([*kept.columns, found], names=[*kept.schema.names, "_fp"])

    return docs.mapInArrow(score, schema_of(docs, (text,), "_fp bigint"))


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v), u < v: each pair of different fingerprints of column `_fp` at most `max_bits` (0 to 2) bits apart.

    A fingerprint has at most 2,080 others within two bits, so the output stays in proportion to the input. A pair is
    written once per half: for the wildcard that hides the differing bit, or for wildcard 0 if the half is equal. A
    crowded variant is split between tasks by the skew handling of the join. Both sides are shuffled in any case: Spark
    sizes them by the fingerprints in front of `explode`, and would broadcast 64 rows for each through the driver.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("halves with one wildcard cover distances up to 2 bits")
    variants = distinct.selectExpr("_fp", "explode(sequence(0, 63)) AS w").selectExpr(
        "_fp", "w", "CAST(CASE WHEN w < 32 THEN _fp & 4294967295L ELSE shiftrightunsigned(_fp, 32) END AS BIGINT) AS half",
    ).selectExpr("_fp", "half", "w", "shiftleft(CAST(w AS BIGINT), 32) | (half & ~shiftleft(1L, w % 32)) AS variant")
    a = variants.selectExpr("variant", "_fp AS u")
    b = variants.selectExpr("variant", "_fp AS v")
    wildcard = "CAST(shiftright(variant, 32) AS INT)"
    differing = f"CASE WHEN {wildcard} < 32 THEN (u ^ v) & 4294967295L ELSE shiftrightunsigned(u ^ v, 32) END"
    return a.join(b.hint("merge"), "variant").where(
        f"u < v AND bit_count(u ^ v) <= {max_bits} AND "
        f"({differing} = shiftleft(1L, {wildcard} % 32) OR ({differing} = 0 AND {wildcard} % 32 = 0))",
    ).select("u", "v").distinct()


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """(_fp, root, component_id) for each distinct fingerprint of (_id, _fp); `root` names the component uniquely.

    A written table: a join with it then shuffles both sides, so that a fingerprint of very many copies can be split.
    """
    nodes = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_least")), "fingerprint-nodes")
    roots = materialize(components(linked_fingerprints(nodes, max_bits), "fingerprint-links"), "fingerprint-roots")
    linked = nodes.join(roots, nodes["_fp"] == roots["node"])
    named = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = nodes.join(linked.select("_fp", "root").join(named, "root"), "_fp", "left").select(
        "_fp", F.coalesce("root", "_fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("_least")).otherwise(F.col("component_id")).alias("component_id"))
    return materialize(classes, "fingerprint-classes")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS, seed: int = SEED,
) -> DataFrame:
    """`docs` without its text, plus `fingerprint` (16 hex digits) and `component_id`.

    Documents whose fingerprints differ by `max_bits` bits or fewer are linked; a component is named by its smallest
    document id. Fingerprints are made distinct before the join, so copies cost one row each, not pairs. Texts without a
    word (null, empty, blank) have fingerprint zero and are linked like any other. A null id is never the name of a
    component unless all its ids are null. An empty table gives an empty result. An input column named like a new one
    is replaced.
    """
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), carried(docs, text))
    prints = materialize(fingerprints(slim, "_text", shingle, seed), "fingerprints")
    out = prints.join(_classes(prints, max_bits), "_fp")
    return restored(out, docs.drop(text), {
        "fingerprint": F.lower(F.lpad(F.hex("_fp"), 16, "0")), "component_id": F.col("component_id")})


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS, seed: int = SEED,
) -> DataFrame:
    """One document of each component, unchanged: the smallest id, of repeated ids the least text digest (128 bits), of equal rows one.

    Null ids count as the largest. The texts are shuffled once, for the join with the chosen rows.
    """
    keys = {"_none": F.col(doc_id).isNull(), "_id": F.coalesce(F.col(doc_id), F.lit(0)), "_tag": text_digest(text)}
    rows = docs.select(*[v.alias(k) for k, v in keys.items()], F.struct("*").alias("_row"))
    prints = materialize(fingerprints(
        docs.select(*[v.alias(k) for k, v in keys.items()], F.col(text).alias("_text")), "_text", shingle, seed),
        "fingerprints")
    chosen = prints.join(_classes(prints, max_bits), "_fp").groupBy("root").agg(F.min(F.struct(*keys)).alias("c")).select("c.*")
    first = Window.partitionBy(*keys).orderBy("_id")
    kept = rows.join(chosen, list(keys)).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("_row.*")
