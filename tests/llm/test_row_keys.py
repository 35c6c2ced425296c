"""Rows that agree in their id and in a 32-bit hash of their text, and ids that hold a third of all rows."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from parcelweave.llm import simhash, substrings, versions  # noqa: E402

PASSAGE = " ".join(f"shared{i}" for i in range(40))


@pytest.fixture(scope="module")
def same_hash(spark):
    """Two texts of one 32-bit hash: different words around a shared passage."""
    tail = " ".join(f"t{i}" for i in range(24))
    made = F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(" b c d e "), F.when(
        F.col("id") % 2 == 0, F.lit(PASSAGE)).otherwise(F.concat(F.lit(f"{tail} "), F.lit(PASSAGE), F.lit(f" {tail}"))))
    texts = spark.range(400_000).select(made.alias("text")).withColumn("h", F.hash("text")).cache()
    found = texts.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").collect()
    texts.unpersist()
    pairs = [sorted(r["t"][:2], key=len) for r in found]
    return next(p for p in pairs if len(p[0]) < len(p[1]))


@pytest.mark.parametrize("doc_id", [7, None])
def test_texts_of_one_id_and_hash(spark, same_hash, doc_id):
    rows = [(doc_id, t, "en", "s") for t in (*same_hash, same_hash[0], "other words")] + [(8, "x " + PASSAGE, "en", "s")]
    docs = plain.documents(spark, rows)
    got = substrings.remove_repeats(docs).select("n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(plain.without_repeats([r[1] for r in rows]))
    groups = plain.linked([plain.simhash(r[1]) for r in rows])
    kept = simhash.deduplicated(docs).collect()
    assert len(kept) == len(set(groups)) and len({r["text"] for r in kept}) == len(kept)


@pytest.mark.parametrize("hot", [500, None])
def test_an_id_of_a_third_of_all_rows_is_spread(spark, hot):
    rng = random.Random(17)
    rows = [(i if i % 3 else hot, f"text {i} " + " ".join(rng.choices("abcdefgh", k=rng.randrange(30))), "en", "s") for i in range(1500)]
    docs = plain.documents(spark, rows, clashing=False)
    slim = docs.select(F.coalesce("doc_id", F.lit(versions.LEAST)).alias("_key"), F.xxhash64("text").alias("_tag"), F.col("text").alias("_text"))
    ranged = versions._ranges(slim)
    sizes = [r["count"] for r in ranged.where("_guest = 0").groupBy("_range").count().collect()]
    assert max(sizes) < 150
    ordered = slim.orderBy(F.desc("_key"), "_tag").collect()
    after = {r["_text"]: n["_text"] for r, n in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    text_of = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in versions.fingerprint_versions(docs).collect()}
    want = set()
    for r in rows:
        edited = r[1][:len(r[1]) - len(r[1]) // 2] + after[r[1]][:len(r[1]) // 2]
        want.add((r[0], len(r[1]), versions.hashlib.sha256(edited.encode()).hexdigest()))
    assert text_of == want
