"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits or other signs, as they are written; features are hashes of one and two tokens, and
marks for tokens that repeat at once, each worth its share of a text's n-grams. A score is a sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.frames import carried, chunks, crc_of_id, labelled_sample, restored, schema_of, ship_package, texts_of
from parcelweave.llm.words import mix, split_tokens, window_hashes, word_hashes

BITS = 18
# Labelled documents that the weights are learned from: those first in the order of the id's hash.
SAMPLE_DOCS = 16_000
# Independent learners, whose weights are averaged.
SHARDS = 4
PASSES = 3
REPEATS = mix(np.array([1, 2], dtype=np.uint64))
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 16.0


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all n-grams of all texts in order, and how many each text has."""
    tokens = split_tokens(texts)
    one = word_hashes(tokens)
    two = window_hashes(one, 2)
    counts = np.diff(tokens.first)
    inside = np.ones(len(two), dtype=bool)
    borders = tokens.first[1:-1] - 1
    inside[borders[(borders >= 0) & (borders < len(two))]] = False
    text = np.repeat(np.arange(len(texts)), counts)
    # A token that is one or two places behind its like is, whatever it says, the same n-gram.
    again = [text[n:][(one[n:] == one[:-n]) & (text[n:] == text[:-n])] for n in (1, 2)]
    marks = np.repeat(REPEATS, [len(a) for a in again])
    slots = np.concatenate((one, two[inside], marks)) >> np.uint64(64 - BITS)
    of = np.concatenate((text, text[:-1][inside] if len(text) else text, *again))
    order = np.argsort(of, kind="stable")
    return slots[order].astype(np.int64), np.bincount(of, minlength=len(texts))


def _scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    slots, counts = _features(texts)
    sums = np.zeros(len(texts))
    full = np.flatnonzero(counts)
    if len(full):
        begins = np.cumsum(counts) - counts
        sums[full] = np.add.reduceat(weights[slots].astype(float), begins[full]) / counts[full] * SCALE
    return 1 / (1 + np.exp(-np.clip(sums + bias, -30, 30)))


def follow_leader(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """FTRL-proximal weights for sparse examples (slots, values); the last weight is the bias, which is not shrunk."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1, l2 = np.append(np.full(1 << BITS, L1), 0.0), np.append(np.full(1 << BITS, L2), 0.0)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1[at], 0.0, -(z[at] - np.sign(z[at]) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + l2[at]))

    for _ in range(passes):
        for (slots, values), label in zip(examples, labels, strict=True):
            w = weights(slots)
            gradient = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
            grown = n[slots] + gradient * gradient
            z[slots] += gradient - (np.sqrt(grown) - np.sqrt(n[slots])) / ALPHA * w
            n[slots] = grown
    return weights(slice(None))


def _examples(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    slots, counts = _features(texts)
    for part in np.split(slots, np.cumsum(counts)[:-1]):
        at, n = np.unique(part, return_counts=True)
        values = n / max(1, len(part)) * SCALE
        out.append((np.append(at, 1 << BITS), np.append(values, 1.0)))
    return out


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    sample: int = SAMPLE_DOCS,
) -> tuple[np.ndarray, float]:
    """Weights and bias. Each of the shards of the sample is learned in one task; all weights are 0 without a label."""
    ship_package(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, doc_id, text, sample).withColumn("shard", F.pmod(F.hash("at"), F.lit(SHARDS)))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "text"])
        found = follow_leader(_examples([t.encode() for t in part["text"]]), part["label"].to_numpy())
        return pd.DataFrame({"weights": [found.astype("<f8").tobytes()]})

    learned = rows.groupBy("shard").applyInPandas(train, "weights binary").collect()  # SHARDS rows of a fixed size
    if not learned:
        return np.zeros(1 << BITS, dtype=np.float32), 0.0
    mean = np.mean([np.frombuffer(r["weights"], dtype="<f8") for r in learned], axis=0)
    return mean[:-1].astype(np.float32), float(mean[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """`docs` without its text, with `score` in 0 to 1 and `predicted` (1 from 0.5 on).

    Null, empty and blank texts have no n-gram and get the bias alone. The weights are 2^18 numbers, whatever the data.
    An input column named like a new one is replaced.
    """
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "_text"):
                own = rows.drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(_scores(texts_of(rows, "_text"), *model.value))],
                    names=[*own.schema.names, "_score"])

    slim = docs.select(F.col(text).alias("_text"), carried(docs, text))
    out = slim.mapInArrow(run, schema_of(slim, ("_text",), "_score double"))
    return restored(out, docs.drop(text), {
        "score": F.col("_score"), "predicted": F.when(F.col("_score") >= 0.5, 1).otherwise(0)})


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 3 == 1


def quality_of(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without its text, with `held_out`, `score` and `predicted`; held-out labels are not learned from."""
    weights, bias = learn(docs.select(doc_id, text).where(~held_out(doc_id)), labels, "quality", doc_id, text)
    return score(docs.withColumn("held_out", held_out(doc_id)), weights, bias, text)
