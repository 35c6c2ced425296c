"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that mark toxic texts among the labelled ones. Features are
densities of its terms, nearness to second-person words, capitals, punctuation and obfuscated spellings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.frames import (
    carried,
    chunks,
    crc_of_id,
    labelled_sample,
    materialize,
    restored,
    schema_of,
    ship_package,
    texts_of,
)

# Labelled documents that lexicon, trees and calibration are learned from: those first in the order of the id's hash.
SAMPLE_DOCS = 20_000
LEXICON_TERMS = 400
MIN_TOXIC_DOCS = 3
MIN_ODDS = 8.0
PREFIXES = (4, 5)
NEAR_WORDS = 5
TREES, DEPTH, STEP = 30, 3, 0.2

# Second-person words of the four languages, and letters that signs stand for.
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie",
    "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros"}
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})

EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
INNER = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|^\d+[^\W\d_]|[^\W\d_]\d+$")
LONG = re.compile(r"(.)\1{2,}")
UPPER = np.zeros(256, dtype=np.int64)
UPPER[0x41:0x5B] = 1
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = 1
LETTER[0xC0:] = 1
SIGN = np.zeros(256, dtype=np.int64)
SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
SHOUT = np.zeros(256, dtype=np.int64)
SHOUT[[0x21, 0x3F]] = 1

FEATURES = (
    "word_density", "prefix_density", "weight_density", "largest_weight", "hits", "near_second_person", "second_person",
    "capitals", "capital_words", "signs", "shouts", "obfuscated", "obfuscated_hits", "stretched", "length")


def _core(word: str) -> str:
    return word.strip(EDGE).lower()


def _terms(text: str) -> set[str]:
    """Lexicon candidates of a text: its words, and the beginnings of longer words with a hyphen after them."""
    words = {w for w in map(_core, set(text.split())) if w.isalpha()}
    return words | {w[:n] + "-" for n in PREFIXES for w in words if len(w) > n}


def learn_lexicon(rows: DataFrame) -> DataFrame:
    """(half, term, weight): the most telling terms of each half of (half, text, label), equal texts counted once."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, text, label in zip(*(batch.column(c).to_pylist() for c in ("half", "text", "label")), strict=True):
                found = sorted(_terms(text))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([half] * n, pa.int32()), pa.array(found, pa.string()), pa.array([label] * n, pa.float64())],
                    names=["half", "term", "label"])

    distinct = rows.dropDuplicates(["half", "text"]).select("half", "text", "label")
    totals = distinct.groupBy("half").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    seen = distinct.mapInArrow(terms, "half int, term string, label double").groupBy("half", "term").agg(
        F.sum("label").alias("t"), F.count("*").alias("n")).where(F.col("t") >= MIN_TOXIC_DOCS)
    odds = ((F.col("t") + 0.5) / (F.col("toxic") + 1)) / ((F.col("n") - F.col("t") + 0.5) / (F.col("all") - F.col("toxic") + 1))
    return seen.join(totals, "half").withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).select(
        "half", "term", F.log("odds").alias("weight"), (F.col("t") * F.log("odds")).alias("strength"))


class Lexicon:
    """Facts of single words, kept for the words seen so far: weights of word and beginning, and how it is written."""

    def __init__(self, weights: dict[str, float], cached: int = 300_000):
        self.weights, self.cached = weights, cached
        self.plain: dict[int, list[str]] = {}
        for term in weights:
            if not term.endswith("-"):
                self.plain.setdefault(len(term), []).append(term)
        self.known: dict[str, tuple[float, ...]] = {}

    def _hidden(self, core: str) -> float:
        """Weight of a term behind signs, stars or stretched letters."""
        spelled = "".join(c for c in core.translate(SIGNS) if c.isalpha())
        tried = [spelled, LONG.sub(r"\1", spelled), LONG.sub(r"\1\1", spelled)]
        best = max(self.weights.get(t, 0.0) for t in tried)
        if not best and "*" in core:
            alike = self.plain.get(len(core), ())
            masked = re.compile("".join("." if c == "*" else re.escape(c) for c in core)) if alike else None
            best = max((self.weights[t] for t in alike if masked.fullmatch(t)), default=0.0)
        return best

    def facts(self, word: str) -> tuple[float, ...]:
        found = self.known.get(word)
        if found is None:
            core = _core(word)
            whole = self.weights.get(core, 0.0)
            start = max(self.weights.get(core[:n] + "-", 0.0) if len(core) > n else 0.0 for n in PREFIXES)
            mixed = not core.isalpha() and bool(INNER.search(core))
            stretched = bool(LONG.search(core)) and core.isalpha()
            hidden = self._hidden(core) if mixed or stretched else 0.0
            shouted = len(core) > 1 and word.isupper()
            found = (whole, start, hidden, float(core in SECOND_PERSON), float(shouted), float(mixed), float(stretched))
            if len(self.known) >= self.cached:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def features(self, texts: list[bytes]) -> np.ndarray:
        """One row of FEATURES per text; all 0 for a text without a word."""
        lists = [t.decode().split() for t in texts]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        words = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
        table = np.array(list(map(self.facts, words.dictionary.to_numpy(zero_copy_only=False).tolist())),
                         dtype=float).reshape(-1, 7)
        whole, start, hidden, you, shouted, mixed, stretched = table[words.indices.to_numpy()].T
        first = np.cumsum(counts) - counts

        def by_text(values: np.ndarray, reduce=np.add) -> np.ndarray:
            out = np.zeros(len(texts))
            full = np.flatnonzero(counts)
            if len(full):
                out[full] = reduce.reduceat(values, first[full])
            return out

        weight = np.maximum(np.maximum(whole, start), hidden)
        hit = weight > 0
        at = np.arange(len(weight))
        low = np.maximum(at - NEAR_WORDS, np.repeat(first, counts))
        high = np.minimum(at + NEAR_WORDS + 1, np.repeat(first + counts, counts))
        total = np.concatenate(([0], np.cumsum(you)))
        near = hit & (total[high] > total[low])
        n, hits = np.maximum(counts, 1), by_text(hit.astype(float))
        raw = np.frombuffer(b"".join(texts) + b"\n", dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

        def signs(kind: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(kind[raw])))[bounds]).astype(float)

        size, letters = np.maximum(np.diff(bounds), 1), np.maximum(signs(LETTER), 1)
        return np.stack([
            100 * by_text((whole > 0).astype(float)) / n, 100 * by_text((start > 0).astype(float)) / n,
            100 * by_text(weight) / n, by_text(weight, np.maximum), hits, by_text(near.astype(float)) / np.maximum(hits, 1),
            100 * by_text(you) / n, signs(UPPER) / letters, by_text(shouted) / n, signs(SIGN) / size, signs(SHOUT) / size,
            by_text(mixed) / n, 100 * by_text((hidden > 0).astype(float)) / n, by_text(stretched) / n, np.log1p(counts),
        ], axis=1)


def with_features(rows: DataFrame, lexicons: dict[int, dict[str, float]], text: str, half: str | None = None) -> DataFrame:
    """`rows` without the text, with `_features`; `half` names the column that chooses the lexicon, else it is 0."""
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: Lexicon(v) for k, v in shared.value.items()}
        for batch in batches:
            for part in chunks(batch, text):
                own = part.drop_columns([text])
                if half is None:
                    found = made[0].features(texts_of(part, text))
                else:
                    side = np.array(part.column(half).to_pylist())
                    both = [made[k].features(texts_of(part, text)) for k in sorted(made)]
                    found = np.where((side == sorted(made)[0])[:, None], both[0], both[-1])
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(list(found), pa.list_(pa.float64()))], names=[*own.schema.names, "_features"])

    return rows.mapInArrow(run, schema_of(rows, (text,), "_features array<double>"))


def _raw(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_raw", vector_to_array("probability")[1])


class Model:
    """A learned scorer; with labels of one kind only, their share is the score of every text."""

    def __init__(self, lexicon: dict[str, float], trees, steps, share: float):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    sample: int = SAMPLE_DOCS,
) -> Model:
    """Lexicon, trees and calibration from the sample.

    Each half of the sample gets its features from the lexicon of the other half, so the trees learn from terms that
    were not chosen on their own texts; scoring uses both halves' lexicons. Every fourth row calibrates. The lexicon is
    at most 2 x LEXICON_TERMS rows.
    """
    ship_package(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, doc_id, text, sample).withColumns({
        "half": F.pmod("at", F.lit(2)).cast("int"), "calibrates": F.pmod(F.shiftright("at", 1), F.lit(4)) == 0})
    rows = materialize(rows, "toxic-sample")
    kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = kinds.get(1.0, 0) / max(1, sum(kinds.values()))
    if len(kinds) < 2:
        return Model({}, None, None, share)
    terms = materialize(learn_lexicon(rows), "toxic-terms")
    halves = {h: {r["term"]: r["weight"] for r in terms.where(F.col("half") == h).orderBy(
        F.desc("strength"), "term").limit(LEXICON_TERMS).collect()} for h in (0, 1)}
    both = {t: max(halves[0].get(t, 0.0), halves[1].get(t, 0.0)) for t in {**halves[0], **halves[1]}}
    featured = with_features(rows, {0: halves[1], 1: halves[0]}, "text", "half").select(
        "label", "calibrates", array_to_vector("_features").alias("features"))
    featured = featured.repartition(4).persist()  # at most SAMPLE_DOCS short rows
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=42, minInstancesPerNode=5)
    fit = featured.where(~F.col("calibrates"))
    if fit.select("label").distinct().count() < 2:
        fit = featured
    trees = trees.fit(fit)
    steps = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_step").fit(
        _raw(trees.transform(featured.where("calibrates"))) if featured.where("calibrates").count() else _raw(trees.transform(fit)))
    featured.unpersist()
    return Model(both, trees, steps, share)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without its text, with `score` in 0 to 1 and `predicted` (1 from 0.5 on).

    Null and empty texts have features of 0 and are scored like any other. The score is the calibrated probability;
    a thousandth of the uncalibrated one orders texts on the same step. An input column named like a new one is replaced.
    """
    slim = docs.select(F.col(text).alias("_text"), carried(docs, text))
    if model.trees is None:
        out = slim.withColumn("_score", F.lit(float(model.share)))
    else:
        featured = with_features(slim, {0: model.lexicon}, "_text").withColumn("features", array_to_vector("_features"))
        out = model.steps.transform(_raw(model.trees.transform(featured))).withColumn(
            "_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("_step") + 0.001 * F.col("_raw"))))
    return restored(out, docs.drop(text), {
        "score": F.col("_score"), "predicted": F.when(F.col("_score") >= 0.5, 1).otherwise(0)})


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 5 == 0


def toxicity_of(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without its text, with `held_out`, `score` and `predicted`; held-out labels are not learned from."""
    model = learn(docs.select(doc_id, text).where(~held_out(doc_id)), labels, "toxic", doc_id, text)
    return score(docs.withColumn("held_out", held_out(doc_id)), model, text)
