"""Language by rank-order profiles: the out-of-place distance between the most frequent n-grams of a text and a language.

N-grams are runs of one to three symbols of a word with its two borders, letters lower-cased, everything else a border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.llm.frames import carried, chunks, crc_of_id, released, restored, schema_of, ship_package

PROFILE_GRAMS = 300
# Documents of a language that its profile is learned from: those first in the order of the id's hash.
SAMPLE_DOCS = 2_000
# Ids are first counted by the leading bits of their hash, so that only those near the sample are sorted.
BUCKET_BITS = 16
UNKNOWN = "und"
BLOCK = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _symbols(text: str) -> np.ndarray:
    """Letters as code point + 2, each run of anything else as 1, a border at both ends; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    symbols = np.concatenate(([1], np.where(letter, points + 2, 1), [1]))
    return symbols[np.concatenate(([True], (symbols[1:] != 1) | (symbols[:-1] != 1)))]


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Each n-gram as one number, 21 bits a symbol. A trigram does not span a border."""
    a, b, c = symbols, symbols[1:], symbols[2:]
    two = a[:-1] | (b << 21)
    three = (two[:-1] | (c << 42))[b[:-1] != 1]
    return np.concatenate((a[a != 1], two, three))


def has_letter(text: str | None) -> bool:
    return bool(text) and len(_symbols(text)) > 0


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts, block by block for very long texts."""
    symbols = _symbols(text)
    if len(symbols) <= BLOCK:
        return np.unique(_grams(symbols), return_counts=True)
    keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for at in range(0, len(symbols), BLOCK):
        part = symbols[at:at + BLOCK + 2]  # two more symbols complete the n-grams that begin in the block
        new = np.unique(_grams(part), return_counts=True)
        tail = part[BLOCK:]
        over = np.unique(_grams(tail), return_counts=True) if len(tail) else (keys[:0], counts[:0])
        keys, inverse = np.unique(np.concatenate((keys, new[0], over[0])), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate((counts, new[1], -over[1])), len(keys)).astype(np.int64)
    return keys[counts > 0], counts[counts > 0]


def _most_frequent(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    if len(keys) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        kept = counts >= floor
        keys, counts = keys[kept], counts[kept]
    return keys[np.lexsort((keys, -counts))[:size]]


def _near_ids(known: DataFrame, sample: int) -> DataFrame:
    """(lang, at, id, n) of (lang, at, id): one row an id with its count, up to the hash bucket that fills the sample."""
    bucket = F.shiftright("at", 64 - BUCKET_BITS)
    before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = known.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < sample).groupBy("lang").agg(
        F.max("bucket").alias("last"))
    return known.join(F.broadcast(cuts), "lang").where(bucket <= F.col("last")).groupBy("lang", "at", "id").agg(
        F.count("*").alias("n"))


def _first_ids(known: DataFrame, sample: int) -> DataFrame:
    """(lang, id) of the first `sample` rows of each language of (lang, at, id), in the order of `at` and id."""
    before = Window.partitionBy("lang").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return _near_ids(known, sample).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
        F.col("before") < sample).select("lang", "id")


def learn_profiles(
    docs: DataFrame, doc_id: str, text: str, lang: str, size: int = PROFILE_GRAMS, sample: int = SAMPLE_DOCS,
) -> dict[str, list[int]]:
    """The `size` most frequent n-grams of each language, most frequent first, from at most `sample` documents of it."""
    ship_package(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id)).alias("at"), F.col(doc_id).alias("id"))
    chosen = _first_ids(known, sample)
    texts = docs.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = texts.join(chosen, ["lang", "id"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
                for name, t in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    held.setdefault(name, []).append(gram_counts(t))
                for name, parts in held.items():
                    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    sums = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(sums)],
                        names=["lang", "gram", "n"])

    counts = texts.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # languages x size rows
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranks:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for row, name in zip(self.ranks, self.names, strict=True):
            row[np.searchsorted(self.grams, np.array(profiles[name], dtype=np.int64))] = np.arange(len(profiles[name]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Sum of rank differences; a gram that a profile lacks counts `size`."""
        at = np.searchsorted(self.grams, grams)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != grams)] = len(self.grams)
        ranks = self.ranks[:, at]
        return np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams)))).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text:
            return UNKNOWN, 0.0
        keys, counts = gram_counts(text)
        if not len(keys):
            return UNKNOWN, 0.0
        grams = _most_frequent(keys, counts, self.size)
        found = self.distances(grams)
        best = int(found.argmin())
        others = np.delete(found, best)
        second = others.min() if len(others) else self.size * len(grams)
        total = float(found[best] + second)
        return self.names[best], float(second) / total if total else 0.5


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE_GRAMS, with_text: bool = False,
) -> DataFrame:
    """`docs`, without its text unless `with_text`, with `lang_pred` and `score`; `with_text` also adds `has_letter`.

    The language is the profile of least distance, ties by name; the score is the second distance over the sum of both:
    0.5 for a tie, near 1 for a clear case. Null, empty and letterless texts, and all texts if no profile was learned,
    are `und` with score 0. The profiles (languages x size numbers) go to the tasks with their code. An input column
    named like a new one is replaced.
    """
    ship_package(docs.sparkSession)
    ranks = Ranks(profiles, size)
    drop = () if with_text else ("_text",)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, "_text"):
                    texts = rows.column("_text").to_pylist()
                    found = [ranks.predict(t) for t in texts]
                    # A score above 0 needs a letter, so only the others are looked at again.
                    lettered = [x > 0 or with_text and has_letter(t) for (_, x), t in zip(found, texts, strict=True)]
                    own = rows.drop_columns(list(drop)) if drop else rows
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array([x for x, _ in found], pa.string()),
                         pa.array([x for _, x in found], pa.float64()), pa.array(lettered, pa.bool_())],
                        names=[*own.schema.names, "_lang", "_score", "_letter"])

    slim = docs.select(F.col(text).alias("_text"), carried(docs, text))
    out = slim.mapInArrow(score, schema_of(slim, drop, "_lang string, _score double, _letter boolean"))
    new = {"lang_pred": F.col("_lang"), "score": F.col("_score")}
    if not with_text:
        return restored(out, docs.drop(text), new)
    return restored(out, docs, new | {"has_letter": F.col("_letter")}, **{text: F.col("_text")})


def held_out(doc_id: str = "doc_id"):
    return crc_of_id(doc_id) % 5 == 0


def language_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` without its text, with `held_out`, `lang_pred` and `score`; profiles come from rows that are not held out."""
    train = docs.select(doc_id, text, lang).where(~held_out(doc_id))
    profiles = learn_profiles(train, doc_id, text, lang)
    return predict(docs.withColumn("held_out", held_out(doc_id)), profiles, text)
