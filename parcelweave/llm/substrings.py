"""Exact removal of repeated word windows by super-k-mers.

Every window of `window` words has a minimiser: the least hash among its runs of `MER_WORDS` words. Consecutive windows
that share one minimiser occurrence are one packed string, whose bucket is that hash. Equal windows have equal
minimisers, so they meet in one bucket, and no occurrence covers two equal windows, so a minimiser that occurs once in
the corpus has no repeated window. Strings of one bucket with one 128-bit digest are equal: a string that occurs again is
repeated as a whole, in however many copies. Of the different strings of a bucket one each travels there, where windows
are sorted by hash and equal neighbours are settled on their bytes.

A bucket of more than `HOT_SPANS` different strings (around a passage that a third of all rows may hold) is not sorted
in one task: its windows are counted one by one, as 128-bit digests, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.frames import carried, chunks, materialize, released, restored, schema_of, ship_package, text_digest, texts_of
from parcelweave.llm.words import Words, split_words, window_hashes, word_hashes

WINDOW_WORDS = 35
MER_WORDS = 5
HOT_SPANS = 2_000
# Bytes of packed strings that one sorting step handles at once, plus the rest of its last bucket.
SORT_BYTES = 2 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in each run of `width` values."""
    at = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        reach += step
    return at


def _spans(words: Words, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word within the text, number of windows and minimiser of each super-k-mer."""
    none = np.empty(0, dtype=np.int64)
    if len(words.starts) < window:
        return none, none, none, none
    values = window_hashes(word_hashes(words), mer).view(np.int64)
    least = _least(values, window - mer + 1)
    counts = np.diff(words.first)
    fits = np.repeat(words.first[1:], counts)[:len(least)] - np.arange(len(least)) >= window
    opens = fits.copy()
    opens[1:] &= ~(fits[:-1] & (least[1:] == least[:-1]))
    begin = np.flatnonzero(opens)
    if not len(begin):
        return none, none, none, none
    n = np.add.reduceat(fits.astype(np.int64), begin)
    text = np.searchsorted(words.first, begin, side="right") - 1
    return text, begin - words.first[text], n, values[least[begin]]


def _minimisers(docs: DataFrame, window: int, mer: int) -> DataFrame:
    """(bucket, name, _id, _tag, at): minimiser and digest of the packed string of each super-k-mer, whose first word times
    64 plus its number of windows is `at`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, "_text"):
                    words = split_words(texts_of(rows, "_text"))
                    text, at, n, value = _spans(words, window, mer)
                    first = words.first[text] + at
                    data, name = words.data, xxhash.xxh3_128_digest
                    names = [name(data[a:b]) for a, b in zip(
                        words.starts[first].tolist(), words.ends[first + n + window - 2].tolist(), strict=True)]
                    of = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value), pa.array(names, pa.binary()), rows.column("_id").take(of),
                         rows.column("_tag").take(of), pa.array(at * 64 + n)], names=["bucket", "name", "_id", "_tag", "at"])

    kept = docs.select("_id", "_tag", "_text")
    return kept.mapInArrow(find, f"bucket bigint, name binary, {schema_of(kept, ('_text',))}, at bigint")


def _pack(met: DataFrame, window: int) -> DataFrame:
    """(bucket, packed, times, _id, _tag, word) for the super-k-mers listed in `spans`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, "_text"):
                    words = split_words(texts_of(rows, "_text"))
                    lists = rows.column("spans")
                    sizes = _lengths(lists)
                    text = np.repeat(np.arange(len(sizes)), sizes)
                    flat = lists.flatten()
                    at = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                    first = words.first[text] + at // 64
                    last = first + at % 64 + window - 2
                    data = words.data
                    packed = [data[a:b] for a, b in zip(
                        words.starts[first].tolist(), words.ends[last].tolist(), strict=True)]
                    of = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [flat.field(0), pa.array(packed, pa.binary()), flat.field(2), rows.column("_id").take(of),
                         rows.column("_tag").take(of), pa.array(at // 64)],
                        names=["bucket", "packed", "times", "_id", "_tag", "word"])

    own = schema_of(met.select("_id", "_tag"))
    return met.mapInArrow(pack, f"bucket bigint, packed binary, times bigint, {own}, word bigint")


def _digests(strings: DataFrame, window: int) -> DataFrame:
    """(digest, times, _id, _tag, word) for each window of distinct packed strings."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, "packed"):
                    words = split_words(texts_of(rows, "packed"))
                    n = np.diff(words.first) - window + 1
                    text = np.repeat(np.arange(len(n)), n)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    first = words.first[text] + nth
                    data, make = words.data, xxhash.xxh3_128_digest
                    found = [make(data[a:b]) for a, b in zip(
                        words.starts[first].tolist(), words.ends[first + window - 1].tolist(), strict=True)]
                    of = rows.select(["times", "_id", "_tag"]).take(pa.array(text))
                    word = rows.column("word").to_numpy()[text] + nth
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.binary()), *of.columns, pa.array(word)],
                        names=["digest", "times", "_id", "_tag", "word"])

    return strings.mapInArrow(digest, f"digest binary, {schema_of(strings.select('times', '_id', '_tag'))}, word bigint")


def _crowded(packed: DataFrame, window: int) -> DataFrame:
    """(_id, _tag, low, high) for distinct packed strings whose minimisers have too many of them for a bucket.

    What is joined back is a written table, so that the join has a shuffle on both sides and a crowded digest can be
    split between tasks.
    """
    windows = _digests(packed, window)
    again = materialize(windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "crowded-windows")
    return windows.where("times = 1").join(again, "digest", "left_semi").select(
        "_id", "_tag", F.col("word").alias("low"), (F.col("word") + window).alias("high"))


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, dtype=np.int64)


def _repeated(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows among packed strings: string number, first window, number of windows."""
    words = split_words(packed)
    hashes = window_hashes(word_hashes(words), window)
    counts = np.diff(words.first)
    inside = np.repeat(words.first[1:], counts)[:len(hashes)] - np.arange(len(hashes)) >= window
    starts = np.flatnonzero(inside)
    order = starts[np.argsort(hashes[starts], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    flags = np.zeros(len(hashes) + 1, dtype=bool)
    data = words.data
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    low, high = words.starts, words.ends
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        group = order[a:b + 1]
        texts = [data[x:y] for x, y in zip(low[group].tolist(), high[group + window - 1].tolist(), strict=True)]
        if texts.count(texts[0]) == len(texts):
            flags[group] = True
        else:  # different windows of one hash
            seen: dict[bytes, int] = {}
            for t in texts:
                seen[t] = seen.get(t, 0) + 1
            flags[group] = [seen[t] > 1 for t in texts]
    text = np.searchsorted(words.first, np.arange(len(flags)), side="right") - 1
    opens = flags.copy()
    opens[1:] &= ~(flags[:-1] & (text[1:] == text[:-1]))
    begin = np.flatnonzero(opens)
    n = np.add.reduceat(flags.astype(np.int64), begin) if len(begin) else begin
    return text[begin], begin - words.first[text[begin]], n


def _counted(packed: DataFrame, window: int) -> DataFrame:
    """(_id, _tag, low, high): ranges of words covered by windows that occur again in their bucket.

    Rows arrive sorted by bucket; whole buckets are sorted together, a few megabytes at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            text, first, n = _repeated(rows.column("packed").to_pylist(), window)
            single = rows.column("times").to_numpy()[text] == 1  # the others are repeated as a whole
            text, first, n = text[single], first[single], n[single]
            of = pa.array(text)
            low = rows.column("word").to_numpy()[text] + first
            chosen = rows.select(["_id", "_tag"]).take(of)
            return pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() for c in chosen.columns), pa.array(low), pa.array(low + n + window - 1)],
                names=["_id", "_tag", "low", "high"])

        with released():
            for batch in batches:
                for step in chunks(batch, "packed", SORT_BYTES):
                    held.append(step)
                    rows = pa.Table.from_batches(held)
                    bucket = rows.column("bucket").to_numpy()
                    cut = int(np.searchsorted(bucket, bucket[-1]))
                    if cut:
                        yield settle(rows.slice(0, cut))
                        held = rows.slice(cut).to_batches()
            if held:
                yield settle(pa.Table.from_batches(held))

    return packed.mapInArrow(count, f"{schema_of(packed.select('_id', '_tag'))}, low bigint, high bigint")


def _kept(met: DataFrame, as_is: bool) -> DataFrame:
    """The text without the words of its ranges, and both counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            for batch in batches:
                for rows in chunks(batch, "_text"):
                    texts = texts_of(rows, "_text")
                    words = split_words(texts)
                    ranges = rows.column("ranges")
                    sizes = _lengths(ranges)
                    base = np.repeat(words.first[:-1], sizes)
                    flat = ranges.flatten()
                    steps = np.zeros(len(words.starts) + 1, dtype=np.int64)
                    np.add.at(steps, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(steps, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
                    stays = np.cumsum(steps)[:-1] == 0
                    left = np.concatenate(([0], np.cumsum(stays)))
                    lengths = words.ends - words.starts + 1
                    data = np.frombuffer(words.data, dtype=np.uint8)[np.repeat(stays, lengths)].tobytes()
                    bounds = np.concatenate(([0], np.cumsum(lengths * stays)))[words.first].tolist()
                    kept = [data[a:max(a, b - 1)] for a, b in zip(bounds, bounds[1:], strict=False)]
                    n = np.diff(words.first)
                    gone = n - np.diff(left[words.first])
                    if as_is:
                        kept = [k if g else t for k, g, t in zip(kept, gone.tolist(), texts, strict=True)]
                    own = rows.drop_columns(["_text", "ranges"])
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(n), pa.array(gone), pa.array(kept, pa.binary()).cast(pa.string())],
                        names=[*own.schema.names, "_n", "_gone", "_kept"])

    return met.mapInArrow(cut, schema_of(met, ("_text", "ranges"), "_n bigint, _gone bigint, _kept string"))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, mer: int = MER_WORDS,
    hot_spans: int = HOT_SPANS, as_is: bool = False,
) -> DataFrame:
    """`docs` with `n_words`, `n_removed` and `kept`: the text without every word that lies in a repeated window.

    A window is `window` consecutive words of one text, compared byte by byte; it is repeated if its word sequence
    starts anywhere else, in the same text too. All its occurrences go, the first one included, and all windows are
    judged on the input. `kept` holds the remaining words joined by one space; null and blank texts give 0, 0 and ''.
    With `as_is`, a text that loses nothing keeps its white space (null becomes ''). An empty table gives none.
    Rows repeated with one id are documents like any other, so they remove each other. An input column named like a
    new one is replaced.
    """
    if not 0 < mer <= window or window - mer + 1 > 63:
        raise ValueError("a window holds 1 to 63 runs of mer words")
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("_id"), text_digest(text).alias("_tag"), F.col(text).alias("_text"),
                       carried(docs, doc_id, text))
    spans = _minimisers(slim, window, mer)
    buckets = materialize(spans.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "minimisers")
    live = materialize(spans.join(buckets, "bucket"), "live-spans")
    strings = materialize(live.groupBy("bucket", "name").agg(
        F.count("*").alias("times"), F.min(F.struct("_id", "_tag", "at")).alias("one")), "span-strings")
    whole = live.join(strings.where("times > 1").select("bucket", "name"), ["bucket", "name"], "left_semi").select(
        "_id", "_tag", F.expr("at div 64").alias("low"), F.expr(f"at div 64 + at % 64 + {window - 1}").alias("high"))
    mixed = materialize(strings.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "mixed-minimisers")
    span = F.struct("bucket", "one.at", "times")
    lists = materialize(strings.join(mixed, "bucket").groupBy("one._id", "one._tag").agg(
        F.collect_list(F.when(F.col("n") <= hot_spans, span)).alias("cold"),
        F.collect_list(F.when(F.col("n") > hot_spans, span)).alias("hot")), "span-lists")

    def with_docs(found: DataFrame, how: str) -> DataFrame:
        """Joins on id and text digest, a null id being an id; rows that agree in both have the same ranges."""
        found = found.withColumnsRenamed({"_id": "_id2", "_tag": "_tag2"})
        on = slim["_id"].eqNullSafe(found["_id2"]) & (slim["_tag"] == found["_tag2"])
        return slim.join(found, on, how).drop("_id2", "_tag2")

    def packed(kind: str) -> DataFrame:
        return _pack(with_docs(lists.where(F.size(kind) > 0).select("_id", "_tag", F.col(kind).alias("spans")), "inner"), window)

    cold = _counted(packed("cold").repartition("bucket").sortWithinPartitions("bucket"), window)
    hot = _crowded(packed("hot"), window)
    ranges = whole.union(cold).union(hot).groupBy("_id", "_tag").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    met = with_docs(ranges, "left").withColumn("ranges", F.coalesce("ranges", none))
    out = _kept(met.drop("_tag"), as_is)
    return restored(out, docs.drop(text), {"n_words": F.col("_n"), "n_removed": F.col("_gone"), "kept": F.col("_kept")},
                    **{doc_id: F.col("_id")})
