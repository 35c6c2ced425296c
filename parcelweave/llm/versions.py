"""Document fingerprints as invertible Bloom lookup sketches of the digests of a text's pieces.

A sketch is a table of cells; a digest is added to three of them (count, xor of digests, xor of checks). Sketches of two
versions subtract cell by cell, equal pieces vanish, and peeling cells that hold one digest recovers those that differ.
If peeling stops early, larger sketches are tried.

A piece is a line, cut at its sentence ends and then at borders that the characters before them choose, so that a change
moves no border further on.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.frames import carried, released, restored, schema_of, ship_package
from parcelweave.llm.words import mix

# Cells of the sketch that is the fingerprint: they peel some 85 differing digests, more than two versions of a text of
# usual length differ by. A retry has GROWTH times as many, the first one GROWTH times until all digests of both fit.
CELLS = 120
GROWTH = 4
TABLES = 3
# Cells per digest at which peeling nearly always succeeds.
ROOM = 1.4
# A border inside a sentence is chosen by the hash of so many characters before it, one in BORDERS of them; none lies
# nearer than LEAST_CHARS to another one or to the sentence's ends. What is still longer than MOST_CHARS is cut evenly.
REACH = 6
BORDERS = 16
LEAST_CHARS = 12
MOST_CHARS = 96
# Ranges of the document order for each shuffle partition, and at most.
RANGES_A_PARTITION = 4
MAX_RANGES = 20_000
# Characters of texts, and cells of sketches, that one vectorised step handles at once.
CHUNK_CHARS = 1 << 19
CHUNK_CELLS = 1 << 19
# A null id takes part as the least one, and its place among the ranges is beyond that of any other.
LEAST, NO_ID = -(1 << 63), 2.0**64

STOPS = [ord(c) for c in ".!?"]
WIDE_STOPS = [ord(c) for c in "。！？"]
SALTS = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9]], dtype=np.uint64)
OFFSETS = np.arange(TABLES)[:, None]
CHECK = np.uint64(0xFF51AFD7ED558CCD)
CELL = np.dtype([("n", "<i4"), ("key", "<u8"), ("check", "<u4")])


def _chosen(points: np.ndarray) -> np.ndarray:
    """Positions whose REACH characters before them choose a border."""
    n = len(points) - REACH + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    hashes = points[:n].copy()
    for i in range(1, REACH):
        hashes *= np.uint32(0x01000193)
        hashes ^= points[i:n + i]
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x85EBCA6B)
    return np.flatnonzero(hashes < np.uint32((1 << 32) // BORDERS)) + REACH


def _borders(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces; line feeds and the space after a sentence belong to none."""
    gap = points == 0x0A
    gap[1:] |= (points[1:] == 0x20) & np.logical_or.reduce([points[:-1] == c for c in STOPS])
    gaps = np.flatnonzero(gap)
    wide = np.flatnonzero(points >= 0x3000)
    wide = wide[np.isin(points[wide], WIDE_STOPS)] + 1 if len(wide) else wide
    starts = np.sort(np.concatenate(([0], gaps + 1, wide)))
    ends = np.sort(np.concatenate((gaps, wide, [len(points)])))
    full = ends > starts
    starts, ends = starts[full], ends[full]
    inner = _chosen(points)
    if len(inner) and len(starts):
        within = np.maximum(np.searchsorted(starts, inner, "right") - 1, 0)
        own = inner - starts[within] >= REACH  # chosen by characters of its own sentence
        inner, within = inner[own], within[own]
        kept = (inner - starts[within] >= LEAST_CHARS) & (ends[within] - inner >= LEAST_CHARS)
        kept[1:] &= (np.diff(inner) >= LEAST_CHARS) | (np.diff(within) > 0)
        inner = inner[kept]
        starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    parts = -(-(ends - starts) // MOST_CHARS)
    if len(parts) and parts.max() > 1:
        first = np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(starts, parts) + (np.arange(len(first)) - first) * MOST_CHARS
        starts, ends = at, np.minimum(at + MOST_CHARS, np.repeat(ends, parts))
    return starts, ends


def pieces(text: str) -> list[str]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts, ends = _borders(points)
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def digests(text: str) -> np.ndarray:
    """A 64-bit digest per piece; the second and later ones of equal pieces differ by their number."""
    seen: dict[str, int] = {}
    out = []
    for p in pieces(text):
        n = seen[p] = seen.get(p, -1) + 1
        out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), n))
    return np.array(out, dtype=np.uint64)


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ CHECK) >> np.uint64(32)).astype(np.uint32)


class Sketch:
    """Cells of a set of digests, or of the difference of two."""

    def __init__(self, cells: int):
        self.cells = cells
        self.counts = np.zeros(cells, dtype=np.int32)
        self.keys = np.zeros(cells, dtype=np.uint64)
        self.checks = np.zeros(cells, dtype=np.uint32)

    def add(self, keys: np.ndarray, signs: np.ndarray | int = 1) -> Sketch:
        part = self.cells // TABLES
        at = ((mix(keys ^ SALTS) % np.uint64(part)).view(np.int64) + OFFSETS * part).ravel()
        np.add.at(self.counts, at, np.tile(signs, TABLES) if np.ndim(signs) else np.int32(signs))
        np.bitwise_xor.at(self.keys, at, np.tile(keys, TABLES))
        np.bitwise_xor.at(self.checks, at, np.tile(_checks(keys), TABLES))
        return self

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.cells)
        out.counts = self.counts - other.counts
        out.keys, out.checks = self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests that are only in the first and only in the second set, or None if cells are left over."""
        first, second = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for _ in range(self.cells + 1):
            pure = np.flatnonzero((np.abs(self.counts) == 1) & (_checks(self.keys) == self.checks))
            if not len(pure):
                break
            keys, at = np.unique(self.keys[pure], return_index=True)
            signs = self.counts[pure][at]
            first.append(keys[signs > 0])
            second.append(keys[signs < 0])
            self.add(keys, -signs)
        if self.counts.any() or self.keys.any():
            return None
        return np.concatenate(first), np.concatenate(second)

    @classmethod
    def read(cls, stored: str) -> Sketch:
        """The sketch that a fingerprint column holds."""
        cells = np.frombuffer(base64.b64decode(stored), dtype=CELL)
        out = cls(len(cells))
        out.counts, out.keys, out.checks = cells["n"].copy(), cells["key"].copy(), cells["check"].copy()
        return out

    def __str__(self) -> str:
        cells = np.empty(self.cells, dtype=CELL)
        cells["n"], cells["key"], cells["check"] = self.counts, self.keys, self.checks
        return base64.b64encode(cells.tobytes()).decode()


class Version:
    """One text with its digests and the sketches made of them so far."""

    def __init__(self, text: str):
        self.text = text
        self.keys = digests(text)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, cells: int = CELLS) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch(cells).add(self.keys)
        return self.sketches[cells]

    def differing(self, other: Version) -> tuple[np.ndarray, np.ndarray]:
        """Digests of one version only, peeled from sketches of growing size.

        After the smallest sketch the next is large enough even if nothing is shared, then each is GROWTH times the one
        before. A table of many times the digests fails only if two of them share all cells; then they are compared
        directly.
        """
        total, cells = len(self.keys) + len(other.keys), CELLS
        while cells <= 64 * total + CELLS:
            found = self.sketch(cells).minus(other.sketch(cells)).peel()
            if found is not None:
                return found
            cells *= GROWTH
            while cells < ROOM * total:
                cells *= GROWTH
        return np.setdiff1d(self.keys, other.keys), np.setdiff1d(other.keys, self.keys)

    def likeness(self, other: Version) -> float:
        """Shared pieces over all: 1 for equal sets, also for two texts without a piece."""
        only = sum(map(len, self.differing(other)))
        total = len(self.keys) + len(other.keys)
        return (total - only) / (total + only) if total else 1.0


def _gather(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[k], begins[k] + 1, ... (sizes[k] of them) for each k."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Texts:
    """The digests of many texts at once: those of text i are keys[past[i]:past[i + 1]]."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)  # a line feed is in no piece
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts, ends = _borders(points) if len(points) else (np.empty(0, np.int64), np.empty(0, np.int64))
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        of = np.searchsorted(first, starts, "right") - 1
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))
        data, digest = joined.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest
        spans = list(zip(at[starts].tolist(), at[ends].tolist(), strict=True))
        self.keys = np.fromiter((digest(data[a:b]) for a, b in spans), dtype=np.uint64, count=len(spans))
        # Equal pieces of a text are told apart by their number, which is the seed of their digest.
        order = np.lexsort((self.keys, of))
        again = (np.diff(of[order], prepend=-1) == 0) & (np.diff(self.keys[order], prepend=np.uint64(0)) == 0)
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(order)))) if len(order) else order
        for i, n in zip(order[nth > 0].tolist(), nth[nth > 0].tolist(), strict=True):
            a, b = spans[i]
            self.keys[i] = digest(data[a:b], n)
        self.past = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
        self.counts = np.diff(self.past)

    def tables(self, which: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, keys and checks of the sketches of some texts, one after the other."""
        n = self.counts[which]
        keys = self.keys[_gather(self.past[which], n)]
        at = _cells(keys, np.repeat(np.arange(len(which)), n), cells).ravel()
        counts = np.bincount(at, minlength=len(which) * cells).astype(np.int32)
        sums, checks = np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts), dtype=np.uint32)
        np.bitwise_xor.at(sums, at, np.tile(keys, TABLES))
        np.bitwise_xor.at(checks, at, np.tile(_checks(keys), TABLES))
        return counts, sums, checks


def _cells(keys: np.ndarray, of: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each table, for sketches that lie one after the other."""
    part = cells // TABLES
    return (mix(keys ^ SALTS) % np.uint64(part)).view(np.int64) + OFFSETS * part + of * cells


def _peeled(counts: np.ndarray, keys: np.ndarray, checks: np.ndarray, cells: int) -> np.ndarray:
    """How many digests peeling recovers from each of the subtracted sketches, -1 where cells are left over."""
    n = len(counts) // cells
    found = np.zeros(n, dtype=np.int64)
    look = np.flatnonzero(np.abs(counts) == 1)
    for _ in range(cells + 1):
        pure = look[(np.abs(counts[look]) == 1) & (_checks(keys[look]) == checks[look])]
        if not len(pure):
            break
        of, own, signs = pure // cells, keys[pure], counts[pure]
        order = np.lexsort((own, of))
        of, own, signs = of[order], own[order], signs[order]
        fresh = np.ones(len(of), dtype=bool)
        fresh[1:] = (of[1:] != of[:-1]) | (own[1:] != own[:-1])
        of, own, signs = of[fresh], own[fresh], signs[fresh]
        found += np.bincount(of, minlength=n)
        look = _cells(own, of, cells).ravel()
        np.subtract.at(counts, look, np.tile(signs, TABLES))
        np.bitwise_xor.at(keys, look, np.tile(own, TABLES))
        np.bitwise_xor.at(checks, look, np.tile(_checks(own), TABLES))
    left = (counts != 0) | (keys != 0)
    found[left.reshape(n, cells).any(axis=1)] = -1
    return found


def likenesses(a: Texts, b: Texts, pairs: np.ndarray) -> np.ndarray:
    """Shared pieces over all of text pairs[k, 0] of `a` and pairs[k, 1] of `b`, as `Version.likeness` gives them.

    All pairs are tried with sketches of CELLS cells; those that do not peel, or whose numbers of digests differ by more
    than the cells could ever give back, go on to the next size that `Version.differing` takes.
    """
    n_a, n_b = a.counts[pairs[:, 0]], b.counts[pairs[:, 1]]
    total = n_a + n_b
    only = np.full(len(pairs), -1, dtype=np.int64)
    size = np.full(len(pairs), CELLS, dtype=np.int64)
    open_ = np.arange(len(pairs))
    while len(open_):
        cells = int(size[open_].min())
        now = open_[size[open_] == cells]
        tried = now[np.abs(n_a[now] - n_b[now]) <= cells]
        step = max(1, CHUNK_CELLS // cells)
        for at in range(0, len(tried), step):
            some = tried[at:at + step]
            first, second = a.tables(pairs[some, 0], cells), b.tables(pairs[some, 1], cells)
            only[some] = _peeled(first[0] - second[0], first[1] ^ second[1], first[2] ^ second[2], cells)
        failed = now[only[now] < 0]
        size[failed] *= GROWTH
        while (small := size[failed] < ROOM * total[failed]).any():
            size[failed[small]] *= GROWTH
        for k in failed[size[failed] > 64 * total[failed] + CELLS].tolist():  # digests that share all cells
            x, y = (t.keys[t.past[i]:t.past[i + 1]] for t, i in zip((a, b), pairs[k].tolist(), strict=True))
            only[k] = len(np.setxor1d(x, y))
        open_ = open_[only[open_] < 0]
    return np.where(total > 0, (total - only) / np.maximum(total + only, 1), 1.0)


def _stored(texts: Texts, n: int) -> list[str]:
    """The fingerprint column of the first `n` texts."""
    out: list[str] = []
    step = max(1, CHUNK_CELLS // CELLS)
    for at in range(0, n, step):
        which = np.arange(at, min(n, at + step))
        cells = np.empty(len(which) * CELLS, dtype=CELL)
        cells["n"], cells["key"], cells["check"] = texts.tables(which, CELLS)
        data, size = cells.tobytes(), CELLS * CELL.itemsize
        out += [base64.b64encode(data[i:i + size]).decode() for i in range(0, len(data), size)]
    return out


def _facts(texts: list[str], pairs: list[tuple[int, int]]) -> list[list]:
    """The new columns for each pair (text, the text after it in the order)."""
    edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[j][:len(texts[i]) // 2] for i, j in pairs]
    used = [i for i, _ in pairs] + [j for _, j in pairs]
    place = {i: k for k, i in enumerate(dict.fromkeys(used))}
    own, new = Texts([texts[i] for i in place]), Texts(edited)
    of = np.array([(place[i], place[j]) for i, j in pairs], dtype=np.int64)
    stored = _stored(own, len(place))
    return [[len(texts[i]) for i, _ in pairs],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            [stored[i] for i in of[:, 0].tolist()], _stored(new, len(edited)),
            likenesses(own, new, np.stack([of[:, 0], np.arange(len(pairs))], axis=1)).tolist(), likenesses(own, own, of).tolist()]


def _ranges(docs: DataFrame) -> DataFrame:
    """`docs` with `_range`, numbered in the order of descending `_key` and rising `_tag`, and `_guest`, 0; the first row
    of each range is also given to the range before it (to the last one, for the first), with `_guest` 1.

    Borders are quantiles of the ids; an id that fills several quantiles gets ranges of its own, by its tags. One number
    per range goes through the driver.
    """
    spark = docs.sparkSession
    n = min(MAX_RANGES, RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    as_double = docs.withColumn("_at", F.when(F.col("_key") == LEAST, NO_ID).otherwise(-F.col("_key").cast("double")))
    quantiles = Counter(as_double.approxQuantile("_at", [i / n for i in range(1, n)], 1 / (4 * n)))
    # Beyond 2^53 a double may stand for several ids.
    hot = {at: times + 1 for at, times in quantiles.items() if times > 1 and (abs(at) < 2.0**53 or at == NO_ID)}
    borders = sorted({*quantiles, *(float(np.nextafter(at, np.inf)) for at in hot)})
    splits = [float("-inf"), *borders, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    shares = spark.createDataFrame([(splits.index(at), times) for at, times in hot.items()], "_wide int, _shares int")
    share = F.least(F.floor((F.col("_tag").cast("double") / 2.0**64 + 0.5) * F.col("_shares")), F.col("_shares") - 1)
    ranged = Bucketizer(splits=splits, inputCol="_at", outputCol="_wide").transform(as_double).withColumn(
        "_wide", F.col("_wide").cast("int")).join(F.broadcast(shares), "_wide", "left").withColumn(
        "_range", F.col("_wide").cast("long") * MAX_RANGES + F.coalesce(share, F.lit(0))).drop("_at", "_wide", "_shares")
    highest = ranged.groupBy("_range").agg(F.max("_key").alias("_key"))
    firsts = ranged.join(F.broadcast(highest), ["_range", "_key"]).groupBy("_range", "_key").agg(F.min("_tag").alias("_tag"))
    found = sorted((r["_range"], r["_key"], r["_tag"]) for r in firsts.collect())
    hosts = [(key, tag, number, found[i - 1][0]) for i, (number, key, tag) in enumerate(found)]
    names = "_key bigint, _tag bigint, _range bigint, _host bigint"
    guests = ranged.join(F.broadcast(spark.createDataFrame(hosts, names)), ["_key", "_tag", "_range"]).groupBy("_host").agg(
        F.first(F.struct(*docs.columns)).alias("row"))  # rows of one id and text are alike
    own: list[Column] = [F.col(c) for c in docs.columns]
    return ranged.select(*own, "_range", F.lit(0).alias("_guest")).union(
        guests.select("row.*", F.col("_host").alias("_range"), F.lit(1).alias("_guest")))


def fingerprint_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without its text, with `n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next`.

    The edited text of a document replaces its last floor(n / 2) code points by the first as many (or all) of the next
    document in descending id order, nulls last; the last is followed by the first. Rows of one id go by text hash.
    Null is the empty text: no piece, likeness 1 to another empty one and 0 to all others. Rows are dealt in
    ranges of the order (of one id that holds very many rows, of its text hashes) and streamed, some hundred thousand
    characters or two texts at a time. An empty table gives an empty result. An input column named like a new one is
    replaced.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("_key"), F.xxhash64(text).alias("_tag"),
                       F.coalesce(F.col(text), F.lit("")).alias("_text"), carried(docs, text))
    dealt = _ranges(slim).repartition("_range").sortWithinPartitions("_range", "_guest", F.desc("_key"), "_tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows that wait for the text after them: own columns, number of the range, text.
        held: list[tuple[pa.RecordBatch, int, str]] = []
        chars = 0

        def settle() -> pa.RecordBatch | None:
            pairs = [(i, i + 1) for i in range(len(held) - 1) if held[i][0] is not None and held[i][1] == held[i + 1][1]]
            if not pairs:
                return None
            rows = pa.Table.from_batches([held[i][0] for i, _ in pairs]).combine_chunks()
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            facts = _facts([t for _, _, t in held], pairs)
            return pa.RecordBatch.from_arrays(
                [rows.column(0).chunk(0), *(pa.array(c, k) for c, k in zip(facts, kinds, strict=True))],
                names=["_rest", "_n", "_sha", "_own", "_edited", "_near", "_next"])

        with released():
            for batch in batches:
                own = batch.select(["_rest"])
                columns = zip(batch.column("_range").to_pylist(), batch.column("_guest").to_pylist(), batch.column("_text"), strict=True)
                for i, (number, guest, value) in enumerate(columns):
                    text = value.as_py()
                    held.append((None if guest else own.slice(i, 1), number, text))
                    chars += len(text)
                    if chars > CHUNK_CHARS and len(held) > 1:
                        made = settle()
                        if made is not None:
                            yield made
                        held, chars = held[-1:], len(text)
            made = settle()
            if made is not None:
                yield made

    schema = f"{schema_of(dealt.select('_rest'))}, _n bigint, _sha string, _own string, _edited string, _near double, _next double"
    out = dealt.mapInArrow(run, schema)
    return restored(out, docs.drop(text), {
        "n_chars": F.col("_n"), "edited_sha256": F.col("_sha"), "fingerprint": F.col("_own"),
        "edited_fingerprint": F.col("_edited"), "near_edited": F.col("_near"), "near_next": F.col("_next")})
