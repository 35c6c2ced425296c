"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both tokenizations of a text are arrays of token ends. Where tokens go one to one, the arrays agree at a fixed index
shift; runs of agreement are jumped by comparing slices of doubling length. Where they part, both sides are advanced to
the next common end, which closes an irregular group, each step being one pair of overlapping tokens, and the shift is
updated.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelweave.llm.frames import carried, chunks, materialize, released, restored, schema_of, ship_package

# Pairs that hold more than this part of all links are looked up in a shared table; there are no more of them than that.
SHARED_PAIRS = 1 << 16
# Texts are given to the tokenizers word by word, cut at a single space between two words, where no token can cross; words
# are kept for a task, so many at most, and looked up together for so many bytes of text.
CACHED_WORDS = 200_000
MAX_CACHED_CHARS = 64
LOOKUP_BYTES = 4 << 20
ID_DIGITS = 6
# Fixed value: the pattern by which byte-level tokenizers split a text before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_RANKED_CHARS = 256
# Ends that the first probe along a diagonal compares; shorter runs are followed end by end.
PROBE = 8
BETWEEN_WORDS = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def align(ends_a: array, ends_b: array) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], array, array]:
    """Runs (i, j, n) of one-to-one groups, irregular groups (i, past i, j, past j), and the links inside the latter.

    Both arrays rise strictly and end at the same value.
    """
    runs, groups, link_a, link_b = [], [], array("q"), array("q")
    i = j = 0
    n_a, n_b = len(ends_a), len(ends_b)
    while i < n_a:
        most = min(n_a - i, n_b - j)
        n, step = 0, PROBE
        while step <= most - n and ends_a[i + n:i + n + step] == ends_b[j + n:j + n + step]:
            n += step
            step *= 2
        while step > PROBE:
            step //= 2
            if step <= most - n and ends_a[i + n:i + n + step] == ends_b[j + n:j + n + step]:
                n += step
        while n < most and ends_a[i + n] == ends_b[j + n]:
            n += 1
        if n:
            runs.append((i, j, n))
            i, j = i + n, j + n
            if i == n_a:
                break
        first_a, first_b = i, j
        a, b = ends_a[i], ends_b[j]
        while True:
            link_a.append(i)
            link_b.append(j)
            if a < b:
                i += 1
                a = ends_a[i]
            elif b < a:
                j += 1
                b = ends_b[j]
            else:
                break
        i, j = i + 1, j + 1
        groups.append((first_a, i, first_b, j))
    return runs, groups, link_a, link_b


def _gather(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[k], begins[k] + 1, ... (sizes[k] of them) for each k."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def grouped(ids_a: np.ndarray, ids_b: np.ndarray, past_a: np.ndarray, past_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2`: the ids of all groups, group k ending before ids_a[past_a[k]] and ids_b[past_b[k]]."""
    n_a, n_b = (np.diff(past, prepend=0) for past in (past_a, past_b))
    ids = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(past_b - n_b, n_a)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(past_a, n_b)] = ids_b
    mark[past_a + past_b - n_b - 1] = ord("|")
    mark[past_a + past_b - 1] = ord(";")
    signs = np.empty((len(ids), ID_DIGITS + 1), dtype=np.uint8)
    rest = ids.astype(np.int32)
    for at in range(ID_DIGITS - 1, -1, -1):
        rest, digit = np.divmod(rest, 10)
        signs[:, at] = digit + ord("0")
    signs[:, ID_DIGITS] = mark
    lengths = np.searchsorted(10 ** np.arange(1, ID_DIGITS), ids, side="right") + 1
    shown = np.arange(ID_DIGITS + 1) >= (ID_DIGITS - lengths)[:, None]
    return signs[shown].tobytes()[:-1]


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: itself if it prints, else counted from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(others)}


class TokenPair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes):
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of = _byte_of()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.ranked = self._as_ranks(json.loads(byte_level))
        if max(len(self.bytes_a), len(self.bytes_b)) > 10**ID_DIGITS:
            raise ValueError("a vocabulary of more than a million tokens")
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def forget(self) -> None:
        self.words = {}

    def _as_ranks(self, spec: dict) -> tiktoken.Encoding | None:
        """The same vocabulary as ranks, which encode faster, if its merges are numbered in their order."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocabulary, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        made = [vocabulary.get(left + right) for left, right in merges]
        if made != list(range(256, 256 + len(made))) or not spec["pre_tokenizer"].get("use_regex") or spec["normalizer"]:
            return None
        ranks = {self.bytes_a[i]: i for token, i in vocabulary.items() if token not in added}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _byte_level(self, word: str) -> list[int]:
        if self.ranked is not None and len(word) <= MAX_RANKED_CHARS:
            return self.ranked.encode_ordinary(word)
        return self.a.encode(word, add_special_tokens=False).ids

    def _encoded(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of each word by both tokenizers, as 32-bit numbers; None if its bytes are not spelled out."""
        raw = [(" " + w).encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        spelled, ids = np.ones(len(words), dtype=bool), []
        lists_a = [self._byte_level(" " + w) for w in words]
        for lists, table, sizes in ((lists_a, self.bytes_a, self.sizes_a), (self.b.encode(words, num_threads=1), self.bytes_b, self.sizes_b)):
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32)
            past = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))))
            spelled &= np.diff(np.concatenate(([0], np.cumsum(sizes[flat])))[past]) == lengths
            if b"".join(map(table.__getitem__, flat.tolist())) != b"".join(raw):
                spelled &= [b"".join(map(table.__getitem__, x)) == r for x, r in zip(lists, raw, strict=True)]
            held, bounds = flat.tobytes(), (4 * past).tolist()
            ids.append([held[x:y] for x, y in zip(bounds, bounds[1:], strict=False)])
        return [(a, b) if ok else None for a, b, ok in zip(*ids, spelled.tolist(), strict=True)]

    def _of_words(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of each different word, looked up or encoded."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words, new = {}, words
        found = dict(zip(new, self._encoded(new), strict=True))
        out = [found[w] if w in found else self.words[w] for w in words]
        self.words.update((w, ids) for w, ids in found.items() if len(w) <= MAX_CACHED_CHARS)
        return out

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by both tokenizers; none if one of them does not spell out its bytes."""
        lists = [BETWEEN_WORDS.split(t) if t else [] for t in texts]
        words = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
        found = self._of_words(words.dictionary.to_pylist())
        code = words.indices.to_numpy()
        past = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        missing = np.concatenate(([0], np.cumsum(np.array([f is None for f in found], dtype=np.int64)[code])))
        whole = missing[past[1:]] == missing[past[:-1]]
        sides = []
        for side in (0, 1):
            held = [f[side] if f else b"" for f in found]
            sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
            begins = np.cumsum(sizes) - sizes
            n = sizes[code]
            flat = np.frombuffer(b"".join(held), dtype=np.int32)[_gather(begins[code], n)].astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(n)))[past].tolist()
            sides.append([flat[x:y if ok else x] for x, y, ok in zip(bounds, bounds[1:], whole.tolist(), strict=False)])
        return list(zip(*sides, strict=True))


_LOADED: dict[int, TokenPair] = {}


def _pair(byte_level: str, pieces: bytes) -> TokenPair:
    key = zlib.crc32(pieces, zlib.crc32(byte_level.encode()))
    if key not in _LOADED:
        _LOADED[key] = TokenPair(byte_level, pieces)
    return _LOADED[key]


def _aligned_text(tokens: TokenPair, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple:
    """n_a, n_b, n_groups, n_links, digest of the groups, distinct id pairs linked, and how often each is."""
    if not len(ids_a):
        return 0, 0, 0, 0, "", np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    runs, groups, link_a, link_b = align(
        array("q", np.cumsum(tokens.sizes_a[ids_a]).tobytes()), array("q", np.cumsum(tokens.sizes_b[ids_b]).tobytes()))
    first = np.array(runs, dtype=np.int64).reshape(-1, 3)
    others = np.array(groups, dtype=np.int64).reshape(-1, 4)
    one_a, one_b = _gather(first[:, 0], first[:, 2]), _gather(first[:, 1], first[:, 2])
    past_a, past_b = (np.sort(np.concatenate((one + 1, others[:, k]))) for one, k in ((one_a, 1), (one_b, 3)))
    digest = hashlib.sha256(grouped(ids_a, ids_b, past_a, past_b)).hexdigest()
    at_a, at_b = np.concatenate((one_a, np.frombuffer(link_a, dtype=np.int64))), np.concatenate((one_b, np.frombuffer(link_b, dtype=np.int64)))
    pairs, times = np.unique(ids_a[at_a] * len(tokens.bytes_b) + ids_b[at_b], return_counts=True)
    return len(ids_a), len(ids_b), len(past_a), len(at_a), digest, pairs, times


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))


def _aligned(docs: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """A row of each document with its counts, digest and linked id pairs; `_row` numbers the rows."""
    shared = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _pair(*shared.value)
        row = TaskContext.get().partitionId() << 40
        with released(tokens.forget):
            for batch in batches:
                for rows in chunks(batch, "_text", LOOKUP_BYTES):
                    texts = [t or "" for t in rows.column("_text").to_pylist()]
                    found = [_aligned_text(tokens, a, b) for a, b in tokens.ids(texts)]
                    columns = list(zip(*found, strict=True))
                    own = rows.drop_columns(["_text"])
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(np.arange(row, row + len(found))),
                         *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()),
                         _lists(columns[5]), _lists(columns[6])],
                        names=[*own.schema.names, "_row", "_a", "_b", "_groups", "_links", "_sha", "_pairs", "_times"])
                    row += len(found)

    return docs.mapInArrow(run, schema_of(docs, ("_text",), (
        "_row bigint, _a bigint, _b bigint, _groups bigint, _links bigint, _sha string, _pairs array<bigint>, "
        "_times array<bigint>")))


def _settled(aligned: DataFrame, frequent: DataFrame) -> DataFrame:
    """(_row, best, total, pairs, times): what the frequent pairs add to a document, and its other pairs."""
    rows = sorted((r["pair"], r["n"], r["best"]) for r in frequent.collect())  # at most SHARED_PAIRS
    shared = aligned.sparkSession.sparkContext.broadcast(np.array(rows, dtype=np.int64).reshape(-1, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, bests = shared.value.T
        with released():
            for batch in batches:
                lists = batch.column("_pairs")
                sizes = np.diff(lists.offsets.to_numpy())
                pairs = lists.flatten().to_numpy()
                times = batch.column("_times").flatten().to_numpy()
                of = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
                best, total = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
                np.add.at(best, of[hit], times[hit] * bests[at[hit]])
                np.add.at(total, of[hit], times[hit] * counts[at[hit]])
                bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[~hit], minlength=len(sizes))))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), pa.array(best), pa.array(total),
                     pa.ListArray.from_arrays(bounds, pa.array(pairs[~hit])),
                     pa.ListArray.from_arrays(bounds, pa.array(times[~hit]))],
                    names=["_row", "best", "total", "pairs", "times"])

    return aligned.select("_row", "_pairs", "_times").mapInArrow(
        run, "_row bigint, best bigint, total bigint, pairs array<bigint>, times array<bigint>")


def align_tokenizers(
    docs: DataFrame, byte_level: str, pieces: str, text: str = "text", shared_pairs: int = SHARED_PAIRS,
) -> DataFrame:
    """`docs` without its text, with `n_a n_b n_groups n_links n_best count_sum groups_sha256`.

    A is the byte-level tokenizer file `byte_level` over a space and the text, B the piece model `pieces` over the text;
    strings of special tokens are plain text. Byte offsets where tokens of both end cut them into groups; overlapping
    tokens are linked. `n_best` counts the links whose id pair has the highest corpus-wide count of its B id, `count_sum`
    adds up the corpus-wide counts of a document's links. Null and empty texts, and texts that a tokenizer does not
    spell out byte by byte, have no tokens: zeros and ''. Repeated rows count each time; an empty table gives none; an
    input column named like a new one is replaced.

    Pairs that hold at least one in `shared_pairs` links are settled where the documents lie (there are no more than
    `shared_pairs` of them, whatever the data); all others are counted by a join in which, therefore, no key is hot.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        spec, model = f.read(), g.read()
    n_pieces = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    slim = docs.select(F.col(text).alias("_text"), carried(docs, text))
    aligned = materialize(_aligned(slim, spec, model), "aligned-documents")
    each = aligned.select(F.explode(F.arrays_zip("_pairs", "_times")).alias("z"))
    counts = materialize(each.groupBy(F.col("z._pairs").alias("pair")).agg(F.sum("z._times").alias("n")), "pair-counts")
    highest = counts.groupBy((F.col("pair") % n_pieces).alias("b")).agg(F.max("n").alias("most"))  # a row a piece of B
    rated = materialize(counts.join(F.broadcast(highest), F.col("pair") % n_pieces == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "rated-pairs")
    links = rated.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * shared_pairs >= links
    settled = materialize(_settled(aligned, rated.where(often)), "settled-documents")
    rare = settled.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("_row", "z.pairs", "z.times")
    met = rare.join(rated.where(~often), F.col("pairs") == F.col("pair")).select(
        "_row", (F.col("times") * F.col("best")).alias("best"), (F.col("times") * F.col("n")).alias("total"))
    sums = settled.select("_row", "best", "total").union(met).groupBy("_row").agg(
        F.sum("best").alias("_best"), F.sum("total").alias("_total"))
    out = aligned.drop("_pairs", "_times").join(sums, "_row")
    return restored(out, docs.drop(text), {
        "n_a": F.col("_a"), "n_b": F.col("_b"), "n_groups": F.col("_groups"), "n_links": F.col("_links"),
        "n_best": F.col("_best"), "count_sum": F.col("_total"), "groups_sha256": F.col("_sha")})
