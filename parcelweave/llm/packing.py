"""Vector bin packing of token pieces into sequences, by the dot-product heuristic.

A piece has three sizes: tokens, one segment, and loss-bearing tokens; a sequence has a limit for each. Documents longer
than a sequence give full sequences of their own; what remains of them, and all shorter documents, is packed. Every task
packs its own partition in pools of bounded size, so only sizes are held, nothing is shuffled, and memory does not follow
the input.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelweave.llm.frames import carried, chunks, released, restored, schema_of, ship_package

SEQUENCE_TOKENS = 4096
# Segments of a sequence of instruction data; plain documents may fill one with single tokens.
MAX_SEGMENTS = 256
MAX_LOSS_TOKENS = 4096
END_ID = 2
POOL_PIECES = 20_000
# Entries of the token caches of one task; a cache starts anew when it is full.
CACHED_WORDS = 50_000
CACHED_PIECES = 150_000
# Text bytes whose distinct words are looked up together.
LOOKUP_BYTES = 1 << 20

MAX_CACHED_CHARS = 64
SPLITS_MORE = re.compile(r"[\x1c-\x1f]")


class WordTokens:
    """Token ids of whole texts for a BPE whose pieces never span white space, with the ids of each word cached.

    Normalisation and the split into pieces follow the tokenizer's own file; merges are done by the tokenizer's model.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.model = self.tokenizer.model
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["use_regex"]:
            raise ValueError("not a lower-casing word BPE")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.alphabet = _byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            shown = piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(piece) <= MAX_CACHED_CHARS:
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._piece(word)
        found = self.words.get(word)
        if found is None:
            found = b"".join(map(self._piece, self.pattern.findall(word)))
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            if len(word) <= MAX_CACHED_CHARS:
                self.words[word] = found
        return found

    def forget(self) -> None:
        self.words, self.pieces = {}, {}

    def _special(self, text: str) -> bool:
        """Added tokens may join or split words, and U+001C to U+001F are white space to str.split() alone."""
        return ("<" in text and any(t in text.lower() for t in self.added)) or bool(SPLITS_MORE.search(text))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words are looked up once for each distinct word of the batch."""
        apart = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4")
                 for i, t in enumerate(texts) if self._special(t)}
        # Letters are lowered one by one, so a final sigma has no form of its own.
        lists = [[] if i in apart else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower().split()
                 for i, t in enumerate(texts)]
        words = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
        found = list(map(self._word, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        code = words.indices.to_numpy()
        n = sizes[code]
        upto = np.cumsum(n)
        ids = flat[np.repeat(begins[code] - (upto - n), n) + np.arange(n.sum())]
        last = np.concatenate(([0], upto))[np.cumsum([len(x) for x in lists])]
        return [apart.get(i, ids[a:b]) for i, (a, b) in enumerate(zip([0, *last[:-1].tolist()], last.tolist(), strict=True))]


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


_LOADED: dict[int, WordTokens] = {}


def _tokens(text: str) -> WordTokens:
    key = zlib.crc32(text.encode())
    if key not in _LOADED:
        _LOADED[key] = WordTokens(text)
    return _LOADED[key]


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, for limits on tokens, segments and loss-bearing tokens.

    One sequence is open at a time. It takes, again and again, the fitting piece whose sizes, as parts of the limits,
    have the largest dot product with what the sequence has left, until nothing fits (a piece is one segment, so that
    term is the same for all). Pieces of equal sizes are one kind with a count, so a step looks at kinds, not pieces.
    """
    kinds, kind_of, counts = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True, return_counts=True)
    queue = np.argsort(kind_of.ravel(), kind="stable")
    after = np.cumsum(counts)
    next_of = after - counts
    sequence, offset = np.empty(len(tokens), dtype=np.int64), np.empty(len(tokens), dtype=np.int64)
    alive = np.arange(len(kinds))
    number = 0
    while len(alive):
        size, bears = kinds[alive, 0], kinds[alive, 1]
        token_part, loss_part = size / limits[0], bears / limits[2]
        left, left_segments, left_loss = limits
        while left_segments:
            n = int(np.searchsorted(size, left, side="right"))  # kinds are sorted by tokens
            if not n:
                break
            score = token_part[:n] * (left / limits[0]) + loss_part[:n] * (left_loss / limits[2])
            score[bears[:n] > left_loss] = -1
            best = int(score.argmax())
            if score[best] < 0:
                break
            at = alive[best]
            piece = queue[next_of[at]]
            sequence[piece], offset[piece] = number, limits[0] - left
            next_of[at] += 1
            left, left_segments, left_loss = left - int(size[best]), left_segments - 1, left_loss - int(bears[best])
            if next_of[at] == after[at]:
                bears[best] = limits[2] + 1  # none of this kind is left
        alive = alive[next_of[alive] < after[alive]]
        number += 1
    return sequence, offset


def pack_pieces(
    docs: DataFrame, pieces_of: Callable[[pa.RecordBatch], tuple[list[np.ndarray], list[np.ndarray | None]]], text: str,
    limits: tuple[int, int, int], pool: int = POOL_PIECES,
) -> DataFrame:
    """The columns of `docs` but `text`, once for each piece, with `_start _length _crc _all _loss _sequence _offset`.

    `pieces_of` gives the ids of each row (unsigned 32-bit) and which of them bear loss (None: all).
    """
    length = min(limits[0], limits[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        waiting: list[tuple[pa.RecordBatch, np.ndarray]] = []
        held = 0

        def settle() -> pa.RecordBatch:
            nonlocal base
            own = pa.Table.from_batches([rows for rows, _ in waiting]).combine_chunks()
            facts = np.concatenate([facts for _, facts in waiting])
            sequence, offset = pack(facts[:, 1], facts[:, 4], limits)
            sequence += base
            base = int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays(
                [*(c.chunk(0) for c in own.columns), *map(pa.array, facts.T.copy()), pa.array(sequence), pa.array(offset)],
                names=[*own.schema.names, "_start", "_length", "_crc", "_all", "_loss", "_sequence", "_offset"])

        with released(*(tokens.forget for tokens in _LOADED.values())):
            for batch in batches:
                for rows in chunks(batch, text, LOOKUP_BYTES):
                    ids, masks = pieces_of(rows)
                    of, facts = [], []
                    for i, (row, mask) in enumerate(zip(ids, masks, strict=True)):
                        total = len(row)
                        for start in range(0, total, length):
                            part = row[start:start + length]
                            n = len(part)
                            loss = n if mask is None else int(mask[start:start + n].sum())
                            of.append(i)
                            facts.append((start, n, zlib.crc32(part.tobytes()), total, loss))
                    if of:
                        waiting.append((rows.drop_columns([text]).take(pa.array(of)), np.array(facts, dtype=np.int64)))
                        held += len(of)
                    if held >= pool:
                        yield settle()
                        waiting, held = [], 0
            if held:
                yield settle()

    new = "_start bigint, _length bigint, _crc bigint, _all bigint, _loss bigint, _sequence bigint, _offset bigint"
    return docs.mapInArrow(run, schema_of(docs, (text,), new))


def pack_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", sequence_tokens: int = SEQUENCE_TOKENS,
    max_segments: int = SEQUENCE_TOKENS, max_loss: int = MAX_LOSS_TOKENS, end_id: int = END_ID,
) -> DataFrame:
    """`docs` without its text, one row per piece: `start length ids_crc32 doc_tokens sequence_id offset`.

    A document's ids are those of the tokenizer file `vocabulary`, then `end_id`; every id bears loss. A null or empty
    text is `end_id` alone; repeated rows are packed like others. Only documents longer than a sequence are cut, at its
    multiples. The vocabulary (a few MB, whatever the data) goes to the tasks with their code. A row of an empty table
    gives none. An input column named like a new one is replaced. Sequence ids hold the task's number, so they change
    with the file splits.
    """
    ship_package(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4")

    def pieces_of(rows: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
        tokens = _tokens(spec.value)
        ids = [np.concatenate((x, end)) for x in tokens.batch([t or "" for t in rows.column("_text").to_pylist()])]
        return ids, [None] * len(ids)

    slim = docs.select(F.col(text).alias("_text"), carried(docs, text))
    out = pack_pieces(slim, pieces_of, "_text", (sequence_tokens, max_segments, max_loss))
    return restored(out, docs.drop(text), {
        "start": F.col("_start"), "length": F.col("_length"), "ids_crc32": F.col("_crc"), "doc_tokens": F.col("_all"),
        "sequence_id": F.col("_sequence"), "offset": F.col("_offset")})


def pack_windows(
    windows: DataFrame, vocabulary: str, text: str = "formatted", loss: str = "loss", sequence_tokens: int = SEQUENCE_TOKENS,
    max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS_TOKENS // 2, end_id: int = END_ID,
) -> DataFrame:
    """Instruction data, such as the windows of chat formatting, under all three limits.

    `loss` lists the places [low, high), in code points of `text` and in order, whose tokens bear loss; `end_id` closes a
    window and bears none. Text is tokenized up to each border, so that no token lies on both sides. Gives `windows`
    without `text` and `loss`, one row per piece: `start length loss_tokens sequence_id offset`. A null text is empty, a
    null mask bears no loss; a window over the token or the loss limit is cut at multiples of the smaller one.
    """
    ship_package(windows.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = windows.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4")

    def pieces_of(rows: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
        parts, bears, upto = [], [], []
        for whole, spans in zip(rows.column("_text").to_pylist(), rows.column("_spans").to_pylist(), strict=True):
            whole, at = whole or "", 0
            for span in spans or []:
                parts += (whole[at:span["low"]], whole[span["low"]:span["high"]])
                bears += (False, True)
                at = span["high"]
            parts.append(whole[at:])
            bears.append(False)
            upto.append(len(parts))
        found = _tokens(spec.value).batch(parts)
        masks = [np.full(len(ids), bear) for ids, bear in zip(found, bears, strict=True)]
        own = [slice(a, b) for a, b in zip([0, *upto[:-1]], upto, strict=True)]
        return [np.concatenate((*found[s], end)) for s in own], [np.concatenate((*masks[s], [False])) for s in own]

    slim = windows.select(F.col(text).alias("_text"), F.col(loss).alias("_spans"), carried(windows, text, loss))
    out = pack_pieces(slim, pieces_of, "_text", (sequence_tokens, max_segments, max_loss))
    return restored(out, windows.drop(text, loss), {
        "start": F.col("_start"), "length": F.col("_length"), "loss_tokens": F.col("_loss"),
        "sequence_id": F.col("_sequence"), "offset": F.col("_offset")})
