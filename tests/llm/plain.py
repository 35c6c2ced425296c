"""Plain single-process versions of the operators, and awkward rows to hold them against."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names the operators use inside or add themselves.
CLASHING = ("_text", "_id", "_rest", "_tag", "_fp", "size", "score", "bucket", "Fingerprint", "start", "kept", "held_out")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
NEAR = " ".join(f"near{i} copy{i * 7 % 13}" for i in range(150))

AWKWARD = [
    (1, "The quick brown fox.\nIt jumps over the lazy dog.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\x0b ", None, "b"),
    (5, "x", "en", None),
    (6, "The quick brown fox.\nIt jumps over the lazy dog.", "en", "b"),
    (6, "The quick brown fox.\nIt jumps over the lazy dog.", "en", "b"),
    (7, LONG, "en", "hot"),
    (8, LONG + " end", "en", "hot"),
    (None, "a row without an id " + PASSAGE, "en", "hot"),
    (None, "another row without an id", None, "hot"),
    (9, "before " + PASSAGE + " after", "en", "hot"),
    (10, "le chat noir dort sur la chaise " + PASSAGE, "fr", "hot"),
    (11, "Straße İstanbul ΣΑΣ \x1c 日本語   é é <|endoftext|> </s>[INST]", "de", "ü"),
    (12, "same same " * 60, "en", "a"),
    (13, NEAR, "en", "a"),
    (14, NEAR + " tail", "en", "c"),
    (15, "123 456 !!! ---", None, "c"),
    (-5, "negative id words", "en", "c"),
]


def documents(spark, rows=None, clashing=True):
    rows = AWKWARD if rows is None else rows
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOC_SCHEMA)
    if clashing:
        for i, name in enumerate(CLASHING):
            docs = docs.selectExpr("*", f"{i} AS `{name}`")
    return docs


def words(text):
    return WORD.findall(text or "")


def simhash(text, shingle=3, seed=42):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(found[i:i + shingle]) for i in range(max(1, len(found) - shingle + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def linked(prints, max_bits=2):
    """Component number of each fingerprint, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def without_repeats(texts, window=35):
    """(words, removed, kept text) of each text."""
    lists = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Target of each source of {source: size}: the excess over the most repeats is reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        found = {s: repeats * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        new = {s for s in names if s not in full and found[s] > repeats * sizes[s]}
        if not new:
            return found
        full |= new


def sainte_lague(votes, seats):
    """Seats of each item, one at a time to the highest quotient, ties to the smaller item."""
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda i: (-votes[i] / (2 * won[i] + 1), i))
        won[best] += 1
    return won


def edited_pairs(rows):
    """(id, text, edited text, next text) in descending order of unique ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        yield key, text, text[:len(text) - half] + following[:half], following


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
