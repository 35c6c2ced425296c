import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from compare import compare, connect  # noqa: E402
from parcelweave.llm import chat, mixing, packing, queries, search  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def awkward(spark):
    return plain.documents(spark).cache()


# Packing ----------------------------------------------------------------------------------------------------

def test_word_tokens_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    with open(VOCABULARY, encoding="utf-8") as f:
        tokens = packing.WordTokens(f.read())
    rng = random.Random(1)
    odd = ["", " ", "don't we'll I'D", "É é ΣΑΣ İ ß ﬁ", "\x1c\x1d a\x1fb", "a b c　d\x85e", "日本語 한국 1½²",
           "<|endoftext|>", "x<|startoftext|>y < z", "🙂👍🏽 ퟿", "_under_score_ %%% $$$", "̀ͅ x"]
    texts = odd + ["".join(rng.choices("aB9 '.\n\té%́", k=rng.randrange(60))) for _ in range(300)]
    for got, text in zip(tokens.batch(texts), texts, strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_limits_hold_and_little_is_padded():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 4000, 3000)
    loss = (size * rng.random(3000)).astype(int)
    limits = (4096, 6, 2500)
    loss = np.minimum(loss, limits[2])
    sequence, offset = packing.pack(size, loss, limits)
    for s in range(sequence.max() + 1):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert 1 <= len(own) <= limits[1] and size[own].sum() <= limits[0] and loss[own].sum() <= limits[2]
        assert offset[own].tolist() == (np.cumsum(size[own]) - size[own]).tolist()
    free, _ = packing.pack(size, size, (4096, 256, 4096))
    assert size.sum() / (4096 * (free.max() + 1)) > 0.97


def test_each_step_takes_the_largest_dot_product():
    rng = np.random.default_rng(5)
    size, loss = rng.integers(1, 60, 80), rng.integers(0, 30, 80)
    loss = np.minimum(loss, size)
    limits = (100, 5, 40)
    sequence, offset = packing.pack(size, loss, limits)
    waiting = set(range(80))
    for s in range(sequence.max() + 1):
        own = np.flatnonzero(sequence == s)
        left, segments, rest = limits
        for piece in own[np.argsort(offset[own])].tolist():
            fits = [i for i in waiting if size[i] <= left and loss[i] <= rest]
            value = lambda i: size[i] / 100 * left / 100 + loss[i] / 40 * rest / 40  # noqa: B023, E731
            assert value(piece) == pytest.approx(max(map(value, fits)))
            waiting.discard(piece)
            left, segments, rest = left - size[piece], segments - 1, rest - loss[piece]
        assert not segments or not [i for i in waiting if size[i] <= left and loss[i] <= rest]


def test_pieces_of_awkward_rows(spark, awkward):
    rows = packing.pack_documents(awkward, VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc_id, text, *_ in plain.AWKWARD:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at:at + 4096]
            want[doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(plain.documents(spark, []), VOCABULARY).count() == 0


def test_single_tokens_fill_a_sequence(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text").coalesce(1)
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    assert sorted(r["offset"] for r in rows) == list(range(3000)) and len({r["sequence_id"] for r in rows}) == 1


def test_masked_windows_under_three_limits(spark):
    rng = random.Random(8)
    said = [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(["yes", "[no]", "per<haps", "Zoë"]) for _ in range(rng.randrange(90))))
            for c in range(40) for t in range(6)]
    windows = chat.format_windows(spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string"))
    limits = (600, 4, 150)
    rows = packing.pack_windows(windows.coalesce(2), VOCABULARY, sequence_tokens=600, max_segments=4, max_loss=150).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for w in windows.collect():
        at, masks = 0, []
        for span in [*w["loss"], None]:
            low, high = (span["low"], span["high"]) if span else (len(w["formatted"]), len(w["formatted"]))
            masks += [False] * len(tokenizer.encode(w["formatted"][at:low], add_special_tokens=False).ids)
            masks += [True] * len(tokenizer.encode(w["formatted"][low:high], add_special_tokens=False).ids)
            at = high
        masks.append(False)
        for start in range(0, len(masks), 150):
            own = masks[start:start + 150]
            want[w["conv_id"], w["window"], start, len(own), sum(own)] += 1
    assert Counter((r["conv_id"], r["window"], r["start"], r["length"], r["loss_tokens"]) for r in rows) == want
    assert any(0 < r["loss_tokens"] < r["length"] for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        assert len(own) <= limits[1] and sum(r["length"] for r in own) <= limits[0] and sum(r["loss_tokens"] for r in own) <= limits[2]
        ends = sorted((r["offset"], r["length"]) for r in own)
        assert [a for a, _ in ends] == [sum(n for _, n in ends[:i]) for i in range(len(ends))]
    none = packing.pack_windows(windows.limit(1).selectExpr("conv_id", "CAST(NULL AS string) AS formatted", "CAST(NULL AS array<struct<low:bigint,high:bigint>>) AS loss"), VOCABULARY)
    assert [(r["length"], r["loss_tokens"]) for r in none.collect()] == [(1, 0)]
    assert packing.pack_windows(windows.where("false"), VOCABULARY).count() == 0


# Mixing -----------------------------------------------------------------------------------------------------

def test_seats_against_one_by_one(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 100, 1003):
        votes = {i: rng.choice([1, 2, 3, 50, 1000, 4000]) for i in range(rng.randrange(1, 30))}
        table = spark.createDataFrame([("g", i, v, seats) for i, v in votes.items()], "g string, i int, votes bigint, n bigint")
        got = {r["i"]: r["seats"] for r in mixing._seats(table, ["g"], "i").collect()}
        assert got == plain.sainte_lague(votes, seats)


def test_targets_against_resharing(spark):
    rng = random.Random(9)
    for _ in range(4):
        sizes = {rng.choice("abcdefgh") + str(i): rng.choice([0, 10, 300, 50_000]) for i in range(rng.randrange(1, 9))}
        sizes[None] = 700
        table = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
        want = plain.targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_of_awkward_rows(spark, awkward):
    rows = mixing.mixed_sizes(awkward).collect()
    sizes = {}
    for r in plain.AWKWARD:
        sizes[r[3]] = sizes.get(r[3], 0) + len(plain.words(r[1]))
    want, taken = plain.targets(sizes), Counter()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], len(plain.words(r[1]))) for r in plain.AWKWARD)
    source = {(r[0], len(plain.words(r[1]))): r[3] for r in plain.AWKWARD if r[0] not in (6,)}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] != 6:
            name = source[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[name] and r["target"] == pytest.approx(want[name])
            taken[name] += r["taken"]
    assert abs(taken["hot"] - want["hot"]) <= mixing.BLOCK_WORDS * 2
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mixed_sizes(awkward).collect()), key=repr)


def test_every_source_meets_its_target(spark, awkward):
    rng = random.Random(4)
    tail = [(f"t{i}", rng.choice([1, 3, 40, 45, 90, 200, 700])) for i in range(60)]
    rows = [(i, " ".join(["w"] * n), "en", source) for i, (source, n) in enumerate([*tail, *tail, *[("big", 900)] * 40])]
    for docs in (plain.documents(spark, rows, clashing=False), awkward):
        sizes, taken = Counter(), Counter()
        for r in docs.select("source", "text").collect():
            sizes[r["source"]] += len(plain.words(r["text"]))
        want = plain.targets(sizes)
        for r in mixing.mixed_documents(docs).select("source", "text").collect():
            taken[r["source"]] += len(plain.words(r["text"]))
        for source, target in want.items():
            allowed = 1 if target < mixing.SMALL_BLOCKS * mixing.BLOCK_WORDS else target / mixing.SMALL_BLOCKS
            assert abs(taken[source] - target) <= allowed, source


def test_mixed_documents_hold_what_is_taken(spark, awkward):
    taken = Counter()
    for r in mixing.mixed_sizes(awkward.where("doc_id <> 6 AND doc_id IS NOT NULL")).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(awkward.where("doc_id <> 6 AND doc_id IS NOT NULL"))
    assert mixed.columns == awkward.columns
    found, texts = Counter(), {r[0]: r[1] for r in plain.AWKWARD}
    for r in mixed.collect():
        found[r["doc_id"]] += len(plain.words(r["text"]))
        assert plain.words(texts[r["doc_id"]])[:len(plain.words(r["text"]))] == plain.words(r["text"])
        if len(plain.words(r["text"])) == len(plain.words(texts[r["doc_id"]])):
            assert r["text"] == texts[r["doc_id"]]
    assert found == +taken


def _same_as_sql(docs):
    import duckdb

    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({mixing.CHECK_SQL})").fetchall()
    got = [tuple(r[n] for n in names) for r in mixing.mixed_sizes(docs).collect()]
    near = lambda rows: Counter((i, a, b, round(t, 6), n) for i, a, b, t, n in rows)
    assert near(got) == near(want)


def test_mix_with_tiny_sources_against_sql(spark):
    rng = random.Random(6)
    tail = [(f"t{i}", rng.choice([1, 2, 5, 40, 300])) for i in range(12)]
    rows = [(i, " ".join([f"w{i}"] * n), "en", source)
            for i, (source, n) in enumerate([*tail, *tail, *[("big", 700)] * 30, ("blank", 0)])]
    _same_as_sql(plain.documents(spark, rows, clashing=False))
    _same_as_sql(plain.documents(spark, [(i, f"word{i} " * 500, "en", "ab"[i % 2]) for i in range(400)], clashing=False))


def test_rows_of_one_id_spread_over_shards(spark):
    for doc_id in (7, None):
        rows = [(doc_id if i % 3 == 0 else i, f"w{i} " * 700, "en", "a") for i in range(900)]
        sizes = mixing.sized(plain.documents(spark, rows, clashing=False)).cache()
        places = mixing._placed(sizes, mixing.source_targets(sizes)).groupBy("shard").agg(F.sum("size").alias("n")).collect()
        assert len(places) == 10 and max(p["n"] for p in places) < 2 * mixing.SHARD_WORDS


def test_mix_of_nothing(spark):
    assert mixing.mixed_sizes(plain.documents(spark, [])).count() == 0
    assert mixing.mixed_documents(plain.documents(spark, [])).count() == 0
    blank = plain.documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])
    assert {(r["taken"], r["target"]) for r in mixing.mixed_sizes(blank).collect()} == {(0, 0.0)}
    assert mixing.mixed_documents(blank).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_their_sql(spark, name):
    ok, message = compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.SQL[name])
    assert ok, message


# Search -----------------------------------------------------------------------------------------------------

def plain_top(rows, k):
    vectors = {i: np.floor(1024 * np.array(v, dtype=float)).astype(int) for i, v in rows}
    out = []
    for q, v in vectors.items():
        if q % 5 == 0:
            scores = sorted((-int(v @ w), i) for i, w in vectors.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("n, k, block", [(120, 10, 4096), (120, 3, 8), (4, 10, 4096)])
def test_search_against_all_pairs(spark, n, k, block):
    rng = random.Random(n + k)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(n)]
    rows = [(i, rows[7][1] if 20 <= i < 60 and n > 60 else v) for i, v in rows]  # many equal vectors: ties
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = search.top_k(table, table.where("vec_id % 5 = 0"), k, block=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain_top(rows, k)


def test_search_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [0.5, 9.0]),
            (6, [0.5, 9.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int")
    got = sorted(map(tuple, search.top_k(table, table.where("vec_id IN (0, 2, 5)")).collect()))
    assert got == [(0, 1, 1, 512 * 1024), (0, 2, 6, 512 * 1024), (0, 3, 6, 512 * 1024)]
    assert search.top_k(table, table.where("vec_id = 2")).count() == 0
    assert search.top_k(table.limit(0), table.limit(0)).count() == 0


def test_large_scores_are_exact():
    rows, queries_ = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0]])
    assert search._scores(rows, queries_).tolist() == [[2**60 + 15]]


# Chat -------------------------------------------------------------------------------------------------------

CONVERSATION = "conv_id bigint, turn bigint, role string, text string"
CHAT = [
    (1, 0, "system", "be brief"), *[(1, i, ("assistant", "user")[i % 2], f"turn {i} " + "word " * (i * 37 % 300)) for i in range(1, 40)],
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]\\"),
    (3, 0, None, None), (3, 1, "assistant", None), (3, 2, "assistant", ""), (3, None, "tool[x]", "\\[<<SYS>>"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"),
    (5, 0, "user", "long " * 20_000), (5, 1, "assistant", "answer " * 20_000), (5, 2, "system", "late system"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "still none"),
]


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=key)]


@pytest.fixture(scope="module")
def windows(spark):
    said = spark.createDataFrame([(*r, 1) for r in CHAT], CONVERSATION + ", loss int")
    return chat.format_windows(said).cache()


def test_round_trip_of_conversations(spark, windows):
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert got.keys() == {r[0] for r in CHAT}
    for key, r in got.items():
        turns = ordered([c for c in CHAT if c[0] == key])
        targets = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(targets), hashlib.sha256(targets.encode()).hexdigest())
    total = sum(len(w["formatted"]) for w in windows.collect())
    assert sum(r["formatted_chars"] for r in got.values()) == total


def test_windows_keep_the_budget_and_the_system_turn(windows):
    rows = sorted(windows.where("conv_id = 1").collect(), key=lambda r: r["window"])
    assert len(rows) > 3
    for n, r in enumerate(rows):
        turns = list(chat.read_turns(r["formatted"]))
        cost = [chat.estimated_tokens(role, text) for role, text, *_ in turns]
        assert sum(cost) <= chat.BUDGET_TOKENS and turns[0][:2] == ("system", "be brief")
        if n:
            history = cost[1:r["repeated"]]
            assert 0 < sum(history) <= chat.HISTORY_TOKENS or not history
        inside = {(low, high) for low, high in ((s["low"], s["high"]) for s in r["loss"])}
        assert inside == {(low, high) for i, (role, _, low, high) in enumerate(turns) if role == "assistant" and i >= r["repeated"]}


def test_reading_undoes_writing():
    rng = random.Random(6)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "", "t[o]<ol\\"]), "".join(rng.choices("a[]<>/\\ISNT s", k=rng.randrange(20))))
                 for _ in range(rng.randrange(1, 6))]
        text = "".join("".join(chat.write_turn(*t)) for t in turns)
        assert [(role, said) for role, said, *_ in chat.read_turns(text)] == turns


def test_no_conversation(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], CONVERSATION))).count() == 0
