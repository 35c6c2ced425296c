import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from parcelweave.llm import components, simhash, substrings, versions, words  # noqa: E402


def test_words_of_a_buffer():
    texts = [" a  bc\n", "", "\t", "d\x0ce é", "no\x1cspace"]
    found = words.split_words([t.encode() for t in texts])
    got = [[found.data[a:b].decode() for a, b in zip(found.starts[x:y], found.ends[x:y], strict=True)]
           for x, y in zip(found.first, found.first[1:], strict=False)]
    assert got == [plain.words(t) for t in texts]
    assert found.data == b"a bc d e \xc3\xa9 no\x1cspace "


def test_tokens_of_a_buffer():
    texts = ["ab12 !!c", "", "é-x"]
    found = words.split_tokens([t.encode() for t in texts])
    got = [[found.data[a:b].decode() for a, b in zip(found.starts[x:y], found.ends[x:y], strict=True)]
           for x, y in zip(found.first, found.first[1:], strict=False)]
    assert got == [["ab", "12", "!!", "c"], [], ["é", "-", "x"]]


def test_hashes_do_not_depend_on_place(monkeypatch):
    text = b" ".join(random.Random(1).choices([b"a", b"bb", b"ccc", b"dddd"], k=5000))
    whole = words.split_words([text, text])
    hashes = words.word_hashes(whole)
    assert (hashes[:5000] == hashes[5000:]).all() and len(set(hashes.tolist())) == 4
    monkeypatch.setattr(words, "BLOCK", 256)
    assert (words.word_hashes(whole) == hashes).all()
    windows = words.window_hashes(hashes, 7)
    assert (windows[:4994] == windows[5000:]).all()


@pytest.fixture(scope="module")
def awkward(spark):
    return plain.documents(spark).cache()


def test_near_duplicates_against_all_pairs(spark, awkward):
    rows = simhash.near_duplicates(awkward).select("doc_id", "source", "n_chars", "fingerprint", "component_id").collect()
    prints = [plain.simhash(r[1]) for r in plain.AWKWARD]
    group = plain.linked(prints)
    least = {g: min((r[0] for r, h in zip(plain.AWKWARD, group, strict=True) if h == g and r[0] is not None), default=None)
             for g in set(group)}
    want = Counter((r[0], r[3], f"{p:016x}", least[g]) for r, p, g in zip(plain.AWKWARD, prints, group, strict=True))
    assert Counter((r["doc_id"], r["source"], r["fingerprint"], r["component_id"]) for r in rows) == want


def test_near_duplicates_keeps_other_columns(spark, awkward):
    out = simhash.near_duplicates(awkward)
    assert "text" not in out.columns and out.columns.count("fingerprint") == 1 and "Fingerprint" not in out.columns
    assert out.select("_fp").distinct().collect()[0][0] == plain.CLASHING.index("_fp")


def test_one_document_of_each_group_stays(spark, awkward):
    rows = simhash.deduplicated(awkward).collect()
    prints = [plain.simhash(r[1]) for r in plain.AWKWARD]
    assert len(rows) == len(set(plain.linked(prints)))
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1, 6)) == [1]
    assert rows[0].asDict().keys() == set(awkward.columns)


def test_links_within_two_bits_against_all_pairs(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            value = centre
            for _ in range(rng.randrange(4)):
                value ^= 1 << rng.randrange(64)
            prints.add(value - (1 << 64) if value >> 63 else value)
    table = spark.createDataFrame([(p,) for p in prints], "_fp bigint")
    got = sorted(tuple(r) for r in simhash.linked_fingerprints(table).collect())
    low = (1 << 64) - 1
    want = sorted((a, b) for a in prints for b in prints if a < b and ((a ^ b) & low).bit_count() <= 2)
    assert got == want and len(got) > 100
    with pytest.raises(ValueError):
        simhash.linked_fingerprints(table, 3)


def test_variants_do_not_pass_through_the_driver(spark):
    """64 rows a fingerprint, which Spark sizes as one: few enough for a broadcast by that size, not by their own."""
    links = simhash.linked_fingerprints(spark.range(100).selectExpr("xxhash64(id) AS _fp"))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    links.collect()
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_empty_documents(spark):
    none = plain.documents(spark, [])
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert versions.fingerprint_versions(none).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame([*path, *star, (200, 200), (300, 301), (301, 300), (300, 301)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components.components(links, "test").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 300: 300, 301: 300}
    assert components.components(links.limit(0), "test").count() == 0


@pytest.mark.parametrize("hot", [2_000, 1])
def test_repeats_against_counted_windows(spark, awkward, hot):
    rows = substrings.remove_repeats(awkward, hot_spans=hot).select("doc_id", "n_words", "n_removed", "kept").collect()
    want = plain.without_repeats([r[1] for r in plain.AWKWARD])
    assert Counter(tuple(r) for r in rows) == Counter((r[0], *w) for r, w in zip(plain.AWKWARD, want, strict=True))


@pytest.mark.parametrize("hot", [2_000, 3])
def test_repeats_of_random_texts(spark, hot):
    rng = random.Random(3)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 30))) for _ in range(12)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 9))) for _ in range(60)]
    docs = plain.documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], clashing=False)
    for window, mer in ((8, 3), (5, 5), (6, 1)):
        out = substrings.remove_repeats(docs, window=window, mer=mer, hot_spans=hot)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()}
        assert got == dict(enumerate(plain.without_repeats(texts, window)))


def test_untouched_texts_keep_their_layout(spark):
    docs = plain.documents(spark, [(1, "a  b\n\nc", "en", "s"), (2, None, "en", "s")], clashing=False)
    got = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(docs, as_is=True).collect()}
    assert got == {1: "a  b\n\nc", 2: ""}


def test_hash_collisions_are_settled_on_bytes(monkeypatch):
    monkeypatch.setattr(substrings, "window_hashes", lambda hashes, size: np.zeros(max(0, len(hashes) - size + 1), np.uint64))
    text, first, n = substrings._repeated([b"a b c", b"b c d", b"x y z"], 2)
    assert list(zip(text.tolist(), first.tolist(), n.tolist(), strict=True)) == [(0, 1, 1), (1, 0, 1)]


def test_sketches_recover_exactly_what_differs():
    rng = random.Random(5)
    for shared, a_only, b_only in ((0, 0, 0), (50, 0, 0), (50, 3, 0), (0, 40, 60), (300, 25, 31)):
        keys = np.array([rng.getrandbits(64) for _ in range(shared + a_only + b_only)], dtype=np.uint64)
        a, b = versions.Version(""), versions.Version("")
        a.keys, b.keys = keys[:shared + a_only], np.concatenate((keys[:shared], keys[shared + a_only:]))
        first, second = a.differing(b)
        assert set(first.tolist()) == set(keys[shared:shared + a_only].tolist())
        assert set(second.tolist()) == set(keys[shared + a_only:].tolist())


def test_too_small_a_sketch_says_so():
    keys = np.arange(1, 200, dtype=np.uint64)
    assert versions.Sketch(12).add(keys).peel() is None


def test_repeated_paragraphs_count():
    assert versions.Version("a\na\nb").likeness(versions.Version("a\nb")) == pytest.approx(2 / 3)
    assert versions.Version("").likeness(versions.Version("")) == 1.0
    assert versions.Version("").likeness(versions.Version("a")) == 0.0


def test_a_kept_half_is_found_again_in_texts_of_few_lines():
    rng = random.Random(7)
    spoken = " ".join(f"word{rng.randrange(10_000)}" for _ in range(400))
    texts = {
        "short line": spoken[:199], "one sentence": spoken[:600], "one paragraph": spoken,
        "sentences": ". ".join(spoken[i:i + 70] for i in range(0, 1_400, 70)),
        "no spaces": "".join(rng.choices("0123456789abcdef", k=1_000)),
        "cjk": "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500)), "one character": "a" * 1_000}
    for name, text in texts.items():
        half, other = len(text) // 2, "".join(rng.choices("ghijklmnop ", k=len(text) // 2))
        own, edited = versions.Version(text), versions.Version(text[:len(text) - half] + other)
        kept = np.intersect1d(own.keys, edited.keys)
        assert len(kept) >= 2, name
        assert own.likeness(edited) == pytest.approx(len(kept) / len(np.union1d(own.keys, edited.keys))), name
        assert max(map(len, versions.pieces(text))) <= versions.MOST_CHARS
    assert versions.Version(spoken).likeness(versions.Version("x " + spoken)) > 0.9  # borders do not move


def test_stored_fingerprints_compare_versions_without_their_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"word{rng.randrange(10_000)}" for _ in range(170)) for _ in range(3)]  # of usual length, 1,500 characters
    docs = plain.documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], clashing=False)
    for r in versions.fingerprint_versions(docs).collect():
        text, following = texts[r["doc_id"]], texts[r["doc_id"] - 1]
        half = len(text) // 2
        own, edited = versions.digests(text), versions.digests(text[:len(text) - half] + following[:half])
        found = versions.Sketch.read(r["fingerprint"]).minus(versions.Sketch.read(r["edited_fingerprint"])).peel()
        assert found is not None
        assert set(found[0].tolist()) == set(np.setdiff1d(own, edited).tolist())
        assert set(found[1].tolist()) == set(np.setdiff1d(edited, own).tolist())


def test_pieces_do_not_depend_on_other_sentences():
    sentence = "the quick brown fox jumps over the lazy dog and runs away from the farm into the dark forest at night."
    alone = versions.pieces(sentence)
    assert len(alone) > 1 and "".join(alone) == sentence
    assert versions.pieces(f"Before. {sentence}\n\nAfter it") == ["Before.", *alone, "After it"]
    assert versions.pieces("日本。語！ab") == ["日本。", "語！", "ab"]
    assert versions.pieces("") == versions.pieces("\n") == []


def test_versions_against_plain_order(spark, awkward):
    rows = [(r[0], r[1] or "") for r in plain.AWKWARD if r[0] not in (None, 6)]
    docs = plain.documents(spark, [(*r, "en", "s") for r in rows])
    got = {r["doc_id"]: r for r in versions.fingerprint_versions(docs).collect()}
    assert len(got) == len(rows)
    for key, text, edited, following in plain.edited_pairs(rows):
        own, new, after = (versions.Version(t) for t in (text, edited, following))
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), plain.sha(edited))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (str(own.sketch()), str(new.sketch()))

        def jaccard(a, b):
            a, b = set(a.keys.tolist()), set(b.keys.tolist())
            return len(a & b) / len(a | b) if a | b else 1.0

        assert r["near_edited"] == pytest.approx(jaccard(own, new))
        assert r["near_next"] == pytest.approx(jaccard(own, after))


def test_versions_of_awkward_rows(spark, awkward):
    out = versions.fingerprint_versions(awkward)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in plain.AWKWARD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 6)}) == 1
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    one = plain.documents(spark, [(1, "alone here", "en", "s")], clashing=False)
    assert versions.fingerprint_versions(one).first()["near_next"] == 1.0
