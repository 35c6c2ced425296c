import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from parcelweave.llm import language, quality, toxicity  # noqa: E402

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def awkward(spark):
    return plain.documents(spark).cache()


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents whose kind can be told: junk signs mean low quality, two insults mean toxic."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randrange(20, 80))
        junk, toxic = i % 4 == 0, i % 5 == 0
        if junk:
            text = [w + "%%%" for w in text]
        if toxic:
            for insult in rng.sample(["zidiotz", "zmoronz", "zscumz"], 2):
                text.insert(rng.randrange(len(text)), insult)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(not junk), int(toxic)))
    return plain.documents(spark, rows, clashing=False).cache(), spark.createDataFrame(labels, LABELS).cache(), labels


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def accuracy(rows, truth):
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"]])


def test_quality_on_held_out_labels(spark, labelled):
    docs, labels, truth = labelled
    rows = quality.quality_of(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r["held_out"] == (held(r["doc_id"]) % 3 == 1) for r in rows)
    assert accuracy(rows, {t[0]: t[1] for t in truth}) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_held_out_labels(spark, labelled):
    docs, labels, truth = labelled
    rows = toxicity.toxicity_of(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r["held_out"] == (held(r["doc_id"]) % 5 == 0) for r in rows)
    assert accuracy(rows, {t[0]: t[2] for t in truth}) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_not_learned_from(spark, labelled):
    docs, labels, _ = labelled
    swapped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    one, two = (sorted(map(tuple, quality.quality_of(docs, x).select("doc_id", "score").collect())) for x in (labels, swapped))
    assert one == two


def test_scores_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (6, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, None), (99, 1, 1)], LABELS)
    for out in (quality.quality_of(awkward, labels), toxicity.toxicity_of(awkward, labels)):
        rows = out.collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in plain.AWKWARD)
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
        assert out.columns.count("score") == 1 and "text" not in out.columns and "_text" in out.columns
        by_id = {}
        for r in rows:
            by_id.setdefault(r["doc_id"], set()).add(r["score"])
        assert by_id[2] == by_id[3] == by_id[4] and len(by_id[6]) == 1


def test_no_labels_and_no_documents(spark, awkward):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.quality_of(awkward, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity_of(awkward, none).collect()} == {0.0}
    empty = plain.documents(spark, [])
    assert quality.quality_of(empty, none).count() == toxicity.toxicity_of(empty, none).count() == 0
    one_kind = spark.createDataFrame([(i, 1, 1) for i in range(1, 16)], LABELS)
    assert {r["predicted"] for r in toxicity.toxicity_of(awkward, one_kind).collect()} == {1}


def test_sparse_scores_against_plain_sums():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=1 << quality.BITS).astype(np.float32)
    texts = [b"a b! 12", b"", b"x", b"\xc3\xa9 y y"]
    got = quality._scores(texts, weights, 0.25)
    for text, score in zip(texts, got, strict=True):
        slots, counts = quality._features([text])
        total = sum(float(weights[s]) for s in slots.tolist())
        want = 0.25 + (total / len(slots) * quality.SCALE if len(slots) else 0)
        assert score == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-5) and counts.sum() == len(slots)
    # Features of a text do not depend on its neighbours.
    assert quality._features([texts[3]])[0].tolist() == quality._features(texts)[0][-len(quality._features([texts[3]])[0]):].tolist()


def test_leader_updates_against_plain_loop():
    rng = np.random.default_rng(2)
    examples = [(np.unique(rng.integers(0, 50, 5)), None) for _ in range(40)]
    examples = [(s, rng.random(len(s))) for s, _ in examples]
    labels = rng.integers(0, 2, 40).astype(float)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for slots, values in examples:
        label = labels[[id(s) for s, _ in examples].index(id(slots))]
        w = [weight(i) for i in slots.tolist()]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, values, strict=True))))
        for i, wi, v in zip(slots.tolist(), w, values, strict=True):
            g = (p - label) * v
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old ** 0.5) / quality.ALPHA * wi
            n[i] = old + g * g
    got = quality.follow_leader(examples, labels, passes=1)
    assert all(got[i] == pytest.approx(weight(i)) for i in z)


def test_hidden_spellings_are_found():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "chll-": 2.0})
    names = dict(zip(("whole", "start", "hidden", "you", "shouted", "mixed", "stretched"), range(7), strict=True))
    assert lexicon.facts("Idiot,")[names["whole"]] == 3.0
    assert lexicon.facts("chllasa")[names["start"]] == 2.0
    for word in ("1d1ot", "id*ot", "i.d.i.o.t", "idiooot"):
        assert lexicon.facts(word)[names["hidden"]] == 3.0, word
    assert lexicon.facts("clean")[:3] == (0.0, 0.0, 0.0)
    assert lexicon.facts("YOU!")[names["you"]] == lexicon.facts("YOU!")[names["shouted"]] == 1.0


def test_features_do_not_depend_on_neighbours():
    texts = [t.encode() for t in ("you idiot !!", "", "clean words here", "CAPS you are fine")]
    made = toxicity.Lexicon({"idiot": 3.0})
    together = made.features(texts)
    assert (together == np.concatenate([made.features([t]) for t in texts])).all()
    at = toxicity.FEATURES.index
    assert together[0, at("near_second_person")] == 1 and together[0, at("hits")] == 1 and not together[1].any()


LANGUAGES = {"en": "the quick brown fox jumps over lazy dogs with the other things that they have seen",
             "de": "der schnelle braune fuchs springt über den faulen hund und die anderen nicht gesehen haben",
             "fr": "le renard brun rapide saute par dessus le chien paresseux que les autres ont déjà vu"}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = list(LANGUAGES)[i % 3]
        rows.append((i, " ".join(rng.choices(LANGUAGES[lang].split(), k=rng.randrange(8, 40))), lang if i % 7 else None, lang))
    return plain.documents(spark, rows, clashing=False).cache()


def test_language_on_held_out_rows(spark, spoken):
    rows = language.language_of(spoken).select("doc_id", "source", "held_out", "lang_pred", "score").collect()
    assert all(r["held_out"] == (held(r["doc_id"]) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == r["source"] for r in rows if r["held_out"]]) > 0.97
    assert all(0.5 <= r["score"] <= 1 for r in rows)


def test_profiles_and_distances_against_plain_counts(spark, spoken):
    profiles = language.learn_profiles(spoken, "doc_id", "text", "lang", size=40)
    counts = {}
    for r in spoken.where("lang IS NOT NULL").collect():
        counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    for lang, found in profiles.items():
        want = [g for g, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:40]]
        assert found == want
    ranks = language.Ranks(profiles, 40)
    doc = [g for g, _ in sorted(plain_grams("der hund und le chien").items(), key=lambda x: (-x[1], x[0]))[:40]]
    want = [sum(abs(i - profiles[n].index(g)) if g in profiles[n] else 40 for i, g in enumerate(doc)) for n in sorted(profiles)]
    assert ranks.distances(np.array(doc)).tolist() == want


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = "\0" + "".join(w + "\0" for w in words)
    out = Counter()
    code = lambda s: sum((1 if c == "\0" else ord(c) + 2) << 21 * i for i, c in enumerate(s))
    for i in range(len(line)):
        for n in (1, 2, 3):
            g = line[i:i + n]
            if len(g) == n and g != "\0" and not (n == 3 and g[1] == "\0"):
                out[code(g)] += 1
    return out


def test_first_ids_against_a_full_sort(spark):
    rows = [(lang, i) for i in range(3_000) for lang in ("en", "fr")[:1 + (i % 7 == 0)]] + [("en", 5)] * 900 + [("de", None)] * 3
    known = spark.createDataFrame(rows, "lang string, id bigint").selectExpr("lang", "xxhash64(id) AS at", "id").repartition(4)
    held = {}
    for r in known.collect():
        held.setdefault(r["lang"], []).append((r["at"], r["id"] is not None, r["id"]))
    for sample in (1, 50, 1_500, 10_000):
        got = language._first_ids(known, sample)
        want = {(lang, i) for lang, found in held.items() for _, _, i in sorted(found, key=lambda x: x[:2])[:sample]}
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    many = spark.range(300_000).selectExpr("'en' AS lang", "xxhash64(id) AS at", "id")
    assert 100 <= language._near_ids(many, 100).count() < 200  # all that one task sorts


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = "Ein Wort, zwei Wörter; " * 50
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "BLOCK", 37)
    parts = language.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert dict(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == plain_grams(text)


def test_language_of_awkward_rows(spark, awkward):
    out = language.language_of(awkward)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in plain.AWKWARD)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert all(found[i] == ("und", 0.0) for i in (2, 3, 4, 15)) and found[1][0] != "und"
    assert out.columns.count("score") == 1 and out.columns.count("held_out") == 1
    nothing = language.language_of(awkward.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language.language_of(plain.documents(spark, [])).count() == 0
