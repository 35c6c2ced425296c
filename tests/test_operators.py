"""Operators against brute force, skewed inputs, and the plans they make."""

import random

import pytest
from pyspark.sql import functions as F

from parcelweave.functions import geo, text
from parcelweave.functions.token_set import token_key, token_set_score
from parcelweave.operators import checks, contacts, matching, ownership, set_join, spatial, text_match, upsert
from parcelweave.operators.set_join import similarity_pairs
from parcelweave.operators.skew import salted_join
from parcelweave.operators.token_set_join import token_set_pairs
from parcelweave.sources import vendor

WORDS = "smith holdings llc capital trust main street group inc partners abel bell of a".split()
FORCED = {"rows_per_salt": 10}


def names(seed, n=150):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        chars = list(" ".join(rng.sample(WORDS, rng.randint(1, 5))))
        for _ in range(rng.randint(0, 2)):
            chars[rng.randrange(len(chars))] = rng.choice("abcx ")
        out.add("".join(chars).strip() or "q")
    return sorted(out)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select((F.col("id") % 20).alias("k"), F.col("id").alias("other"))
    want = big.join(small, "k", how).select("id", *(["other"] if how in ("inner", "left") else []))
    got = salted_join(big, small, ["k"], how, **FORCED).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_similarity_pairs_equal_brute_force(spark, threshold):
    sets = lambda seed: spark.createDataFrame([(n,) for n in names(seed)], "id string").withColumn(
        "tokens", text.trigram_codes(F.col("id")))
    left, right = sets(1), sets(2)
    got = [tuple(r) for r in similarity_pairs(left, right, threshold).collect()]
    sim = text.similarity(F.col("a.id"), F.col("b.id")).alias("sim")
    want = left.alias("a").crossJoin(right.alias("b")).select("a.id", "b.id", sim).filter(F.col("sim") >= threshold)
    assert sorted(got) == sorted(tuple(r) for r in want.collect())
    assert len(got) == len(set(got))


def test_similarity_pairs_stay_within_groups(spark):
    rows = [("x", "main street"), ("y", "main street"), ("x", "other road")]
    sets = spark.createDataFrame(rows, "grp string, id string").withColumn(
        "tokens", text.trigram_codes(F.col("id")))
    got = similarity_pairs(sets, sets.filter("grp = 'x'"), 0.9).select("grp", "l_id").collect()
    assert sorted(map(tuple, got)) == [("x", "main street"), ("x", "other road")]


def test_similarity_join_makes_no_cross_join(spark):
    sets = spark.createDataFrame([("a b",)], "id string").withColumn("tokens", text.trigram_codes(F.col("id")))
    plan = plan_of(similarity_pairs(sets, sets, 0.7))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_token_set_pairs_equal_brute_force(spark):
    keys = lambda seed: spark.createDataFrame([(n,) for n in names(seed)], "n string").select(
        token_key(F.col("n")).alias("id")).filter("id <> ''").distinct()
    left, right = keys(3), keys(4)
    got = {tuple(r) for r in token_set_pairs(left, right, 90).collect()}
    pairs = [(a.id, b.id) for a in left.collect() for b in right.collect()]
    assert got == {(a, b, s) for a, b in pairs if (s := token_set_score(a, b)) >= 90}


def test_best_trigram_match_takes_lowest_id_on_ties(spark):
    owners = spark.createDataFrame([("e2", "ACME LLC"), ("e1", "acme llc"), ("e3", "OTHER")],
                                   "entity_id string, canonical_name string")
    found = matching.best_trigram_match(
        spark.createDataFrame([("Acme, LLC",), ("ACME LLCS",), ("nobody",)], "name string"), owners)
    assert {r.name: r.entity_id for r in found.collect()} == {"Acme, LLC": "e1", "ACME LLCS": "e1"}


def test_text_match(spark):
    queries = spark.createDataFrame([("Route 1",), ("the",), ("Northern Streets",), ("US 1",)], "query string")
    docs = spark.createDataFrame(
        [("US Route 1",), ("Northern Street",), ("US-1",), ("Route 17",), ("Northern Streets Street",)], "doc string")
    got = {tuple(r) for r in text_match.text_match(queries, docs).collect()}
    assert got == {("Route 1", "US Route 1"), ("US 1", "US Route 1"), ("Northern Streets", "Northern Street"),
                   ("Northern Streets", "Northern Streets Street")}


@pytest.mark.parametrize("cell_m", [150.0, 400.0, 900.0])
def test_within_distance_equals_brute_force_on_a_hot_cell(spark, cell_m):
    rng = random.Random(5)
    spots = [(i, 40 + rng.random() / 20, -74 + rng.random() / 20) for i in range(300)]
    # A third of all points in one place.
    spots += [(300 + i, 40.02, -73.98) for i in range(150)]
    lines = [(j, 40 + rng.random() / 20, -74 + rng.random() / 20) for j in range(20)]
    lines = [(j, a, b, a + rng.uniform(-0.03, 0.03), b + rng.uniform(-0.03, 0.03)) for j, a, b in lines]
    lines.append((99, 40.0205, -73.9805, 40.0205, -73.9805))
    points = spark.createDataFrame(spots, "id int, lat double, lon double")
    segments = spark.createDataFrame(lines, "seg int, lat1 double, lon1 double, lat2 double, lon2 double")
    m_lat, m_lon = geo.metres_per_degree(F.col("lat"))
    d2 = geo.distance_sq_to_segment(F.col("lat"), F.col("lon"), m_lat, m_lon, *(
        F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")))
    want = {tuple(r) for r in points.crossJoin(segments).filter(d2 <= 160_000).select("id", "seg").collect()}
    got = spatial.within_distance(points, segments, 400.0, "inner", cell_m=cell_m, **FORCED).select("id", "seg")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    semi = spatial.within_distance(points, segments, 400.0, cell_m=cell_m)
    assert sorted(r.id for r in semi.select("id").collect()) == sorted({i for i, _ in want})
    plan = plan_of(semi)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_exact_edges_with_a_hot_name(spark):
    parcels = spark.range(90).select(
        F.concat(F.lit("p"), "id").alias("parcel_id"),
        F.when(F.col("id") % 3 == 0, " hot owner ").otherwise(F.concat(F.lit("n"), "id")).alias("owner_name_raw"))
    entities = spark.createDataFrame([("e1", "HOT OWNER"), ("e2", "hot owner"), ("e3", "N1")],
                                     "entity_id string, canonical_name string")
    plain = matching.exact_edges(parcels, entities)
    forced = matching.exact_edges(parcels, entities, **FORCED)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, forced.collect()))
    assert plain.count() == 61


def test_merge_edges_rules(spark):
    schema = "entity_id string, parcel_id string, confidence double, method string"
    old = spark.createDataFrame([("e", "a", 1.0, "graph"), ("e", "b", 0.8, "fuzzy"), ("e", "c", 0.9, "graph")], schema)
    new = spark.createDataFrame([("e", "a", 1.0, "exact"), ("e", "b", 1.0, "exact"), ("e", "d", 0.7, "fuzzy")], schema)
    merged = upsert.merge_edges(old, new)
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [
        ("a", 1.0, "graph"), ("b", 1.0, "exact"), ("c", 0.9, "graph"), ("d", 0.7, "fuzzy")]
    again = upsert.merge_edges(merged, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


@pytest.mark.parametrize("profile, email, expected", [
    (True, True, ("Ann Lee", "CEO", "a@x.com", 0.9, "proxycurl+hunter")),
    (True, False, ("Pat", "Principal", None, 0.75, "proxycurl")),
    (False, True, ("Ann Lee", "CEO", "a@x.com", 0.9, "hunter")),
    (False, False, None),
])
def test_contact_waterfall(spark, profile, email, expected):
    asked = spark.createDataFrame([("e", "ACME")], "entity_id string, canonical_name string")
    p = spark.createDataFrame([("e", "Pat", None, "Acme Inc")] if profile else [],
                              "entity_id string, person_name string, person_title string, company_name string")
    m = spark.createDataFrame([("e", "Ann", "Lee", "CEO", "a@x.com", 90.0)] if email else [],
                              "entity_id string, first_name string, last_name string, position string, email string, "
                              "email_confidence double")
    rows = contacts.resolve_contacts(asked, p, m).collect()
    got = [(r.name, r.role, r.email, r.confidence, r.source) for r in rows]
    assert got == ([expected] if expected else [])


def test_contact_blank_fields_fall_back(spark):
    asked = spark.createDataFrame([("e", "ACME")], "entity_id string, canonical_name string")
    p = spark.createDataFrame([], "entity_id string, person_name string, person_title string, company_name string")
    m = spark.createDataFrame([("e", " ", "", "", "a@x.com", 40.0)],
                              "entity_id string, first_name string, last_name string, position string, email string, "
                              "email_confidence double")
    row = contacts.resolve_contacts(asked, p, m).first()
    assert (row.name, row.role, row.confidence) == ("ACME", "Contact", 0.4)


def test_ownership_chain_stops_at_cycles(spark):
    links = spark.createDataFrame(
        [("a", "A", "b"), ("b", "B", "c"), ("c", "C", "a"), ("d", "D", None), ("b", "B2", None)],
        "entity_id string, owner_name string, parent_entity_id string")
    rows = ownership.ownership_chain(links).filter("entity_id = 'a'").collect()
    assert sorted((r.depth, r.owner_name) for r in rows) == [(1, "A"), (2, "B"), (2, "B2"), (3, "C")]


def test_ownership_chain_has_no_depth_limit(spark):
    links = spark.createDataFrame([(f"e{i}", f"O{i}", f"e{i + 1}") for i in range(40)],
                                  "entity_id string, owner_name string, parent_entity_id string")
    assert ownership.ownership_chain(links).filter("entity_id = 'e0'").count() == 40
    cut = ownership.ownership_chain(links, max_depth=3).filter("entity_id = 'e0' OR entity_id = 'e38'").collect()
    assert sorted((r.entity_id, r.depth, r.truncated) for r in cut) == [
        ("e0", 1, False), ("e0", 2, False), ("e0", 3, True), ("e38", 1, False), ("e38", 2, False)]


def test_malformed_answers_give_no_contact(spark):
    answers = spark.createDataFrame(
        [("a", "{bad"), ("b", "<html>x</html>"), ("c", None), ("d", " "), ("e", '{"name": "N"}'), ("f", "{}"),
         ("g", " null "), ("h", "[]"), ("i", '{"name": "N", "people_also_viewed": 3}')],
        "entity_id string, response string")
    got = vendor.flatten_company_profiles(answers).collect()
    assert sorted(r.entity_id for r in got) == ["e", "f", "i"]
    assert vendor.flatten_email_searches(answers).count() == 0
    counts = {r.outcome: r.n for r in vendor.answer_metrics(profile=answers).collect()}
    assert counts == {"malformed": 2, "empty": 2, "answered": 2, "null": 1, "mistyped": 1, "wrong_list": 1}


def test_table_checks_find_faults(spark):
    entities = spark.createDataFrame([("e", "A", "LLC", "active"), ("e", None, "Club", "active")],
                                     "entity_id string, canonical_name string, entity_type string, status string")
    edges = spark.createDataFrame([("x", "p", 2.0, "exact")],
                                  "entity_id string, parcel_id string, confidence double, method string")
    rows = checks.check_tables({"entities": entities, "portfolio_edges": edges}).filter("n_bad > 0").collect()
    assert sorted((r["check"], r.column_name) for r in rows) == [
        ("allowed_value", "confidence"), ("allowed_value", "entity_type"), ("foreign_key", "entity_id"),
        ("not_null", "canonical_name"), ("unique", "entity_id")]


def _jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


@pytest.mark.parametrize("least", [0.3, 1e-6])
def test_set_index_equals_brute_force(spark, monkeypatch, least):
    rng = random.Random(21)
    sets = lambda n, first: [
        (first + i, sorted({rng.randrange(12) if rng.random() < 0.5 else rng.randrange(400) for _ in range(rng.randrange(0, 14))}))
        for i in range(n)]
    stored, asked = sets(160, 0), sets(60, 1000) + [(2000, [9999]), (2001, [])]
    stored += [(300 + i, stored[i][1]) for i in range(5)]
    schema = "id bigint, tokens array<bigint>"
    # Parts of three rows, and one time all joins dealt out by their pairs.
    monkeypatch.setattr(set_join, "ROWS_PER_SPLIT", 3)
    for in_place in (set_join.PAIRS_IN_PLACE, 0):
        monkeypatch.setattr(set_join, "PAIRS_IN_PLACE", in_place)
        index = set_join.SetIndex.build(spark.createDataFrame(stored, schema), least)
        probe = index.probe(spark.createDataFrame(asked, schema))
        for threshold in (0.9, 0.5, least):
            got = sorted((r["l_id"], r["r_id"]) for r in index.pairs(probe, threshold).collect())
            want = sorted((i, j) for i, a in asked for j, b in stored if _jaccard(a, b) >= threshold - 1e-9 and set(a) & set(b))
            assert got == want
        some = spark.createDataFrame([(1003,), (1010,), (7,)], "id bigint")
        got = sorted((r["l_id"], r["r_id"]) for r in index.pairs(probe, least, some).collect())
        assert got == [p for p in want if p[0] in (1003, 1010)]


def test_set_index_compares_within_groups(spark):
    schema = "id string, grp string, tokens array<bigint>"
    stored = spark.createDataFrame([("a", "x", [1, 2, 3]), ("a", "y", [1, 2, 3]), ("b", "y", [1, 2, 4])], schema)
    index = set_join.SetIndex.build(stored, 0.3)
    probe = index.probe(spark.createDataFrame([("q", "y", [1, 2, 3]), ("q", "z", [1, 2, 3])], schema))
    assert sorted(tuple(r) for r in index.pairs(probe, 0.5).collect()) == [("y", "q", "a", 1.0), ("y", "q", "b", 0.5)]


def test_stored_indexes_are_read_without_an_exchange(spark):
    """A join against stored postings exchanges the asked side only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(f"word{i % 7} street {i}",) for i in range(60)], "doc string")
        index = text_match.TextIndex.build(docs)
        asked = spark.createDataFrame([("word3", 0)], "word string, part int")
        plan = plan_of(index.postings.join(asked, ["word", "part"]))
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        sets = spark.createDataFrame([(i, [i % 5, i % 7 + 10, 50]) for i in range(60)], "id bigint, tokens array<bigint>")
        postings = set_join.SetIndex.build(sets, 0.3).postings
        tokens = spark.createDataFrame([(3, 0)], "token bigint, part int")
        plan = plan_of(postings.join(tokens, ["token", "part"]))
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_index_gives_what_one_search_gives(spark, monkeypatch):
    monkeypatch.setattr(text_match, "ROWS_PER_PART", 2)
    docs = spark.createDataFrame([(t,) for t in ("running shoes", "run fast", "the runs of shoes", "boots", "shoe run 12")], "doc string")
    queries = spark.createDataFrame([(t,) for t in ("run shoe", "runs", "the", "boots 12", "12")], "query string")
    got = {tuple(r) for r in text_match.TextIndex.build(docs).match(queries).collect()}
    assert got == {tuple(r) for r in text_match.text_match(queries, docs).collect()}
    assert {d for q, d in got if q == "run shoe"} == {"running shoes", "the runs of shoes", "shoe run 12"}
    assert {d for q, d in got if q == "12"} == {"shoe run 12"} and not {q for q, _ in got} & {"the", "boots 12"}
