"""Steps that must not do their work twice or exchange more than they need."""

import os
import random
import uuid

from pyspark.sql import functions as F

from parcelweave import session
from parcelweave.functions.token_set import token_set_score
from parcelweave.operators import portfolio, set_join, token_set_join
from parcelweave.plans import discovery
from parcelweave.sources import vendor
from parcelweave.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letter_shapes_drop_only_pairs_that_cannot_score(spark):
    rng = random.Random(5)
    words = ["alpha", "alfa", "beta", "betta", "gama", "gamma", "oo", "ooooooooooooo", "x1", "x12", "ünit"]
    texts = sorted({" ".join(sorted(rng.sample(words, rng.randint(1, 5)))) for _ in range(40)})
    keys = spark.createDataFrame([(t,) for t in texts], "id string")
    shapes = {r.id: [s & (2**64 - 1) for s in r.shape] for r in token_set_join._gram_sets(keys).collect()}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(shapes[a], shapes[b]))
    dropped = 0
    for a in texts:
        for b in texts:
            whole = token_set_score(a, b) >= 90 and not set(a.split()) & set(b.split())
            far = apart(a, b) > (1 - 0.895) * (len(a) + len(b))
            assert not (whole and far)
            dropped += far
    assert dropped > len(texts) ** 2 / 2
    sets = token_set_join._gram_sets(keys)
    assert set_join.overlap_pairs(sets, sets, "size", "1").count() > len(texts)
    assert set_join.overlap_pairs(sets, sets, "size", "1", "l_shape = r_shape").filter("l_id <> r_id").count() == 0


def test_answers_are_parsed_once(spark):
    texts = ['{"property": []}', ' \n{"property": {}}', '{"property": "x"}', '{"property": null}', '{"a": 1}', "[1]", "3", '"{"', "null",
             " null ", "{bad", "<html>", " ", "", None, "{}", "\t{}"]
    answers = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "parcel_id string, response string")
    counted = vendor.answer_metrics(property=answers)
    assert {(r.outcome, r.n) for r in counted.collect()} == {
        ("answered", 5), ("wrong_list", 2), ("mistyped", 3), ("null", 2), ("malformed", 2), ("empty", 3)}
    assert plan(counted).lower().count("parsejson(") == 1
    details = vendor.flatten_property_detail(answers)
    assert plan(details).lower().count("parsejson(") == 1 and plan(details).lower().count("from_json(") == 1
    assert details.filter("found").count() == 0 and details.filter("state = 'answered'").count() == 7


def test_requests_that_ask_for_the_same_are_looked_up_once(spark, monkeypatch):
    asked = discovery.parse_requests(spark.createDataFrame(
        [(f"r{i}" if i else None, "Route 9, NJ", "Retail", 0.0, None, i + 1) for i in range(6)],
        "request_id string, corridor string, property_type string, lot_size_min_acres double, lot_size_max_acres double, max_results int"))
    parcels = spark.createDataFrame([(f"p{i}", 40.0, -74.0, 1.0, "Retail") for i in range(3)],
                                    "parcel_id string, lat double, lon double, lot_size_acres double, property_type string")
    roads = spark.createDataFrame([("Route 9", "NJ", [(-74.0, 40.0), (-74.0, 40.01)])],
                                  "road_name string, state string, geom array<struct<lon: double, lat: double>>")
    edges = portfolio.GroupedEdges(
        parcels.select(F.lit(0).cast("long").alias("group_id"), "parcel_id"),
        spark.createDataFrame([(0, f"e{i}", 1.0, "exact") for i in range(4)], "group_id long, entity_id string, confidence double, method string"))
    looked_up, plainly = [], discovery._corridor_parcels
    monkeypatch.setattr(discovery, "_corridor_parcels", lambda wanted, *rest: looked_up.append(wanted.count()) or plainly(wanted, *rest))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = rows(discovery.corridor_candidates(asked, parcels, roads, edges))
    assert len(got) == 6 * 3 * 4 and looked_up == [1]
    assert got == rows(discovery.corridor_candidates(asked, parcels, roads, edges.flat()))


def test_pairs_of_asks_and_parcels_are_not_stored(spark, monkeypatch):
    """48 asks for the same 60 parcels, some near several segments: counted and ranked without a table of their pairs."""
    asked = discovery.parse_requests(spark.createDataFrame(
        [(f"r{i}", "Route 9, NJ", "Retail", i / 100, None, 4) for i in range(48)],
        "request_id string, corridor string, property_type string, lot_size_min_acres double, lot_size_max_acres double, max_results int"))
    parcels = spark.createDataFrame([(f"p{i}", 40.0 + i % 9 / 1000, -74.0, float(i % 5 + 1), "Retail") for i in range(60)],
                                    "parcel_id string, lat double, lon double, lot_size_acres double, property_type string")
    roads = spark.createDataFrame([("Route 9", "NJ", [(-74.0, 40.0 + k / 1000) for k in range(12)])],
                                  "road_name string, state string, geom array<struct<lon: double, lat: double>>")
    edges = portfolio.GroupedEdges(
        parcels.selectExpr("CAST(substr(parcel_id, 2) AS BIGINT) % 30 AS group_id", "parcel_id"),
        spark.range(30).selectExpr("id AS group_id", "concat('e', id div 2) AS entity_id", "1.0D AS confidence", "'exact' AS method"))
    wanted = discovery.corridor_candidates(asked, parcels, roads, edges.flat()).cache()
    assert wanted.count() == 48 * 60
    written, plainly = {}, discovery.materialize

    def counting(df, name):
        table = plainly(df, name)
        written[name] = max(written.get(name, 0), table.count())
        return table

    monkeypatch.setattr(discovery, "materialize", counting)
    candidates = discovery.grouped_candidates(asked, parcels, roads, edges)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for got, want in zip(discovery.rank_owners(candidates, asked), discovery.rank_owners(wanted, asked)):
        assert rows(got) == rows(want)
    # Ranked owners' own parcels are found from their groups.
    assert max(n for name, n in written.items() if name != "corridor-chosen") <= 48 * 60 / 2


def test_a_stored_table_leaves_no_shuffle_or_second_copy(spark, tmp_path):
    plain = spark.conf.get(session.SHUFFLE_CLEANUP)
    stored = Tables(spark, f"parcelweave_{uuid.uuid4().hex}", str(tmp_path / "room"))
    folder, name = session.workdir(spark), uuid.uuid4().hex
    rows = spark.range(50).selectExpr("concat('p', id) AS parcel_id", "if(id % 2 = 0, 'NJ', 'NY') AS state", f"'{name}' AS address")
    before = set(os.listdir(folder))
    assert stored.overwrite("parcels", rows.repartition(3, "parcel_id")).where(f"address = '{name}'").count() == 50
    assert set(os.listdir(folder)) == before and spark.conf.get(session.SHUFFLE_CLEANUP) == plain
