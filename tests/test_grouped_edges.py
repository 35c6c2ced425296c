"""Grouped edges against flat ones: the same rows, without the product of parcels and owners of a name being exchanged."""

import pytest
from pyspark.sql import functions as F

from parcelweave.operators import checks, matching, portfolio, upsert
from parcelweave.plans import address_match, discovery
from parcelweave.plans.resolution import recompute_edges


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    """Names of several entities, an alias that is a name too, parcel ids that repeat under two names or are missing."""
    names = [(f"e{i}", f"Owner {i % 3}") for i in range(24)] + [("e1", "Owner 1"), ("e1", "Owner 2"), ("z", None), (None, "Owner 0")]
    aliases = [("e5", "owner 2", 0.9), ("e5", "owner 0", 0.8), ("e5", " OWNER 0", 0.7), ("e7", "Other", None), ("e8", "Other", 0.8)]
    parcels = [(f"p{i}", f"{i % 4} Main Street", "Town" if i % 2 else None, "NJ", [" owner 0", "Owner 1", "OWNER 2 ", "other", "none", None][i % 6],
                float(i), "Retail" if i % 5 else "Office", None if i % 7 == 0 else float(i % 4), 40.0 + i / 1e4, -74.0) for i in range(40)]
    parcels += [("p1", *parcels[2][1:]), ("p2", *parcels[2][1:]), (None, *parcels[0][1:]), (None, *parcels[1][1:])]
    return {
        "entities": spark.createDataFrame(names, "entity_id string, canonical_name string"),
        "entity_aliases": spark.createDataFrame(aliases, "entity_id string, alias_name string, match_score double"),
        "parcels": spark.createDataFrame(
            parcels, "parcel_id string, address string, city string, state string, owner_name_raw string, building_sqft double, "
                     "property_type string, lot_size_acres double, lat double, lon double"),
        "roads": spark.createDataFrame(
            [("Route 9", "NJ", [(-74.0, 40.0), (-74.0, 40.01)])], "road_name string, state string, geom array<struct<lon: double, lat: double>>"),
    }


@pytest.fixture(scope="module")
def grouped(tables):
    return matching.grouped_edges(tables["parcels"], tables["entities"], tables["entity_aliases"])


@pytest.fixture(scope="module")
def flat(tables):
    return upsert.merge_edges(matching.exact_edges(tables["parcels"], tables["entities"]),
                              matching.alias_edges(tables["parcels"], tables["entity_aliases"])).cache()


def test_same_edges_from_tables_no_longer_than_their_inputs(tables, grouped, flat):
    assert rows(grouped.flat()) == rows(flat)
    assert rows(recompute_edges(tables["parcels"], tables["entities"], tables["entity_aliases"])) == rows(flat)
    assert grouped.members.count() <= tables["parcels"].count()
    assert grouped.owners.count() < flat.count() / 3


def test_operators_take_both_forms(spark, tables, grouped, flat):
    ids = spark.createDataFrame([("e1",), ("e5",), ("e9",)], "entity_id string")
    sized = tables["parcels"]
    for call in (
        lambda e: portfolio.portfolio_summary(e, sized), lambda e: portfolio.portfolio_summary(portfolio.for_entities(e, ids), sized),
        lambda e: portfolio.owned_parcels(portfolio.for_entities(e, ids), sized),
        lambda e: portfolio.parcels_with_owner(sized.select("parcel_id", "city"), e, tables["entities"]),
        lambda e: portfolio.coverage_counts(tables | {"portfolio_edges": e}),
    ):
        assert rows(call(grouped)) == rows(call(flat))


def test_address_rows_of_both_forms(spark, tables, grouped, flat):
    asked = spark.createDataFrame([("1 Main Street", "Town"), ("2 Main Street", "")], "street string, asked_city string")
    got, want = (address_match.ranked_matches(asked, tables | {"portfolio_edges": e}).select(
        "street", "asked_city", "rank", "parcel_id", "entity_id", "confidence") for e in (grouped, flat))
    assert rows(got) == rows(want)


def test_corridors_of_both_forms(spark, tables, grouped, flat):
    ask = [("a", "Route 9, NJ", "Retail", 0.0, None, 12), ("b", "Route 9, NJ", "retail", 0.0, None, 3), ("c", "Route 9, NJ", "Office", 1.0, 2.0, 20),
           ("d", "Route 8, NJ", "Retail", 0.0, None, 5), ("e", "Route 9, NJ", "Retail", 0.0, None, 2), ("e", "Route 9, NJ", "Office", 0.0, None, 4)]
    asked = discovery.parse_requests(spark.createDataFrame(
        ask, "request_id string, corridor string, property_type string, lot_size_min_acres double, lot_size_max_acres double, max_results int"))
    args = (asked, tables["parcels"].filter("parcel_id is not null"), tables["roads"])
    by_group, one_by_one = discovery.grouped_candidates(*args, grouped), discovery.corridor_candidates(*args, flat)
    assert by_group.asks.select("ask_id").distinct().count() == 4
    assert rows(discovery.corridor_candidates(*args, grouped)) == rows(one_by_one)
    for got, want in zip(discovery.rank_owners(by_group, asked), discovery.rank_owners(one_by_one, asked)):
        assert rows(got) == rows(want) and got.count() > 0
    owners = discovery.rank_owners(one_by_one, asked)[0]
    assert rows(discovery.top_parcels(by_group, owners)) == rows(discovery.top_parcels(one_by_one, owners))
    columns = ["request_id", "entity_id", "parcel_id", "lot"]
    assert rows(discovery.capped(by_group, asked).select(columns)) == rows(discovery.capped(one_by_one, asked).select(columns))


def test_merge_of_grouped_edges(spark, tables, flat):
    """Old edges of some parcels, with several confidences in one group, merged into new ones without making them flat."""
    new = matching.grouped_edges(tables["parcels"], tables["entities"], tables["entity_aliases"])
    only = matching.grouped_edges(tables["parcels"].filter("parcel_id is null or parcel_id > 'p2'"), tables["entities"])
    old = only.split("even", F.length("parcel_id") % 2 == 0)
    old.owners = old.owners.withColumns({"confidence": F.when(F.col("even"), 1.0).otherwise(0.8), "method": F.lit("graph")}).drop("even")
    merged = upsert.merge_edges(old, new)
    assert rows(merged.flat()) == rows(upsert.merge_edges(old.flat(), flat))
    assert rows(upsert.merge_edges(new, old).flat()) == rows(upsert.merge_edges(flat, old.flat()))
    assert merged.members.count() == flat.select("parcel_id").distinct().count()
    assert merged.owners.count() < flat.count()


def test_checks_of_grouped_edges(tables, grouped, monkeypatch):
    """Faults planted on groups: owners that come twice, missing or wrong values, parcel ids in several groups; counted without flat edges."""
    faulty = portfolio.GroupedEdges(
        grouped.members.unionByName(grouped.members.where("parcel_id in ('p3', 'p5')")).withColumn("parcel_id", F.expr(
            "CASE WHEN parcel_id > 'p3' THEN 'gone' WHEN parcel_id IN ('p0', 'p20') THEN NULL ELSE parcel_id END")),
        grouped.owners.unionByName(grouped.owners.where("confidence > 0.85")).withColumns({
            "method": F.expr("CASE WHEN entity_id = 'e7' THEN NULL WHEN confidence < 0.9 THEN 'guess' ELSE method END"),
            "confidence": F.expr("confidence + if(entity_id IN ('e2', 'e5'), 1, 0)")}))
    others = {"entities": tables["entities"].filter("entity_id <> 'e4'").selectExpr(
        "*", "'LLC' AS entity_type", "'active' AS status"), "parcels": tables["parcels"].filter("parcel_id <> 'p1'").selectExpr("*", "'' AS zip")}
    for edges in (grouped, faulty):
        want = rows(checks.check_tables(others | {"portfolio_edges": edges.flat().cache()}))
        with monkeypatch.context() as m:
            m.setattr(portfolio.GroupedEdges, "flat", lambda self: pytest.fail("made flat"))
            assert rows(checks.check_tables(others | {"portfolio_edges": edges})) == want
    assert {r[0] for r in want if r[2] > 0 and r[3] == "portfolio_edges"} == {"unique", "not_null", "foreign_key", "allowed_value"}
