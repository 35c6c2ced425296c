"""Readers, stored tables and the composite jobs on hand-made files."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from parcelweave.operators import upsert
from parcelweave.plans import address_match, discovery, profiles, resolution, screening, serving
from parcelweave.schemas import TABLES
from parcelweave.sources import addresses, landed, registry, roads, tax_lots
from parcelweave.sources.tables import Tables
from parcelweave.streaming import jobs as streaming


def stored_at(spark, folder):
    return Tables(spark, f"parcelweave_{uuid.uuid4().hex}", str(folder))


def as_of():
    return F.lit("2024-01-31").cast("timestamp")


def feature(**changes):
    body = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-74.2861, 40.5579]},
            "properties": {"id": "p1", "number": "1240", "street": "Highway 9", "postcode": "07095",
                           "address_levels": [{"value": "New Jersey", "short_code": "US-NJ"}, {"value": "Woodbridge"}]}}
    body["properties"] |= changes.pop("properties", {})
    return json.dumps(body | changes)


@pytest.fixture
def landed_addresses(tmp_path):
    lines = [
        feature(), "\x1e" + feature(properties={"id": "p2"}), "{bad", feature(geometry={"type": "LineString"}),
        feature(geometry={"type": "Point"}), feature(properties={"id": None}), feature(id="f1", properties={"id": None}),
        feature(properties={"number": None, "street": ""}), feature(properties={"address_levels": None}),
        feature(properties={"id": "p3", "address_levels": [{"value": "New Jersey"}], "postal_city": "X"}),
        "", feature(properties={"number": "1241"}),
    ]
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "nj_addresses.geojsonseq").write_text("\n".join(lines))
    (folder / "ny_addresses.geojsonseq").write_text(feature(properties={"id": "ny"}))
    return str(folder)


def test_read_addresses(spark, landed_addresses):
    rows = addresses.read_addresses(spark, landed_addresses, ["nj"])
    reasons = {r.outcome: r.n for r in landed.ingest_metrics(rows).collect()}
    assert reasons == {"loaded": 6, "unparsable": 1, "not_point": 1, "bad_coordinates": 1, "no_address": 1, "no_state": 1}
    good = upsert.last_by_position(landed.accepted(rows), "parcel_id", landed.POSITION)
    by_id = {r.parcel_id: r for r in good.collect()}
    assert set(by_id) == {"p1", "p2", "p3", "f1", "ov_-74.286100_40.557900"}
    # The later line with the same id wins.
    assert by_id["p1"].address == "1241 Highway 9"
    assert (by_id["p3"].state, by_id["p3"].city) == ("NE", "New Jersey")
    assert addresses.read_addresses(spark, landed_addresses).filter("parcel_id = 'ny'").count() == 1


def test_stream_refresh_equals_batch_and_repeats_safely(spark, landed_addresses, tmp_path):
    stored = stored_at(spark, tmp_path / "stream")
    files = []
    for _ in range(2):
        streaming.refresh_addresses(
            stored, landed_addresses, str(tmp_path / "checkpoint"), as_of()).awaitTermination()
        files.append({f.name for f in (tmp_path / "stream").rglob("*.parquet")})
    batch = stored_at(spark, tmp_path / "batch")
    resolution.load_addresses(batch, addresses.read_addresses(spark, landed_addresses), as_of())
    columns = ["parcel_id", "address", "city", "state", "zip", "property_type"]
    rows = [sorted(map(tuple, t.read("parcels").select(columns).collect())) for t in (stored, batch)]
    assert rows[0] == rows[1] and len(rows[0]) == 6
    assert files[0] == files[1]  # the second run found no new file


def test_read_roads(spark, tmp_path):
    way = lambda i, name, n, cls="primary": {
        "type": "way", "id": i, "tags": {"highway": cls, "name": name},
        "geometry": [{"lat": 40 + k / 100, "lon": -74.0} for k in range(n)]}
    elements = [way(1, "Broadway", 3), way(1, "Broadway", 3), way(2, "Short", 1), way(3, "", 2),
                way(4, "Ramp", 2, "primary_link"), way(5, "Lane", 2, "residential"), {"type": "node", "id": 9}]
    (tmp_path / "ny_roads.json").write_text(json.dumps({"elements": elements}, indent=1))
    rows = roads.read_roads(spark, str(tmp_path)).collect()
    assert sorted((r.road_name, r.state, len(r.geom)) for r in rows) == [("Broadway", "NY", 3), ("Ramp", "NY", 2)]


def test_registry_round_trip(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text('DOS ID,Current Entity Name,Entity Type,Initial DOS Filing Date,Registered Agent Name,'
                   'Registered Agent Address 1,Registered Agent City,Registered Agent State,Registered Agent Zip\n'
                   '7,"ACME ""A"", LLC",DOMESTIC LLC,03/15/2019,,1 Elm,,NY,12207\n8,,X,,,,,,\n')
    standard = registry.standardize_registry(registry.read_raw_registry(spark, str(raw)), "ny")
    registry.write_registry_csv(standard, str(tmp_path / "std"), "NY")
    (row,) = registry.read_registry(spark, str(tmp_path / "std")).collect()
    assert (row.entity_id, row.canonical_name, row.entity_type) == ("sos_ny_7", 'ACME "A", LLC', "LLC")
    assert (row.registered_agent_name, row.registered_agent_address) == (None, "1 Elm, NY, 12207")
    assert str(row.incorporated_at) == "2019-03-15"


def test_read_tax_lots(spark, tmp_path):
    (tmp_path / "lots.csv").write_text(
        "Borough,Address,PostCode,OwnerName,BBL,LandUse,BldgClass,LotArea,Latitude,Longitude,Extra\n"
        'MN,"1 A, REAR",10001,ACME,1,5,O4,43560,40.7,-74.0,x\nMN,1 A,10001,LATER,1,5,K1,0,40.7,-74.0,x\n'
        "BK,2 B,11201,,2,4,Z9,0,40.6,-73.9,x\nQN,3 C,11101,Q,3,1,A1,100,40.6,-73.9,x\n"
        "ZZ,4 D,10001,Q,4,6,S1,100,0,-73.9,x\n")
    lots = tax_lots.read_tax_lots(spark, str(tmp_path / "lots.csv"))
    rows = {r.parcel_id: r for r in tax_lots.commercial_lots(lots).collect()}
    assert set(rows) == {"ny_bbl_1", "ny_bbl_2"}
    first = rows["ny_bbl_1"]
    assert (first.owner_name_raw, first.property_type, first.lot_size_acres, first.city) == (
        "ACME", "Office", 1.0, "Manhattan")
    assert (rows["ny_bbl_2"].owner_name_raw, rows["ny_bbl_2"].property_type) == (None, "Unknown")


@pytest.fixture(scope="module")
def small_world(spark):
    """One parcel with its owner near a road, one parcel far away."""
    def table(name, rows):
        frame = spark.createDataFrame([], TABLES[name])
        full = [tuple(r.get(c) for c in frame.columns) for r in rows]
        return spark.createDataFrame(full, frame.schema)

    import datetime
    at = datetime.datetime(2024, 1, 30, 23)
    near = {"parcel_id": "NJ_MIDDLESEX_0024_00001", "address": "1240 Highway 9", "city": "Woodbridge", "state": "NJ",
            "zip": "07095", "lot_size_acres": 2.3, "building_sqft": 18000.0, "property_type": "Retail",
            "last_sale_date": datetime.date(2019, 3, 15), "last_sale_price": 1850000.0,
            "loan_maturity": datetime.date(2027, 6, 1), "lat": 40.5579, "lon": -74.2861,
            "owner_name_raw": "Smith Capital Holdings LLC"}
    far = near | {"parcel_id": "far", "address": "9 Elm Street", "lat": 41.0, "owner_name_raw": "Someone"}
    return {
        "parcels": table("parcels", [near, far]),
        "roads": table("roads", [{"road_key": "r", "road_name": "US Highway 9", "state": "NJ", "geom": [
            (-74.2861, 40.55), (-74.2861, 40.56)]}]),
        "entities": table("entities", [{"entity_id": "smith", "canonical_name": "Smith Capital Holdings LLC",
                                        "entity_type": "LLC", "jurisdiction": "US-NJ", "status": "active",
                                        "source": "sos", "updated_at": at, "registered_agent_name": "CT"}]),
        "portfolio_edges": table("portfolio_edges", [
            {"entity_id": "smith", "parcel_id": p, "confidence": 0.8, "method": "fuzzy"}
            for p in ("NJ_MIDDLESEX_0024_00001", "far")]),
        "beneficial_owners": table("beneficial_owners", [
            {"entity_id": "smith", "owner_name": "John Smith", "role": "Managing Member", "ownership_pct": 100.0}]),
        "contacts": table("contacts", [{"entity_id": "smith", "name": "John", "confidence": 0.88, "source": "s",
                                        "expires_at": datetime.datetime(2024, 3, 1)}]),
    }


def test_discovery_result(spark, small_world):
    asked = spark.createDataFrame(
        [("a", "Highway 9, New Jersey", "retail", 0.0, None, 10), ("b", "Highway 9, NY", None, None, None, None),
         ("c", "Highway 9, NJ", "Retail", 3.0, None, 10)],
        "request_id string, corridor string, property_type string, lot_size_min_acres double, "
        "lot_size_max_acres double, max_results int")
    results = discovery.discover(asked, small_world, as_of())
    rows = {r.request_id: r for r in results.collect()}
    assert [rows[k].status for k in "abc"] == ["ok", "empty", "empty"]
    (owner,) = rows["a"].owners
    assert (owner.owner_name, owner.resolution_required, owner.contact_status) == (
        "Smith Capital Holdings LLC", True, "available")
    assert owner.portfolio_summary.property_count == 2
    (listed,) = owner.properties_in_corridor
    assert (listed.parcel_id, listed.loan_maturity, listed.latitude) == (
        "NJ_MIDDLESEX_0024_00001", "2027-06-01", 40.5579)
    assert (owner.data_freshness, owner.freshness_secs) == ("fresh", 3600)
    assert rows["b"].query_summary.closest_corridors is None and rows["b"].owners == []
    assert rows["c"].query_summary.closest_corridors == ["US Highway 9"]
    assert screening.screen_owners(results, min_properties=2).count() == 0
    assert screening.screen_owners(results, loan_before=F.lit("2028-01-01")).count() == 1


@pytest.mark.parametrize("strict, expected", [(False, {"Route 17", "Route 1", "US-1A Bypass"}),
                                              (True, {"Route 1", "US-1A Bypass"})])
def test_route_prefixes(spark, strict, expected):
    lines = spark.createDataFrame(
        [(n, "NJ") for n in ("Route 17", "Route 1", "US-1A Bypass", "Main 1")], "road_name string, state string")
    asked = spark.createDataFrame([("US 1", "")], "road string, road_state string")
    assert {r.road_name for r in discovery.match_roads(asked, lines, strict).collect()} == expected


def test_profiles(spark, small_world):
    ids = spark.createDataFrame([("smith",), ("nobody",)], "entity_id string")
    rows = {r.entity_id: r for r in profiles.profiles(ids, small_world, as_of()).collect()}
    known, unknown = rows["smith"], rows["nobody"]
    assert sorted(r.parcel_id for r in profiles.profile_properties(ids, small_world).collect()) == [
        "NJ_MIDDLESEX_0024_00001", "far"]
    assert known.registered_agent.name == "CT" and known.n_beneficial_owners == 1
    assert [r.name for r in profiles.profile_owners(ids, small_world).collect()] == ["John Smith"]
    assert (unknown.canonical_name, unknown.contact_status, unknown.source, unknown.confidence) == (
        "Unknown Entity", "not_available", "not_found", 0.0)
    assert known.portfolio_summary.property_count == 2


def test_serving_writes_the_log(spark, small_world, tmp_path):
    tables = stored_at(spark, tmp_path / "served")
    for name, rows in small_world.items():
        tables.overwrite(name, rows)
    asked = spark.createDataFrame([("a", "Highway 9, New Jersey", "retail", 0.0, None, 10)],
                                  "request_id string, corridor string, property_type string, lot_size_min_acres double, "
                                  "lot_size_max_acres double, max_results int")
    serving.serve_discovery(tables, asked, as_of())
    serving.serve_profiles(tables, spark.createDataFrame([("smith",), ("nobody",)], "entity_id string"), as_of())
    log = sorted((r.tool_name, r.entity_id) for r in tables.read("query_log").collect())
    assert log == [("investor_discovery", "smith"), ("owner_profile", "smith")]


def test_refresh_rewrites_only_the_states_it_touches(spark, tmp_path):
    tables = stored_at(spark, tmp_path / "t")
    old = spark.createDataFrame(
        [("p1", "NJ"), ("p2", "NY"), ("moved", "PA"), ("stays", "CT")], "parcel_id string, state string").withColumns({
            "address": F.lit("1 A"), "city": F.lit("X"), "zip": F.lit("1"), "property_type": F.lit("Retail")})
    tables.overwrite("parcels", old)

    def files():
        return {str(f.relative_to(tmp_path)) for f in (tmp_path / "t" / "parcels").rglob("*.parquet")}

    before = files()
    landed_at = tmp_path / "landed"
    landed_at.mkdir()
    (landed_at / "nj.geojsonseq").write_text("\n".join([feature(), feature(properties={"id": "moved"})]))
    streaming.refresh_addresses(tables, str(landed_at), str(tmp_path / "c"), as_of()).awaitTermination()
    after = files()
    kept = {f for f in before if "state=NY" in f or "state=CT" in f}
    assert kept and kept <= after and not any("state=PA" in f for f in after)
    assert sorted((r.parcel_id, r.state) for r in tables.read("parcels").collect()) == [
        ("moved", "NJ"), ("p1", "NJ"), ("p2", "NY"), ("stays", "CT")]


def test_appends_add_files_and_overwrites_may_read_their_table(spark, tmp_path):
    tables = stored_at(spark, tmp_path / "t")
    alias = lambda n: spark.createDataFrame([(f"e{n}", "A", 0.9, "trgm")], TABLES["entity_aliases"])
    files = lambda: {f.name for f in (tmp_path / "t" / "entity_aliases").glob("*.parquet")}
    kept = set()
    for n in range(3):
        tables.append("entity_aliases", alias(n))
        assert kept < files()
        kept = files()
    tables.append("entity_aliases", tables.read("entity_aliases").filter("entity_id = 'e0'"))
    assert tables.read("entity_aliases").count() == 4
    after = tables.overwrite("entity_aliases", tables.read("entity_aliases").filter("entity_id <> 'e0'"))
    assert sorted(r.entity_id for r in after.collect()) == ["e1", "e2"]
    with pytest.raises(ValueError):
        tables.overwrite("query_log", tables.read("query_log"))
    with pytest.raises(KeyError):
        tables.read("other")


def test_stored_states(spark, tmp_path):
    tables = stored_at(spark, tmp_path / "t")
    rows = spark.createDataFrame(
        [("a", "NJ"), ("b", "NY"), ("c", None), ("d", "O'X")], "parcel_id string, state string")
    tables.overwrite("parcels", rows)
    some = tables.read("parcels", ["nj"])
    assert [r.parcel_id for r in some.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(state" in some._jdf.queryExecution().toString()
    tables.replace_states("parcels", rows.filter("parcel_id = 'a'").withColumn("city", F.lit("X")), ["NJ", "O'X"])
    assert {(r.parcel_id, r.city, r.state) for r in tables.read("parcels").collect()} == {
        ("a", "X", "NJ"), ("b", None, "NY"), ("c", None, None)}
    tables.overwrite("parcels", rows.filter("parcel_id = 'b'"))  # a full overwrite leaves no state behind
    assert [r.parcel_id for r in tables.read("parcels").collect()] == ["b"]


def test_late_log_files_count(spark, tmp_path):
    for day in (20, 21, 5):
        rows = spark.sql(f"SELECT 'e' AS entity_id, TIMESTAMP'2024-01-{day:02d} 10:00:00' AS queried_at")
        rows.write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
        streaming.keep_popularity(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.day.day: r.n_queries for r in streaming.read_popularity(spark, str(tmp_path / "out")).collect()}
    assert got == {5: 1, 20: 1, 21: 1}


def test_every_landed_answer_is_merged(spark, small_world):
    parcels = small_world["parcels"].limit(1).drop("owner_name_raw", "parcel_id").crossJoin(
        spark.range(700).selectExpr("concat('p', id) AS parcel_id")).withColumn("owner_name_raw", F.lit(None).cast("string"))
    answers = parcels.select("parcel_id", F.lit(
        '{"property": [{"owner": {"owner1": {"fullname": "DOE"}}}]}').alias("response"))
    after = resolution.enrich_parcels(parcels.select(*small_world["parcels"].columns), answers, as_of())
    assert after.filter("owner_name_raw = 'DOE'").count() == 700


def test_repeated_staged_rows_give_one_parcel(spark, small_world):
    parcels = small_world["parcels"]
    twice = parcels.limit(1).union(parcels.limit(1)).withColumn("address", F.lit("2 B"))
    assert upsert.upsert_parcels(parcels, twice, "address", as_of()).count() == 2


def test_address_match(spark, small_world):
    asked = spark.createDataFrame(
        [("a", "1240 Highway 9, Woodbridge NJ"), ("b", "1240 Hwy 9, Woodbridge NJ"), ("c", "zzz qqq")],
        "request_id string, address string")
    rows = {r.request_id: r for r in address_match.match_addresses(asked, small_world, as_of()).collect()}
    assert rows["a"].status == rows["b"].status == "found" and rows["c"].status == "not_found"
    assert rows["a"].entity_id == "smith" and rows["b"].parcel.parcel_id == "NJ_MIDDLESEX_0024_00001"


@pytest.mark.parametrize("method", ["trigram", "token_set"])
def test_resolution_over_stored_tables(spark, small_world, tmp_path, method):
    tables = stored_at(spark, tmp_path / "t")
    misspelt = small_world["parcels"].withColumn("owner_name_raw", F.lit("Smith Captal Holdings LLC"))
    tables.overwrite("parcels", misspelt)
    tables.overwrite("entities", small_world["entities"])
    edges = resolution.resolve_entities(tables, None, as_of(), method).collect()
    assert {(r.entity_id, r.method) for r in edges} == {("smith", "fuzzy")} and len(edges) == 2
    # A second run finds no new names and changes nothing.
    resolution.resolve_entities(tables, None, as_of(), method)
    assert tables.read("entity_aliases").count() == 1
    assert sorted(map(tuple, tables.read("portfolio_edges").collect())) == sorted(map(tuple, edges))


def test_upserts_are_idempotent(spark, small_world):
    parcels = small_world["parcels"]
    new = parcels.limit(1).select("parcel_id", "address", "city", "state", "zip", "lat", "lon", "source").withColumn(
        "address", F.lit("1 New Road"))
    for policy in ("replace", "address", "enrich", "enrich_update"):
        once = upsert.upsert_parcels(parcels, new, policy, as_of())
        twice = upsert.upsert_parcels(once, new, policy, as_of())
        assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    with pytest.raises(ValueError):
        upsert.upsert_parcels(parcels, new, "other", as_of())


def test_stored_edges_are_groups(spark, tmp_path):
    """Edges of a name with many parcels and many entities take the room of both; view, merges, appends and old flat tables give flat rows."""
    tables = stored_at(spark, tmp_path / "t")
    schema = TABLES["portfolio_edges"]
    old = [("e1", "p1", 0.5, "graph"), ("e2", "p2", None, "graph"), ("x", "p1", 1.0, "graph"), ("x", None, 0.3, "graph"), ("x", "q", 0.3, "graph")]
    sql = lambda: sorted(map(tuple, spark.sql(f"SELECT * FROM `{tables.database}`.portfolio_edges").collect()), key=repr)
    # A flat table as earlier versions wrote it.
    spark.sql(f"CREATE TABLE `{tables.database}`.portfolio_edges ({schema.replace(': ', ':')}) USING parquet")
    spark.createDataFrame(old, schema).write.insertInto(f"`{tables.database}`.portfolio_edges")
    assert sorted(map(tuple, tables.read("portfolio_edges").collect()), key=repr) == sorted(old, key=repr) == sql()

    tables.overwrite("parcels", spark.createDataFrame([(f"p{i}", "NJ", "Acme") for i in range(30)] + [(None, "NJ", "Acme")],
                                                      "parcel_id string, state string, owner_name_raw string"))
    tables.overwrite("entities", spark.createDataFrame([(f"e{i}", "ACME") for i in range(20)], "entity_id string, canonical_name string"))
    new = {(f"e{i}", p, 1.0, "exact") for i in range(20) for p in [f"p{k}" for k in range(30)] + [None]}
    merged = sorted(map(tuple, resolution.recompute_portfolio(tables, "merge").collect()), key=repr)
    assert merged == sorted([*new, *old[2:]], key=repr) == sql()
    assert sorted(map(tuple, tables.read_all()["portfolio_edges"].flat().collect()), key=repr) == merged
    rebuilt = sorted(map(tuple, resolution.recompute_portfolio(tables, "rebuild").collect()), key=repr)
    assert rebuilt == sorted(new, key=repr) == sql()
    # 31 parcels; 20 owners for the name and 20 for the missing id, which is a group of its own.
    assert spark.table(tables.name("portfolio_groups")).count() == 31 + 40
    tables.append("portfolio_edges", spark.createDataFrame([("x", "p1", 0.2, "fuzzy")], schema))
    assert sql() == sorted([*new, ("x", "p1", 0.2, "fuzzy")], key=repr)
    kept = tables.overwrite("portfolio_edges", tables.read("portfolio_edges").filter("parcel_id IN ('p1', 'p2')"))
    assert kept.count() == 41 == len(sql())
