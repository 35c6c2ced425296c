"""Registered queries for the file formats and normalisers.

Landed records (JSON lines, registry and tax-lot rows, vendor answers) are made from the driver's tables, then read
by the library as it would read files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.operators import upsert
from parcelweave.plans import resolution as R
from parcelweave.plans.adapters import as_of
from parcelweave.plans import profiles, serving
from parcelweave.plans.catalog import CTES, _FOUND, _discovered, _landed_contacts, register, tables_of
from parcelweave.plans.discovery import parse_requests
from parcelweave.plans.resolution import landed_details
from parcelweave.session import workdir
from parcelweave.sources import addresses, landed, registry, roads, tax_lots, vendor
from parcelweave.sources.tables import Tables
from parcelweave.streaming import jobs as streaming


def _scratch(a, name: str) -> str:
    return f"{workdir(a.spark)}/{name}-{uuid.uuid4().hex}"


def _stored(a, name: str) -> Tables:
    """Empty domain tables in a database of their own."""
    at = _scratch(a, name)
    return Tables(a.spark, "parcelweave_" + at.rsplit("/", 1)[1].replace("-", "_"), at)


# Address features -------------------------------------------------------------------------------------------

def _feature_lines(a):
    """One feature line per order; every eighth order has one of the known faults or odd forms."""
    o, key = a.source("orders"), F.col("o_orderkey")
    lon = F.lit(-74.0) + (key % 1000).cast("double") / 1000
    lat = F.lit(40.0) + (key % 777).cast("double") / 1000
    kind = key % 8
    level = lambda value, code: F.struct(value.alias("value"), code.alias("short_code"))
    text = lambda s: F.lit(s).cast("string")
    levels = F.when(kind != 6, F.array(
        level(text("New Jersey"), F.when(kind != 4, F.lit("US-NJ"))),
        level(F.concat(F.lit("Town "), F.col("o_custkey")), text(None))))
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.when(kind == 7, F.concat(F.lit("feature_"), key)).alias("id"),
        F.struct(F.when(kind == 1, "LineString").otherwise("Point").alias("type"),
                 F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(
            F.when(~kind.isin(2, 7), F.concat(F.lit("prop_"), key)).alias("id"),
            F.when(kind != 3, (key % 900).cast("string")).alias("number"),
            F.when(kind != 3, F.lit("Main Street")).alias("street"),
            F.when(key % 3 == 0, F.lit("07095")).alias("postcode"),
            levels.alias("address_levels"),
        ).alias("properties")))
    line = F.when(kind == 0, F.lit("{bad")).when(kind == 5, F.concat(F.lit("\x1e"), feature)).otherwise(feature)
    return o.select(line.alias("value"), key)


_FEATURES = """
, features AS (
  SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'unparsable' WHEN 1 THEN 'not_point' WHEN 3 THEN 'no_address'
                       WHEN 6 THEN 'no_state' END AS reject_reason,
         CASE o_orderkey % 8 WHEN 2 THEN printf('ov_%.6f_%.6f', -74.0 + CAST(o_orderkey % 1000 AS DOUBLE) / 1000,
                                                40.0 + CAST(o_orderkey % 777 AS DOUBLE) / 1000)
              WHEN 7 THEN 'feature_' || o_orderkey ELSE 'prop_' || o_orderkey END AS parcel_id,
         (o_orderkey % 900) || ' Main Street' AS address, 'Town ' || o_custkey AS city,
         CASE WHEN o_orderkey % 8 = 4 THEN 'NE' ELSE 'NJ' END AS state,
         CASE WHEN o_orderkey % 3 = 0 THEN '07095' ELSE '' END AS zip,
         40.0 + CAST(o_orderkey % 777 AS DOUBLE) / 1000 AS lat,
         -74.0 + CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS lon
  FROM orders)
"""


@register(CTES + _FEATURES + """SELECT o_orderkey, parcel_id, address, city, state, zip, lat, lon FROM features
                                WHERE reject_reason IS NULL""")
def address_features(a):
    return landed.accepted(addresses.parse_addresses(_feature_lines(a))).select(
        "o_orderkey", "parcel_id", "address", "city", "state", "zip", F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"))


@register(CTES + _FEATURES + """SELECT coalesce(reject_reason, 'loaded') AS outcome, count(*) AS n
                                FROM features GROUP BY 1""")
def address_ingest_metrics(a):
    return landed.ingest_metrics(addresses.parse_addresses(_feature_lines(a)))


# Features that share a coordinate id differ only in what the file order decides, so their number, town and zip are left out.
_LOADED = """
, loaded AS (SELECT parcel_id, state, CASE WHEN starts_with(parcel_id, 'ov_') THEN '' ELSE address END AS address,
                    CASE WHEN starts_with(parcel_id, 'ov_') THEN '' ELSE city END AS city,
                    CASE WHEN starts_with(parcel_id, 'ov_') THEN '' ELSE zip END AS zip FROM (
    SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY o_orderkey DESC) AS n
    FROM features WHERE reject_reason IS NULL) WHERE n = 1)
SELECT parcel_id, address, city, state, zip FROM loaded"""


def _loaded(parcels):
    own = ~F.col("parcel_id").startswith("ov_")
    return parcels.select(
        "parcel_id", "state", *[F.when(own, F.col(c)).otherwise("").alias(c) for c in ("address", "city", "zip")])


@register(CTES + _FEATURES + _LOADED)
def load_addresses(a):
    """Staging reloaded and merged into stored parcels, twice with the same outcome."""
    tables = _stored(a, "addresses")
    rows = addresses.parse_addresses(_feature_lines(a).select(
        "value", F.lit("f").alias("_file"), F.lit(0).alias("_block"), F.col("o_orderkey").alias("_row")))
    for _ in range(2):
        after = R.load_addresses(tables, rows, as_of())
    return _loaded(after)


@register(CTES + _FEATURES + _LOADED)
def address_stream_refresh(a):
    """Address files taken in by the stream, merged into an empty parcels table."""
    root = _scratch(a, "refresh")
    _feature_lines(a).select("value").write.option("compression", "none").text(f"{root}/landed")
    tables = _stored(a, "refreshed")
    query = streaming.refresh_addresses(
        tables, f"{root}/landed", f"{root}/checkpoint", as_of(), suffix=".txt")
    query.awaitTermination()
    return _loaded(tables.read("parcels"))


@register("SELECT parcel_id FROM parcels WHERE lat BETWEEN 38.9284 AND 41.3574 AND lon BETWEEN -75.5593 AND -73.8977")
def parcels_in_state_box(a):
    return addresses.in_state_boxes(a.tables()["parcels"], ["nj"]).select("parcel_id")


# Roads ------------------------------------------------------------------------------------------------------

@register("""SELECT c_custkey, 'Way ' || c_custkey AS road_name, 'NY' AS state, CAST(2 + c_custkey % 3 AS INTEGER) AS n_vertices
             FROM customer WHERE c_custkey % 6 IN (3, 4, 5)""")
def road_ways(a):
    """Ways parsed from extract documents, one document per customer."""
    key = F.col("c_custkey")
    kind = key % 6
    vertices = F.transform(
        F.sequence(F.lit(0), F.when(kind == 1, F.lit(0)).otherwise(1 + key % 3)),
        lambda i: F.struct((F.lit(40.0) + i / 100).alias("lat"), (F.lit(-74.0) - i / 100).alias("lon")))
    tags = F.create_map(
        F.lit("highway"), F.when(kind == 3, "primary_link").otherwise("secondary"),
        F.lit("name"), F.when(kind != 2, F.concat(F.lit("Way "), key)).otherwise(""))
    element = F.struct(
        F.when(kind == 0, "node").otherwise("way").alias("type"), key.alias("id"), tags.alias("tags"),
        vertices.alias("geometry"))
    docs = a.source("customer").select(F.array(element, element).alias("elements"))
    text = docs.select(F.to_json(F.struct("elements")).alias("doc"))
    parsed = text.select(F.from_json("doc", roads.EXTRACT)["elements"].alias("elements"))
    ways = roads.parse_ways(parsed, F.lit("ny"))
    return ways.select(
        F.regexp_extract("road_name", r"(\d+)", 1).cast("long").alias("c_custkey"), "road_name", "state",
        F.size("geom").alias("n_vertices"))


# Registry ---------------------------------------------------------------------------------------------------

def _raw_registry(a):
    key = F.col("p_partkey")
    kinds = ["DOMESTIC LIMITED LIABILITY COMPANY", "BUSINESS TRUST", "FOREIGN BUSINESS CORPORATION",
             "LIMITED PARTNERSHIP", "SAVINGS BANK", "SOLE PROPRIETOR", "OTHER"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % 7 + 1).cast("int"))
    return a.source("part").select(
        F.when(key % 13 != 0, key.cast("string")).alias("dos_id"),
        F.concat(F.lit(" "), "p_name", F.lit(', "'), "p_brand", F.lit('" ')).alias("current_entity_name"),
        kind.alias("entity_type"),
        F.when(key % 3 == 0, "03/15/2019").when(key % 3 == 1, "2018-02-03T00:00:00").otherwise("")
        .alias("initial_dos_filing_date"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("Agent "), key)).alias("registered_agent_name"),
        F.concat(key, F.lit(" Elm St")).alias("registered_agent_address_1"),
        F.when(key % 2 == 0, " ").otherwise("Albany").alias("registered_agent_city"),
        F.lit("NY").alias("registered_agent_state"), F.lit("12207").alias("registered_agent_zip"))


_REGISTRY = """
, filings AS (
  SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS filing_number, p_name || ', "' || p_brand || '"' AS name,
         CASE p_partkey % 7 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Trust' WHEN 2 THEN 'Corporation' WHEN 3 THEN 'Corporation'
              WHEN 4 THEN 'Corporation' WHEN 5 THEN 'Individual' ELSE 'Unknown' END AS entity_type,
         CASE p_partkey % 3 WHEN 0 THEN '03/15/2019' WHEN 1 THEN '2018-02-03' ELSE '' END AS incorporated_date,
         CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Agent ' || p_partkey END AS agent,
         p_partkey || ' Elm St' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ', Albany' END || ', NY, 12207' AS address
  FROM part WHERE p_partkey % 13 <> 0)
"""


@register(CTES + _REGISTRY + """
SELECT filing_number, name, entity_type, 'active' AS status, incorporated_date, agent AS registered_agent_name,
       address AS registered_agent_address,
       'https://apps.dos.ny.gov/publicInquiry/EntityDisplay?DOS_ID=' || filing_number AS filing_url FROM filings""")
def registry_standard(a):
    return registry.standardize_registry(_raw_registry(a), "ny")


@register(CTES + _REGISTRY + """
SELECT 'sos_ny_' || filing_number AS entity_id, name AS canonical_name, entity_type, 'US-NY' AS jurisdiction,
       'active' AS status, CASE p_partkey % 3 WHEN 0 THEN DATE '2019-03-15' WHEN 1 THEN DATE '2018-02-03' END
         AS incorporated_at,
       nullif(agent, '') AS registered_agent_name, address AS registered_agent_address FROM filings""")
def registry_entities(a):
    """Standard registry files written, then read back as entities."""
    root = _scratch(a, "registry")
    registry.write_registry_csv(registry.standardize_registry(_raw_registry(a), "ny"), root, "ny")
    return registry.read_registry(a.spark, root).drop("sos_filing_url")


# Tax lots ---------------------------------------------------------------------------------------------------

def _raw_lots(a):
    key = F.col("o_orderkey")
    letters = F.element_at(F.split(F.lit("O,K,L,E,F,G,H,D,C,R,S,Z,o"), ","), (key % 13 + 1).cast("int"))
    borough = F.element_at(F.split(F.lit("MN,BX,BK,QN,SI,??"), ","), (key % 6 + 1).cast("int"))
    return a.source("orders").select(
        F.concat(key, F.lit(" Broadway")).alias("address"), F.lit("10001").alias("postcode"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("OWNER "), "o_custkey")).alias("ownername"),
        F.when(key % 17 != 0, key.cast("string")).alias("bbl"),
        F.concat(F.lit(" "), (key % 9).cast("string")).alias("landuse"),
        F.concat(letters, F.lit("1")).alias("bldgclass"),
        F.when(key % 7 == 0, "0").when(key % 7 == 1, "n/a").otherwise(F.col("o_totalprice").cast("string"))
        .alias("lotarea"),
        F.when(key % 11 == 0, "").otherwise("40.7").alias("latitude"),
        F.when(key % 19 == 0, "0").otherwise("-73.9").alias("longitude"), borough.alias("borough"))


_LOTS = """
, lots AS (
  SELECT o_orderkey, 'ny_bbl_' || o_orderkey AS parcel_id,
         CASE o_orderkey % 6 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Bronx' WHEN 2 THEN 'Brooklyn' WHEN 3 THEN 'Queens'
              WHEN 4 THEN 'Staten Island' ELSE 'New York' END AS city,
         CASE WHEN o_orderkey % 7 > 1 AND o_totalprice > 0 THEN o_totalprice / 43560 END AS lot_size_acres,
         CASE WHEN o_orderkey % 13 IN (0, 12) THEN 'Office' WHEN o_orderkey % 13 IN (1, 2) THEN 'Retail'
              WHEN o_orderkey % 13 IN (3, 4, 5) THEN 'Industrial' WHEN o_orderkey % 13 = 6 THEN 'Hospitality'
              WHEN o_orderkey % 13 IN (7, 8, 9) THEN 'Multifamily' WHEN o_orderkey % 13 = 10 THEN 'Mixed-Use'
              ELSE 'Unknown' END AS property_type,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'OWNER ' || o_custkey END AS owner_name_raw,
         CASE WHEN o_orderkey % 9 NOT BETWEEN 4 AND 7 THEN 'not_commercial'
              WHEN o_orderkey % 11 = 0 OR o_orderkey % 19 = 0 THEN 'no_coordinates'
              WHEN o_orderkey % 17 = 0 THEN 'no_id_or_address' END AS reject_reason
  FROM orders)
"""


@register(CTES + _LOTS + """SELECT parcel_id, city, lot_size_acres, property_type, owner_name_raw FROM lots
                            WHERE reject_reason IS NULL""")
def tax_lot_parcels(a):
    return landed.accepted(tax_lots.parse_tax_lots(_raw_lots(a))).select(
        "parcel_id", "city", "lot_size_acres", "property_type", "owner_name_raw")


@register(CTES + _LOTS + "SELECT coalesce(reject_reason, 'loaded') AS outcome, count(*) AS n FROM lots GROUP BY 1")
def tax_lot_metrics(a):
    return landed.ingest_metrics(tax_lots.parse_tax_lots(_raw_lots(a)))


@register("""SELECT parcel_id, owner_name_raw, last_sale_date FROM (
               SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY l_shipdate, l_partkey, l_suppkey,
                                            l_extendedprice, l_quantity, l_discount, l_tax) AS n
               FROM parcels_staging) WHERE n = 1""")
def first_record_per_parcel(a):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    return upsert.first_by_position(a.raw("parcels_staging"), "parcel_id", order).select(
        "parcel_id", "owner_name_raw", "last_sale_date")


# Vendor property detail -------------------------------------------------------------------------------------

def _property_answers(a):
    o, key = a.source("orders"), F.col("o_orderkey")
    kinds = F.split(F.lit("RETAIL STORE,OFFICE,WAREHOUSE,APARTMENT,MIXED USE,VACANT LOT,MOTEL,COMMERCIAL NEC,OTHER"), ",")
    kind = F.element_at(kinds, (key % 9 + 1).cast("int"))
    detail = F.struct(
        F.struct(kind.alias("proptype"), F.lit("").alias("propSubType")).alias("summary"),
        F.struct(F.col("o_totalprice").alias("lotsize1"),
                 F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 2.5).otherwise(20000.0).alias("lotsize2")).alias("lot"),
        F.struct(F.struct(F.when(key % 2 == 0, F.col("o_totalprice")).alias("bldgsize"),
                          F.lit(1200.0).alias("grosssize")).alias("size")).alias("building"),
        F.struct(F.when(key % 4 == 0, "2020-01-02").alias("saleRecDate"), F.lit("2019-12-31").alias("salesearchdate"),
                 F.col("o_totalprice").alias("saleamt")).alias("sale"),
        F.struct(F.struct(
            F.when(key % 5 == 0, F.concat(F.lit(" FULL "), "o_custkey", F.lit(" "))).alias("fullname"),
            F.when(key % 5 == 1, F.lit("")).otherwise("DOE").alias("lastname"),
            F.when(key % 5 == 1, F.lit("")).otherwise("JO").alias("firstname")).alias("owner1")).alias("owner"))
    answer = F.when(key % 10 == 9, F.when(key % 30 == 29, "null").otherwise('{"property": []}')).when(key % 30 == 8, "{bad").when(
        key % 30 == 18, "<html>error</html>").when(key % 30 == 28, F.lit(None)).otherwise(
        F.to_json(F.struct(F.array(detail).alias("property"))))
    return o.select(F.concat(F.lit("p_"), key, F.lit("_1")).alias("parcel_id"), answer.alias("response"), key)


_DETAILS = """
, details AS (
  SELECT 'p_' || o_orderkey || '_1' AS parcel_id, o_orderkey, o_orderkey % 10 NOT IN (8, 9) AS found,
         CASE WHEN o_orderkey % 30 IN (8, 18) THEN 'malformed' WHEN o_orderkey % 10 IN (8, 9) THEN 'not_found' END AS failed,
         CASE WHEN o_orderkey % 5 = 0 THEN 'FULL ' || o_custkey WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'JO DOE' END
           AS owner_name_raw,
         CASE o_orderkey % 9 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Office' WHEN 2 THEN 'Industrial' WHEN 3 THEN 'Multifamily'
              WHEN 4 THEN 'Mixed-Use' WHEN 5 THEN 'Land' WHEN 6 THEN 'Hospitality' WHEN 7 THEN 'Retail'
              ELSE 'Unknown' END AS property_type,
         CASE WHEN o_orderkey % 3 = 1 THEN 2.5 WHEN o_totalprice > 0 THEN o_totalprice / 43560 END AS lot_size_acres,
         CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 1200 END AS building_sqft,
         CASE WHEN o_orderkey % 4 = 0 THEN DATE '2020-01-02' ELSE DATE '2019-12-31' END AS last_sale_date,
         o_totalprice AS last_sale_price
  FROM orders)
"""


@register(CTES + _DETAILS + """
SELECT d.parcel_id, d.owner_name_raw, d.property_type, d.lot_size_acres, d.building_sqft, d.last_sale_date,
       d.last_sale_price, CASE WHEN d.owner_name_raw IS NULL THEN 'no_owner' ELSE 'enriched' END AS outcome
FROM details d JOIN parcels p USING (parcel_id) WHERE found AND p.owner_name_raw IS NULL
UNION ALL
SELECT d.parcel_id, NULL, 'Unknown', NULL, NULL, NULL, NULL, failed
FROM details d JOIN parcels p USING (parcel_id) WHERE NOT found AND p.owner_name_raw IS NULL""")
def property_details(a):
    wanted = R.enrichment_candidates(a.tables()["parcels"], limit=None)
    return landed_details(wanted, _property_answers(a)).drop("found")


@register("""SELECT kind, outcome, count(*) AS n FROM (
               SELECT 'property' AS kind, CASE WHEN o_orderkey % 30 IN (8, 18) THEN 'malformed'
                        WHEN o_orderkey % 30 = 28 THEN 'empty' WHEN o_orderkey % 30 = 29 THEN 'null'
                        ELSE 'answered' END AS outcome FROM orders
               UNION ALL SELECT 'profile', CASE WHEN c_custkey % 20 IN (2, 12) THEN 'malformed'
                        WHEN c_custkey % 20 IN (4, 14) THEN 'empty' WHEN c_custkey % 20 = 6 THEN 'null'
                        WHEN c_custkey % 20 = 16 THEN 'wrong_list' ELSE 'answered' END FROM customer WHERE c_custkey % 2 = 0
               UNION ALL SELECT 'email', CASE WHEN c_custkey % 30 = 3 THEN 'malformed' ELSE 'answered' END
                         FROM customer WHERE c_custkey % 3 = 0)
             GROUP BY ALL""")
def vendor_answer_metrics(a):
    profile, email = _landed_contacts(a)
    return vendor.answer_metrics(property=_property_answers(a), profile=profile, email=email)


@register(CTES + _DETAILS + """
SELECT parcel_id, coalesce(p.owner_name_raw, CASE WHEN found THEN d.owner_name_raw END) AS owner_name_raw,
       CASE WHEN p.owner_name_raw IS NULL AND found AND d.property_type <> 'Unknown' THEN d.property_type
            ELSE p.property_type END AS property_type,
       CASE WHEN p.owner_name_raw IS NULL AND found THEN coalesce(d.lot_size_acres, p.lot_size_acres)
            ELSE p.lot_size_acres END AS lot_size_acres,
       CASE WHEN p.owner_name_raw IS NULL AND found THEN coalesce(d.building_sqft, p.building_sqft)
            ELSE p.building_sqft END AS building_sqft,
       CASE WHEN p.owner_name_raw IS NULL AND found THEN d.last_sale_date ELSE p.last_sale_date END AS last_sale_date
FROM parcels p LEFT JOIN details d USING (parcel_id)""")
def owner_enrichment(a):
    after = R.enrich_parcels(a.tables()["parcels"], _property_answers(a), as_of())
    return after.select("parcel_id", "owner_name_raw", "property_type", "lot_size_acres", "building_sqft",
                        "last_sale_date")


# Requests and stream ----------------------------------------------------------------------------------------

@register("""SELECT request_id, road, road_state, nullif(number, '') AS route_number, max_results FROM asked""")
def corridor_split(a):
    return parse_requests(a.raw("corridor_requests")).select(
        "request_id", "road", "road_state", N.route_number(F.col("road")).alias("route_number"), "max_results")


@register("""SELECT CAST(queried_at AS DATE) AS day, entity_id, count(*) AS n_queries FROM query_log GROUP BY 1, 2""")
def stream_popularity(a):
    """Daily counts kept by the stream over the query log's files."""
    root = _scratch(a, "popularity")
    log = a.raw("query_log").withColumn("queried_at", F.col("queried_at").cast("timestamp"))
    log.write.parquet(f"{root}/log")
    stream = a.spark.readStream.schema(log.schema).parquet(f"{root}/log")
    streaming.keep_popularity(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return streaming.read_popularity(a.spark, f"{root}/out")


@register("""SELECT 'investor_discovery' AS tool_name, entity_id, corridor, count(*) AS n FROM (
               SELECT entity_id, road || ', ' || road_state AS corridor FROM owner_ranks JOIN asked USING (request_id))
             GROUP BY ALL
             UNION ALL SELECT 'owner_profile', entity_id, NULL, 1 FROM entities""")
def served_log(a):
    """Owners served by discovery and profiles served, appended to the query log and read back."""
    tables, t = _stored(a, "log"), tables_of(a)
    serving.log_discovery(tables, _discovered(a))
    serving.log_profiles(tables, profiles.profiles(t["entities"], t, as_of()), as_of())
    return tables.read("query_log").groupBy("tool_name", "entity_id", "corridor").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT entity_id, parcel_id, confidence, method FROM edges""")
def stored_recompute(a):
    """The portfolio job over stored tables: written, resolved and read back, twice, with the same outcome."""
    tables = _stored(a, "tables")
    domain = a.tables()
    for name in ("parcels", "entities", "entity_aliases"):
        tables.overwrite(name, domain[name])
    R.recompute_portfolio(tables, "rebuild")
    return R.recompute_portfolio(tables, "merge")


@register(CTES + _FOUND + """
SELECT coalesce(c.entity_id, f.entity_id) AS entity_id, coalesce(f.name, c.name) AS name,
       coalesce(f.confidence, c.confidence) AS confidence, coalesce(f.source, 'hunter') AS source
FROM contacts c FULL OUTER JOIN found f ON c.entity_id = f.entity_id""")
def contact_refresh(a):
    """Every landed answer merged into the stored contacts, however many there are."""
    tables, t = _stored(a, "contacts"), a.tables()
    for name in ("entities", "contacts"):
        tables.overwrite(name, t[name])
    return R.refresh_contacts(tables, *_landed_contacts(a), as_of()).select("entity_id", "name", "confidence", "source")


@register("SELECT road_name, state, count(*) AS n FROM (SELECT DISTINCT road_name, state, lat1, lon1, lat2, lon2 FROM roads) GROUP BY ALL")
def load_roads(a):
    """Roads loaded twice into a stored table; the second load adds nothing."""
    tables = _stored(a, "roads")
    rows = a.tables()["roads"].withColumn("road_key", F.sha2(F.to_json(F.struct("road_name", "state", "geom")), 256))
    for _ in range(2):
        R.load_roads(tables, rows, as_of())
    return tables.read("roads").groupBy("road_name", "state").agg(F.count(F.lit(1)).alias("n"))


@register(CTES + _LOTS + """
SELECT parcel_id, owner_name_raw, lot_size_acres, property_type FROM parcels
UNION ALL SELECT parcel_id, owner_name_raw, lot_size_acres, property_type FROM lots WHERE reject_reason IS NULL""")
def load_tax_lots(a):
    """Tax lots merged into stored parcels, twice with the same outcome."""
    tables = _stored(a, "lots")
    tables.overwrite("parcels", a.tables()["parcels"])
    lots = tax_lots.parse_tax_lots(_raw_lots(a).select(
        "*", F.lit("f").alias("_file"), F.lit(0).alias("_block"), F.lit(0).alias("_row")))
    for _ in range(2):
        after = R.load_tax_lots(tables, lots, as_of())
    return after.select("parcel_id", "owner_name_raw", "lot_size_acres", "property_type")


@register("""SELECT parcel_id, state FROM parcels WHERE state IN ('NJ', 'PA')""")
def states_selected(a):
    """Stored parcels of some states; the partitions of the others are not read."""
    tables = _stored(a, "states")
    tables.overwrite("parcels", a.tables()["parcels"])
    return tables.read("parcels", ["nj", "pa"]).select("parcel_id", "state")


@register(CTES + _LOTS + """
SELECT 'before' AS outcome, (SELECT count(*) FROM parcels) AS n
UNION ALL SELECT 'after', (SELECT count(*) FROM parcels) + (SELECT count(*) FROM lots WHERE reject_reason IS NULL)
UNION ALL SELECT 'added', (SELECT count(*) FROM lots WHERE reject_reason IS NULL)
UNION ALL SELECT 'rejected ' || reject_reason, count(*) FROM lots WHERE reject_reason IS NOT NULL GROUP BY 1""")
def job_metrics(a):
    """What a tax-lot load did: rows before and after, rows added, rows rejected by reason."""
    tables = _stored(a, "metrics")
    before = a.tables()["parcels"]
    tables.overwrite("parcels", before)
    lots = tax_lots.parse_tax_lots(_raw_lots(a).select(
        "*", F.lit("f").alias("_file"), F.lit(0).alias("_block"), F.lit(0).alias("_row")))
    after = R.load_tax_lots(tables, lots, as_of())
    rejected = landed.ingest_metrics(landed.rejected(lots)).select(
        F.concat(F.lit("rejected "), "outcome").alias("outcome"), "n")
    return landed.change_metrics(before, after, "parcel_id").unionByName(rejected)


@register("""SELECT CAST(p_partkey AS VARCHAR) AS filing_number, p_name AS name,
                    CASE p_partkey % 2 WHEN 0 THEN 'LLC' ELSE 'Trust' END AS entity_type, 'active' AS status,
                    '2020-01-02' AS incorporated_date, 'Agent ' || p_partkey AS registered_agent_name,
                    p_partkey || ' Elm St, Ames, IA, 50010' AS registered_agent_address, '' AS filing_url FROM part""")
def registry_second_layout(a):
    """The other state's raw layout; it has no filing address."""
    key = F.col("p_partkey")
    raw = a.source("part").select(
        key.cast("string").alias("corp_number"), F.col("p_name").alias("legal_name"),
        F.when(key % 2 == 0, "LIMITED LIABILITY COMPANY").otherwise("BUSINESS TRUST").alias("corporation_type"),
        F.lit("2020-01-02T00:00:00").alias("effective_date"), F.concat(F.lit("Agent "), key).alias("registered_agent"),
        F.concat(key, F.lit(" Elm St")).alias("ra_address_1"), F.lit("Ames").alias("ra_city"), F.lit("IA").alias("ra_state"),
        F.lit("50010").alias("ra_zip"))
    return registry.standardize_registry(raw, "ia")


@register("""SELECT regexp_replace(address, '^[0-9]+ ', '') AS road, state AS road_state, count(*) AS n_parcels,
                    max(lot_size_acres) AS max_acres FROM parcels GROUP BY ALL""")
def corridor_state_names(a):
    """Parcels counted by the corridor their landed text names, with full state names and abbreviations."""
    named = F.when(F.col("state") == "NY", " new york ").when(F.col("state") == "NJ", "New Jersey").otherwise(F.lower("state"))
    text = F.concat_ws(",", F.regexp_replace("address", "^[0-9]+", ""), named)
    return a.tables()["parcels"].groupBy(
        N.corridor_road(text).alias("road"), N.corridor_state(text).alias("road_state")).agg(
        F.count(F.lit(1)).alias("n_parcels"), F.max("lot_size_acres").alias("max_acres"))


@register("""SELECT user_id, count(*) AS n_notices, count(*) FILTER (status = 'dissolved') AS n_dissolved,
                    arg_max(status, (ts, event_id)) AS status
             FROM (SELECT *, CASE WHEN event_id % 8 < 2 THEN 'active' WHEN event_id % 8 < 4 THEN 'dissolved'
                                  WHEN event_id % 8 < 6 THEN 'suspended' ELSE 'unknown' END AS status FROM events)
             GROUP BY user_id""")
def registry_statuses(a):
    """The last status of each entity from its status notices, whose texts are every known one, an unknown and a missing one."""
    texts = F.array(*[F.lit(t) for t in ("Active", "good standing", "DISSOLVED", "cancelled", "Suspended", "revoked", "other", None)])
    text = F.element_at(texts, (F.col("event_id") % 8 + 1).cast("int"))
    return a.source("events").withColumn("status", N.entity_status(text)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_notices"), F.count_if(F.col("status") == "dissolved").alias("n_dissolved"),
        F.max_by("status", F.struct("ts", "event_id")).alias("status"))
