"""Domain tables derived from a star schema of parts, suppliers, customers, line items and events.

Each table is one SQL template over the source tables and the tables before it. The text is plain enough for Spark
and for the checking engine, so both read the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.operators.upsert import pick_first
from parcelweave.session import materialize

AS_OF = "2024-01-31"

ENTITIES = """
SELECT 'sos_ny_' || p_partkey AS entity_id,
       upper(p_name || ' ' || p_brand || ' ' || p_type || ' ' ||
         CASE p_partkey % 5 WHEN 0 THEN 'LLC' WHEN 1 THEN 'TRUST' WHEN 2 THEN 'INC' WHEN 3 THEN 'HOLDINGS LLC'
                            ELSE 'GROUP' END) AS canonical_name,
       CASE p_partkey % 5 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Trust' WHEN 2 THEN 'Corporation' WHEN 3 THEN 'LLC'
                          ELSE 'Unknown' END AS entity_type,
       'US-' || CASE p_size % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'NJ' ELSE 'PA' END AS jurisdiction,
       CASE p_partkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'dissolved' WHEN 2 THEN 'suspended'
                          ELSE 'unknown' END AS status,
       CAST('2024-01-31' AS DATE) - CAST(p_size AS INTEGER) AS updated_on,
       p_partkey
FROM {part}
"""

PARCELS_STAGING = """
SELECT 'p_' || l_orderkey || '_' || l_linenumber AS parcel_id,
       (l_orderkey % 900 + 100) || ' ' || p_name || ' Street' AS address,
       n_name AS city,
       CASE l_suppkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'NJ' ELSE 'PA' END AS state,
       CAST(10000 + l_suppkey % 90000 AS VARCHAR(10)) AS zip,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity / 10 END AS lot_size_acres,
       l_extendedprice AS building_sqft,
       CASE l_linenumber % 6 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Office' WHEN 2 THEN 'Industrial'
                             WHEN 3 THEN 'Multifamily' WHEN 4 THEN 'Mixed-Use' ELSE 'Land' END AS property_type,
       l_extendedprice * (1 - l_discount) AS last_sale_price,
       CAST(l_shipdate AS DATE) AS last_sale_date,
       CASE WHEN l_partkey % 10 = 0 THEN NULL
            ELSE CASE l_orderkey % 4 WHEN 0 THEN canonical_name
                                     WHEN 1 THEN '  ' || lower(canonical_name) || ' '
                                     WHEN 2 THEN substr(canonical_name, 1, 2) || substr(canonical_name, 4)
                                     ELSE replace(canonical_name, 'LLC', 'L L C') END END AS owner_name_raw,
       40 + CAST((l_orderkey * 7919 + l_linenumber * 104729) % 30000 AS DOUBLE) / 100000 AS lat,
       -74 + CAST((l_orderkey * 15485863 + l_linenumber * 32452843) % 30000 AS DOUBLE) / 100000 AS lon,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate
FROM {lineitem}
JOIN {part} ON l_partkey = p_partkey
JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey
JOIN {entities} ON entity_id = 'sos_ny_' || l_partkey
"""

PARCELS = """
SELECT parcel_id, address, city, state, zip, lot_size_acres, building_sqft, property_type, last_sale_price,
       last_sale_date, owner_name_raw, lat, lon
FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY l_shipdate DESC, l_partkey, l_suppkey,
                                   l_extendedprice, l_quantity, l_discount, l_tax) AS rn
      FROM {parcels_staging}) AS ranked
WHERE rn = 1
"""

ROADS = """
SELECT road_name, state, lat1, lon1,
       lat1 + (s_suppkey % 7 - 3) * CAST(0.01 AS DOUBLE) AS lat2,
       lon1 + (s_suppkey % 5 - 2) * CAST(0.01 AS DOUBLE) AS lon2, s_suppkey
FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Route ' || (s_suppkey % 20)
                                WHEN 1 THEN 'US Highway ' || (s_suppkey % 20)
                                WHEN 2 THEN p_name || ' Avenue' ELSE p_name || ' Street' END AS road_name,
             CASE s_nationkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'NJ' ELSE 'PA' END AS state,
             40 + CAST(s_suppkey * 7907 % 30000 AS DOUBLE) / 100000 AS lat1,
             -74 + CAST(s_suppkey * 6007 % 30000 AS DOUBLE) / 100000 AS lon1, s_suppkey
      FROM {supplier} JOIN {part} ON p_partkey = s_suppkey) AS named
"""

CONTACTS = """
SELECT 'sos_ny_' || c_custkey AS entity_id, c_name AS name, c_mktsegment AS role,
       CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence,
       CAST('2024-01-01' AS DATE) + CAST(c_custkey % 60 AS INTEGER) AS expires_on
FROM {customer} WHERE c_custkey % 3 = 0
"""

QUERY_LOG = """
SELECT 'sos_ny_' || user_id AS entity_id,
       CASE event_type WHEN 'view' THEN 'parcel_lookup' WHEN 'click' THEN 'owner_profile'
                       ELSE 'investor_discovery' END AS tool_name,
       ts AS queried_at
FROM {events}
"""

BENEFICIAL_OWNERS = """
SELECT 'sos_ny_' || c_custkey AS entity_id, c_name AS owner_name,
       CASE WHEN c_custkey < 4 THEN NULL
            ELSE 'sos_ny_' || CAST(floor(c_custkey / 4) AS BIGINT) END AS parent_entity_id
FROM {customer}
"""

# Aliases, old edges and request tables for the jobs that need them.
ALIASES = """
SELECT entity_id, lower(substr(canonical_name, 1, 2) || substr(canonical_name, 4)) AS alias_name, CAST(70 + c_custkey % 30 AS DOUBLE) / 100 AS match_score,
       'trgm' AS source
FROM {customer} JOIN {entities} ON entity_id = 'sos_ny_' || c_custkey
"""

CORRIDOR_REQUESTS = """
SELECT 'r_' || s_suppkey AS request_id, road_name || ', ' || state AS corridor,
       CASE s_suppkey % 6 WHEN 0 THEN 'retail' WHEN 1 THEN 'Office' WHEN 2 THEN 'Industrial'
                          WHEN 3 THEN 'Multifamily' WHEN 4 THEN 'Mixed-Use' ELSE 'Land' END AS property_type,
       CAST(s_suppkey % 3 AS DOUBLE) AS lot_size_min_acres,
       CASE WHEN s_suppkey % 4 = 0 THEN CAST(4 AS DOUBLE) END AS lot_size_max_acres,
       CAST(5 + s_suppkey % 20 AS INTEGER) AS max_results,
       road_name AS road, state AS road_state
FROM {roads}
"""

ADDRESS_REQUESTS = """
SELECT 'c_' || c_custkey AS request_id,
       CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 900 + 100) || ' ' || p_name || ' Street, ' || n_name || ' NY'
                          WHEN 1 THEN (c_custkey % 900 + 100) || ' ' || p_name || ' Street'
                          WHEN 2 THEN (c_custkey % 900 + 100) || ' ' || p_name || ' St, ' || n_name || ' NJ'
                          ELSE c_name END AS address,
       CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 900 + 100) || ' ' || p_name || ' Street'
                          WHEN 1 THEN (c_custkey % 900 + 100) || ' ' || p_name || ' Street'
                          WHEN 2 THEN (c_custkey % 900 + 100) || ' ' || p_name || ' St'
                          ELSE c_name END AS street,
       CASE WHEN c_custkey % 4 IN (0, 2) THEN n_name ELSE '' END AS asked_city
FROM {customer} JOIN {part} ON p_partkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

PARCEL_COLUMNS = ["parcel_id", "address", "city", "state", "zip", "lot_size_acres", "building_sqft", "property_type",
                  "last_sale_price", "last_sale_date", "owner_name_raw", "lat", "lon"]

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

TEMPLATES = {
    "entities": ENTITIES, "parcels_staging": PARCELS_STAGING, "parcels": PARCELS, "roads": ROADS,
    "contacts": CONTACTS, "query_log": QUERY_LOG, "beneficial_owners": BENEFICIAL_OWNERS, "entity_aliases": ALIASES,
    "corridor_requests": CORRIDOR_REQUESTS, "address_requests": ADDRESS_REQUESTS,
}


def check_ctes() -> str:
    """The templates as one WITH list for the checking engine."""
    names = {n: n for n in [*SOURCES, *TEMPLATES]}
    return ",\n".join(f"{name} AS ({sql.format(**names)})" for name, sql in TEMPLATES.items())


class LazyTables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __or__(self, makers: dict[str, Callable[[], DataFrame]]) -> LazyTables:
        return LazyTables(self._makers | makers)


class Adapted:
    """Adapter tables of one data folder. Each is derived once per session and kept as a table in the work folder."""

    _kept: dict[tuple[str, str], Adapted] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Adapted:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._kept:
            cls._kept[key] = cls(spark, sf_dir)
        return cls._kept[key]

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw(self, name: str) -> DataFrame:
        """The template's own columns."""
        if name == "parcels" and name not in self._tables:
            self._tables[name] = materialize(self._parcels(), "adapted-parcels")
        if name not in self._tables:
            sql = TEMPLATES[name]
            inputs = {n: self.source(n) for n in SOURCES if "{" + n + "}" in sql}
            inputs |= {n: self.raw(n) for n in TEMPLATES if "{" + n + "}" in sql}
            self._tables[name] = materialize(self.spark.sql(sql, **inputs), f"adapted-{name}")
        return self._tables[name]

    def _parcels(self) -> DataFrame:
        """The rows of the template `parcels`, ranked before part and supplier texts are joined to them.

        Line items without a part, supplier or nation are found by their distinct keys and left out first, so the rank is
        taken over the same rows. Only the line item's own columns are sorted; the staging table is not written.
        """
        part = pick_first(
            self.raw("entities").select("canonical_name", "entity_id").join(
                self.source("part").select("p_partkey", "p_name", F.concat(F.lit("sos_ny_"), "p_partkey").alias("entity_id")),
                "entity_id"), ["p_partkey"], [F.col("p_name"), F.col("canonical_name")])
        part = materialize(part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "canonical_name"), "adapted-part")
        supplier = pick_first(
            self.source("supplier").join(self.source("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
                F.col("s_suppkey").alias("l_suppkey"), "n_name"), ["l_suppkey"], [F.col("n_name")])
        supplier = materialize(supplier, "adapted-supplier")
        ranked_by = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
        lines = self.source("lineitem").select("l_orderkey", "l_linenumber", *ranked_by, "l_shipdate")
        kept = lines
        for parent, key in ((part, "l_partkey"), (supplier, "l_suppkey")):
            orphans = lines.filter(F.col(key).isNotNull()).select(key).distinct().join(parent.select(key), key, "left_anti")
            kept = kept.filter(F.col(key).isNotNull()).join(materialize(orphans, "adapted-orphans"), key, "left_anti")
        # Numbers of one parcel id are one pair of keys; where either is missing the id is, and such rows are one group.
        known = F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
        kept = kept.select("*", *[F.when(known, F.col(c)).alias(f"_{c}") for c in ("l_orderkey", "l_linenumber")])
        first = pick_first(kept, ["_l_orderkey", "_l_linenumber"], [F.col("l_shipdate").desc(), *[F.col(c) for c in ranked_by]])
        joined = first.drop("l_tax", "_l_orderkey", "_l_linenumber").join(supplier, "l_suppkey").join(part, "l_partkey")
        # The template's own expressions, so that both give the same rows.
        columns = PARCELS_STAGING[:PARCELS_STAGING.index("l_orderkey, l_linenumber, l_partkey")].rstrip().rstrip(",")
        return self.spark.sql(columns + " FROM {joined}", joined=joined).select(*PARCEL_COLUMNS)

    def tables(self) -> LazyTables:
        """The domain tables in their declared shape, without edges."""
        null = lambda kind: F.lit(None).cast(kind)
        return LazyTables({
            "parcels": lambda: self.raw("parcels").withColumns({
                "loan_maturity": F.add_months("last_sale_date", 120), "source": F.lit("overture"),
                "ingested_at": F.col("last_sale_date").cast("timestamp"), "updated_at": null("timestamp")}),
            "roads": lambda: self.raw("roads").select(
                F.concat(F.lit("road_"), "s_suppkey").alias("road_key"), "road_name", "state",
                F.array(F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")),
                        F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat"))).alias("geom"),
                F.lit("osm").alias("source"), null("timestamp").alias("ingested_at")),
            "entities": lambda: self.raw("entities").drop("p_partkey").withColumns({
                "incorporated_at": null("date"), "registered_agent_name": null("string"),
                "registered_agent_address": null("string"), "lei": null("string"), "sos_filing_url": null("string"),
                "source": F.lit("sos"), "created_at": F.col("updated_on").cast("timestamp"),
                "updated_at": F.col("updated_on").cast("timestamp")}).drop("updated_on"),
            "entity_aliases": lambda: self.raw("entity_aliases"),
            "beneficial_owners": lambda: self.raw("beneficial_owners").withColumns({
                "role": F.lit("Member"), "ownership_pct": null("double")}),
            "contacts": lambda: self.raw("contacts").withColumns({
                "email": null("string"), "phone": null("string"), "source": F.lit("hunter"),
                "enriched_at": null("timestamp"), "expires_at": F.col("expires_on").cast("timestamp")}
            ).drop("expires_on"),
            "query_log": lambda: self.raw("query_log").withColumn("corridor", null("string")),
        })


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")
