"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.operators import checks, contacts, matching, ownership, portfolio, spatial, text_match, upsert
from parcelweave.operators.token_set_join import best_token_set_match
from parcelweave.plans import address_match as AM
from parcelweave.plans import discovery as D
from parcelweave.plans import profiles as P
from parcelweave.plans import resolution as R
from parcelweave.plans import screening as S
from parcelweave.plans.adapters import Adapted, LazyTables, as_of, check_ctes
from parcelweave.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query function of the adapter tables under its own name, with its checking SQL."""
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Adapted.of(spark, sf_dir))
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn
    return add


# Building blocks --------------------------------------------------------------------------------------------

def edges_of(a: Adapted) -> portfolio.GroupedEdges:
    """Exact and alias edges by owner name, kept once per session."""
    if "portfolio_edges" not in a._tables:
        t = a.tables()
        a._tables["portfolio_edges"] = matching.grouped_edges(t["parcels"], t["entities"], t["entity_aliases"])
    return a._tables["portfolio_edges"]


def tables_of(a: Adapted) -> LazyTables:
    """The domain tables, with grouped edges."""
    return a.tables() | {"portfolio_edges": lambda: edges_of(a)}


def requests_of(a: Adapted) -> DataFrame:
    return D.parse_requests(a.raw("corridor_requests"))


def candidates_of(a: Adapted) -> D.GroupedCandidates:
    if "candidates" not in a._tables:
        t = tables_of(a)
        a._tables["candidates"] = D.grouped_candidates(requests_of(a), t["parcels"], t["roads"], t["portfolio_edges"])
    return a._tables["candidates"]


def rounded(name: str, digits: int = 2):
    return F.round(name, digits).alias(name)


def joined(name: str):
    return F.array_join(name, ",").alias(name)


def trgm(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))"
    return f"list_distinct(flatten(list_transform({words}, lambda w: {grams})))"


def words_sql(x: str) -> str:
    return f"list_distinct(string_split(lower({x}), ' '))"


ROUTE_WORDS = ["Route ", "US ", "US Route ", "US Highway ", "Highway ", "US-", "NJ ", "NY "]
_like_route = " OR ".join(f"r.road_name ILIKE '%{w}' || q.number || '%'" for w in ROUTE_WORDS)

# First eccentricity squared of the WGS84 ellipsoid.
_E2 = "0.0066943799901413165"

CTES = f"""
WITH {check_ctes()},
exact_edges AS (
  SELECT e.entity_id, p.parcel_id, CAST(1.0 AS DOUBLE) AS confidence, 'exact' AS method
  FROM parcels p JOIN entities e ON upper(trim(p.owner_name_raw)) = upper(trim(e.canonical_name))),
alias_edges AS (
  SELECT a.entity_id, p.parcel_id, max(a.match_score) AS confidence, 'fuzzy' AS method
  FROM parcels p JOIN entity_aliases a ON upper(trim(p.owner_name_raw)) = upper(trim(a.alias_name)) GROUP BY 1, 2),
edges AS (
  SELECT entity_id, parcel_id, confidence, method FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, parcel_id ORDER BY confidence DESC, turn) AS n
    FROM (SELECT *, 1 AS turn FROM exact_edges UNION ALL SELECT *, 2 AS turn FROM alias_edges)) WHERE n = 1),
summary AS (
  SELECT entity_id, CAST(count(*) AS INTEGER) AS property_count, sum(building_sqft) AS total_sqft,
         string_agg(DISTINCT state, ',' ORDER BY state) AS states_present,
         string_agg(DISTINCT property_type, ',' ORDER BY property_type) AS property_types
  FROM edges JOIN parcels USING (parcel_id) GROUP BY entity_id),
live AS (SELECT * FROM contacts WHERE expires_on > DATE '2024-01-31'),
scaled AS (
  SELECT parcel_id, lat, lon, w2 AS w2,
         radians(6378137.0 * (1 - {_E2}) / (w2 * sqrt(w2))) AS my,
         radians(6378137.0 / sqrt(w2) * cos(radians(lat))) AS mx
  FROM (SELECT *, 1 - {_E2} * sin(radians(lat)) * sin(radians(lat)) AS w2 FROM parcels)),
offsets AS (
  SELECT p.parcel_id, r.road_name, r.state, (lon1 - lon) * mx AS x1, (lat1 - lat) * my AS y1,
         (lon2 - lon1) * mx AS dx, (lat2 - lat1) * my AS dy
  FROM scaled p CROSS JOIN roads r),
near AS (
  SELECT DISTINCT parcel_id, road_name, state
  FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0
                  THEN greatest(0.0, least(1.0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t
        FROM offsets)
  WHERE (x1 + t * dx) * (x1 + t * dx) + (y1 + t * dy) * (y1 + t * dy) <= 160000.0),
asked AS (
  SELECT *, regexp_extract(road, '\\b(\\d+[A-Za-z]?)\\b', 1) AS number FROM corridor_requests),
road_matches AS (
  SELECT DISTINCT q.request_id, r.road_name, r.state FROM asked q
  JOIN (SELECT DISTINCT road_name, state FROM roads) r ON r.state = q.road_state
   AND (list_has_all({words_sql('r.road_name')}, {words_sql('q.road')})
        OR (q.number <> '' AND ({_like_route})))),
candidates AS (
  SELECT DISTINCT q.request_id, e.entity_id, p.parcel_id, e.confidence,
         coalesce(p.lot_size_acres, 0) AS lot
  FROM asked q JOIN road_matches m USING (request_id) JOIN near n ON n.road_name = m.road_name AND n.state = m.state
  JOIN parcels p USING (parcel_id) JOIN edges e USING (parcel_id)
  WHERE upper(p.property_type) = upper(q.property_type)
    AND (p.lot_size_acres IS NULL OR p.lot_size_acres >= q.lot_size_min_acres)
    AND (q.lot_size_max_acres IS NULL OR p.lot_size_acres <= q.lot_size_max_acres)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, entity_id ORDER BY lot DESC, parcel_id) AS parcel_rank
  FROM candidates),
per_owner AS (
  SELECT request_id, entity_id, count(*) AS n_parcels, max(confidence) AS confidence,
         max(CASE WHEN parcel_rank = 1 THEN lot END) AS top_lot,
         max(CASE WHEN parcel_rank = 1 THEN parcel_id END) AS top_parcel
  FROM ordered GROUP BY 1, 2),
owner_ranks AS (
  SELECT * FROM (
    SELECT o.*, max_results, CAST(row_number() OVER (
             PARTITION BY request_id ORDER BY top_lot DESC, top_parcel, entity_id) AS INTEGER) AS owner_rank
    FROM per_owner o JOIN asked USING (request_id))
  WHERE owner_rank <= 15 AND owner_rank <= max_results),
counts AS (
  SELECT request_id, CAST(sum(n_parcels) AS BIGINT) AS matched_parcels, count(*) AS total_owners
  FROM per_owner GROUP BY 1)
"""


def check_sql() -> dict[str, str]:
    return {name: sql if sql.lstrip().upper().startswith("WITH") else CTES + sql for name, sql in CHECKS.items()}


# Edges and portfolio ----------------------------------------------------------------------------------------

@register("""SELECT entity_id, property_count, round(total_sqft, 2) AS total_sqft, states_present, property_types
             FROM summary""")
def portfolio_summary(a):
    return portfolio.portfolio_summary(edges_of(a), a.tables()["parcels"]).select(
        "entity_id", "property_count", rounded("total_sqft"), joined("states_present"), joined("property_types"))


@register("SELECT entity_id, parcel_id, confidence, method FROM exact_edges")
def exact_edges(a):
    t = a.tables()
    return matching.exact_edges(t["parcels"], t["entities"])


@register("SELECT entity_id, parcel_id, confidence, method FROM alias_edges")
def alias_edges(a):
    t = a.tables()
    return matching.alias_edges(t["parcels"], t["entity_aliases"])


@register("SELECT entity_id, parcel_id, confidence, method FROM edges")
def portfolio_recompute(a):
    t = a.tables()
    return R.recompute_edges(t["parcels"], t["entities"], t["entity_aliases"])


@register("""SELECT entity_id, parcel_id, CAST(1.0 AS DOUBLE) AS confidence,
                    CASE WHEN length(parcel_id) % 2 = 0 THEN 'graph' ELSE 'exact' END AS method FROM exact_edges""")
def merge_edges(a):
    new = matching.grouped_edges(a.tables()["parcels"], a.tables()["entities"])
    old = new.split("even", F.length("parcel_id") % 2 == 0)
    old.owners = old.owners.withColumns({
        "confidence": F.when(F.col("even"), 1.0).otherwise(0.8), "method": F.lit("graph")}).drop("even")
    return upsert.merge_edges(old, new).flat()


@register("""SELECT parcel_id, state, city, entity_id, canonical_name AS owner_name, confidence
             FROM parcels LEFT JOIN edges USING (parcel_id) LEFT JOIN entities USING (entity_id)""")
def parcels_with_owner(a):
    t = tables_of(a)
    return portfolio.parcels_with_owner(
        t["parcels"].select("parcel_id", "state", "city"), t["portfolio_edges"], t["entities"])


@register("""SELECT entity_id, parcel_id, address, last_sale_price
             FROM edges JOIN parcels USING (parcel_id) WHERE entity_id IN (SELECT entity_id FROM live)""")
def portfolio_for_entities(a):
    t = tables_of(a)
    ids = portfolio.live_contacts(t["contacts"], as_of())
    return portfolio.owned_parcels(portfolio.for_entities(t["portfolio_edges"], ids), t["parcels"]).select(
        "entity_id", "parcel_id", "address", "last_sale_price")


@register("""SELECT 'roads' AS metric, count(*) AS n FROM roads
             UNION ALL SELECT 'parcels', count(*) FROM parcels
             UNION ALL SELECT 'parcels_with_owner', count(owner_name_raw) FROM parcels
             UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'edges', count(*) FROM edges
             UNION ALL SELECT 'edges_' || method, count(*) FROM edges GROUP BY method""")
def coverage_counts(a):
    return portfolio.coverage_counts(tables_of(a))


# Corridor discovery -----------------------------------------------------------------------------------------

@register("SELECT DISTINCT parcel_id FROM near")
def parcels_near_roads(a):
    t = a.tables()
    return spatial.within_distance(
        t["parcels"].select("parcel_id", "lat", "lon"), spatial.explode_segments(t["roads"])).select("parcel_id")


@register("SELECT DISTINCT q.road, q.road_state, m.road_name, m.state FROM asked q JOIN road_matches m USING (request_id)")
def corridor_roads(a):
    return D.match_roads(requests_of(a), a.tables()["roads"])


@register("SELECT request_id, entity_id, parcel_id, confidence, lot FROM candidates")
def corridor_parcels(a):
    t = tables_of(a)
    return D.corridor_candidates(requests_of(a), t["parcels"], t["roads"], t["portfolio_edges"])


@register("SELECT request_id, owner_rank, entity_id, confidence, n_parcels FROM owner_ranks")
def corridor_owners(a):
    return D.rank_owners(candidates_of(a), requests_of(a))[0]


@register("""SELECT o.request_id, o.entity_id, CAST(o.parcel_rank AS INTEGER) AS parcel_rank, o.parcel_id
             FROM ordered o JOIN owner_ranks USING (request_id, entity_id) WHERE o.parcel_rank <= 3""")
def corridor_top_parcels(a):
    owners, _ = D.rank_owners(candidates_of(a), requests_of(a))
    return D.top_parcels(candidates_of(a), owners)


@register("""SELECT request_id, entity_id, parcel_id FROM (
               SELECT c.*, max_results, row_number() OVER (
                 PARTITION BY request_id ORDER BY lot DESC, parcel_id, entity_id) AS n
               FROM candidates c JOIN asked USING (request_id))
             WHERE n <= least(500, greatest(100, 15 * max_results))""")
def corridor_capped(a):
    return D.capped(candidates_of(a), requests_of(a)).select("request_id", "entity_id", "parcel_id")


def _discovered(a):
    if "discovered" not in a._tables:
        a._tables["discovered"] = materialize(
            D.discover(a.raw("corridor_requests"), tables_of(a), as_of()), "adapted-discovered")
    return a._tables["discovered"]


_LISTED = """
, listed AS (
  SELECT request_id, entity_id, string_agg(parcel_id, ',' ORDER BY parcel_rank) AS parcels
  FROM ordered WHERE parcel_rank <= 3 GROUP BY 1, 2)
SELECT request_id, owner_rank, e.canonical_name AS owner_name, entity_id, e.entity_type,
       o.confidence AS entity_resolution_confidence, o.confidence < 0.85 AS resolution_required, s.property_count,
       round(s.total_sqft, 2) AS total_sqft, s.states_present, s.property_types, l.name AS contact_name,
       l.confidence AS contact_confidence,
       CASE WHEN l.entity_id IS NULL THEN 'pending' ELSE 'available' END AS contact_status, parcels,
       CASE WHEN DATE '2024-01-31' - e.updated_on > 1 THEN 'stale' ELSE 'fresh' END AS data_freshness,
       CAST((DATE '2024-01-31' - e.updated_on) * 86400 AS BIGINT) AS freshness_secs
FROM owner_ranks o JOIN entities e USING (entity_id) JOIN summary s USING (entity_id)
JOIN listed USING (request_id, entity_id) LEFT JOIN live l USING (entity_id)
"""


@register(CTES + _LISTED)
def discovery(a):
    results = D.discover(a.raw("corridor_requests"), tables_of(a), as_of())
    return results.select("request_id", F.posexplode("owners").alias("pos", "o")).select(
        "request_id", (F.col("pos") + 1).alias("owner_rank"), "o.owner_name", "o.entity_id", "o.entity_type",
        "o.entity_resolution_confidence", "o.resolution_required", "o.portfolio_summary.property_count",
        F.round("o.portfolio_summary.total_sqft", 2).alias("total_sqft"),
        F.array_join("o.portfolio_summary.states_present", ",").alias("states_present"),
        F.array_join("o.portfolio_summary.property_types", ",").alias("property_types"),
        F.col("o.contact.name").alias("contact_name"), F.col("o.contact.confidence").alias("contact_confidence"),
        "o.contact_status",
        F.array_join(F.transform("o.properties_in_corridor", lambda p: p["parcel_id"]), ",").alias("parcels"),
        "o.data_freshness", "o.freshness_secs")


_NEAREST = f"""
, names AS (SELECT DISTINCT road_name, state, {trgm('road_name')} AS g FROM roads),
texts AS (SELECT DISTINCT road, road_state, {trgm('road')} AS g FROM {{asked}}),
scored AS (
  SELECT road, road_state, road_name,
         CAST(CAST(CAST(len(list_intersect(t.g, n.g)) AS DOUBLE)
              / (len(t.g) + len(n.g) - len(list_intersect(t.g, n.g))) AS FLOAT) AS DOUBLE) AS sim
  FROM texts t JOIN names n ON n.state = t.road_state),
nearest AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY road, road_state ORDER BY sim DESC, road_name) AS INTEGER) AS rank FROM scored) WHERE rank <= 5)
"""


@register(CTES + _NEAREST.format(asked="asked") + """
SELECT request_id, CASE WHEN c.request_id IS NULL THEN 'empty' ELSE 'ok' END AS status,
       coalesce(matched_parcels, 0) AS matched_parcels, coalesce(total_owners, 0) AS total_owners,
       least(coalesce(total_owners, 0), 15, max_results) AS unique_owners,
       CASE WHEN c.request_id IS NULL THEN names END AS closest_corridors
FROM asked LEFT JOIN counts c USING (request_id)
LEFT JOIN (SELECT road, road_state, string_agg(road_name, ',' ORDER BY rank) AS names FROM nearest GROUP BY 1, 2)
  USING (road, road_state)""")
def discovery_summary(a):
    return _discovered(a).select(
        "request_id", "status", *[f"query_summary.{c}" for c in ("matched_parcels", "total_owners", "unique_owners")],
        F.array_join("query_summary.closest_corridors", ",").alias("closest_corridors"))


_ROAD_QUESTIONS = """(SELECT p_partkey, p_name || ' Rd' AS road,
  CASE p_partkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'NJ' ELSE 'PA' END AS road_state FROM part)"""


@register(CTES + _NEAREST.format(asked=_ROAD_QUESTIONS) + f"""
SELECT 'q_' || p_partkey AS request_id, rank, road_name, round(sim, 6) AS sim
FROM {_ROAD_QUESTIONS} JOIN nearest USING (road, road_state)""")
def closest_roads(a):
    key = F.col("p_partkey") % 3
    asked = a.source("part").select(
        F.concat(F.lit("q_"), "p_partkey").alias("request_id"), F.concat("p_name", F.lit(" Rd")).alias("road"),
        F.when(key == 0, "NY").when(key == 1, "NJ").otherwise("PA").alias("road_state"))
    return D.closest_roads(asked, a.tables()["roads"]).select("request_id", "rank", "road_name", rounded("sim", 6))


@register("""SELECT request_id, entity_id, CAST(row_number() OVER (
               PARTITION BY request_id ORDER BY round(total_sqft, 2) DESC, entity_id) AS INTEGER) AS size_rank, property_count
             FROM owner_ranks JOIN summary USING (entity_id) WHERE property_count > 10""")
def screen_owners(a):
    return S.screen_owners(_discovered(a), min_properties=10).select(
        "request_id", "entity_id", "size_rank", "property_count")


@register("""SELECT DISTINCT request_id, entity_id FROM ordered JOIN owner_ranks USING (request_id, entity_id)
             JOIN parcels USING (parcel_id)
             WHERE ordered.parcel_rank <= 3 AND last_sale_date + INTERVAL 120 MONTH < TIMESTAMP '2010-01-01'""")
def loans_due(a):
    return S.screen_owners(_discovered(a), loan_before=F.lit("2010-01-01")).select("request_id", "entity_id")


@register("""SELECT request_id, corridor, coalesce(matched_parcels, 0) AS matched_parcels,
                    coalesce(total_owners, 0) AS total_owners, round(owners_total_sqft, 2) AS owners_total_sqft
             FROM asked LEFT JOIN counts USING (request_id)
             LEFT JOIN (SELECT request_id, sum(total_sqft) AS owners_total_sqft
                        FROM owner_ranks JOIN summary USING (entity_id) GROUP BY 1) USING (request_id)""")
def compare_corridors(a):
    return S.compare_corridors(_discovered(a)).select(
        "request_id", "corridor", "matched_parcels", "total_owners", rounded("owners_total_sqft"))


# Resolution -------------------------------------------------------------------------------------------------

_BEST = f"""
, named AS (SELECT DISTINCT owner_name_raw AS name FROM parcels WHERE owner_name_raw IS NOT NULL),
name_sets AS (SELECT upper(name) AS uname, {trgm('any_value(name)')} AS g FROM named GROUP BY 1),
entity_sets AS (SELECT upper(canonical_name) AS cname, min(entity_id) AS entity_id,
                       {trgm('any_value(canonical_name)')} AS g FROM entities GROUP BY 1),
name_grams AS (SELECT uname, len(g) AS n, unnest(g) AS t FROM name_sets),
entity_grams AS (SELECT entity_id, len(g) AS n, unnest(g) AS t FROM entity_sets),
shared AS (SELECT uname, entity_id, a.n AS na, b.n AS nb, count(*) AS i
           FROM name_grams a JOIN entity_grams b USING (t) GROUP BY ALL),
scored AS (SELECT uname, entity_id,
                  CAST(CAST(CAST(i AS DOUBLE) / (na + nb - i) AS FLOAT) AS DOUBLE) AS sim FROM shared),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uname ORDER BY sim DESC, entity_id) AS k
                        FROM scored WHERE sim >= 0.70) WHERE k = 1)
"""


@register(CTES + _BEST + """SELECT name, entity_id, round(sim, 6) AS match_score
                            FROM named JOIN best ON uname = upper(name)""")
def best_trigram_match(a):
    t = a.tables()
    names = t["parcels"].filter("owner_name_raw is not null").select(F.col("owner_name_raw").alias("name"))
    return matching.best_trigram_match(names, t["entities"]).select("name", "entity_id", rounded("match_score", 6))


@register(CTES + _BEST + """
SELECT entity_id, name AS alias_name, round(sim, 6) AS match_score, 'trgm' AS source
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, upper(name) ORDER BY name) AS once
      FROM named JOIN best ON uname = upper(name)
      WHERE NOT EXISTS (SELECT 1 FROM entity_aliases WHERE upper(alias_name) = upper(name)))
WHERE once = 1""")
def resolve_names(a):
    t = a.tables()
    return R.resolve_names(t["parcels"], t["entities"], t["entity_aliases"]).select(
        "entity_id", "alias_name", rounded("match_score", 6), "source")


def _word_key(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')))"


# Token-set score: the shared words against each side with them in front, and both sides against each other, in percent
# of insert-and-delete similarity. Whole texts are compared only where the counts of each letter allow the score; their
# longest common subsequence is then folded row by row over the letters of the left text.
_TOKEN_SET = f"""
, raw_names AS (SELECT DISTINCT owner_name_raw AS name FROM parcels WHERE owner_name_raw IS NOT NULL
                AND owner_name_raw NOT IN (SELECT alias_name FROM entity_aliases)),
name_keys AS (SELECT name, w, array_to_string(w, ' ') AS k FROM (SELECT name, {_word_key('name')} AS w FROM raw_names)),
owner_keys AS (SELECT w, array_to_string(w, ' ') AS k, min(entity_id) AS entity_id FROM (
    SELECT entity_id, {_word_key('canonical_name')} AS w FROM entities) GROUP BY w),
letters AS (SELECT string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', '') AS all_letters),
left_keys AS (SELECT *, length(k) AS n, list_transform(all_letters, lambda c: n - length(replace(k, c, ''))) AS counts
              FROM (SELECT DISTINCT w, k FROM name_keys WHERE k <> ''), letters),
right_keys AS (SELECT *, length(k) AS n, list_transform(all_letters, lambda c: n - length(replace(k, c, ''))) AS counts
               FROM (SELECT * FROM owner_keys WHERE k <> ''), letters),
pairs AS (
  SELECT l.k AS lk, r.entity_id, l.w AS lw, r.w AS rw, l.n AS ln, r.n AS rn, list_sort(list_intersect(l.w, r.w)) AS shared,
         2 * least(l.n, r.n) >= 0.895 * (l.n + r.n) AND 2 * list_sum(list_transform(range(1, 38), lambda i:
           least(l.counts[i], r.counts[i]))) >= 0.895 * (l.n + r.n) AS near
  FROM left_keys l CROSS JOIN right_keys r),
spelled AS (
  SELECT lk, entity_id, ln, rn, near, array_to_string(shared, ' ') AS s, length(array_to_string(shared, ' ')) AS sn,
         trim(array_to_string(list_concat(shared, list_filter(lw, lambda x: NOT list_contains(shared, x))), ' ')) AS a,
         trim(array_to_string(list_concat(shared, list_filter(rw, lambda x: NOT list_contains(shared, x))), ' ')) AS b
  FROM pairs WHERE near OR (len(shared) > 0 AND 2.21 * length(array_to_string(shared, ' ')) >= 1.78 * least(ln, rn))),
common AS (
  SELECT a, b, list_last(list_reduce(
      list_prepend(list_transform(range(length(b) + 1), lambda i: 0::BIGINT),
        list_transform(string_split(a, ''), lambda c: list_prepend(0::BIGINT,
          list_transform(string_split(b, ''), lambda d: (CASE WHEN c = d THEN 1 ELSE 0 END)::BIGINT)))),
      lambda above, hit: list_reduce(
        list_prepend([0::BIGINT], list_transform(range(2, length(b) + 2), lambda j: [greatest(above[j], above[j - 1] + hit[j])])),
        lambda done, x: list_append(done, greatest(x[1], list_last(done)))))) AS n
  FROM (SELECT DISTINCT a, b FROM spelled WHERE near)),
scored AS (
  SELECT lk, entity_id, greatest(
      CASE WHEN sn = 0 THEN 0 ELSE floor(200 * sn / (sn + least(ln, rn))::DOUBLE + 0.5) END,
      coalesce(floor(200 * n / (ln + rn)::DOUBLE + 0.5), 0)) AS score
  FROM spelled LEFT JOIN common USING (a, b)),
chosen AS (SELECT lk, entity_id, score, row_number() OVER (PARTITION BY lk ORDER BY score DESC, entity_id) AS n
           FROM scored WHERE score >= 90)
SELECT name, entity_id, CAST(score / 100 AS DOUBLE) AS match_score
FROM name_keys JOIN chosen ON lk = k WHERE n = 1
"""


@register(CTES + _TOKEN_SET)
def best_token_set(a):
    t = a.tables()
    names = matching.unmatched_names(t["parcels"], t["entity_aliases"], case_insensitive=False)
    return best_token_set_match(names, t["entities"])


@register("""SELECT DISTINCT owner_name_raw AS name FROM parcels WHERE owner_name_raw IS NOT NULL
             AND NOT EXISTS (SELECT 1 FROM entity_aliases WHERE upper(alias_name) = upper(owner_name_raw))""")
def unmatched_names(a):
    t = a.tables()
    return matching.unmatched_names(t["parcels"], t["entity_aliases"])


@register("""SELECT DISTINCT owner_name_raw AS name FROM parcels WHERE owner_name_raw IS NOT NULL
             AND owner_name_raw NOT IN (SELECT alias_name FROM entity_aliases)""")
def unmatched_names_case_sensitive(a):
    t = a.tables()
    return matching.unmatched_names(t["parcels"], t["entity_aliases"], case_insensitive=False)


@register("""SELECT a.entity_id, upper(a.alias_name) AS alias_name FROM (
               SELECT entity_id, upper(canonical_name) AS alias_name FROM entities
               UNION SELECT entity_id, upper(alias_name) FROM entity_aliases) a
             WHERE NOT EXISTS (SELECT 1 FROM entity_aliases k
                               WHERE k.entity_id = a.entity_id AND upper(k.alias_name) = a.alias_name)""")
def append_new_aliases(a):
    t = a.tables()
    new = t["entities"].select("entity_id", F.col("canonical_name").alias("alias_name")).unionByName(
        t["entity_aliases"].select("entity_id", "alias_name"))
    return upsert.append_new(t["entity_aliases"], new, ["entity_id", "alias_name"], {"alias_name": F.upper}).select(
        "entity_id", F.upper("alias_name").alias("alias_name"))


_WORD_ROWS = """
, name_words AS (SELECT DISTINCT p_name, unnest(string_split(lower(p_name), ' ')) AS word FROM part),
n_words AS (SELECT p_name, count(*) AS n FROM name_words GROUP BY 1),
entity_words AS (SELECT DISTINCT canonical_name, unnest(string_split(lower(canonical_name), ' ')) AS word FROM entities)
"""


@register(CTES + _WORD_ROWS + """
SELECT p_name AS query, canonical_name AS doc FROM name_words JOIN n_words USING (p_name) JOIN entity_words USING (word)
GROUP BY p_name, canonical_name, n HAVING count(*) = n""")
def names_by_words(a):
    queries = a.source("part").select(F.col("p_name").alias("query")).distinct()
    docs = a.tables()["entities"].select(F.col("canonical_name").alias("doc")).distinct()
    return text_match.text_match(queries, docs)


_SEARCHED = f"""
, searches AS (SELECT DISTINCT p_name AS name, CASE p_size % 2 WHEN 0 THEN 'NY' ELSE '' END AS state FROM part),
search_grams AS (SELECT name, {trgm('name')} AS g FROM (SELECT DISTINCT name FROM searches)),
target_grams AS (SELECT canonical_name, {trgm('canonical_name')} AS g FROM (SELECT DISTINCT canonical_name FROM entities)),
pairs AS (
  SELECT name, canonical_name, CAST(CAST(CAST(i AS DOUBLE) / (na + nb - i) AS FLOAT) AS DOUBLE) AS sim, all_words
  FROM (SELECT s.name, e.canonical_name, len(list_intersect(s.g, e.g)) AS i, len(s.g) AS na, len(e.g) AS nb,
               list_has_all({words_sql('e.canonical_name')}, {words_sql('s.name')}) AS all_words
        FROM search_grams s CROSS JOIN target_grams e))
SELECT name || '/' || state AS request_id, rank, entity_id, round(sim, 6) AS sim FROM (
  SELECT s.name, s.state, entity_id, sim, CAST(row_number() OVER (
           PARTITION BY s.name, s.state ORDER BY sim DESC, entity_id) AS INTEGER) AS rank
  FROM searches s JOIN pairs USING (name) JOIN entities e USING (canonical_name)
  WHERE (s.state = '' OR e.jurisdiction = 'US-' || s.state) AND (sim >= 0.3 OR all_words))
"""


@register(CTES + _SEARCHED)
def find_entities(a):
    searches = a.source("part").select(
        F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "NY").otherwise("").alias("state")).distinct()
    searches = searches.withColumn("request_id", F.concat_ws("/", "name", "state"))
    return S.find_entities(searches, a.tables()["entities"]).select(
        "request_id", "rank", "entity_id", rounded("sim", 6))


# Address match ----------------------------------------------------------------------------------------------

_ADDRESS = f"""
, places AS (SELECT DISTINCT address, {trgm('address')} AS g, {words_sql('address')} AS w FROM parcels),
streets AS (SELECT DISTINCT street, {trgm('street')} AS g, {words_sql('street')} AS w FROM address_requests),
by_words AS (
  SELECT s.street, p.address FROM streets s JOIN places p ON p.w[1] = s.w[1] OR len(s.w) = 1
  WHERE list_has_all(p.w, s.w)),
missed AS (SELECT * FROM streets WHERE street NOT IN (SELECT street FROM by_words)),
place_grams AS (SELECT address, len(g) AS n, unnest(g) AS t FROM places),
missed_grams AS (SELECT street, len(g) AS n, unnest(g) AS t FROM missed),
by_grams AS (
  SELECT street, address, CAST(CAST(CAST(count(*) AS DOUBLE) / (m.n + p.n - count(*)) AS FLOAT) AS DOUBLE) AS sim
  FROM missed_grams m JOIN place_grams p USING (t) GROUP BY street, address, m.n, p.n),
matches AS (
  SELECT street, address,
         CAST(CAST(CAST(len(list_intersect(s.g, p.g)) AS DOUBLE)
              / (len(s.g) + len(p.g) - len(list_intersect(s.g, p.g))) AS FLOAT) AS DOUBLE) AS sim
  FROM by_words JOIN streets s USING (street) JOIN places p USING (address)
  UNION ALL SELECT street, address, sim FROM by_grams WHERE sim >= 0.3),
asked_pairs AS (SELECT DISTINCT street, asked_city FROM address_requests),
rows5 AS (
  SELECT * FROM (
    SELECT q.street, q.asked_city, m.sim, p.parcel_id, p.address, p.city, p.state, e.entity_id, n.canonical_name,
           p.owner_name_raw, row_number() OVER (PARTITION BY q.street, q.asked_city ORDER BY
             CASE WHEN q.asked_city <> '' AND p.city ILIKE '%' || q.asked_city || '%' THEN 1 ELSE 0 END DESC,
             m.sim DESC, e.confidence DESC NULLS LAST, p.parcel_id, e.entity_id) AS rank
    FROM asked_pairs q JOIN matches m USING (street) JOIN parcels p USING (address)
    LEFT JOIN edges e USING (parcel_id) LEFT JOIN entities n ON n.entity_id = e.entity_id) WHERE rank <= 5),
places5 AS (SELECT street, asked_city, CAST(count(DISTINCT (address, city, state)) AS INTEGER) AS n_places
            FROM rows5 GROUP BY 1, 2),
chosen AS (
  SELECT * FROM (
    SELECT r.*, n_places, row_number() OVER (PARTITION BY r.street, r.asked_city ORDER BY
             CASE WHEN n_places > 1 AND entity_id IS NULL THEN 1 ELSE 0 END, rank) AS pick
    FROM rows5 r JOIN places5 USING (street, asked_city)) WHERE pick = 1)
"""


@register(CTES + _ADDRESS + """
SELECT request_id, CASE WHEN parcel_id IS NULL THEN 'not_found' ELSE 'found' END AS status, parcel_id, address, city,
       coalesce(canonical_name, owner_name_raw) AS owner_name, entity_id, 'fresh' AS data_freshness,
       CAST(0 AS BIGINT) AS freshness_secs, coalesce(n_places, 0) AS n_distinct_addresses
FROM (SELECT request_id, street, asked_city FROM address_requests) LEFT JOIN chosen USING (street, asked_city)""")
def address_match(a):
    return AM.match_addresses(a.raw("address_requests"), tables_of(a), as_of()).select(
        "request_id", "status", "parcel.parcel_id", "parcel.address", "parcel.city", "owner_name", "entity_id",
        "data_freshness", "freshness_secs", "n_distinct_addresses")


@register(CTES + _ADDRESS + """SELECT street, asked_city, CAST(rank AS INTEGER) AS rank, parcel_id, entity_id,
                                      round(sim, 6) AS sim FROM rows5""")
def address_top_rows(a):
    return AM.ranked_matches(AM.parse_addresses(a.raw("address_requests")), tables_of(a)).select(
        "street", "asked_city", "rank", "parcel_id", "entity_id", rounded("sim", 6))


@register("SELECT request_id, street, asked_city FROM address_requests")
def address_split(a):
    return AM.parse_addresses(a.raw("address_requests"))


# Profiles ---------------------------------------------------------------------------------------------------

_PROFILE = """
, ids AS (SELECT entity_id FROM entities UNION SELECT 'sos_ny_c' || c_custkey FROM customer),
bo AS (SELECT entity_id, count(*) AS n FROM beneficial_owners GROUP BY 1)
SELECT i.entity_id, coalesce(e.canonical_name, 'Unknown Entity') AS canonical_name,
       coalesce(e.entity_type, 'Unknown') AS entity_type, coalesce(e.jurisdiction, 'Unknown') AS jurisdiction,
       coalesce(e.status, 'unknown') AS status,
       CASE WHEN e.entity_id IS NULL THEN 0 ELSE coalesce(bo.n, 0) END AS n_beneficial_owners,
       l.name AS contact_name,
       CASE WHEN e.entity_id IS NULL THEN 'not_available' WHEN l.entity_id IS NULL THEN 'pending'
            ELSE 'available' END AS contact_status,
       coalesce(s.property_count, 0) AS property_count, round(s.total_sqft, 2) AS total_sqft,
       coalesce(s.states_present, '') AS states_present, coalesce(s.property_types, '') AS property_types,
       CASE WHEN e.entity_id IS NULL THEN 'not_found' ELSE 'sos' END AS source,
       CASE WHEN e.entity_id IS NULL OR DATE '2024-01-31' - e.updated_on > 1 THEN 'stale' ELSE 'fresh' END
         AS data_freshness,
       CAST(coalesce(DATE '2024-01-31' - e.updated_on, 0) * 86400 AS BIGINT) AS freshness_secs,
       CAST(CASE WHEN e.entity_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence
FROM ids i LEFT JOIN entities e USING (entity_id) LEFT JOIN summary s USING (entity_id)
LEFT JOIN live l ON l.entity_id = e.entity_id LEFT JOIN bo ON bo.entity_id = e.entity_id
"""


@register(CTES + _PROFILE)
def owner_profile(a):
    t = tables_of(a)
    ids = t["entities"].select("entity_id").unionByName(
        a.source("customer").select(F.concat(F.lit("sos_ny_c"), "c_custkey").alias("entity_id")))
    return P.profiles(ids, t, as_of()).select(
        "entity_id", "canonical_name", "entity_type", "jurisdiction", "status", "n_beneficial_owners",
        F.col("contact.name").alias("contact_name"),
        "contact_status", "portfolio_summary.property_count",
        F.round("portfolio_summary.total_sqft", 2).alias("total_sqft"),
        F.array_join("portfolio_summary.states_present", ",").alias("states_present"),
        F.array_join("portfolio_summary.property_types", ",").alias("property_types"),
        "source", "data_freshness", "freshness_secs", "confidence")


@register("""SELECT entity_id, owner_name AS name, 'Member' AS role, CAST(NULL AS DOUBLE) AS ownership_pct
             FROM beneficial_owners JOIN entities USING (entity_id)""")
def profile_owners(a):
    t = tables_of(a)
    return P.profile_owners(t["entities"], t)


@register("""SELECT entity_id, parcel_id, address, city, state, zip, lot_size_acres, building_sqft, property_type,
                    last_sale_price, CAST(last_sale_date AS VARCHAR) AS last_sale_date,
                    strftime(last_sale_date + INTERVAL 120 MONTH, '%Y-%m-%d') AS loan_maturity,
                    lat AS latitude, lon AS longitude
             FROM edges JOIN parcels USING (parcel_id)""")
def profile_properties(a):
    t = tables_of(a)
    return P.profile_properties(t["entities"], t).select(
        "entity_id", "parcel_id", "address", "city", "state", "zip", "lot_size_acres", "building_sqft",
        "property_type", "last_sale_price", "last_sale_date", "loan_maturity", "latitude", "longitude")


@register("""SELECT entity_id, CAST((DATE '2024-01-31' - updated_on) * 86400 AS BIGINT) AS freshness_secs,
                    CASE WHEN DATE '2024-01-31' - updated_on > 1 THEN 'stale' ELSE 'fresh' END AS data_freshness
             FROM entities""")
def freshness(a):
    updated = F.col("updated_at")
    return a.tables()["entities"].select(
        "entity_id", N.freshness_secs(updated, as_of()).alias("freshness_secs"),
        N.data_freshness(updated, as_of()).alias("data_freshness"))


# Ownership, contacts, log -----------------------------------------------------------------------------------

@register("""
WITH RECURSIVE {ctes}, chain AS (
  SELECT entity_id, 1 AS depth, owner_name, parent_entity_id, [entity_id] AS path FROM beneficial_owners
  UNION ALL
  SELECT c.entity_id, c.depth + 1, b.owner_name, b.parent_entity_id, list_append(c.path, b.entity_id)
  FROM chain c JOIN beneficial_owners b ON b.entity_id = c.parent_entity_id
  WHERE NOT list_contains(c.path, c.parent_entity_id))
SELECT entity_id, CAST(depth AS INTEGER) AS depth, owner_name, parent_entity_id,
       array_to_string(path, '>') AS path FROM chain""".replace("{ctes}", check_ctes()))
def ownership_chain(a):
    return ownership.ownership_chain(a.raw("beneficial_owners")).withColumn("path", F.array_join("path", ">"))


@register("SELECT entity_id, count(*) AS n_queries FROM query_log GROUP BY 1")
def query_popularity(a):
    return contacts.popularity(a.tables()["query_log"])


@register("""SELECT entity_id, n_queries, canonical_name,
                    regexp_replace(regexp_replace(lower(canonical_name),
                      '\\s*(llc|inc|corp|ltd|trust|holdings|group|partners|capital)\\s*', '', 'g'),
                      '[^a-z0-9]', '', 'g') || '.com' AS domain
             FROM (SELECT entity_id, count(*) AS n_queries FROM query_log GROUP BY 1) JOIN entities USING (entity_id)
             WHERE entity_id NOT IN (SELECT entity_id FROM live)
             ORDER BY n_queries DESC, entity_id LIMIT 500""")
def prewarm_candidates(a):
    t = a.tables()
    return contacts.prewarm_candidates(t["query_log"], t["entities"], t["contacts"], as_of())


def _landed_contacts(a):
    """Vendor answers as JSON text, made from the customers."""
    c, key = a.source("customer"), F.col("c_custkey")
    entity = F.concat(F.lit("sos_ny_"), "c_custkey").alias("entity_id")
    people = F.when(key % 5 == 0, F.array(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title")))
                    ).otherwise(F.array().cast("array<struct<name: string, title: string>>"))
    profile = c.filter(key % 2 == 0).select(entity, F.to_json(F.struct(
        F.concat(F.lit("Company "), "c_custkey").alias("name"), people.alias("people_also_viewed"))).alias("response"))
    # Answers that are no JSON, JSON null, missing or empty give no contact; one list is a text.
    turn = F.substring_index("entity_id", "_", -1).cast("long")
    profile = profile.withColumn("response", F.when(turn % 20 == 2, "{bad").when(turn % 20 == 12, "<html>no</html>").when(
        turn % 20 == 4, F.lit(None)).when(turn % 20 == 14, " ").when(turn % 20 == 6, "null").when(turn % 20 == 16, F.concat(
            F.lit('{"name": "Company '), turn, F.lit('", "people_also_viewed": "none"}'))).otherwise(F.col("response")))
    mail = F.struct(
        F.concat(F.lit("u"), "c_custkey", F.lit("@example.com")).alias("value"), F.lit("personal").alias("type"),
        (key % 101).cast("double").alias("confidence"),
        F.when(key % 7 == 0, " ").otherwise(F.col("c_mktsegment")).alias("first_name"),
        F.when(key % 7 == 0, "").otherwise(F.col("c_custkey").cast("string")).alias("last_name"),
        F.when(key % 11 == 0, "").otherwise("Manager").alias("position"))
    no_mail = F.array().cast("array<struct<value: string, type: string, confidence: double, first_name: string, "
                             "last_name: string, position: string>>")
    emails = c.filter(key % 3 == 0).select(entity, F.to_json(F.struct(F.struct(
        F.when(key % 4 == 0, no_mail).otherwise(F.array(mail)).alias("emails")).alias("data"))).alias("response"))
    emails = emails.withColumn("response", F.when(turn % 30 == 3, "{bad").otherwise(F.col("response")))
    return profile, emails


_FOUND = """
, found AS (
  SELECT entity_id, has_profile, has_email,
         CASE WHEN has_email AND c_custkey % 7 <> 0 THEN c_mktsegment || ' ' || c_custkey
              WHEN has_profile THEN profile_name ELSE canonical_name END AS name,
         CASE WHEN has_email AND c_custkey % 11 <> 0 THEN 'Manager'
              WHEN has_profile THEN CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'Principal' END
              ELSE 'Contact' END AS role,
         CASE WHEN has_email THEN 'u' || c_custkey || '@example.com' END AS email,
         CAST(CASE WHEN has_profile AND has_email THEN greatest(0.75, CAST(c_custkey % 101 AS DOUBLE) / 100)
              WHEN has_profile THEN 0.75 ELSE CAST(c_custkey % 101 AS DOUBLE) / 100 END AS DOUBLE) AS confidence,
         CASE WHEN has_profile AND has_email THEN 'proxycurl+hunter' WHEN has_profile THEN 'proxycurl'
              ELSE 'hunter' END AS source
  FROM (SELECT *, c_custkey % 2 = 0 AND c_custkey % 20 NOT IN (2, 4, 6, 12, 14) AS has_profile,
               c_custkey % 3 = 0 AND c_custkey % 4 <> 0 AND c_custkey % 30 <> 3 AS has_email,
               CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'Company ' || c_custkey END AS profile_name
        FROM customer JOIN entities ON entity_id = 'sos_ny_' || c_custkey)
  WHERE has_profile OR has_email)
"""


@register(CTES + _FOUND + "SELECT entity_id, name, role, email, confidence, source FROM found")
def contact_waterfall(a):
    return R.find_contacts(a.tables()["entities"], *_landed_contacts(a)).drop("phone")


@register(CTES + _FOUND + """
SELECT coalesce(c.entity_id, f.entity_id) AS entity_id, coalesce(f.name, c.name) AS name,
       coalesce(f.role, c.role) AS role, CASE WHEN f.entity_id IS NOT NULL THEN f.email END AS email,
       coalesce(f.confidence, c.confidence) AS confidence, coalesce(f.source, 'hunter') AS source,
       CASE WHEN f.entity_id IS NOT NULL THEN DATE '2024-03-01' ELSE c.expires_on END AS expires_on
FROM contacts c FULL OUTER JOIN found f ON c.entity_id = f.entity_id""")
def upsert_contacts(a):
    t = a.tables()
    found = R.find_contacts(t["entities"], *_landed_contacts(a))
    return upsert.upsert_contacts(t["contacts"], found, as_of()).select(
        "entity_id", "name", "role", "email", "confidence", "source",
        F.col("expires_at").cast("date").alias("expires_on"))


# Upserts of parcels and entities ----------------------------------------------------------------------------

_FRESH = """
, fresh AS (
  SELECT 'p_' || o_orderkey || '_1' AS parcel_id, o_orderkey || ' New Road' AS address, 'Town' AS city, 'NJ' AS state,
         CAST(10000 + o_custkey % 90000 AS VARCHAR) AS zip, CAST(41 AS DOUBLE) AS lat, CAST(-73 AS DOUBLE) AS lon,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 1000 END AS lot_size_acres,
         CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' ELSE 'Hospitality' END AS property_type,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'OWNER ' || o_custkey END AS owner_name_raw,
         o_totalprice AS building_sqft, CAST(o_orderdate AS DATE) AS last_sale_date
  FROM orders)
"""


def _fresh(a):
    o, key = a.source("orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("p_"), "o_orderkey", F.lit("_1")).alias("parcel_id"),
        F.concat("o_orderkey", F.lit(" New Road")).alias("address"), F.lit("Town").alias("city"),
        F.lit("NJ").alias("state"), (10000 + F.col("o_custkey") % 90000).cast("string").alias("zip"),
        F.lit(41.0).alias("lat"), F.lit(-73.0).alias("lon"),
        F.when(key % 3 != 0, F.col("o_totalprice") / 1000).alias("lot_size_acres"),
        F.when(key % 4 == 1, "Unknown").when(key % 4 > 1, "Hospitality").alias("property_type"),
        F.when(key % 5 != 0, F.concat(F.lit("OWNER "), "o_custkey")).alias("owner_name_raw"),
        F.col("o_totalprice").alias("building_sqft"), F.col("o_orderdate").cast("date").alias("last_sale_date"),
        F.lit("overture").alias("source"),
    )


_UPSERT_COLS = ["parcel_id", "address", "city", "state", "zip", "lot_size_acres", "building_sqft", "property_type",
                "last_sale_date", "owner_name_raw", "lat"]


def _upserted(a, policy):
    after = upsert.upsert_parcels(a.tables()["parcels"], _fresh(a), policy, as_of())
    return after.select(*_UPSERT_COLS, (F.col("updated_at") == as_of()).alias("touched"))


def _upsert_sql(how: str, **columns: str) -> str:
    picks = ", ".join(f"{columns.get(c, columns['other']).format(c=c)} AS {c}" for c in _UPSERT_COLS[1:])
    return f"""{CTES}{_FRESH}
SELECT coalesce(n.parcel_id, t.parcel_id) AS parcel_id, {picks},
       CASE WHEN n.parcel_id IS NOT NULL THEN true END AS touched
FROM parcels t {how} JOIN fresh n ON n.parcel_id = t.parcel_id"""


_NEW = "CASE WHEN n.parcel_id IS NOT NULL THEN n.{c} ELSE t.{c} END"
_OLD = "CASE WHEN t.parcel_id IS NULL THEN n.{c} ELSE t.{c} END"
_TYPE = ("CASE WHEN n.property_type <> 'Unknown' THEN n.property_type WHEN t.parcel_id IS NULL THEN 'Unknown' "
         "ELSE t.property_type END")


@register(_upsert_sql("FULL OUTER", other=_NEW, property_type="CASE WHEN n.parcel_id IS NOT NULL "
                      "THEN coalesce(n.property_type, 'Unknown') ELSE t.property_type END"))
def upsert_replace(a):
    return _upserted(a, "replace")


@register(_upsert_sql("FULL OUTER", other=_NEW, lot_size_acres="t.{c}", building_sqft="t.{c}", last_sale_date="t.{c}",
                      owner_name_raw="t.{c}", property_type="coalesce(t.property_type, 'Unknown')"))
def upsert_address(a):
    return _upserted(a, "address")


@register(_upsert_sql("FULL OUTER", other=_OLD, lot_size_acres="coalesce(n.{c}, t.{c})",
                      owner_name_raw="coalesce(n.{c}, t.{c})", property_type=_TYPE))
def upsert_enrich(a):
    return _upserted(a, "enrich")


@register(_upsert_sql("LEFT", other=_OLD, property_type=_TYPE, **{
    c: "coalesce(n.{c}, t.{c})" for c in ("lot_size_acres", "owner_name_raw", "building_sqft", "last_sale_date")}))
def upsert_enrich_update(a):
    return _upserted(a, "enrich_update")


@register("""SELECT coalesce(t.entity_id, n.entity_id) AS entity_id, coalesce(n.name, t.canonical_name) AS canonical_name,
                    coalesce(t.jurisdiction, 'US-IA') AS jurisdiction,
                    CASE WHEN n.entity_id IS NOT NULL THEN 'active' ELSE t.status END AS status,
                    n.entity_id IS NOT NULL OR t.updated_on = DATE '2024-01-31' AS touched
             FROM entities t FULL OUTER JOIN (
               SELECT 'sos_ny_' || c_custkey * 2 AS entity_id, c_name AS name FROM customer) n
             ON n.entity_id = t.entity_id""")
def upsert_entities(a):
    registry = a.source("customer").select(
        F.concat(F.lit("sos_ny_"), F.col("c_custkey") * 2).alias("entity_id"),
        F.col("c_name").alias("canonical_name"), F.lit("LLC").alias("entity_type"),
        F.lit("US-IA").alias("jurisdiction"), F.lit("active").alias("status"),
        F.lit(None).cast("date").alias("incorporated_at"), F.lit(None).cast("string").alias("registered_agent_name"),
        F.lit(None).cast("string").alias("registered_agent_address"),
        F.lit(None).cast("string").alias("sos_filing_url"))
    return upsert.upsert_entities(a.tables()["entities"], registry, as_of()).select(
        "entity_id", "canonical_name", "jurisdiction", "status", (F.col("updated_at") == as_of()).alias("touched"))


@register("""SELECT parcel_id, address, city, state, zip,
                    concat_ws(' ', nullif(city, ''), nullif(state, ''), nullif(zip, '')) AS locality
             FROM parcels WHERE owner_name_raw IS NULL
             ORDER BY last_sale_date DESC, parcel_id LIMIT 500""")
def enrichment_candidates(a):
    return R.enrichment_candidates(a.tables()["parcels"]).drop("ingested_at")


@register("""SELECT check_name AS "check", table_name, column_name, CAST(n_bad AS BIGINT) AS n_bad FROM (
  SELECT 'unique' AS check_name, 'parcels' AS table_name, 'parcel_id' AS column_name,
         count(*) - count(DISTINCT parcel_id) AS n_bad FROM parcels_staging
  UNION ALL SELECT 'unique', 'entities', 'entity_id', count(*) - count(DISTINCT entity_id) FROM entities
  UNION ALL SELECT 'not_null', 'entities', 'entity_id', count(*) - count(entity_id) FROM entities
  UNION ALL SELECT 'not_null', 'entities', 'canonical_name', count(*) - count(canonical_name) FROM entities
  UNION ALL SELECT 'not_null', 'entities', 'entity_type', count(*) - count(entity_type) FROM entities
  UNION ALL SELECT 'not_null', 'parcels', 'parcel_id', count(*) - count(parcel_id) FROM parcels_staging
  UNION ALL SELECT 'not_null', 'parcels', 'address', count(*) - count(address) FROM parcels_staging
  UNION ALL SELECT 'not_null', 'parcels', 'city', count(*) - count(city) FROM parcels_staging
  UNION ALL SELECT 'not_null', 'parcels', 'state', count(*) - count(state) FROM parcels_staging
  UNION ALL SELECT 'not_null', 'parcels', 'zip', count(*) - count(zip) FROM parcels_staging
  UNION ALL SELECT 'not_null', 'parcels', 'property_type', count(*) - count(property_type) FROM parcels_staging
  UNION ALL SELECT 'not_null', 'beneficial_owners', 'entity_id', 0
  UNION ALL SELECT 'not_null', 'beneficial_owners', 'owner_name', count(*) - count(owner_name) FROM beneficial_owners
  UNION ALL SELECT 'foreign_key', 'beneficial_owners', 'entity_id', count(*) FROM beneficial_owners
            WHERE entity_id NOT IN (SELECT entity_id FROM entities)
  UNION ALL SELECT 'foreign_key', 'beneficial_owners', 'parent_entity_id', count(*) FROM beneficial_owners
            WHERE parent_entity_id NOT IN (SELECT entity_id FROM entities)
  UNION ALL SELECT 'allowed_value', 'entities', 'entity_type', count(*) FROM entities
            WHERE entity_type NOT IN ('LLC', 'Trust', 'Corporation', 'Individual', 'Unknown')
  UNION ALL SELECT 'allowed_value', 'entities', 'status', count(*) FROM entities
            WHERE status NOT IN ('active', 'dissolved', 'suspended', 'unknown'))""")
def table_checks(a):
    return checks.check_tables({
        "parcels": a.raw("parcels_staging"), "entities": a.raw("entities"),
        "beneficial_owners": a.raw("beneficial_owners")})


# Faults planted in every constrained table: columns replaced by an expression, and the rows that are there twice.
_FAULTS = {
    "parcels": ({"city": "CASE WHEN length(address) % 3 = 0 THEN NULL ELSE city END"}, "length(address) % 5 = 0"),
    "roads": ({"road_name": "CASE WHEN length(road_name) % 4 = 0 THEN NULL ELSE road_name END"}, "length(road_name) = 7"),
    "entities": ({"entity_type": "CASE WHEN length(entity_id) % 2 = 0 THEN 'Club' ELSE entity_type END",
                  "status": "CASE WHEN length(canonical_name) % 5 = 0 THEN 'lost' ELSE status END"},
                 "length(canonical_name) % 4 = 1"),
    "entity_aliases": ({"match_score": "match_score + 0.1", "entity_id": "CASE WHEN match_score > 0.9 THEN 'gone' ELSE entity_id END"},
                       "match_score < 0.75"),
    "beneficial_owners": ({"owner_name": "CASE WHEN length(entity_id) % 2 = 1 THEN NULL ELSE owner_name END",
                           "parent_entity_id": "CASE WHEN length(entity_id) % 3 = 0 THEN 'gone' ELSE parent_entity_id END"},
                          "parent_entity_id IS NULL"),
    "portfolio_edges": ({"method": "CASE WHEN confidence < 0.8 THEN 'guess' ELSE method END",
                         "parcel_id": "CASE WHEN length(parcel_id) % 2 = 0 THEN 'gone' ELSE parcel_id END"}, "confidence > 0.95"),
    "contacts": ({"confidence": "confidence * 2 - 0.5", "name": "CASE WHEN confidence < 0.1 THEN NULL ELSE name END"},
                 "confidence > 0.9"),
    "query_log": ({"tool_name": "CASE WHEN length(entity_id) % 2 = 0 THEN NULL ELSE tool_name END"}, "length(entity_id) = 8"),
}


def _faulty_sql(table: str) -> str:
    replaced, twice = _FAULTS[table]
    new = ", ".join(f"{e} AS {c}" for c, e in replaced.items())
    own = "edges" if table == "portfolio_edges" else table
    return f"bad_{table} AS (SELECT * REPLACE ({new}) FROM (SELECT * FROM {own} UNION ALL SELECT * FROM {own} WHERE {twice}))"


def _faults_sql() -> str:
    def row(check: str, table: str, column: str, n: str, where: str = "") -> str:
        return (f"SELECT '{check}' AS \"check\", '{table}' AS table_name, '{column}' AS column_name, "
                f"CAST({n} AS BIGINT) AS n_bad FROM bad_{table} {where}")

    keys = {"parcels": "parcel_id", "entities": "entity_id", "portfolio_edges": "entity_id,parcel_id", "contacts": "entity_id"}
    filled = {"parcels": "parcel_id address city state zip property_type", "roads": "road_name state",
              "entities": "entity_id canonical_name entity_type", "entity_aliases": "entity_id alias_name",
              "beneficial_owners": "entity_id owner_name", "portfolio_edges": "entity_id parcel_id confidence method",
              "contacts": "entity_id name", "query_log": "tool_name"}
    links = {"portfolio_edges": ["entity_id", "parcel_id"], "entity_aliases": ["entity_id"],
             "beneficial_owners": ["entity_id", "parent_entity_id"], "contacts": ["entity_id"]}
    allowed = {("entities", "entity_type"): "NOT IN ('LLC', 'Trust', 'Corporation', 'Individual', 'Unknown')",
               ("entities", "status"): "NOT IN ('active', 'dissolved', 'suspended', 'unknown')",
               ("portfolio_edges", "method"): "NOT IN ('exact', 'fuzzy', 'graph')",
               **{(t, c): "NOT BETWEEN 0 AND 1" for t, c in (
                   ("portfolio_edges", "confidence"), ("contacts", "confidence"), ("entity_aliases", "match_score"))}}
    rows = [row("unique", t, k, f"count(*) - count(DISTINCT ({k}))") for t, k in keys.items()]
    rows += [row("not_null", t, c, f"count(*) - count({c})") for t, cs in filled.items() for c in cs.split()]
    rows += [row("foreign_key", t, c, "count(*)", f"WHERE {c} NOT IN (SELECT {'parcel_id FROM bad_parcels' if c == 'parcel_id' else 'entity_id FROM bad_entities'})")
             for t, cs in links.items() for c in cs]
    rows += [row("allowed_value", t, c, "count(*)", f"WHERE {c} {rule}") for (t, c), rule in allowed.items()]
    return CTES + ", " + ",\n".join(map(_faulty_sql, _FAULTS)) + "\n" + "\nUNION ALL ".join(rows)


@register(_faults_sql())
def table_faults(a):
    """The checks over all constrained tables, with planted faults."""
    def faulty(df, replaced, twice):
        if isinstance(df, portfolio.GroupedEdges):  # owners come twice, and so their edges
            own = {c: e for c, e in replaced.items() if c in df.owners.columns}
            members = df.members.withColumns({c: F.expr(e) for c, e in replaced.items() if c not in own})
            return portfolio.GroupedEdges(members, faulty(df.owners, own, twice))
        return df.unionByName(df.where(twice)).withColumns({c: F.expr(e) for c, e in replaced.items()})

    tables = tables_of(a)
    return checks.check_tables({name: faulty(tables[name], *faults) for name, faults in _FAULTS.items()})


@register(CTES + _BEST + """
SELECT entity_id, name AS alias_name, round(sim, 6) AS match_score, 'trgm' AS source
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, upper(name) ORDER BY name) AS once
      FROM (SELECT name FROM named WHERE NOT EXISTS (SELECT 1 FROM entity_aliases WHERE upper(alias_name) = upper(name))
            ORDER BY name LIMIT 500) JOIN best ON uname = upper(name))
WHERE once = 1""")
def resolve_work_set(a):
    """One run's work set: the first 500 names without an alias."""
    t = a.tables()
    return R.resolve_names(t["parcels"], t["entities"], t["entity_aliases"], limit=500).select(
        "entity_id", "alias_name", rounded("match_score", 6), "source")
