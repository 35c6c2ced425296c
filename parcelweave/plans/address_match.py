"""Address match: the parcel and owner behind each of a table of addresses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.functions.text import similarity, trigram_codes
from parcelweave.operators.portfolio import GroupedEdges, grouped_parcels, parcels_with_owner
from parcelweave.operators.set_join import SetIndex
from parcelweave.operators.text_match import TextIndex
from parcelweave.session import materialize

SIMILARITY_THRESHOLD = 0.3
# Similarities at which a search for the five best places stops for those it has settled.
STEPS = (0.7, 0.5, SIMILARITY_THRESHOLD)
TOP_ROWS = 5


def parse_addresses(requests: DataFrame) -> DataFrame:
    address = F.coalesce("address", F.lit("1240 Highway 9, Woodbridge NJ"))
    return requests.select(
        "request_id", N.lookup_street(address).alias("street"), N.lookup_city(address).alias("asked_city"))


def city_hits(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(asked_city, city): the cities whose name holds the asked one, case aside.

    Every substring of a distinct city name is a key, so it is an equi-join; names are short.
    """
    cities = places.select("city").distinct().filter("city is not null")
    starts = F.sequence(F.lit(1), F.length("city"))
    substrings = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.length("city") - i + 1), lambda n: F.substr(F.lower("city"), i, n))))
    keys = cities.filter(F.length("city") > 0).select("city", F.explode(F.array_distinct(substrings)).alias("part"))
    wanted = asked.filter("asked_city <> ''").select("asked_city").distinct()
    return wanted.join(keys, F.lower("asked_city") == F.col("part")).select("asked_city", "city")


def _sets(df: DataFrame, text: str, *group: str) -> DataFrame:
    """Trigram sets of the distinct texts, made once per text."""
    sets = materialize(df.select(F.col(text).alias("id")).distinct().select(
        "id", trigram_codes(F.col("id")).alias("tokens")), "address-sets")
    if not group:
        return sets
    return df.select(F.col(text).alias("id"), F.col(group[0]).alias("grp")).distinct().join(sets, "id")


def _best_places(matches: DataFrame) -> DataFrame:
    """The places that can hold one of the five best rows: rank up to five, ties included."""
    order = Window.partitionBy("street", "asked_city").orderBy(F.col("city_hit").desc(), F.col("sim").desc())
    return matches.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= TOP_ROWS).drop("_rank")


@dataclass
class PlaceIndex:
    """The distinct places of a parcel table with their word and trigram indexes, written once for many requests."""

    places: DataFrame
    cities: DataFrame
    words: TextIndex
    in_city: SetIndex
    anywhere: SetIndex

    @classmethod
    def build(cls, parcels: DataFrame) -> PlaceIndex:
        places = materialize(parcels.filter(F.col("address").isNotNull()).select("address", "city").distinct(), "places")
        sets = _sets(places, "address")
        return cls(
            places, materialize(places.select("city").distinct(), "cities"), TextIndex.build(places.select(F.col("address").alias("doc")).distinct()),
            SetIndex.build(places.filter("city is not null").select(F.col("address").alias("id"), F.col("city").alias("grp")).join(
                sets, "id"), SIMILARITY_THRESHOLD),
            SetIndex.build(sets, SIMILARITY_THRESHOLD))


def match_places(asked: DataFrame, index: PlaceIndex) -> DataFrame:
    """(street, asked_city, address, city, city_hit, sim): for each asked pair the places among its five best.

    Streets matching an address by words use those matches only. The others go by trigram similarity from 0.3 up, places
    in the asked city first, as they rank before all others, then everywhere. Both searches begin with the pairs of high
    similarity and go down in steps; a pair is settled by the first step that gives it five places, since all places it
    has not seen are less similar.
    """
    columns = ["street", "asked_city", "address", "city", "city_hit", "sim"]
    places = index.places
    hits = materialize(city_hits(asked, index.cities).withColumn("city_hit", F.lit(1)), "address-cities")
    by_words = materialize(index.words.match(asked.select(F.col("street").alias("query")).distinct()).toDF(
        "street", "address"), "address-words")

    def at_places(pairs: DataFrame, who: DataFrame) -> DataFrame:
        return (
            pairs.join(who, "street").join(places, "address").join(hits, ["asked_city", "city"], "left")
            .withColumn("city_hit", F.coalesce("city_hit", F.lit(0))).select(columns)
        )

    def settled(matches: DataFrame) -> DataFrame:
        return matches.groupBy("street", "asked_city").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") >= TOP_ROWS).select("street", "asked_city")

    def by_steps(left: DataFrame, step) -> list[DataFrame]:
        """Best places of the pairs that each step settles; the last one holds what there is for the others."""
        done = []
        for threshold in STEPS:
            matches = materialize(_best_places(step(left, threshold)), "address-step")
            if threshold == STEPS[-1]:
                return [*done, matches]
            done.append(matches.join(settled(matches), ["street", "asked_city"], "left_semi"))
            left = materialize(left.join(settled(matches), ["street", "asked_city"], "left_anti"), "address-left")
            if left.isEmpty():
                return done

    found = _best_places(at_places(
        by_words.withColumn("sim", similarity(F.col("address"), F.col("street"))), asked))
    missed = materialize(asked.join(by_words.select("street").distinct(), "street", "left_anti"), "address-missed")
    if missed.isEmpty():
        return found
    wanted = materialize(missed.join(hits, "asked_city").select("street", "asked_city", "city"), "address-wanted")

    def in_city(left: DataFrame, threshold: float) -> DataFrame:
        own = wanted.join(left, ["street", "asked_city"], "left_semi")
        near = index.in_city.pairs(city_probe, threshold, own.select(F.col("street").alias("id"), F.col("city").alias("grp")))
        return near.toDF("city", "street", "address", "sim").join(own, ["street", "city"]).withColumn(
            "city_hit", F.lit(1)).select(columns)

    city_matches = found.limit(0)
    if not wanted.isEmpty():
        city_probe = index.in_city.probe(_sets(wanted, "street", "city"))
        city_matches = materialize(reduce(DataFrame.unionByName, by_steps(
            wanted.select("street", "asked_city").distinct(), in_city)), "address-city")
        found = found.unionByName(city_matches.join(settled(city_matches), ["street", "asked_city"], "left_semi"))
    left = materialize(missed.join(settled(city_matches), ["street", "asked_city"], "left_anti"), "address-left")
    if left.isEmpty():
        return found
    probe = index.anywhere.probe(_sets(left, "street"))

    def anywhere(left: DataFrame, threshold: float) -> DataFrame:
        near = index.anywhere.pairs(probe, threshold, left.select(F.col("street").alias("id"))).toDF("street", "address", "sim")
        # City places are known down to the least similarity and rank first, so only the others are taken from here.
        return at_places(near, left).filter("city_hit = 0").unionByName(
            city_matches.join(left, ["street", "asked_city"], "left_semi"))

    return reduce(DataFrame.unionByName, by_steps(left, anywhere), found)


def _likely_owned(wanted: DataFrame, edges: GroupedEdges) -> tuple[DataFrame, GroupedEdges]:
    """The parcels and edges that can give one of the five best rows of a place: by confidence, parcel and entity.

    A parcel has its best owner's confidence in the order of parcels, and only its five first owners count.
    """
    def first(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(*order)
        return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= TOP_ROWS)

    sure = F.col("confidence").desc_nulls_last()
    owners = materialize(first(edges.owners, ["group_id"], sure, F.col("entity_id")), "address-owners")
    best = owners.filter("_n = 1").select("group_id", "confidence")
    parcels = first(grouped_parcels(wanted, edges).join(best, "group_id", "left"), ["address", "city"], sure, F.col("parcel_id"))
    parcels = materialize(parcels.select(*wanted.columns, "group_id"), "address-parcels")
    return parcels.select(wanted.columns), GroupedEdges(
        parcels.select("group_id", "parcel_id").distinct().join(owners.select("group_id"), "group_id", "left_semi"), owners.drop("_n"))


def ranked_matches(requests: DataFrame, tables: dict[str, DataFrame], index: PlaceIndex | None = None) -> DataFrame:
    """The five best rows per distinct (street, asked_city): city hit, similarity, edge confidence, ids.

    Ranking is done on distinct (address, city) pairs first, keeping ties; only those that can be among the five are
    joined to their parcels and owners.
    """
    asked = requests.select("street", "asked_city").distinct()
    index = index or PlaceIndex.build(tables["parcels"])
    best_places = materialize(match_places(materialize(asked, "address-asked"), index), "address-best")
    same = [F.col("address"), F.col("city")]
    wanted = tables["parcels"].select("parcel_id", "address", "city", "state").alias("p").join(
        best_places.select(*same).distinct().alias("b"),
        (F.col("p.address") == F.col("b.address")) & F.col("p.city").eqNullSafe(F.col("b.city")), "left_semi")
    edges = tables["portfolio_edges"]
    if isinstance(edges, GroupedEdges):
        wanted, edges = _likely_owned(wanted, edges)
    owned = parcels_with_owner(wanted, edges, tables["entities"])
    same_place = (F.col("m.address") == F.col("o.address")) & F.col("m.city").eqNullSafe(F.col("o.city"))
    rows = best_places.alias("m").join(owned.alias("o"), same_place).select(
        "street", "asked_city", "city_hit", "sim", "o.address", "o.city", "state", "parcel_id", "entity_id",
        "owner_name", "confidence")
    order = Window.partitionBy("street", "asked_city").orderBy(
        F.col("city_hit").desc(), F.col("sim").desc(), F.col("confidence").desc_nulls_last(), "parcel_id", "entity_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_ROWS)


def choose_row(ranked: DataFrame) -> DataFrame:
    """One row per (street, asked_city): with several distinct addresses the first one with an owner, else the first."""
    place = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("address", "city", "state")])
    row = F.struct("rank", "parcel_id", "entity_id", "owner_name", "sim", place.alias("place"))
    rows = ranked.groupBy("street", "asked_city").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    n_places = F.size(F.array_distinct(F.transform("rows", lambda r: r["place"])))
    owned = F.get(F.filter("rows", lambda r: r["entity_id"].isNotNull()), F.lit(0))
    first = F.get("rows", F.lit(0))
    chosen = F.when(n_places > 1, F.coalesce(owned, first)).otherwise(first)
    return rows.select("street", "asked_city", n_places.alias("n_distinct_addresses"), chosen.alias("r")).select(
        "street", "asked_city", "n_distinct_addresses", "r.parcel_id", "r.entity_id", "r.owner_name", "r.sim")


def match_addresses(
    requests: DataFrame, tables: dict[str, DataFrame], as_of: Column, index: PlaceIndex | None = None,
) -> DataFrame:
    """One row per request: status, parcel, owner_name, entity_id, freshness, n_distinct_addresses.

    `index` is a stored `PlaceIndex` of the parcels; without one it is built for this job.
    """
    as_of = as_of.cast("timestamp")
    asked = parse_addresses(requests)
    chosen = materialize(choose_row(ranked_matches(asked, tables, index)), "address-chosen")
    parcels = tables["parcels"].select(
        F.col("parcel_id").alias("found_id"), N.property_struct().alias("parcel"), "owner_name_raw", "updated_at")
    found = F.col("found_id").isNotNull()
    return (
        asked.join(chosen, ["street", "asked_city"], "left")
        .join(parcels, F.col("parcel_id") == F.col("found_id"), "left")
        .select(
            "request_id", F.when(found, "found").otherwise("not_found").alias("status"), "parcel",
            F.coalesce("owner_name", "owner_name_raw").alias("owner_name"), "entity_id",
            F.when(found, N.data_freshness(F.col("updated_at"), as_of)).otherwise("fresh").alias("data_freshness"),
            F.when(found, N.freshness_secs(F.col("updated_at"), as_of)).otherwise(F.lit(0)).alias("freshness_secs"),
            F.coalesce("n_distinct_addresses", F.lit(0)).alias("n_distinct_addresses"),
        )
    )
