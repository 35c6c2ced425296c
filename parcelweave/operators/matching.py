"""Matching raw owner names to registered entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions import text
from parcelweave.functions.normalize import name_key
from parcelweave.operators.portfolio import GroupedEdges
from parcelweave.operators.set_join import similarity_pairs
from parcelweave.operators.skew import salted_join
from parcelweave.operators.upsert import merge_edges, pick_first
from parcelweave.session import materialize, spread

TRIGRAM_THRESHOLD = 0.70
TOKEN_SET_THRESHOLD = 90


def _owned(parcels: DataFrame) -> DataFrame:
    return parcels.filter(F.col("owner_name_raw").isNotNull()).select(
        "parcel_id", name_key(F.col("owner_name_raw")).alias("name_key"))


def _exact_names(entities: DataFrame) -> DataFrame:
    return entities.select(name_key(F.col("canonical_name")).alias("name_key"), "entity_id")


def _alias_names(aliases: DataFrame) -> DataFrame:
    """The best score per entity and name key."""
    return aliases.groupBy(name_key(F.col("alias_name")).alias("name_key"), "entity_id").agg(
        F.max("match_score").alias("confidence"))


def exact_edges(parcels: DataFrame, entities: DataFrame, **salting) -> DataFrame:
    """(entity_id, parcel_id, confidence 1.0, 'exact') for equal names, case and outer blanks aside."""
    return salted_join(_owned(parcels), _exact_names(entities), ["name_key"], **salting).select(
        "entity_id", "parcel_id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))


def alias_edges(parcels: DataFrame, aliases: DataFrame, **salting) -> DataFrame:
    """(entity_id, parcel_id, best alias score, 'fuzzy'), one row per entity and parcel."""
    # The best score per entity and name key is picked before the join, so the join makes no duplicate edges.
    return salted_join(_owned(parcels), _alias_names(aliases), ["name_key"], **salting).select(
        "entity_id", "parcel_id", "confidence", F.lit("fuzzy").alias("method"))


def grouped_edges(parcels: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, **salting) -> GroupedEdges:
    """Exact and alias edges (without `aliases` exact ones alone) merged, kept by owner name: parcels of a name and entities of a name, never their product.

    A parcel id with one row has one name, so the best edge per entity and parcel is the best owner per entity and name.
    Ids that are missing or have several rows may hold several names; their edges are merged one by one, and each such
    id is a group of its own.
    """
    owned = materialize(_owned(parcels), "owned-parcels")
    repeated = materialize(
        owned.filter("parcel_id is not null").groupBy("parcel_id").count().filter("count > 1").select("parcel_id"), "repeated-ids")
    exact = _exact_names(entities).withColumns({"confidence": F.lit(1.0), "method": F.lit("exact"), "_turn": F.lit(0)})
    named = exact if aliases is None else exact.unionByName(
        _alias_names(aliases).withColumns({"method": F.lit("fuzzy"), "_turn": F.lit(1)}))
    owners = pick_first(
        named.filter("name_key is not null"), ["name_key", "entity_id"],
        [F.col("confidence").desc_nulls_last(), F.col("_turn")]).drop("_turn")
    owners = materialize(owners, "name-owners")
    names = materialize(owners.select("name_key").distinct().withColumn("group_id", F.monotonically_increasing_id()), "owner-names")
    members = owned.filter("parcel_id is not null").join(repeated, "parcel_id", "left_anti").join(names, "name_key").select(
        "group_id", "parcel_id")
    owners_of = owners.join(names, "name_key").select("group_id", "entity_id", "confidence", "method")

    several = materialize(
        owned.filter("parcel_id is null").unionByName(owned.join(repeated, "parcel_id", "left_semi").select(owned.columns)),
        "repeated-parcels")
    if not several.isEmpty():
        edges = merge_edges(salted_join(several, owners, ["name_key"], **salting))
        # Groups of names are numbered from 0 up, these from -1 down.
        one_by_one = GroupedEdges.of_flat(edges)
        members, owners_of = members.unionByName(one_by_one.members), owners_of.unionByName(one_by_one.owners)
    return GroupedEdges(materialize(members, "edge-members"), materialize(owners_of, "edge-owners"))


def unmatched_names(parcels: DataFrame, aliases: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """Distinct raw owner names with no alias yet, as column `name`."""
    fold = F.upper if case_insensitive else (lambda c: c)
    names = parcels.filter(F.col("owner_name_raw").isNotNull()).select(F.col("owner_name_raw").alias("name")).distinct()
    known = aliases.select(fold(F.col("alias_name")).alias("folded")).distinct()
    return names.withColumn("folded", fold(F.col("name"))).join(known, "folded", "left_anti").select("name")


def _trigram_key(name: Column) -> Column:
    return F.array_join(F.array_sort(text.trigrams(F.upper(name))), "")


def _key_sets(df: DataFrame) -> DataFrame:
    """Back from a key to its trigrams, as numbers: every trigram is three characters."""
    starts = F.sequence(F.lit(1), F.length("id") - 2, F.lit(3))
    return df.select("id", F.transform(starts, lambda i: text.trigram_code(F.substr(F.col("id"), i, F.lit(3)))).alias("tokens"))


def best_trigram_match(names: DataFrame, entities: DataFrame, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """(name, entity_id, match_score) with the most similar entity per name; ties go to the lowest entity id.

    Names and entities are first collapsed to distinct trigram sets. Sets equal on both sides have similarity 1 and
    are settled by an equi-join; only the rest goes through the similarity join.
    """
    # The keys are written once: as a plain expression they would be made again for every filter and join on them.
    keyed = materialize(
        spread(names.select("name").distinct(), "name").select("name", _trigram_key(F.col("name")).alias("id")),
        "name-keys").filter("id <> ''")
    left = keyed.select("id").distinct()
    owners = materialize(
        entities.select(_trigram_key(F.col("canonical_name")).alias("id"), "entity_id"), "entity-keys"
    ).filter("id <> ''").groupBy("id").agg(F.min("entity_id").alias("entity_id"))
    equal = left.join(owners, "id").select("id", "entity_id", F.lit(1.0).alias("match_score"))
    rest = left.join(owners, "id", "left_anti")
    pairs = similarity_pairs(_key_sets(rest), _key_sets(owners), threshold)
    near = (
        pairs.join(owners.withColumnRenamed("id", "r_id"), "r_id")
        .groupBy(F.col("l_id").alias("id"))
        .agg(F.min(F.struct((-F.col("sim")).alias("neg_sim"), "entity_id")).alias("best"))
        .select("id", "best.entity_id", (-F.col("best.neg_sim")).alias("match_score"))
    )
    return keyed.join(equal.unionByName(near), "id").select("name", "entity_id", "match_score")


def new_aliases(matches: DataFrame, source: str) -> DataFrame:
    return matches.select(
        "entity_id", F.col("name").alias("alias_name"), "match_score", F.lit(source).alias("source"))
