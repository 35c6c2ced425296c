"""Joins and aggregates over portfolio edges.

Edges are given flat, as (entity_id, parcel_id, confidence, method), or as `GroupedEdges`; the rows are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.operators.skew import salted_join
from parcelweave.session import materialize


@dataclass
class GroupedEdges:
    """Edges as groups: every parcel of a group belongs to every owner of it, and to no owner of another group.

    `members` (group_id, parcel_id) and `owners` (group_id, entity_id, confidence, method) grow with the parcels and the
    entities; edges grow with their product for each name. Work on edges joins and aggregates on the groups, and only
    what is asked for is made flat. A parcel id is in one group and an owner once in a group, so no edge comes twice.
    """

    members: DataFrame
    owners: DataFrame

    @classmethod
    def of_flat(cls, edges: DataFrame) -> GroupedEdges:
        """Flat edges, every row kept; each parcel id is a group of its own, numbered from -1 down."""
        edges = materialize(edges, "flat-edges")
        ids = materialize(edges.select("parcel_id").distinct().withColumn(
            "group_id", -1 - F.monotonically_increasing_id()), "repeated-groups")
        numbered = edges.withColumnRenamed("parcel_id", "_id").join(ids, F.col("_id").eqNullSafe(F.col("parcel_id")))
        return cls(ids.select("group_id", "parcel_id"), numbered.select("group_id", "entity_id", "confidence", "method"))

    def flat(self) -> DataFrame:
        """All edges, one row each; the product is made by the join that ends here and not exchanged again."""
        return salted_join(self.members, self.owners, ["group_id"]).select(
            "entity_id", "parcel_id", "confidence", "method")

    def for_entities(self, ids: DataFrame) -> GroupedEdges:
        """The edges of some entities."""
        owners = self.owners.join(ids.select("entity_id"), "entity_id", "left_semi").select(self.owners.columns)
        return GroupedEdges(self.members.join(owners.select("group_id"), "group_id", "left_semi"), owners)

    def split(self, name: str, value: Column) -> GroupedEdges:
        """Groups whose parcels agree in `value`, an expression over `parcel_id`; their owners have it as column `name`."""
        valued = self.members.withColumn(name, value)
        parts = materialize(valued.select("group_id", name).distinct().withColumn(
            "part_id", F.monotonically_increasing_id()), "group-parts")
        own = parts.select(F.col("group_id").alias("_group"), F.col(name).alias("_value"), "part_id")
        members = valued.join(own, (F.col("group_id") == F.col("_group")) & F.col(name).eqNullSafe(F.col("_value")))
        owners = self.owners.join(parts, "group_id").drop("group_id").withColumnRenamed("part_id", "group_id")
        return GroupedEdges(members.select(F.col("part_id").alias("group_id"), "parcel_id"), owners)

    def weighted(self) -> tuple[DataFrame, DataFrame]:
        """Members and owners, each row with the number of edges it is in as `n_edges`; rows in none are left out."""
        sizes = [df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_edges")) for df in (self.owners, self.members)]
        return self.members.join(sizes[0], "group_id"), self.owners.join(sizes[1], "group_id")

    def count_by(self, *columns: str) -> DataFrame:
        """Number of edges `n` by columns of the owners, or by `parcel_id`."""
        members, owners = self.weighted()
        return (members if columns == ("parcel_id",) else owners).groupBy(*columns).agg(
            F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n"))

    def count_repeated(self) -> DataFrame:
        """One row `n`: edges beyond the first of their entity and parcel id, also where groups break their rules.

        A parcel id in one group has the group's different owners; only ids in several groups meet their owners one by one.
        """
        per_id = self.members.groupBy("parcel_id").agg(F.min("group_id").alias("_first"), F.max("group_id").alias("_last"))
        several = F.col("_first") != F.col("_last")
        found = materialize(per_id.groupBy(
            several.alias("several"), F.when(several, F.col("parcel_id")).alias("_id"), F.when(~several, F.col("_first")).alias("group_id")
        ).agg(F.count(F.lit(1)).alias("n_ids")), "edge-ids")
        owners = self.owners.select("group_id", "entity_id").distinct()
        alone = found.filter("not several").join(owners.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_owners")), "group_id")
        shared = self.members.join(found.filter("several").select("_id"), F.col("parcel_id").eqNullSafe(F.col("_id")))
        shared = materialize(shared.select("group_id", "parcel_id").distinct(), "shared-ids")
        pairs = salted_join(shared, owners, ["group_id"]).select("parcel_id", "entity_id").distinct()
        counts = self.count_by().unionByName(alone.agg((-F.sum(F.col("n_ids") * F.col("n_owners"))).alias("n"))).unionByName(
            pairs.agg((-F.count(F.lit(1))).alias("n")))
        return counts.agg(F.sum("n").alias("n"))


Edges = DataFrame | GroupedEdges


def owned_parcels(edges: Edges, parcels: DataFrame) -> DataFrame:
    if isinstance(edges, GroupedEdges):
        return salted_join(edges.members.join(parcels, "parcel_id"), edges.owners, ["group_id"]).select(
            "parcel_id", "entity_id", "confidence", "method", *[c for c in parcels.columns if c != "parcel_id"])
    return edges.join(parcels, "parcel_id")


def grouped_parcels(parcels: DataFrame, edges: GroupedEdges) -> DataFrame:
    """Every parcel with its group; a parcel without one gets a number that no group has, spread over many."""
    nowhere = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("parcel_id"), F.lit(1 << 40))
    return parcels.join(edges.members, "parcel_id", "left").withColumn("group_id", F.coalesce("group_id", nowhere))


def parcels_with_owner(parcels: DataFrame, edges: Edges, entities: DataFrame) -> DataFrame:
    """Every parcel, with its owner edges and entities where there are any."""
    named = entities.select("entity_id", F.col("canonical_name").alias("owner_name"))
    if isinstance(edges, GroupedEdges):
        owners = edges.owners.select("group_id", "entity_id", "confidence").join(named, "entity_id", "left")
        return salted_join(grouped_parcels(parcels, edges), owners, ["group_id"], "left").select(
            *parcels.columns, "entity_id", "confidence", "owner_name")
    owners = edges.select("parcel_id", "entity_id", "confidence").join(named, "entity_id", "left")
    return parcels.join(owners, "parcel_id", "left")


def for_entities(df: Edges, ids: DataFrame) -> Edges:
    """Rows of `df` whose entity is in `ids`."""
    if isinstance(df, GroupedEdges):
        return df.for_entities(ids)
    return df.join(ids.select("entity_id"), "entity_id", "left_semi")


def portfolio_summary(edges: Edges, parcels: DataFrame) -> DataFrame:
    """Per entity: property count, total building size, states and property types present.

    Aggregated by (entity, state, type) first, so an entity with very many parcels reaches its final group as a few
    rows and the sets stay small; grouped edges are summed up by (group, state, type) before they meet the owners.
    """
    sized = parcels.select("parcel_id", "building_sqft", "state", "property_type")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("building_sqft").alias("sqft")]
    if isinstance(edges, GroupedEdges):
        per_group = edges.members.join(sized, "parcel_id").groupBy("group_id", "state", "property_type").agg(*sums)
        parts = per_group.join(edges.owners.select("group_id", "entity_id"), "group_id")
    else:
        parts = owned_parcels(edges.select("entity_id", "parcel_id"), sized).groupBy(
            "entity_id", "state", "property_type").agg(*sums)
    return parts.groupBy("entity_id").agg(
        F.sum("n").cast("int").alias("property_count"),
        F.sum("sqft").alias("total_sqft"),
        F.array_sort(F.collect_set("state")).alias("states_present"),
        F.array_sort(F.collect_set("property_type")).alias("property_types"),
    )


def summary_for(ids: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary of every id asked for, zero and empty where it owns nothing."""
    empty = F.array().cast("array<string>")
    return ids.join(summary, "entity_id", "left").select(
        *ids.columns,
        F.coalesce("property_count", F.lit(0)).alias("property_count"), "total_sqft",
        F.coalesce("states_present", empty).alias("states_present"),
        F.coalesce("property_types", empty).alias("property_types"),
    )


def live_contacts(contacts: DataFrame, as_of: Column) -> DataFrame:
    return contacts.filter(F.col("expires_at") > as_of.cast("timestamp"))


def coverage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts per layer, and edges per method, as (metric, n)."""
    def counted(df, metric):
        return df.agg(F.count(F.lit(1)).alias("n")).select(metric.alias("metric"), "n")

    edges = tables["portfolio_edges"]
    if isinstance(edges, GroupedEdges):
        all_edges, per_method = edges.count_by(), edges.count_by("method")
    else:
        all_edges, per_method = (
            edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) for by in ([], ["method"]))
    with_owner = tables["parcels"].agg(
        F.count(F.lit(1)).alias("parcels"), F.count("owner_name_raw").alias("parcels_with_owner"))
    return (
        counted(tables["roads"], F.lit("roads"))
        .unionByName(with_owner.unpivot([], ["parcels", "parcels_with_owner"], "metric", "n"))
        .unionByName(counted(tables["entities"], F.lit("entities")))
        .unionByName(all_edges.select(F.lit("edges").alias("metric"), "n"))
        .unionByName(per_method.select(F.concat(F.lit("edges_"), F.col("method")).alias("metric"), "n"))
    )
