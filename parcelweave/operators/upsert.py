"""Keyed upserts as full outer joins, and the other merge policies.

Spark's file tables take no row-level MERGE, so each merge returns the whole new version of the table, to be written
next to the old one and switched (see `sources.tables`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.operators.portfolio import Edges, GroupedEdges
from parcelweave.session import materialize

CONTACT_LIFETIME = "30 days"

ADDRESS_COLUMNS = ["address", "city", "state", "zip", "lat", "lon", "source"]
PARCEL_COLUMNS = ADDRESS_COLUMNS + [
    "lot_size_acres", "building_sqft", "property_type", "last_sale_price", "last_sale_date", "loan_maturity",
    "owner_name_raw",
]
UNKNOWN = "Unknown"


def pick_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`. The limit of one is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def last_by_position(staging: DataFrame, key: str, position: list[str]) -> DataFrame:
    """The last record per key in file order, without the position columns."""
    return pick_first(staging, [key], [F.col(c).desc() for c in position]).drop(*position)


def first_by_position(staging: DataFrame, key: str, position: list[str]) -> DataFrame:
    return pick_first(staging, [key], [F.col(c).asc() for c in position]).drop(*position)


def _merge(target: DataFrame, new: DataFrame, key: list[str], columns: dict[str, Column], how: str) -> DataFrame:
    """Join `target` t and `new` n on `key`; `columns` gives the result of each non-key column from t.* and n.*."""
    t = target.withColumn("_in", F.lit(True)).alias("t")
    n = new.withColumn("_in", F.lit(True)).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"n.{k}") for k in key])
    keys = [F.coalesce(F.col(f"t.{k}"), F.col(f"n.{k}")).alias(k) for k in key]
    merged = t.join(n, on, how).select(*keys, *[c.alias(name) for name, c in columns.items()])
    return merged.select(*target.columns)


def _is_new() -> Column:
    return F.col("n._in").isNotNull()


def _replace(name: str) -> Column:
    return F.when(_is_new(), F.col(f"n.{name}")).otherwise(F.col(f"t.{name}"))


def _keep(name: str) -> Column:
    """Taken from the new row only when the key is new."""
    return F.when(F.col("t._in").isNull(), F.col(f"n.{name}")).otherwise(F.col(f"t.{name}"))


def _fill(name: str) -> Column:
    return F.coalesce(F.col(f"n.{name}"), F.col(f"t.{name}"))


def _new_type() -> Column:
    """A known new type replaces the old one; a new row without a type is 'Unknown'."""
    known = _is_new() & (F.col("n.property_type") != UNKNOWN)
    fallback = F.when(F.col("t._in").isNull(), UNKNOWN).otherwise(F.col("t.property_type"))
    return F.when(known, F.col("n.property_type")).otherwise(fallback)


def _parcel_stamps(as_of: Column) -> dict[str, Column]:
    return {
        "ingested_at": F.when(F.col("t._in").isNull(), as_of).otherwise(F.col("t.ingested_at")),
        "updated_at": F.when(_is_new(), as_of).otherwise(F.col("t.updated_at")),
    }


def upsert_parcels(
    parcels: DataFrame, staging: DataFrame, policy: str, as_of: Column, order: list[Column] | None = None,
) -> DataFrame:
    """New version of `parcels` after merging `staging` under a policy.

    Of several staged rows of one id the first by `order` counts, by default the one with the greatest values.

    'replace'        every data column is overwritten, a missing type becomes 'Unknown'
    'address'        only address, city, state, zip, coordinates and source are overwritten
    'enrich'         owner and lot size are filled where given, a known type replaces; new parcels are added
    'enrich_update'  as 'enrich' plus building size and last sale; parcels not in the table are left out
    """
    as_of = as_of.cast("timestamp")
    stamps = _parcel_stamps(as_of)
    available = set(staging.columns)
    staging = pick_first(
        staging, ["parcel_id"], order or [F.col(c).desc_nulls_last() for c in PARCEL_COLUMNS if c in available])
    staging = staging.select(
        "parcel_id",
        *[F.col(c) if c in available else F.lit(None).cast(parcels.schema[c].dataType).alias(c)
          for c in PARCEL_COLUMNS],
    )
    if policy == "replace":
        columns = {c: _replace(c) for c in PARCEL_COLUMNS}
        columns["property_type"] = F.when(
            _is_new(), F.coalesce(F.col("n.property_type"), F.lit(UNKNOWN))).otherwise(F.col("t.property_type"))
        how = "full_outer"
    elif policy == "address":
        columns = {c: _keep(c) for c in PARCEL_COLUMNS} | {c: _replace(c) for c in ADDRESS_COLUMNS}
        columns["property_type"] = F.when(F.col("t._in").isNull(), UNKNOWN).otherwise(F.col("t.property_type"))
        for c in ("lot_size_acres", "building_sqft", "last_sale_price", "last_sale_date", "loan_maturity",
                  "owner_name_raw"):
            columns[c] = F.col(f"t.{c}")
        how = "full_outer"
    elif policy in ("enrich", "enrich_update"):
        columns = {c: _keep(c) for c in PARCEL_COLUMNS}
        columns |= {c: _fill(c) for c in ("owner_name_raw", "lot_size_acres")}
        columns["property_type"] = _new_type()
        if policy == "enrich_update":
            columns |= {c: _fill(c) for c in ("building_sqft", "last_sale_date", "last_sale_price")}
        how = "full_outer" if policy == "enrich" else "left"
    else:
        raise ValueError(f"unknown upsert policy: {policy}")
    return _merge(parcels, staging, ["parcel_id"], columns | stamps, how)


def upsert_entities(entities: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Registry rows replace name, type, status, agent and filing address; jurisdiction and date stay as they were."""
    as_of = as_of.cast("timestamp")
    replaced = ["canonical_name", "entity_type", "status", "registered_agent_name", "registered_agent_address",
                "sos_filing_url"]
    columns = {c: _replace(c) for c in replaced} | {c: _keep(c) for c in ("jurisdiction", "incorporated_at")}
    columns["lei"] = F.col("t.lei")
    columns["source"] = F.when(F.col("t._in").isNull(), "sos").otherwise(F.col("t.source"))
    columns["created_at"] = F.when(F.col("t._in").isNull(), as_of).otherwise(F.col("t.created_at"))
    columns["updated_at"] = F.when(_is_new(), as_of).otherwise(F.col("t.updated_at"))
    return _merge(entities, registry, ["entity_id"], columns, "full_outer")


def _merge_groups(old: GroupedEdges, new: GroupedEdges) -> GroupedEdges:
    """Parcels that come from the same group on either side are one group, whose owners are merged once for all of them.

    Parcels and owners travel, never their product. A group has a parcel, so owners of groups are no more than edges.
    """
    sides = [e.members.select(F.col("parcel_id").alias(f"_{s}"), F.col("group_id").alias(f"{s}_group"), F.lit(True).alias(f"{s}_in"))
             for e, s in ((old, "old"), (new, "new"))]
    paired = sides[0].join(sides[1], F.col("_old").eqNullSafe(F.col("_new")), "full_outer")
    paired = materialize(paired.select(
        "old_group", "new_group", F.when(F.col("old_in"), F.col("_old")).otherwise(F.col("_new")).alias("parcel_id")), "merged-parcels")
    pairs = materialize(paired.select("old_group", "new_group").distinct().withColumn(
        "group_id", F.monotonically_increasing_id()), "merged-groups")
    both = [e.owners.select(F.col("group_id").alias(f"{s}_group"), "entity_id", "confidence", "method", F.lit(i).alias("_turn")).join(
        pairs, f"{s}_group").select("group_id", "entity_id", "confidence", "method", "_turn") for i, (e, s) in enumerate(((old, "old"), (new, "new")))]
    owners = pick_first(both[0].unionByName(both[1]), ["group_id", "entity_id"],
                        [F.col("confidence").desc_nulls_last(), F.col("_turn")]).drop("_turn")
    own = pairs.toDF("_o", "_n", "group_id")
    members = paired.join(own, F.col("old_group").eqNullSafe(F.col("_o")) & F.col("new_group").eqNullSafe(F.col("_n")))
    return GroupedEdges(materialize(members.select("group_id", "parcel_id"), "edge-members"), materialize(owners, "edge-owners"))


def merge_edges(old: Edges, *new: Edges) -> Edges:
    """Edges with the greatest confidence seen; the method changes only for a strictly greater confidence.

    Later inputs count as merged later, so on equal confidence the earlier one keeps its method. Inputs are all flat or
    all grouped, and so is the result.
    """
    if isinstance(old, GroupedEdges):
        return reduce(_merge_groups, new, old)
    cols = ["entity_id", "parcel_id", "confidence", "method"]
    ranked = [df.select(*cols, F.lit(i).alias("_turn")) for i, df in enumerate((old, *new))]
    edges = reduce(DataFrame.unionByName, ranked)
    return pick_first(edges, ["entity_id", "parcel_id"], [F.col("confidence").desc_nulls_last(), F.col("_turn")]
                      ).select(*cols)


def upsert_contacts(contacts: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """Found contacts replace the stored ones and live for 30 days from `as_of`."""
    as_of = as_of.cast("timestamp")
    columns = {c: _replace(c) for c in ("name", "role", "email", "phone", "confidence", "source")}
    columns["enriched_at"] = F.when(_is_new(), as_of).otherwise(F.col("t.enriched_at"))
    columns["expires_at"] = F.when(_is_new(), as_of + F.expr(f"INTERVAL {CONTACT_LIFETIME}")).otherwise(
        F.col("t.expires_at"))
    return _merge(contacts, found, ["entity_id"], columns, "full_outer")


def append_new(target: DataFrame, new: DataFrame, key: list[str], fold: dict | None = None) -> DataFrame:
    """Rows of `new` whose natural key is not in `target` yet, one per key; to be appended to the table.

    `fold` maps a key column to a function applied on both sides, e.g. upper case for alias names.
    """
    fold = fold or {}
    keyed = lambda df: [fold.get(k, lambda c: c)(F.col(k)).alias(f"_k_{k}") for k in key]
    names = [f"_k_{k}" for k in key]
    known = target.select(*keyed(target)).distinct()
    fresh = new.select("*", *keyed(new))
    once = pick_first(fresh, names, [F.col(c) for c in new.columns])
    return once.join(known, names, "left_anti").select(*new.columns)
