"""Data-quality checks in place of the key and range constraints a database would enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave import schemas
from parcelweave.operators.portfolio import Edges, GroupedEdges

PRIMARY_KEYS = {
    "parcels": ["parcel_id"], "entities": ["entity_id"], "portfolio_edges": ["entity_id", "parcel_id"],
    "contacts": ["entity_id"],
}
NOT_NULL = {
    "parcels": ["parcel_id", "address", "city", "state", "zip", "property_type"],
    "roads": ["road_name", "state"],
    "entities": ["entity_id", "canonical_name", "entity_type"],
    "entity_aliases": ["entity_id", "alias_name"],
    "beneficial_owners": ["entity_id", "owner_name"],
    "portfolio_edges": ["entity_id", "parcel_id", "confidence", "method"],
    "contacts": ["entity_id", "name"],
    "query_log": ["tool_name"],
}
FOREIGN_KEYS = [
    ("portfolio_edges", "entity_id", "entities", "entity_id"),
    ("portfolio_edges", "parcel_id", "parcels", "parcel_id"),
    ("entity_aliases", "entity_id", "entities", "entity_id"),
    ("beneficial_owners", "entity_id", "entities", "entity_id"),
    ("beneficial_owners", "parent_entity_id", "entities", "entity_id"),
    ("contacts", "entity_id", "entities", "entity_id"),
]
VALUE_RULES = {
    ("entities", "entity_type"): lambda c: c.isin(schemas.ENTITY_TYPES),
    ("entities", "status"): lambda c: c.isin(schemas.ENTITY_STATUSES),
    ("portfolio_edges", "method"): lambda c: c.isin(schemas.EDGE_METHODS),
    ("portfolio_edges", "confidence"): lambda c: c.between(0, 1),
    ("contacts", "confidence"): lambda c: c.between(0, 1),
    ("entity_aliases", "match_score"): lambda c: c.between(0, 1),
}


def _row(check: str, table: str, column: str, n: Column) -> list[Column]:
    return [F.lit(check).alias("check"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            F.coalesce(n, F.lit(0)).cast("long").alias("n_bad")]


def _repeated(table: Edges, key: list[str]) -> DataFrame:
    """One row `n`: rows beyond the first of their key."""
    if isinstance(table, GroupedEdges):
        return table.count_repeated()
    repeated = table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.agg(F.sum(F.col("n") - 1).alias("n"))


def _count_wrong(table: Edges, bad: dict[tuple[str, str], Column]) -> list[DataFrame]:
    """One row each, with a count for every key of `bad`; all counts of a table come from one scan."""
    if not isinstance(table, GroupedEdges):
        return [table.agg(*[F.count_if(wrong).alias(f"{check}:{c}") for (check, c), wrong in bad.items()])]
    return [side.agg(*[F.coalesce(F.sum(F.when(wrong, F.col("n_edges"))), F.lit(0)).alias(f"{check}:{c}")
                       for (check, c), wrong in bad.items() if c in side.columns]) for side in table.weighted()]


def check_tables(tables: dict[str, Edges]) -> DataFrame:
    """(check, table_name, column_name, n_bad): repeated keys, nulls, orphans and values outside the allowed set.

    The staging table has no constraints, so it has no rows here; a table that is not given is not checked. Grouped edges
    are counted on their groups and never made flat; the counts are those of the flat edges.
    """
    results = []
    for table, key in PRIMARY_KEYS.items():
        if table in tables:
            results.append(_repeated(tables[table], key).select(*_row("unique", table, ",".join(key), F.col("n"))))
    for table, df in tables.items():
        bad = {("not_null", c): F.col(c).isNull() for c in NOT_NULL.get(table, [])}
        bad |= {("allowed_value", c): ~rule(F.col(c)) for (t, c), rule in VALUE_RULES.items() if t == table}
        for counted in _count_wrong(df, bad) if bad else []:
            results.append(counted.unpivot([], counted.columns, "_key", "n").select(
                F.substring_index("_key", ":", 1).alias("check"), F.lit(table).alias("table_name"),
                F.substring_index("_key", ":", -1).alias("column_name"), F.col("n").alias("n_bad")))
    for table, column, parent, parent_key in FOREIGN_KEYS:
        if table in tables and parent in tables:
            # Count per key value first: a hot key reaches the join as one row.
            rows = tables[table]
            used = rows.count_by(column) if isinstance(rows, GroupedEdges) else rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            used = used.filter(F.col(column).isNotNull()).withColumnRenamed(column, "k")
            orphans = used.join(tables[parent].select(F.col(parent_key).alias("k")), "k", "left_anti")
            results.append(orphans.agg(F.sum("n").alias("n")).select(
                *_row("foreign_key", table, column, F.col("n"))))
    return reduce(DataFrame.unionByName, results)
