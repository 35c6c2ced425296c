"""Nested ownership: following parent entities upwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelweave.session import materialize


def ownership_chain(beneficial_owners: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(entity_id, depth, owner_name, parent_entity_id, path) for every owner reachable from every entity.

    Depth 1 is the entity's own owners; each further level follows `parent_entity_id`. `path` lists the entities
    passed, and a parent already on it ends the chain, so the loop ends with the longest chain. One join extends all
    chains by a level; each level is written as a table, so the plan stays flat. With `max_depth` a column `truncated`
    marks the rows whose chain goes on beyond it.
    """
    links = materialize(
        beneficial_owners.select("entity_id", "owner_name", "parent_entity_id").distinct(), "ownership-links")
    owners = links.select(
        F.col("entity_id").alias("tip"), F.col("owner_name").alias("next_owner"),
        F.col("parent_entity_id").alias("next_parent"),
    )
    goes_on = F.col("parent_entity_id").isNotNull() & ~F.array_contains("path", F.col("parent_entity_id"))
    level = links.select(
        "entity_id", F.lit(1).alias("depth"), "owner_name", "parent_entity_id", F.array("entity_id").alias("path"))
    levels = [materialize(level, "ownership")]
    while len(levels) != max_depth and not levels[-1].isEmpty():
        open_ends = levels[-1].filter(goes_on).select(
            "entity_id", "depth", "path", F.col("parent_entity_id").alias("tip"))
        grown = open_ends.join(owners, "tip").select(
            "entity_id", (F.col("depth") + 1).alias("depth"), F.col("next_owner").alias("owner_name"),
            F.col("next_parent").alias("parent_entity_id"), F.array_append("path", F.col("tip")).alias("path"))
        levels.append(materialize(grown, "ownership"))
    chains = reduce(DataFrame.unionByName, levels)
    if max_depth is None:
        return chains
    known = owners.select(F.col("tip").alias("parent_entity_id"), F.lit(True).alias("_known")).distinct()
    return chains.join(known, "parent_entity_id", "left").withColumn(
        "truncated", (F.col("depth") == max_depth) & goes_on & F.coalesce("_known", F.lit(False))).select(
        *chains.columns, "truncated")
