"""Follow-up questions on discovery results, and entity search by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.functions.text import similarity, trigram_codes
from parcelweave.operators.set_join import similarity_pairs
from parcelweave.operators.text_match import text_match


def discovered_owners(results: DataFrame) -> DataFrame:
    """Discovery results as one row per request and owner."""
    return results.select(
        "request_id", F.col("query_summary.corridor").alias("corridor"), F.posexplode("owners").alias("pos", "o"),
    ).select(
        "request_id", "corridor", (F.col("pos") + 1).alias("owner_rank"), "o.owner_name", "o.entity_id",
        "o.entity_type", "o.portfolio_summary.property_count", "o.portfolio_summary.total_sqft",
        "o.properties_in_corridor",
    )


def screen_owners(
    results: DataFrame, min_properties: int | None = None, loan_before: Column | None = None, top: int | None = None,
) -> DataFrame:
    """Owners of each request ranked by total portfolio size, to the hundredth so that sums in any order tie alike.

    Keeps owners with more than `min_properties` properties, and with a listed loan maturing before `loan_before`.
    """
    owners = discovered_owners(results)
    if min_properties is not None:
        owners = owners.filter(F.col("property_count") > min_properties)
    if loan_before is not None:
        due = F.exists("properties_in_corridor",
                       lambda p: p["loan_maturity"].cast("date") < loan_before.cast("date"))
        owners = owners.filter(F.coalesce(due, F.lit(False)))
    w = Window.partitionBy("request_id").orderBy(F.round("total_sqft", 2).desc_nulls_last(), "entity_id")
    ranked = owners.withColumn("size_rank", F.row_number().over(w))
    return ranked.filter(F.col("size_rank") <= top) if top is not None else ranked


def compare_corridors(results: DataFrame) -> DataFrame:
    """One row per request: parcels, owners and the building size of the owners returned."""
    totals = discovered_owners(results).groupBy("request_id").agg(F.sum("total_sqft").alias("owners_total_sqft"))
    return results.join(totals, "request_id", "left").select(
        "request_id", "query_summary.corridor", "query_summary.property_type", "query_summary.matched_parcels",
        "query_summary.total_owners", "owners_total_sqft")


def find_entities(
    requests: DataFrame, entities: DataFrame, threshold: float = 0.3, top: int | None = None,
) -> DataFrame:
    """Entities by name within a state: requests(request_id, name, state), '' for every state.

    A name matches by its words or by trigram similarity; the most similar come first, all of them unless `top`.
    """
    asked = requests.select("name").distinct()
    names = entities.select("canonical_name").distinct()
    by_words = text_match(asked.toDF("query"), names.toDF("doc")).toDF("name", "canonical_name").withColumn(
        "sim", similarity(F.col("name"), F.col("canonical_name")))
    sets = lambda df, c: df.select(F.col(c).alias("id"), trigram_codes(F.col(c)).alias("tokens"))
    by_trigrams = similarity_pairs(sets(asked, "name"), sets(names, "canonical_name"), threshold).toDF(
        "name", "canonical_name", "sim")
    pairs = by_words.unionByName(by_trigrams).distinct()
    located = entities.select(
        "entity_id", "canonical_name",
        F.explode(F.array(F.coalesce(F.regexp_replace(F.upper("jurisdiction"), "^US-", ""), F.lit("?")), F.lit("")))
        .alias("state"))
    w = Window.partitionBy("request_id").orderBy(F.col("sim").desc(), "entity_id")
    ranked = (
        requests.select("request_id", "name", F.upper("state").alias("state")).join(pairs, "name")
        .join(located, ["canonical_name", "state"])
        .withColumn("rank", F.row_number().over(w))
        .select("request_id", "rank", "entity_id", "canonical_name", "sim")
    )
    return ranked.filter(F.col("rank") <= top) if top is not None else ranked
