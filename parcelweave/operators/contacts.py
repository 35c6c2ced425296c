"""Contact candidates and the merge of the two landed vendor answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.normalize import blank_to_null, company_domain, empty_to_null, trim_space
from parcelweave.operators.portfolio import live_contacts

PREWARM_LIMIT = 500
PROFILE_CONFIDENCE = 0.75
# Contact sources and default roles.
PROFILE_SOURCE, EMAIL_SOURCE, BOTH_SOURCES = "proxycurl", "hunter", "proxycurl+hunter"
PROFILE_ROLE, EMAIL_ROLE = "Principal", "Contact"


def popularity(query_log: DataFrame) -> DataFrame:
    """Queries per entity."""
    return query_log.filter(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_queries"))


def prewarm_candidates(
    query_log: DataFrame, entities: DataFrame, contacts: DataFrame, as_of: Column, limit: int = PREWARM_LIMIT,
) -> DataFrame:
    """The most asked-for entities without a live contact, with the domain to ask the e-mail search for.

    The log is counted per entity before any join.
    """
    return (
        popularity(query_log)
        .join(entities.select("entity_id", "canonical_name"), "entity_id")
        .join(live_contacts(contacts, as_of).select("entity_id"), "entity_id", "left_anti")
        .orderBy(F.col("n_queries").desc(), "entity_id").limit(limit)
        .withColumn("domain", company_domain(F.col("canonical_name")))
    )


def resolve_contacts(candidates: DataFrame, profiles: DataFrame, emails: DataFrame) -> DataFrame:
    """One contact per candidate entity from the landed answers, or no row where neither vendor had one.

    candidates(entity_id, canonical_name), profiles(entity_id, person_name, person_title, company_name),
    emails(entity_id, first_name, last_name, position, email, email_confidence); one row per entity each.
    A profile gives the base; an e-mail hit overlays name, role and address and lifts the confidence.
    """
    p = profiles.withColumn("has_profile", F.lit(True))
    e = emails.withColumn("has_email", F.lit(True))
    joined = candidates.select("entity_id", "canonical_name").join(p, "entity_id", "left").join(e, "entity_id", "left")
    has_profile, has_email = F.col("has_profile").isNotNull(), F.col("has_email").isNotNull()

    profile_name = F.coalesce("person_name", "company_name", "canonical_name")
    full_name = trim_space(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))))
    email_name = F.coalesce(blank_to_null(full_name), F.when(has_profile, profile_name).otherwise(
        F.col("canonical_name")))
    base_role = F.when(has_profile, F.coalesce("person_title", F.lit(PROFILE_ROLE))).otherwise(EMAIL_ROLE)
    email_score = F.col("email_confidence") / 100
    profile_score = F.when(has_profile, F.lit(PROFILE_CONFIDENCE))
    return joined.filter(has_profile | has_email).select(
        "entity_id",
        F.when(has_email, email_name).otherwise(profile_name).alias("name"),
        F.when(has_email, F.coalesce(empty_to_null(F.col("position")), base_role)).otherwise(base_role).alias("role"),
        F.when(has_email, F.col("email")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.greatest(profile_score, F.when(has_email, email_score)).alias("confidence"),
        F.when(has_profile & has_email, BOTH_SOURCES).when(has_profile, PROFILE_SOURCE).otherwise(EMAIL_SOURCE)
        .alias("source"),
    )
