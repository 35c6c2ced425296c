"""Batch jobs that keep the tables up to date: resolution, portfolio, contacts, owner enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.operators import contacts as C
from parcelweave.operators import matching as M
from parcelweave.operators import upsert as U
from parcelweave.operators.portfolio import Edges
from parcelweave.operators.token_set_join import best_token_set_match
from parcelweave.sources import vendor
from parcelweave.sources.landed import POSITION, accepted
from parcelweave.sources.tables import Tables
from parcelweave.sources.tax_lots import commercial_lots

# Alias sources of the two matching methods.
ALIAS_SOURCES = {"trigram": "trgm", "token_set": "fuzzball"}
ENRICHMENT_LIMIT = 500


def resolve_names(
    parcels: DataFrame, entities: DataFrame, aliases: DataFrame, method: str = "trigram",
    limit: int | None = None,
) -> DataFrame:
    """New alias rows for owner names that have none: the best entity per name.

    'trigram' takes similarity >= 0.70, 'token_set' a token-set score >= 90. All names are matched unless `limit`.
    """
    names = M.unmatched_names(parcels, aliases, case_insensitive=method == "trigram")
    if limit is not None:
        names = names.orderBy("name").limit(limit)
    if method == "trigram":
        matches = M.best_trigram_match(names, entities, M.TRIGRAM_THRESHOLD)
    elif method == "token_set":
        matches = best_token_set_match(names, entities, M.TOKEN_SET_THRESHOLD)
    else:
        raise ValueError(f"unknown matching method: {method}")
    found = M.new_aliases(matches, ALIAS_SOURCES[method])
    fold = {"alias_name": F.upper} if method == "trigram" else {}
    return U.append_new(aliases, found, ["entity_id", "alias_name"], fold)


def recompute_edges(
    parcels: DataFrame, entities: DataFrame, aliases: DataFrame, old_edges: Edges | None = None,
) -> DataFrame:
    """Exact and alias edges merged into `old_edges`; without them, rebuilt from nothing."""
    edges = M.grouped_edges(parcels, entities, aliases)
    if isinstance(old_edges, DataFrame):
        return U.merge_edges(old_edges, edges.flat())
    return (edges if old_edges is None else U.merge_edges(old_edges, edges)).flat()


def enrichment_candidates(
    parcels: DataFrame, states: list[str] | None = None, limit: int | None = ENRICHMENT_LIMIT,
) -> DataFrame:
    """Parcels without an owner, newest first, to ask the vendor for by `address` and `locality`."""
    wanted = parcels.filter(F.col("owner_name_raw").isNull() & F.col("address").isNotNull())
    if states:
        wanted = wanted.filter(F.upper("state").isin([s.upper() for s in states]))
    wanted = wanted.select("parcel_id", "address", "city", "state", "zip", "ingested_at",
                           N.vendor_match_key(F.col("city"), F.col("state"), F.col("zip")).alias("locality"))
    if limit is None:
        return wanted
    return wanted.orderBy(F.col("ingested_at").desc_nulls_last(), "parcel_id").limit(limit)


def landed_details(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Flat vendor details of the candidates, one row per parcel.

    `outcome` is enriched, no_owner, not_found or malformed; of several answers one with a property is taken.
    """
    details = vendor.flatten_property_detail(answers.join(candidates, "parcel_id", "left_semi"))
    details = U.pick_first(
        details, ["parcel_id"], [F.col(c).desc_nulls_last() for c in details.columns if c != "parcel_id"])
    outcome = F.when(F.col("state") == "malformed", "malformed").when(~F.col("found"), "not_found").when(F.col("owner_name_raw").isNull(), "no_owner").otherwise(
        "enriched")
    return details.withColumn("outcome", outcome).drop("state")


def enrich_parcels(
    parcels: DataFrame, answers: DataFrame, as_of: Column, states: list[str] | None = None,
) -> DataFrame:
    """Parcels after taking owner, type, size and sale from every landed answer for a parcel without owner.

    The limit of `enrichment_candidates` chooses what to buy; what has been bought is merged whole.
    """
    details = landed_details(enrichment_candidates(parcels, states, None), answers).filter("found")
    return U.upsert_parcels(parcels, details.drop("found", "outcome"), "enrich_update", as_of)


def find_contacts(
    candidates: DataFrame, profile_answers: DataFrame, email_answers: DataFrame,
) -> DataFrame:
    return C.resolve_contacts(
        candidates, vendor.flatten_company_profiles(profile_answers), vendor.flatten_email_searches(email_answers))


# Jobs over stored tables ------------------------------------------------------------------------------------

def load_registry(tables: Tables, registry: DataFrame, as_of: Column) -> DataFrame:
    return tables.overwrite("entities", U.upsert_entities(tables.read("entities"), registry, as_of))


def load_addresses(tables: Tables, rows: DataFrame, as_of: Column, policy: str = "address") -> DataFrame:
    """Reload staging from accepted address rows (with file position) and merge it into the parcels."""
    staging = tables.overwrite("parcels_staging", U.last_by_position(accepted(rows), "parcel_id", POSITION))
    return tables.overwrite("parcels", U.upsert_parcels(tables.read("parcels"), staging, policy, as_of))


def resolve_entities(tables: Tables, registry: DataFrame | None, as_of: Column, method: str = "trigram") -> DataFrame:
    """Registry load, unmatched names, best match, new aliases, portfolio recompute."""
    if registry is not None:
        load_registry(tables, registry, as_of)
    found = resolve_names(
        tables.read("parcels"), tables.read("entities"), tables.read("entity_aliases"), method)
    tables.append("entity_aliases", found)
    return recompute_portfolio(tables)


def recompute_portfolio(tables: Tables, mode: str = "merge") -> DataFrame:
    """'merge' keeps old edges, 'rebuild' starts over; both read, merge and store groups, which the returned edges are made from."""
    edges = M.grouped_edges(tables.read("parcels"), tables.read("entities"), tables.read("entity_aliases"))
    if mode == "merge":
        edges = U.merge_edges(tables.read_edges(), edges)
    return tables.overwrite("portfolio_edges", edges)


def refresh_contacts(
    tables: Tables, profile_answers: DataFrame, email_answers: DataFrame, as_of: Column,
) -> DataFrame:
    """Merge every landed answer of a known entity; `contacts.prewarm_candidates` chooses whom to ask for."""
    found = find_contacts(tables.read("entities"), profile_answers, email_answers)
    return tables.overwrite("contacts", U.upsert_contacts(tables.read("contacts"), found, as_of))


def load_roads(tables: Tables, rows: DataFrame, as_of: Column) -> DataFrame:
    """Append the roads that are not in the table yet, by name, state and line."""
    fresh = U.append_new(tables.read("roads"), rows.withColumn("ingested_at", as_of.cast("timestamp")), ["road_key"])
    tables.append("roads", fresh)
    return tables.read("roads")


def load_tax_lots(tables: Tables, lots: DataFrame, as_of: Column) -> DataFrame:
    """Commercial lots fill owner, size and type of known parcels and add new ones."""
    staging = commercial_lots(lots)
    return tables.overwrite("parcels", U.upsert_parcels(tables.read("parcels"), staging, "enrich", as_of))


def enrich_owners(
    tables: Tables, answers: DataFrame, as_of: Column, states: list[str] | None = None,
) -> DataFrame:
    return tables.overwrite("parcels", enrich_parcels(tables.read("parcels"), answers, as_of, states))
