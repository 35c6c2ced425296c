"""Products over stored tables: the answers, and a log row for each owner or profile that was served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from parcelweave.plans import discovery, profiles
from parcelweave.session import materialize
from parcelweave.sources.tables import Tables

# Tool names in the query log.
DISCOVERY_TOOL, PROFILE_TOOL = "investor_discovery", "owner_profile"


def log_discovery(tables: Tables, results: DataFrame) -> None:
    tables.append_query_log(DISCOVERY_TOOL, discovery.served_owners(results))


def log_profiles(tables: Tables, results: DataFrame, as_of: Column) -> None:
    tables.append_query_log(PROFILE_TOOL, profiles.served_profiles(results, as_of))


def serve_discovery(tables: Tables, requests: DataFrame, as_of: Column, **options) -> DataFrame:
    """Discovery results, computed once, logged and returned."""
    results = materialize(discovery.discover(requests, tables.read_all(), as_of, **options), "served-discovery")
    log_discovery(tables, results)
    return results


def serve_profiles(tables: Tables, ids: DataFrame, as_of: Column) -> DataFrame:
    """Profiles, computed once, logged and returned; their lists are the flat tables of `profiles`."""
    results = materialize(profiles.profiles(ids, tables.read_all(), as_of), "served-profiles")
    log_profiles(tables, results, as_of)
    return results
