"""Normalising column expressions used by the readers and products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SQFT_PER_ACRE = 43_560
STALE_AFTER_SECONDS = 86_400

# Full state name to postal code.
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO",
    "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA",
    "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN",
    "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC",
    "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA",
    "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX",
    "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV",
    "WISCONSIN": "WI", "WYOMING": "WY",
}

# Registry status text to entity status.
STATUS_MAP = {
    "active": "active", "good standing": "active", "dissolved": "dissolved", "cancelled": "dissolved",
    "suspended": "suspended", "revoked": "suspended",
}

# First letter of the building class to property type.
BUILDING_CLASS_TYPES = {
    "O": "Office", "K": "Retail", "L": "Retail", "E": "Industrial", "F": "Industrial", "G": "Industrial",
    "H": "Hospitality", "D": "Multifamily", "C": "Multifamily", "R": "Multifamily", "S": "Mixed-Use",
}

# Borough code to city.
BOROUGH_CITIES = {"MN": "Manhattan", "BX": "Bronx", "BK": "Brooklyn", "QN": "Queens", "SI": "Staten Island"}

# Substrings deciding a type; the first rule that hits wins.
REGISTRY_TYPE_RULES = [
    ("LLC", ["llc", "limited liability"]),
    ("Trust", ["trust"]),
    ("Corporation", ["corp", "inc"]),
    ("Individual", ["individual", "sole prop"]),
]
RAW_REGISTRY_TYPE_RULES = [
    ("LLC", ["llc", "limited liability"]),
    ("Trust", ["trust"]),
    ("Corporation", ["partnership", " lp", " llp"]),
    ("Corporation", ["corp", "inc", "company", "bank"]),
    ("Individual", ["individual", "sole prop"]),
]
VENDOR_TYPE_RULES = [
    ("Retail", ["retail", "store", "shopping"]),
    ("Office", ["office"]),
    ("Industrial", ["industrial", "warehouse", "flex"]),
    ("Multifamily", ["multifamily", "apartment"]),
    ("Mixed-Use", ["mixed"]),
    ("Land", ["land", "vacant", "lot"]),
    ("Hospitality", ["hotel", "motel", "hospitality"]),
    ("Retail", ["commercial"]),
]

# Words dropped from a company name before guessing its domain.
COMPANY_WORDS = ["llc", "inc", "corp", "ltd", "trust", "holdings", "group", "partners", "capital"]


def trim_space(c: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_space(c), F.lit(""))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _first_rule(text: Column, rules) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def hit(words):
        return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])

    out = F.when(hit(rules[0][1]), rules[0][0])
    for name, words in rules[1:]:
        out = out.when(hit(words), name)
    return out.otherwise("Unknown")


# Address features -------------------------------------------------------------------------------------------

def street_address(number: Column, street: Column) -> Column:
    return F.concat_ws(" ", empty_to_null(number), empty_to_null(street))


def state_from_levels(levels: Column) -> Column:
    top = F.get(levels, F.lit(0))
    code = F.regexp_replace(empty_to_null(top["short_code"]), "^US-", "")
    named = F.upper(F.substring(empty_to_null(top["value"]), 1, 2))
    return F.coalesce(code, named, F.lit(""))


def city_from_levels(levels: Column, postal_city: Column) -> Column:
    return F.coalesce(F.try_element_at(levels, F.lit(-1))["value"], postal_city, F.lit(""))


def address_parcel_id(property_id: Column, feature_id: Column, lon: Column, lat: Column) -> Column:
    return F.coalesce(property_id, feature_id, F.format_string("ov_%.6f_%.6f", lon, lat))


# Registry ---------------------------------------------------------------------------------------------------

def registry_entity_type(text: Column) -> Column:
    return _first_rule(text, REGISTRY_TYPE_RULES)


def raw_registry_entity_type(text: Column) -> Column:
    return _first_rule(text, RAW_REGISTRY_TYPE_RULES)


def entity_status(text: Column) -> Column:
    return F.coalesce(lookup(STATUS_MAP, F.lower(F.coalesce(text, F.lit("")))), F.lit("unknown"))


def registry_entity_id(state: Column, filing_number: Column) -> Column:
    return F.concat(F.lit("sos_"), F.lower(state), F.lit("_"), filing_number)


def jurisdiction(state: Column) -> Column:
    return F.concat(F.lit("US-"), F.upper(state))


def date_text(c: Column) -> Column:
    """The first ten characters, which drops a time part."""
    return F.substring(F.coalesce(c, F.lit("")), 1, 10)


def parse_date(c: Column) -> Column:
    text = date_text(c)
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "MM/dd/yyyy"))


def join_parts(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[F.when(trim_space(p) != "", p) for p in parts])


# Tax lots and vendor detail ---------------------------------------------------------------------------------

def building_class_type(c: Column) -> Column:
    return F.coalesce(lookup(BUILDING_CLASS_TYPES, F.upper(F.substring(c, 1, 1))), F.lit("Unknown"))


def borough_city(c: Column) -> Column:
    return F.coalesce(lookup(BOROUGH_CITIES, c), F.lit("New York"))


def number(c: Column) -> Column:
    return trim_space(c).try_cast("double")


def lot_acres(sqft: Column) -> Column:
    return F.when(~F.isnan(sqft) & (sqft > 0), sqft / SQFT_PER_ACRE)


def vendor_property_type(kind: Column, subkind: Column) -> Column:
    return _first_rule(F.concat_ws(" ", kind, subkind), VENDOR_TYPE_RULES)


def vendor_lot_acres(lotsize1: Column, lotsize2: Column) -> Column:
    return F.when((lotsize2 != 0) & (lotsize2 < 10_000), lotsize2).when(lotsize1 > 0, lotsize1 / SQFT_PER_ACRE)


def vendor_owner_name(fullname: Column, firstname: Column, lastname: Column) -> Column:
    two_part = F.concat_ws(" ", empty_to_null(firstname), empty_to_null(lastname))
    return F.coalesce(blank_to_null(fullname), blank_to_null(two_part))


def vendor_match_key(city: Column, state: Column, zip_code: Column) -> Column:
    return F.concat_ws(" ", empty_to_null(city), empty_to_null(state), empty_to_null(zip_code))


def company_domain(name: Column) -> Column:
    words = "|".join(COMPANY_WORDS)
    dropped = F.regexp_replace(F.lower(name), rf"\s*({words})\s*", "")
    return F.concat(F.regexp_replace(dropped, "[^a-z0-9]", ""), F.lit(".com"))


# Names, requests, results -----------------------------------------------------------------------------------

def name_key(c: Column) -> Column:
    """Key of the exact owner match: upper case, blanks stripped at both ends."""
    return F.upper(F.trim(c))


def corridor_road(corridor: Column) -> Column:
    return trim_space(F.get(F.split(corridor, ",", -1), F.lit(0)))


def corridor_state(corridor: Column) -> Column:
    raw = F.upper(trim_space(F.coalesce(F.get(F.split(corridor, ",", -1), F.lit(1)), F.lit(""))))
    return F.coalesce(lookup(STATE_CODES, raw), raw)


def route_number(road: Column) -> Column:
    """The first number standing as a word, with at most one letter behind it; null for '4th Avenue'."""
    return empty_to_null(F.regexp_extract(road, r"(?i)\b(\d+[A-Z]?)\b", 1))


def _address_part(address: Column, index: int) -> Column:
    parts = F.filter(F.transform(F.split(address, ",", -1), trim_space), lambda p: p != "")
    return F.get(parts, F.lit(index))


def lookup_street(address: Column) -> Column:
    return F.coalesce(_address_part(address, 0), address)


def lookup_city(address: Column) -> Column:
    part = F.coalesce(_address_part(address, 1), F.lit(""))
    return trim_space(F.regexp_replace(part, r"\s+[A-Za-z]{2}$", ""))


def freshness_secs(updated_at: Column, as_of: Column) -> Column:
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(updated_at.cast("timestamp"))
    return F.coalesce(age, F.lit(0)).cast("long")


def data_freshness(updated_at: Column, as_of: Column) -> Column:
    return F.when(freshness_secs(updated_at, as_of) > STALE_AFTER_SECONDS, "stale").otherwise("fresh")


def property_struct() -> Column:
    """The 13-field property record of the results: empty text for missing text, null for missing numbers."""
    def text(name):
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    return F.struct(
        text("address"), text("city"), text("state"), text("zip"), F.col("lot_size_acres"),
        F.col("building_sqft"), text("property_type"), F.col("last_sale_price"),
        F.date_format("last_sale_date", "yyyy-MM-dd").alias("last_sale_date"),
        F.date_format("loan_maturity", "yyyy-MM-dd").alias("loan_maturity"),
        text("parcel_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
    )


def contact_struct(prefix: str = "contact_") -> Column:
    c = lambda name: F.col(prefix + name)
    return F.when(
        c("found"),
        F.struct(
            F.coalesce(c("name"), F.lit("")).alias("name"), F.coalesce(c("role"), F.lit("")).alias("role"),
            c("email").alias("email"), c("phone").alias("phone"),
            F.coalesce(c("confidence"), F.lit(0.0)).alias("confidence"),
            F.coalesce(c("source"), F.lit("unknown")).alias("source"),
        ),
    )
