"""Column expressions on hand-made values."""

import datetime

import pytest
from pyspark.sql import functions as F

from parcelweave.functions import geo, text
from parcelweave.functions import normalize as N
from parcelweave.functions.token_set import token_set_score


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("a, b, expected", [
    ("word", "two words", 0.3636363744735718), ("", "", 0.0), ("Same Name", "same  name!", 1.0), ("abc", "xyz", 0.0),
])
def test_similarity(spark, a, b, expected):
    assert value(spark, text.similarity(F.lit(a), F.lit(b))) == expected
    assert value(spark, text.similarity(F.lit(b), F.lit(a))) == expected


def test_trigrams_pad_each_word(spark):
    assert value(spark, text.trigrams(F.lit("a-bc"))) == ["  a", " a ", "  b", " bc", "bc "]
    codes = value(spark, text.trigram_codes(F.lit("Ringe ringe")))
    assert len(codes) == len(set(codes)) == 6


def test_words(spark):
    assert value(spark, text.words(F.lit("US-1 and the 4th Main-Street"))) == [
        "us", "-1", "4th", "main-street", "main", "street"]


@pytest.mark.parametrize("word, stem", [
    ("streets", "street"), ("avenue", "avenu"), ("running", "run"), ("hopping", "hop"), ("hoped", "hope"),
    ("relational", "relat"), ("cries", "cri"), ("ties", "tie"), ("dying", "die"), ("happily", "happili"),
    ("controlled", "control"), ("generously", "generous"), ("knightly", "knight"), ("saying", "say"), ("by", "by"),
])
def test_stems(word, stem):
    assert text.stem_word(word) == stem


@pytest.mark.parametrize("a, b, score", [
    ("abc llc", "abc llc", 100), ("llc", "abc llc", 100), ("abc", "", 0), ("abcd", "abce", 75),
    ("john smith", "smith jon", 95),
])
def test_token_set_score(a, b, score):
    keys = [" ".join(sorted(set(x.split()))) for x in (a, b)]
    assert token_set_score(*keys) == score


@pytest.mark.parametrize("raw, kind", [
    ("Domestic LLC", "LLC"), ("Limited Liability Co", "LLC"), ("Business Trust", "Trust"), ("Corp.", "Corporation"),
    ("Incorporated", "Corporation"), ("Sole Proprietor", "Individual"), ("Partnership", "Unknown"), (None, "Unknown"),
])
def test_registry_entity_type(spark, raw, kind):
    assert value(spark, N.registry_entity_type(F.lit(raw))) == kind


@pytest.mark.parametrize("raw, kind", [
    ("Limited Partnership", "Corporation"), ("SMITH LP", "Corporation"), ("Savings Bank", "Corporation"),
    ("Trust Company", "Trust"),
])
def test_raw_registry_entity_type(spark, raw, kind):
    assert value(spark, N.raw_registry_entity_type(F.lit(raw))) == kind


@pytest.mark.parametrize("kind, sub, expected", [
    ("COMMERCIAL", "RETAIL", "Retail"), ("COMMERCIAL", "OFFICE BUILDING", "Office"), ("COMMERCIAL", None, "Retail"),
    ("VACANT", None, "Land"), ("FLEX SPACE", None, "Industrial"), (None, None, "Unknown"),
])
def test_vendor_property_type(spark, kind, sub, expected):
    assert value(spark, N.vendor_property_type(F.lit(kind), F.lit(sub))) == expected


@pytest.mark.parametrize("one, two, acres", [
    (43560.0, None, 1.0), (43560.0, 2.5, 2.5), (43560.0, 20000.0, 1.0), (43560.0, 0.0, 1.0), (0.0, None, None),
])
def test_vendor_lot_acres(spark, one, two, acres):
    cast = lambda x: F.lit(x).cast("double")
    assert value(spark, N.vendor_lot_acres(cast(one), cast(two))) == acres


@pytest.mark.parametrize("road, number", [
    ("Route 1", "1"), ("US Route 9W", "9W"), ("4th Avenue", None), ("Broadway", None), ("I-95", "95"),
])
def test_route_number(spark, road, number):
    assert value(spark, N.route_number(F.lit(road))) == number


def test_corridor_and_address_split(spark):
    assert value(spark, N.corridor_state(F.lit("Route 1, new jersey"))) == "NJ"
    assert value(spark, N.corridor_state(F.lit("Broadway"))) == ""
    assert value(spark, N.corridor_state(F.lit("Broadway,  new york "))) == "NY"
    assert value(spark, N.corridor_state(F.lit("Broadway, xx"))) == "XX"
    assert value(spark, N.corridor_road(F.lit(" Broadway , NY"))) == "Broadway"
    assert value(spark, N.lookup_street(F.lit("1240 Highway 9, Woodbridge NJ"))) == "1240 Highway 9"
    assert value(spark, N.lookup_city(F.lit("1240 Highway 9, Woodbridge NJ"))) == "Woodbridge"
    assert value(spark, N.lookup_city(F.lit("1240 Highway 9"))) == ""


def test_dates_and_domain(spark):
    assert value(spark, N.parse_date(F.lit("03/15/2019"))) == datetime.date(2019, 3, 15)
    assert value(spark, N.parse_date(F.lit("2019-03-15T00:00"))) == datetime.date(2019, 3, 15)
    assert value(spark, N.parse_date(F.lit(""))) is None
    assert value(spark, N.company_domain(F.lit("Princeton Holdings LLC"))) == "preton.com"


def test_freshness(spark):
    as_of = F.lit("2024-01-02 00:00:01").cast("timestamp")
    stale = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert value(spark, N.freshness_secs(stale, as_of)) == 86_401
    assert value(spark, N.data_freshness(stale, as_of)) == "stale"
    assert value(spark, N.data_freshness(F.lit(None).cast("timestamp"), as_of)) == "fresh"


def test_distance_to_segment(spark):
    lat, lon = F.lit(40.0), F.lit(-74.0)
    m_lat, m_lon = geo.metres_per_degree(lat)
    d2 = geo.distance_sq_to_segment(
        lat, lon, m_lat, m_lon, F.lit(40.001), F.lit(-74.01), F.lit(40.001), F.lit(-73.99))
    # One thousandth of a degree of latitude at 40 degrees north is 111.035 m on the ellipsoid.
    assert abs(value(spark, F.sqrt(d2)) - 111.035) < 0.01


def test_entity_status(spark):
    known = {"Active": "active", "good standing": "active", "DISSOLVED": "dissolved", "cancelled": "dissolved",
             "Suspended": "suspended", "revoked": "suspended", "other": "unknown", None: "unknown"}
    for text, status in known.items():
        assert value(spark, N.entity_status(F.lit(text).cast("string"))) == status
