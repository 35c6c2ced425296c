"""Landed vendor answers: property detail, company profile and e-mail search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.operators.upsert import pick_first

PROPERTY_DETAIL = (
    "property array<struct<summary: struct<proptype: string, propSubType: string>, "
    "lot: struct<lotsize1: double, lotsize2: double>, "
    "building: struct<size: struct<bldgsize: double, grosssize: double>>, "
    "sale: struct<saleRecDate: string, salesearchdate: string, saleamt: double>, "
    "owner: struct<owner1: struct<fullname: string, lastname: string, firstname: string>>>>"
)
COMPANY_PROFILE = "name string, people_also_viewed array<struct<name: string, title: string>>"
EMAIL_SEARCH = (
    "data struct<emails: array<struct<value: string, type: string, confidence: double, first_name: string, "
    "last_name: string, position: string>>>"
)


# Where each kind of answer holds its list.
LISTS = {"property": "$.property", "profile": "$.people_also_viewed", "email": "$.data.emails"}


def with_parsed(answers: DataFrame) -> DataFrame:
    """Answers with their parsed JSON as `_parsed`, a column of its own, so that it is parsed once for all that use it."""
    return answers.withColumn("_parsed", F.try_parse_json("response"))


def _state() -> Column:
    """The state of an answer `with_parsed`. JSON is an object if it begins with a brace after JSON's white space."""
    blank = F.coalesce(N.trim_space(F.col("response")), F.lit("")) == ""
    return F.when(blank, "empty").when(F.col("_parsed").isNull(), "malformed").when(
        F.is_variant_null("_parsed"), "null").when(
        F.ltrim("response", F.lit(" \t\r\n")).startswith("{"), "answered").otherwise("mistyped")


def with_state(answers: DataFrame) -> DataFrame:
    """Answers with `state` beside `_parsed`: 'empty', 'malformed' (no JSON, such as an error page), 'null', 'mistyped'
    (JSON, but no object) or 'answered'.

    The kind of the column `response` is looked at before any of its fields.
    """
    return with_parsed(answers).withColumn("state", _state())


def answer_metrics(**answers: DataFrame) -> DataFrame:
    """(kind, outcome, n): how many answers of each kind came in which state.

    An answer whose list (`LISTS`) is something else is 'wrong_list'; its other fields are used.
    """
    def outcome(kind: str) -> Column:
        # Missing or an array, or JSON null; only what is neither an array nor missing is looked at twice.
        listed = F.try_variant_get("_parsed", LISTS[kind], "array<variant>").isNotNull()
        other = F.try_variant_get("_parsed", LISTS[kind], "variant")
        wrong = (F.col("state") == "answered") & ~listed & other.isNotNull() & ~F.is_variant_null(other)
        return F.when(wrong, "wrong_list").otherwise(F.col("state"))

    counted = [with_state(df.select("response")).groupBy(outcome(kind).alias("outcome")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(kind).alias("kind"), "outcome", "n") for kind, df in answers.items()]
    return reduce(DataFrame.unionByName, counted)


def _read(answers: DataFrame, schema: str) -> DataFrame:
    """Answers with `state` and their fields as `_r`, null unless the answer is a JSON object; read once for all fields."""
    return with_state(answers).drop("_parsed").withColumn(
        "_r", F.when(F.col("state") == "answered", F.from_json("response", schema)))


def flatten_property_detail(answers: DataFrame) -> DataFrame:
    """(parcel_id, response) → enrichment attributes and the answer's `state`; `found` is false without a property."""
    p = F.get("_r.property", F.lit(0))
    owner = p["owner"]["owner1"]
    return _read(answers, PROPERTY_DETAIL).select(
        "parcel_id", p.isNotNull().alias("found"), "state",
        N.vendor_owner_name(owner["fullname"], owner["firstname"], owner["lastname"]).alias("owner_name_raw"),
        N.vendor_property_type(p["summary"]["proptype"], p["summary"]["propSubType"]).alias("property_type"),
        N.vendor_lot_acres(p["lot"]["lotsize1"], p["lot"]["lotsize2"]).alias("lot_size_acres"),
        F.coalesce(p["building"]["size"]["bldgsize"], p["building"]["size"]["grosssize"]).alias("building_sqft"),
        N.parse_date(F.coalesce(p["sale"]["saleRecDate"], p["sale"]["salesearchdate"])).alias("last_sale_date"),
        p["sale"]["saleamt"].alias("last_sale_price"),
    )


def flatten_company_profiles(answers: DataFrame) -> DataFrame:
    """(entity_id, response) → person and company name; one row per entity."""
    person = F.get("_r.people_also_viewed", F.lit(0))
    rows = _read(answers, COMPANY_PROFILE).select("entity_id", F.col("_r").alias("r"), person.alias("p")).filter("r is not null").select(
        "entity_id", F.col("p.name").alias("person_name"), F.col("p.title").alias("person_title"),
        F.col("r.name").alias("company_name"))
    return pick_first(rows, ["entity_id"], [F.col(c).asc_nulls_last() for c in rows.columns[1:]])


def flatten_email_searches(answers: DataFrame) -> DataFrame:
    """(entity_id, response) → first e-mail found; entities without one have no row."""
    top = F.get("_r.data.emails", F.lit(0))
    rows = _read(answers, EMAIL_SEARCH).select("entity_id", top.alias("m")).filter("m is not null").select(
        "entity_id", "m.first_name", "m.last_name", "m.position", F.col("m.value").alias("email"),
        F.col("m.confidence").alias("email_confidence"))
    return pick_first(rows, ["entity_id"], [F.col("email_confidence").desc_nulls_last(), F.col("email")])
