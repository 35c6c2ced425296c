"""Tax-lot file of a city: commercial lots with owner, type and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.operators.upsert import first_by_position
from parcelweave.sources.landed import POSITION, accepted, first_reason, with_position

COLUMNS = ["address", "postcode", "ownername", "bbl", "landuse", "bldgclass", "lotarea", "latitude", "longitude",
           "borough"]
# Land-use codes taken as commercial.
COMMERCIAL_LAND_USE = ["4", "5", "6", "7"]


def parse_tax_lots(raw: DataFrame) -> DataFrame:
    """Parcel rows from the raw columns; other lots get `reject_reason`. Extra columns (file position) are kept."""
    text = {c: F.coalesce(N.trim_space(F.col(c)), F.lit("")) for c in COLUMNS}
    lat, lon = N.number(F.col("latitude")), N.number(F.col("longitude"))
    no_point = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon) | (lat == 0) | (lon == 0)
    reason = first_reason(
        (~text["landuse"].isin(COMMERCIAL_LAND_USE), "not_commercial"),
        (no_point, "no_coordinates"),
        ((text["bbl"] == "") | (text["address"] == ""), "no_id_or_address"),
    )
    keep = [c for c in raw.columns if c in POSITION]
    return raw.select(
        F.concat(F.lit("ny_bbl_"), text["bbl"]).alias("parcel_id"), text["address"].alias("address"),
        N.borough_city(text["borough"]).alias("city"), F.lit("NY").alias("state"), text["postcode"].alias("zip"),
        N.lot_acres(N.number(F.col("lotarea"))).alias("lot_size_acres"),
        N.building_class_type(text["bldgclass"]).alias("property_type"),
        N.empty_to_null(text["ownername"]).alias("owner_name_raw"),
        lat.alias("lat"), lon.alias("lon"), F.lit("pluto").alias("source"), *keep, reason.alias("reject_reason"),
    )


def read_tax_lots(spark: SparkSession, path: str) -> DataFrame:
    """All lots of the file with `reject_reason`; only the ten columns needed are parsed out of the wide rows."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    named = {c.strip().lower(): c for c in raw.columns}
    return parse_tax_lots(
        with_position(raw).select(*[F.col(f"`{named[c]}`").alias(c) for c in COLUMNS], *POSITION))


def commercial_lots(lots: DataFrame) -> DataFrame:
    """Good lots, the first record per id."""
    return first_by_position(accepted(lots), "parcel_id", POSITION)
