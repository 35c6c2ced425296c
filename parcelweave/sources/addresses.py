"""Address features: newline-delimited GeoJSON, optionally with a record-separator byte in front of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.functions.geo import in_state_box
from parcelweave.sources.landed import first_reason, state_file_filter, with_position

FEATURE = (
    "type string, id string, geometry struct<type: string, coordinates: array<double>>, "
    "properties struct<id: string, number: string, street: string, postcode: string, postal_city: string, "
    "address_levels: array<struct<value: string, short_code: string>>>, _corrupt string"
)
SUFFIX = ".geojsonseq"


def parse_addresses(lines: DataFrame) -> DataFrame:
    """Staging rows from a `value` column of feature lines; other columns are kept. Bad rows get `reject_reason`."""
    keep = [c for c in lines.columns if c != "value"]
    text = F.regexp_replace(N.trim_space(F.col("value")), "^\x1e", "")
    parsed = lines.select(*keep, text.alias("json")).filter("json <> ''").select(
        *keep, F.from_json("json", FEATURE, {"columnNameOfCorruptRecord": "_corrupt"}).alias("f"))
    point, props = F.col("f.geometry"), F.col("f.properties")
    lon, lat = F.get(point["coordinates"], F.lit(0)), F.get(point["coordinates"], F.lit(1))
    rows = parsed.select(
        *keep,
        N.address_parcel_id(props["id"], F.col("f.id"), lon, lat).alias("parcel_id"),
        N.street_address(props["number"], props["street"]).alias("address"),
        N.city_from_levels(props["address_levels"], props["postal_city"]).alias("city"),
        N.state_from_levels(props["address_levels"]).alias("state"),
        F.coalesce(props["postcode"], F.lit("")).alias("zip"),
        lat.alias("lat"), lon.alias("lon"),
        F.lit("overture").alias("source"),
        point["type"].alias("_geometry_type"), F.col("f._corrupt").alias("_corrupt"),
    )
    reason = first_reason(
        (F.col("_geometry_type").isNull() & F.col("_corrupt").isNotNull(), "unparsable"),
        (F.coalesce("_geometry_type", F.lit("")) != "Point", "not_point"),
        (F.col("lat").isNull() | F.col("lon").isNull(), "bad_coordinates"),
        (F.col("address") == "", "no_address"),
        (F.col("state") == "", "no_state"),
    )
    return rows.withColumn("reject_reason", reason).drop("_geometry_type", "_corrupt")


def read_addresses(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """Staging rows of the address files in `path`, with file position and `reject_reason` (null for good rows)."""
    lines = spark.read.option("pathGlobFilter", state_file_filter(SUFFIX, states)).text(path)
    return parse_addresses(with_position(lines))


def in_state_boxes(df: DataFrame, states: list[str]) -> DataFrame:
    """Rows inside the bounding box of any of the states."""
    hit = F.lit(False)
    for state in states:
        hit = hit | in_state_box(F.col("lat"), F.col("lon"), state)
    return df.filter(hit)

