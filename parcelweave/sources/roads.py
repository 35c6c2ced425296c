"""Road ways: landed map extracts with an `elements` list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.sources.landed import state_file_filter

EXTRACT = (
    "elements array<struct<type: string, id: bigint, tags: map<string, string>, "
    "geometry: array<struct<lat: double, lon: double>>>>"
)
# Fixed value: road classes of a corridor. Unanchored, so link roads such as 'primary_link' pass as well.
ROAD_CLASSES = "motorway|trunk|primary|secondary|tertiary"


def parse_ways(extracts: DataFrame, state) -> DataFrame:
    """Roads from extract documents: named ways of a corridor class with at least two vertices, each once."""
    way = extracts.select(state.alias("state"), F.explode("elements").alias("e"))
    vertices = F.transform("e.geometry", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    highway = F.try_element_at("e.tags", F.lit("highway"))
    roads = (
        way.filter((F.col("e.type") == "way") & (F.size("e.geometry") >= 2))
        .filter(highway.isNull() | highway.rlike(ROAD_CLASSES))
        .select(F.try_element_at("e.tags", F.lit("name")).alias("road_name"), F.upper("state").alias("state"),
                vertices.alias("geom"))
        .filter("road_name is not null and road_name <> ''")
    )
    key = F.sha2(F.to_json(F.struct("road_name", "state", "geom")), 256)
    return roads.select(
        key.alias("road_key"), "road_name", "state", "geom", F.lit("osm").alias("source")
    ).dropDuplicates(["road_key"])


def read_roads(
    spark: SparkSession, path: str, state: str | None = None, states: list[str] | None = None,
) -> DataFrame:
    """Roads of the extract files in `path`, or of the files of some `states` by the beginning of their names.

    Without `state`, a road's state is the file name up to the first '_' or '.'.

    One extract document is one JSON value and so one task; land one file per state or smaller area.
    """
    docs = spark.read.schema(EXTRACT).option("multiLine", True).option(
        "pathGlobFilter", state_file_filter("", states)).json(path)
    from_name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^_.]+)", 1)
    return parse_ways(docs, F.lit(state) if state else from_name)
