"""Company registry files: raw state layouts, the standard layout, and entities from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions import normalize as N
from parcelweave.operators.upsert import last_by_position
from parcelweave.sources.landed import POSITION, with_position

# Columns of the standard registry file.
STANDARD_COLUMNS = [
    "filing_number", "name", "entity_type", "status", "incorporated_date", "registered_agent_name",
    "registered_agent_address", "filing_url",
]

# Raw column names per state. 'address' lists the parts joined into the agent address.
LAYOUTS = {
    "ny": {
        "filing_number": "dos_id", "name": "current_entity_name", "entity_type": "entity_type",
        "date": "initial_dos_filing_date", "agent": "registered_agent_name",
        "address": ["registered_agent_address_1", "registered_agent_city", "registered_agent_state",
                    "registered_agent_zip"],
        "url": "https://apps.dos.ny.gov/publicInquiry/EntityDisplay?DOS_ID=",
    },
    "ia": {
        "filing_number": "corp_number", "name": "legal_name", "entity_type": "corporation_type",
        "date": "effective_date", "agent": "registered_agent",
        "address": ["ra_address_1", "ra_city", "ra_state", "ra_zip"],
        "url": None,
    },
}


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("escape", '"')


def read_raw_registry(spark: SparkSession, path: str) -> DataFrame:
    """A raw state file with its headers in lower case and blanks as underscores."""
    raw = _csv(spark).csv(path)
    return raw.toDF(*["_".join(c.strip().lower().split()) for c in raw.columns])


def standardize_registry(raw: DataFrame, layout: str) -> DataFrame:
    """The eight standard columns from a raw state file; rows without a number or a name are dropped."""
    spec = LAYOUTS[layout]

    def text(name):
        value = N.trim_space(F.col(name)) if name in raw.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(""))

    number = text(spec["filing_number"])
    url = F.concat(F.lit(spec["url"]), number) if spec["url"] else F.lit("")
    return raw.select(
        number.alias("filing_number"), text(spec["name"]).alias("name"),
        N.raw_registry_entity_type(text(spec["entity_type"])).alias("entity_type"),
        F.lit("active").alias("status"), N.date_text(text(spec["date"])).alias("incorporated_date"),
        text(spec["agent"]).alias("registered_agent_name"),
        N.join_parts(", ", *[text(p) for p in spec["address"]]).alias("registered_agent_address"),
        url.alias("filing_url"),
    ).filter("filing_number <> '' and name <> ''")


def write_registry_csv(df: DataFrame, directory: str, state: str) -> str:
    """Write the standard file of one state; line breaks inside values become blanks so that files stay splittable."""
    path = f"{directory.rstrip('/')}/{state.lower()}_entities.csv"
    flat = [F.regexp_replace(F.col(c), r"[\r\n]+", " ").alias(c) for c in STANDARD_COLUMNS]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(path)
    return path


def read_registry(spark: SparkSession, directory: str) -> DataFrame:
    """Entity rows from all `{state}_entities.csv` files or folders in `directory`; the last record per id wins."""
    schema = ", ".join(f"{c} string" for c in STANDARD_COLUMNS)
    rows = with_position(_csv(spark).schema(schema).csv(f"{directory.rstrip('/')}/*_entities.csv"))
    clean = rows.select(
        *[F.coalesce(N.trim_space(F.col(c)), F.lit("")).alias(c) for c in STANDARD_COLUMNS],
        F.upper(F.regexp_extract("_file", r"([^/]+)_entities\.csv", 1)).alias("state"), *POSITION,
    ).filter("filing_number <> '' and name <> ''")
    entities = clean.select(
        N.registry_entity_id(F.col("state"), F.col("filing_number")).alias("entity_id"),
        F.col("name").alias("canonical_name"),
        N.registry_entity_type(F.col("entity_type")).alias("entity_type"),
        N.jurisdiction(F.col("state")).alias("jurisdiction"),
        N.entity_status(F.col("status")).alias("status"),
        N.parse_date(F.col("incorporated_date")).alias("incorporated_at"),
        N.empty_to_null(F.col("registered_agent_name")).alias("registered_agent_name"),
        N.empty_to_null(F.col("registered_agent_address")).alias("registered_agent_address"),
        N.empty_to_null(F.col("filing_url")).alias("sos_filing_url"),
        *POSITION,
    )
    return last_by_position(entities, "entity_id", POSITION)
