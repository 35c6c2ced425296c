"""A corpus from raw documents to training sequences: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.llm import language, mixing, packing, simhash, substrings
from parcelweave.llm.frames import carried, materialize, restored, table

# SQL has no tokenizer, fingerprints or language profiles; the stages are tested against plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a missing language is filled in, with `und` where no profile could be learned."""
    train = docs.select("doc_id", "text", "lang").where(~language.held_out())
    profiles = language.learn_profiles(train, "doc_id", "text", "lang")
    slim = docs.select("text", carried(docs, "text", name="_doc"))
    known = language.predict(slim, profiles, with_text=True).where("has_letter")
    own = {"text": F.col("text"), "lang": F.coalesce(F.col("_doc")["lang"], F.col("lang_pred"))}
    return restored(known, docs, {}, name="_doc", **own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document goes only if nothing of it is left."""
    slim = docs.select("doc_id", "text", carried(docs, "text", name="_doc"))
    cut = substrings.remove_repeats(slim, as_is=True).where("n_removed = 0 OR n_removed < n_words")
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return restored(cut, docs, {}, name="_doc", **own)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each taken document, once for each time it is taken."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mixing_sources),
    ("packing", packing_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
