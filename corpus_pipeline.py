"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are
written as Parquet and read back as the next stage's ``docs``.  All stages but
the last return the columns of their ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkops.llm import language, minhash, mixing, packing, secrets
from parkops.llm.common import materialize, prepare, read
from parkops.llm.queries import tokenizer

#: Below this score a text resembles no learned language.
LEAST_SCORE = 0.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those with no letter (or no text) or in
    none of the languages go.  A missing ``lang`` becomes the predicted one."""
    prepare(spark)
    found = language.identify(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), docs)
    stay = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    lang = F.coalesce(F.col("row.lang"), F.col("lang_pred"))
    return stay.select(*[lang.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id."""
    prepare(spark)
    return minhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark and ``n_chars``, where docs have it, follows.  All documents stay."""
    prepare(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents; one that it takes twice comes twice."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset.  A copy of a document is a
    document of its own: its pieces come once more, in other places."""
    prepare(spark)
    return packing.pack(docs, **tokenizer()).drop("ids")


STAGES = [("language_id", language_stage), ("near_dedup", dedup_stage), ("secret_scan", secret_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]
#: SQL can't express the stages; tests compare each, and run(), with plain Python (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
