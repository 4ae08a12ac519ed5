"""A corpus from raw documents to token ids: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis.llm import decontaminate, pieces, quality_rules, secret_scan, simhash
from fiscalis.llm.common import materialize, table

#: No SQL states the stages as a whole (suffix arrays, linked fingerprints, the tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text passes the quality rules; each row is judged by its own text, a null one as empty."""
    return quality_rules.verdicts(quality_rules.measures(docs, whole_rows=True)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return simhash.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret and n_chars counted anew. A null text stays null."""
    found = secret_scan.scan(docs, whole_rows=True)
    text = F.when(F.col("row.text").isNotNull(), F.when(F.size("found") > 0, secret_scan.redacted("text", "found")).otherwise(F.col("text")))
    new = found.select("row", text.alias("fresh"))
    put = {"text": F.col("fresh"), "n_chars": F.coalesce(F.length("fresh"), F.lit(0)).cast("long")}
    return new.select(*(put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document with the byte spans of its pieces, and digests of the ids and of the decoded text."""
    found = pieces.encode_pieces(docs)
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
