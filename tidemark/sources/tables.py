"""The harness tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a chapter of the book ``source``; each of its lines is a paragraph."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_num"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n").alias("text")
    )


def dialogue_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a chapter; users' turns are dialogue lines, two turns make a paragraph."""
    turns = table(spark, sf_dir, "conversations")
    said = F.concat(F.when(F.col("role") == "user", F.lit("— ")).otherwise(F.lit("")), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    end = F.when(F.col("turn") % 3 == 0, F.lit("\n\n")).otherwise(F.lit("\n"))
    return (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(said, end).alias("line")))).alias("lines"))
        .select(
            F.concat(F.lit("book"), (F.col("conv_id") % 7).cast("string")).alias("book_id"),
            F.col("conv_id").alias("chapter_num"),
            F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"),
        )
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks on a time axis of each user: ``chapter_num, idx, t`` (seconds since the user's first)."""
    events = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(1e6)
    return events.select(
        F.col("user_id").alias("chapter_num"),
        (F.row_number().over(own.orderBy("ts", "event_id")) - 1).alias("idx"),
        "event_id",
        "event_type",
        "value",
        F.round(at - F.min(at).over(own), 3).alias("t"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a signal of 64 samples: ``chapter_num, samples``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chapter_num"), F.col("embedding").alias("samples"))
