"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import discard, materialise, release_shuffles, scratch_path

__all__ = ["attach", "discard", "documents", "materialise", "named", "partitions", "release_shuffles", "scratch_path", "staying", "text_or_empty", "whole_row"]

#: A word is a maximal run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot from this share of the rows; so at most HOT_SHARE keys are hot, whatever the data.
HOT_SHARE, HOT_LEAST = 2000, 64


def attach(rows: DataFrame, key: str, table: DataFrame, size: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per value of ``key`` and, as ``size``, its number of rows.

    Hot keys are looked up in a broadcast of at most HOT_SHARE rows; their rows then go on under keys of
    their own, so no key brings many rows to one task. ``rows`` and ``table`` are written tables.
    """
    rest = [c for c in table.columns if c not in (key, size)]
    least = max(HOT_LEAST, rows.count() // HOT_SHARE)
    hot = table.filter(F.col(size) >= least).select(key, *(F.col(c).alias(f"__hot_{c}") for c in rest), F.lit(True).alias("__hot"))
    spread = F.when(F.col("__hot"), F.lit(None)).otherwise(F.col(key))
    salt = F.when(F.col("__hot"), F.xxhash64(*rows.columns)).otherwise(F.lit(0))
    found = rows.join(F.broadcast(hot), key, "left").withColumn("__key", spread).withColumn("__salt", salt)
    cold = table.select(F.col(key).alias("__key"), F.lit(0).cast("long").alias("__salt"), *(F.col(c).alias(f"__cold_{c}") for c in rest))
    return found.join(cold, ["__key", "__salt"], "left").select(
        *rows.columns, *(F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in rest)
    )


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one named ``doc``, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("doc")


def named(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mark``: what decisions on documents need, ``mark`` being a hash of the text; other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("mark"))


def staying(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keep(first)`` names by id and mark, with all their columns as they are."""
    keep = materialise(keep.select(F.col("first.doc_id").alias("id"), F.col("first.mark").alias("mark")), "keep")
    whole = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text_or_empty()).alias("own_mark"))
    kept = whole.join(keep, (F.col("own_mark") == F.col("mark")) & F.col("own_id").eqNullSafe(F.col("id")), "left_semi")
    return kept.select("doc.*")
