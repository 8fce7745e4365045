"""Exact deduplication over a persistent digest index (built-in functions only).

The index is a Parquet table, bucketed and sorted by the digest. A batch is reduced to one row per digest by a
partial aggregation before anything is shuffled; its new digests are found by a sort-merge anti-join on the
buckets and appended, and for those the index knows, a row with the batch's number of copies and largest id is
appended too. Reading adds these up within the buckets, so sizes stay right however many batches came.

Defined cases: a null text counts as empty; texts are equal when their bytes are; of equal texts in a
batch the largest ``doc_id`` stays (null ids lose to any other), and a text of an earlier batch keeps that one's
row; rows that repeat both id and text are one decision, ``kept`` on each of them, and ``deduplicate`` returns
one of them; a batch that comes again under its name changes nothing; an empty table gives an empty result; other columns pass through ``deduplicate`` untouched whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import discard, materialise, partitions, scratch_path, text_or_empty, whole_row

#: A digest is hot from this share of a batch's rows; so at most HOT_SHARE digests are hot.
HOT_SHARE, HOT_LEAST = 2000, 64


def digest(text: str = "text"):
    return F.sha2(text_or_empty(text).cast("binary"), 256)


class DigestIndex:
    """What is known of the texts seen so far, kept in the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """Open the index at ``path``, or make it there. ``buckets`` must be the same at each opening."""
        self.spark, self.path = spark, path or scratch_path(spark, "digests")
        self.buckets = buckets or partitions(spark)
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, id BIGINT, n BIGINT, is_first BOOLEAN, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def forget(self, files: bool = False) -> None:
        """Take the index out of the session's catalog, and its files from their folder if asked to."""
        table = self.spark.table(self.table)
        table.scratch = self.path
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if files:
            discard(table)

    def read(self) -> DataFrame:
        """``digest, keep_id, last_id, group_size``: the row that stayed at first, the largest id, and all copies of each text."""
        return (
            self.spark.table(self.table).groupBy("digest")
            .agg(F.max(F.when(F.col("is_first"), F.col("id"))).alias("keep_id"), F.max("id").alias("last_id"), F.sum("n").alias("group_size"))
        )

    def append(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Add the texts of ``digests(doc_id, digest)``; returns the new ones, one row per text: digest, id, n.

        A batch with a name is added once: if the index has it already, as after a driver that was lost behind the
        insert, nothing is added and the texts that were new then are returned. Without a name each call is a batch.
        """
        known = self.spark.table(self.table)
        if batch is not None and known.filter(F.col("batch") == batch).limit(1).count():
            return known.filter((F.col("batch") == batch) & F.col("is_first")).select("digest", "id", "n")
        # Written first: the optimizer would push an anti-join below the partial aggregation.
        own = materialise(digests.groupBy("digest").agg(F.max("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "batch")
        seen = known.filter("is_first").select("digest")
        new = materialise(own.hint("merge").join(seen, "digest", "left_anti"), "new_digests")
        again = own.hint("merge").join(seen, "digest", "left_semi")
        rows = new.withColumn("is_first", F.lit(True)).unionByName(again.withColumn("is_first", F.lit(False)))
        rows = materialise(rows.withColumn("batch", F.lit(batch or uuid.uuid4().hex)), "index_rows")
        # One insert, committed as one: a batch is in the index or it isn't.
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        discard(own, rows)
        return new

    def resolve(self, digests: DataFrame, total: int, latest: bool = False) -> DataFrame:
        """``digests`` with ``keep_id`` (with ``latest``, the largest id) and ``group_size`` of each row's text.

        Hot digests (at most HOT_SHARE of them, whatever the data) are looked up in a broadcast; their rows
        then go on under keys of their own, so no key brings many rows to one task.
        """
        index = self.read().select("digest", F.col("last_id" if latest else "keep_id").alias("keep_id"), "group_size")
        hot = (
            digests.groupBy("digest").agg(F.count(F.lit(1)).alias("here")).filter(F.col("here") >= max(HOT_LEAST, total // HOT_SHARE))
            .join(index, "digest").select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
        )
        own = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        rows = digests.join(F.broadcast(materialise(hot, "hot_digests")), "digest", "left").withColumn(
            "key", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(own)
        )
        return rows.join(index.withColumnRenamed("digest", "key"), "key", "left").select(
            "doc_id",
            "digest",
            F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("hot_size", "group_size").alias("group_size"),
        )


def classes(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    With an ``index`` that holds earlier batches, a text seen before keeps the earlier row's id. Without one,
    ``docs`` goes into a new index in so many ``batches``, and the largest id of all stays. ``batch`` names
    ``docs`` in the index, so that a call that is repeated gives the same result.
    """
    own = index or DigestIndex(docs.sparkSession)
    digests = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest")), "batch_digests")
    for k in range(batches):
        own.append(digests if batches == 1 else digests.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), batch and f"{batch}/{k}")
    found = own.resolve(digests, digests.count(), latest=index is None).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    found = materialise(found, "classes")
    discard(digests)
    if index is None:
        own.forget(files=True)
    return found


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keep = classes(docs, index, batches).filter("kept").select("doc_id", "text_sha256")
    same = keep.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    # The id alone would do if it were unique; the digest keeps apart rows that share one.
    whole = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("own_id"), digest().alias("own_digest"))
    rows = whole.join(keep.distinct(), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_digest") == F.col("text_sha256")), "left_semi")
    return (rows.dropDuplicates(["own_digest"]) if same else rows).select("doc.*")
