"""Events as recordings: a user is a chapter, an event a spoken word, an hour a second.

Word i starts at its event's time and lasts half the gap to the next one, half a second at most; the rest
of a gap is silence. Boards hold seven words; every fifth event of type ``purchase`` is an insert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import round3
from tidemark.sources.tables import marks

HOP_S, BOARD = 0.01, 7


def word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chapter_num, token_idx, word, start, end, matched."""
    order = Window.partitionBy("chapter_num").orderBy("idx")
    m = marks(spark, sf_dir).withColumn("start", round3(F.col("t") / 3600))
    gap = F.coalesce(F.lead("start").over(order) - F.col("start"), F.lit(1.0))
    return m.select(
        "chapter_num", F.col("idx").alias("token_idx"), F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("word"), "start",
        round3(F.col("start") + F.least(gap / 2, F.lit(0.5))).alias("end"), (F.col("event_id") % 3 != 0).alias("matched"),
    )


def stats(words: DataFrame) -> DataFrame:
    duration = F.round(F.max("end") + 1, 3)
    return words.groupBy("chapter_num").agg(duration.alias("duration"), F.floor(duration / HOP_S).cast("int").alias("n_frames"), F.count(F.lit(1)).cast("int").alias("token_count"))


def silence(words: DataFrame) -> DataFrame:
    """Gaps between words: start, end."""
    order = Window.partitionBy("chapter_num").orderBy("token_idx")
    return words.select("chapter_num", F.col("end").alias("start"), F.lead("start").over(order).alias("end")).filter("end > start")


def islands(words: DataFrame) -> DataFrame:
    frame = lambda c: F.round(F.col(c) / HOP_S).cast("int")
    return silence(words).select("chapter_num", frame("start").alias("first_frame"), frame("end").alias("end_frame")).filter("end_frame > first_frame")


def segments(words: DataFrame, size: int = 5) -> DataFrame:
    """Utterances of five words: seg_id, start, end, text."""
    return words.groupBy("chapter_num", F.floor(F.col("token_idx") / size).cast("int").alias("seg_id")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "word"))), lambda x: x["word"]), " ").alias("text")
    )


def layouts(words: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).cast("int")
    return words.groupBy("chapter_num").agg(n.alias("token_count")).select(
        "chapter_num", "token_count", F.when(F.col("token_count") > BOARD, F.sequence(F.lit(BOARD), F.col("token_count") - 1, F.lit(BOARD))).otherwise(F.array().cast("array<int>")).alias("breaks")
    )


def book_boards(words: DataFrame) -> DataFrame:
    """Boards with their texts and the times of their first and last words."""
    return words.groupBy("chapter_num", F.floor(F.col("token_idx") / BOARD).cast("int").alias("b")).agg(
        F.min("token_idx").alias("lo"), (F.max("token_idx") + 1).alias("hi"), F.min_by("start", "token_idx").alias("first_start"), F.max_by("end", "token_idx").alias("last_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "word"))), lambda x: x["word"]), " ").alias("text"), F.bool_and("matched").alias("dialogue"),
    ).drop("b")


def inserts(words: DataFrame) -> DataFrame:
    """What is heard before every fourth board: anchor, nth, start_time, end_time, heard, text, edited, typed, breaks, words.

    Every other one has word times; who types an insert anew keeps one of the words heard.
    """
    at = words.filter(f"token_idx % {4 * BOARD} = 0")
    start, end = F.greatest(F.lit(0.0), F.col("start") - 0.4), F.col("start")
    mid = round3((start + end) / 2)
    said = lambda w, s, e: F.struct(w.alias("w"), s.alias("s"), e.alias("e"))
    return at.select(
        "chapter_num", F.col("token_idx").alias("anchor"), F.lit(0).alias("nth"), start.alias("start_time"), end.alias("end_time"),
        F.concat(F.lit("heard "), "word").alias("heard"), F.lit(None).cast("string").alias("text"), F.col("matched").alias("edited"),
        F.when(F.col("matched"), F.concat(F.lit("typed "), "word", F.lit(" of a user"))).alias("typed"), F.array(F.lit(2)).alias("breaks"),
        F.when(F.col("token_idx") % (8 * BOARD) == 0, F.array(said(F.lit("heard"), start, mid), said(F.col("word"), mid, end))).alias("words"),
    )
