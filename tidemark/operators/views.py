"""Review, overview and export views over boards (book_id, chapter_num, chunk_id, text, chunk_type, start_time, end_time, cut_key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.intervals import meeting, next_after

KEYS = ["book_id", "chapter_num"]


def _joined(boards: DataFrame, part, between: str, name: str) -> DataFrame:
    """Per chapter, the non-null parts of its boards in order, joined."""
    rows = boards.select(*KEYS, "chunk_id", part.alias("part")).filter("part is not null")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "part")))
    return rows.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), between).alias(name))


def srt(boards: DataFrame) -> DataFrame:
    """Numbered subtitle cues with a blank line between."""
    cue = F.concat(F.col("chunk_id").cast("string"), F.lit("\n"), X.srt_time(F.col("start_time")), F.lit(" --> "), X.srt_time(F.col("end_time")), F.lit("\n"), X.srt_text(F.col("text")), F.lit("\n"))
    return _joined(boards, cue, "\n", "srt")


def slashed(boards: DataFrame) -> DataFrame:
    """Texts with ``///`` between boards; blank ones left out."""
    own = X.strip(F.col("text"))
    return _joined(boards, F.when(own != "", own), "\n///\n", "slashed")


def labels(boards: DataFrame) -> DataFrame:
    """A label track: start, end and a label, tab-separated."""
    name = X.strip(F.regexp_replace(X.label(F.col("text"), F.col("chunk_type"), F.col("chunk_id")), "[\\t\\r\\n]+", " "))
    line = F.concat(F.format_string("%.6f", "start_time"), F.lit("\t"), F.format_string("%.6f", "end_time"), F.lit("\t"), name)
    return _joined(boards, line, "\n", "labels")


def slices(boards: DataFrame) -> DataFrame:
    """What to cut from the recording: index, start, length of at least 0.1 s, and a file name."""
    name = F.concat(F.lpad(F.col("chunk_id").cast("string"), 3, "0"), F.lit(" - "), X.file_name(F.col("text")), F.lit(".mp3"))
    return boards.select(*KEYS, "chunk_id", "start_time", F.round(F.greatest(F.lit(0.1), F.col("end_time") - F.col("start_time")), 3).alias("length"), name.alias("file"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each board; a board is known by its cut key, or where there is none by its number."""
    board = F.coalesce(F.col("cut_key"), F.concat(F.lit("#"), F.col("chunk_id").cast("string")))
    last = Window.partitionBy("chapter_num", "board").orderBy(F.col("seen_at").desc(), F.col("review_id").desc())
    return reviews.withColumn("board", board).withColumn("rank", F.row_number().over(last)).filter("rank = 1").drop("rank", "board")


def review_stats(reviews: DataFrame) -> DataFrame:
    """total, correct, incorrect, accuracy in per cent (100 where nothing was reviewed)."""
    total, right = F.count(F.lit(1)), F.count_if(F.col("is_correct"))
    return reviews.agg(
        total.alias("total"), right.alias("correct"), (total - right).alias("incorrect"), F.coalesce(F.round(F.try_divide(right * 100.0, total), 1), F.lit(100.0)).alias("accuracy")
    )


def status_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def last_reviews(reviews: DataFrame, n: int = 10) -> DataFrame:
    return reviews.orderBy(F.col("seen_at").desc(), F.col("review_id").desc()).limit(n)


def unreviewed(boards: DataFrame, reviews: DataFrame) -> DataFrame:
    """Boards that no review names, by cut key or by number."""
    by_key = reviews.filter("cut_key is not null").select("chapter_num", "cut_key").distinct()
    by_number = reviews.select("chapter_num", "chunk_id").distinct()
    return boards.join(by_key, ["chapter_num", "cut_key"], "left_anti").join(by_number, ["chapter_num", "chunk_id"], "left_anti")


def sample(boards: DataFrame, seed: int = 1, reviews: DataFrame | None = None) -> DataFrame:
    """One board of each book, the first in an order of hashes, with its neighbours' numbers (-1: none).

    With ``reviews`` a board not yet reviewed is drawn, if the book has one. Draws are sums in each task; only the drawn
    chapters are looked at again for neighbours.
    """
    ticket = F.sha1(F.concat_ws(":", F.lit(str(seed)), "chapter_num", "chunk_id").cast("binary"))
    rows = boards.withColumn("seen", F.lit(0))
    if reviews is not None:
        fresh = unreviewed(boards, reviews).select(*KEYS, "chunk_id", F.lit(0).alias("seen"))
        rows = boards.join(fresh, [*KEYS, "chunk_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(1)))
    drawn = rows.groupBy("book_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "book_id")), F.struct("seen", ticket)).alias("b")).select("book_id", "b.*").drop("seen")
    other = drawn.select(*KEYS, F.col("chunk_id").alias("own")).join(boards.select(*KEYS, "chunk_id"), KEYS)
    around = other.groupBy(*KEYS).agg(F.max(F.when(F.col("chunk_id") < F.col("own"), F.col("chunk_id"))).alias("p"), F.min(F.when(F.col("chunk_id") > F.col("own"), F.col("chunk_id"))).alias("n"))
    return drawn.join(around, KEYS).withColumn("previous", F.coalesce("p", F.lit(-1))).withColumn("next", F.coalesce("n", F.lit(-1))).drop("p", "n")


def overview(boards: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per chapter: boards, lines, duration, reviewed boards."""
    per = boards.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("boards"), F.round(F.max("end_time"), 3).alias("duration"))
    seen = latest_reviews(reviews).groupBy("chapter_num").agg(F.count(F.lit(1)).alias("reviewed"))
    return per.join(seen, "chapter_num", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(0)))


def at_times(boards: DataFrame, times: DataFrame, width: float = 60.0) -> DataFrame:
    """The board that holds each time (chapter_num, time_id, t), else the next one, else the last."""
    b, t = boards.select("chapter_num", "chunk_id", "start_time", "end_time"), F.col("t")
    met = meeting(times, b, (t, t), (F.col("start_time"), F.col("end_time")), width).filter((F.col("start_time") <= t) & (t < F.col("end_time")))
    inside = met.groupBy("chapter_num", "time_id").agg(F.min("chunk_id").alias("inside"))
    ahead = next_after(times, "t", b.groupBy("chapter_num", "start_time").agg(F.min("chunk_id").alias("chunk_id")), "start_time", F.col("chunk_id"), "ahead")
    last = b.groupBy("chapter_num").agg(F.max("chunk_id").alias("last"))
    return ahead.join(inside, ["chapter_num", "time_id"], "left").join(last, "chapter_num").select("chapter_num", "time_id", "t", F.coalesce("inside", "ahead", "last").alias("chunk_id"))


def overlapping(spans: DataFrame, segments: DataFrame, width: float = 60.0) -> DataFrame:
    """``spans(chapter_num, span_id, start, end)`` with the text of the segments that they touch, ends included."""
    s = segments.select("chapter_num", "seg_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("said"))
    met = meeting(spans, s, (F.col("start"), F.col("end")), (F.col("s"), F.col("e")), width).filter(~((F.col("e") < F.col("start")) | (F.col("s") > F.col("end"))))
    text = met.groupBy("chapter_num", "span_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "said"))), lambda x: x["said"]), " ").alias("heard"))
    return spans.join(text, ["chapter_num", "span_id"], "left").withColumn("heard", F.coalesce("heard", F.lit("")))
