"""From boards and word times to cuts in a recording, and boards with times.

``units``: chapter_num, unit_idx, cut_key, kind (book or insert), text, dialogue, token_start, token_end,
anchor, insert_board, edited, corrected, first_start, last_end. All windows are within a chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.numbers import round3
from tidemark.operators import alignment as A
from tidemark.operators import signal as G
from tidemark.operators.intervals import meeting
from tidemark.operators.scans import STRETCH as STRETCH_PLACES
from tidemark.operators.scans import Scan, numbered, scanned
from tidemark.sources.scratch import materialise

# Fixed values.
LEAST_BOARD, MARGIN, HEARD_MARGIN, END_KEY, LEAST_FILL = 0.20, 0.05, 0.1, "end", 0.02
#: Seconds of a stretch in which utterances are looked up.
STRETCH = 30.0


def bounds(layouts: DataFrame) -> DataFrame:
    """Boards of ``layouts(chapter_num, breaks, token_count)``: board_idx, lo, hi."""
    ends = F.concat(F.array(F.lit(0)), "breaks", F.array("token_count"))
    return layouts.select("chapter_num", F.posexplode(F.arrays_zip(F.slice(ends, F.lit(1), F.size(ends) - 1).alias("lo"), F.slice(ends, 2, 1 << 30).alias("hi"))).alias("board_idx", "b")).select(
        "chapter_num", "board_idx", "b.lo", "b.hi"
    )


def heard(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """``spans(chapter_num, span_id, start, end)`` with the text of the segments that overlap each by over 0.1 s."""
    s = segments.select("chapter_num", F.col("seg_id"), F.col("start").alias("s"), F.col("end").alias("e"), X.strip(F.col("text")).alias("said"))
    met = meeting(spans, s, (F.col("start"), F.col("end")), (F.col("s"), F.col("e")), STRETCH)
    met = met.filter((F.col("e") > F.col("start") + HEARD_MARGIN) & (F.col("s") < F.col("end") - HEARD_MARGIN) & (F.col("said") != ""))
    text = met.groupBy("chapter_num", "span_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "said"))).alias("parts"))
    joined = text.select("chapter_num", "span_id", F.array_join(F.transform("parts", lambda p: p["said"]), " ").alias("heard"))
    return spans.join(joined, ["chapter_num", "span_id"], "left").withColumn("heard", F.coalesce("heard", F.lit("")))


def insert_texts(inserts: DataFrame) -> DataFrame:
    """The insert that counts at each anchor (the last by ``nth``), with its text ``full`` and words ``ws``."""
    last = Window.partitionBy("chapter_num", "anchor").orderBy(F.col("nth").desc())
    own = inserts.withColumn("rank", F.row_number().over(last)).filter("rank = 1").drop("rank")
    raw = F.when(F.col("edited"), F.col("typed")).otherwise(F.col("text"))
    text = F.coalesce(raw, X.heard_board(F.col("heard")))
    text = F.when((X.without_marker(text) == "") & (F.coalesce("heard", F.lit("")) != ""), X.heard_board(F.col("heard"))).otherwise(text)
    return own.withColumn("full", text).withColumn("ws", X.words(X.without_marker(F.col("full")))).withColumn("n", F.size("ws"))


def insert_words(own: DataFrame) -> DataFrame:
    """Words of ``insert_texts`` with times: chapter_num, anchor, k, word, start, end.

    Typed and heard words (``words``, with s and e) are aligned; those of equal blocks take the heard word's time, and
    those between two such share what lies between, 0.02 s each at least. Where nothing was heard or nothing fits (or there is
    no such column), all share the insert's span.
    """
    norm = lambda ws: F.transform(ws, X.normal_word)
    none = F.array().cast("array<struct<w:string,s:double,e:double>>")
    heard = F.coalesce(F.col("words").cast("array<struct<w:string,s:double,e:double>>"), none) if "words" in own.columns else none
    pairs = own.withColumn("hw", heard).withColumn("at", A.block_places(norm(F.col("ws")), norm(F.transform("hw", lambda w: w["w"]))))
    rows = pairs.select("chapter_num", "anchor", "start_time", "end_time", "n", "hw", "at", F.posexplode("ws").alias("k", "word")).withColumn("m", F.get("at", F.col("k")))
    rows = rows.withColumn("hit", F.when(F.col("m") >= 0, F.get("hw", F.col("m")))).drop("hw", "at")
    order = Window.partitionBy("chapter_num", "anchor").orderBy("k")
    hit = F.when(F.col("hit").isNotNull(), F.struct("k", F.col("hit.s").alias("s"), F.col("hit.e").alias("e")))
    rows = rows.withColumn("p", F.last(hit, True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("q", F.first(hit, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    first, stop = F.coalesce(F.col("p.k"), F.lit(-1)), F.coalesce(F.col("q.k"), F.col("n"))
    begin, until = F.coalesce(F.col("p.e"), F.col("start_time")), F.coalesce(F.col("q.s"), F.col("end_time"))
    none = F.col("p").isNull() & F.col("q").isNull()
    count = stop - first - 1
    step = F.when(none, (F.col("end_time") - F.col("start_time")) / F.col("n")).otherwise(F.greatest(F.lit(LEAST_FILL), (until - begin) / (count + 1)))
    at = begin + (F.col("k") - first - 1) * step
    end = F.when(none, F.col("start_time") + (F.col("k") + 1) * step).otherwise(at + step)
    return rows.select(
        "chapter_num", "anchor", "k", "word", F.coalesce(F.col("hit.s"), round3(at)).alias("start"), F.coalesce(F.col("hit.e"), round3(end)).alias("end")
    )


def insert_units(inserts: DataFrame) -> DataFrame:
    """Boards of inserts (chapter_num, anchor, nth, start_time, end_time, heard, text, edited, typed, breaks, words).

    Of several inserts at one anchor the last (by ``nth``) counts. An insert without words is one board of its whole span.
    """
    own = insert_texts(inserts)
    inner = F.array_sort(F.array_distinct(F.filter(F.coalesce("breaks", F.array().cast("array<int>")), lambda b: (b > 0) & (b < F.col("n")))))
    own = own.withColumn("inner", inner)
    said = insert_words(own.filter("n > 0")).join(own.select("chapter_num", "anchor", "inner", "edited"), ["chapter_num", "anchor"])
    said = said.withColumn("insert_board", F.size(F.filter("inner", lambda b: b <= F.col("k"))))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
    boards = said.groupBy("chapter_num", "anchor", "insert_board").agg(
        piece.alias("piece"), F.first("edited").alias("edited"), F.size(F.first("inner")).alias("last"), F.min_by("start", "k").alias("first_start"), F.max_by("end", "k").alias("last_end")
    )
    boards = boards.withColumn("text", F.when(F.col("insert_board") == F.col("last"), F.concat("piece", F.lit("\n" + X.NO_SOURCE))).otherwise(F.col("piece")))
    silent = own.filter("n = 0").select("chapter_num", "anchor", F.lit(0).alias("insert_board"), F.col("full").alias("text"), "edited", F.col("start_time").alias("first_start"), F.col("end_time").alias("last_end"))
    rows = boards.select(silent.columns).unionByName(silent)
    return rows.select("chapter_num", "anchor", "insert_board", F.concat(F.lit("i"), "anchor", F.lit("."), "insert_board").alias("cut_key"), "text", "edited", "first_start", "last_end")


def units(boards: DataFrame, inserts: DataFrame, corrections: DataFrame, token_counts: DataFrame) -> DataFrame:
    """Book boards (chapter_num, lo, hi, text, dialogue, first_start, last_end) and insert boards in reading order.

    An insert stands before the board that starts at its anchor, or at the end from ``token_count`` on; one
    whose anchor is no board's start is left out. ``corrections(chapter_num, lo, hi, fixed)`` replace texts.
    """
    fixed = boards.join(corrections, ["chapter_num", "lo", "hi"], "left")
    has = F.coalesce(F.col("fixed"), F.lit("")) != ""
    book = fixed.select(
        "chapter_num", F.col("lo").alias("place"), F.lit(1).alias("is_book"), F.lit(-1).alias("insert_board"), F.concat(F.lit("b"), "lo").alias("cut_key"), F.lit("book").alias("kind"),
        F.when(has, F.col("fixed")).otherwise(F.col("text")).alias("text"), "dialogue", F.col("lo").alias("token_start"), F.col("hi").alias("token_end"), F.lit(-1).alias("anchor"),
        F.lit(False).alias("edited"), has.alias("corrected"), "first_start", "last_end",
    )
    starts = boards.select("chapter_num", F.col("lo").alias("anchor"), F.lit(True).alias("at_board"))
    kept = inserts.join(starts, ["chapter_num", "anchor"], "left").join(token_counts, "chapter_num").filter(F.col("at_board") | (F.col("anchor") >= F.col("token_count")))
    extra = kept.select(
        "chapter_num", F.col("anchor").alias("place"), F.lit(0).alias("is_book"), "insert_board", "cut_key", F.lit("insert").alias("kind"), "text", F.lit(False).alias("dialogue"),
        F.lit(-1).alias("token_start"), F.lit(-1).alias("token_end"), "anchor", "edited", F.lit(False).alias("corrected"), "first_start", "last_end",
    )
    stretch = F.floor(F.col("place") / STRETCH_PLACES)
    return numbered(book.unionByName(extra), ["chapter_num"], ["place", "is_book", "insert_board"], [stretch], "unit_idx").drop("place", "is_book")


def in_order(points: DataFrame, levels: list[Column] | None = None) -> DataFrame:
    """``points(chapter_num, point_id, t, duration)`` with ``time``: cut times at least LEAST_BOARD apart, none pushed beyond ``duration``.

    Without the cap the recurrence t'(i) = max(t(i), t'(i-1) + gap) is a running maximum of t(i) - gap i. ``levels``: see ``scanned``.
    """
    t, i, duration = F.col("t"), F.col("point_id"), F.col("duration")
    levels = [F.floor(i / STRETCH_PLACES)] if levels is None else levels
    rows = scanned(points, ["chapter_num"], ["point_id"], levels, {"time": Scan(t - i * LEAST_BOARD, "highest")})
    pushed = F.col("time") + i * LEAST_BOARD
    time = F.when(pushed > t + 1e-9, F.greatest(t, F.round(F.least(pushed, duration), 3))).otherwise(t)
    return rows.withColumn("time", time)


def cuts(unit_rows: DataFrame, islands: DataFrame, stats: DataFrame, silence_rows: DataFrame, segments: DataFrame, overrides: DataFrame, hop_s: float, search: float = G.SEARCH, least: float = G.MIN_SILENCE) -> DataFrame:
    """One row per boundary of the units, first and last included: idx, key, time, source, confidence, safety, ...

    ``stats``: chapter_num, n_frames, duration. A cut is set by hand, or at an edge, or in a silence, or between words.
    """
    order = Window.partitionBy("chapter_num").orderBy("unit_idx")
    opening = unit_rows.select(
        "chapter_num", F.col("unit_idx").alias("idx"), F.col("cut_key").alias("key"), F.lag("last_end").over(order).alias("word_end"), F.col("first_start").alias("word_start"), F.lit(False).alias("is_last")
    )
    closing = unit_rows.groupBy("chapter_num").agg(F.max("unit_idx").alias("m"), F.max_by("last_end", "unit_idx").alias("word_end")).select(
        "chapter_num", (F.col("m") + 1).alias("idx"), F.lit(END_KEY).alias("key"), "word_end", F.lit(None).cast("double").alias("word_start"), F.lit(True).alias("is_last")
    )
    points = opening.unionByName(closing).join(stats.select("chapter_num", "duration"), "chapter_num")
    points = points.join(overrides, ["chapter_num", "key"], "left").withColumn("is_first", F.col("idx") == 0)
    points = materialise(points, "points")  # asked several questions each; written tables keep plans small
    ident = lambda rows, t: rows.select("chapter_num", F.col("idx").alias("point_id"), t.alias("t"))
    manual = F.col("manual").isNotNull()
    edges = G.edge_cuts(
        ident(points.filter(F.col("is_first") & ~manual), F.col("word_start")), ident(points.filter(F.col("is_last") & ~manual), F.col("word_end")), islands, stats, hop_s
    )
    inner = points.filter(~F.col("is_first") & ~F.col("is_last") & ~manual).select("chapter_num", F.col("idx").alias("point_id"), F.col("word_end").alias("t_end"), F.col("word_start").alias("t_start"))
    snap = G.snapped(inner, silence_rows, stats, search, least).drop("t_end", "t_start").withColumnRenamed("confidence", "snap_confidence")
    all_points = points.withColumnRenamed("idx", "point_id").join(edges, ["chapter_num", "point_id"], "left").join(snap, ["chapter_num", "point_id"], "left")
    timed = all_points.select(
        "chapter_num", "point_id", "key", "duration", "is_first", "is_last",
        F.coalesce("manual", "edge", "cut").alias("t"),
        F.when(manual, "manual").when(F.col("edge").isNotNull(), "edge").when(F.col("method") == "silence", "silence").otherwise("words").alias("source"),
        F.when(manual | F.col("edge").isNotNull(), 1.0).otherwise(F.col("snap_confidence")).alias("confidence"),
        F.coalesce("silence_start", F.lit(0.0)).alias("silence_start"), F.coalesce("silence_end", F.lit(0.0)).alias("silence_end"),
        F.coalesce("word_end", F.lit(0.0)).alias("word_end"), F.coalesce("word_start", "duration").alias("word_start"),
    )
    timed = materialise(timed, "timed")
    safe = G.probed(timed.select("chapter_num", "point_id", "t"), islands, stats, hop_s).select("chapter_num", "point_id", "safety")
    placed = in_order(timed).join(safe, ["chapter_num", "point_id"])
    placed = materialise(placed, "placed")
    s = segments.select("chapter_num", F.col("seg_id"), F.col("start").alias("s"), F.col("end").alias("e"), X.strip(F.col("text")).alias("said"))
    broken = (
        meeting(placed.filter(~F.col("is_first") & ~F.col("is_last")), s, (F.col("time"), F.col("time")), (F.col("s"), F.col("e")), STRETCH)
        .filter((F.col("s") + MARGIN < F.col("time")) & (F.col("time") < F.col("e") - MARGIN))
        .groupBy("chapter_num", "point_id").agg(F.min_by("said", "seg_id").alias("segment_text"))
    )
    out = placed.join(broken, ["chapter_num", "point_id"], "left").withColumn("no_pause", F.col("segment_text").isNotNull())
    return out.select(
        "chapter_num", F.col("point_id").alias("idx"), "key", F.round("time", 3).alias("time"), "source", F.round("confidence", 3).alias("confidence"), F.round("safety", 3).alias("safety"),
        "silence_start", "silence_end", F.round("word_end", 3).alias("word_end"), F.round("word_start", 3).alias("word_start"), "no_pause", F.coalesce("segment_text", F.lit("")).alias("segment_text"),
        (F.abs(F.col("time") - F.col("t")) > 1e-9).alias("clamped"),
        (F.col("no_pause") | (F.col("source") == "words") | (F.col("safety") < G.SAFE)).alias("needs_attention"),
    )


def timed_boards(unit_rows: DataFrame, cut_rows: DataFrame, width: int = X.MAX_CHARS) -> DataFrame:
    """The boards as exports take them: contiguous, from each unit's cut to the next."""
    order = Window.partitionBy("chapter_num").orderBy("idx")
    spans = cut_rows.select("chapter_num", F.col("idx").alias("unit_idx"), F.col("time").alias("start_time"), F.lead("time").over(order).alias("end_time"))
    kind = F.when(F.col("kind") == "insert", "intro_outro").when(F.col("dialogue"), "dialogue").otherwise("narration")
    return unit_rows.join(spans, ["chapter_num", "unit_idx"]).select(
        "chapter_num", (F.col("unit_idx") + 1).alias("chunk_id"), "text", kind.alias("chunk_type"), X.line_count(F.col("text"), width).alias("lines_count"),
        "start_time", "end_time", F.round(F.col("end_time") - F.col("start_time"), 3).alias("duration"), "cut_key", "kind", "token_start", "token_end", "anchor", "insert_board", "edited", "corrected",
    )


def summary(board_rows: DataFrame, cut_rows: DataFrame, most: int = X.MAX_LINES) -> DataFrame:
    """Counters per chapter."""
    count = lambda c: F.count_if(c)
    b = board_rows.groupBy("chapter_num").agg(
        F.count(F.lit(1)).alias("boards"), count(F.col("kind") == "insert").alias("inserts"), count((F.col("kind") == "insert") & F.col("edited")).alias("inserts_edited"),
        count(F.col("corrected")).alias("corrections"), count(F.col("lines_count") > most).alias("over_limit"),
    )
    c = cut_rows.groupBy("chapter_num").agg(
        F.count(F.lit(1)).alias("cuts"), count(F.col("needs_attention")).alias("attention"), count(F.col("no_pause")).alias("no_pause"), count(F.col("source") == "silence").alias("from_silence"),
        count(F.col("source") == "words").alias("from_words"), count(F.col("source") == "manual").alias("manual"), count(F.col("clamped")).alias("clamped"),
    )
    return b.join(c, "chapter_num")
