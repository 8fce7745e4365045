"""Boards as earlier results hold them: edges of a recording, refinement, checks against what layouts give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import signal as G
from tidemark.operators import timing as T

# Fixed values.
EDGE_SECONDS, ROOM, SAME, LEAST = 1.0, 0.05, 0.002, 0.5


def edge_spans(heard: DataFrame) -> DataFrame:
    """What is said before the first and after the last matched word, if it lasts a second: chapter_num, side, start, end, duration.

    ``heard``: chapter_num, heard_idx, start, end, token_idx (null: no match). Without any match there is no edge.
    """
    per = heard.groupBy("chapter_num").agg(
        F.min(F.when(F.col("token_idx").isNotNull(), F.col("heard_idx"))).alias("first"), F.max(F.when(F.col("token_idx").isNotNull(), F.col("heard_idx"))).alias("last")
    ).filter("first is not null")
    side = F.when(F.col("heard_idx") < F.col("first"), "intro").when(F.col("heard_idx") > F.col("last"), "outro")
    rows = heard.join(per, "chapter_num").withColumn("side", side).filter("side is not null")
    spans = rows.groupBy("chapter_num", "side").agg(F.min_by("start", "heard_idx").alias("start"), F.max_by("end", "heard_idx").alias("end"))
    return spans.withColumn("duration", F.round(F.col("end") - F.col("start"), 3)).filter(F.col("end") - F.col("start") >= EDGE_SECONDS)


def edge_boards(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Boards of ``edge_spans``: what is heard there, with the marker."""
    own = spans.select("chapter_num", F.col("side").alias("span_id"), "start", "end", "duration")
    text = X.heard_board(F.col("heard"))
    return T.heard(own, segments).select(
        "chapter_num", F.col("span_id").alias("side"), text.alias("text"), F.lit("intro_outro").alias("chunk_type"), F.size(F.split(text, "\n")).alias("lines_count"),
        F.round("start", 3).alias("start_time"), F.round("end", 3).alias("end_time"), "duration",
    )


def edge_flags(spans: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per chapter whether it has an intro and an outro, and their durations (0: none)."""
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("duration"))), F.lit(0.0))
    per = spans.groupBy("chapter_num").agg(side("intro").alias("intro_duration"), side("outro").alias("outro_duration"))
    out = chapters.select("chapter_num").join(per, "chapter_num", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("intro_duration", "outro_duration")})
    return out.withColumns({"intro_detected": F.col("intro_duration") > 0, "outro_detected": F.col("outro_duration") > 0})


def untimed(words: DataFrame) -> DataFrame:
    """Chapters with words that have no time: chapter_num, untimed. A finished alignment has none."""
    per = words.groupBy("chapter_num").agg(F.count_if(F.col("start").isNull() | F.col("end").isNull()).alias("untimed"))
    return per.filter("untimed > 0")


def payload_times(payloads: DataFrame) -> DataFrame:
    """Word times of payloads (chapter_num, words): token_idx, start, end; null times where a payload has no words."""
    rows = payloads.select("chapter_num", F.posexplode_outer("words").alias("token_idx", "w"))
    return rows.select("chapter_num", "token_idx", F.col("w.s").alias("start"), F.col("w.e").alias("end"))


def refined(boards: DataFrame, silence_rows: DataFrame, islands: DataFrame, stats: DataFrame, hop_s: float, search: float = G.SEARCH, least: float = G.MIN_SILENCE) -> DataFrame:
    """Proposed cuts of stored boards (chapter_num, idx, start_time, end_time): one after each board but the last, and the edges.

    point_id: -1 the head, the board before the cut, and the last board for the tail; cut, method.
    """
    order = Window.partitionBy("chapter_num").orderBy("idx")
    pairs = boards.select("chapter_num", F.col("idx").alias("point_id"), F.col("end_time").alias("t_end"), F.lead("start_time").over(order).alias("t_start"), F.lead("idx").over(order).alias("more"))
    inner = G.snapped(pairs.filter("more is not null").drop("more"), silence_rows, stats, search, least).select("chapter_num", "point_id", "cut", "method")
    ends = boards.groupBy("chapter_num").agg(F.min_by("start_time", "idx").alias("head"), F.max_by("end_time", "idx").alias("tail"), F.max("idx").alias("last"))
    edges = G.edge_cuts(
        ends.select("chapter_num", F.lit(-1).alias("point_id"), F.col("head").alias("t")), ends.select("chapter_num", F.col("last").alias("point_id"), F.col("tail").alias("t")), islands, stats, hop_s
    )
    return inner.unionByName(edges.select("chapter_num", "point_id", F.col("edge").alias("cut"), F.lit("edge").alias("method")))


def applied(boards: DataFrame, cuts: DataFrame) -> DataFrame:
    """``boards`` with the cuts of ``refined`` that stay inside their pair of boards; boards touch where a cut was taken.

    A cut is taken if it lies 0.05 s after its board's start, which an earlier cut may have moved, and before the next
    board's end. Only whether the cut before was taken decides that start, so each cut is a map of "taken" or "not" to
    the same. Such a map is constant, leaves as is, or turns round; so a cut is what the last constant one says, turned
    as often as there are turning ones since: counts and one last value, no fold.
    """
    order = Window.partitionBy("chapter_num").orderBy("idx")
    own = boards.select("chapter_num", "idx", "start_time", "end_time", F.lead("end_time").over(order).alias("next_end"))
    inner = cuts.filter("method <> 'edge'").select("chapter_num", F.col("point_id").alias("idx"), "cut")
    head = cuts.filter("method = 'edge' and point_id = -1").select("chapter_num", F.col("cut").alias("head"))
    tail = cuts.filter("method = 'edge' and point_id <> -1").select("chapter_num", F.col("cut").alias("tail"))
    rows = own.join(inner, ["chapter_num", "idx"], "left")
    cut, before = F.round("cut", 3), F.round(F.lag("cut").over(order), 3)
    takes = lambda start: F.coalesce((start + ROOM < F.col("cut")) & (F.col("cut") < F.col("next_end") - ROOM), F.lit(False))
    maps = rows.withColumn("if_not", takes(F.col("start_time"))).withColumn("if_taken", F.when(before.isNull(), F.col("if_not")).otherwise(takes(before)))
    turns = maps.withColumn("turns", F.count_if(F.col("if_not") & ~F.col("if_taken")).over(order))
    known = F.when(F.col("if_not") == F.col("if_taken"), F.struct(F.col("if_not").alias("taken"), "turns"))
    taken = turns.withColumn("known", F.last(known, True).over(order)).withColumn("taken", F.col("known.taken") != ((F.col("turns") - F.col("known.turns")) % 2 == 1))
    flat = taken.select("chapter_num", "idx", "start_time", "end_time", (F.row_number().over(order) - 1).alias("k"), F.when(F.col("taken"), cut).alias("own"))
    by = Window.partitionBy("chapter_num").orderBy("k")
    flat = flat.withColumn("start_time", F.coalesce(F.lag("own").over(by), "start_time")).withColumn("end_time", F.coalesce("own", "end_time"))
    flat = flat.withColumn("is_last", F.lead("k").over(by).isNull()).join(head, "chapter_num", "left").join(tail, "chapter_num", "left")
    start = F.when(F.col("k") == 0, F.round(F.least(F.col("head"), F.col("end_time") - ROOM), 3)).otherwise(F.col("start_time"))
    flat = flat.withColumn("start_time", F.coalesce(start, "start_time"))
    end = F.when(F.col("is_last"), F.round(F.greatest(F.col("tail"), F.col("start_time") + ROOM), 3)).otherwise(F.col("end_time"))
    flat = flat.withColumn("end_time", F.coalesce(end, "end_time"))
    return flat.select("chapter_num", "idx", "start_time", "end_time", F.round(F.col("end_time") - F.col("start_time"), 3).alias("duration"), F.col("own").isNotNull().alias("cut_taken"))


def times_compared(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """Per chapter, board times from a layout against stored ones: exact, clamped, min_duration, unexplained, text_diff.

    ``derived(chapter_num, idx, text, start_time, end_time)``; ``stored`` also has chunk_type and its place in the whole
    list, where intros stand too: a stored board may start where the one before it ends, and last half a second at least.
    Chapters with different numbers of boards are one unexplained row.
    """
    whole = Window.partitionBy("chapter_num").orderBy("place")
    s = stored.withColumn("before", F.lag("end_time").over(whole)).filter("chunk_type <> 'intro_outro'")
    s = s.select("chapter_num", (F.row_number().over(whole) - 1).alias("idx"), F.col("text").alias("old"), F.col("start_time").alias("s"), F.col("end_time").alias("e"), "before")
    both = derived.join(s, ["chapter_num", "idx"], "full")
    ds, de = F.abs(F.col("start_time") - F.col("s")), F.abs(F.col("end_time") - F.col("e"))
    start_ok = (ds < SAME) | F.coalesce(F.abs(F.col("s") - F.col("before")) < SAME, F.lit(False))
    stretched = (de >= SAME) & (F.abs(F.col("e") - (F.col("s") + LEAST)) < SAME)
    end_ok, exact = (de < SAME) | stretched, (ds < SAME) & (de < SAME)
    odd = F.col("text").isNull() | F.col("old").isNull()
    per = both.groupBy("chapter_num").agg(
        F.count("text").alias("boards"), F.bool_or(odd).alias("odd"), F.count_if(F.col("text") != F.col("old")).alias("text_diff"), F.count_if(exact).alias("exact"),
        F.count_if(~exact & start_ok & end_ok & (ds >= SAME)).alias("clamped"), F.count_if(~exact & start_ok & end_ok & stretched).alias("min_duration"), F.count_if(~(start_ok & end_ok)).alias("unexplained"),
    )
    keep = lambda c, other: F.when(F.col("odd"), other).otherwise(F.col(c)).alias(c)
    return per.select("chapter_num", "boards", *(keep(c, F.lit(0)) for c in ("text_diff", "exact", "clamped", "min_duration")), keep("unexplained", F.lit(1)))
