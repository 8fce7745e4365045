"""What screens and exports ask of a book: derived boards, states of layouts and cuts, lists and counts.

All are joins and aggregations keyed by chapter; a chapter that lacks an input keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import segments as S

# Fixed values.
NEIGHBOUR, HEIGHT = 0.2, 118


def _joined(items: Column, key: str, value: Column, between: str) -> Column:
    """An aggregate: values in order of a key, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("v")))), lambda x: x["v"]), between)


def mismatched(layouts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Layouts (chapter_num, token_count) of another number of words than their chapter has: chapter_num, token_count, words."""
    n = tokens.groupBy("chapter_num").agg(F.count(F.lit(1)).alias("words"))
    both = layouts.select("chapter_num", "token_count").join(n, "chapter_num", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    return both.filter(F.col("token_count") != F.col("words"))


def derived_boards(layouts: DataFrame, tokens: DataFrame, times: DataFrame | None, overrides: DataFrame, width: int = X.MAX_CHARS) -> DataFrame:
    """Boards of ``layouts(chapter_num, breaks, token_count)`` over ``tokens``, without inserts.

    ``times(chapter_num, token_idx, start, end)``: none gives zeros; ``overrides(chapter_num, key, manual)``. Layouts that
    don't fit their chapter are left out, see ``mismatched``.
    """
    good = layouts.join(mismatched(layouts, tokens).select("chapter_num"), "chapter_num", "left_anti")
    opening = good.select("chapter_num", F.explode("breaks").alias("token_idx"), F.lit(1).alias("opens"))
    rows = tokens.join(good.select("chapter_num"), "chapter_num", "left_semi").join(opening, ["chapter_num", "token_idx"], "left")
    if times is None:
        rows = rows.withColumns({"start": F.lit(0.0), "end": F.lit(0.0)})
    else:
        rows = rows.join(times.select("chapter_num", "token_idx", "start", "end"), ["chapter_num", "token_idx"], "left")
    order = Window.partitionBy("chapter_num").orderBy("token_idx")
    rows = rows.withColumn("board", F.coalesce(F.sum("opens").over(order), F.lit(0)))
    ts = F.array_sort(F.collect_list(F.struct("token_idx", "word", "sep")))
    boards = rows.groupBy("chapter_num", "board").agg(
        ts.alias("ts"), F.bool_and("is_dialogue").alias("said"), F.min("token_idx").alias("token_start"), (F.max("token_idx") + 1).alias("token_end"),
        F.min_by("start", "token_idx").alias("s"), F.max_by("end", "token_idx").alias("e"),
    )
    text = F.array_join(F.transform("ts", lambda t, i: F.concat(t["word"], F.when(i == F.size("ts") - 1, "").otherwise(t["sep"]))), "")
    own = boards.withColumn("text", text).withColumn("key", F.concat(F.lit("b"), "token_start")).withColumn("end_key", F.concat(F.lit("b"), "token_end"))
    own = own.join(overrides.select("chapter_num", "key", F.col("manual").alias("m0")), ["chapter_num", "key"], "left")
    own = own.join(overrides.select("chapter_num", F.col("key").alias("end_key"), F.col("manual").alias("m1")), ["chapter_num", "end_key"], "left")
    zero = F.lit(times is None)
    start = F.round(F.when(zero, 0.0).otherwise(F.coalesce("m0", "s")), 3)
    end = F.round(F.when(zero, 0.0).otherwise(F.coalesce("m1", "e")), 3)
    return own.select(
        "chapter_num", (F.col("board") + 1).cast("int").alias("chunk_id"), "text", F.when(F.col("said"), "dialogue").otherwise("narration").alias("chunk_type"),
        X.line_count(F.col("text"), width).alias("lines_count"), start.alias("start_time"), end.alias("end_time"), F.round(end - start, 3).alias("duration"), "token_start", "token_end",
        F.col("m0").isNotNull().alias("manual_start"), F.col("m1").isNotNull().alias("manual_end"),
    )


def derived_or_stored(derived: DataFrame, stored: DataFrame, origin: str = "board_source") -> DataFrame:
    """Boards of each chapter as the layout gives them; where it gives none, as they were stored. ``origin``: layout or legacy."""
    columns = stored.columns
    own = derived.select(*columns).withColumn(origin, F.lit("layout"))
    rest = stored.join(derived.select("chapter_num").distinct(), "chapter_num", "left_anti").select(*columns)
    return own.unionByName(rest.withColumn(origin, F.lit("legacy")))


def export_state(selection: DataFrame, book: str = "book_id") -> DataFrame:
    """Per book of a ``derived_or_stored`` selection: chapters, degraded ones, and whether the export is refused as all are."""
    per = selection.groupBy(book, "chapter_num").agg(F.max(F.col("cut_source") == "legacy").alias("legacy"))
    return per.groupBy(book).agg(F.count(F.lit(1)).alias("chapters"), F.count_if("legacy").alias("degraded"), F.bool_and("legacy").alias("refused"))


def layout_state(layouts: DataFrame, cuts: DataFrame, inserts: DataFrame, reviewed: DataFrame, stale: DataFrame, boards: DataFrame, most: int = X.MAX_LINES) -> DataFrame:
    """Per chapter of ``layouts(chapter_num, text_hash, token_count, breaks, saved)`` what the layout screen shows.

    flags (boundaries without a pause, key:text), inserts, reviewed keys, stale corrections and boards over the limit;
    chapters without a recording have no cuts and aren't ``processed``.
    """
    flags = cuts.groupBy("chapter_num").agg(_joined(None, "idx", F.when(F.col("no_pause"), F.concat("key", F.lit(":"), "segment_text")), "|").alias("flags"), F.lit(True).alias("processed"))
    ins = inserts.groupBy("chapter_num").agg(F.countDistinct("anchor").alias("inserts"))
    seen = reviewed.groupBy("chapter_num").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("reviewed"))
    gone = stale.groupBy("chapter_num").agg(_joined(None, "lo", F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")), ",").alias("stale"))
    over = boards.groupBy("chapter_num").agg(F.count_if(F.col("lines_count") > most).alias("warnings"), F.count_if(F.col("lines_count") == 0).alias("errors"))
    out = layouts
    for part in (flags, ins, seen, gone, over):
        out = out.join(part, "chapter_num", "left")
    text = {c: F.coalesce(c, F.lit("")) for c in ("flags", "reviewed", "stale")}
    number = {c: F.coalesce(c, F.lit(0)) for c in ("inserts", "warnings", "errors")}
    return out.withColumns({**text, **number, "processed": F.coalesce("processed", F.lit(False)), "breaks": F.array_join(F.col("breaks").cast("array<string>"), ",")})


def cut_state(cuts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Cuts with ``reviewed``, and what the list shows of each: reviewed, attention, manual or automatic."""
    seen = reviewed.select("chapter_num", "key", F.lit(True).alias("reviewed")).distinct()
    rows = cuts.join(seen, ["chapter_num", "key"], "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    kind = F.when(F.col("reviewed"), "reviewed").when(F.col("needs_attention"), "attention").when(F.col("source") == "manual", "manual").otherwise("automatic")
    return rows.withColumn("state", kind)


def open_cuts(state: DataFrame) -> DataFrame:
    """Per chapter: cuts that need attention and weren't reviewed, reviewed ones, and the first open one but the edges."""
    last = Window.partitionBy("chapter_num")
    open_ = F.col("needs_attention") & ~F.col("reviewed")
    rows = state.withColumn("inner", (F.col("idx") > 0) & (F.col("idx") < F.max("idx").over(last)))
    return rows.groupBy("chapter_num").agg(
        F.count_if(open_).alias("open"), F.count_if("reviewed").alias("reviewed"), F.coalesce(F.min(F.when(open_ & F.col("inner"), F.col("idx"))), F.lit(1)).alias("selected")
    )


def overview(chapters: DataFrame, layouts: DataFrame, summaries: DataFrame, reviewed: DataFrame, archived: DataFrame) -> DataFrame:
    """One row per chapter: saved_layout, processed, boards, attention, reviewed, archived_layouts, error.

    A chapter with cuts takes its boards from them, another from its layout; one without either has an error.
    """
    own = layouts.select("chapter_num", "saved", (F.size("breaks") + 1).alias("laid"))
    made = summaries.select("chapter_num", F.col("boards").alias("cut_boards"), "attention", F.lit(True).alias("processed"))
    seen = reviewed.groupBy("chapter_num").agg(F.countDistinct("key").alias("reviewed"))
    old = archived.groupBy("chapter_num").agg(F.count(F.lit(1)).alias("archived_layouts"))
    out = chapters.select("chapter_num")
    for part in (own, made, seen, old):
        out = out.join(part, "chapter_num", "left")
    return out.select(
        "chapter_num", F.coalesce("saved", F.lit(False)).alias("saved_layout"), F.coalesce("processed", F.lit(False)).alias("processed"), F.coalesce("cut_boards", "laid").cast("long").alias("boards"),
        "attention", F.coalesce("reviewed", F.lit(0)).alias("reviewed"), F.coalesce("archived_layouts", F.lit(0)).alias("archived_layouts"), F.when(F.col("laid").isNull(), "no layout").alias("error"),
    )


def packed_peaks(peaks: DataFrame) -> DataFrame:
    """Peaks (chapter_num, bucket, lo, hi) as base64 of signed bytes in order of bucket: chapter_num, buckets, min, max."""
    hexed = lambda c: F.transform("ps", lambda p: F.right(F.hex(p[c].cast("int")), F.lit(2)))
    two = lambda c: F.array_join(F.transform(hexed(c), lambda h: F.lpad(h, 2, "0")), "")
    rows = peaks.groupBy("chapter_num").agg(F.array_sort(F.collect_list(F.struct("bucket", "lo", "hi"))).alias("ps"))
    return rows.select("chapter_num", F.size("ps").alias("buckets"), F.base64(F.unhex(two("lo"))).alias("min"), F.base64(F.unhex(two("hi"))).alias("max"))


def gain(peaks: DataFrame) -> DataFrame:
    """Per chapter, what takes its loudest peak to the height of a screen; peaks under one count as one."""
    loud = F.greatest(F.max(F.col("hi").cast("int")), F.max(-F.col("lo").cast("int")), F.lit(1))
    return peaks.groupBy("chapter_num").agg((F.lit(HEIGHT) / loud).alias("gain"))


def peak_columns(peaks: DataFrame, views: DataFrame, rate: float) -> DataFrame:
    """Peaks of ``views(chapter_num, t0, t1, width)`` by pixel column x: lo (0 at most) and hi (0 at least)."""
    n = peaks.groupBy("chapter_num").agg((F.max("bucket") + 1).alias("n"))
    v = views.join(n, "chapter_num").withColumn("i0", F.greatest(F.lit(0), F.floor(F.col("t0") * rate))).withColumn("i1", F.least(F.col("n"), F.ceil(F.col("t1") * rate)))
    v = v.withColumn("span", F.greatest(F.lit(1), F.col("i1") - F.col("i0")))
    x = v.select("chapter_num", "i0", "i1", "span", "width", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    edge = lambda k: F.col("i0") + F.floor(F.col("span") * k / F.col("width"))
    x = x.withColumn("a", edge(F.col("x"))).withColumn("b", F.least(F.greatest(F.col("a") + 1, edge(F.col("x") + 1)), F.col("i1")))
    cells = x.select("chapter_num", "x", F.explode(F.when(F.col("b") > F.col("a"), F.sequence("a", F.col("b") - 1)).otherwise(F.array(F.lit(-1).cast("long")))).alias("bucket"))
    met = cells.join(peaks, ["chapter_num", "bucket"], "left")
    return met.groupBy("chapter_num", "x").agg(F.least(F.lit(0), F.coalesce(F.min(F.col("lo").cast("int")), F.lit(0))).alias("lo"), F.greatest(F.lit(0), F.coalesce(F.max(F.col("hi").cast("int")), F.lit(0))).alias("hi"))


def moved_cuts(cuts: DataFrame, wishes: DataFrame) -> DataFrame:
    """``wishes(chapter_num, idx, t)`` for inner cuts, kept 0.2 s away from the neighbours' times."""
    order = Window.partitionBy("chapter_num").orderBy("idx")
    around = cuts.select("chapter_num", "idx", F.lag("time").over(order).alias("before"), F.lead("time").over(order).alias("after"))
    met = wishes.join(around.filter("before is not null and after is not null"), ["chapter_num", "idx"])
    return met.select("chapter_num", "idx", F.round(F.least(F.greatest(F.col("t"), F.col("before") + NEIGHBOUR), F.col("after") - NEIGHBOUR), 3).alias("time"))


def chapter_list(chapters: DataFrame, payloads: DataFrame, recordings: DataFrame) -> DataFrame:
    """Chapters (book_id, chapter_num, header, text) with blocks_count, audio_file, is_processed, duration, chunks_count, match_rate."""
    made = payloads.select(*S.KEYS, F.lit(True).alias("done"), "duration", F.col("chunks_count").alias("made"), "match_rate")
    out = chapters.select(*S.KEYS, "header", F.size(S.block_texts(F.col("text"))).alias("blocks_count")).join(made, S.KEYS, "left").join(recordings.select(*S.KEYS, "audio_file"), S.KEYS, "left")
    return out.select(
        *S.KEYS, "header", "blocks_count", "audio_file", F.coalesce("done", F.lit(False)).alias("is_processed"), "duration", F.coalesce("made", F.lit(0)).alias("chunks_count"), "match_rate"
    )


def project_summary(entries: DataFrame, files: DataFrame, payloads: DataFrame) -> DataFrame:
    """Per book: audio_count, audio_mode, chapter_map_count, processed_count."""
    audio = files.groupBy("book_id").agg(F.count(F.lit(1)).alias("audio_count"))
    made = payloads.select(*S.KEYS, F.lit(1).alias("done")).distinct()
    mapped = entries.join(made, S.KEYS, "left").groupBy("book_id").agg(F.count(F.lit(1)).alias("chapter_map_count"), F.count("done").alias("processed_count"))
    out = audio.join(mapped, "book_id", "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("audio_count", "chapter_map_count", "processed_count")}
    return out.withColumns(n).withColumn("audio_mode", F.when(F.col("audio_count") > 1, "multi").otherwise("single"))


def text_edits(edits: DataFrame, boards: DataFrame) -> DataFrame:
    """Edits (chapter_num, op_id, cut_key, chunk_id, text) as operations on the board they mean, by key, or by number where there is none.

    A book board's text is corrected, an insert's is set; an edit that means no board is ``rejected``.
    """
    b = boards.select(F.col("chapter_num").alias("own_chapter"), F.col("cut_key").alias("own_key"), F.col("chunk_id").alias("own_id"), "kind", "anchor", "token_start", "token_end")
    here = F.col("chapter_num") == F.col("own_chapter")
    keyed = edits.filter("cut_key is not null").join(b, here & (F.col("cut_key") == F.col("own_key")), "left")
    numbered = edits.filter("cut_key is null").join(b, here & (F.col("chunk_id") == F.col("own_id")), "left")
    rows = keyed.unionByName(numbered)
    insert = F.col("kind") == "insert"
    op = F.when(F.col("own_key").isNull(), "rejected").when(insert, "insert_text").otherwise("correction")
    return rows.select(
        "chapter_num", "op_id", op.alias("op"), F.when(insert, F.col("anchor")).otherwise(F.col("token_start")).alias("at"), F.when(~insert, F.col("token_end")).alias("until"), "text"
    )
