"""Aligning a text's words with the words of a transcript.

Matching blocks are found by joins over all chapters at once (``blocks``); only gaps between them, rows of their own, are
finished by a small function; everything after it (interpolation, inserts, reports) is windows over its rows.
"""

from __future__ import annotations

import bisect
import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import round3
from tidemark.operators import blocks as B
from tidemark.operators.scans import STRETCH, Scan, numbered, scanned

# Fixed values.
FUZZY, STEP, LEAST_STEP = 0.75, 0.35, 0.05
EXTRA_SECONDS, EXTRA_WORDS = 1.5, 4


def equal_words(heard: list[str], book: list[str]) -> dict[int, int]:
    """Book word -> heard word of the matching blocks of a gap.

    A gap of more than ``blocks.GAP`` words has no two words in a row in common (``blocks`` saw to that), so each heard word
    takes its next place in the book.
    """
    if max(len(heard), len(book)) <= B.GAP:
        own = difflib.SequenceMatcher(None, heard, book, autojunk=False).get_matching_blocks()
        return {b + k: h + k for h, b, n in own for k in range(n)}
    places, found, at = {}, {}, 0
    for b, word in enumerate(book):
        places.setdefault(word, []).append(b)
    for h, word in enumerate(heard):
        own = places.get(word, ())
        k = bisect.bisect_left(own, at)
        if k < len(own):
            found[own[k]], at = h, own[k] + 1
    return found


def match_words(heard: list[str], book: list[str], fuzzy: float = FUZZY) -> dict[int, int]:
    """Book word -> heard word: equal blocks first, then for each word left the likest one between its neighbours."""
    found = equal_words(heard, book)
    if fuzzy > 1:
        return found
    used = set(found.values())
    after = [len(heard) - 1] * (len(book) + 1)
    for b in range(len(book) - 1, -1, -1):
        after[b] = found.get(b, after[b + 1])
    before = 0
    for b, word in enumerate(book):
        if b in found:
            before = found[b]
            continue
        best, at = 0.0, -1
        for h in range(before, after[b] + 1) if word else ():
            if h not in used:
                ratio = difflib.SequenceMatcher(None, word, heard[h]).ratio()
                if ratio > best:
                    best, at = ratio, h
        if at >= 0 and best >= fuzzy:
            found[b] = before = at
            used.add(at)
    return found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def block_places(typed: pd.Series, heard: pd.Series) -> pd.Series:
    """For each typed word the place of the heard word in an equal block, -1 if none."""

    def places(own, other):
        found = [-1] * len(own)
        for h, t, n in difflib.SequenceMatcher(None, list(other), list(own), autojunk=False).get_matching_blocks():
            found[t : t + n] = range(h, h + n)
        return found

    return pd.Series([places(a, b) for a, b in zip(typed, heard, strict=True)])


def matches(book: DataFrame, heard: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """``chapter_num, token_idx, heard_idx`` from ``book(chapter_num, token_idx, norm)`` and ``heard(chapter_num, heard_idx, norm)``."""

    a, b = heard.select("chapter_num", F.col("heard_idx").alias("a_idx"), "norm"), book.select("chapter_num", F.col("token_idx").alias("b_idx"), "norm")
    found = B.aligned(a, b, lambda said, text: match_words(said, text, fuzzy))
    return found.select(F.col("chapter_num").cast("long").alias("chapter_num"), F.col("b_idx").cast("int").alias("token_idx"), F.col("a_idx").cast("int").alias("heard_idx"))


def interpolated(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Times for all words of ``words(chapter_num, token_idx, start, end)``, where unmatched ones have nulls.

    Before the first and after the last match words take 0.35 s each; between matches they share the gap;
    without any match they share the recording (60 s where its length is unknown).
    """
    hit = F.when(F.col("start").isNotNull(), F.col("token_idx"))
    w = scanned(
        words, ["chapter_num"], ["token_idx"], [F.floor(F.col("token_idx") / STRETCH)],
        {"p": Scan(hit, "last"), "pe": Scan(F.col("end"), "last"), "q": Scan(hit, "ahead"), "qs": Scan(F.col("start"), "ahead")},
    )
    w = w.join(words.groupBy("chapter_num").agg(F.count(F.lit(1)).alias("n")), "chapter_num")
    w = w.join(durations.select("chapter_num", F.coalesce("duration", F.lit(0.0)).alias("d")), "chapter_num")
    i, r3 = F.col("token_idx"), round3
    whole = F.when(F.col("d") == 0, 60.0).otherwise(F.col("d")) / F.col("n")
    lead = F.greatest(F.lit(0.0), F.col("qs") - (F.col("q") - i) * STEP)
    gap = F.col("q") - F.col("p") - 1
    step = F.greatest(gap * LEAST_STEP, F.col("qs") - F.col("pe")) / (gap + 1)
    k = i - F.col("p") - 1
    start = (
        F.when(F.col("start").isNotNull(), F.col("start")).when(F.col("p").isNull() & F.col("q").isNull(), r3(i * whole)).when(F.col("p").isNull(), r3(lead))
        .when(F.col("q").isNull(), r3(F.least("d", F.col("pe") + k * STEP))).otherwise(r3(F.col("pe") + k * step))
    )
    end = (
        F.when(F.col("start").isNotNull(), F.col("end")).when(F.col("p").isNull() & F.col("q").isNull(), r3((i + 1) * whole))
        .when(F.col("p").isNull(), r3(F.greatest(lead + 0.1, F.col("qs") - (F.col("q") - i - 1) * STEP)))
        .when(F.col("q").isNull(), r3(F.least("d", F.col("pe") + (k + 1) * STEP))).otherwise(r3(F.col("pe") + (k + 1) * step))
    )
    return w.select("chapter_num", "token_idx", start.alias("start"), end.alias("end"), F.col("start").isNotNull().alias("matched"))


def extras(heard: DataFrame, token_counts: DataFrame, seconds: float = EXTRA_SECONDS, least: int = EXTRA_WORDS) -> DataFrame:
    """Runs of heard words without a match: anchor, position, start_time, end_time, word_count, heard.

    ``heard``: chapter_num, heard_idx, word, start, end, token_idx (null: no match). The anchor is the next
    matched word's place in the text.
    """
    matched = F.col("token_idx").isNotNull().cast("int")
    rows = scanned(
        heard, ["chapter_num"], ["heard_idx"], [F.floor(F.col("heard_idx") / STRETCH)], {"run": Scan(matched, "total"), "next": Scan(F.col("token_idx"), "ahead")}
    ).filter("token_idx is null")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("heard_idx", "word"))), lambda x: x["word"]), " ")
    runs = rows.groupBy("chapter_num", "run").agg(
        F.min("start").alias("start_time"), F.max("end").alias("end_time"), F.count(F.lit(1)).cast("int").alias("word_count"), said.alias("heard"), F.first("next").alias("next"), F.min("heard_idx").alias("first")
    )
    kept = runs.filter((F.round(F.col("end_time") - F.col("start_time"), 6) >= seconds) & (F.col("word_count") >= least)).join(token_counts, "chapter_num")
    where = F.when(F.col("first") == 0, "intro").when(F.col("next").isNull(), "outro").otherwise("inline")
    return kept.select("chapter_num", F.coalesce("next", "token_count").alias("anchor"), where.alias("position"), "start_time", "end_time", "word_count", "heard")


def report(words: DataFrame) -> DataFrame:
    """Matched words per chapter, and their share in per cent."""
    hit, n = F.count_if("matched"), F.count(F.lit(1))
    return words.groupBy("chapter_num").agg(n.alias("words"), hit.alias("matched"), F.round(hit * 100.0 / n, 2).alias("match_percentage"))


def board_times(spans: DataFrame) -> DataFrame:
    """Board times of ``spans(chapter_num, board_idx, s, e)`` in order: none starts before the last one's end, none is under half a second.

    The ends e'(i) = max(e(i), s(i) + 0.5, e'(i-1) + 0.5) are a running maximum of what is left of each less 0.5 i.
    """
    least, along = F.lit(0.5), (["chapter_num"], ["board_idx"], [F.floor(F.col("board_idx") / STRETCH)])
    rows = numbered(spans, *along, "n").withColumn("least_end", F.greatest(F.col("e"), F.greatest(F.col("s"), F.lit(0.0)) + least))
    left = F.col("least_end") - F.col("n") * least
    rows = scanned(rows, *along, {"top": Scan(left, "highest"), "before": Scan(left, "highest", own=False)})
    rows = rows.withColumn("end", F.col("top") + F.col("n") * least)
    start = F.greatest(F.col("s"), F.coalesce(F.col("before") + (F.col("n") - 1) * least, F.lit(0.0)))
    return rows.select("chapter_num", "board_idx", F.round(start, 3).alias("start_time"), F.round("end", 3).alias("end_time"))


def snippets(heard: DataFrame, seconds: float = 45.0) -> DataFrame:
    """What is heard in the first seconds of each recording, as one text."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "word"))), lambda x: x["word"])
    return heard.filter(F.col("start") < seconds).groupBy("chapter_num").agg(F.array_join(said, " ").alias("snippet"))


def flattened(segments: DataFrame) -> DataFrame:
    """Words of ``segments(chapter_num, seg_id, words)`` one by one, in their order: word_idx, word, start, end."""
    return segments.select("chapter_num", "seg_id", F.posexplode("words").alias("word_idx", "w")).select("chapter_num", "seg_id", "word_idx", "w.word", "w.start", "w.end")


def spread(segments: DataFrame) -> DataFrame:
    """Segments without word times: their words share the time evenly. heard words with start, end, probability 1."""
    ws = F.filter(F.split("text", "(?U)\\s+"), lambda w: w != "")
    rows = segments.withColumn("ws", ws).select("chapter_num", "seg_id", "start", "end", F.size("ws").alias("n"), F.posexplode("ws").alias("k", "word"))
    each = (F.col("end") - F.col("start")) / F.col("n")
    return rows.select(
        "chapter_num", "seg_id", F.col("k").alias("word_idx"), "word", round3(F.col("start") + F.col("k") * each).alias("start"), round3(F.col("start") + (F.col("k") + 1) * each).alias("end"), F.lit(1.0).alias("probability")
    )
