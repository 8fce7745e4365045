"""Which part of a book each recording reads: a proposed chapter map.

``books``: book_id, text. ``recordings``: book_id, audio_file, duration (seconds), words (what is heard at its start).

Books with trusty headings as many as recordings are mapped by joins alone. Elsewhere recordings are looked for in the text:

- A book's search form is a table of ``stretches`` of SIZE signs, and an index of its words in threes, by hash and place.
- Five words that a recording says (its seeds) meet the index on the three in the middle, so that the outer ones may be
  parts of words. Only hits go on; each gets its window from one stretch, never the book, and is judged by likeness.
- What is heard later stands later: recordings of a line (a book, or a chapter that several recordings read) take their places
  in turn, on rows of numbers. Where none of a recording's hits is left, windows at a step are compared, for all such recordings at once.

Hits of a seed may overlap each other. A seed of fewer than three words in search form is not looked up.
"""

from __future__ import annotations

import difflib
import re
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.functions.numbers import round3
from tidemark.operators import chapters as C
from tidemark.sources.scratch import materialise

# Fixed values.
SEED_STARTS, SEED_WORDS, LEAST_SEED, LEAST_QUERY, LEAST_WORDS = (0, 2, 4, 6, 9, 12), 5, 12, 20, 4
GOOD, SURE, PART_CONFIDENCE, LOW = 0.75, 0.45, 0.6, 0.5
TAIL_ROOM, SCAN_ROOM, SCAN_STEP, BEHIND, APART, SNIPPET = 80, 100, 200, 50, 200, 160

#: Signs of a stretch, and words of the index.
SIZE, GRAM = 4096, 3
#: Looked-up words that are sent to the executors, some 10 MB; beyond it the whole index is joined.
WANTED = 100_000
_RUN = re.compile(r"[^\W_]+")

FIELDS = ["book_id", "chapter_num", "header", "title", "text_start", "text_end", "audio_file", "confidence", "source", "method", "warnings"]


def lowered(text: str) -> list[str]:
    """The lower case of each sign; some have two."""
    low = text.lower()
    return list(low) if len(low) == len(text) and "Σ" not in text else [c.lower() for c in text]


def search_index(text: str) -> tuple[str, np.ndarray]:
    """A text's search form and each sign's place in the text; signs that one letter's lower case has share its place."""
    good = np.fromiter(map(str.isalnum, text), bool, len(text))
    places = np.flatnonzero(good | np.append(False, good[:-1])) if len(text) else np.empty(0, np.int64)
    low = lowered(text)
    signs = [low[p] if g else " " for p, g in zip(places.tolist(), good[places].tolist(), strict=True)]
    return "".join(signs), np.repeat(places, [len(c) for c in signs]).astype(np.int32) if signs else places.astype(np.int32)


def _rows(found, kinds, most: int = 4096):
    """Rows as record batches of up to ``most``."""
    held = []
    for row in found:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=[*kinds])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=[*kinds])


def _texts(batches):
    for batch in batches:
        for book, text in zip(batch.column(0), batch.column(1), strict=True):
            yield book.as_py(), text.as_py() or ""


def stretches(books: DataFrame, room: int) -> DataFrame:
    """``book_id, no, first, form, places, text_first, text_next, n, text_n`` of ``books(book_id, text)``; ``form`` has ``room`` signs more than its places."""

    def cut(batches):
        for book, text in _texts(batches):
            form, places = search_index(text)
            for first in range(0, max(1, len(form)), SIZE):
                last = min(first + SIZE, len(form))
                low, high = (0 if first == 0 else int(places[first])), (int(places[last]) if last < len(form) else len(text) + 1)
                yield book, first // SIZE, first, form[first : last + room], places[first:last].tolist(), low, high, len(form), len(text)

    kinds = {"book_id": pa.string(), "no": pa.int32(), "first": pa.int32(), "form": pa.string(), "places": pa.list_(pa.int32())}
    kinds |= dict.fromkeys(("text_first", "text_next", "n", "text_n"), pa.int32())
    schema = "book_id STRING, no INT, first INT, form STRING, places ARRAY<INT>, text_first INT, text_next INT, n INT, text_n INT"
    return books.mapInArrow(lambda batches: _rows(cut(batches), kinds, 256), schema)


def index(books: DataFrame, sizes: list[int], wanted: frozenset[str] | None) -> DataFrame:
    """``book_id, gram, at``: every so many words in a row of the search form of ``books(book_id, text)``, by hash and place; only ``wanted`` ones."""
    known = books.sparkSession.sparkContext.broadcast(wanted)

    def cut(batches):
        for book, text in _texts(batches):
            low = lowered(text)
            words = _RUN.findall("".join(low)) if max(map(len, low), default=1) == 1 else search_index(text)[0].split(" ")
            at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
            for n in sizes:
                for k, gram in enumerate(map(" ".join, zip(*(words[i:] for i in range(n)), strict=False))):
                    if known.value is None or gram in known.value:
                        yield book, gram, at[k]

    kinds = {"book_id": pa.string(), "gram": pa.string(), "at": pa.int32()}
    return books.mapInArrow(lambda batches: _rows(cut(batches), kinds), "book_id STRING, gram STRING, at INT").select("book_id", F.xxhash64("gram").alias("gram"), "at")


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def queries(asks: DataFrame) -> DataFrame:
    """``asks(ask, words, ...)`` with ``said``, the words that aren't blank, and ``whole``, their search form; null where there is too little."""
    said = F.filter("words", lambda w: F.trim(w) != "")
    whole = X.search_form(F.array_join(said, " "))
    enough = (F.size(said) >= LEAST_WORDS) & (F.length(whole) >= LEAST_QUERY)
    return asks.withColumn("said", F.when(enough, said)).withColumn("whole", F.when(enough, whole)).drop("words")


def seeds(asked: DataFrame) -> DataFrame:
    """``ask, k, seed, tail, gram, lead, size``: the five words from the k-th start on, what follows, and the words that are looked up."""
    form = lambda n: X.search_form(F.array_join(F.slice("said", F.col("start") + 1, n), " "))
    starts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("start")) for k, s in enumerate(SEED_STARTS)))
    rows = asked.filter("said IS NOT NULL").select("ask", "said", F.explode(starts).alias("s")).select("ask", "said", "s.k", "s.start").filter(F.col("start") + SEED_WORDS <= F.size("said"))
    rows = rows.select("ask", "k", form(F.lit(SEED_WORDS)).alias("seed"), form(F.size("said")).alias("tail")).filter(F.length("seed") >= LEAST_SEED)
    rows = rows.withColumn("tokens", F.split(F.trim("seed"), " ")).filter(F.size("tokens") >= 3).withColumn("size", F.least(F.lit(GRAM), F.size("tokens") - 2))
    gram = F.array_join(F.slice("tokens", F.lit(2), F.col("size")), " ")
    return rows.select("ask", "k", "seed", "tail", "size", gram.alias("words"), F.xxhash64(gram).alias("gram"), (F.length(F.element_at("tokens", 1)) + 1).alias("lead"))


class Search:
    """Hits of ``asks(ask, book_id, words)`` in their books; without ``book_id``, in all books."""

    def __init__(self, books: DataFrame, asks: DataFrame):
        own = [c for c in ("book_id",) if c in asks.columns]
        self.asks = materialise(queries(asks.select("ask", *own, "words")), "asks")
        room = (self.asks.agg(F.max(F.length("whole"))).first()[0] or 0) + SCAN_ROOM  # one number
        found = materialise(seeds(self.asks), "seeds")
        sizes = sorted(r.size for r in found.select("size").distinct().collect())  # at most GRAM
        wanted = found.select("words").distinct()
        wanted = frozenset(r.words for r in wanted.collect()) if wanted.count() <= WANTED else None
        books = books.select("book_id", "text")
        met = (found.join(self.asks.select("ask", *own), "ask") if own else found).join(index(books, sizes, wanted), [*own, "gram"])
        met = materialise(met.select("ask", "book_id", "k", "seed", "tail", (F.col("at") - F.col("lead")).alias("place")).filter("place >= 0"), "met")
        # With books of their own all of these may be scanned; else only books with hits are looked at again.
        self.stretches = materialise(stretches(books if own else books.join(met.select("book_id").distinct(), "book_id", "left_semi"), room), "stretches")
        here = self.windows(met, "place", F.length("tail") + TAIL_ROOM).filter(F.startswith("window", "seed"))
        self.hits = materialise(here.select("ask", "book_id", "k", "place", "text_place", likeness("tail", "window").alias("how")), "hits")

    def windows(self, rows: DataFrame, place: str, length: Column) -> DataFrame:
        """``rows`` with ``window``, so many signs of their book from ``place`` on, and ``text_place``."""
        parts = self.stretches.select("book_id", "no", "first", "form", "places")
        at = F.col(place) - F.col("first")
        return rows.withColumn("no", F.floor(F.col(place) / SIZE).cast("int")).join(parts, ["book_id", "no"]).select(
            *rows.columns, F.substr("form", at + 1, length.cast("int")).alias("window"), F.get("places", at).alias("text_place")
        )

    def scanned(self, rows: DataFrame) -> DataFrame:
        """``ask, book_id, start, place, text_place, how``: the likest window at a step from ``start`` on of ``rows(ask, book_id, start)``, if any is like."""
        sizes = self.stretches.filter("no = 0").select("book_id", "n")
        size = F.length("whole")
        asked = rows.join(self.asks.select("ask", "whole"), "ask").join(sizes, "book_id").filter("whole IS NOT NULL AND start < n")
        last = F.greatest(F.lit(1), F.col("n") - F.col("start") - size)
        at = asked.select("ask", "book_id", "start", "whole", F.explode(F.sequence("start", F.col("start") + last - 1, F.greatest(F.lit(SCAN_STEP), F.floor(size / 2).cast("int")))).alias("place"))
        judged = self.windows(at, "place", size + SCAN_ROOM).select("ask", "book_id", "start", "place", "text_place", likeness("whole", "window").alias("how")).filter("how > 0")
        best = judged.groupBy("ask", "book_id", "start").agg(F.max(F.struct("how", (-F.col("place")).alias("back"), "text_place")).alias("b"))
        return best.select("ask", "book_id", "start", (-F.col("b.back")).alias("place"), "b.text_place", "b.how")

    def alone(self) -> DataFrame:
        """``ask, book_id, place, text_place, how``: each recording's likest hit, starts after a good one left aside; without hits none."""
        each = self.hits.groupBy("ask", "book_id", "k").agg(F.max(F.struct("how", (-F.col("place")).alias("back"), "text_place")).alias("b"))
        before = F.max("b.how").over(Window.partitionBy("ask", "book_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
        open_ = each.withColumn("before", before).filter(F.coalesce("before", F.lit(0.0)) < GOOD)
        best = open_.groupBy("ask", "book_id").agg(F.max(F.struct("b.how", (-F.col("k")).alias("early"), "b.back", "b.text_place")).alias("b")).filter("b.how > 0")
        return best.select("ask", "book_id", (-F.col("b.back")).alias("place"), "b.text_place", "b.how")

    def form_places(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``column``, a place in the text, as the first place of the search form that is there or behind it."""
        near = rows.join(self.stretches.select("book_id", "no", "first", "text_first", "text_next", "places"), "book_id").filter((F.col(column) >= F.col("text_first")) & (F.col(column) < F.col("text_next")))
        return near.withColumn(column, F.col("first") + F.size(F.filter("places", lambda p: p < F.col(column)))).select(*rows.columns)

    def text_places(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``column``, a place in the search form, as one of the text; the text's end behind the form's."""
        ends = self.stretches.filter("no = 0").select("book_id", F.col("text_n"))
        parts = self.stretches.select("book_id", "no", "first", "places")
        near = rows.withColumn("no", F.floor(F.col(column) / SIZE).cast("int")).join(parts, ["book_id", "no"], "left").join(ends, "book_id")
        return near.withColumn(column, F.coalesce(F.get("places", F.col(column) - F.col("first")), "text_n")).select(*rows.columns)


LINES = "ask STRING, book_id STRING, line INT, seq INT, start INT, gap INT, end INT, fallback INT, sure DOUBLE"


TURNS = {"ask": pa.string(), "book_id": pa.string(), "line": pa.int32(), "seq": pa.int32(), "pos": pa.int32(), "how": pa.float64(), "found": pa.bool_(), "open": pa.bool_()}


def _turn(rows: list[dict]):
    """One line's recordings in turn: each takes its likest hit behind the search's place, or stands where the line says.

    ``rows`` of numbers, in order of ``seq``; ``k`` is -1 for what a scan found, -2 for a scan that found nothing, and null for a recording
    without hits. A ``mute`` recording has too few words for a scan. The line stops, ``open``, at a recording that needs one.
    """
    at = None
    for seq, own in groupby(rows, itemgetter("seq")):
        own = list(own)
        ask = own[0]
        at = ask["start"] if at is None else at
        ahead = sorted((x["k"], -x["how"], x["pos"]) for x in own if x["k"] is not None and x["k"] >= 0 and x["pos"] is not None and x["pos"] >= at)
        scan = [x for x in own if x["k"] is not None and x["k"] < 0 and x["scan_start"] == at]
        if ahead:
            pos, how, last = -1, -1.0, None
            for k, less, place in ahead:
                if k == last:
                    continue  # each start's likest
                if how >= GOOD:
                    break  # those behind a good one don't count
                last = k
                if -less > how:
                    pos, how = place, -less
        elif scan:
            pos, how = (scan[0]["pos"], scan[0]["how"]) if scan[0]["k"] == -1 else (-1, 0.0)
        elif ask["mute"]:
            pos, how = -1, 0.0
        else:
            yield ask["ask"], ask["book_id"], ask["line"], seq, at, 0.0, False, True
            return
        inside = pos >= 0 and how >= ask["sure"] and (ask["end"] is None or at - ask["gap"] < pos < ask["end"])
        fixed = ask["fallback"] is not None
        place = pos if inside else ask["fallback"] if fixed else at
        yield ask["ask"], ask["book_id"], ask["line"], seq, place, how if inside else 0.0, inside, False
        at = place + ask["gap"] if inside or fixed else at


def _turns(batches):
    """TURNS of batches of lines' recordings and hits, in order of line and ``seq``."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return _rows((x for _, own in groupby(rows, itemgetter("book_id", "line")) for x in _turn(own)), TURNS)


def in_turn(search: Search, lines: DataFrame, in_text: bool) -> DataFrame:
    """``ask, book_id, line, seq, pos, how, found`` of all recordings of ``lines`` (LINES), in places of the text or of the search form.

    A line that waits for a scan goes on from there in the next round; what stands before is kept.
    """
    place = "text_place" if in_text else "place"
    mute = search.asks.select("ask", F.col("whole").isNull().alias("mute"))
    lines, known, parts = materialise(lines.join(mute, "ask"), "lines"), None, None
    none = F.lit(None).cast("int")
    schema = "ask STRING, book_id STRING, line INT, seq INT, pos INT, how DOUBLE, found BOOLEAN, open BOOLEAN"
    while True:
        hits = search.hits.select("ask", "k", F.col(place).alias("pos"), "how", none.alias("scan_start"))
        rows = lines.join(hits if known is None else hits.unionByName(known), "ask", "left")
        done = rows.repartition("book_id", "line").sortWithinPartitions("book_id", "line", "seq").mapInArrow(_turns, schema)
        done = materialise(done, "turns")
        kept = done.filter("NOT open").drop("open")
        parts = kept if parts is None else parts.unionByName(kept)
        wanting = done.filter("open").select("ask", "book_id", "line", F.col("seq").alias("from"), F.col("pos").alias("asked"))
        if not wanting.limit(1).count():
            return parts
        starts = wanting.select("ask", "book_id", F.col("asked").alias("start"))
        starts = search.form_places(starts, "start") if in_text else starts
        found = search.scanned(starts).select("ask", F.col(place).alias("pos"), "how")
        new = wanting.join(found, "ask", "left").select("ask", F.when(F.col("pos").isNull(), -2).otherwise(-1).alias("k"), "pos", "how", F.col("asked").alias("scan_start"))
        known = materialise(new, "scans")
        left = lines.join(wanting.drop("ask"), ["book_id", "line"]).filter(F.col("seq") >= F.col("from"))
        lines = materialise(left.withColumn("start", F.col("asked")).select(lines.columns), "lines")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def chapters_of(sizes: pd.Series, durations: pd.Series) -> pd.Series:
    return pd.Series([dealt(s, d) for s, d in zip(sizes, durations, strict=True)])


def dealt(sizes, durations) -> list[int]:
    """The chapter of each recording in turn; those left over get -1.

    A recording goes on with the chapter of the one before if that brings the chapter's time nearer to its share and
    the recordings from it on are more than the chapters still to come.
    """
    rate, at, got, out = sum(sizes) / sum(durations), -1, 0.0, []
    for k, seconds in enumerate(durations):
        want, to_come = sizes[at] / rate if at >= 0 else 0.0, len(sizes) - at - 1
        nearer = at >= 0 and abs(got + seconds - want) < abs(got - want)
        if nearer and len(durations) - k > to_come:
            got += seconds
        elif to_come:
            at, got = at + 1, seconds
        else:
            return out + [-1] * (len(durations) - k)
        out.append(at)
    return out


def _by_anchors(books: DataFrame, recordings: DataFrame) -> DataFrame:
    """Maps of ``books`` without headings: one chapter a recording of ``recordings(book_id, place, audio_file, words)``."""
    asks = recordings.withColumn("ask", F.concat_ws("/", F.col("book_id"), F.col("place").cast("string")))
    search = Search(books, asks)
    none = lambda kind: F.lit(None).cast(kind)
    lines = asks.select("ask", "book_id", F.lit(0).alias("line"), F.col("place").alias("seq"), F.lit(0).alias("start"), F.lit(BEHIND).alias("gap"), none("int").alias("end"), none("int").alias("fallback"), F.lit(0.0).alias("sure"))
    found = search.text_places(in_turn(search, lines, False), "pos").join(asks.select("ask", "audio_file"), "ask")
    found = found.join(search.stretches.filter("no = 0").select("book_id", "text_n"), "book_id").withColumn("how", round3(F.col("how")))
    own = Window.partitionBy("book_id")
    end = F.coalesce(F.lead("pos").over(own.orderBy("seq")), "text_n")
    low = F.count_if(F.col("how") < LOW).over(own)
    name = F.concat(F.lit("Rozdział "), (F.col("seq") + 1).cast("string"))
    notes = F.when(low > 0, F.array(F.lit("no headings"), F.concat(F.lit("low confidence: "), low.cast("string")))).otherwise(F.array(F.lit("no headings")))
    return found.select(
        "book_id", (F.col("seq") + 1).alias("chapter_num"), name.alias("header"), F.lit("").alias("title"), F.col("pos").alias("text_start"),
        F.when(end > F.col("pos"), end).otherwise(F.col("text_n")).alias("text_end"), "audio_file", F.col("how").alias("confidence"),
        F.lit("anchor").alias("source"), F.lit("anchor").alias("method"), notes.alias("warnings"),
    )


def _reconciled(books: DataFrame, chapters: DataFrame, recordings: DataFrame) -> DataFrame:
    """Maps of ``books`` whose headings and recordings differ in number; both tables have ``book_id, place``."""
    size = F.col("text_end") - F.col("text_start")
    listed = lambda rows, c, name: rows.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", c.alias("v")))), lambda x: x["v"]).alias(name))
    both = listed(chapters, size, "sizes").join(listed(recordings, F.col("duration"), "durations"), "book_id")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    usable = both.filter((total("sizes") > 0) & (total("durations") > 0)).select("book_id", chapters_of("sizes", "durations").alias("line"))
    given = recordings.join(usable.select("book_id", F.posexplode("line").alias("place", "line")), ["book_id", "place"])
    before = Window.partitionBy("book_id", "line").orderBy("place")
    own = given.filter("line >= 0").withColumns({"part": F.row_number().over(before) - 1, "parts": F.count(F.lit(1)).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "until": F.sum("duration").over(before), "time": F.sum("duration").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    marked = materialise(
        chapters.withColumnRenamed("place", "line").drop("audio_file").join(own.select("book_id", "line", "audio_file", "words", "part", "parts", ((F.col("until") - F.col("duration")) / F.col("time")).alias("share")), ["book_id", "line"], "left"), "marked"
    )
    cut = marked.filter("part > 0").withColumn("ask", F.concat_ws("/", "book_id", F.col("line").cast("string"), F.col("part").cast("string")))
    search = Search(books.join(cut.select("book_id").distinct(), "book_id", "left_semi"), cut)
    fallback = F.col("text_start") + F.floor(size * F.col("share")).cast("int")
    lines = cut.select("ask", "book_id", F.col("line"), F.col("part").alias("seq"), (F.col("text_start") + APART).alias("start"), F.lit(APART).alias("gap"), F.col("text_end").alias("end"), fallback.alias("fallback"), F.lit(SURE).alias("sure"))
    edges = in_turn(search, lines, True).select("book_id", "line", F.col("seq").alias("part"), "pos", "found")
    rows = marked.join(edges, ["book_id", "line", "part"], "left").withColumn("start", F.coalesce("pos", "text_start"))
    later = F.coalesce(F.col("part"), F.lit(0)) > 0
    order = Window.partitionBy("book_id").orderBy("line", "part")
    inner = Window.partitionBy("book_id", "line").orderBy("part")
    several = F.max(later.cast("int")).over(Window.partitionBy("book_id")) == 1
    first_source = F.first("source").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = rows.join(usable.select("book_id", F.lit(True).alias("dealt")), "book_id", "left")
    numbered = recordings.groupBy("book_id").agg(F.count(F.lit(1)).alias("m")).join(chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")), "book_id")
    note = lambda df, *o: df.select("book_id", F.struct(*(F.coalesce(x.cast("int"), F.lit(0)).alias(f"o{k}") for k, x in enumerate(o[:-1])), o[-1].alias("note")).alias("x"))
    c = F.col
    none_left = given.filter("line < 0").groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audio_file"))), lambda x: x["audio_file"]), ", ").alias("left"))
    notes = (
        note(numbered, F.lit(0), F.lit(0), F.lit(0), F.format_string("%d headings, %d recordings", "n", "m"))
        .unionByName(note(none_left, F.lit(1), F.lit(0), F.lit(0), F.concat(F.lit("left over: "), "left")))
        .unionByName(note(known.filter("dealt AND part IS NULL"), F.lit(2), c("line"), F.lit(0), F.format_string("no recording: %d", "chapter_num")))
        .unionByName(note(known.filter("part = 0 AND parts > 1"), F.lit(2), c("line"), F.lit(0), F.format_string("cut in %d: %s", "parts", "header")))
        .unionByName(note(known.filter("part > 0 AND NOT found"), F.lit(2), c("line"), c("part"), F.concat(F.lit("cut by time: "), "audio_file")))
        .groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["note"]).alias("warnings"))
    )
    return known.join(notes, "book_id").select(
        "book_id", F.when(several, F.row_number().over(order)).otherwise(F.col("chapter_num")).alias("chapter_num"),
        F.when(later, F.format_string("%s (cz. %d)", "header", F.col("part") + 1)).otherwise(F.col("header")).alias("header"), "title", F.col("start").alias("text_start"),
        F.coalesce(F.lead("start").over(inner), "text_end").alias("text_end"), "audio_file", F.when(later, PART_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"),
        F.when(later, "headings+anchor").otherwise(F.col("source")).alias("source"), F.concat(first_source, F.when(several, "+reconciled").otherwise("")).alias("method"), "warnings",
    )


def proposed(books: DataFrame, recordings: DataFrame) -> DataFrame:
    """The map of each book: FIELDS with heading_score, snippet, audio_duration and text_length."""
    books = books.select(F.col("book_id").cast("string").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = lambda c: (F.row_number().over(Window.partitionBy("book_id").orderBy(*c)) - 1).alias("place")
    recordings = recordings.select(F.col("book_id").cast("string").alias("book_id"), "audio_file", F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration"), "words")
    named = materialise(recordings.select("*", place(["audio_file", "duration"])), "recordings")
    heard = named.groupBy("book_id").agg(F.count(F.lit(1)).alias("m"))
    found = C.headings(books)
    best = C.best_pattern(C.scores(found, books.select("book_id").join(heard.select("book_id", F.col("m").alias("expected")), "book_id", "left")))
    best = materialise(best.select("book_id", "pattern", "pattern_no", "score"), "patterns")
    trusty = best.filter(F.col("score") >= C.MIN_SCORE)
    own = C.chapters(found, trusty).join(trusty.select("book_id", "pattern"), "book_id").select(
        "book_id", F.col("chapter_num").cast("int").alias("chapter_num"), "header", "title", F.col("text_start").cast("int").alias("text_start"), F.col("text_end").cast("int").alias("text_end"),
        "confidence", F.concat(F.lit("headings:"), "pattern").alias("source"), place(["text_start"]),
    )
    own = materialise(own, "chapters")
    counts = books.select("book_id").join(own.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")), "book_id", "left").join(heard, "book_id", "left").fillna(0, ["n", "m"])
    state = materialise(counts.withColumn("kind", F.when((F.col("m") > 0) & (F.col("n") == 0), "anchors").when((F.col("m") > 0) & (F.col("n") != F.col("m")), "cuts").when(F.col("n") > 0, "agreed").otherwise("bare")), "kinds")
    of = lambda rows, kind: rows.join(state.filter(F.col("kind") == kind).select("book_id"), "book_id", "left_semi")
    agreed = of(own, "agreed").join(named.select("book_id", "place", "audio_file"), ["book_id", "place"], "left").withColumn("method", F.col("source")).withColumn("warnings", F.array().cast("array<string>"))
    bare = of(books, "bare").select(
        "book_id", F.lit(1).alias("chapter_num"), F.lit("Rozdział 1").alias("header"), F.lit("").alias("title"), F.lit(0).alias("text_start"), F.length("text").alias("text_end"), F.lit(None).cast("string").alias("audio_file"),
        F.lit(0.0).alias("confidence"), F.lit("fallback").alias("source"), F.lit("fallback").alias("method"), F.array(F.lit("one chapter")).alias("warnings"),
    )
    rows = agreed.select(*FIELDS).unionByName(bare).unionByName(_by_anchors(of(books, "anchors"), of(named, "anchors"))).unionByName(_reconciled(of(books, "cuts"), of(own, "cuts"), of(named, "cuts")))
    # The snippet is cut where the text is: only places go to it.
    starts = rows.select("book_id", "text_start").distinct().groupBy("book_id").agg(F.collect_list("text_start").alias("starts"))
    cut = books.join(starts, "book_id").select("book_id", F.explode(F.transform("starts", lambda s: F.struct(s.alias("text_start"), X.strip(F.substr("text", s + 1, F.lit(SNIPPET))).alias("snippet")))).alias("x")).select("book_id", "x.*")
    times = recordings.groupBy("book_id", "audio_file").agg(F.max("duration").alias("audio_duration"))
    return rows.join(cut, ["book_id", "text_start"]).join(times, ["book_id", "audio_file"], "left").join(best.select("book_id", F.col("score").alias("heading_score")), "book_id", "left").select(
        *FIELDS, F.coalesce("heading_score", F.lit(0.0)).alias("heading_score"), "snippet", F.coalesce("audio_duration", F.lit(0.0)).alias("audio_duration"), F.greatest(F.lit(0), F.col("text_end") - F.col("text_start")).alias("text_length"),
    )


def book_anchors(books: DataFrame, snippets: DataFrame) -> DataFrame:
    """``book_id, snippet_id, place, confidence`` of ``snippets(snippet_id, book_id, words)`` in their own book; -1 if nowhere."""
    asks = snippets.select(F.concat_ws("/", F.col("book_id").cast("string"), F.col("snippet_id").cast("string")).alias("ask"), F.col("book_id").cast("string").alias("book_id"), "words")
    search = Search(books.select(F.col("book_id").cast("string").alias("book_id"), "text"), asks)
    hit = materialise(search.alone(), "found")
    rest = asks.select("ask", "book_id", F.lit(0).alias("start")).join(hit.select("ask"), "ask", "left_anti")
    whole = hit.select("ask", "text_place", "how").unionByName(search.scanned(rest).select("ask", "text_place", "how"))
    named = snippets.select("book_id", "snippet_id", F.concat_ws("/", F.col("book_id").cast("string"), F.col("snippet_id").cast("string")).alias("ask")).join(whole, "ask", "left")
    return named.select("book_id", "snippet_id", F.coalesce("text_place", F.lit(-1)).alias("place"), F.coalesce(round3(F.col("how")), F.lit(0.0)).alias("confidence"))


def anchors_anywhere(books: DataFrame, snippets: DataFrame) -> DataFrame:
    """``book_anchors`` of ``snippets(snippet_id, text)`` in all books that have five words in a row of theirs, at one of the starts."""
    search = Search(books.select(F.col("book_id").cast("string").alias("book_id"), "text"), snippets.select(F.col("snippet_id").cast("string").alias("ask"), X.words(F.col("text")).alias("words")))
    kind = dict(books.dtypes)["book_id"], dict(snippets.dtypes)["snippet_id"]
    return search.alone().select(F.col("book_id").cast(kind[0]).alias("book_id"), F.col("ask").cast(kind[1]).alias("snippet_id"), F.col("text_place").alias("place"), round3(F.col("how")).alias("confidence"))
