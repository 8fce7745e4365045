"""Finding chapters in a book: headings and their scores.

``books``: book_id, text. Headings are found line by line, so offsets come from one running sum a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X

# Stems of the ordinals from 1 to 19, tens with their numbers, and suffixes.
UNITS = [
    "pierwsz", "drug", "trzec", "czwart", "piąt", "szóst", "siódm", "ósm", "dziewiąt", "dziesiąt", "jedenast", "dwunast", "trzynast", "czternast", "piętnast", "szesnast", "siedemnast", "osiemnast",
    "dziewiętnast",
]
TENS = {"dwudziest": 20, "trzydziest": 30, "czterdziest": 40, "pięćdziesiąt": 50}
SUFFIXES = "yiae"
SPECIAL = "ostatni rozdział|ostatni rozdzial|rozdział ostatni|rozdzial ostatni|prolog|epilog|zakończenie|zakonczenie|posłowie|poslowie"
SHORT_SPAN, MIN_SCORE = 400, 1.5


def ordinals() -> dict[str, int]:
    """Ordinal words to numbers from 1 to 59."""
    single = {stem + s: n for n, stem in enumerate(UNITS, 1) for s in SUFFIXES} | {stem + s: n for stem, n in TENS.items() for s in SUFFIXES}
    pairs = {f"{a}{s} {b}{t}": n + k for a, n in TENS.items() for s in SUFFIXES for k, b in enumerate(UNITS[:9], 1) for t in SUFFIXES}
    return single | pairs


_ORDINAL = "|".join(sorted(ordinals(), key=len, reverse=True))
# Per pattern, a regular expression of one line with a number (group 1) and a title (group 2).
PATTERNS = [
    ("rozdzial_named", f"(?iu)^[ \\t]*(?:(?:rozdzia[łl]|cz[eę][śs][ćc]|ksi[eę]ga)[ \\t]+({_ORDINAL}|[IVXLC]+|\\d{{1,3}})|(?:{SPECIAL}))[ \\t]*[.:—–-]?[ \\t]*(.*)$"),
    ("chapter_named", "(?iu)^[ \\t]*chapter[ \\t]+([IVXLC]+|\\d{1,3})[ \\t]*[.:—–-]?[ \\t]*(.*)$"),
    ("roman_bare", "(?iu)^[ \\t]*([IVXLC]+)[ \\t]*[.:]?[ \\t]*()$"),
    ("arabic_bare", "(?iu)^[ \\t]*(\\d{1,3})[ \\t]*[.:]?[ \\t]*()$"),
    ("asterisks", "(?iu)^[ \\t]*()((?:[*•·#—–-][ \\t]*){3,})$"),
]


def roman_value(n: int) -> str:
    out = ""
    for value, sign in X.ROMAN:
        out, n = out + sign * (n // value), n % value
    return out


def number(token: Column) -> Column:
    """A chapter's number: digits, an ordinal word, or a Roman number up to 50; else null."""
    table = ordinals() | {roman_value(k).lower(): k for k in range(1, 51)}
    words = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    low = F.regexp_replace(F.lower(F.trim(token)), "\\s+", " ")
    return F.when(low.rlike("^\\d+$"), low.try_cast("int")).otherwise(F.try_element_at(words, low))


def headings(books: DataFrame) -> DataFrame:
    """book_id, pattern, pattern_no, idx, match_start, body_start, header, number, title."""
    lines = books.select("book_id", F.length("text").alias("text_len"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("book_id").orderBy("line_no")
    placed = lines.withColumn("match_start", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The first line after a heading that isn't blank, if it begins soon enough.
    own = F.when(X.strip(F.col("line")) != "", F.struct("match_start", X.strip(F.col("line")).alias("line")))
    placed = placed.withColumn("next", F.first(own, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    body = F.col("match_start") + F.length("line")
    after = F.col("next.line")
    good = (F.col("next.match_start") < body + SHORT_SPAN) & (F.length(after) <= 90) & ~after.rlike("^[—–-]") & ~after.rlike("[.!?:]$")
    # All patterns in one pass: a union would read and sort the books' lines once a pattern, all in the same task.
    which = F.explode_outer(F.array(*(F.when(F.col("line").rlike(pattern), k) for k, (_, pattern) in enumerate(PATTERNS))))
    hits = placed.select("book_id", "text_len", "match_start", "line", body.alias("body_start"), F.when(good, after).alias("after"), which.alias("pattern_no")).filter("pattern_no IS NOT NULL")
    hits = hits.withColumn("head", X.strip(F.col("line"))).filter("head <> ''")
    own = lambda part: F.coalesce(*(F.when(F.col("pattern_no") == k, part(*p)) for k, p in enumerate(PATTERNS)))
    hits = hits.withColumns({"pattern": own(lambda name, _: F.lit(name)), "token": own(lambda _, p: F.regexp_extract("line", p, 1)), "rest": own(lambda _, p: F.regexp_extract("line", p, 2))})
    title = F.regexp_replace("rest", "^[ .:—–-]+|[ .:—–-]+$", "")
    hits = hits.withColumn("title", F.when(title != "", title).otherwise(F.coalesce("after", F.lit(""))))
    rows = hits.select(
        "book_id", "text_len", "pattern", "pattern_no", "match_start", "body_start",
        F.when(F.col("head").contains(F.col("title")), F.col("head")).otherwise(F.concat("head", F.lit(" "), "title")).alias("header"), number(F.col("token")).alias("number"), "title",
    )
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("book_id", "pattern_no").orderBy("match_start")) - 1)


def scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Score of each pattern of each book; ``expected(book_id, expected)``: how many recordings there are (0: unknown)."""
    order = Window.partitionBy("book_id", "pattern_no").orderBy("match_start")
    span = F.coalesce(F.lead("match_start").over(order), F.col("text_len")) - F.col("body_start")
    rows = found.withColumn("span", span).withColumn("rises", F.coalesce(F.col("number") > F.lag("number").over(order), F.lit(True)))
    per = rows.groupBy("book_id", "pattern", "pattern_no").agg(
        F.count(F.lit(1)).alias("n"), (F.count("number") == F.count(F.lit(1))).alias("numbered"), F.bool_and("rises").alias("rising"), F.count_if(F.col("span") < SHORT_SPAN).alias("tiny"),
        F.avg("span").alias("mean"), F.stddev_pop("span").alias("deviation"),
    ).join(expected, "book_id", "left")
    e = F.coalesce("expected", F.lit(0))
    count = F.when(e > 0, 3 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("n") - e) / F.greatest(e, F.lit(1)))).otherwise(1.0)
    even = F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), 1.5 - F.col("deviation") / F.col("mean"))).otherwise(0.0)
    score = count + F.when(F.col("numbered") & F.col("rising"), 1.5).otherwise(0.0) - 0.5 * F.col("tiny") + even
    return per.filter("n >= 2").select("book_id", "pattern", "pattern_no", "n", F.round(score, 3).alias("score"))


def best_pattern(scored: DataFrame) -> DataFrame:
    top = Window.partitionBy("book_id").orderBy(F.col("score").desc(), "pattern_no")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(top)).filter("rank = 1").drop("rank")


def chapters(found: DataFrame, best: DataFrame) -> DataFrame:
    """Chapters of the best pattern: text_start to the next heading; repeated or missing numbers become places."""
    order = Window.partitionBy("book_id").orderBy("match_start")
    own = found.join(best.select("book_id", "pattern_no"), ["book_id", "pattern_no"])
    place = F.col("idx") + 1
    raw = F.coalesce("number", place)
    return own.withColumn("raw", raw).withColumn("again", F.row_number().over(Window.partitionBy("book_id", "raw").orderBy("match_start")) > 1).select(
        "book_id", F.when(F.col("again"), place).otherwise(F.col("raw")).alias("chapter_num"), "header", "title", F.col("body_start").alias("text_start"),
        F.coalesce(F.lead("match_start").over(order), F.col("text_len")).alias("text_end"), F.lit(1.0).alias("confidence"),
    )


def saved_map(entries: DataFrame, books: DataFrame) -> DataFrame:
    """``entries(book_id, nth, chapter_num, text_start, text_end)`` clamped, sorted by start; repeated numbers become places."""
    n = books.select("book_id", F.length("text").alias("n"))
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("n"))
    rows = entries.join(n, "book_id").withColumns({"text_start": clamp("text_start"), "text_end": clamp("text_end")}).drop("n")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("text_start", "nth")))
    again = F.row_number().over(Window.partitionBy("book_id", "chapter_num").orderBy("place")) > 1
    return rows.withColumn("again", again).select("book_id", "place", F.when(F.col("again"), F.col("place")).otherwise(F.col("chapter_num")).alias("chapter_num"), "text_start", "text_end")
