"""Text expressions. Every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_CHARS, MAX_LINES = 45, 11
DIALOGUE = "—–\\-―“„\""
SENTENCE_STARTS = "A-ZĄĆĘŁŃÓŚŹŻ—–\\-"
FOOTER_FROM = 0.85
NO_SOURCE = "(brak tekstu w pliku txt)"
ILLEGAL = '\\/:*?"<>|\r\n\t'
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
DEVICE_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10))]

#: White space as Unicode has it.
SPACE = "(?U)\\s"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas, where Spark shares no subexpressions."""
    return F.transform(F.array(value), body)[0]


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"{SPACE}+\\z|\\A{SPACE}+", "")


def words(t: Column) -> Column:
    """White-space-separated words, none empty."""
    return F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")


def newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def footer_start(t: Column, markers: list[str], share: float = FOOTER_FROM) -> Column:
    """1-based place of the first marker in the last part of a text; null if there is none."""
    first = F.floor(F.length(t) * F.lit(share)).cast("int") + 1
    low = F.lower(t)
    return _least([_locate(m, low, first) for m in markers])


def _locate(marker: str, low: Column, first: Column) -> Column:
    at = F.instr(F.substr(low, first), marker)
    return F.when(at > 0, at + first - 1)


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def without_footer(t: Column, markers: list[str]) -> Column:
    at = footer_start(t, markers)
    return F.when(at.isNull(), t).otherwise(F.regexp_replace(F.substr(t, F.lit(1), at - 1), f"{SPACE}+\\z", ""))


def text_slice(t: Column, start: Column, end: Column, window: int = 1200) -> Column:
    """Characters [start, end); an end of 0 is ``window`` after the start."""
    first = F.greatest(F.lit(0), F.least(start, F.length(t)))
    last = F.greatest(first, F.least(F.when(end == 0, start + window).otherwise(end), F.length(t)))
    return F.substr(t, first + 1, last - first)


def lengths(t: Column) -> Column:
    """Word lengths of a text, with a 0 for each line break between them."""
    per = F.transform(F.split(t, "\n"), lambda p: F.transform(words(p), F.length))
    return F.flatten(F.transform(per, lambda x: F.concat(F.array(F.lit(0)), x)))


def wrap(state: Column, sizes: Column, width: int = MAX_CHARS) -> Column:
    """Greedy wrapping: ``state`` (lines, used) after more word lengths; 0 ends a line."""

    def step(s: Column, n: Column) -> Column:
        room = s["used"] + 1 + n <= width
        return F.struct(
            F.when(n == 0, s["lines"]).when((s["used"] > 0) & room, s["lines"]).otherwise(s["lines"] + 1).alias("lines"),
            F.when(n == 0, 0).when((s["used"] > 0) & room, s["used"] + 1 + n).otherwise(n).alias("used"),
        )

    return F.aggregate(sizes, state, step)


def fresh() -> Column:
    return F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"))


def line_count(t: Column, width: int = MAX_CHARS) -> Column:
    """Lines that a text takes on a board; 0 if it is blank."""
    return wrap(fresh(), lengths(t), width)["lines"]


def sentences(t: Column) -> Column:
    found = F.filter(F.transform(F.split(t, f"(?<=[.!?…]){SPACE}+(?=[{SENTENCE_STARTS}])"), strip), lambda s: s != "")
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(strip(t))))


def is_dialogue(t: Column) -> Column:
    return strip(t).rlike(f"^[{DIALOGUE}]")


def normal_word(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}_]", "")


def search_form(t: Column) -> Column:
    """Lower-case letters and digits, every other run as one space, none at the start."""
    return F.ltrim(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}]+", " "))


def search_places(t: Column) -> Column:
    """The place in a text (from 0) of each sign of its ``search_form``: letters and digits, and the first sign after each run of them."""
    # One separator a run of letters and digits, so places are sums of run lengths.
    runs = F.regexp_extract_all(t, F.lit("[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(s: Column, r: Column) -> Column:
        skip = F.length(F.regexp_extract(r, "^[^\\p{L}\\p{N}]*", 0))
        end = s["at"] + F.length(r)
        return F.struct(end.alias("at"), F.array_append(s["spans"], F.struct((s["at"] + skip).alias("a"), end.alias("b"))).alias("spans"))

    spans = F.aggregate(runs, start, step, lambda s: s["spans"])
    return F.flatten(F.transform(spans, lambda r: F.sequence(r["a"], F.least(r["b"], F.length(t) - 1))))


def words_hash(word_array: Column) -> Column:
    return F.substring(F.sha1(F.array_join(word_array, "\n").cast("binary")), 1, 16)


def without_marker(t: Column, any_case: bool = False) -> Column:
    return strip(F.regexp_replace(F.coalesce(t, F.lit("")), ("(?i)" if any_case else "") + "\\(brak tekstu[^)]*\\)", ""))


def heard_board(heard: Column) -> Column:
    return F.when(F.coalesce(heard, F.lit("")) == "", F.lit(NO_SOURCE)).otherwise(F.concat(heard, F.lit("\n" + NO_SOURCE)))


def safe_component(t: Column, fallback: str = "projekt") -> Column:
    """A name that file systems take. Texts are expected in normal form C."""
    plain = F.trim(F.regexp_replace(F.translate(t, ILLEGAL, ""), f"{SPACE}+", " "))
    name = F.regexp_replace(plain, "^[ .]+|[ .]+$", "")
    name = F.when(name == "", fallback).otherwise(name)
    return F.when(F.upper(F.regexp_extract(name, "^[^.]*", 0)).isin(DEVICE_NAMES), F.concat(F.lit("_"), name)).otherwise(name)


def spoken(t: Column) -> Column:
    """A board's text for names and labels: without the marker and leading dashes, quotes and space."""
    return strip(F.regexp_replace(without_marker(t, True), "(?U)^[—–\\-\"'„“\\s]+", ""))


def file_name(t: Column, most: int = 5) -> Column:
    first = F.slice(words(spoken(t)), 1, most)
    kept = F.regexp_replace(F.translate(F.array_join(first, " "), ILLEGAL, ""), f"{SPACE}+", " ")
    name = F.regexp_replace(kept, "^[ .]+|[ .]+$", "")
    return F.when(F.size(first) == 0, "fragment").when(name == "", "audio_fragment").otherwise(name)


def label(t: Column, kind: Column, number: Column) -> Column:
    """A track label: the first five words in capitals, or what stands for a board without any."""
    first = F.slice(words(spoken(t)), 1, 5)
    return (
        F.when(F.size(first) > 0, F.upper(F.array_join(first, " ")))
        .when(kind == "intro_outro", "BRAK TEKSTU W ŹRÓDLE")
        .otherwise(F.concat(F.lit("PLANSZA "), number.cast("string")))
    )


def roman(n: Column) -> Column:
    """Greedy Roman numerals; "" below 1."""
    out, left = F.lit(""), F.greatest(n, F.lit(0))
    for value, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return out


def srt_time(seconds: Column) -> Column:
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_text(t: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != ""), "\n")
