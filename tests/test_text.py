"""Text functions against plain-Python models of their definitions."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from tests_models import lines_model, sentence_model

from tidemark.functions import text as X

TEXTS = [
    "", " \n ", "Dawno, dawno temu żył sobie król.", "— Kto tam? — zapytał. — To ja!\n— Wejdź.", "a " * 40, "x" * 60 + " y", "Jeden. Dwa! Trzy… Cztery? pięć.", "Linia\r\ndruga\rtrzecia", "„Cytat” i \"drugi\"",
    "con.txt", "a/b:c*d?", "... ", "słowo (brak tekstu w pliku txt)", "(BRAK TEKSTU X) Tak, nie", "A\n\n\nB\n \nC",
]


def run(spark, column):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i INT, t STRING").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_lines(spark):
    assert run(spark, X.line_count(F.col("t"))) == [lines_model(t) for t in TEXTS]


def test_words_and_sentences(spark):
    assert run(spark, X.words(F.col("t"))) == [t.split() for t in TEXTS]
    assert run(spark, X.sentences(F.col("t"))) == [sentence_model(t) for t in TEXTS]


def test_small_functions(spark):
    assert run(spark, X.newlines(F.col("t"))) == [t.replace("\r\n", "\n").replace("\r", "\n") for t in TEXTS]
    assert run(spark, X.is_dialogue(F.col("t"))) == [bool(re.match("[—–\\-―“„\"]", t.strip())) for t in TEXTS]
    assert run(spark, X.normal_word(F.col("t"))) == [re.sub(r"[^\w]", "", t.lower()) for t in TEXTS]
    names = dict(zip(TEXTS, run(spark, X.safe_component(F.col("t"))), strict=True))
    assert names["con.txt"] == "_con.txt" and names["a/b:c*d?"] == "abcd" and names["... "] == "projekt"
    files = dict(zip(TEXTS, run(spark, X.file_name(F.col("t"))), strict=True))
    assert files["(BRAK TEKSTU X) Tak, nie"] == "Tak, nie" and files[""] == "fragment" and files["... "] == "audio_fragment"


@pytest.mark.parametrize(("seconds", "stamp"), [(0.0, "00:00:00,000"), (-1.0, "00:00:00,000"), (3661.2345, "01:01:01,235"), (59.9999, "00:01:00,000")])
def test_srt_time(spark, seconds, stamp):
    assert spark.range(1).select(X.srt_time(F.lit(seconds)).alias("s")).first().s == stamp


def test_roman(spark):
    got = spark.createDataFrame([(n,) for n in (0, -3, 1, 4, 9, 14, 40, 1994)], "n INT").select("n", X.roman(F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == ["", "", "I", "IV", "IX", "XIV", "XL", "MCMXCIV"]


def test_footer(spark):
    body = "słowo " * 100
    rows = spark.createDataFrame([(body + "\n-----\nstopka",), ("-----\n" + body,), ("",)], "t STRING")
    got = [r.v for r in rows.select(X.without_footer(F.col("t"), ["\n-----", "licencji"]).alias("v")).collect()]
    assert got == [body.rstrip(), "-----\n" + body, ""]
