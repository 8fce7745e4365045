"""Files as tables: texts in unknown encodings, recordings by name, JSON payloads, PCM sound."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X

# Fixed values.
LETTERS = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
ENCODINGS = ["cp1250", "iso-8859-2", "cp852"]
AUDIO = ["mp3", "m4a", "wav", "flac", "ogg", "opus", "mp4", "aac"]

#: A processed chapter, as JSON files hold it.
PAYLOAD = (
    "chapter_num INT, header STRING, audio_file STRING, duration DOUBLE, chunks ARRAY<STRUCT<chunk_id: INT, text: STRING, chunk_type: STRING, start_time: DOUBLE, end_time: DOUBLE>>, "
    "words ARRAY<STRUCT<w: STRING, s: DOUBLE, e: DOUBLE, m: BOOLEAN>>, extras ARRAY<STRUCT<anchor: INT, position: STRING, start_time: DOUBLE, end_time: DOUBLE, heard: STRING>>"
)


def decoded(raw: bytes) -> str:
    """UTF-8 if the bytes are; else the old code page that makes most Polish letters, the first of equals."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    best, most = None, None
    for name in ENCODINGS:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        score = sum(map(text.count, LETTERS)) - 10 * text.count("�")
        if most is None or score > most:
            best, most = text, score
    return raw.decode("utf-8", "replace") if best is None else best


@F.pandas_udf(T.StringType())
def decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decoded(bytes(b)))


def book_texts(spark: SparkSession, path: str, footers: list[str]) -> DataFrame:
    """``book_id, text`` of text files: decoded, with plain line ends, without the publisher's footer."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    return files.select(name.alias("book_id"), X.without_footer(X.newlines(decode("content")), footers).alias("text"))


def chapter_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Chapters from JSON files, one or many to a file; files that are no JSON are left out."""
    return spark.read.schema(PAYLOAD).option("mode", "DROPMALFORMED").option("multiLine", True).json(path).filter("chapter_num is not null")


def write_payloads(payloads: DataFrame, path: str) -> None:
    payloads.repartition("chapter_num").write.mode("overwrite").json(path)


def is_audio(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(AUDIO)


def chapter_of(name: Column) -> Column:
    """The chapter that a recording's name gives: ``_012_`` or ``rozdzial-12``; null if none."""
    found = F.regexp_extract(name, r"(?i)_(\d{3})_|rozdzial[-_]?0*(\d+)\b", 0)
    return F.when(found != "", F.regexp_extract(found, r"(\d+)", 1).cast("int"))


def recordings(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """``chapters(book_id, chapter_num, audio_file)`` with a recording each: the mapped one, else the one whose
    name gives the chapter (the first by name), else the one in the chapter's place among the book's files."""
    f = files.filter(is_audio(F.col("name"))).select("book_id", "name", chapter_of(F.col("name")).alias("chapter_num"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("name"))
    by_name = f.filter("chapter_num is not null").groupBy("book_id", "chapter_num").agg(F.min("name").alias("named"))
    by_place = f.select("book_id", "name", place.alias("chapter_num")).withColumnRenamed("name", "placed")
    known = f.select("book_id", F.col("name").alias("audio_file"), F.lit(True).alias("known"))
    return (
        chapters.join(known, ["book_id", "audio_file"], "left").join(by_name, ["book_id", "chapter_num"], "left").join(by_place, ["book_id", "chapter_num"], "left")
        .select("book_id", "chapter_num", F.coalesce(F.when(F.col("known"), F.col("audio_file")), "named", "placed").alias("recording"))
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def pcm_samples(content: pd.Series) -> pd.Series:
    """Samples between -1 and 1 of 16-bit mono WAV files."""

    def read(raw):
        with wave.open(io.BytesIO(bytes(raw))) as w:
            return (np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32768).astype(np.float32)

    return content.map(read)


def natural_key(name: Column) -> Column:
    """A sort key under which numbers in names stand in order of value."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(\d+)", "000000000000$1"), r"0*(\d{12})(?!\d)", "$1")


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.75, "high").when(x >= 0.45, "middle").otherwise("low")
