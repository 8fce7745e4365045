"""Texts in old code pages, recordings by name, payloads and PCM sound."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import files as S

TEXT = "Zażółć gęślą jaźń, ŚĆ"


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "cp1250", "iso-8859-2", "cp852"])
def test_encodings(name):
    assert S.decoded(TEXT.encode(name)) == TEXT


def test_book_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes((TEXT + "\r\n" + "x" * 200 + "\r\n-----\r\nstopka").encode("cp1250"))
    (tmp_path / "b.mp3").write_bytes(b"")
    assert [tuple(r) for r in S.book_texts(spark, str(tmp_path), ["\n-----"]).collect()] == [("a", TEXT + "\n" + "x" * 200)]


def test_recordings(spark):
    files = spark.createDataFrame([("b", n) for n in ("x_002_y.mp3", "rozdzial-7.MP3", "a.flac", "note.txt")], "book_id STRING, name STRING")
    chapters = spark.createDataFrame([("b", 1, None), ("b", 2, None), ("b", 7, "a.flac"), ("b", 3, "gone.mp3"), ("b", 9, None)], "book_id STRING, chapter_num INT, audio_file STRING")
    got = {r.chapter_num: r.recording for r in S.recordings(chapters, files).collect()}
    assert got == {1: "a.flac", 2: "x_002_y.mp3", 7: "a.flac", 3: "x_002_y.mp3", 9: None}


def test_payloads(spark, tmp_path):
    rows = spark.createDataFrame([(1, "h", "a.mp3", 9.5, [(1, "t", "narration", 0.0, 1.5)], [("w", 0.0, 0.5, True)], [])], S.PAYLOAD)
    S.write_payloads(rows, str(tmp_path / "out"))
    (tmp_path / "out" / "broken.json").write_text('{"chapter_num": 1, "header": [')
    assert S.chapter_payloads(spark, str(tmp_path / "out")).collect() == rows.collect()


def test_pcm_and_keys(spark):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    got = spark.createDataFrame([(raw.getvalue(),)], "content BINARY").select(S.pcm_samples("content").alias("s")).first().s
    assert got == [0.0, 0.5, -1.0]
    names = ["b10.mp3", "b9.mp3", "a1.mp3"]
    rows = spark.createDataFrame([(n,) for n in names], "n STRING").orderBy(S.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["a1.mp3", "b9.mp3", "b10.mp3"]
