"""Exports as files, read back; exports that fail leave no file behind."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import views as V
from tidemark.sources import export as E

BOARDS = "book_id STRING, chapter_num LONG, chunk_id INT, text STRING, chunk_type STRING, start_time DOUBLE, end_time DOUBLE"


def boards(spark):
    rows = [(b, c, k, f"Tekst {k}\nżółć" if k % 3 else "", "narration", k * 2.0, k * 2.0 + 1.5) for b in ("Zły: tytuł?", "b 2") for c in (1, 12, 1000) for k in range(1, 6)]
    return spark.createDataFrame(rows, BOARDS)


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files if not f.startswith("."))


def test_tree_equals_the_views(spark, tmp_path):
    folder = str(tmp_path / "out")
    E.write_files(E.packages(boards(spark)).repartition(3), folder)
    manifest = json.load(open(f"{folder}/manifest.json"))
    assert names(folder) == sorted([*(f["name"] for f in manifest), "manifest.json"]) and len(manifest) == 18
    want = {r.name: r.text for r in E.packages(boards(spark)).collect()}
    for f in manifest:
        data = open(f"{folder}/{f['name']}", "rb").read()
        assert (data.decode(), len(data), hashlib.sha256(data).hexdigest()) == (want[f["name"]], f["bytes"], f["sha256"])
    assert {r.name: r.text for r in E.read_files(spark, folder).collect()} == want
    assert V.srt(boards(spark)).filter("chapter_num = 12 AND book_id = 'b 2'").first().srt == want["b 2/012/subtitles.srt"]
    with pytest.raises(FileExistsError):
        E.write_files(E.packages(boards(spark)), folder)


@pytest.mark.parametrize("name", ["CASE WHEN id = 17 THEN raise_error('lost') ELSE concat('a/', id) END", "CASE WHEN id = 17 THEN '../x' ELSE concat('a/', id) END", "concat('a/', id % 19)"])
def test_a_failed_export_leaves_no_file(spark, tmp_path, name):
    """A task that fails, a name that leads out of the folder, and a name that comes twice."""
    folder = str(tmp_path / "out")
    with pytest.raises(Exception):  # noqa: B017
        E.write_files(spark.range(0, 20, 1, 4).select(F.expr(name).alias("name"), F.lit("x").alias("text")), folder)
    assert [n for n in names(tmp_path) if "_staging/" not in n] == []  # tasks that end after the failure may still leave something there
    E.write_files(spark.range(3).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("name"), F.lit("x").alias("text")), folder)
    assert names(tmp_path) == ["out/a/0", "out/a/1", "out/a/2", "out/manifest.json"]


def test_empty_export(spark, tmp_path):
    E.write_files(E.packages(boards(spark).limit(0)), str(tmp_path / "none"))
    assert names(tmp_path / "none") == ["manifest.json"]
