"""Texts as files: subtitles, slashed texts and label tracks of each chapter in a tree of named files, with a manifest.

Tasks write below ``_staging``; once all have ended the driver moves their files to their names and writes
``manifest.json`` last, so a folder with a manifest is whole, and one whose job was stopped has none. What a lost task
or a stopped job left is below ``_staging`` alone, and the next export removes it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.functions import text as X
from tidemark.operators import views as V

MANIFEST, STAGING = "manifest.json", "_staging"


def _store(folder: str):
    """The file system of a folder's address, and its path there; a path without a scheme is a local one."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder.rstrip("/")
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int, str]]  # name, where it is staged, bytes, SHA-256


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, root = _store(self.folder)
        own, files = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        for k, row in enumerate(iterator):
            if not row.name or row.name.startswith(("/", "_")) or ".." in row.name.split("/") or row.name == MANIFEST:
                raise ValueError(f"not a file name: {row.name!r}")
            data = (row.text or "").encode()
            system.create_dir(own, recursive=True)
            with system.open_output_stream(f"{own}/{k}") as out:
                out.write(data)
            files.append((row.name, f"{own}/{k}", len(data), hashlib.sha256(data).hexdigest()))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _store(self.folder)
        files = sorted(f for m in messages if m for f in m.files)
        names = [f[0] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        for folder in {f"{root}/{n}".rpartition("/")[0] for n in names} | {root}:
            system.create_dir(folder, recursive=True)
        for name, staged, _, _ in files:
            system.move(staged, f"{root}/{name}")
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([{"name": n, "bytes": size, "sha256": sha} for n, _, size, sha in files], ensure_ascii=False, indent=1).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, root = _store(self.folder)
        if system.get_file_info(f"{root}/{STAGING}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{STAGING}")


class TextFiles(DataSource):
    """``rows(name, text).write.format("textfiles").mode("append").option("folder", ...)``: one file a row."""

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return "name STRING, text STRING"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["folder"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``rows(name, text)`` as files in ``folder``, all of them or none. Names are unique and have no ``..``."""
    system, root = _store(folder)
    if system.get_file_info(f"{root}/{MANIFEST}").is_file:
        raise FileExistsError(f"{folder} has a manifest; export to a new folder")
    rows.sparkSession.dataSource.register(TextFiles)
    rows.select("name", "text").write.format("textfiles").mode("append").option("folder", folder).save()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, text`` of an export's files."""
    found = spark.read.option("recursiveFileLookup", True).option("wholetext", True).format("text").load(folder).select("value", F.col("_metadata.file_path").alias("at"))
    own = F.regexp_replace(F.url_decode("at"), "^.*" + "/" + folder.rstrip("/").rpartition("/")[2] + "/", "")
    return found.select(own.alias("name"), F.col("value").alias("text")).filter(F.col("name") != MANIFEST)


def packages(boards: DataFrame) -> DataFrame:
    """``name, text``: each chapter's subtitles, slashed text and labels under ``book/chapter``."""
    home = F.concat(X.safe_component(F.col("book_id")), F.lit("/"), F.lpad(F.col("chapter_num").cast("string"), 3, "0"), F.lit("/"))
    parts = ((V.srt(boards), "srt", "subtitles.srt"), (V.slashed(boards), "slashed", "boards.txt"), (V.labels(boards), "labels", "labels.txt"))
    out = [rows.select(F.concat(home, F.lit(file)).alias("name"), F.col(column).alias("text")) for rows, column, file in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
