"""Rules on the licences' own texts, and the query against its SQL there."""

from __future__ import annotations

import duckdb

from tidemark.llm import licences, queries_licences

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
TEXTS = [
    (GPL.format(":", ",", 3), "gpl3-header-printed", "GPL-3.0-or-later"),
    (GPL.format(";", ";", 3), "gpl3-header-semicolon", "GPL-3.0-or-later"),
    (GPL.format(";", ";", 2), "gpl2-header-printed", "GPL-2.0-or-later"),
    (GPL.format(";", ",", 2), "gpl2-header-comma", "GPL-2.0-or-later"),
    (APACHE, "apache-header-plain", "Apache-2.0"),
    ("This program is free software.", "", ""),
]


def compare(spark, folder, texts):
    spark.createDataFrame([(k, t, "en", "src0", 0) for k, t in enumerate(texts)], DOCS).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries_licences.op10_licence_rules(spark, str(folder)).collect())
    assert got == sorted(con.sql(queries_licences.OP10_SQL).fetchall())
    return got


def test_own_texts(spark, tmp_path):
    got = compare(spark, tmp_path, [t for t, _, _ in TEXTS])
    assert [r[3:] for r in got] == [x[1:] for x in TEXTS]


def test_every_rule_matches_its_sentences(spark, tmp_path):
    got = compare(spark, tmp_path, [". ".join(licences.SENTENCES[n] for n in ids) + "." for _, _, ids in licences.RULES])
    for r, (rule, licence, _) in zip(got, licences.RULES, strict=True):
        assert rule in r[3].split(",") and licence in r[4].split(",")


def test_wrapped_anchor(spark, tmp_path):
    """No anchor may span words: between them stand line ends, tabs, hyphens or comment signs."""
    assert all(a.isalpha() for a in licences.ANCHORS)
    parts = ["public\ndomain", "public  domain", "public\tdomain", "public-domain", "public\n# domain"]
    got = compare(spark, tmp_path, [f"This is free and unencumbered software released into the {p}." for p in parts])
    assert [r[4] for r in got] == ["Unlicense"] * len(parts)
