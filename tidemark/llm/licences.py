"""Licence scans by sentence rules (built-in functions only).

A text is cut into sentences, each is normalised and hash-joined with the table of known licence sentences; the
identifiers found, in order, are matched against the table of rules, each an ordered run of identifiers: rules are
hash-joined on their first identifier, and their run is compared. Two ways of cutting are used, since licences come one
sentence a line or wrapped: by lines and ends of sentences, and by ends of sentences and blank lines alone. A rule
matches if it does in either.

``sentence_table`` and ``rule_table`` hold the rule base below; any other tables of the same columns will do. Tables of up
to BROADCAST rows are sent to the executors, larger ones are shuffled.

Every sentence of the rule base holds one of ANCHORS (checked when the module is loaded), so texts without any are
not cut at all. An anchor stands within one word, which normalising leaves whole: nothing can be missed by that. With
tables of the caller's own all texts are cut.

Defined cases: null and empty texts and texts without known sentences have empty results; repeats of a
sentence count each time; a rule's run may be interrupted by unknown sentences, not by known ones; of two
rules both are reported, also where one contains the other; rows alike in id and text have one result each;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import LOWER, UPPER, materialise, text_or_empty

# Known licence sentences, normalised (lower case; every run of other characters than letters
# and digits is one space), by identifier.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    7: "you may obtain a copy of the license at",
    8: "http www apache org licenses license 2 0",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "see the license for the specific language governing permissions and limitations under the license",
    10: "released under the mit license",
    11: "licensed under the mit license",
    12: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    13: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    14: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    23: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    25: "this program is free software",
    26: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    27: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    28: "either version 2 of the license or at your option any later version",
    29: "this program is distributed in the hope that it will be useful but without any warranty",
    35: "without even the implied warranty of merchantability or fitness for a particular purpose",
    36: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    37: "either version 3 of the license or at your option any later version",
    24: "see the gnu general public license for more details",
    30: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    31: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    32: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    33: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    40: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    50: "licensed under cc by nc 4 0",
    51: "licensed under cc by 4 0",
    52: "licensed under cc by sa 4 0",
    53: "this work is licensed under a creative commons attribution 4 0 international license",
    60: "this is free and unencumbered software released into the public domain",
    70: "this library is free software",
    71: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    72: "either version 2 1 of the license or at your option any later version",
    73: "this library is distributed in the hope that it will be useful but without any warranty",
    74: "see the gnu lesser general public license for more details",
    75: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    76: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    77: "see the gnu affero general public license for more details",
    80: "this source code form is subject to the terms of the mozilla public license v",
    81: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    82: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    83: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    84: "distributed under the boost software license version 1 0",
    90: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    91: "this software is distributed without any warranty",
    92: "this software is provided as is without any express or implied warranty",
    93: "in no event will the authors be held liable for any damages arising from the use of this software",
    94: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    95: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    96: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
}
# Rules as (rule, licence, ordered sentence identifiers).
RULES = [
    ("apache-line", "Apache-2.0", [1]),
    ("apache-header", "Apache-2.0", [2, 3, 4, 5, 6]),
    ("apache-header-plain", "Apache-2.0", [2, 3, 7, 8, 5, 6]),
    ("mit-line", "MIT", [10]),
    ("mit-line-licensed", "MIT", [11]),
    ("mit-text", "MIT", [12, 13, 14]),
    ("gpl3-line", "GPL-3.0", [20]),
    ("gpl3-header", "GPL-3.0-or-later", [21, 23, 24]),
    ("gpl2-header", "GPL-2.0-or-later", [22, 23, 24]),
    # The headers as they are printed, cut at ';' and ':'; before "either" stands a comma or a semicolon.
    ("gpl3-header-printed", "GPL-3.0-or-later", [25, 26, 29, 35, 24]),
    ("gpl3-header-semicolon", "GPL-3.0-or-later", [25, 27, 37, 29, 35, 24]),
    ("gpl2-header-printed", "GPL-2.0-or-later", [25, 27, 28, 29, 35, 24]),
    ("gpl2-header-comma", "GPL-2.0-or-later", [25, 36, 29, 35, 24]),
    ("bsd2-text", "BSD-2-Clause", [30, 31, 32]),
    ("bsd3-text", "BSD-3-Clause", [30, 31, 32, 33]),
    ("isc-text", "ISC", [40]),
    ("cc-by-nc-line", "CC-BY-NC-4.0", [50]),
    ("cc-by-line", "CC-BY-4.0", [51]),
    ("cc-by-sa-line", "CC-BY-SA-4.0", [52]),
    ("cc-by-text", "CC-BY-4.0", [53]),
    ("unlicense-line", "Unlicense", [60]),
    ("lgpl21-header", "LGPL-2.1-or-later", [70, 71, 72, 73, 35, 74]),
    ("lgpl3-header", "LGPL-3.0-or-later", [25, 75, 29, 35, 74]),
    ("agpl3-header", "AGPL-3.0-or-later", [25, 76, 29, 35, 77]),
    ("mpl2-header", "MPL-2.0", [80, 81]),
    ("mpl2-header-http", "MPL-2.0", [80, 82]),
    ("epl2-header", "EPL-2.0", [83]),
    ("boost-line", "BSL-1.0", [84]),
    ("cc0-text", "CC0-1.0", [90, 91]),
    ("zlib-text", "Zlib", [92, 93, 94]),
    ("0bsd-text", "0BSD", [95]),
    ("bsd4-text", "BSD-4-Clause", [30, 31, 32, 96]),
]
ANCHORS = ["licens", "permission", "redistribut", "copyright", "warrant", "unencumbered", "software", "mozilla"]
if not all(re.fullmatch("[a-z]+", a) for a in ANCHORS):
    raise ValueError("an anchor is not within one word")
if not all(any(a in s for a in ANCHORS) for s in SENTENCES.values()):
    raise ValueError("a known sentence has no anchor")

SPACE, STOP = r"[ \t\n\r\f]", r"[.!?;:]"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))


def _cut(text: Column, by_lines: bool) -> Column:
    """Sentences of a text. Only breaks that every cut has to make are made, so abbreviations stay whole."""
    unwrapped = text if by_lines else F.regexp_replace(F.regexp_replace(text, r"\r?\n[ \t\r\n\f]*\n", "\u001e"), r"[\r\n]+", " ")
    return F.split(F.regexp_replace(unwrapped, f"({STOP}){SPACE}+", "$1\u001e"), "[\u001e\n\r]" if by_lines else "\u001e")


#: Rows of a table that is sent to the executors: some 20 MB.
BROADCAST = 50_000


def sentence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENTENCES.items()), "id INT, sentence STRING")


def rule_table(spark: SparkSession) -> DataFrame:
    """``nth, rule, licence, ids``: rules in the order in which they are reported."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], "nth INT, rule STRING, licence STRING, ids ARRAY<INT>")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST + 1).count() <= BROADCAST else table


def _run(ids: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ","), F.lit(","))


def scan(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids (by lines), wrapped_ids, rules, licences (arrays)."""
    spark = docs.sparkSession
    suspect = F.lit(sentences is not None)
    for anchor in ANCHORS:
        suspect = suspect | F.translate(F.col("text"), UPPER, LOWER).contains(anchor)
    sentences, rules = sentence_table(spark) if sentences is None else sentences, rule_table(spark) if rules is None else rules
    # Normalising never lengthens a sentence, and its lengths bound what can be known.
    shortest, longest = sentences.agg(F.coalesce(F.min(F.length("sentence")), F.lit(0)), F.coalesce(F.max(F.length("sentence")), F.lit(0))).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"), 256)
    cut = F.array(*(F.struct(F.lit(way).alias("way"), _cut(F.col("text"), way == 0).alias("parts")) for way in (0, 1)))
    parts = rows.filter(suspect).select(key.alias("key"), F.explode(cut).alias("c")).select("key", "c.way", F.posexplode("c.parts").alias("at", "part")).filter(F.length("part") >= shortest)
    named = parts.select("key", "way", "at", normalised(F.col("part")).alias("sentence")).filter(F.length("sentence") <= longest)
    met = named.join(_small(sentences.select("id", "sentence")), "sentence")
    ids = lambda way: F.transform(F.array_sort(F.collect_set(F.when(F.col("way") == way, F.struct("at", "id")))), lambda x: x["id"])
    found = materialise(met.groupBy("key").agg(ids(0).alias("sentence_ids"), ids(1).alias("wrapped_ids")), "licence_sentences")
    first = rules.select("nth", "rule", "licence", F.element_at("ids", 1).alias("first"), _run(F.col("ids")).alias("run"))
    starts = found.select("key", "sentence_ids", "wrapped_ids", F.explode(F.array_union("sentence_ids", "wrapped_ids")).alias("first"))
    hits = starts.join(_small(first), "first").filter(_run(F.col("sentence_ids")).contains(F.col("run")) | _run(F.col("wrapped_ids")).contains(F.col("run")))
    ruled = hits.groupBy("key").agg(F.transform(F.array_sort(F.collect_set(F.struct("nth", "rule"))), lambda x: x["rule"]).alias("rules"), F.array_sort(F.collect_set("licence")).alias("licences"))
    whole = found.join(ruled, "key", "left")
    # Only texts with a known sentence have a key, so the others aren't shuffled by it.
    keyed = rows.select("doc_id", F.when(suspect, key).alias("key"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    kinds = {"sentence_ids": "int", "wrapped_ids": "int", "rules": "string", "licences": "string"}
    return keyed.join(whole, "key", "left").select("doc_id", *(F.coalesce(c, none(k)).alias(c) for c, k in kinds.items()))
