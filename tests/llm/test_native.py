"""The native operators against their SQL on a fixture of awkward rows, and their other interfaces."""

from __future__ import annotations

import hashlib
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, licences, mixing, queries_dedup, queries_licences, queries_sampling, tool_calls

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
MIT = "\n".join(f"{s}." for k, s in licences.SENTENCES.items() if k in (12, 13, 14))


def documents():
    texts = [None, "", " \t\n", "One two.", "One two.", "One two. ", "Released under the MIT License.", MIT, MIT.replace(" ", "\n", 1) + "\n\nEnd.", "x " * 9000, "Ünïcode wörds", "all rights reserved"]
    sources = ["src0", "src10", "src2", None, "src0", "", "src0", "ß", "src0", "src10", None, "src0"]
    rows = [(100 - k, t, "en", s, 1) for k, (t, s) in enumerate(zip(texts, sources, strict=True))]
    return rows + [(k, f"hot copy {k % 3}", "en", "src0", 1) for k in range(200, 500)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def by_sql(path, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con.sql(sql).fetchall(), [d[0] for d in con.sql(sql).description]


@pytest.mark.parametrize(
    ("query", "sql"),
    [
        (queries_sampling.op1_source_mixing, queries_sampling.OP1_SQL),
        (queries_dedup.op9_exact_dedup, queries_dedup.OP9_SQL),
        (queries_licences.op10_licence_rules, queries_licences.OP10_SQL),
    ],
)
def test_query_equals_sql(spark, folder, query, sql):
    rows, names = by_sql(folder, sql)
    got = query(spark, folder).select(*names).collect()
    round_ = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(round_, map(tuple, got)), key=str) == sorted(map(round_, rows), key=str)


def test_licences_found(spark, folder):
    found = {r.doc_id: r.licences for r in queries_licences.op10_licence_rules(spark, folder).collect()}
    assert found[94] == "MIT" and found[93] == "MIT" and found[92] == "MIT" and found[89] == ""


def test_mix_meets_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == len(documents()) and (rows.taken <= 3 * rows["size"]).all()
    for _, own in rows.groupby(rows.source.fillna("(null)")):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max() + 1e-6
    assert rows.groupby(rows.source.fillna("(null)")).target.first().sum() == pytest.approx(min(rows["size"].sum(), 3 * rows["size"].sum()))
    copies = mixing.mixed(docs.withColumnRenamed("n_chars", "size"))
    assert copies.columns == ["doc_id", "text", "lang", "source", "size"] and copies.count() == rows.copies.sum()
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_inclusion_rates(spark):
    """Over many draws each document comes as often as its weight asks; the greatest ones always."""
    sizes = [1, 1, 2, 2, 3, 4, 4, 5, 6, 8, 8, 10, 12, 16, 20, 40]
    draws, most = 600, sum(sizes)
    rows = [(1000 * d + k, "w " * n, f"s{d:04d}") for d in range(draws) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    for inclusion, weights in ((None, sizes), (docs.doc_id * 0 + 4, [4] * len(sizes))):
        # Every source's size is the same; targets are half of it and one and a half by turns.
        got = mixing.mix(docs, weights=(1.0, 3.0), inclusion=inclusion).selectExpr("doc_id % 1000 AS k", "copies - IF(target > size * 0 + source_size, 1, 0) AS drawn").groupBy("k").avg("drawn").collect()
        rate = {r[0]: r[1] for r in got}
        held = [2 ** (round(16 * math.log2(w)) / 16) for w in weights]
        sure: set[int] = set()
        while True:  # by the definition: what exceeds one is certain, the rest is shared anew
            need = most / 2 - sum(sizes[k] for k in sure)
            share = {k: need * held[k] / sum(held[j] * sizes[j] for j in range(len(sizes)) if j not in sure) for k in range(len(sizes)) if k not in sure}
            more = {k for k, p in share.items() if p >= 1}
            if not more:
                break
            sure |= more
        for k in range(len(sizes)):
            want = 1.0 if k in sure else share[k]
            assert rate[k] == pytest.approx(want, abs=4 * math.sqrt(max(want * (1 - want), 1e-9) / draws) + 0.06), (k, want)
        if inclusion is None:
            assert rate[15] == rate[15] and all(a <= b + 0.08 for a, b in zip([rate[k] for k in range(14)], [rate[k] for k in range(1, 15)], strict=True))


def test_targets_by_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "e": 300}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source STRING, source_size LONG")).collect()}
    weights, want, total = dict(zip(sizes, [5, 2, 1, 5, 2], strict=True)), {}, sum(sizes.values())
    while True:
        left, open_ = total - sum(want.values()), {s: w for s, w in weights.items() if s not in want}
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        above = {s: 3 * sizes[s] for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            break
        want |= above
    assert got == pytest.approx({**want, **share})


def test_index_keeps_what_it_has(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id LONG, text STRING")
    again = spark.createDataFrame([(7, "a"), (8, "c"), (8, "c"), (None, "d")], "doc_id LONG, text STRING")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.classes(first, index).collect()) == [(1, 2, False), (2, 2, True), (3, 3, True)]
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.classes(again, index).collect()}
    assert got == {(7, 2, False), (8, 8, True), (None, None, True)}
    assert {r.digest for r in index.read().collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in "abcd"}
    reopened = exact_dedup.DigestIndex(spark, index.path, 3)
    assert reopened.read().count() == 4
    kept = exact_dedup.deduplicate(again.withColumnRenamed("text", "text").selectExpr("*", "1 AS digest", "2 AS keep_id"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "d"), (7, "a"), (8, "c")] and kept.columns == ["doc_id", "text", "digest", "keep_id"]
    assert exact_dedup.deduplicate(first.limit(0)).collect() == []
    # Sizes and the largest id follow later batches; a text that is rare at first and hot later is looked up apart.
    many = spark.range(1000, 1400).selectExpr("id AS doc_id", "'b' AS text")
    assert {(r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(many, index).collect()} == {(3, 401, False)}
    assert {(r.keep_id, r.last_id, r.group_size) for r in reopened.read().collect() if r.keep_id == 2} == {(2, 7, 3)}
    clash = first.selectExpr("*", "1 AS __digest", "2 AS own_id", "3 AS `a.b`", "4 AS doc")
    assert sorted(tuple(r) for r in exact_dedup.deduplicate(clash, batches=2).collect()) == [(2, "a", 1, 2, 3, 4), (3, "b", 1, 2, 3, 4)]
    index.forget()
    assert not spark.catalog.tableExists(index.table)


def test_batch_that_comes_again(spark):
    """A driver that is lost behind an insert appends its batch once more under the same name."""
    index = exact_dedup.DigestIndex(spark, buckets=2)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id LONG, text STRING")
    for _ in range(2):
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(docs, index, batches=2, batch="monday").collect())
        assert [(d, n) for d, _, n, _ in got] == [(1, 2), (2, 2), (3, 1)] and sum(k for *_, k in got) == 2
    more = exact_dedup.classes(docs.limit(1), index, batch="tuesday").first()
    assert (more.group_size, more.kept) == (3, more.doc_id == more.keep_id)
    index.forget(files=True)


def test_tool_calls(spark):
    schema = spark.createDataFrame([("add", "a", "integer", True, 0.0, 9.0), ("add", "b", "number", False, None, None)], tool_calls.PARAMETERS)
    calls = spark.createDataFrame(
        [
            (1, "x", 0, "add", '{"b": 2.5, "a": 1}', None), (1, "y", 2, "add", '{"a": "1"}', "x"), (1, "z", 4, "add", '{"a": 99, "q": 1}', "y"), (1, "z", 5, "add", "{}", "y"),
            (1, "w", 6, "sub", "{}", "gone"), (1, "v", 7, "add", "nonsense", "z"), (2, "p", 0, "add", None, "q"), (2, "q", 1, "add", '{"b": 1}', "p"), (2, None, 3, "add", '{"a": 1}', None),
        ], tool_calls.CALLS,
    )
    results = spark.createDataFrame([(1, "x", 1, "3.5"), (1, "x", 3, "later"), (1, "lost", 9, "é\n"), (2, None, 4, "?"), (2, None, 5, "!"), (None, "x", 6, "no"), (1, "lost", 10, "more")], tool_calls.RESULTS)
    got = tool_calls.link(calls, results, schema).collect()
    by = {(r.conv_id, r.call_id, r.position): r for r in got}
    assert len(got) == len(calls.collect()) + 5  # each result without a call is a row
    assert sorted((r.position, json.loads(r.json)["result"]) for r in got if r.status == "orphan") == [(4, "?"), (5, "!"), (6, "no"), (9, "é\n"), (10, "more")]
    x = by[1, "x", 0]
    assert (x.level, x.status, x.valid, x.errors) == (0, "linked", True, "")
    assert x.json == '{"arguments":{"a":1,"b":2.5},"call_id":"x","name":"add","result":"3.5"}'
    assert (by[1, "y", 2].level, by[1, "y", 2].status, by[1, "y", 2].errors) == (1, "pending", "not integer a")
    assert (by[1, "z", 4].level, by[1, "z", 4].errors) == (2, "out of range a; unknown q")
    assert by[1, "z", 5].status == "repeated" and by[1, "z", 5].errors == "missing a" and by[1, "z", 5].level is None
    assert (by[1, "w", 6].level, by[1, "w", 6].errors) == (0, "no schema")
    assert (by[1, "v", 7].level, by[1, "v", 7].errors) == (3, "no object")
    assert by[2, "p", 0].status == by[2, "q", 1].status == "cyclic" and by[2, "p", 0].valid is False
    lost = by[1, "lost", 9]
    assert lost.status == "orphan" and lost.valid is None and json.loads(lost.json)["result"] == "é\n"
    assert tool_calls.link(calls.limit(0), results.limit(0), schema).collect() == []
    # Arguments under another name, and with a repeated key; a very long text and columns that clash.
    own = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"b": "' + "x" * 100_000 + '"}',)], "args STRING").withColumn("arguments", F.lit("{}"))
    parameters = F.array(F.struct(F.lit("a").alias("parameter"), F.lit("integer").alias("kind"), F.lit(True).alias("required"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most")))
    found = [r.e for r in own.select(tool_calls.errors(F.col("args"), parameters).alias("e")).collect()]
    assert found[0] == [] and found[1] == ["no object"] and found[2] == ["missing a", "unknown b"]


def test_chain_levels(spark):
    n = 150
    calls = spark.createDataFrame([(5, f"c{k}", f"c{k - 1}" if k else None) for k in range(n)], "conv_id LONG, call_id STRING, after STRING")
    assert sorted(r.level for r in tool_calls.levels(calls).collect()) == list(range(n))


