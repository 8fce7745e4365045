"""The pipeline's stages on a fixture with planted cases, and awkward rows through all of them."""

from __future__ import annotations

import random

import corpus_pipeline
from tidemark.llm._shared import materialise

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def documents():
    rng = random.Random(8)
    en = ["the", "river", "house", "where", "with", "they", "lived", "over", "that", "long"]
    fr = ["la", "rivière", "maison", "où", "avec", "ils", "vivaient", "sur", "cette", "longue"]
    rows = []
    for k in range(60):
        words = [rng.choice(en if k % 2 else fr) + rng.choice(["", "s", "er", "ing"]) for _ in range(150)]
        rows.append((k, " ".join(words), "en" if k % 2 else "fr", f"src{k % 4}", 0))
    near = rows[7][1].split()
    near[40] = "changed"
    return rows + [(500, rows[3][1], "en", "src0", 0), (501, " ".join(near), "en", "src1", 0), (502, None, None, None, None), (503, "12 -- !!", "en", "src0", 0), (None, "the house with long river", "en", None, 0)]


def test_stages(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), name)
        seen[name] = docs
        if name != "packed":
            assert docs.columns == names
    ids = {name: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect()) for name, df in seen.items()}
    assert ids["language_id"] == sorted([-1, *range(60), 500, 501])
    assert ids["exact_duplicates"] == sorted(set(ids["language_id"]) - {3})
    assert ids["near_duplicates"] == sorted(set(ids["exact_duplicates"]) - {501})
    assert set(ids["source_mix"]) <= set(ids["near_duplicates"])
    words = sum(len(r.text.split()) for r in seen["near_duplicates"].collect())
    assert abs(sum(len(r.text.split()) for r in seen["source_mix"].collect()) - words) <= 5 * 150
    assert sum(r.start == 0 for r in seen["packed"].collect()) == len(ids["source_mix"])
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.collect() == []


def test_awkward_columns_through_all_stages(spark):
    """Names with dots, and those that stages use themselves, pass untouched; a very long text too."""
    extra = ["a.b", "c.d.e", "doc", "mark", "size", "digest", "node", "copies", "words", "own_id", "target", "ids"]
    rows = [(*r, *range(len(extra))) for r in [*documents(), (600, "the river house " * 40_000, "en", "src2", 0)]]
    kinds = DOCS + "".join(", `" + c.replace("`", "``") + "` INT" for c in extra)
    docs = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, ""), name)
        assert docs.columns == [*DOCS.replace(" LONG", "").replace(" STRING", "").split(", "), *extra]
        assert {tuple(r)[5:] for r in docs.collect()} == {tuple(range(len(extra)))}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and 600 in {r.doc_id for r in packed}
