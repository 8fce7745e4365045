"""Spans against an exhaustive search; accuracy on held-out documents."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pytest

from tidemark.llm import langid

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
EN = "the house and the river with a long road over that hill where they lived"
FR = "la maison et les rivières avec une longue route sur cette colline où ils vivaient"
RU = "дом и река с длинной дорогой через тот холм где они жили"


def cost(scores, path, switch):
    return sum(scores[t, k] for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_path_is_best(seed):
    rng = np.random.default_rng(seed)
    scores = rng.uniform(-6, 0, (6, 3)) * (1 if seed % 2 else 0.3)
    best = max(cost(scores, p, 3.0) for p in product(range(3), repeat=6))
    for path in (langid.viterbi(scores, 3.0), langid.label(scores, 3.0)):
        assert cost(scores, path.tolist(), 3.0) == pytest.approx(best)


def test_scores_of_many_words_are_those_of_each():
    counts = [("en", "t", g, 3) for g in ("^^t", "^th", "the", "he$")] + [("fr", "t", g, 2) for g in ("^^l", "^le", "le$")] + [("en", "w", "the", 5), ("fr", "w", "le", 4), ("en", "s", "Latin", 9), ("fr", "s", "Latin", 9), ("ru", "s", "Cyrillic", 5)]
    model = langid.Model(counts)
    words = ["the", "le", "x", "дом", "thethethe", "é" * 400]
    letters = len({g[2] for _, kind, g, _ in counts if kind == "t"}) + 1
    for word, row in zip(words, model.score(words), strict=True):
        logs = []
        for lang in model.langs:
            n = {g: c for own, kind, g, c in counts if (own, kind) == (lang, "t")}
            x = sum(math.log((n.get(g, 0) + 0.1) / (sum(c for h, c in n.items() if h[:2] == g[:2]) + 0.1 * letters)) if any(g == h for _, kind, h, _ in counts if kind == "t") else math.log(0.1 / letters) for g in langid.trigrams(word))
            share = sum(c for own, kind, w, c in counts if (own, kind, w) == (lang, "w", word)) / (sum(c for own, kind, _, c in counts if (own, kind) == (lang, "w")) or 1)
            known = any((kind, w) == ("w", word) for _, kind, w, _ in counts)
            x = math.log(0.5 * math.exp(max(x, -700)) + 0.5 * share) if known else x
            logs.append(x if (lang == "ru") == (word == "дом") else -math.inf)
        assert row.tolist() == pytest.approx([langid.NEVER if x == -math.inf else max(x - max(logs), -langid.MOST) for x in logs])
    assert (model.score(words) == np.concatenate([model.score([w]) for w in words])).all()


def docs(spark):
    rows = [(k, " ".join((EN, FR, RU)[k % 3].split()[k % 5 :] * 3), ("en", "fr", "ru")[k % 3], None, None) for k in range(60)]
    rows += [(100, None, "en", None, None), (101, "12 34 !!", "fr", None, None), (102, " ".join([EN] * 4 + [FR] * 3), None, None, None)]
    rows += [(102, RU, None, None, None), (103, "", None, None, None), (None, EN, None, None, None), (104, "ñ " * 4000, None, None, None)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS spans", "'x' AS lang_pred")


def test_spans(spark):
    model = langid.fit(docs(spark))
    assert model.langs == ["en", "fr", "ru"] and model.candidates["Cyrillic"] == {2}
    got = langid.identify(docs(spark).select("doc_id", "text"), model).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 102}
    assert len(got) == 67
    for k in range(60):
        assert by[k].lang_pred == ("en", "fr", "ru")[k % 3] and by[k].score == 1.0 and len(by[k].spans) == 1
    for k in (100, 101, 103):
        assert (by[k].lang_pred, by[k].score, by[k].spans) == ("und", 0.0, [])
    assert by[None].lang_pred == "en"
    mixed = next(r for r in got if r.doc_id == 102 and len(r.spans) > 1)
    n = len(EN.split()) * 4
    assert [(s.first, s.last, s.lang) for s in mixed.spans] == [(0, n - 1, "en"), (n, n + len(FR.split()) * 3 - 1, "fr")]
    assert mixed.lang_pred == "en" and 0.5 < mixed.score < 0.7


def test_scripts_narrow(spark):
    """Words in a script that only one language uses are that language's, whatever stands around them."""
    model = langid.fit(docs(spark))
    text = " ".join([EN, EN, "дом и река", EN])
    n = len(EN.split())
    for words, spans in [
        (text, [(0, 2 * n - 1, "en"), (2 * n, 2 * n + 2, "ru"), (2 * n + 3, 3 * n + 2, "en")]),
        (f"{EN} роадroad {EN}", None),
        (f"{EN} ρίβερ {EN}", [(0, 2 * n, "en")]),  # Greek, which nobody learned, narrows nothing
    ]:
        row = langid.identify(spark.createDataFrame([(1, words)], "doc_id LONG, text STRING"), model).first()
        assert row.lang_pred == "en"
        if spans:
            assert [(s.first, s.last, s.lang) for s in row.spans] == spans
    assert row.score == 1.0
    score = model.score(["дом", "домhouses", "домыhou"])
    assert score[0].tolist() == pytest.approx([langid.NEVER, langid.NEVER, 0.0])
    assert score[1][2] == langid.NEVER and score[1].max() == 0.0  # most of its letters are Latin
    assert score[2].tolist() == pytest.approx([langid.NEVER, langid.NEVER, 0.0])


def test_every_word_of_the_sample_counts(spark):
    """A word met once still tells languages apart."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("aaa bbb abab", "x"), ("aaa bbb baba", "y")])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"))
    assert model.score(["abab"])[0].argmax() == 0 and model.score(["baba"])[0].argmax() == 1
    assert langid.word_hash("abab") in model.word_hashes.tolist()


def test_nothing_learned(spark):
    model = langid.fit(docs(spark).filter("lang = 'none'"))
    assert {r.lang_pred for r in langid.identify(docs(spark), model).collect()} == {"und"}
    assert langid.identify(docs(spark).limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    table = spark.read.parquet(path)
    model = langid.fit(table.filter(langid.in_training()))
    out = table.filter(langid.held_out())
    found = {r.doc_id: r.lang_pred for r in langid.identify(out, model).collect()}
    right = [found[r.doc_id] == r.lang for r in out.select("doc_id", "lang").collect()]
    assert len(right) > 100 and np.mean(right) > 0.98
