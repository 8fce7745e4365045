"""Headings, anchors and chapter maps against plain definitions; joins of intervals against all pairs."""

from __future__ import annotations

import difflib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import chapter_map as M
from tidemark.operators import chapters as C
from tidemark.operators import intervals as I
from tidemark.operators import timing as T

WORDS = [f"słowo{k}" for k in range(400)]


def prose(seed, n=200):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def plain_form(text):
    """The search form by its definition: what each sign gives, spaces in a row once."""
    kept = [(c.lower() if c.isalnum() else " ", k) for k, c in enumerate(text)]
    kept = [x for n, x in enumerate(kept) if x[0] != " " or n and kept[n - 1][0] != " "]
    return "".join(s for s, _ in kept), [k for _, k in kept]


def test_headings_and_scores(spark):
    text = "Wstęp\n\nRozdział pierwszy. Dom\n" + prose(1) + "\n\nROZDZIAŁ II\n\nLas\n" + prose(2) + "\nRozdział 3\n" + prose(3)
    found = C.headings(spark.createDataFrame([("b", text)], "book_id STRING, text STRING"))
    own = found.filter("pattern = 'rozdzial_named'").orderBy("idx").collect()
    assert [(r.number, r.title) for r in own] == [(1, "Dom"), (2, "Las"), (3, "")]
    assert [text[r.match_start : r.body_start].strip() for r in own] == ["Rozdział pierwszy. Dom", "ROZDZIAŁ II", "Rozdział 3"]
    expected = spark.createDataFrame([("b", 3)], "book_id STRING, expected LONG")
    best = C.best_pattern(C.scores(found, expected)).first()
    assert best.pattern == "rozdzial_named" and best.score > 4.5  # all counted, numbers rise
    rows = C.chapters(found, C.best_pattern(C.scores(found, expected))).orderBy("text_start").collect()
    assert [(r.chapter_num, r.text_start, r.text_end) for r in rows] == [(r.number, r.body_start, n) for r, n in zip(own, [own[1].match_start, own[2].match_start, len(text)], strict=True)]


def test_headings_read_the_books_once(spark):
    """One pass over the lines for all patterns: their rows meet no other patterns' in one task by a union."""
    rows = [("a", "I.\n12\n\n* * *\nchapter V: five\nprolog\nrozdział drugi\n"), ("b", "")]
    found = C.headings(spark.createDataFrame(rows, "book_id STRING, text STRING"))
    assert [(r.pattern, r.number, r.title, r.idx) for r in found.orderBy("match_start").collect()] == [
        ("roman_bare", 1, "12", 0), ("arabic_bare", 12, "* * *", 0), ("asterisks", None, "* * *", 0), ("chapter_named", 5, "five", 0), ("rozdzial_named", None, "rozdział drugi", 0), ("rozdzial_named", 2, "", 1),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_places_of_search_form(spark):
    texts = ["", " — ", "Ala ma  kota.", "x", "  x1,y ", "żółw!!", "a\n\nb "]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", X.search_places(F.col("t")).alias("p"), X.search_form(F.col("t")).alias("f")).collect()
    for r in got:
        form, places = plain_form(r.t)
        assert (r.f, list(r.p)) == (form, places)
        assert [r.t[p].lower() if r.t[p].isalnum() else " " for p in places] == list(form)


def anchor(spark, said, text):
    books = spark.createDataFrame([("b", text)], "book_id STRING, text STRING")
    r = M.book_anchors(books, spark.createDataFrame([("b", 1, said)], "book_id STRING, snippet_id INT, words ARRAY<STRING>")).first()
    return r.place, r.confidence


def test_anchor_search(spark):
    text = prose(5, 600)
    form, places = M.search_index(text)
    said = text.split()[300:340]
    behind = lambda place: plain_form(text[place:])[0]
    place, how = anchor(spark, said, text)
    assert behind(place).startswith(plain_form(" ".join(said[:5]))[0]) and how >= 0.75
    place, how = anchor(spark, ["dzień", "dobry", "państwu", *said], text)  # an introduction that isn't in the book
    assert behind(place).startswith(plain_form(" ".join(said[1:4]))[0]) and how >= 0.75
    inside = anchor(spark, said, text.replace(said[0], "nie" + said[0], 1).replace(f" {said[0]} ", f" nie{said[0]} "))
    assert inside[1] >= 0.75  # the first of five words may be part of a word
    broken = [w if k % 4 else "inne" for k, w in enumerate(said)]  # no five words as they stand: a scan at a step
    place, how = anchor(spark, broken, text)
    whole = plain_form(" ".join(broken))[0]
    step = max(200, len(whole) // 2)
    windows = {at: difflib.SequenceMatcher(None, whole, form[at : at + len(whole) + 100]).ratio() for at in range(0, max(1, len(form) - len(whole)), step)}
    assert (place, how) == (places[max(windows, key=windows.get)], pytest.approx(max(windows.values()), abs=0.0006))
    assert anchor(spark, ["a", "b", "c"], text) == anchor(spark, said[:2], text) == anchor(spark, said, "") == (-1, 0.0)


def test_stretches_do_not_matter(spark, monkeypatch):
    """Hits and scans across the borders of stretches, in a book with signs whose lower case is longer."""
    text = "İ " + prose(6, 900) + " Σ koniec"
    books = spark.createDataFrame([("b", text), ("c", "İ" + text)], "book_id STRING, text STRING")
    said = [text.split()[k : k + 30] for k in range(0, 850, 50)]
    rows = [(b, k, [w if i % 4 or k % 3 else "inne" for i, w in enumerate(s)]) for b in "bc" for k, s in enumerate(said)]
    asks = spark.createDataFrame(rows, "book_id STRING, snippet_id INT, words ARRAY<STRING>")
    found = []
    for size in (M.SIZE, 100):
        monkeypatch.setattr(M, "SIZE", size)
        found.append(sorted(tuple(r) for r in M.book_anchors(books, asks).collect()))
    assert found[0] == found[1]
    whole = [(b, k, w) for b, k, w in rows if "inne" not in w]
    place = {(b, k): p for b, k, p, _ in found[0]}
    assert len(whole) == 22 and all(0 <= place[b, k] - ("İ" * (b == "c") + text).index(" ".join(w)) < 150 for b, k, w in whole)


def test_recordings_take_their_places_in_turn(spark):
    """A passage that stands twice is taken first by one recording, then by the next; one that is nowhere stands where the search stood."""
    twice, parts = prose(21, 60), [prose(k, 120) for k in range(22, 25)]
    text = " ".join([parts[0], twice, parts[1], twice, parts[2]])
    heard = [parts[0].split()[:30], twice.split()[:30], twice.split()[:30], ["zupełnie", "inny", "tekst"], parts[2].split()[:30]]
    rows = [("b", f"{k}.mp3", 10.0, w) for k, w in enumerate(heard)]
    out = M.proposed(spark.createDataFrame([("b", text)], "book_id STRING, text STRING"), spark.createDataFrame(rows, "book_id STRING, audio_file STRING, duration DOUBLE, words ARRAY<STRING>"))
    got = [(r.text_start, r.confidence >= 0.75) for r in out.orderBy("chapter_num").collect()]
    second = text.index(twice, len(parts[0]) + 50)
    assert [g[1] for g in got] == [True, True, True, False, True]
    assert [got[k][0] for k in (0, 1, 2, 4)] == [0, len(parts[0]) + 1, second, text.index(parts[2])] and second < got[3][0] < got[4][0]


def test_dealing_recordings():
    assert M.dealt([100, 100], [10, 10]) == [0, 1]
    assert M.dealt([200, 100], [10, 10, 10]) == [0, 0, 1]
    assert M.dealt([100, 100, 100], [10, 10]) == [0, 1]
    assert M.dealt([300], [10, 10, 10]) == [0, 0, 0]
    assert M.dealt([100], [1, 100]) == [0, 0] and M.dealt([1, 1], [10, 10, 10]) == [0, 1, -1]


@pytest.fixture(scope="module")
def maps(spark):
    parts = [prose(k, 300) for k in range(10, 14)]
    head = lambda k: f"Rozdział {k}\n"
    books = {
        "agree": head(1) + parts[0] + "\n" + head(2) + parts[1], "merged": head(1) + parts[0] + "\n" + parts[1] + "\n" + head(2) + parts[2],
        "none": parts[0] + "\n" + parts[1], "alone": parts[3],
    }
    reads = {"agree": [0, 1], "merged": [0, 1, 2], "none": [0, 1]}
    rows = [(b, f"{n}.mp3", len(parts[k]) / 10.0, parts[k].split()[:40]) for b, own in reads.items() for n, k in enumerate(own)]
    recordings = spark.createDataFrame(rows, "book_id STRING, audio_file STRING, duration DOUBLE, words ARRAY<STRING>")
    out = {}
    for r in M.proposed(spark.createDataFrame(list(books.items()), "book_id STRING, text STRING"), recordings).collect():
        out.setdefault(r.book_id, []).append(r)
    return books, parts, {b: sorted(rows, key=lambda r: r.text_start) for b, rows in out.items()}


def test_map_of_agreeing_counts(maps):
    books, parts, out = maps
    assert [(r.chapter_num, r.audio_file, r.source, r.confidence) for r in out["agree"]] == [(1, "0.mp3", "headings:rozdzial_named", 1.0), (2, "1.mp3", "headings:rozdzial_named", 1.0)]
    assert [books["agree"][r.text_start : r.text_end].strip() for r in out["agree"]] == parts[:2] and out["agree"][0].warnings == []


def test_map_of_a_missing_heading(maps):
    books, parts, out = maps
    rows = out["merged"]
    assert [(r.chapter_num, r.header, r.audio_file, r.confidence) for r in rows] == [(1, "Rozdział 1", "0.mp3", 1.0), (2, "Rozdział 1 (cz. 2)", "1.mp3", 0.6), (3, "Rozdział 2", "2.mp3", 1.0)]
    assert [books["merged"][r.text_start : r.text_end].strip() for r in rows] == parts[:3]
    assert {r.method for r in rows} == {"headings:rozdzial_named+reconciled"} and "cut in 2: Rozdział 1" in rows[0].warnings


def test_map_by_anchors_and_without_any(maps):
    books, parts, out = maps
    assert [(r.text_start, r.source) for r in out["none"]] == [(0, "anchor"), (len(parts[0]) + 1, "anchor")] and out["none"][0].warnings == ["no headings"]
    (one,) = out["alone"]
    assert (one.method, one.text_start, one.text_end, one.audio_file, one.confidence) == ("fallback", 0, len(parts[3]), None, 0.0)


def test_meeting_is_all_pairs_near(spark):
    rng = random.Random(2)
    spans = lambda n: [(rng.randrange(3), k, a := rng.uniform(-20, 50), a + rng.choice([0.0, 0.5, 30.0])) for k in range(n)]
    left, right = spans(60), spans(60)
    a = spark.createDataFrame(left, "chapter_num INT, i INT, s DOUBLE, e DOUBLE")
    b = spark.createDataFrame(right, "chapter_num INT, j INT, s2 DOUBLE, e2 DOUBLE")
    met = I.meeting(a, b, (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), 7.0).filter("s <= e2 and s2 <= e").select("i", "j").collect()
    assert sorted(map(tuple, met)) == sorted((i, j) for c, i, s, e in left for d, j, s2, e2 in right if c == d and s <= e2 and s2 <= e)
    points = a.select("chapter_num", "i", F.floor("s").alias("p"))
    marks = b.select("chapter_num", "j", F.floor("s2").alias("m"))
    after = {r.i: r.x for r in I.next_after(points, "p", marks, "m", F.col("m"), "x").collect()}
    before = {r.i: r.x for r in I.last_before(points, "p", marks, "m", F.col("m"), "x").collect()}
    at = {(d, j): int(s2 // 1) for d, j, s2, _ in right}
    for c, i, s, _ in left:
        own = [m for (d, _), m in at.items() if d == c]
        assert after[i] == min((m for m in own if m > s // 1), default=None) and before[i] == max((m for m in own if m < s // 1), default=None)


def test_insert_words(spark):
    said = [("raz", 1.0, 1.4), ("cztery", 2.6, 3.0)]
    rows = [
        (1, 0, 0, 1.0, 3.0, "raz cztery", None, True, "raz dwa trzy cztery", None, said), (1, 5, 0, 4.0, 6.0, "x", None, True, "a b c d", None, []),
        (1, 9, 0, 7.0, 8.0, "", None, False, None, None, None), (2, 0, 0, 0.0, 2.0, "", "całkiem co innego", False, None, None, said),
    ]
    schema = "chapter_num INT, anchor INT, nth INT, start_time DOUBLE, end_time DOUBLE, heard STRING, text STRING, edited BOOLEAN, typed STRING, breaks ARRAY<INT>, words ARRAY<STRUCT<w STRING, s DOUBLE, e DOUBLE>>"
    inserts = spark.createDataFrame(rows, schema)
    got = {}
    for r in T.insert_words(T.insert_texts(inserts).filter("n > 0")).orderBy("k").collect():
        got.setdefault((r.chapter_num, r.anchor), []).append((r.start, r.end))
    assert got[1, 0] == [(1.0, 1.4), (1.4, 1.8), (1.8, 2.2), (2.6, 3.0)]
    assert got[1, 5] == [(4.0, 4.5), (4.5, 5.0), (5.0, 5.5), (5.5, 6.0)]
    assert got[2, 0] == [(0.0, 0.667), (0.667, 1.333), (1.333, 2.0)]
    units = {(r.chapter_num, r.anchor): r for r in T.insert_units(inserts).collect()}
    assert units[1, 9].text == X.NO_SOURCE and (units[1, 9].first_start, units[1, 9].last_end) == (7.0, 8.0)


def test_a_line_goes_on_where_it_waited():
    """Recordings with too few words ask for no scan; a line that waited for one goes on from there and gives what it would as a whole."""
    fields = pa.schema([(c, pa.string()) for c in ("ask", "book_id")] + [(c, pa.int32()) for c in ("line", "seq", "start", "gap", "end", "fallback")] + [("sure", pa.float64()), ("mute", pa.bool_()), ("k", pa.int32()), ("pos", pa.int32()), ("how", pa.float64()), ("scan_start", pa.int32())])
    row = lambda seq, start, mute=False, k=None, pos=None, how=None, scan=None: dict(zip(fields.names, (f"b/{seq}", "b", 0, seq, start, 50, None, None, 0.0, mute, k, pos, how, scan), strict=True))
    first = [row(0, 0, k=0, pos=10, how=0.6), row(0, 0, k=1, pos=300, how=0.9), row(0, 0, k=2, pos=5, how=1.0), row(1, 0, mute=True)]
    rest = lambda start: [row(2, start, k=-1, pos=700, how=0.5, scan=350), row(3, start, k=0, pos=100, how=1.0), row(3, start, k=1, pos=800, how=0.7)]

    def turns(rows, size):
        return [tuple(x.values())[3:] for b in M._turns(pa.RecordBatch.from_pylist(rows[k : k + size], fields) for k in range(0, len(rows), size)) for x in b.to_pylist()]

    for size in (1, 2, 100):
        waiting = turns([*first, row(2, 0), row(3, 0, k=1, pos=800, how=0.7)], size)
        assert waiting == [(0, 300, 0.9, True, False), (1, 350, 0.0, False, False), (2, 350, 0.0, False, True)]
        later = turns(rest(350), size)
        assert later == [(2, 700, 0.5, True, False), (3, 800, 0.7, True, False)]
        assert turns(first + rest(0), size) == waiting[:2] + later
