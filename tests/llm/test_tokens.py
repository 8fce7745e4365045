"""Encoding, plane files and packing against the tokenizers library and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import planes, tokens

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aAbéÉßñÜİIi 's'll09.,- \u0085́\x1c<|\n", max_size=60))
def test_encoder_equals_library(text):
    want = Tokenizer.from_file(tokens.default_path()) if not hasattr(test_encoder_equals_library, "t") else test_encoder_equals_library.t
    test_encoder_equals_library.t = want
    got = np.frombuffer(tokens.encoder(tokens.default_path()).encode(text.encode()), "<u4").tolist()
    assert got == want.encode(text, add_special_tokens=False).ids


def test_special_strings(library):
    text = "a<|endoftext|> b <|startoftext|>c"
    got = np.frombuffer(tokens.encoder(tokens.default_path()).encode(text.encode()), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_segment_round_trip(bits, block):
    rng = random.Random(5)
    docs = [(k if k != 3 else None, [rng.choice([0, 1, 2, 49407, 2**32 - 1, 65536]) for _ in range(rng.randint(1, 40))]) for k in range(9)]
    raw = [np.array(x, "<u4").tobytes() for _, x in docs]
    seg = planes.Segment(planes.pack_segment([d for d, _ in docs], raw, bits, block))
    assert [(d, x) for d, _, x in seg.documents()] == [(d, x) for (d, _), x in zip(docs, raw, strict=True)]
    flat = np.frombuffer(b"".join(raw), "<u4")
    for a, b in [(0, 1), (3, 50), (len(flat) - 1, len(flat) + 5), (8, 8)]:
        assert seg.read(a, b).tolist() == flat[a:b].tolist()


def rows(spark):
    texts = [None, "", " \n", "One fish two fish", "héllo wörld's", "x " * 5000, "Two", "Two"]
    return spark.createDataFrame([(10 - i, t, None, "s", None) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)] * 2, DOCS)


@pytest.mark.parametrize("bits", [1, 8])
def test_plane_files(spark, library, bits):
    path = planes.new_path(spark)
    planes.write(rows(spark), path, bits=bits)
    got = sorted(planes.read_documents(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    at = 0
    for g, w in zip(got, want, strict=True):
        ids = [*library.encode(w.text or "", add_special_tokens=False).ids, planes.END]
        assert (g.doc_id, g.start, bytes(g.ids)) == (w.doc_id, at, np.array(ids, "<u4").tobytes())
        assert zlib.crc32(bytes(g.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_plane_files_of_nothing(spark):
    path = planes.new_path(spark)
    planes.write(rows(spark).limit(0), path)
    assert planes.read_documents(spark, path).collect() == []


def test_hilbert_curve_is_a_walk():
    """Every cell has its own place, and neighbours on the curve are neighbours in space."""
    from tidemark.llm import packing

    for dims, bits in [(2, 4), (3, 3)]:
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("length", [8, 2048])
def test_packing(spark, library, length):
    from tidemark.llm import packing

    got = packing.pack(rows(spark), length=length).collect()
    want = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, packing.END]) for r in rows(spark).collect()]
    assert sum(len(r.ids) // 4 for r in got) == sum(len(x) for _, x in want)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for doc_id, ids in want:
        if doc_id is not None:
            own = sorted(pieces[doc_id])
            assert sum((x for _, x, _ in own), []) == ids and own[0][0] == 0 and {n for *_, n in own} == {len(ids)}
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0
    assert packing.pack(rows(spark).limit(0)).collect() == []


def test_packing_follows_the_curve(spark, library):
    """Documents lie in the stream in order of their Hilbert keys, long ones in one stretch, whatever the columns around them."""
    from tidemark.llm import packing

    rng = random.Random(3)
    topics = [[f"t{t}w{k}" for k in range(30)] for t in range(6)]
    texts = [" ".join(rng.choice(topics[k % 6]) for _ in range(rng.choice([3, 40, 300, 6000]))) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").selectExpr("*", "1 AS place", "2 AS ids", "3 AS start", "4 AS total")
    got = sorted(packing.pack(docs, length=512).collect(), key=lambda r: (r.sequence_id, r.offset))
    ids = [[*library.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    slots = [[(i * 2654435761 % 2**32) >> 24 for i in x[:-1]] for x in ids]
    places = packing.curve_places(np.array([np.bincount(s, minlength=packing.FEATURES) for s in slots], np.float64)).tolist()
    order = [r.doc_id for k, r in enumerate(got) if k == 0 or got[k - 1].doc_id != r.doc_id]
    assert sorted(order) == list(range(60))  # each in one stretch
    assert [places[d] for d in order] == sorted(places)
    whole = {}
    for r in got:
        assert r.start == len(whole.setdefault(r.doc_id, []))
        whole[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert [whole[k] for k in range(60)] == ids
    near = np.mean([a % 6 == b % 6 for a, b in zip(order, order[1:])])
    assert near > 0.4  # documents of one topic lie together: one in six would by chance


def test_two_segments_in_a_shard(spark, library, monkeypatch):
    """A shard of several segments, columns that clash, and a document longer than a segment."""
    monkeypatch.setattr(planes, "SEGMENT", 700)
    docs = spark.createDataFrame([(k, "one two " * n) for k, n in enumerate([5, 300, 3, 40, 1000, 0, 200])], "doc_id LONG, text STRING").selectExpr("*", "1 AS shard", "2 AS segment", "3 AS base")
    path = planes.new_path(spark)
    planes.write(docs, path, shards=1)
    assert spark.read.parquet(path).count() >= 3
    at = 0
    for r in sorted(planes.read_documents(spark, path).collect(), key=lambda r: r.doc_id):
        want = [*library.encode(docs.filter(f"doc_id = {r.doc_id}").first().text, add_special_tokens=False).ids, planes.END]
        assert (r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (at, want)
        at += len(want)
