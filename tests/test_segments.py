"""Blocks, boards and tokens: invariants, and a plain-Python model of the packing."""

from __future__ import annotations

import random

from tests_models import lines_model, sentence_model

from tidemark.operators import segments as S

SAMPLE = "Pierwszy akapit narracji, twardo\nzłamany na dwa wiersze.\n\nDrugi akapit.\n\n— Kto tam? — zapytał.\n— To ja.\n— Wejdź.\n\nOstatni akapit."


def texts():
    rng = random.Random(4)
    out = [SAMPLE, "", "Jedno."]
    for _ in range(25):
        paragraphs = []
        for _ in range(rng.randint(1, 8)):
            said = rng.random() < 0.5
            n = rng.choice([1, 3, 20, 160])
            body = " ".join(rng.choice(["słowo", "i", "Kot", "dom.", "Tak!", "x" * 50]) for _ in range(n))
            paragraphs.append(("— " if said else "") + body.replace(" i ", "\ni ", 1))
        out.append("\n\n".join(paragraphs))
    return out


def block_model(text):
    import re

    out = []
    for p in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in p.strip().split("\n") if x.strip()]
        if len(lines) > 1 and any(x[0] in "—–-―“„\"" for x in lines):
            out += lines
        elif p.strip():
            out.append(p.strip())
    return out


def board_model(text, most=11):
    boards = []  # [text, dialogue, may grow]
    for b in block_model(text):
        said = b[0] in "—–-―“„\""
        if lines_model(b) > most:
            own = ""
            for s in sentence_model(b):
                if own and lines_model(own + " " + s) <= most:
                    own += " " + s
                else:
                    boards += [[own, said, False]] if own else []
                    own = s
            boards += [[own, said, False]] if own else []
        elif said and boards and boards[-1][2] and lines_model(boards[-1][0] + "\n" + b) <= most:
            boards[-1][0] += "\n" + b
        else:
            boards.append([b, said, said])
    return [(t, "dialogue" if d else "narration", lines_model(t)) for t, d, _ in boards]


def chapters(spark):
    return spark.createDataFrame([("b", k, t) for k, t in enumerate(texts())], "book_id STRING, chapter_num INT, text STRING")


def test_boards(spark):
    got = {}
    for r in S.boards(chapters(spark)).orderBy("chapter_num", "chunk_id").collect():
        got.setdefault(r.chapter_num, []).append((r.text, r.chunk_type, r.lines_count))
    for k, t in enumerate(texts()):
        assert got.get(k, []) == board_model(t)


def test_tokens_cover_and_slice(spark):
    rows = {}
    for r in S.tokens(chapters(spark)).orderBy("chapter_num", "token_idx").collect():
        rows.setdefault(r.chapter_num, []).append(r)
    for k, t in enumerate(texts()):
        own = rows.get(k, [])
        assert [r.word for r in own] == t.split()
        whole = "".join(r.word + r.sep for r in own)
        assert all(whole[r.char_start : r.char_end] == r.word for r in own)
        if own:
            assert own[-1].sep == ""


def test_layout_matches_boards(spark):
    layouts = {r.chapter_num: r for r in S.proposed_layout(chapters(spark)).collect()}
    for k, t in enumerate(texts()):
        sizes = [len(b.split()) for b, *_ in board_model(t)]
        ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        assert layouts[k].breaks == ends[:-1] and layouts[k].token_count == len(t.split())
