"""Editing board layouts: an ordered stream of operations folded into a chapter's state.

A chapter's state is small, and each operation needs the one before it, so a chapter's operations are one
group: ``edited`` folds them in a grouped function (``tidemark.streaming.edits`` does so on a stream).
Book boards and the boards of an insert are both intervals between breaks on a line of words, and share
one set of break edits. Operations that can't be done leave the state as it is and are reported.
"""

from __future__ import annotations

import json
import re
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT_KEY = re.compile(r"b(\d+)|i(\d+)\.(\d+)|end")
EMPTY_INSERT = {"text": None, "breaks": [], "edited": False}
OPS = "chapter_num LONG, op_id LONG, op STRING, key STRING, board INT, at INT, until INT, value DOUBLE, text STRING, n_words INT"
RESULT = "chapter_num LONG, breaks ARRAY<INT>, token_count INT, state STRING, rejected ARRAY<STRING>"


class Rejected(ValueError):
    """An operation that its layout doesn't allow."""


def edited_breaks(breaks: list[int], size: int, how: str, k: int, at: int | None = None):
    """(new breaks, ranges before, ranges after) of a split of board k, a merge of k with k + 1, or a move of break k."""
    edges = [0, *breaks, size]
    if how == "split":
        if not 0 <= k < len(edges) - 1 or not edges[k] < at < edges[k + 1]:
            raise Rejected("a split lies inside its board")
        return [*breaks[:k], at, *breaks[k:]], [(edges[k], edges[k + 1])], [(edges[k], at), (at, edges[k + 1])]
    if not 0 <= k < len(breaks):
        raise Rejected("there is no such break")
    old = [(edges[k], edges[k + 1]), (edges[k + 1], edges[k + 2])]
    if how == "merge":
        return [*breaks[:k], *breaks[k + 1 :]], old, [(edges[k], edges[k + 2])]
    if not edges[k] < at < edges[k + 2]:
        raise Rejected("a break stays between its neighbours")
    return [*breaks[:k], at, *breaks[k + 1 :]], old, [(edges[k], at), (at, edges[k + 2])]


def _whole(x):
    """Null as None, and whole numbers as such: a data frame holds nullable integers as floats."""
    return None if pd.isna(x) else int(x)


def operation(o) -> SimpleNamespace:
    """A row of OPS as an operation."""
    own = {c: _whole(getattr(o, c)) for c in ("op_id", "board", "at", "until", "n_words")}
    return SimpleNamespace(op=o.op, key=o.key, text=o.text, value=o.value, **own)


class Chapter:
    """A layout being edited. ``words``: the chapter's words, for texts of boards (rendered with spaces)."""

    def __init__(self, words: list[str], breaks: list[int]):
        self.words, self.breaks = words, list(breaks)
        self.overrides, self.reviewed, self.inserts, self.corrections = {}, [], {}, {}

    def text(self, r):
        return self.corrections.get(r) or " ".join(self.words[r[0] : r[1]])

    def correct(self, r, text: str):
        text = text.strip()
        if text and text != " ".join(self.words[r[0] : r[1]]):
            self.corrections[r] = text

    def forget(self, gone):
        self.overrides = {k: v for k, v in self.overrides.items() if not gone(k)}
        self.reviewed = [k for k in self.reviewed if not gone(k)]

    def checked(self, key: str) -> str:
        m = CUT_KEY.fullmatch(key or "")
        if not m or m[1] and int(m[1]) not in (0, len(self.words), *self.breaks):
            raise Rejected(f"no boundary is called {key}")
        return key

    # Operations: each takes a row of OPS.
    def op_split(self, o):
        self.breaks, (whole,), parts = edited_breaks(self.breaks, len(self.words), "split", o.board, o.at)
        if text := self.corrections.pop(whole, None):
            ws = text.split()
            # As much of the user's words goes left as of the book's; halves to the even side.
            cut = min(len(ws), max(0, round(len(ws) * (o.at - whole[0]) / (whole[1] - whole[0]))))
            self.correct(parts[0], " ".join(ws[:cut]))
            self.correct(parts[1], " ".join(ws[cut:]))

    def op_merge(self, o):
        self.breaks, old, (whole,) = edited_breaks(self.breaks, len(self.words), "merge", o.board)
        self.forget(lambda k: k == f"b{old[1][0]}")
        if any(r in self.corrections for r in old):
            both = " ".join(t for t in map(self.text, old) if t)
            for r in old:
                self.corrections.pop(r, None)
            self.correct(whole, both)

    def op_move(self, o):
        self.breaks, old, new = edited_breaks(self.breaks, len(self.words), "move", o.board, o.at)
        self.forget(lambda k: k == f"b{old[1][0]}")
        for was, now in zip(old, new, strict=True):
            if (text := self.corrections.pop(was, None)) is not None:
                self.correct(now, text)

    def op_cut_time(self, o):
        key = self.checked(o.key)
        if pd.isna(o.value):
            self.overrides.pop(key, None)
        else:
            self.overrides[key] = round(float(o.value), 3)

    def op_reviewed(self, o):
        key = self.checked(o.key)
        self.reviewed = [k for k in self.reviewed if k != key or o.value] + ([key] if o.value and key not in self.reviewed else [])

    def op_correction(self, o):
        text = (o.text or "").strip()
        self.corrections.pop((o.at, o.until), None)
        if text:
            self.corrections[o.at, o.until] = text

    def op_insert_text(self, o):
        self.inserts[o.at] = {"text": (o.text or "").strip(), "breaks": [], "edited": True}
        self.forget(lambda k: k.startswith(f"i{o.at}."))

    def _insert(self, o, how, at=None):
        state = self.inserts.get(o.at, EMPTY_INSERT)
        self.inserts[o.at] = {**state, "breaks": edited_breaks(state["breaks"], o.n_words, how, o.board, at)[0]}

    def op_insert_split(self, o):
        self._insert(o, "split", o.until)

    def op_insert_move(self, o):
        self._insert(o, "move", o.until)
        self.forget(lambda k: k == f"i{o.at}.{o.board + 1}")

    def op_insert_merge(self, o):
        self._insert(o, "merge")
        self.forget(lambda k: k.startswith(f"i{o.at}."))

    def apply(self, o):
        run = getattr(self, f"op_{o.op}", None)
        if run is None:
            raise Rejected(f"no operation is called {o.op}")
        try:
            run(operation(o))
        except TypeError as e:  # a parameter that the operation needs is null
            raise Rejected(f"{o.op} lacks a parameter") from e

    def stale(self) -> list[str]:
        """Corrections whose words are no board's any more."""
        edges = [0, *self.breaks, len(self.words)]
        live = set(zip(edges, edges[1:], strict=False))
        return sorted(f"{a}-{b}" for a, b in self.corrections if (a, b) not in live)

    def state(self) -> str:
        return json.dumps(
            {
                "overrides": self.overrides, "reviewed": self.reviewed, "inserts": {str(k): v for k, v in self.inserts.items()},
                "corrections": {f"{a}-{b}": t for (a, b), t in self.corrections.items()}, "stale": self.stale(),
            }, sort_keys=True, ensure_ascii=False,
        )


def folded(words: list[str], breaks: list[int], ops: pd.DataFrame) -> tuple[Chapter, list[str]]:
    chapter, rejected = Chapter(words, breaks), []
    for o in ops.sort_values("op_id").itertuples(index=False):
        if o.op == "reset":
            chapter = Chapter(words, breaks)
            continue
        try:
            chapter.apply(o)
        except Rejected as e:
            rejected.append(f"{o.op_id}: {e}")
    return chapter, rejected


def edited(layouts: DataFrame, ops: DataFrame) -> DataFrame:
    """RESULT of ``layouts(chapter_num, words, breaks)`` after ``ops`` (OPS) in order of op_id."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["chapter_num", "breaks", "token_count", "state", "rejected"])
        row = left.iloc[0]
        chapter, rejected = folded(list(row["words"]), [int(b) for b in row["breaks"]], right)
        return pd.DataFrame([(row["chapter_num"], chapter.breaks, len(chapter.words), chapter.state(), rejected)], columns=["chapter_num", "breaks", "token_count", "state", "rejected"])

    keyed = layouts.select("chapter_num", "words", "breaks").groupBy("chapter_num")
    return keyed.cogroup(ops.groupBy("chapter_num")).applyInPandas(run, RESULT)


def stale_corrections(corrections: DataFrame, bounds: DataFrame) -> DataFrame:
    """``corrections(chapter_num, lo, hi)`` that are no board's range."""
    return corrections.join(bounds.select("chapter_num", "lo", "hi"), ["chapter_num", "lo", "hi"], "left_anti")


def valid_cut_key(key: Column, breaks: Column, token_count: Column) -> Column:
    token = F.regexp_extract(key, r"^b(\d+)$", 1)
    at = F.when(token != "", token.cast("int"))
    return F.coalesce((at == 0) | (at == token_count) | F.array_contains(breaks, at), key.rlike(r"^(i\d+\.\d+|end)$"))


def warnings(board_lines: DataFrame, most: int = 11) -> DataFrame:
    """Boards with too many lines (warning) or none (error)."""
    level = F.when(F.col("lines_count") == 0, "error").when(F.col("lines_count") > most, "warning")
    return board_lines.withColumn("level", level).filter("level is not null")


def loaded_or_proposed(saved: DataFrame, proposed: DataFrame) -> DataFrame:
    """For each chapter the saved layout if it is of the same text (hash), else the proposal; ``origin`` says which."""
    s = saved.select("chapter_num", "text_hash", F.col("breaks").alias("own"))
    return proposed.join(s, ["chapter_num", "text_hash"], "left").select(
        "chapter_num", "text_hash", F.coalesce("own", "breaks").alias("breaks"), F.when(F.col("own").isNotNull(), "saved").otherwise("proposed").alias("origin")
    )


def archived(saved: DataFrame, proposed: DataFrame) -> DataFrame:
    """Saved layouts of texts that have changed since."""
    return saved.join(proposed.select("chapter_num", "text_hash"), ["chapter_num", "text_hash"], "left_anti")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Place by place, texts of two versions (chapter_num, idx, text): same, space (differs in white space only) or different."""
    flat = lambda c: F.regexp_replace(c, "(?U)\\s+", " ")
    both = left.withColumnRenamed("text", "a").join(right.withColumnRenamed("text", "b"), ["chapter_num", "idx"], "full")
    kind = F.when(F.col("a").eqNullSafe(F.col("b")), "same").when(flat(F.col("a")) == flat(F.col("b")), "space").otherwise("different")
    return both.groupBy("chapter_num").agg(*(F.count_if(kind == k).alias(k) for k in ("same", "space", "different")))
