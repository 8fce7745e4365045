"""Layout edits as a stream: the state of each chapter is kept and every batch of operations moves it on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.layouts import Chapter, Rejected

STATE = "n_words INT, breaks ARRAY<INT>, rejected INT"
OUT = "chapter_num LONG, breaks ARRAY<INT>, rejected INT"


def running_breaks(ops: DataFrame, n_words: int, first: list[int]) -> DataFrame:
    """Breaks of each chapter after every batch of ``ops`` (streaming; splits, merges and moves of book boards, and resets to ``first``)."""

    def run(key, batches, state: GroupState):
        size, breaks, rejected = state.get if state.exists else (n_words, first, 0)
        chapter = Chapter([""] * size, list(breaks))
        for o in pd.concat(list(batches)).sort_values("op_id").itertuples(index=False):
            if o.op == "reset":
                chapter = Chapter([""] * size, list(first))
                continue
            try:
                chapter.apply(o)
            except Rejected:
                rejected += 1
        state.update((size, chapter.breaks, rejected))
        yield pd.DataFrame({"chapter_num": [key[0]], "breaks": [chapter.breaks], "rejected": [rejected]})

    return ops.groupBy("chapter_num").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Stretches of a user's events without a gap, by session windows under a watermark."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "value")
    )
