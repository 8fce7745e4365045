"""Matching blocks of two word sequences, longest first, without holding a chapter anywhere.

The blocks are those of a recursion that takes the longest equal run (the earliest, where several are as long), and goes on
left and right of it. Here all open regions go on at once, from long runs to short ones: runs of at least GRAMS[k] words are
found by a hash join of word n-grams within a region. A run that is compatible with all others of its region
is taken whatever the order; between two such, of runs that contradict each other the longest is taken. Both cut their
region, and what is left of the others is looked at again. Regions of at most GAP words a side are finished by a small function:
their words, sorted by region, go by it as a stream, so a worker holds one region's words and one batch, however many there are.

A longer region that is left has no two words in a row in common; there the recursion comes down to taking each word at its next
place, which needs no pairs. Word numbers come from counts of stretches of STRETCH words and an offset each.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import materialise

GRAMS, GAP, STRETCH = (32, 8, 2), 1000, 1024


def numbered(rows: DataFrame, idx: str) -> DataFrame:
    """``rows(chapter_num, ...)`` with ``pos``, their number from 0 in the chapter in order of ``idx``."""
    own = rows.withColumn("stretch", F.floor(F.col(idx) / STRETCH))
    counts = own.groupBy("chapter_num", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("chapter_num").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("chapter_num", "stretch", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("chapter_num", "stretch").orderBy(idx)) - 1
    return own.withColumn("inside", inside).join(offsets, ["chapter_num", "stretch"]).withColumn("pos", (F.col("offset") + F.col("inside")).cast("int")).drop("stretch", "inside", "offset")


def grams(words: DataFrame, k: int) -> DataFrame:
    """``chapter_num, pos, gram``: a hash of every ``k`` words in a row of ``words(chapter_num, pos, code)``."""
    at = F.floor(F.col("pos") / STRETCH)
    back = -(-(k - 1) // STRETCH)
    homes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda s: at - s), lambda h: (h >= 0) & ((h == at) | (F.col("pos") < (h + 1) * STRETCH + k - 1)))
    held = words.select("chapter_num", "pos", "code", F.explode(homes).alias("home")).groupBy("chapter_num", "home").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("w"))
    codes = held.select("chapter_num", "home", F.transform("w", lambda x: x["code"]).alias("codes"), F.col("w")[0]["pos"].alias("first"))
    last = F.least(F.lit(STRETCH), F.size("codes") - k + 1)
    each = codes.filter(F.size("codes") >= k).select("chapter_num", "first", F.explode(F.transform(F.sequence(F.lit(0), last - 1), lambda p: F.struct(p.alias("p"), F.xxhash64(F.slice("codes", p + 1, F.lit(k))).alias("gram")))).alias("x"))
    return each.select("chapter_num", (F.col("first") + F.col("x.p")).alias("pos"), "x.gram")


def within(rows: DataFrame, pos: str, regions: DataFrame, low: str, high: str, k: int = 1) -> DataFrame:
    """``rows`` joined with the region of ``regions`` that holds the ``k`` words from ``pos`` on, by stretches."""
    homes = F.sequence(F.floor(F.col(low) / STRETCH), F.floor((F.col(high) - 1) / STRETCH))
    parts = regions.withColumn("home", F.explode(homes))
    met = rows.withColumn("home", F.floor(F.col(pos) / STRETCH)).join(parts, ["chapter_num", "home"])
    return met.filter((F.col(pos) >= F.col(low)) & (F.col(pos) + k <= F.col(high))).drop("home")


def chosen(pairs: DataFrame, k: int) -> DataFrame:
    """``chapter_num, r, i, j, n`` of the runs that are taken, of ``pairs(chapter_num, r, i, j)`` of equal ``k``-grams."""
    region = ["chapter_num", "r"]
    line = Window.partitionBy(*region, "d").orderBy("i")
    own = pairs.withColumn("d", F.col("i") - F.col("j")).withColumn("run", F.col("i") - F.row_number().over(line))
    runs = own.groupBy(*region, "d", "run").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count(F.lit(1)) + k - 1).cast("int").alias("n"))
    order = Window.partitionBy(*region).orderBy("i", "j")
    past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    behind = lambda c: F.coalesce(F.max(F.col(c) + F.col("n")).over(past) <= F.col(c), F.lit(True))
    ahead = lambda c: F.coalesce(F.min(c).over(future) >= F.col(c) + F.col("n"), F.lit(True))
    free = runs.withColumn("free", behind("i") & behind("j") & ahead("i") & ahead("j"))
    knots = free.withColumn("knot", F.count_if("free").over(order))
    best = knots.filter("NOT free").groupBy(*region, "knot").agg(F.max(F.struct("n", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("b"))
    return knots.filter("free").select(*region, "i", "j", "n").unionByName(best.select(*region, (-F.col("b.i")).alias("i"), (-F.col("b.j")).alias("j"), F.col("b.n").alias("n")))


def cut(regions: DataFrame, taken: DataFrame) -> DataFrame:
    """What ``taken`` runs leave of their ``regions``, where both sides have words."""
    ends = regions.select("chapter_num", "r", F.col("a_high").alias("i"), F.col("b_high").alias("j"), F.lit(0).alias("n"))
    order = Window.partitionBy("chapter_num", "r").orderBy("i", "j", F.desc("n"))
    rows = taken.unionByName(ends).withColumns({"a_from": F.lag(F.col("i") + F.col("n")).over(order), "b_from": F.lag(F.col("j") + F.col("n")).over(order)}).join(regions, ["chapter_num", "r"])
    out = rows.select("chapter_num", F.coalesce("a_from", "a_low").alias("a_low"), F.col("i").alias("a_high"), F.coalesce("b_from", "b_low").alias("b_low"), F.col("j").alias("b_high"))
    return out.filter("a_low < a_high AND b_low < b_high").withColumn("r", F.col("a_low"))


def large(a: DataFrame, b: DataFrame, regions: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Blocks ``chapter_num, i, j, n`` of ``regions`` and the regions left: small ones, and such as have no two words in a row in common."""
    blocks, small = None, None
    size = F.greatest(F.col("a_high") - F.col("a_low"), F.col("b_high") - F.col("b_low"))
    for k in GRAMS:
        if not regions.limit(1).count():
            break
        side = lambda words, x, p: within(grams(words, k), "pos", regions, f"{x}_low", f"{x}_high", k).select("chapter_num", "r", "gram", F.col("pos").alias(p))  # noqa: B023, E731
        pairs = materialise(side(a, "a", "i").join(side(b, "b", "j"), ["chapter_num", "r", "gram"]).drop("gram"), "pairs")
        while pairs.limit(1).count():
            taken = materialise(chosen(pairs, k), "taken")
            blocks = taken.drop("r") if blocks is None else blocks.unionByName(taken.drop("r"))
            pieces = materialise(cut(regions, taken), "pieces")
            done = pieces.filter(size <= GAP)  # no round waits for these
            small = done if small is None else small.unionByName(done)
            regions = pieces.filter(size > GAP)
            left = within(pairs.drop("r"), "i", regions, "a_low", "a_high", k).filter((F.col("j") >= F.col("b_low")) & (F.col("j") + k <= F.col("b_high")))
            pairs = materialise(left.select("chapter_num", "r", "i", "j"), "pairs")
    return blocks, regions if small is None else small.unionByName(regions)


def finished(batches, finish):
    """Batches ``chapter_num, a_idx, b_idx`` of matching words from batches ``chapter_num, r, side, idx, norm`` in order of region and side (0: a, 1: b).

    A region may go on in the next batch; no more than one region and one batch is held.
    """

    def pairs(key, sides, idx, norms):
        sides, idx = np.concatenate(sides), np.concatenate(idx)
        n = int(np.searchsorted(sides, 1))
        found = finish(norms[:n], norms[n:])
        b, a = (np.fromiter(x, np.int64, len(found)) for x in (found.keys(), found.values()))
        return pa.repeat(key[0], len(found)), pa.array(idx[:n][a]), pa.array(idx[n:][b])

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done, strict=True)], names=["chapter_num", "a_idx", "b_idx"])

    key, sides, idx, norms = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        chapter, r, side, at = batch.column(0), batch.column(1), *(batch.column(k).to_numpy() for k in (2, 3))
        words, done = batch.column(4).to_pylist(), []
        new = pc.or_(pc.not_equal(chapter[1:], chapter[:-1]), pc.not_equal(r[1:], r[:-1]))
        for low, high in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]):
            own = chapter[low], r[low]
            if own != key:
                if norms:
                    done.append(pairs(key, sides, idx, norms))
                key, sides, idx, norms = own, [], [], []
            sides.append(side[low:high])
            idx.append(at[low:high])
            norms += words[low:high]
        if done:
            yield batch_of(done)
    if norms:
        yield batch_of([pairs(key, sides, idx, norms)])


def aligned(a: DataFrame, b: DataFrame, finish) -> DataFrame:
    """``chapter_num, a_idx, b_idx`` of matching words of ``a(chapter_num, a_idx, norm)`` and ``b(chapter_num, b_idx, norm)``.

    ``finish(a_norms, b_norms)`` gives, for lists of a region's words, each matched place of b with its place of a.
    """
    kinds = {c: x.schema[c].dataType for x, c in ((a, "chapter_num"), (a, "a_idx"), (b, "b_idx"))}
    a, b = (materialise(x.select("chapter_num", c, "norm"), "words") for x, c in ((a, "a_idx"), (b, "b_idx")))
    a, b = (materialise(numbered(x, c).withColumn("code", F.xxhash64("norm")), "numbered") for x, c in ((a, "a_idx"), (b, "b_idx")))
    count = lambda x, c: x.groupBy("chapter_num").agg(F.count(F.lit(1)).cast("int").alias(c))
    whole = count(a, "a_high").join(count(b, "b_high"), "chapter_num").select("chapter_num", F.lit(0).alias("r"), F.lit(0).alias("a_low"), "a_high", F.lit(0).alias("b_low"), "b_high")
    whole = materialise(whole, "regions")
    big = F.greatest("a_high", "b_high") > GAP
    regions, blocks = whole, None
    if whole.filter(big).limit(1).count():
        blocks, left = large(a, b, whole.filter(big))
        regions = materialise(whole.filter(~big).unionByName(left), "regions")

    def held(words, x, side):
        own = within(words, "pos", regions, f"{x}_low", f"{x}_high")
        return own.select("chapter_num", "r", F.lit(side).alias("side"), "pos", F.col(f"{x}_idx").cast("long").alias("idx"), "norm")

    rows = held(a, "a", 0).unionByName(held(b, "b", 1)).repartition("chapter_num", "r").sortWithinPartitions("chapter_num", "r", "side", "pos").drop("pos")
    schema = T.StructType([T.StructField("chapter_num", rows.schema["chapter_num"].dataType), T.StructField("a_idx", T.LongType()), T.StructField("b_idx", T.LongType())])
    out = rows.mapInArrow(lambda batches: finished(batches, finish), schema).select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))
    if blocks is None:
        return out
    each = blocks.select("chapter_num", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.struct((F.col("i") + s).alias("i"), (F.col("j") + s).alias("j")))).alias("p")).select("chapter_num", "p.*")
    found = each.join(a.select("chapter_num", F.col("pos").alias("i"), "a_idx"), ["chapter_num", "i"]).join(b.select("chapter_num", F.col("pos").alias("j"), "b_idx"), ["chapter_num", "j"])
    return out.unionByName(found.select("chapter_num", "a_idx", "b_idx"))
