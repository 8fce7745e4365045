"""Mixing sources to target weights by Pareto order sampling (built-in functions only).

A source's target divided by its size gives each of its documents a number of whole copies that is certain; the
rest is drawn. Documents have inclusion weights (by size, unless told otherwise), and their inclusion probabilities are
in proportion to these; those that would exceed one are certain, and the others share what they leave. Documents are
ranked by the odds of a random number divided by the odds of their inclusion, and the first in that order are taken until
the source's target in words is reached (Rosen's Pareto order sampling, with the fixed size counted in words). The
random numbers are hashes of the id and a seed, so reruns agree.

Weights are held to sixteenths of a power of two, so a source has some hundreds of them at most, and its
probabilities come from sums by weight. The order statistics come from histograms, never from a sort of a whole source: two rounds of counting
narrow the place where a source reaches its target to one fine bin, and only that bin is ranked.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents
without words take nothing; ties of rank are broken by id and then by size, and rows alike in all of
these are interchangeable; an empty table gives an empty result; inclusion weights that are null or
not positive count as 1, and weights beyond 2**-64 and 2**64 as these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import WORD, materialise, text_or_empty, whole_row

#: Weights of the sources in order of code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No target exceeds this many times its source's size.
MOST = 3
BINS = 4096
SEED = 20


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; shares the sum of all sizes.

    A source is capped once its fair share exceeds ``most`` times its size. In order of that ratio the
    capped ones come first, so one running sum over the sources finds them all: source k is capped if the
    words left by those before it, shared by weight among the rest, exceed its own cap.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("n", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights) + 1)
    )
    cap = F.col("source_size") * F.lit(most)
    before = whole.orderBy((F.col("source_size") / F.col("weight")), "n").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    filled = (
        ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), zero))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("capped", F.col("left") * F.col("weight") / F.col("rest") > cap)
        .withColumn("free", F.sum("source_size").over(whole) - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(whole))
    )
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("free") * F.col("weight") / F.col("open"))
    return filled.select("source", "source_size", target.alias("target"))


def uniform(seed: int = SEED) -> Column:
    """A number strictly between 0 and 1, from the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _narrow(rows: DataFrame, low: str, step: float) -> DataFrame:
    """Adds ``bin``: the place of ``rank01`` in BINS steps of ``step`` above ``low``."""
    place = F.floor((F.col("rank01") - F.col(low)) / F.lit(step)).cast("int")
    return rows.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)))


def _turn(rows: DataFrame) -> DataFrame:
    """Per source, the bin in which the words reach ``need``, and the words in the bins before it.

    Takes partial sums of at most BINS rows a source.
    """
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bins.withColumn("done", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .filter((F.col("done") < F.col("need")) & (F.col("need") <= F.col("done") + F.col("words")))
        .select(F.col("source").alias("s"), F.col("bin").alias("turn"), "done")
    )


def plan(narrow: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row a source: what its documents need to know to decide for themselves.

    ``narrow``: a written table of doc_id, source, size and w (inclusion weight).
    """
    by_weight = materialise(narrow.groupBy("source", "w").agg(F.sum("size").alias("words")), "weights")
    per_source = by_weight.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(per_source, weights, most).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0)
    )
    goals = goals.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumnRenamed("source", "s")
    goals = materialise(goals.join(rates(by_weight, goals), F.col("s").eqNullSafe(F.col("rate_source"))).drop("rate_source"), "goals")
    by_source = F.col("source").eqNullSafe(F.col("s"))
    ranked = narrow.join(goals, by_source).drop("s").withColumn("rank01", rank(seed)).filter((F.col("need") > 0) & (F.col("size") > 0) & ~certain())
    open_rows = materialise(ranked.select("doc_id", "source", "size", (F.col("need") - F.col("sure")).alias("need"), "rank01"), "ranked")

    first = _narrow(open_rows.withColumn("low", F.lit(0.0)), "low", 1 / BINS)
    turn1 = materialise(_turn(first), "turn1")
    inside = first.join(turn1, by_source).filter(F.col("bin") == F.col("turn")).select(
        "doc_id", "source", "size", "rank01", (F.col("need") - F.col("done")).alias("need"), (F.col("turn") / BINS).alias("low")
    )
    second = _narrow(inside, "low", 1 / BINS**2)
    turn2 = _turn(second)
    fine = second.join(turn2, by_source).filter(F.col("bin") == F.col("turn"))
    up_to = Window.partitionBy("source").orderBy("rank01", "doc_id", "size")
    crossing = (
        fine.withColumn("run", F.sum("size").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("goal", F.col("need") - F.col("done"))
        # The document in which the target is reached is taken if that comes nearer to it.
        .filter(F.col("run") - F.col("size") / 2 <= F.col("goal"))
        .groupBy("source")
        .agg(F.max(F.struct("rank01", "doc_id", "size")).alias("last"))
    )
    cuts = turn1.select("s", "turn").join(
        turn2.select(F.col("s").alias("t"), F.col("turn").alias("turn2")), F.col("s").eqNullSafe(F.col("t")), "left"
    ).join(crossing.withColumnRenamed("source", "c"), F.col("s").eqNullSafe(F.col("c")), "left").select(
        F.col("s").alias("cut_source"), (F.col("turn") / BINS + F.col("turn2") / BINS**2).alias("floor"), "last"
    )
    return materialise(goals.join(cuts, F.col("s").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "mixing_plan")


def rates(by_weight: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source ``rate``, by which weights become probabilities, ``sure``, the words of certain documents, and ``most_w``.

    From the greatest weight down, a weight is certain while what is needed beyond those above, shared by weight among
    the rest, gives it one; ``most_w`` is the greatest weight that isn't. ``by_weight``: source, w, words.
    """
    rows = by_weight.filter("words > 0").join(goals.select("s", "need"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    down = Window.partitionBy("source").orderBy(F.col("w").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("open", (F.col("need") - above) * F.col("w") < rest * (1 - 1e-12))
    rows = rows.withColumn("most_w", F.max(F.when(F.col("open"), F.col("w"))).over(Window.partitionBy("source")))
    is_open = F.col("w") <= F.col("most_w")
    per = rows.groupBy("source", "need", "most_w").agg(
        F.sum(F.when(is_open, 0).otherwise(F.col("words"))).alias("sure"), F.sum(F.when(is_open, F.col("w") * F.col("words")).otherwise(0.0)).alias("shares")
    )
    rate = F.coalesce(F.try_divide(F.col("need") - F.col("sure"), F.col("shares")), F.lit(0.0))
    found = per.select(F.col("source").alias("rate_source"), "most_w", "sure", rate.alias("rate"))
    bare = goals.join(found, F.col("s").eqNullSafe(F.col("rate_source")), "left_anti").select(F.col("s").alias("rate_source"), F.lit(1.0).alias("most_w"), F.lit(0).cast("long").alias("sure"), F.lit(0.0).alias("rate"))
    return found.unionByName(bare)


def certain() -> Column:
    return F.coalesce(F.col("w") > F.col("most_w"), F.lit(True))


def rank(seed: int = SEED) -> Column:
    """Random odds by inclusion odds, as q / (1 + q): a monotone image of them in (0, 1)."""
    part = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("rate") * F.col("w")))
    u = uniform(seed)
    odds = (u / (1 - u)) / (part / (1 - part))
    return odds / (1 + odds)


def decide(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows(doc_id, source, size, w, ...)`` with the plan's columns, ``copies`` and ``taken``."""
    got = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rank01", rank(seed))
    drawn = (F.col("size") > 0) & (F.col("need") > 0) & F.when(certain(), True).when(
        F.col("last").isNotNull(), F.struct("rank01", "doc_id", "size") <= F.col("last")
    ).otherwise(F.col("rank01") < F.col("floor"))
    copies = F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("int")
    return got.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))


def _measured(docs: DataFrame, inclusion: Column | None, *more: Column) -> DataFrame:
    weight = words().cast("double") if inclusion is None else inclusion.cast("double")
    sixteenths = F.round(F.log2(F.when(weight > 0, weight).otherwise(1.0)) * 16)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words().alias("size"),
        F.pow(F.lit(2.0), F.greatest(F.lit(-1024), F.least(F.lit(1024), sixteenths)) / 16).alias("w"),
        *more,
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, inclusion: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``inclusion``: relative inclusion weights of documents within their source; their sizes by default.
    """
    narrow = materialise(_measured(docs, inclusion), "sizes")
    return decide(narrow, plan(narrow, weights, most, seed), seed).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, inclusion: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as many times as it has copies, with all its columns.

    Texts aren't shuffled: the plan has one row a source, and each row decides for itself.
    """
    narrow = materialise(_measured(docs, inclusion), "sizes")
    rows = decide(_measured(docs, inclusion, whole_row(docs)), plan(narrow, weights, most, seed), seed)
    return rows.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
