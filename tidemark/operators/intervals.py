"""Joins of intervals, and neighbours on a line, without comparing all rows of a chapter.

``meeting`` cuts both sides into stretches of a fixed width and joins on chapter and stretch, so a row meets what lies
near it only. ``next_after`` and ``last_before`` need no join at all: both sides in one order, and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAPTER = "chapter_num"


def meeting(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float) -> DataFrame:
    """Pairs of rows of a chapter that have a stretch of ``width`` in common, each pair once.

    Spans that touch always have one; whether they do is the caller's condition. Spans that end before they start meet
    nothing.
    """

    def cut(rows: DataFrame, span, name: str) -> DataFrame:
        first, last = (F.floor(x / F.lit(float(width))).cast("long") for x in span)
        return rows.withColumn(name, first).withColumn("stretch", F.explode(F.when(last >= first, F.sequence(first, last))))

    both = cut(left, left_span, "left_first").join(cut(right, right_span, "right_first"), [CHAPTER, "stretch"])
    return both.filter(F.col("stretch") == F.greatest("left_first", "right_first")).drop("stretch", "left_first", "right_first")


def _side_by_side(points: DataFrame, at: str, marks: DataFrame, mark_at: str, found: Column) -> DataFrame:
    both = [c for c in points.columns if c != CHAPTER]
    left = points.select(CHAPTER, F.struct(*both).alias("own"), F.col(at).alias("at"), F.lit(None).alias("mark"))
    return left.unionByName(marks.select(CHAPTER, F.lit(None).alias("own"), F.col(mark_at).alias("at"), found.alias("mark")))


def next_after(points: DataFrame, at: str, marks: DataFrame, mark_at: str, found: Column, name: str) -> DataFrame:
    """``points`` with, as ``name``, ``found`` of the first mark whose ``mark_at`` is greater than the point's ``at``; null if none."""
    order = Window.partitionBy(CHAPTER).orderBy("at", F.col("own").isNotNull())
    rows = _side_by_side(points, at, marks, mark_at, found).withColumn(name, F.first("mark", True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    return rows.filter("own is not null").select(CHAPTER, "own.*", name)


def last_before(points: DataFrame, at: str, marks: DataFrame, mark_at: str, found: Column, name: str) -> DataFrame:
    """``points`` with, as ``name``, ``found`` of the last mark whose ``mark_at`` is less than the point's ``at``; null if none."""
    order = Window.partitionBy(CHAPTER).orderBy("at", F.col("own").isNull())
    rows = _side_by_side(points, at, marks, mark_at, found).withColumn(name, F.last("mark", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.filter("own is not null").select(CHAPTER, "own.*", name)
