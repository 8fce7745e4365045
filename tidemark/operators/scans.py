"""Running sums, maxima and neighbours along one long sequence, spread over tasks.

A window with ``partitionBy(chapter)`` sorts a whole chapter in one task. ``scanned`` cuts each sequence into stretches: what
came before (or comes after) a stretch is scanned on one row per stretch, and every stretch then scans its own rows beginning there.
No task holds more than a stretch of rows, or a sequence's stretches; those are cut again where a coarser level is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a stretch, for positions that count rows.
STRETCH = 65_536


@dataclass(frozen=True)
class Scan:
    """``how`` of ``value`` over the rows up to the own one: total, highest, last (not null); or, from it on, ahead (first not null).

    ``own``: whether the row itself counts.
    """

    value: Column
    how: str
    own: bool = True

    def over(self, order, value: Column | None = None) -> Column:
        value = self.value if value is None else value
        near = 0 if self.own else 1
        frame = order.rowsBetween(near, Window.unboundedFollowing) if self.how == "ahead" else order.rowsBetween(Window.unboundedPreceding, -near)
        return {"total": F.sum, "highest": F.max, "last": lambda c: F.last(c, True), "ahead": lambda c: F.first(c, True)}[self.how](value).over(frame)

    def whole(self, value: Column, order: list[str]) -> Column:
        """The same over a group of rows."""
        at = F.when(value.isNotNull(), F.struct(*order))
        return {"total": F.sum, "highest": F.max, "last": lambda c: F.max_by(c, at), "ahead": lambda c: F.min_by(c, at)}[self.how](value)

    def joined(self, outside: Column, inside: Column) -> Column:
        if self.how == "total":
            return F.coalesce(outside + inside, inside, outside)
        return F.greatest(outside, inside) if self.how == "highest" else F.coalesce(inside, outside)


def scanned(rows: DataFrame, keys: list[str], order: list[str], levels: list[Column], scans: dict[str, Scan]) -> DataFrame:
    """``rows`` with a column for each of ``scans``, equal to windows over ``keys`` in ``order`` (names, ascending).

    ``levels``, finest first, name the stretch of a row: each must not fall along ``order``, and each coarser one must depend
    on the one before it alone (``floor(position / n)`` for growing multiples). Without levels this is the plain window. Null keys are a
    sequence, and null levels a stretch. Ties in ``order`` are as undefined as in a window. Totals of floating values may differ from
    a window's in their last bits, as they are added in another order. ``rows`` are read twice, once for totals of few columns.
    """
    if not levels:
        by = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({name: s.over(by) for name, s in scans.items()})
    own = "_scan"
    while any(c.startswith(own) for c in rows.columns):
        own += "_"
    level = [f"{own}level{k}" for k in range(len(levels))]
    value = {name: f"{own}value{k}" for k, name in enumerate(scans)}
    cut = rows.withColumns({**dict(zip(level, levels, strict=True)), **{value[n]: s.value for n, s in scans.items()}})
    totals = cut.groupBy(*keys, level[0]).agg(*(F.first(c).alias(c) for c in level[1:]), *(s.whole(F.col(value[n]), order).alias(value[n]) for n, s in scans.items()))
    past = {f"{own}past{k}": Scan(F.col(value[n]), s.how, own=False) for k, (n, s) in enumerate(scans.items())}
    offsets = scanned(totals, keys, [level[0]], [F.col(c) for c in level[1:]], past)
    join = {c: f"{own}join{k}" for k, c in enumerate([*keys, level[0]])}
    offsets = offsets.select(*(F.col(c).alias(j) for c, j in join.items()), *past)
    inside = Window.partitionBy(*keys, level[0]).orderBy(*order)
    here = cut.withColumns({value[n]: s.over(inside, F.col(value[n])) for n, s in scans.items()})
    met = here.join(offsets, [F.col(c).eqNullSafe(F.col(j)) for c, j in join.items()], "left")
    found = {n: s.joined(F.col(p), F.col(value[n])) for (n, s), p in zip(scans.items(), past, strict=True)}
    return met.select(*(c for c in rows.columns if c not in scans), *(c.alias(n) for n, c in found.items()))


def numbered(rows: DataFrame, keys: list[str], order: list[str], levels: list[Column], name: str) -> DataFrame:
    """``rows`` with their number from 0 within ``keys``."""
    out = scanned(rows, keys, order, levels, {name: Scan(F.lit(1), "total")})
    return out.withColumn(name, (F.col(name) - 1).cast("int"))
