"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors that are equal are one row with a count. The rest are scaled to length one, quantised to int8 once, and dealt
into tiles; every pair of tiles is compared in one task, which gets int8 components alone. Each vector has a scale of its
own, and the length of what quantisation lost is known exactly, so for x = x' + dx and y = y' + dy

    |x.y - x'.y'| <= |dx| |y'| + |x'| |dy| + |dx| |dy|.

Int8 products are computed as float32 products of whole numbers below 2**24, which are exact. Pairs whose bounds lie above
the threshold are links, those whose bounds lie below it aren't. For the rest the two tiles' tasks are run again with the
full vectors of the rows concerned, in double precision. Tasks return each vector's number of links and a spanning forest
of the links, and the rows that need another look: never pairs.

Comparing tiles is quadratic in the number of distinct vectors: a vector's int8 components go to one task per tile.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component link with
nothing; vectors of different lengths never link; rows that repeat an id count as separate vectors of one
component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import attach, discard, materialise
from tidemark.llm.components import components, forest

THRESHOLD, TILE, ROWS = 0.9, 4096, 256
#: Above the rounding of the double and single precision steps that the bound passes through.
SLACK = 1e-5
#: Coordinates whose int8 products a float32 sum holds exactly.
EXACT_DIMS = (1 << 24) // 127**2


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers as float32, scale, |x'|, |dx|) of rows of length one."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    back = whole * scale[:, None]
    return whole.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


class Tile:
    """Rows of one length: ids, counts, quantised components, and unit vectors where they are known."""

    def __init__(self, ids, counts, whole, scale, kept, lost, unit=None):
        self.ids, self.counts = np.asarray(ids, np.int64), np.asarray(counts, np.int64)
        self.whole, self.scale, self.kept, self.lost, self.unit = whole, scale, kept, lost, unit


def unit_rows(vectors) -> np.ndarray:
    raw = np.array(vectors, np.float64)
    # By the largest component first, so that squares neither overflow nor vanish.
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def tile_of(ids, counts, vectors) -> Tile:
    unit = unit_rows(vectors)
    return Tile(ids, counts, *quantise(unit), unit)


def compared(x: Tile, y: Tile, threshold: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(which rows of ``x`` and ``y`` are surely linked, as a boolean matrix; places of the pairs that may be)."""
    sure, open_i, open_j = np.zeros((len(x.ids), len(y.ids)), bool), [], []
    dims = x.whole.shape[1]
    if dims == y.whole.shape[1]:
        # One pass with the tile's widest bound, then the pair's own; by blocks of rows, to bound memory.
        widest = x.lost * y.kept.max() + x.kept * y.lost.max() + x.lost * y.lost.max()
        least = (threshold - SLACK - widest) / (x.scale * y.scale.max())
        least -= 1e-6 * np.abs(least)
        for at in range(0, len(x.ids), ROWS):
            rows = slice(at, at + ROWS)
            products = sum(
                (x.whole[rows, k : k + EXACT_DIMS] @ y.whole[:, k : k + EXACT_DIMS].T).astype(np.float64 if dims > EXACT_DIMS else np.float32) for k in range(0, dims, EXACT_DIMS)
            )
            i, j = np.nonzero(products >= least[rows, None].astype(products.dtype))
            near = products[i, j] * (x.scale[i + at] * y.scale[j])
            i += at
            error = x.lost[i] * y.kept[j] + x.kept[i] * y.lost[j] + x.lost[i] * y.lost[j]
            good = near - error >= threshold + SLACK
            sure[i[good], j[good]] = True
            maybe = ~good & (near + error >= threshold - SLACK)
            open_i.append(i[maybe])
            open_j.append(j[maybe])
    none = [np.zeros(0, np.int64)]
    return sure, (np.concatenate(open_i or none), np.concatenate(open_j or none))


def exact(x: Tile, y: Tile, places: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs at ``places`` are linked, in double precision, as a boolean matrix."""
    out = np.zeros((len(x.ids), len(y.ids)), bool)
    for k in range(0, len(places[0]), 1 << 16):
        i, j = (p[k : k + (1 << 16)] for p in places)
        out[i, j] = np.einsum("ij,ij->i", x.unit[i], y.unit[j]) >= threshold
    return out


def linked(x: Tile, y: Tile, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` are linked."""
    sure, places = compared(x, y, threshold)
    return sure | exact(x, y, places, threshold)


#: What tasks return: forest links (a, b), numbers of links of a, and rows a of a pair of tiles that need another look.
FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("tile", pa.int32())])
LINK, COUNT, AGAIN = range(3)


def _quantised(distinct: DataFrame, tiles: int) -> DataFrame:
    """``node, n, tile, dims, whole (int8), scale, kept, lost`` of ``distinct(node, n, v)``."""

    def run(batches):
        names = ["node", "n", "tile", "dims", "whole", "scale", "kept", "lost"]
        for batch in batches:
            column = batch.column(2)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(ends)])
            node, tile = batch.column(0), batch.column(3)
            for dims in np.unique(ends):
                own = np.flatnonzero(ends == dims)
                unit = unit_rows(flat[at[own][:, None] + np.arange(dims)])
                whole, scale, kept, lost = quantise(unit)
                data = pa.array([row.tobytes() for row in whole.astype(np.int8)], pa.binary())
                take = pa.array(own)
                sizes = pa.array(np.full(len(own), dims, np.int32))
                yield pa.RecordBatch.from_arrays([node.take(take), batch.column(1).take(take), tile.take(take), sizes, data, pa.array(scale), pa.array(kept), pa.array(lost)], names=names)

    dealt = distinct.select("node", "n", "v", F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("tile"))
    return dealt.mapInArrow(run, "node LONG, n LONG, tile INT, dims INT, whole BINARY, scale DOUBLE, kept DOUBLE, lost DOUBLE")


def _sides(table: pa.Table, i: int, j: int, vectors: bool):
    """Pairs of Tiles of the same length from the rows of tiles ``i`` and ``j``."""
    own: dict[tuple[int, int], list[int]] = {}
    for k, key in enumerate(zip(table["tile"].to_pylist(), table["dims"].to_pylist(), strict=True)):
        own.setdefault(key, []).append(k)

    def make(rows):
        t = table.take(pa.array(rows))
        whole = np.frombuffer(b"".join(t["whole"].to_pylist()), np.int8).reshape(len(rows), -1).astype(np.float32)
        unit = unit_rows(t["v"].to_pylist()) if vectors else None
        return Tile(t["node"].to_numpy(), t["n"].to_numpy(), whole, *(t[c].to_numpy() for c in ("scale", "kept", "lost")), unit)

    for (tile, dims), rows in own.items():
        if tile == i and (j, dims) in own:
            x = make(rows)
            yield x, x if i == j else make(own[j, dims])


def _rows(near: np.ndarray, x: Tile, y: Tile, places=None, i: int = 0, j: int = 0) -> list[tuple]:
    """Rows of FOUND for the links ``near``, and for the pairs at ``places`` that are still open."""
    out = [(LINK, a, b, 0, i, j, 0) for a, b in forest(near, x.ids, y.ids)]
    links = [(x, near @ y.counts)] + ([] if x is y else [(y, x.counts @ near)])
    out += [(COUNT, int(node), 0, int(k), i, j, 0) for side, per in links for node, k in zip(side.ids, per, strict=True) if k]
    if places is not None:
        for side, at, tile in ((x, places[0], i), (y, places[1], j)):
            out += [(AGAIN, int(node), 0, 0, i, j, tile) for node in side.ids[np.unique(at)]]
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(FOUND)], schema=FOUND)


def classes(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    wide = F.col("embedding").cast(f"array<{kind if kind in ('float', 'double') else 'double'}>")
    good = (
        (F.size("embedding") > 0)
        & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(wide, lambda v: v != 0)
    )
    text = F.concat_ws(",", F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")))
    rows = materialise(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), wide).alias("v")).withColumn(
            "key", F.when(F.col("v").isNotNull(), F.sha2(text.cast("binary"), 256))
        ),
        "vectors",
    )
    found = rows.filter("v is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    distinct = materialise(found.withColumn("node", F.monotonically_increasing_id()), "distinct")  # numbers hold once they are written
    tiles = max(1, -(-distinct.count() // tile))
    # Written: each row goes to as many tasks as there are tiles.
    small = materialise(_quantised(distinct, tiles), "quantised")
    others = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j")))
    pairs = small.select("*", F.explode(others).alias("p")).select("p.i", "p.j", *small.columns)

    def compare(key, table):
        i, j = (k.as_py() for k in key)
        out = []
        for x, y in _sides(table, i, j, False):
            sure, places = compared(x, y, threshold)
            if x is y:
                np.fill_diagonal(sure, False)
                other = places[0] != places[1]
                places = tuple(p[other] for p in places)
            out += _rows(sure, x, y, places, i, j)
        return _table(out)

    def compare_again(key, table):
        i, j = (k.as_py() for k in key)
        out = []
        for x, y in _sides(table, i, j, True):
            near = exact(x, y, compared(x, y, threshold)[1], threshold)
            if x is y:
                np.fill_diagonal(near, False)
            out += _rows(near, x, y)
        return _table(out)

    schema = "kind BYTE, a LONG, b LONG, links LONG, i INT, j INT, tile INT"
    first = materialise(pairs.groupBy("i", "j").applyInArrow(compare, schema), "tile_links")
    again = first.filter(F.col("kind") == AGAIN).select("i", "j", F.col("a").alias("node")).distinct()
    again = materialise(again.join(small, "node").join(distinct.select("node", "v"), "node"), "open_rows")
    found = first.unionByName(materialise(again.groupBy("i", "j").applyInArrow(compare_again, schema), "open_links"))
    component = components(found.filter(F.col("kind") == LINK).select("a", "b"))
    per = found.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    own = materialise(
        distinct.select("node", "key", "least", "n")
        .join(per, "node", "left")
        .join(component, "node", "left")
        .select("key", "least", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "linked",
    )
    discard(small, again)
    least = materialise(own.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    table = materialise(own.join(least, "component").select("key", "n", "n_links", "component_id"), "vector_classes")
    # Rows of no vector have no key and stay as they are.
    done = attach(rows.select("vec_id", "key"), "key", table, "n")
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
