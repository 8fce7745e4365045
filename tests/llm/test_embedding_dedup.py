"""Tile products against plain double-precision cosines."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import embedding_dedup as ed


@pytest.mark.parametrize("dims", [2, 8, 64])
def test_bounds_never_miss(dims):
    rng = np.random.default_rng(dims)
    raw = rng.standard_normal((120, dims))
    raw[60:] = raw[:60] + rng.standard_normal((60, dims)) * np.linspace(0.05, 0.8, 60)[:, None] * (0.5 if dims > 2 else 1)
    x = ed.tile_of(range(120), [1] * 120, raw * rng.uniform(1e-3, 1e3, (120, 1)))
    got = ed.linked(x, x, 0.9)
    assert (got == (np.einsum("ik,jk->ij", x.unit, x.unit) >= 0.9)).all()
    approx = (x.whole * x.scale[:, None]) @ (x.whole * x.scale[:, None]).T
    bound = x.lost[:, None] * x.kept + x.kept[:, None] * x.lost + x.lost[:, None] * x.lost
    assert (np.abs(approx - x.unit @ x.unit.T) <= bound + 1e-12).all()


def test_classes(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((5, 16))
    vectors = {}
    for k in range(40):
        v = base[k % 5] + rng.standard_normal(16) * 0.3
        vectors[100 - k] = [float(np.float32(c)) for c in v]
    for k in range(7):
        vectors[200 + k] = vectors[100]
    vectors |= {1: None, 2: [0.0] * 16, 3: [float("nan")] * 16, 4: [], 5: [1.0, 2.0], 6: [None, 1.0], 7: [2.0, 4.0], 8: [float("inf")] * 16}
    table = spark.createDataFrame(list(vectors.items()), "vec_id LONG, embedding ARRAY<FLOAT>").selectExpr("*", "0 AS n_links", "vec_id AS v")
    good = {k: np.array(v, float) for k, v in vectors.items() if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [(a, b) for a, b in combinations(sorted(good), 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    up = {k: k for k in vectors}
    for _ in vectors:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    for tile in (8, 4096):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.classes(table, tile=tile).collect()}
        assert got == {k: (sum(k in x for x in links), up[k], up[k] == k) for k in vectors}
    assert ed.classes(table.limit(0)).collect() == []
