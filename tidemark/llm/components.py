"""Connected components of a link table, without collecting links anywhere.

Each round hooks every root to the smallest root next to it, flattens the resulting forest by pointer
jumping and rewrites the links between the remaining roots, so the link table shrinks round by round.
All steps are aggregations with partial sums and joins of written tables, whose skewed partitions Spark
can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``links(a, b)``."""
    links = materialise(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    ends = lambda c: links.select(F.col(c).alias("node")).distinct()
    labels = materialise(ends("a").unionByName(ends("b")).distinct().withColumn("component", F.col("node")), "labels")
    while links.limit(1).count():
        # As a < b, only the larger end of a link can have a smaller neighbour; a node without one is a root and has no row.
        parent_table = parent = materialise(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            higher = parent.join(up, "parent", "left").select("node", F.col("parent").alias("old"), F.coalesce("top", "parent").alias("parent"))
            before, higher = parent_table, materialise(higher, "parents")
            discard(before)
            parent_table, parent = higher, higher.drop("old")
            if not higher.filter("old <> parent").limit(1).count():
                break
        to = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        moved = links.join(to("a"), "a", "left").join(to("b"), "b").select(F.coalesce("a_root", "a").alias("a_root"), "b_root").filter("a_root <> b_root")
        old_links, old_labels = links, labels
        links = materialise(
            moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links"
        )
        labels = materialise(
            labels.join(to("component"), "component", "left").select("node", F.coalesce("component_root", "component").alias("component")), "labels"
        )
        discard(old_links, old_labels, parent_table)
    discard(links)
    return labels


def forest(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Links of a bipartite matrix that connect what all its links connect."""
    left_rows, left_columns, out = near.any(axis=1), near.any(axis=0), []
    for root in np.flatnonzero(left_rows):
        if not left_rows[root]:
            continue
        left_rows[root], name, stack = False, int(rows[root]), [(int(root), True)]
        while stack:
            at, is_row = stack.pop()
            new = np.flatnonzero(near[at] & left_columns) if is_row else np.flatnonzero(near[:, at] & left_rows)
            (left_columns if is_row else left_rows)[new] = False
            out += [(name, int(x)) for x in (columns if is_row else rows)[new]]
            stack += [(int(k), not is_row) for k in new]
    return [(a, b) for a, b in out if a != b]
