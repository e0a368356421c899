"""Connected components of a graph by alternating large and small stars; no group is gathered anywhere."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import saved


LOCAL_EDGES = 1_000_000  # a graph of at most so many edges (16 MB) is solved in one task, a larger one by rounds, with the same result


def _solved(edges: DataFrame) -> DataFrame:
    """Components of a bounded graph, in one task."""
    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(p.column("u").to_numpy(), p.column("v").to_numpy()) for p in parts]
        if not found:
            return
        u, v = (np.concatenate(x) for x in zip(*found))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, label = place[:len(u)], place[len(u):], np.arange(len(ids))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (label[a], label[b]):  # the labels' own labels go down too, so long paths shrink by halves
                np.minimum.at(new, side, low)
            while (new != new[new]).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        for s in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[s:s + 50_000]), pa.array(ids[label[s:s + 50_000]])], ["id", "component"])

    return edges.coalesce(1).mapInArrow(solve, "id long, component long")


def _towards_least(rows: DataFrame) -> DataFrame:
    """rows (u, v): each u's least neighbour or itself as m, joined to all its rows."""
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return rows.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, component (least id reachable) for every id on an edge; ids are longs, loops and repeats do no harm.

    A large star hangs every larger neighbour of a node on the node's least neighbour, a small star every smaller one; the graph
    shrinks to stars in a number of rounds that grows with the logarithm of its size. Each round is a written table.
    """
    now = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    if now.count() <= LOCAL_EDGES:
        return saved(_solved(now), "components")
    state = None
    while True:
        r = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(r) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        state = tuple(r)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        hung = _towards_least(large)
        now = saved(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
