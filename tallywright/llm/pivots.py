"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) come from a sample of the vectors, the ``2 * sqrt(n)`` with the least hash of their id. They are spaced: a
sampled vector within one and a half times the threshold's angle of an earlier pivot is none, so that a dense cluster is named by one
or two pivots that its members share, and not by so many that each member names others. Every vector is
described by its ``nearest`` closest pivots in order. The inverted list of a pivot holds the vectors that name it; two vectors of a
list are compared if they share at least ``shared`` pivots, in the list of the least pivot that they share, and verified by their
cosine in double precision. Exact copies are one vector with a weight. Lists are dealt into blocks, so a list of any size is spread;
all pairs of a dense cluster are compared, which is the square of its distinct vectors.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.blocks import block_pairs, in_groups, spanning
from tallywright.llm.common import only, saved
from tallywright.llm.components import components

BLOCK = 512


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Unit rows in double precision; shorter vectors are padded with zeros."""
    lists = column.to_pylist()
    width = width or max((len(x) for x in lists), default=0)
    out = np.zeros((len(lists), width))
    for k, x in enumerate(lists):
        out[k, :len(x)] = x
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with each row of ``b``; -1 is none."""
    both = np.intersect1d(a, b)
    both = both[both >= 0]
    if not len(both):
        return np.zeros((len(a), len(b)), np.float32)

    def named(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(both, x), len(both) - 1)
        row, col = np.nonzero(both[at] == x)
        out = np.zeros((len(x), len(both)), np.float32)
        out[row, at[row, col]] = 1
        return out

    return named(a) @ named(b).T


def spaced(points: np.ndarray, threshold: float) -> np.ndarray:
    """The points, in their order, that are further than 1.5 times the angle of ``threshold`` from all points taken before."""
    most = math.cos(min(math.pi, 1.5 * math.acos(max(-1.0, min(1.0, threshold)))))
    free = np.ones(len(points), bool)
    for k in range(len(points)):
        if free[k]:
            free[k + 1:] &= points[k + 1:] @ points[k] < most
    return points[free]


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, nearest: int = 8, shared: int = 2) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (least vec_id reachable by links), kept (vec_id = component_id).

    Vectors that are null, empty or zero, or that hold null, NaN or infinite components, link with nothing, and so do rows without
    vec_id; each is its own component. Vectors of unequal length compare as if padded with zeros. Rows that share a vec_id
    are vectors of their own in n_links and one node in component_id. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = only(df, vec_id=vec_id, v=F.col(f"`{embedding}`").cast("array<double>"))
    rows = rows.withColumn("ok", F.coalesce(finite & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False)))
    classes = rows.filter("ok").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = saved(classes, "vectors")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(2 * math.isqrt(n) + 2).select("v").toArrow()
    points = _matrix(sample.column("v").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64())), width).astype(np.float32)
    points = spaced(points, threshold)

    def describe(parts):
        for part in parts:
            near = _matrix(part.column("v"), width).astype(np.float32) @ points.T
            k = min(nearest, near.shape[1])
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("size"), part.column("v"), pa.array(list(top.astype(np.int32)), pa.list_(pa.int32()))], ["id", "size", "v", "pivots"])

    described = classes.select("id", "size", "v").mapInArrow(describe, "id long, size long, v array<double>, pivots array<int>")
    lists = described.withColumn("pivot", F.explode("pivots")).withColumn("one", F.lit(1))
    pairs = block_pairs(lists, "pivot", "id", "one", BLOCK).drop("one")

    def compare(held: dict[str, list]) -> list[tuple]:
        ids, size = np.array(held["id"], np.int64), np.array(held["size"], np.int64)
        second, pivot = np.array(held["second"], bool), held["pivot"][0]
        full, near = _matrix(pa.array(held["v"]), width), np.array(held["pivots"], np.int32)
        same = held["p"][0] == held["q"][0]
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        link = full[a] @ full[b].T >= threshold
        # All shared pivots, and those whose list comes before this one and compares the pair there.
        common, before = _shared(near[a], near[b]), _shared(np.where(near[a] < pivot, near[a], -1), np.where(near[b] < pivot, near[b], -1))
        link &= (common >= min(shared, near.shape[1])) & (before == 0)
        if same:
            link &= ~np.eye(len(a), dtype=bool)
        x, y = np.nonzero(link)
        if not len(x):
            return []
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a[x], size[b[y]])
        if not same:
            np.add.at(links, b[y], size[a[x]])
        root = dict(spanning(ids, a[x], b[y]))
        return [(int(ids[k]), int(links[k]), root.get(int(ids[k]), int(ids[k]))) for k in np.flatnonzero(links)]

    found = saved(in_groups(pairs, ["pivot", "p", "q"], compare, "id long, links long, root long", ["id", "links", "root"], [pa.int64()] * 3), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found, "id", "root")
    facts = classes.join(links, "id", "left").join(parts, "id", "left").select("v", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    linked = rows.filter("ok").join(facts, "v").select("vec_id", (F.col("links") + F.col("size") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
