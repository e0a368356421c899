"""All pairs inside groups of any size, in blocks: a group is dealt into blocks of bounded size and every two blocks meet once.

A task holds two blocks at a time. It returns, for its members, sums over links and the edges of a spanning forest, so the number of
rows grows with members times blocks, never with the number of pairs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, group: str, member: str, weight: str, most: int) -> DataFrame:
    """``members`` with group key, p, q and side: each member once for every pair of blocks that its block is in.

    A group has as many blocks as its summed ``weight`` needs at ``most`` for each. Members are dealt by a hash of their id.
    """
    total = members.groupBy(group).agg(F.ceil(F.sum(weight) / most).cast("int").alias("_n"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    dealt = members.join(total, group).withColumn("_b", F.pmod(F.xxhash64(member, F.lit(7)), F.col("_n")).cast("int"))
    pairs = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return pairs.select("*", F.least("_b", "_x").alias("p"), F.greatest("_b", "_x").alias("q"), (F.col("_b") > F.col("_x")).alias("second")).drop("_b", "_x", "_n", "_m")


def in_groups(rows: DataFrame, keys: list[str], work: Callable[[dict[str, list]], list[tuple]], schema: str, names: list[str], types: list[pa.DataType], together: int = 1) -> DataFrame:
    """``work`` on the columns of each group of ``keys``; groups must be bounded. Streams through sorted partitions.

    ``together``: small groups are handed over several at once, until they have so many rows; ``_group`` numbers them.
    """
    columns = rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in [*columns, "_group"]}
        current, out, group = None, [], 0

        def emit():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for part in parts:
            data = {c: part.column(c).to_pylist() for c in columns}
            tags = list(zip(*(data[k] for k in keys)))
            a = 0
            while a < len(tags):
                b = a
                while b < len(tags) and tags[b] == tags[a]:
                    b += 1
                if tags[a] != current and current is not None:
                    group += 1
                    if len(held["_group"]) >= together:
                        out.extend(work(held))
                        held = {c: [] for c in [*columns, "_group"]}
                        if len(out) > 20_000:
                            yield emit()
                            out = []
                current = tags[a]
                for c in columns:
                    held[c].extend(data[c][a:b])
                held["_group"].extend([group] * (b - a))
                a = b
        if current is not None:
            out.extend(work(held))
        if out:
            yield emit()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def spanning(ids: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, least id of its part) for links between places ``rows`` and ``cols`` of ``ids``."""
    label = ids.copy()
    while len(rows):
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        if (new == label).all():
            break
        label = new
    return [(int(a), int(b)) for a, b in zip(ids, label) if a != b]
