"""Following links, one for each node at most, to their end: pointer jumping.

Each round composes what every node knows of its way with what the node at the end of that way knows, so ways of n links take log2(n) rounds.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.session import cut_lineage


def follow(links: DataFrame) -> DataFrame:
    """(src, end, steps, ended) for ``links`` (src, dst) with one row for each src: the node without a link that the way from src ends at.

    ``ended`` is false for a way that runs into a cycle; its ``end`` is then some node on the cycle. A row that has ended is not joined again.
    """
    start = cut_lineage(links.select("src", "dst"))
    nodes = start.count()
    known = start.select(F.col("src").alias("_k"))
    state = start.join(known, F.col("dst") == F.col("_k"), "left").select("src", F.col("dst").alias("end"), F.lit(1).cast("long").alias("steps"), F.col("_k").isNull().alias("ended"))
    state, reach = cut_lineage(state), 1
    while reach < nodes and not state.filter("NOT ended").isEmpty():
        far = state.select(F.col("src").alias("end"), F.col("end").alias("_e"), F.col("steps").alias("_s"), F.col("ended").alias("_d"))
        moved = state.filter("NOT ended").join(far, "end").select("src", F.col("_e").alias("end"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_d").alias("ended"))
        state, reach = cut_lineage(state.filter("ended").unionByName(moved)), 2 * reach
    return state


def follow_to_cycles(links: DataFrame) -> DataFrame:
    """(src, end) as :func:`follow`, where a way into a cycle ends at the cycle's first node that it meets; a node of a cycle ends at itself."""
    far = follow(links)
    circling = far.filter("NOT ended")
    if circling.isEmpty():
        return far.select("src", "end")
    # So many steps lead every way into its cycle and each cycle onto itself: the ends are the nodes of the cycles.
    cycle = cut_lineage(circling.select("end").distinct())
    onto = links.join(circling.select("src"), "src", "left_semi").join(cycle.select(F.col("end").alias("src")), "src", "left_anti")
    return far.filter("ended").select("src", "end").unionByName(follow(onto).select("src", "end")).unionByName(cycle.select(F.col("end").alias("src"), "end"))
