"""Aliases, supersede chains, neighbourhood walks and cycles by bounded joins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import text as tx
from tallywright.functions.links import follow, follow_to_cycles
from tallywright.functions.ordered import latest_by
from tallywright.operators.windows import fork_detection
from tallywright.session import cut_lineage


def alias_resolve(keys: DataFrame, aliases: DataFrame, hops: int | None = None) -> DataFrame:
    """GR01. Follows the newest alias of every key to its end, or for ``hops`` steps (as published 8). A way into a cycle ends at the first
    key of the cycle that it meets.

    ``aliases`` has (ekey, evalue, ts, id). The ends of all aliases are found by pointer jumping and met by the keys once; a way of ``hops`` steps is joined step by step.
    """
    a = latest_by(aliases.select("ekey", "evalue", "ts", "id"), ["ekey"], ["ts", "id"])
    a = a.filter((F.coalesce("evalue", F.lit("")) != "") & (F.col("evalue") != F.col("ekey"))).select(F.col("ekey").alias("src"), F.col("evalue").alias("dst"))
    if hops is None:
        ends = follow_to_cycles(a)
        return keys.select("key").join(ends, F.col("key") == F.col("src"), "left").select("key", F.coalesce("end", "key").alias("target"))
    a = cut_lineage(a.select(F.col("src").alias("target"), F.col("dst").alias("_to")))
    moving, done = keys.select("key", F.col("key").alias("target"), F.array("key").alias("_seen")), None
    for _ in range(hops):
        j = cut_lineage(moving.join(a, "target", "left").withColumn("_end", F.col("_to").isNull() | F.coalesce(F.array_contains("_seen", F.col("_to")), F.lit(False))))
        # A key whose alias closes a cycle is left at the key that the alias names, as every step before it.
        ended = j.filter("_end").select("key", F.coalesce("_to", "target").alias("target"))
        done = ended if done is None else done.unionByName(ended)
        moving = j.filter("NOT _end").select("key", F.col("_to").alias("target"), F.array_append("_seen", F.col("_to")).alias("_seen"))
        if moving.isEmpty():
            return done
    rest = moving.select("key", "target")
    return rest if done is None else done.unionByName(rest)


def walk_graph(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """GR02. Undirected walk of ``hops`` hops from every start: distinct edges with the depth at which they are met first.

    ``edges`` has (src, relation, dst), ``starts`` has (start). A node is expanded once for each start, when it is first met.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "src", "relation", "dst").unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "src", "relation", "dst")).distinct()
    front = starts.distinct().select("start", F.col("start").alias("node"))
    met, found = front, None
    for depth in range(1, hops + 1):
        step = front.join(both, "node").select("start", "other", "src", "relation", "dst", F.lit(depth).alias("depth"))
        found = step if found is None else found.unionByName(step)
        if depth < hops:
            front = step.select("start", F.col("other").alias("node")).distinct().join(met, ["start", "node"], "left_anti")
            if depth > 1:
                front = cut_lineage(front)
            met = met.unionByName(front)
    return found.groupBy("start", "src", "relation", "dst").agg(F.min("depth").alias("depth"))


def entity_inventory(rows: DataFrame, approved: DataFrame, owner: str) -> DataFrame:
    """GR03. One row per approved or found entity key: present, forked, owner as expected, alias target valid, ok.

    ``rows`` has (id, ts, type, ekey, evalue, agent, supersedes) of types entity and alias; ``approved`` has (ekey).
    """
    r = rows.filter(F.col("type").isin("entity", "alias"))
    forks = fork_detection(r).groupBy("ekey").agg(F.max("forked").alias("forked"))
    owners = r.groupBy("ekey").agg(F.max(~F.col("agent").eqNullSafe(F.lit(owner))).alias("unexpected_owner"), F.max(F.col("type") == "entity").alias("has_entity"))
    ap = approved.select(F.col("ekey").alias("_a")).distinct()
    al = latest_by(r.filter("type = 'alias'").select("ekey", "evalue", "ts", "id"), ["ekey"], ["ts", "id"]).join(ap, F.col("evalue") == F.col("_a"), "left").select(
        F.col("ekey").alias("_k"), F.col("_a").isNull().alias("bad_alias_target"))
    j = owners.join(forks, "ekey").join(al, F.col("ekey") == F.col("_k"), "left").join(ap, F.col("ekey") == F.col("_a"), "full_outer")
    f = lambda c: F.coalesce(c, F.lit(False))
    out = j.select(F.coalesce("ekey", "_a").alias("ekey"), F.col("_a").isNotNull().alias("approved"), f(F.col("has_entity")).alias("present"),
                   f(F.col("forked")).alias("forked"), f(F.col("unexpected_owner")).alias("unexpected_owner"), f(F.col("bad_alias_target")).alias("bad_alias_target"))
    return out.withColumn("ok", F.col("present") & ~F.col("forked") & ~F.col("unexpected_owner") & ~F.col("bad_alias_target"))


def chain_members(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """GR04. (head, id, depth) for every row of the chain below each head; depth 0 is the head.

    Chains are cut at heads and at rows that several rows supersede. Inside a piece list ranking gives every row its distance from the top;
    only the tops, few as they are, are then reached from the heads, and each piece is attached once. Where nothing forks a piece is a whole
    chain. A row that supersedes a missing row ends its chain; rows on a cycle are cut at the first repeated row.
    """
    ids = rows.filter(F.col("id").isNotNull()).select("id").distinct()
    step = rows.filter(F.col("supersedes").isNotNull() & (F.col("supersedes") != F.col("id"))).select(F.col("id").alias("src"), F.col("supersedes").alias("dst")).join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy("src").agg(F.min("dst").alias("dst"))
    step = cut_lineage(step)
    above = step.groupBy("dst").agg(F.count("*").alias("_n"), F.min("src").alias("src"))
    tops = cut_lineage(heads.select("id").union(above.filter("_n > 1").select(F.col("dst").alias("id"))).distinct())
    # The way up of every other row to the first top, or to a row above all heads, which then counts for nothing.
    up = above.filter("_n = 1").select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(tops.withColumnRenamed("id", "src"), "src", "left_anti")
    ranked = follow(up).filter("ended").join(tops.withColumnRenamed("id", "end"), "end", "left_semi").select(F.col("end").alias("top"), F.col("src").alias("id"), F.col("steps").alias("distance"))
    pieces = cut_lineage(ranked.unionByName(tops.select(F.col("id").alias("top"), "id", F.lit(0).cast("long").alias("distance"))))
    # A top that is superseded continues the pieces that end just above it. Every piece has one next top at most.
    below = step.join(tops.withColumnRenamed("id", "dst"), "dst", "left_semi").join(pieces.withColumnRenamed("id", "src"), "src").select(F.col("top").alias("src"), "dst", (F.col("distance") + 1).alias("width"))
    below = cut_lineage(below)
    reach = heads.select(F.col("id").alias("head"), F.col("id").alias("top"), F.lit(0).cast("long").alias("depth")).distinct()
    jump, size = below, 0
    # From the heads every reached top is extended by the jump of the round, 1, 2, 4, ... pieces, until a round adds nothing.
    while not jump.isEmpty() and (now := (reach := cut_lineage(reach)).count()) > size:
        size = now
        more = reach.join(jump, F.col("top") == F.col("src")).select("head", F.col("dst").alias("top"), (F.col("depth") + F.col("width")).alias("depth"))
        reach = reach.unionByName(more).groupBy("head", "top").agg(F.min("depth").alias("depth"))
        far = jump.select(F.col("src").alias("_m"), F.col("dst").alias("_d"), F.col("width").alias("_w"))
        jump = cut_lineage(jump.join(far, F.col("dst") == F.col("_m")).select("src", F.col("_d").alias("dst"), (F.col("width") + F.col("_w")).alias("width")))
    return reach.join(pieces, "top").select("head", "id", (F.col("depth") + F.col("distance")).alias("depth"))


def supersede_chain(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """GR04. Chain rows with their position from the oldest (1) to the head."""
    m = chain_members(rows, heads)
    n = m.groupBy("head").agg(F.max("depth").alias("_m"))
    return m.join(n, "head").select("head", "id", (F.col("_m") - F.col("depth") + 1).alias("position"), (F.col("_m") + 1).alias("chain_length"))


def _ending(edges: DataFrame, near: str, far: str) -> DataFrame:
    """(node): the nodes that cannot be left for ever along edges from ``near`` to ``far``, as far as single edges tell: those without an edge, and
    those whose only edges lead to such a node in turn."""
    out = edges.groupBy(near).agg(F.count("*").alias("_n"), F.min(far).alias("_far"))
    single = out.filter("_n = 1").select(F.col(near).alias("src"), F.col("_far").alias("dst"))
    several = out.filter("_n > 1").select(F.col(near).alias("end"))
    hanging = follow(single).filter("ended").join(several, "end", "left_anti").select(F.col("src").alias("node"))
    return hanging.union(edges.select(F.col(far).alias("node")).distinct().join(out.select(F.col(near).alias("node")), "node", "left_anti"))


def cycle_check(edges: DataFrame) -> DataFrame:
    """GR05. Edges that lie on or between cycles, self edges included; an empty result is an acyclic graph.

    Nodes that lead nowhere, and nodes that nothing leads to, are taken away until nothing changes. A whole chain goes at once: where a node has a single
    edge its end is found by pointer jumping, so a chain of n edges takes log2(n) rounds. Further rounds are needed only as deep as branches lie behind branches.
    """
    cur = cut_lineage(edges.select("src", "dst").distinct())
    n, unchanged, side = cur.count(), 0, ("dst", "src")
    while n and unchanged < 2:
        cur = cut_lineage(cur.join(_ending(cur, *side).withColumnRenamed("node", side[1]), side[1], "left_anti").select("src", "dst"))
        n, before, side = cur.count(), n, side[::-1]
        unchanged = unchanged + 1 if n == before else 0
    return cur.withColumn("self_edge", F.col("src") == F.col("dst"))


CREDENTIAL_SUFFIX = r"-(key|secret|token|id|url|endpoint|sa|p8|dsn)$"


def entity_keys(text: Column, phrases: Sequence[str]) -> Column:
    """GR06. Known phrases at token boundaries and kebab identifiers with a credential suffix, as sorted keys."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    known = [F.when(hay.rlike("(^|[^a-z0-9])" + p.replace(".", r"\.") + "([^a-z0-9]|$)"), "_".join("".join(ch if ch.isalnum() else " " for ch in p).split())) for p in phrases]
    kebab = F.filter(F.regexp_extract_all(hay, F.lit(tx.ascii_regex(r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+){1,5}\b")), F.lit(0)), lambda k: k.rlike(CREDENTIAL_SUFFIX))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*known)), kebab)))
