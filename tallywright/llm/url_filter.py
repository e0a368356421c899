"""URL filter: rules of host and path first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions. Features are whole numbers in few classes, so all labelled URLs shrink by grouped aggregation to one
row for each combination of classes, at most ``CELLS`` rows whatever the input. A tree grows level by level: one aggregation gives, for
every node, feature and class, the sums of gradients and curvatures, and from these few numbers the best split of each node is taken. The
sums are fixed-point longs, so the trees do not depend on the order of rows or on partitions.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import only, saved

#: A value's class is the number of these that it reaches.
EDGES = {
    "length": [24, 32, 40, 48, 64, 96, 160],
    "depth": [1, 2, 3, 4, 5, 7, 10],
    "digits": [20, 50, 80, 110, 150, 220, 350],  # in thousandths of all characters
    "entropy": [300, 330, 360, 390, 420, 450, 480],  # of characters, in hundredths of a bit
    "parameters": [1, 2, 3, 4, 6, 9, 14],
    "suffix_share": [150, 300, 450, 550, 650, 750, 850],  # blocked among the labelled URLs of the suffix, in thousandths
    "suffix_count": [1, 10, 100, 1000, 10_000, 100_000, 1_000_000],
}
FEATURES = list(EDGES)
CELLS = math.prod(len(e) + 1 for e in EDGES.values())
ONE = 1 << 20  # of the fixed-point numbers


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    ``rules`` are (verdict, host and path). A rule without ``/`` fits every path. Of rules of one length the one with the longer host wins, of equal rules the last.
    """
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]))):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        named, verdict = F.when(fits, F.lit(rule)).otherwise(named), F.when(fits, F.lit(decision)).otherwise(verdict)
    return named, verdict


def lexical(url: Column) -> dict[str, Column]:
    """Whole-number features of a URL that is not null, and the suffix of its host."""
    host, path = host_of(url), path_of(url)
    n = F.length(url)
    kinds = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    counts = F.transform(kinds, lambda c: n - F.length(F.replace(url, c, F.lit(""))))
    spread = F.aggregate(counts, F.lit(0.0), lambda total, k: total + k * F.log2(k))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pieces = lambda text, mark: F.size(F.filter(F.split(text, mark), lambda x: x != ""))
    return {
        "length": n,
        "depth": pieces(path, "/"),
        "digits": F.when(n == 0, 0).otherwise(F.floor((n - F.length(F.translate(url, "0123456789", ""))) * 1000 / n)),
        "entropy": F.when(n == 0, 0).otherwise(F.floor(100 * (F.log2(n) - spread / n) + 1e-9)),
        "parameters": pieces(query, "&"),
        "suffix": F.element_at(F.split(host, r"\."), -1),
    }


def _classed(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Rows with ``url`` and the class of every feature; a suffix without labelled URLs is as likely blocked as not."""
    kept = [c for c in rows.columns if c != "url"]
    wide = rows.select(*kept, *[c.alias(k) for k, c in lexical(F.col("url")).items()]).join(suffixes, "suffix", "left")
    value = {k: F.coalesce(F.col(k), F.lit({"suffix_share": 500}.get(k, 0))) for k in FEATURES}
    return wide.select(*kept, *[reduce(lambda a, b: a + b, [(value[k] >= e).cast("int") for e in EDGES[k]]).alias(k) for k in FEATURES])


@dataclass
class Trees:
    """Boosted trees: ``start`` and the leaves are fixed-point log odds of being blocked."""

    start: int
    trees: list[tuple[dict[int, tuple[str, int]], dict[int, int]]] = field(default_factory=list)  # splits and leaf values by node

    def margin(self) -> Column:
        return reduce(lambda a, b: a + b, [at_leaf(splits, lambda node, v=values: F.lit(v[node]).cast("long")) for splits, values in self.trees], F.lit(self.start).cast("long"))


def at_leaf(splits: dict[int, tuple[str, int]], value, node: int = 1) -> Column:
    """``value(leaf)`` for the leaf that a row comes to; nodes 2i and 2i + 1 are below node i."""
    if node not in splits:
        return value(node)
    name, last = splits[node]
    return F.when(F.col(name) <= last, at_leaf(splits, value, 2 * node)).otherwise(at_leaf(splits, value, 2 * node + 1))


def best_splits(rows: DataFrame, splits: dict[int, tuple[str, int]], ridge: float) -> dict[int, tuple]:
    """For every node of the last level: its sums g and h, and the split of the greatest gain (ties: first feature, least class) as (gain, feature, class, g and h at its left)."""
    rows = rows.select(at_leaf(splits, lambda n: F.lit(n)).alias("node"), "g", "h", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("c")) for k, c in enumerate(FEATURES)])).alias("x"))
    # At most one row for each node, feature and class comes to the driver: 2 ** depth * 7 * 8.
    sums = sorted(rows.groupBy("node", "x.f", "x.c").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
    score = lambda g, h: float(g) * g / (h + ridge * ONE)
    out = {}
    for node in {r.node for r in sums}:
        mine = [[r for r in sums if r.node == node and r.f == f] for f in range(len(FEATURES))]
        g, h = sum(r.g for r in mine[0]), sum(r.h for r in mine[0])
        best = None
        for f, classes in enumerate(mine):
            lg = lh = 0
            for r in classes[:-1]:
                lg, lh = lg + r.g, lh + r.h
                gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                if best is None or gain > best[0]:
                    best = (gain, FEATURES[f], r.c, lg, lh)
        out[node] = (g, h, best)
    return out


def fit(cells: DataFrame, trees: int, depth: int, rate: float, ridge: float) -> Trees:
    """Newton boosting of the logistic loss over ``cells`` (classes, n, blocked). The margins are written after every tree."""
    n, blocked = (int(x or 0) for x in cells.agg(F.sum("n"), F.sum("blocked")).first())
    model = Trees(round(ONE * math.log((blocked + 1) / (n - blocked + 1))))
    leaf = lambda g, h: round(ONE * rate * g / (h + ridge * ONE))
    p = 1 / (1 + F.exp(-F.col("m") / ONE))
    state = cells.withColumn("m", F.lit(model.start).cast("long"))
    for _ in range(trees if 0 < blocked < n else 0):
        state = saved(state.withColumns({"g": F.round((F.col("blocked") - F.col("n") * p) * ONE).cast("long"), "h": F.round(F.col("n") * p * (1 - p) * ONE).cast("long")}), "margins")
        splits, values, level = {}, {}, {1}
        for _ in range(depth):
            below = set()
            for node, (g, h, best) in best_splits(state, dict(splits), ridge).items():
                if node not in level:
                    continue
                values[node] = leaf(g, h)
                if best and best[0] > 0:
                    _, name, last, lg, lh = best
                    splits[node], values[2 * node], values[2 * node + 1] = (name, last), leaf(lg, lh), leaf(g - lg, h - lh)
                    below |= {2 * node, 2 * node + 1}
            level = below
            if not level:
                break
        model.trees.append((splits, values))
        state = state.withColumn("m", F.col("m") + at_leaf(splits, lambda node: F.lit(values[node]).cast("long"))).drop("g", "h")
    return model


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labels: DataFrame | None = None, page_id: str = "page_id", url: str = "url",
                trees: int = 10, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row of ``pages``.

    ``labels`` are URLs with a boolean ``blocked`` (null: not labelled) that the trees learn from; without them the URLs that a rule decides are. All labelled URLs are
    used. Where no rule fits, a URL is blocked when the trees find that likelier than not; without labels it is allowed, with labels of one kind only their share decides. A null URL has
    empty host and path, no rule and the features of an empty text. Rows with one page_id, or with none, are judged one by one; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rows = only(pages, page_id=page_id, url=text)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, decision = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decision": decision})
    if labels is None:
        taught = rows.filter("decision IS NOT NULL").select("url", (F.col("decision") == "block").alias("blocked"))
    else:
        taught = only(labels, url=F.coalesce("url", F.lit("")), blocked="blocked").filter("blocked IS NOT NULL")
    taught = taught.withColumn("blocked", F.col("blocked").cast("long"))
    share = F.floor(1000 * (F.sum("blocked") + 1) / (F.count("*") + 2))
    suffixes = saved(taught.groupBy(lexical(F.col("url"))["suffix"].alias("suffix")).agg(share.alias("suffix_share"), F.count("*").alias("suffix_count")), "suffixes")
    cells = saved(_classed(taught, suffixes).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")), "cells")
    model = fit(cells, trees, depth, rate, ridge)
    judged = _classed(rows, suffixes).withColumn("m", model.margin())
    verdict = F.coalesce("decision", F.when(F.col("m") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("m") / ONE))).alias("p_block"))
