"""Set operations over feeds and keys."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import fixed, text as tx
from tallywright.functions.ordered import bucketed_row_number, ranged, top_per_key
from tallywright.operators.joins import active_rows


def union_feeds(a: DataFrame, b: DataFrame, denied: Column) -> DataFrame:
    """SO01. Two normalised feeds as one, without superseded rows, other types, blank or denied rows."""
    keep = F.col("type").isin(*fixed.KEEP_TYPES) & (F.coalesce("agent", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    return active_rows(a).unionByName(active_rows(b)).withColumn("agent", F.lower("agent")).filter(keep & ~denied)


def set_counts(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """SO02. Sizes of all seven regions of three key sets in one aggregation."""
    both = a.select(key, F.lit(1).alias("x")).unionByName(b.select(key, F.lit(2).alias("x"))).unionByName(c.select(key, F.lit(4).alias("x")))
    bits = both.groupBy(key).agg(F.bit_or("x").alias("bits"))
    return bits.groupBy("bits").agg(F.count("*").alias("n")).select(
        ((F.col("bits").bitwiseAND(1)) > 0).alias("in_a"), (F.col("bits").bitwiseAND(2) > 0).alias("in_b"), (F.col("bits").bitwiseAND(4) > 0).alias("in_c"), "n")


def topk_overlap(a: Column, b: Column, k: int) -> Column:
    """SO03. Shared ids of two top-k lists as a percentage; both empty 100, one empty 0."""
    eff = F.least(F.lit(k), F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 100.0).when(eff == 0, 0.0).otherwise(
        F.round(F.size(F.array_intersect(a, b)) / eff * 10000) / 100)


def duplicate_or_conflict(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """SO04. Repeated keys: equal digests are duplicates, different digests a conflict."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(digest).alias("_a"), F.max(digest).alias("_b"))
    return g.filter("n > 1").select(key, "n", F.when(F.col("_a") == F.col("_b"), "duplicate").otherwise("conflict").alias("verdict"))


def dedupe_by_prefix(rows: DataFrame, id: str, text: str, chars: int | None = None, min_chars: int = 70) -> DataFrame:
    """SO05. First row per lower-cased text, or its first ``chars`` characters (as published 80), among texts of the minimum length."""
    t = F.trim(text)
    r = rows.withColumn("_t", t).filter(F.length("_t") >= min_chars).withColumn("_k", F.lower(tx.leading(F.col("_t"), chars)))
    rest = [c for c in rows.columns if c != id]
    return r.groupBy("_k").agg(F.min_by(F.struct(id, *rest), id).alias("_r")).select("_r.*")


def union_discovered_ids(listed: DataFrame, searched: DataFrame, key: str) -> DataFrame:
    """SO06. Every id found by either path with the paths that found it."""
    both = listed.select(key, F.lit(1).alias("x")).unionByName(searched.select(key, F.lit(2).alias("x")))
    bits = both.groupBy(key).agg(F.bit_or("x").alias("_b"))
    return bits.select(key, (F.col("_b").bitwiseAND(1) > 0).alias("via_list"), (F.col("_b").bitwiseAND(2) > 0).alias("via_search"))


def set_changed(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """SO07. One row: whether the key sets differ, and by how many keys on each side."""
    both = previous.select(key, F.lit(1).alias("x")).unionByName(current.select(key, F.lit(2).alias("x")))
    bits = both.groupBy(key).agg(F.bit_or("x").alias("b"))
    return bits.agg(F.count_if(F.col("b") == 1).alias("removed"), F.count_if(F.col("b") == 2).alias("added")).withColumn(
        "changed", (F.col("removed") > 0) | (F.col("added") > 0))


def capped_fact_list(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str, fact: str, cap: int | None = None, chars: int | None = None) -> DataFrame:
    """SO08. New facts not seen before go in front, newest first; ``cap`` cuts the list and ``chars`` compares only the first
    characters (as published 10 and 64).

    Every list entry is a row with its position. Equal facts are reduced to one before they are ranked.
    """
    k = F.lower(tx.leading(F.col(fact), chars))
    old = existing.withColumn("_k", k).withColumn("_age", F.lit(1))
    fresh = new.withColumn("_k", k).groupBy(*keys, "_k").agg(F.min_by(F.struct(order, fact), order).alias("_r")).select(*keys, "_k", "_r.*")
    fresh = fresh.join(old.select(*keys, "_k").distinct(), [*keys, "_k"], "left_anti").withColumn("_age", F.lit(0))
    both = fresh.select(*keys, order, fact, "_age").unionByName(old.select(*keys, order, fact, "_age"))
    # New facts in reverse order of arrival, then the existing list in its own order.
    front = F.when(F.col("_age") == 0, -F.col(order)).otherwise(F.col(order))
    if cap is not None:
        return top_per_key(both, keys, [F.asc("_age"), front], cap, "position").drop("_age")
    # The whole list of a key is numbered in ranges of equal row count.
    r = ranged(both.withColumn("_front", front), keys, ["_age", "_front"])
    return bucketed_row_number(r, keys, F.col("_range"), ["_age", "_front"], "position").withColumn("position", F.col("position").cast("int")).drop("_age", "_front", "_range")

