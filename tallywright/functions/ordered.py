"""Ordered computations that stay spread out when one key holds a large part of all rows.

A plain window over a key puts the whole key into one task. The helpers here cut each key into
buckets of its order column (a day, a block of ids, or ranges of equal row count), work inside the buckets, and carry one summary row per
(key, bucket) across the bucket borders. The summary is small, and the large side is shuffled once.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import cut_lineage


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, as a partially aggregated ``max_by``."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    out = df.groupBy(*keys).agg(pick)
    return out.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark cuts every map partition to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_overall(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows, by TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


def _inside(keys: Sequence[str], bucket: str, order: Sequence[Column]):
    return Window.partitionBy(*keys, bucket).orderBy(*order)


def bucketed_lag(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                 cols: dict[str, str]) -> DataFrame:
    """``lag(col)`` over (keys, order) for each ``{output: col}``; ``bucket`` must grow with ``order``."""
    df = df.withColumn("_b", bucket)
    inside = _inside(keys, "_b", [F.col(c) for c in order])
    src = list(dict.fromkeys(cols.values()))
    df = df.withColumn("_prev", F.lag(F.struct(*src)).over(inside))
    tails = df.groupBy(*keys, "_b").agg(F.max_by(F.struct(*src), F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_b") if keys else Window.partitionBy(F.lit(0)).orderBy("_b")
    tails = tails.withColumn("_before", F.lag("_tail").over(across)).drop("_tail")
    joined = _carry(df, tails, [*keys, "_b"])
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    return joined.select(*[F.col(c) for c in df.columns if c not in ("_b", "_prev")],
                         *[prev.getField(c).alias(out) for out, c in cols.items()])


def bucketed_running(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                     sums: dict[str, Column]) -> DataFrame:
    """Running sums (current row included) over (keys, order) for each ``{output: expression}``."""
    df = df.withColumn("_b", bucket)
    for out, expr in sums.items():
        df = df.withColumn(f"_v_{out}", expr)
    inside = _inside(keys, "_b", [F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    for out in sums:
        df = df.withColumn(f"_r_{out}", F.sum(f"_v_{out}").over(inside))
    totals = df.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in sums])
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", *[
        F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums])
    joined = _carry(df, totals, [*keys, "_b"])
    plain = [F.col(c) for c in df.columns if c != "_b" and not c.startswith(("_v_", "_r_"))]
    return joined.select(*plain, *[(F.col(f"_r_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])


def bucketed_running_max(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                         out: str, value: Column) -> DataFrame:
    """Running maximum of ``value`` (nulls ignored) over (keys, order)."""
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    inside = _inside(keys, "_b", [F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_r", F.max("_v").over(inside))
    tops = df.groupBy(*keys, "_b").agg(F.max("_v").alias("_t"))
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b")
    tops = tops.select(*keys, "_b", F.max("_t").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_o"))
    joined = _carry(df, tops, [*keys, "_b"])
    return joined.select(*[F.col(c) for c in df.columns if c not in ("_b", "_v", "_r")],
                         F.greatest("_r", "_o").alias(out))


def attach(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group facts joined back to the rows of the group.

    Instead of a window over the group: the aggregate is combined before its shuffle, the join has one row per
    key on one side, and adaptive execution splits the other side of a hot key.
    """
    return _carry(df, df.groupBy(*keys).agg(*aggs), keys)


def bucketed_row_number(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                        out: str = "rn") -> DataFrame:
    """``row_number`` over (keys, order)."""
    return bucketed_running(df, keys, bucket, order, {out: F.lit(1).cast("long")})


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_range") -> DataFrame:
    """The rows with the number of their range of (keys, order), as a bucket for the functions above.

    Ranges are partitions of Spark's range partitioning, so each holds about as many rows as the others whatever the keys are and however close together
    their rows lie; a key that is large is cut, small keys share a range. Equal (keys, order) stay together. The rows are written once, for
    the numbers have to be the same wherever they are used.
    """
    dealt = df.repartitionByRange(*keys, *order) if keys or order else df
    return cut_lineage(dealt.withColumn(name, F.spark_partition_id()))


def next_marked(df: DataFrame, order: str, mark: str, name: str) -> DataFrame:
    """``name``: the first value of ``mark`` that is not null on the row or after it, in ``order`` of all rows.

    The rows are sorted in ranges. What a range needs from those behind it is one value, their first mark; there are as many as partitions.
    """
    r = ranged(df, [], [order])
    firsts = sorted((x["_range"], x["m"]) for x in r.groupBy("_range").agg(F.min_by(mark, F.when(F.col(mark).isNotNull(), F.col(order))).alias("m")).collect())
    after, carry = None, {}
    for k, m in reversed(firsts):
        carry[k] = after
        after = m if m is not None else after
    kind = r.schema[mark].dataType
    behind = df.sparkSession.createDataFrame(list(carry.items()), f"_range int, _behind {kind.simpleString()}")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    own = r.withColumn(name, F.first(mark, ignorenulls=True).over(inside))
    return own.join(F.broadcast(behind), "_range").withColumn(name, F.coalesce(name, "_behind")).drop("_range", "_behind")


def time_bucket(col: str = "ts", minutes: int = 60) -> Column:
    """Number of the stretch of time that a row falls in; a shorter one splits a busy key further."""
    return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / F.lit(minutes * 60_000_000))


def id_bucket(col: str, width: int = 65536) -> Column:
    return F.floor(F.col(col) / F.lit(width))


def _carry(df: DataFrame, summary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left join of the one-row-per-bucket summary; null keys match null keys."""
    for c in cols:
        summary = summary.withColumnRenamed(c, f"_k{c}")
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    return df.join(summary, cond, "left").drop(*[f"_k{c}" for c in cols])
