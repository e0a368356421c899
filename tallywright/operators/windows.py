"""Operators that depend on row order inside a key."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.ordered import (attach, bucketed_lag, bucketed_row_number, bucketed_running_max, ranged,
                                           latest_by, top_per_key)


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """WN01. Newest row per key."""
    return latest_by(rows, keys, order)


def fork_detection(rows: DataFrame, keys: Sequence[str] = ("type", "ekey")) -> DataFrame:
    """WN02. Keys in which a row does not supersede the row before it."""
    r = ranged(rows.select(*keys, "id", "ts", "supersedes"), keys, ["ts", "id"])
    prev = bucketed_lag(r, keys, F.col("_range"), ["ts", "id"], {"_prev": "id"})
    bad = F.col("_prev").isNotNull() & ~F.col("supersedes").eqNullSafe(F.col("_prev"))
    return prev.groupBy(*keys).agg(F.count("*").alias("rows"), F.max(bad).alias("forked"))


def last_two_runs_drop(runs: DataFrame, keys: Sequence[str], score: str, ts: str, drop: float = 0.34) -> DataFrame:
    """WN03. Newest against previous score; each map task sends at most two rows per key."""
    two = top_per_key(runs, keys, [F.desc(ts)], 2, "_n")
    g = two.groupBy(*keys).agg(F.max(F.when(F.col("_n") == 1, F.col(score))).alias("latest_score"),
                               F.max(F.when(F.col("_n") == 2, F.col(score))).alias("prior_score"))
    return g.withColumn("drop", F.col("prior_score") - F.col("latest_score")).filter(F.col("drop") >= drop)


def weekly_spike(daily: DataFrame, key: str, as_of: Column, floor: int = 5, ratio: float = 3.0) -> DataFrame:
    """WN04. Last seven days against the median of the three weeks before; missing days count as zero.

    The four weekly totals are conditional sums of one pass, so no calendar has to be filled in.
    """
    back = F.floor(F.datediff(as_of, F.col("day")) / 7)
    g = daily.filter(F.col("day") <= as_of).groupBy(key).agg(
        *[F.sum(F.when(back == w, F.col("n")).otherwise(0)).alias(f"w{w}") for w in range(4)],
        (F.datediff(as_of, F.min("day")) + 1).alias("history_days"))
    median = F.array_sort(F.array("w1", "w2", "w3"))[1].cast("double")
    r = F.when(median > 0, F.col("w0") / median)
    enough, above = F.col("history_days") >= 28, F.col("w0") >= floor
    return g.select(key, F.col("w0").alias("this_week"), median.alias("baseline"), r.alias("ratio"),
                    (enough & above & ((median == 0) | F.coalesce(r >= ratio, F.lit(False)))).alias("spike"),
                    F.when(~enough, "insufficient history").when(~above, "below floor").when(median == 0, "new source")
                    .when(r >= ratio, "above ratio").otherwise("normal").alias("reason"))


def split_factor(date: Column, splits: Sequence[tuple[str, float, float]]) -> Column:
    """WN05. Product of from/to over the splits after the date."""
    f = F.lit(1.0)
    for day, a, b in splits:
        f = f * F.when(F.lit(day).cast("date") > date, F.lit(a / b)).otherwise(F.lit(1.0))
    return f


def daily_change(bars: DataFrame, splits: Sequence[tuple[str, float, float]]) -> DataFrame:
    """WN06. Split-adjusted close, change, range, typical price and volumes; one row per trading day."""
    adj = F.col("close") * split_factor(F.col("date"), splits)
    prev = F.lag("split_adj_close").over(Window.orderBy("date"))
    vwap = F.when(F.col("vwap_true").isNotNull(), F.col("vwap_true")) if "vwap_true" in bars.columns else F.lit(None).cast("double")
    vwap = F.coalesce(vwap, (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = bars.withColumn("split_adj_close", adj).withColumn("_p", prev)
    return b.withColumn("change", F.col("split_adj_close") - F.col("_p")).withColumn(
        "change_pct", F.when(F.col("_p") != 0, (F.col("split_adj_close") - F.col("_p")) / F.col("_p") * 100)).withColumn(
        "range", F.col("high") - F.col("low")).withColumn("vwap", vwap).withColumn(
        "dollar_volume", F.col("close") * F.col("volume")).withColumn("traded_value", F.col("vwap") * F.col("volume")).drop("_p")


def mrr_growth(monthly: DataFrame, month: str = "month", mrr: str = "mrr") -> DataFrame:
    """WN07. Month-over-month growth; one row per month."""
    prev = F.lag(mrr).over(Window.orderBy(month))
    return monthly.withColumn("prev_mrr", prev).withColumn("growth_pct", F.try_divide(F.col(mrr) - F.col("prev_mrr"), F.col("prev_mrr")) * 100)


def rolling_anomaly(daily: DataFrame, keys: Sequence[str], value: str, history: int = 30, sigmas: float = 2.0) -> DataFrame:
    """WN08. Daily values further than ``sigmas`` sample deviations from the mean of the days before."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-history, -1)
    d = daily.withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_samp(value).over(w)).withColumn("_n", F.count(value).over(w))
    return d.withColumn("anomaly", (F.col("_n") >= 2) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("sd"))).drop("_n")


def partition_count(rows: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """WN09. One row per key with the size of its group."""
    return rows.groupBy(*keys).agg(F.count("*").alias(out))


def keep_recent_digest(rows: DataFrame, keep: int, cutoff: Column, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """WN10. (rows among the newest ``keep`` or after the cutoff, one digest row of all others)."""
    anon = rows.select(*key, "id", "ts")
    newest = top_per_key(anon, key, [F.desc("ts"), F.desc("id")], keep, "_n") if key else anon.orderBy(F.desc("ts"), F.desc("id")).limit(keep)
    marked = rows.join(newest.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left")
    stay = F.col("_i").isNotNull() | F.coalesce(F.col("ts") >= cutoff, F.lit(False))
    digest = marked.filter(~stay).groupBy(*key).agg(F.count("*").alias("count"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("start_date"),
                                                    F.date_format(F.max("ts"), "yyyy-MM-dd").alias("end_date"))
    return marked.filter(stay).drop("_i"), digest.filter("count > 0")


def collapse_near_spans(spans: Column, gap: int = 30) -> Column:
    """WN11. An array of (start, end, date) sorted by start, without spans of the same date that begin within ``gap`` of the last kept one.

    The kept spans of one text are folded in order, because each decision depends on the last kept span.
    """
    def step(acc, s):
        last = F.element_at(acc, -1)
        repeat = (F.size(acc) > 0) & F.coalesce((last["date"] == s["date"]) & (s["start"] - last["end"] < gap), F.lit(False))
        return F.when(repeat, acc).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def latest_per_agent(assertions: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """WN12. Several assertions of one agent count once, by the newest."""
    return latest_by(assertions.filter(F.col("agent").isNotNull()), [*keys, "agent"], order)


def consecutive_streak(scans: DataFrame, key: str, state: str, order: Sequence[str] = ("ts", "id"), bucket: Column | None = None) -> DataFrame:
    """WN13. Position of each scan inside its run of equal states. The scans are cut into ranges of equal row count, or into buckets of ``bucket``."""
    b = bucket if bucket is not None else F.col("_range")
    scans = scans if bucket is not None else ranged(scans, [key], order)
    s = bucketed_lag(scans, [key], b, order, {"_prev": state})
    s = bucketed_row_number(s, [key], b, order, "_rn")
    change = F.when(~F.col("_prev").eqNullSafe(F.col(state)), F.col("_rn"))
    s = bucketed_running_max(s, [key], b, order, "_start", change)
    return s.withColumn("streak", F.col("_rn") - F.col("_start") + 1).drop("_prev", "_rn", "_start", "_range")


def latest_and_peak(daily: DataFrame, key: str, value: str, day: str = "day") -> DataFrame:
    """WN14. Latest and highest value per key, with the share of the key on the last day of all."""
    last = daily.agg(F.max(day).alias("d")).scalar()
    total = daily.filter(F.col(day) == last).agg(F.sum(value).alias("v")).scalar()
    g = daily.groupBy(key).agg(F.max_by(value, day).alias("latest"), F.max(value).alias("peak"),
                               F.sum(F.when(F.col(day) == last, F.col(value)).otherwise(0)).alias("_l"))
    return g.withColumn("last_day_share", F.try_divide(F.col("_l"), total)).drop("_l")


def daily_sequence_id(rows: DataFrame, ts: str, id: str, width: int = 65536) -> DataFrame:
    """WN15. yyyymmdd-nnn per day, numbered by id in blocks so that one busy day is not sorted by one task."""
    d = rows.withColumn("_d", F.date_format(ts, "yyyyMMdd"))
    d = bucketed_row_number(d, ["_d"], F.floor(F.col(id) / width), [id], "_n")
    n = F.col("_n").cast("string")
    return d.withColumn("seq_id", F.concat_ws("-", "_d", F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, "0")))).drop("_d", "_n")


def collision_suffix(rows: DataFrame, target: str, order: str, digest: str) -> DataFrame:
    """WN16. The first row keeps a proposed path, later ones get six hash characters before the extension."""
    first = attach(rows, [target], [F.min(order).alias("_first")])
    name = F.element_at(F.split(target, "/"), -1)
    folder = F.expr(f"substr({target}, 1, length({target}) - length(element_at(split({target}, '/'), -1)))")
    h = F.concat(F.lit("_"), F.substring(digest, 1, 6))
    dotted = F.regexp_replace(name, r"^(.+)(\.[^.]*)$", F.concat(F.lit("$1"), h, F.lit("$2")))
    renamed = F.concat(folder, F.when(name.rlike(r"^.+\.[^.]*$"), dotted).otherwise(F.concat(name, h)))
    return first.withColumn("new_path", F.when(F.col(order) == F.col("_first"), F.col(target)).otherwise(renamed)).drop("_first")


def assign_doc_ids(rows: DataFrame, agent: str, id: str, text: str) -> DataFrame:
    """WN17. agent__id; when one base has different texts every member gets a hash suffix."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_\-=]", "_")
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    base = rows.withColumn("_base", clean(F.concat(F.col(agent), F.lit("__"), F.col(id)))).withColumn("_h", F.sha1(trimmed))
    b = attach(base, ["_base"], [F.min("_h").alias("_lo"), F.max("_h").alias("_hi")])
    short = F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, 12)
    return b.withColumn("doc_key", F.when(F.col("_lo") == F.col("_hi"), F.col("_base")).otherwise(F.concat("_base", F.lit("__"), short))).drop("_base", "_h", "_lo", "_hi")
