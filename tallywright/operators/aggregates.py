"""Counts, rollups and censuses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import fixed
from tallywright.functions.ordered import bucketed_row_number, bucketed_running, ranged


def catalog_status(catalog: DataFrame, dims: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """AG01. Rows and flag totals per value of every dimension, in one pass: each row is expanded once per dimension."""
    keys = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("?")).alias("value")) for d in dims],
                   F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")))
    flagged = catalog.select(F.explode(keys).alias("_k"), *[c.alias(n) for n, c in flags.items()])
    return flagged.groupBy("_k.dim", "_k.value").agg(F.count("*").alias("rows"), *[F.count_if(F.col(n)).alias(n) for n in flags])


def materialize_counts(catalog: DataFrame, reason: Column, path: str = "path", digest: str = "sha256") -> DataFrame:
    """AG02. Source, eligible, duplicate and excluded rows; ``conserved`` states that they add up."""
    r = catalog.withColumn("_why", reason)
    by_path = r.groupBy(path).agg(F.count("*").alias("n"), F.count_if(F.col("_why").isNull()).alias("ok"))
    total = by_path.agg(F.sum("n").alias("source_rows"), F.count_if(F.col("ok") > 0).alias("eligible_rows"),
                        F.sum(F.greatest(F.col("ok") - 1, F.lit(0))).alias("duplicate_rows"), F.sum(F.col("n") - F.col("ok")).alias("excluded_rows"))
    return total.withColumn("conserved", F.col("source_rows") == F.col("eligible_rows") + F.col("duplicate_rows") + F.col("excluded_rows"))


def excluded_counts(catalog: DataFrame, reason: Column) -> DataFrame:
    """AG02. Excluded rows per reason."""
    return catalog.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def field_census(df: DataFrame, fields: Sequence[str], scopes: dict[str, Sequence[str]]) -> DataFrame:
    """AG03. Per field: rows where it is present and where it is a non-blank string; per scope: rows with all its fields."""
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}

    def filled(f: str) -> Column:
        return (F.col(f).isNotNull() & (F.trim(f) != "")) if f in strings else F.lit(False)

    aggs = [F.count("*").alias("rows")]
    for f in fields:
        aggs += [F.count(f).alias(f"{f}__present"), F.count_if(filled(f)).alias(f"{f}__filled")]
    for s, fs in scopes.items():
        every = F.lit(True)
        for f in fs:
            every = every & filled(f)
        aggs.append(F.count_if(every).alias(f"{s}__scoped"))
    one = df.agg(*aggs)
    lines = [F.struct(F.lit("field").alias("kind"), F.lit(f).alias("name"), F.col(f"{f}__present").alias("present"), F.col(f"{f}__filled").alias("filled")) for f in fields]
    lines += [F.struct(F.lit("scope").alias("kind"), F.lit(s).alias("name"), F.col(f"{s}__scoped").alias("present"), F.col(f"{s}__scoped").alias("filled")) for s in scopes]
    return one.select("rows", F.explode(F.array(*lines)).alias("_l")).select("rows", "_l.*")


def usage_rollup(usage: DataFrame, keys: Sequence[str], tokens_in: str, tokens_out: str, cost: str) -> DataFrame:
    """AG04. Token, cost and request totals per key combination."""
    return usage.groupBy(*keys).agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"),
                                    F.sum(cost).alias("cost_usd"), F.count("*").alias("requests"))


def model_price(model: Column) -> list[Column]:
    """Input, output, cache write and cache read price per million tokens; unknown models count as sonnet."""
    out = []
    for i in range(4):
        price = None
        for name, p in fixed.MODEL_PRICES.items():
            hit = F.contains(F.lower(F.coalesce(model, F.lit(""))), F.lit(name))
            price = F.when(hit, p[i]) if price is None else price.when(hit, p[i])
        out.append(price.otherwise(fixed.MODEL_PRICES["sonnet"][i]))
    return out


def session_telemetry(turns: DataFrame, session: str = "session") -> DataFrame:
    """AG05. Turns, tool calls, errors, tokens, dominant model, span and cost per session.

    ``turns`` has (session, ts, role, model, tool, is_error, tok_in, tok_out, tok_cache_write, tok_cache_read). The first
    step groups by session and model and is combined before its shuffle; ties of the model go to the one seen first.
    """
    a = F.col("role") == "assistant"
    per_model = turns.groupBy(session, F.when(a, F.col("model")).alias("model")).agg(
        F.count_if(a).alias("turns"), F.count_if(F.col("tool").isNotNull() & a).alias("tool_calls"), F.count_if("is_error").alias("errors"),
        *[F.sum(F.when(a, F.col(c)).otherwise(0)).alias(c) for c in ("tok_in", "tok_out", "tok_cache_write", "tok_cache_read")],
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    rank = F.struct(F.col("model").isNotNull(), "turns", -F.unix_micros(F.col("first_ts").cast("timestamp")))
    s = per_model.groupBy(session).agg(
        F.coalesce(F.max_by("model", rank), F.lit("unknown")).alias("model"),
        *[F.sum(c).alias(c) for c in ("turns", "tool_calls", "errors", "tok_in", "tok_out", "tok_cache_write", "tok_cache_read")],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    pi, po, pw, pr = model_price(F.col("model"))
    cost = (F.col("tok_in") * pi + F.col("tok_out") * po + F.col("tok_cache_write") * pw + F.col("tok_cache_read") * pr) / 1e6
    span = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1000
    return s.withColumn("cost_usd", cost).withColumn("duration_ms", F.floor(span))


def duplicate_census(objects: DataFrame, reference: str, id: str, updated: str, min_count: int = 2) -> DataFrame:
    """AG06. Groups of at least ``min_count`` objects with one reference; the write days are bounded by the calendar."""
    day = F.date_format(updated, "yyyy-MM-dd")
    return objects.groupBy(reference).agg(
        F.count("*").alias("count"), F.min(id).alias("first_id"), F.array_join(F.array_sort(F.collect_set(day)), ",").alias("write_days")
    ).filter(F.col("count") >= min_count).withColumn("phantom", F.col("count") - 1)


def duplicate_members(objects: DataFrame, reference: str, cols: Sequence[str], min_count: int = 2) -> DataFrame:
    """AG06. The objects of the duplicate groups as rows, so that a group of any size stays spread out."""
    big = objects.groupBy(reference).agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    return objects.select(reference, *cols).join(big, reference)


def queue_metrics(classified: DataFrame) -> DataFrame:
    """AG07. Open items per owner by state, longest wait and blocking items; ``classified`` comes from EV19."""
    states = ["open", "near-due", "overdue", "ack"]
    live = classified.filter(F.col("state").isin(*states))
    return live.groupBy("owner").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in states],
        F.max("days_overdue").alias("oldest_wait_days"),
        F.count_if(F.col("terminal") & (F.col("terminal_policy") == "block")).alias("blocking"))


def digest_by_category(classified: DataFrame, tier_one: Column) -> DataFrame:
    """AG08. Attention rows outside tier one, ranked inside their category, longest overdue first, with category totals."""
    att = classified.filter(~tier_one & F.col("state").isin("overdue", "near-due", "ack"))
    wait = F.col("days_overdue")
    ranked = att.select("id", "owner", "category", "state", "days_overdue", "days_until_due", (-wait).alias("_w"))
    # Ranks are taken inside ranges of equal row count, so that a large category, or a wait that many share, is sorted by many tasks.
    ranked = bucketed_row_number(ranged(ranked, ["category"], ["_w", "id"]), ["category"], F.col("_range"), ["_w", "id"], "position").drop("_w", "_range")
    tag = (F.when(F.col("state") == "overdue", F.concat(F.lit("OVERDUE "), F.round("days_overdue").cast("long").cast("string"), F.lit("d past SLA")))
           .when(F.col("state") == "near-due", F.concat(F.lit("due in "), F.ceil("days_until_due").cast("string"), F.lit("d")))
           .otherwise("acknowledged, still open"))
    return ranked.withColumn("tag", tag)


def severity_tally(findings: DataFrame, severities: DataFrame) -> DataFrame:
    """AG09. Open findings per severity, zero included."""
    n = findings.filter(F.col("status") == "open").groupBy("severity").agg(F.count("*").alias("n"))
    return severities.join(n, "severity", "left").fillna(0, ["n"])


def arg_max_status(beacons: DataFrame, agent: str, cols: Sequence[str], ts: str = "ts", since: Column | None = None) -> DataFrame:
    """AG10. The newest row of each agent: ``cols`` and its time. Of several at that time the one with the greatest values, all from one row."""
    b = beacons if since is None else beacons.filter(F.col(ts) > since)
    newest = b.groupBy(agent).agg(F.max(F.struct(F.col(ts).alias("_ts"), *cols)).alias("_n"))
    return newest.select(agent, *[F.col(f"_n.`{c}`").alias(c) for c in cols], F.col("_n._ts").alias("last"))


def activity_funnel(events: DataFrame, since: Column, user: str, event: str, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """AG11. (events and distinct actives, events by frequency, all or the first ``top``) of the window."""
    recent = events.filter(F.col("ts") > since)
    totals = recent.agg(F.count("*").alias("events"), F.count_distinct(user).alias("actives"))
    often = recent.groupBy(event).agg(F.count("*").alias("n")).orderBy(F.desc("n"), event)
    return totals, often if top is None else often.limit(top)


def newest_and_count(events: DataFrame, stream: str, since: Column, ts: str = "ts") -> DataFrame:
    """AG12. Newest time and row count per stream in the lookback."""
    return events.filter(F.col(ts) > since).groupBy(stream).agg(F.max(ts).alias("newest"), F.count("*").alias("n"))


def latency_stats(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], width: float) -> DataFrame:
    """AG13. Mean and exact order statistics sorted[floor(n*q)] per key.

    Equal values are counted before they are sorted, so a value that half of the rows have is one row. The counts are added up inside value
    buckets of ``width``; a value is the order statistic whose position falls among its own.
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = bucketed_running(counts, keys, F.floor(F.col(value) / width), [value], {"_upto": F.col("_c")})
    at = {q: F.least(F.col("n") - 1, F.floor(F.col("n") * v)) for q, v in quantiles.items()}
    met = upto.join(n.select(*[F.col(k).alias(f"_k{k}") for k in keys], *[c.alias(f"_at_{q}") for q, c in at.items()]), [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys])
    of = lambda q: F.max(F.when((F.col(f"_at_{q}") < F.col("_upto")) & (F.col(f"_at_{q}") >= F.col("_upto") - F.col("_c")), F.col(value)))
    picked = met.groupBy(*keys).agg(*[of(q).alias(q) for q in quantiles]).select(*[F.col(k).alias(f"_k{k}") for k in keys], *quantiles)
    return n.join(picked, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys]).drop(*[f"_k{k}" for k in keys])


def oldest_and_count(df: DataFrame, container: str, ts: str, now: Column) -> DataFrame:
    """AG14. Rows and age of the oldest row in days per container."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 86400e6
    return df.groupBy(container).agg(F.count("*").alias("n"), F.round(age, 1).alias("oldest_age_days"))


def mean_ignoring_failures(df: DataFrame, keys: Sequence[str], rating: Column, failed: Column) -> DataFrame:
    """AG15. Mean rating over parsed rows, failures counted apart; no parsed row gives 0."""
    ok = F.when(~failed, rating)
    return df.groupBy(*keys).agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("mean_rating"), F.count_if(failed).alias("failures"))


def having_after_filter(df: DataFrame, where: Column, key: str, more_than: int) -> DataFrame:
    """AG16. Filter, then group, then keep groups above the count."""
    return df.filter(where).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def approx_row_count(df: DataFrame) -> DataFrame:
    """AG17. Number of rows with the relative error of the figure. A count without columns reads the footers of Parquet files and no
    data, so it costs no more than an estimate and has no error."""
    return df.agg(F.count("*").alias("estimate")).withColumn("rsd", F.lit(0.0))


def user_order_summary(users: DataFrame, orders: DataFrame) -> DataFrame:
    """AG18. Orders, spend and last order per user; orders are summed before the join."""
    o = orders.groupBy("o_custkey").agg(F.count("*").alias("total_orders"), F.sum("o_totalprice").alias("total_spent"), F.max("o_orderdate").alias("last_order"))
    return users.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", F.coalesce("total_orders", F.lit(0)).alias("total_orders"), "total_spent", "last_order")


def refresh_user_order_summary(users: DataFrame, orders: DataFrame, path: str) -> None:
    """AG18. Rewrites the summary table."""
    user_order_summary(users, orders).write.mode("overwrite").parquet(path)


def tool_counts_map(events: DataFrame, session: str, tool: str) -> DataFrame:
    """AG19. Map tool -> count per session; counted per (session, tool) before the map is built."""
    n = events.groupBy(session, tool).agg(F.count("*").alias("n"))
    return n.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(tool, "n")))).alias("tools"))


def coverage_report(catalog: DataFrame, family: str, reason: Column) -> DataFrame:
    """AG20. Eligible and excluded rows per source family with the conservation check."""
    r = catalog.withColumn("_why", reason)
    return r.groupBy(family).agg(
        F.count("*").alias("catalog_rows"), F.count_if(F.col("_why").isNull()).alias("eligible"), F.count("_why").alias("excluded")
    ).withColumn("conserved", F.col("catalog_rows") == F.col("eligible") + F.col("excluded"))


