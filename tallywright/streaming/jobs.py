"""Streaming forms of the ledger, usage, freshness, alerting, safety and indexing jobs.

Each takes a streaming DataFrame and returns one, or runs it into a folder where a sink is part of the operator. All but
the state functions also accept a batch DataFrame, which is how they are checked against their batch twins.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.ordered import latest_by
from tallywright.operators.documents import chunk_rows
from tallywright.operators.privacy import safety_classify
from tallywright.operators.scalars import strip_html
from tallywright.streaming.runner import each_batch
from tallywright.streaming.stateful import Freshness, in_order

# Stateless and aggregating jobs ---------------------------------------------------------------------------------------


def ledger_tail(rows: DataFrame, owner: str, marker: Column | None = None) -> DataFrame:
    """ST01. Rows of other writers after the marker. The source's offsets move only as far as the sink has written."""
    out = rows.filter(F.col("agent").isNotNull() & (F.col("agent") != owner))
    return out if marker is None else out.filter(F.col("ts") > marker)


def current_value_stream(rows: DataFrame, key: str, value: str) -> DataFrame:
    """ST02. Newest value per key; the state is one row per key."""
    return rows.groupBy(key).agg(F.max_by(F.struct("id", value), F.struct("ts", "id")).alias("_v")).select(key, F.col("_v.id").alias("id"), F.col(f"_v.{value}").alias(value))


def usage_rollup_stream(usage: DataFrame, keys: list[str], late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """ST03. Token and cost totals per window and key; the watermark closes windows and frees their state."""
    u = usage.withWatermark("ts", late) if usage.isStreaming else usage
    g = u.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("requests"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "tokens_in", "tokens_out", "cost_usd", "requests")


def freshness_stream(events: DataFrame, stream: str, slo: DataFrame, as_of: str | None = None) -> DataFrame:
    """ST04. (stream, newest, state, max_age_ms, at) whenever the state of a declared stream is found out: with its events, and, without any, by a
    timer as soon as the newest is older than the stream's ``max_age_h``. The newest row of a stream is its state.

    ``slo`` has one row (stream, max_age_h) for each declared stream; events of others are dropped. With ``as_of`` (UTC) a history is judged at that time, without timers.
    """
    allowed = slo.select(F.col(stream).alias("_s"), F.round(F.col("max_age_h") * 3_600_000).cast("long").alias("max_age_ms"))
    e = events.select(F.col(stream).alias("stream_"), "ts").join(allowed, F.col("stream_") == F.col("_s")).select("stream_", "ts", "max_age_ms")
    replay = None if as_of is None else int(dt.datetime.fromisoformat(as_of).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    schema = f"stream {dict(events.dtypes)[stream]}, newest timestamp, state string, max_age_ms long, at timestamp"
    return e.groupBy("stream_").transformWithStateInPandas(Freshness(replay), schema, "Update", "None" if replay is not None else "ProcessingTime").withColumnRenamed("stream", stream)


def freshness_table(states: DataFrame, slo: DataFrame, stream: str, now: Column) -> DataFrame:
    """ST04. State, age and allowed age of every declared stream from the newest rows of ``freshness_stream``; NO_DATA where there was none."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("newest")) / 3.6e9
    return slo.join(states.select(stream, "newest", "state"), stream, "left").select(stream, F.coalesce("state", F.lit("NO_DATA")).alias("state"), F.round(age, 1).alias("age_h"), "max_age_h")


def burn_rate_stream(events: DataFrame, error: Column, slo: float, window: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """ST07. Error ratio over the budget in sliding windows."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(error).alias("bad"))
    return g.select(F.col("w.end").alias("window_end"), "n", "bad", (F.col("bad") / F.col("n") / (1 - slo)).alias("burn"))


def safety_alerts(messages: DataFrame, roles: list[str], late: str = "7 days") -> DataFrame:
    """ST08. Matching customer messages, each delivered message once within the watermark."""
    m = messages.filter(F.col("role").isin(*roles)).withColumn("_body", strip_html(F.col("text")))
    if m.isStreaming:
        m = m.withWatermark("ts", late).dropDuplicatesWithinWatermark(["conv_id", "turn"])
    else:
        m = m.dropDuplicates(["conv_id", "turn"])
    hit = safety_classify(m, "_body").filter("matched")
    return hit.select("conv_id", "turn", "ts", F.array_join(F.transform("matches", lambda x: x["id"]), ",").alias("rules"))


def safety_stream(messages: DataFrame, roles: list[str], folder: str, late: str = "7 days") -> tuple[DataFrame, DataFrame]:
    """ST08. (alerts, tagged conversations). A conversation gives one alert: its first matching message of the first batch with any. A batch writes its
    alerts before its tags: after a failure in between the alert comes again, it is never lost."""
    alerts = safety_alerts(messages, roles, late)
    spark, schema = messages.sparkSession, alerts.schema
    spark.createDataFrame([], "conv_id long").write.mode("overwrite").parquet(f"{folder}/tags/batch=-1")

    def write(batch: DataFrame, no: int) -> None:
        tagged = spark.read.schema("conv_id long, batch long").parquet(f"{folder}/tags").filter(F.col("batch") < no).select("conv_id").distinct()
        new = batch.join(tagged, "conv_id", "left_anti").select(*batch.columns)
        # Of the matching messages of a conversation in one batch the first gives the alert.
        rest = [c for c in new.columns if c != "conv_id"]
        first = new.groupBy("conv_id").agg(F.min_by(F.struct(*rest), F.struct("ts", "turn")).alias("_f")).select("conv_id", "_f.*").select(*new.columns)
        first.write.mode("overwrite").parquet(f"{folder}/alerts/batch={no}")
        done = spark.read.schema(schema).parquet(f"{folder}/alerts/batch={no}")
        done.select("conv_id").distinct().write.mode("overwrite").parquet(f"{folder}/tags/batch={no}")

    each_batch(alerts, folder, write)
    return spark.read.schema(schema).parquet(f"{folder}/alerts/*"), spark.read.schema("conv_id long").parquet(f"{folder}/tags/*").distinct()


def idempotent_append(rows: DataFrame, key: str, intent: list[str]) -> DataFrame:
    """ST11. The first row per key stands; the same key with the same intent repeats it, with another intent it is a conflict.

    The hash extremes differ exactly when more than one intent came, so the state per key stays one row.
    """
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in intent]), 256)
    r = rows.withColumn("_h", h)
    g = r.groupBy(key).agg(F.min_by(F.struct("id", "ts"), F.struct("ts", "id")).alias("_first"), F.count("*").alias("attempts"), F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    return g.select(key, F.col("_first.id").alias("id"), "attempts", (F.col("_a") != F.col("_b")).alias("conflict"))


# Incremental index ---------------------------------------------------------------------------------------------------

_HEADS = "path STRING, sha256 STRING, chunks LONG, version LONG"
_CHUNKS = "chunk_id STRING, parent_id STRING, source_path STRING, title STRING, ordinal INT, chunk STRING, content_hash STRING, entity STRING, word_count INT, path STRING"


def incremental_index(docs: DataFrame, folder: str, store: str = "store/room") -> tuple[DataFrame, DataFrame]:
    """ST09. (current heads, current chunks). Only documents whose hash is not the current head's are chunked.

    A batch writes its chunks and then its heads under its own number. The current state is the newest head per path and
    the chunks that carry its hash, so the chunks of a document that shrank are gone as soon as its new head is there.
    """
    spark: SparkSession = docs.sparkSession

    def heads(before: int | None = None) -> DataFrame:
        h = spark.read.schema(_HEADS).parquet(f"{folder}/heads/*")
        return latest_by(h if before is None else h.filter(F.col("version") < before), ["path"], ["version"])

    def write(batch: DataFrame, no: int) -> None:
        b = latest_by(batch, ["path"], ["ts"]) if "ts" in batch.columns else batch.dropDuplicates(["path"])
        if no > 0:
            b = b.join(heads(no).select("path", "sha256"), ["path", "sha256"], "left_anti")
        chunk_rows(b.select("path", "sha256", "entity", "text"), store).write.mode("overwrite").parquet(f"{folder}/chunks/batch={no}")
        n = spark.read.schema(_CHUNKS).parquet(f"{folder}/chunks/batch={no}").groupBy("parent_id").agg(F.count("*").alias("chunks"))
        h = b.select("path", "sha256", F.sha1("path").alias("parent_id")).join(n, "parent_id", "left")
        h.select("path", "sha256", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.lit(no).cast("long").alias("version")).write.mode("overwrite").parquet(f"{folder}/heads/batch={no}")

    each_batch(docs, folder, write)
    now = heads()
    chunks = spark.read.schema(_CHUNKS).parquet(f"{folder}/chunks/*").dropDuplicates(["chunk_id", "content_hash"])
    live = chunks.join(now.select(F.sha1("path").alias("parent_id"), F.col("sha256").alias("content_hash")), ["parent_id", "content_hash"], "left_semi")
    return now, live


# State machines ------------------------------------------------------------------------------------------------------

NEVER = -1


def cooldown_step(wait_us: int, escalate_after: int):
    """(last firing, firings) and a signal: fired and its number, or nothing during the cooldown."""
    def step(state, t, _):
        last, n = state
        if last != NEVER and t - last < wait_us:
            return state, None
        return (t, n + 1), (n + 1, n + 1 >= escalate_after)
    return step


def streak_step(wait_us: int, need: int, escalate_after: int):
    """(streak, sent, last sent) and a scan: the streak, whether help is sent, whether it escalates."""
    def step(state, t, dark):
        streak, sent, last = state
        streak = streak + 1 if dark else 0
        go = bool(dark) and streak >= need and (last == NEVER or t - last >= wait_us)
        sent = sent + go if dark else 0
        return (streak, sent, t if go else last), (streak, go, bool(dark) and sent >= escalate_after)
    return step


def restart_step(wait_us: int, escalate_after: int):
    """(last restart, restarts, paused) and a failure: restart, cooldown, escalate once, then paused."""
    def step(state, t, _):
        last, tries, paused = state
        if paused:
            return state, ("paused", tries)
        if last != NEVER and t - last < wait_us:
            return state, ("cooldown", tries)
        if tries + 1 > escalate_after:
            return (last, tries, True), ("escalate", tries)
        return (t, tries + 1, False), ("restart", tries + 1)
    return step


def alert_cooldown(signals: DataFrame, key: str, cooldown_min: int = 360, escalate_after: int = 3, late: str = "1 hour", ttl_days: float = 30, slot_minutes: int = 60, close: DataFrame | None = None) -> DataFrame:
    """ST05. Fired signals: the first, and each one that comes when the last firing is at least the cooldown old."""
    return in_order(signals, key, None, cooldown_step(cooldown_min * 60_000_000, escalate_after), (NEVER, 0), "last long, n long", "consecutive long, escalate boolean", late, slot_minutes, ttl_days, close)


def dark_streak(scans: DataFrame, key: str, need: int = 2, cooldown_min: int = 360, escalate_after: int = 3, late: str = "1 hour", ttl_days: float = 30, slot_minutes: int = 60, close: DataFrame | None = None) -> DataFrame:
    """ST06. Per scan the streak of dark readings, whether help is sent, and whether it escalates. ``scans`` has (key, id, ts, dark)."""
    return in_order(scans, key, "dark", streak_step(cooldown_min * 60_000_000, need, escalate_after), (0, 0, NEVER), "streak long, sent long, last long", "streak long, dispatch boolean, escalate boolean", late, slot_minutes, ttl_days, close).drop("ts")


def restart_plan(failures: DataFrame, key: str, cooldown_min: int = 360, escalate_after: int = 3, late: str = "1 hour", ttl_days: float = 30, slot_minutes: int = 60, close: DataFrame | None = None) -> DataFrame:
    """ST10. Plan per failure: restart, cooldown, escalate once after the allowed attempts, then paused."""
    return in_order(failures, key, None, restart_step(cooldown_min * 60_000_000, escalate_after), (NEVER, 0, False), "last long, tries long, paused boolean", "plan string, attempt long", late, slot_minutes, ttl_days, close).drop("ts")
