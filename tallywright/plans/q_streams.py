"""Queries over streams: the tables as a file source, run over what is available."""
from pyspark.sql import functions as F

from tallywright.plans.q_privacy import _IDS2, _M2, _PLAIN, _SAFETY
from tallywright.plans.registry import query
from tallywright.plans.tables import NOW_E, NOW_EVENTS, Tables, ts
from tallywright.streaming import jobs, runner


FILES = 8  # files in a micro-batch


def events(t: Tables):
    e = runner.event_time(runner.stream_table(t.spark, t.dir, "events.parquet", FILES))
    return e.withColumn("agent", F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string"))).withColumn("id", F.col("event_id"))


def folder(t: Tables, name: str) -> str:
    return runner.work_folder(t.spark, name)


@query("st01_ledger_tail", "SELECT event_id AS id, 'a' || (user_id % 7) AS agent FROM events WHERE user_id % 7 <> 2 AND ts > TIMESTAMP '2024-01-20'")
def _(t):
    tail = jobs.ledger_tail(events(t), "a2", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return runner.append_to_table(tail.select("id", "agent"), folder(t, "st01"))


@query("st02_current_value_stream", "SELECT user_id % 20 AS ekey, event_id AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    cur = jobs.current_value_stream(events(t).withColumn("ekey", F.col("user_id") % 20), "ekey", "value")
    return runner.update_to_table(cur, ["ekey"], folder(t, "st02"))


@query("st03_usage_rollup_stream", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS kind, CAST(sum(event_id % 100) AS BIGINT) AS tokens_in, CAST(sum(event_id % 50) AS BIGINT) AS tokens_out, round(sum(value), 2) AS cost_usd, count(*) AS requests FROM events GROUP BY 1, 2""")
def _(t):
    u = events(t).select("ts", F.col("event_type").alias("kind"), (F.col("event_id") % 100).alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"), F.col("value").alias("cost_usd"))
    r = runner.update_to_table(jobs.usage_rollup_stream(u, ["kind"]), ["window_start", "kind"], folder(t, "st03"))
    return r.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "kind", "tokens_in", "tokens_out", F.round("cost_usd", 2).alias("cost_usd"), "requests")


@query("st04_freshness_stream", f"SELECT event_type AS stream, CASE WHEN (epoch_us({NOW_E}) - epoch_us(max(ts))) / 3.6e9 <= 24.2 THEN 'FRESH' ELSE 'STALE' END AS state, round((epoch_us({NOW_E}) - epoch_us(max(ts))) / 3.6e9, 1) AS age_h, CAST(24.2 AS DOUBLE) AS max_age_h FROM events GROUP BY event_type")
def _(t):
    slo = t.events.select(F.col("event_type").alias("stream")).distinct().withColumn("max_age_h", F.lit(24.2))
    states = jobs.freshness_stream(events(t).withColumnRenamed("event_type", "stream"), "stream", slo, as_of=NOW_EVENTS)
    with runner.keyed_state(t.spark):
        newest = runner.update_to_table(states, ["stream"], folder(t, "st04"))
    return jobs.freshness_table(newest, slo, "stream", ts(NOW_EVENTS))


_ERRORS = "e AS (SELECT user_id, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error')"


@query("st05_alert_cooldown", f"""WITH RECURSIVE {_ERRORS}, w AS (SELECT user_id, id, rn, ts AS last, CAST(1 AS BIGINT) AS n, true AS fire FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.id, e.rn, CASE WHEN e.ts - w.last >= INTERVAL 1440 MINUTE THEN e.ts ELSE w.last END, w.n + CASE WHEN e.ts - w.last >= INTERVAL 1440 MINUTE THEN 1 ELSE 0 END, e.ts - w.last >= INTERVAL 1440 MINUTE
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1) SELECT user_id, id, n AS consecutive, n >= 3 AS escalate FROM w WHERE fire""")
def _(t):
    s = events(t).filter("event_type = 'error'").select("user_id", "id", "ts")
    return runner.to_the_end(lambda close: jobs.alert_cooldown(s, "user_id", 1440, close=close), t.spark, folder(t, "st05")).select("user_id", "id", "consecutive", "escalate")


@query("st06_dark_streak", """WITH a AS (SELECT agent, event_id AS id, event_type = 'error' AS dark, row_number() OVER w AS rn, ts FROM (SELECT 'a' || (user_id % 7) AS agent, event_id, event_type, ts FROM events) WINDOW w AS (PARTITION BY agent ORDER BY ts, event_id)),
b AS (SELECT *, max(CASE WHEN NOT dark THEN rn END) OVER (PARTITION BY agent ORDER BY rn) AS lastok FROM a) SELECT agent, id, CASE WHEN dark THEN rn - coalesce(lastok, 0) ELSE 0 END AS streak FROM b""")
def _(t):
    s = events(t).select("agent", "id", "ts", (F.col("event_type") == "error").alias("dark"))
    return runner.to_the_end(lambda close: jobs.dark_streak(s, "agent", close=close), t.spark, folder(t, "st06")).select("agent", "id", "streak")


@query("st07_burn_rate_stream", """WITH b AS (SELECT epoch_us(ts) // 300000000 AS s, event_type = 'error' AS bad FROM events), x AS (SELECT (s + i + 1) * 300 AS e, bad FROM b, range(12) r(i))
SELECT strftime(make_timestamp(e * 1000000), '%Y-%m-%d %H:%M') AS window_end, count(*) AS n, count(*) FILTER (bad) AS bad, round(count(*) FILTER (bad) / count(*) / 0.05, 6) AS burn FROM x GROUP BY e""")
def _(t):
    b = jobs.burn_rate_stream(events(t), F.col("event_type") == "error", 0.95)
    r = runner.update_to_table(b, ["window_end"], folder(t, "st07"))
    return r.select(F.date_format("window_end", "yyyy-MM-dd HH:mm").alias("window_end"), "n", "bad", F.round("burn", 6).alias("burn"))


def messages(t: Tables):
    """Conversation turns as a stream; every message comes twice."""
    c = runner.stream_table(t.spark, t.dir, "conversations.parquet", FILES)
    m, head = (F.col("conv_id") + F.col("turn")) % 5, None
    for i, s in enumerate(_SAFETY):
        head = F.when(m == i, s) if head is None else head.when(m == i, s)
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    return c.select("conv_id", "turn", "role", F.concat(head, "text").alias("text"), stamp.alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))


@query("st08_safety_stream", f"""WITH p AS (SELECT conv_id, turn, {_PLAIN} AS t FROM conversations WHERE role = 'user'), x AS (SELECT conv_id, turn, {_M2} AS m FROM p) SELECT conv_id, turn, {_IDS2} AS rules FROM x WHERE {_IDS2} <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def _(t):
    # The files of a stored table come in any order, so no message of it is late: a minute for each conversation number.
    span = t.conversations.agg((F.max("conv_id") - F.min("conv_id")).alias("n")).first()["n"] or 0
    return jobs.safety_stream(messages(t), ["user"], folder(t, "st08"), f"{7 * 1440 + span} minutes")[0].select("conv_id", "turn", "rules")


@query("st09_incremental_index", "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def _(t):
    d = runner.stream_table(t.spark, t.dir, "documents.parquet", FILES)
    d = d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("entity"), "text")
    return jobs.incremental_index(d, folder(t, "st09"))[0].select("path", "sha256")


@query("st10_restart_plan", f"""WITH RECURSIVE {_ERRORS}, w AS (SELECT user_id, id, rn, ts AS last, CAST(1 AS BIGINT) AS n, false AS paused, 'restart' AS plan FROM e WHERE rn = 1
  UNION ALL SELECT user_id, id, rn, CASE WHEN p = 'restart' THEN ts ELSE last END, n + CASE WHEN p = 'restart' THEN 1 ELSE 0 END, paused OR p = 'escalate', p FROM (
    SELECT e.user_id, e.id, e.rn, e.ts, w.last, w.n, w.paused, CASE WHEN w.paused THEN 'paused' WHEN e.ts - w.last < INTERVAL 1440 MINUTE THEN 'cooldown' WHEN w.n + 1 > 3 THEN 'escalate' ELSE 'restart' END AS p
    FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)) SELECT user_id AS job, id, plan, n AS attempt FROM w""")
def _(t):
    s = events(t).filter("event_type = 'error'").select(F.col("user_id").alias("job"), "id", "ts")
    return runner.to_the_end(lambda close: jobs.restart_plan(s, "job", 1440, close=close), t.spark, folder(t, "st10"))


@query("st11_idempotent_append", "SELECT k AS key, arg_min(event_id, (ts, event_id)) AS id, count(*) AS attempts, count(DISTINCT event_type) > 1 AS conflict FROM (SELECT *, 'op' || (event_id % 4000) AS k FROM events) GROUP BY k")
def _(t):
    e = events(t).withColumn("key", F.concat(F.lit("op"), (F.col("event_id") % 4000).cast("string")))
    return runner.update_to_table(jobs.idempotent_append(e, "key", ["event_type"]), ["key"], folder(t, "st11"))
