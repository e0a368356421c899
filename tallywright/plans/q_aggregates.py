"""Queries over aggregates, windows, top-k and set operations."""
from pyspark.sql import functions as F

from tallywright.operators import aggregates as ag, filters as flt, setops as so, topk as tk, windows as wn
from tallywright.plans.registry import query
from tallywright.plans.tables import BARS, CATALOG, DOC_LEDGER, LEDGER, Tables, ts

_WHY = """CASE WHEN NOT sidecar THEN 'missing_sidecar_claim' WHEN NOT enriched THEN 'missing_enrichment_claim'
  WHEN enriched_sha256 IS DISTINCT FROM sha256 THEN 'missing_matching_enrichment_hash' WHEN coalesce(err, '') <> '' THEN 'source_error' END"""


@query("ag01_catalog_status", f"""WITH {CATALOG}, d AS (
  SELECT 'lang' AS dim, lang AS value, * FROM catalog UNION ALL SELECT 'entity', entity, * FROM catalog UNION ALL SELECT 'all', 'all', * FROM catalog)
SELECT dim, value, count(*) AS rows, count(*) FILTER (err IS NOT NULL) AS errors, count(*) FILTER (enriched) AS enriched, count(*) FILTER (sidecar) AS sidecars FROM d GROUP BY dim, value""")
def _(t):
    return ag.catalog_status(t.catalog, ["lang", "entity"], {
        "errors": F.col("err").isNotNull(), "enriched": F.col("enriched"), "sidecars": F.col("sidecar")})


def _doubled(t: Tables):
    """The catalog with every fourth row written twice."""
    return t.catalog.unionByName(t.catalog.filter("doc_id % 4 = 0"))


_DOUBLED = f"{CATALOG}, r AS (SELECT *, {_WHY} AS why FROM (SELECT * FROM catalog UNION ALL SELECT * FROM catalog WHERE doc_id % 4 = 0))"


@query("ag02_materialize_counts", f"""WITH {_DOUBLED} SELECT *, source_rows = eligible_rows + duplicate_rows + excluded_rows AS conserved FROM (
  SELECT count(*) AS source_rows, count(DISTINCT CASE WHEN why IS NULL THEN path END) AS eligible_rows,
    count(*) FILTER (why IS NULL) - count(DISTINCT CASE WHEN why IS NULL THEN path END) AS duplicate_rows, count(why) AS excluded_rows FROM r)""")
def _(t):
    return ag.materialize_counts(_doubled(t), flt.exclusion_reason(None))


@query("ag02_excluded_counts", f"WITH {_DOUBLED} SELECT why AS reason, count(*) AS n FROM r WHERE why IS NOT NULL GROUP BY why")
def _(t):
    return ag.excluded_counts(_doubled(t), flt.exclusion_reason(None))


@query("ag03_field_census", f"""WITH {LEDGER}, c AS (SELECT count(*) AS rows, count(id) AS i, count(supersedes) AS s, count(ekey) AS e, count(agent) AS a FROM ledger)
SELECT rows, 'field' AS kind, 'id' AS name, i AS present, i AS filled FROM c UNION ALL SELECT rows, 'field', 'supersedes', s, s FROM c
UNION ALL SELECT rows, 'field', 'ekey', e, e FROM c UNION ALL SELECT rows, 'field', 'ts', rows, 0 FROM c UNION ALL SELECT rows, 'scope', 'chain', s, s FROM c UNION ALL SELECT rows, 'scope', 'key', e, e FROM c""")
def _(t):
    return ag.field_census(t.ledger, ["id", "supersedes", "ekey", "ts"], {"chain": ["id", "supersedes"], "key": ["ekey", "agent"]})


@query("ag04_usage_rollup", """SELECT p_type AS model, p_brand AS caller, l_returnflag AS kind, sum(l_quantity) AS tokens_in, sum(l_linenumber) AS tokens_out,
  round(sum(l_quantity * p_retailprice), 2) AS cost_usd, count(*) AS requests FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""".replace("sum(l_linenumber)", "CAST(sum(l_linenumber) AS BIGINT)"))
def _(t):
    u = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("model"), F.col("p_brand").alias("caller"), F.col("l_returnflag").alias("kind"), "l_quantity",
        F.col("l_linenumber").cast("long").alias("o"), (F.col("l_quantity") * F.col("p_retailprice")).alias("c"))
    return ag.usage_rollup(u, ["model", "caller", "kind"], "l_quantity", "o", "c").withColumn("cost_usd", F.round("cost_usd", 2))


@query("ag05_session_telemetry", """WITH t AS (SELECT user_id AS session, ts, event_type <> 'view' AS a, CASE event_id % 3 WHEN 0 THEN 'opus-x' WHEN 1 THEN 'haiku-y' ELSE 'other' END AS model,
    event_type = 'click' AS tool, event_type = 'error' AS err, event_id % 100 AS i, event_id % 50 AS o FROM events),
m AS (SELECT session, model, count(*) AS n, min(ts) AS f FROM t WHERE a GROUP BY ALL),
w AS (SELECT session, model FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, f) AS r FROM m) WHERE r = 1),
s AS (SELECT session, count(*) FILTER (a) AS turns, count(*) FILTER (tool) AS tool_calls, count(*) FILTER (err) AS errors,
    CAST(sum(CASE WHEN a THEN i ELSE 0 END) AS BIGINT) AS tok_in, CAST(sum(CASE WHEN a THEN o ELSE 0 END) AS BIGINT) AS tok_out, min(ts) AS f, max(ts) AS l FROM t GROUP BY session)
SELECT s.session, coalesce(w.model, 'unknown') AS model, turns, tool_calls, errors, tok_in, tok_out,
  round((tok_in * CASE WHEN w.model LIKE 'opus%' THEN 15.0 WHEN w.model LIKE 'haiku%' THEN 0.8 ELSE 3.0 END + tok_out * CASE WHEN w.model LIKE 'opus%' THEN 75.0 WHEN w.model LIKE 'haiku%' THEN 4.0 ELSE 15.0 END)::DOUBLE, 3) AS cost_micro,
  (epoch_us(l) - epoch_us(f)) // 1000 AS duration_ms FROM s LEFT JOIN w ON s.session = w.session""")
def _(t):
    e, et, m = t.events, F.col("event_type"), F.col("event_id") % 3
    turns = e.select(F.col("user_id").alias("session"), "ts", F.when(et == "view", "user").otherwise("assistant").alias("role"),
                     F.when(m == 0, "opus-x").when(m == 1, "haiku-y").otherwise("other").alias("model"), F.when(et == "click", "t").alias("tool"),
                     (et == "error").alias("is_error"), (F.col("event_id") % 100).alias("tok_in"), (F.col("event_id") % 50).alias("tok_out"),
                     F.lit(0).cast("long").alias("tok_cache_write"), F.lit(0).cast("long").alias("tok_cache_read"))
    s = ag.session_telemetry(turns)
    return s.select("session", "model", "turns", "tool_calls", "errors", "tok_in", "tok_out", F.round(F.col("cost_usd") * 1e6, 3).alias("cost_micro"), "duration_ms")


_DUP_SQL = f"WITH {DOC_LEDGER}"


@query("ag06_duplicate_census", f"""{_DUP_SQL} SELECT md5(text) AS ref, count(*) AS count, min(doc_id) AS first_id,
  array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ',') AS write_days, count(*) - 1 AS phantom FROM doc_ledger GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return ag.duplicate_census(t.doc_ledger.withColumn("ref", F.md5("text")), "ref", "doc_id", "ts")


@query("ag06_duplicate_members", "SELECT md5(text) AS ref, doc_id, count(*) OVER (PARTITION BY md5(text)) AS count FROM documents QUALIFY count >= 2".replace("AS count FROM", "AS \"count\" FROM").replace("QUALIFY count", "QUALIFY \"count\""))
def _(t):
    return ag.duplicate_members(t.documents.withColumn("ref", F.md5("text")), "ref", ["doc_id"])


@query("ag09_severity_tally", "SELECT p AS severity, (SELECT count(*) FROM orders WHERE o_orderpriority = p AND o_orderstatus = 'O' AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)) AS n FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def _(t):
    mean = t.orders.agg(F.avg("o_totalprice")).scalar()
    f = t.orders.select(F.col("o_orderpriority").alias("severity"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > mean), "open").otherwise("closed").alias("status"))
    return ag.severity_tally(f, f.select("severity").distinct())


@query("ag10_arg_max_status", "SELECT user_id, arg_max(event_type, (ts, event_type, value)) AS event_type, arg_max(value, (ts, event_type, value)) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events WHERE ts > TIMESTAMP '2024-01-20' GROUP BY user_id")
def _(t):
    r = ag.arg_max_status(t.events, "user_id", ["event_type", "value"], since=ts("2024-01-20 00:00:00"))
    return r.withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@query("ag11_activity_funnel", "SELECT count(*) AS events, count(DISTINCT user_id) AS actives FROM events WHERE ts > TIMESTAMP '2024-01-25'")
def _(t):
    return ag.activity_funnel(t.events, ts("2024-01-25 00:00:00"), "user_id", "event_type")[0]


@query("ag11_activity_top_events", "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-25' GROUP BY 1 ORDER BY n DESC, event_type")
def _(t):
    return ag.activity_funnel(t.events, ts("2024-01-25 00:00:00"), "user_id", "event_type")[1]


@query("ag12_newest_and_count", "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10' GROUP BY 1")
def _(t):
    return ag.newest_and_count(t.events, "event_type", ts("2024-01-10 00:00:00")).withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


@query("ag13_latency_stats", """SELECT l_returnflag, n, round(mean, 4) AS mean, max(CASE WHEN r = n // 2 THEN v END) AS p50, max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) THEN v END) AS p95 FROM (
  SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS mean FROM lineitem) GROUP BY ALL""")
def _(t):
    s = ag.latency_stats(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95}, 1000.0)
    return s.withColumn("mean", F.round("mean", 4))


@query("ag14_oldest_and_count", "SELECT event_type, count(*) AS n, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(ts))) / 86400e6, 1) AS oldest_age_days FROM events GROUP BY 1")
def _(t):
    return ag.oldest_and_count(t.events, "event_type", "ts", ts("2024-02-01 00:00:00"))


@query("ag15_mean_ignoring_failures", "SELECT lang, round(coalesce(avg(CASE WHEN toxic = 0 THEN quality END), 0), 6) AS mean_rating, count(*) FILTER (toxic = 1) AS failures FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(t):
    l = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return ag.mean_ignoring_failures(l, ["lang"], F.col("quality"), F.col("toxic") == 1).withColumn("mean_rating", F.round("mean_rating", 6))


@query("ag16_having_after_filter", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 5")
def _(t):
    return ag.having_after_filter(t.orders, F.col("o_orderstatus") == "F", "o_custkey", 5)


@query("ag17_approx_row_count", "SELECT count(*) AS estimate, CAST(0 AS DOUBLE) AS rsd FROM orders")
def _(t):
    return ag.approx_row_count(t.orders)


@query("ag18_user_order_summary", """SELECT c_custkey, c_name, count(o_orderkey) AS total_orders, round(sum(o_totalprice), 2) AS total_spent, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    s = ag.user_order_summary(t.customer, t.orders)
    return s.withColumn("total_spent", F.round("total_spent", 2)).withColumn("last_order", F.date_format("last_order", "yyyy-MM-dd"))


@query("ag19_tool_counts_map", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tools FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    m = ag.tool_counts_map(t.events, "user_id", "event_type")
    pairs = F.transform(F.map_entries("tools"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("user_id", F.array_join(F.array_sort(pairs), ",").alias("tools"))


@query("ag20_coverage_report", f"WITH {CATALOG} SELECT entity, count(*) AS catalog_rows, count(*) FILTER (w IS NULL) AS eligible, count(w) AS excluded, true AS conserved FROM (SELECT *, {_WHY} AS w FROM catalog) GROUP BY entity")
def _(t):
    return ag.coverage_report(t.catalog, "entity", flt.exclusion_reason(None))


@query("wn01_latest_per_key", f"WITH {LEDGER} SELECT ekey, id, type FROM ledger QUALIFY row_number() OVER (PARTITION BY ekey ORDER BY ts DESC, id DESC) = 1")
def _(t):
    return wn.latest_per_key(t.ledger, ["ekey"]).select("ekey", "id", "type")


@query("wn02_fork_detection", f"""WITH {LEDGER} SELECT type, ekey, count(*) AS rows, bool_or(p IS NOT NULL AND supersedes IS DISTINCT FROM p) AS forked FROM (
  SELECT *, lag(id) OVER (PARTITION BY type, ekey ORDER BY ts, id) AS p FROM ledger) GROUP BY type, ekey""")
def _(t):
    return wn.fork_detection(t.ledger)


@query("wn03_last_two_runs_drop", """SELECT user_id, event_type, a AS latest_score, b AS prior_score, round(b - a, 6) AS "drop" FROM (
  SELECT user_id, event_type, max(CASE WHEN r = 1 THEN value END) AS a, max(CASE WHEN r = 2 THEN value END) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r <= 2 GROUP BY 1, 2) WHERE b - a >= 10""")
def _(t):
    d = wn.last_two_runs_drop(t.events, ["user_id", "event_type"], "value", "ts", 10)
    return d.withColumn("drop", F.round("drop", 6))


@query("wn04_weekly_spike", """WITH d AS (SELECT user_id % 5 AS project, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' AND (user_id % 5 <> 2 OR ts >= TIMESTAMP '2024-01-24') GROUP BY 1, 2),
w AS (SELECT project, CAST(sum(CASE WHEN day > DATE '2024-01-23' THEN n ELSE 0 END) AS BIGINT) AS t, sum(CASE WHEN day > DATE '2024-01-16' AND day <= DATE '2024-01-23' THEN n ELSE 0 END) AS a,
  sum(CASE WHEN day > DATE '2024-01-09' AND day <= DATE '2024-01-16' THEN n ELSE 0 END) AS b, sum(CASE WHEN day > DATE '2024-01-02' AND day <= DATE '2024-01-09' THEN n ELSE 0 END) AS c,
  date_diff('day', min(day), DATE '2024-01-30') + 1 AS h FROM d GROUP BY project),
m AS (SELECT *, CAST(a + b + c - greatest(a, b, c) - least(a, b, c) AS DOUBLE) AS base FROM w)
SELECT project, t AS this_week, base AS baseline, round(CASE WHEN base > 0 THEN t / base END, 6) AS ratio, h >= 28 AND t >= 5 AND (base = 0 OR t / base >= 1.05) AS spike,
  CASE WHEN h < 28 THEN 'insufficient history' WHEN t < 5 THEN 'below floor' WHEN base = 0 THEN 'new source' WHEN t / base >= 1.05 THEN 'above ratio' ELSE 'normal' END AS reason FROM m""")
def _(t):
    e = t.events.filter((F.col("event_type") == "error") & ((F.col("user_id") % 5 != 2) | (F.col("ts") >= ts("2024-01-24 00:00:00"))))
    d = e.groupBy((F.col("user_id") % 5).alias("project"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return wn.weekly_spike(d, "project", F.lit("2024-01-30").cast("date"), ratio=1.05).withColumn("ratio", F.round("ratio", 6))


SPLITS = [("1996-06-01", 1.0, 4.0), ("1998-03-15", 1.0, 2.0), ("2000-01-10", 3.0, 1.0)]
SPLIT_SQL = """(CASE WHEN DATE '1996-06-01' > date THEN 0.25 ELSE 1 END * CASE WHEN DATE '1998-03-15' > date THEN 0.5 ELSE 1 END * CASE WHEN DATE '2000-01-10' > date THEN 3 ELSE 1 END)::DOUBLE"""


@query("wn05_split_factor", f"WITH {BARS} SELECT CAST(date AS VARCHAR) AS date, {SPLIT_SQL} AS factor FROM bars")
def _(t):
    return t.daily_bars.select(F.col("date").cast("string").alias("date"), wn.split_factor(F.col("date"), SPLITS).alias("factor"))


@query("wn06_daily_change", f"""WITH {BARS}, a AS (SELECT *, close * {SPLIT_SQL} AS adj FROM bars), p AS (SELECT *, lag(adj) OVER (ORDER BY date) AS prev FROM a)
SELECT CAST(date AS VARCHAR) AS date, round(adj, 6) AS split_adj_close, round(adj - prev, 6) AS change, round((adj - prev) / prev * 100, 4) AS change_pct,
  round(high - low, 4) AS range, round((high + low + close) / 3, 4) AS vwap, round(close * volume, 2) AS dollar_volume, round((high + low + close) / 3 * volume, 2) AS traded_value FROM p""")
def _(t):
    d = wn.daily_change(t.daily_bars, SPLITS)
    return d.select(F.col("date").cast("string").alias("date"), *[F.round(c, 6 if c in ("split_adj_close", "change") else 4).alias(c) for c in ("split_adj_close", "change", "change_pct", "range", "vwap")],
                    F.round("dollar_volume", 2).alias("dollar_volume"), F.round("traded_value", 2).alias("traded_value"))


@query("wn07_mrr_growth", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS mrr FROM orders GROUP BY 1)
SELECT month, round(mrr, 2) AS mrr, round(lag(mrr) OVER (ORDER BY month), 2) AS prev_mrr, round((mrr - lag(mrr) OVER (ORDER BY month)) / lag(mrr) OVER (ORDER BY month) * 100, 4) AS growth_pct FROM m""")
def _(t):
    m = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("mrr"))
    g = wn.mrr_growth(m)
    return g.select("month", F.round("mrr", 2).alias("mrr"), F.round("prev_mrr", 2).alias("prev_mrr"), F.round("growth_pct", 4).alias("growth_pct"))


@query("wn08_rolling_anomaly", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, CAST(day AS VARCHAR) AS day, n, round(avg(n) OVER w, 6) AS mean, round(stddev_samp(n) OVER w, 6) AS sd,
  count(n) OVER w >= 2 AND coalesce(abs(n - avg(n) OVER w) > 2 * stddev_samp(n) OVER w, false) AS anomaly
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def _(t):
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    r = wn.rolling_anomaly(d, ["event_type"], "n", 10)
    return r.select("event_type", F.col("day").cast("string").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "anomaly")


@query("wn09_partition_count", "SELECT DISTINCT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(t):
    return wn.partition_count(t.orders, ["o_custkey"])


_KEEP = f"""WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC) <= 5 OR ts >= TIMESTAMP '2024-01-29' AS stay FROM ledger)"""


@query("wn10_keep_recent_digest", _KEEP + " SELECT type, id FROM r WHERE stay")
def _(t):
    return wn.keep_recent_digest(t.ledger, 5, ts("2024-01-29 00:00:00"), ["type"])[0].select("type", "id")


@query("wn10_keep_recent_digest_rest", _KEEP + " SELECT type, count(*) AS count, strftime(min(ts), '%Y-%m-%d') AS start_date, strftime(max(ts), '%Y-%m-%d') AS end_date FROM r WHERE NOT stay GROUP BY type")
def _(t):
    return wn.keep_recent_digest(t.ledger, 5, ts("2024-01-29 00:00:00"), ["type"])[1]


@query("wn12_latest_per_agent", f"WITH {LEDGER} SELECT ekey, agent, id FROM ledger QUALIFY row_number() OVER (PARTITION BY ekey, agent ORDER BY ts DESC, id DESC) = 1")
def _(t):
    return wn.latest_per_agent(t.ledger, ["ekey"]).select("ekey", "agent", "id")


@query("wn13_consecutive_streak", """WITH a AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts, event_id) AS streak FROM a""")
def _(t):
    return wn.consecutive_streak(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "streak")


@query("wn14_latest_and_peak", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS mau FROM events GROUP BY 1, 2), l AS (SELECT max(day) AS m FROM d)
SELECT event_type, arg_max(mau, day) AS latest, max(mau) AS peak, round(sum(CASE WHEN day = m THEN mau ELSE 0 END) / (SELECT sum(mau) FROM d, l WHERE day = m), 6) AS last_day_share FROM d, l GROUP BY event_type""")
def _(t):
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("mau"))
    return wn.latest_and_peak(d, "event_type", "mau").withColumn("last_day_share", F.round("last_day_share", 6))


@query("wn15_daily_sequence_id", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS seq_id FROM (
  SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders)""")
def _(t):
    return wn.daily_sequence_id(t.orders, "o_orderdate", "o_orderkey", 4096).select("o_orderkey", "seq_id")


@query("wn16_collision_suffix", f"""WITH {CATALOG}, n AS (SELECT doc_id, sha256, entity || '/' || lang || '/doc.txt' AS target FROM catalog)
SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY target) THEN target ELSE replace(target, 'doc.txt', 'doc_' || substr(sha256, 1, 6) || '.txt') END AS new_path FROM n""")
def _(t):
    c = t.catalog.select("doc_id", "sha256", F.concat_ws("/", "entity", "lang", F.lit("doc.txt")).alias("target"))
    return wn.collision_suffix(c, "target", "doc_id", "sha256").select("doc_id", "new_path")


@query("wn17_assign_doc_ids", """WITH b AS (SELECT doc_id, text, source || '__p_' || (doc_id % 200) AS base FROM documents)
SELECT doc_id, CASE WHEN count(DISTINCT trim(text)) OVER (PARTITION BY base) < 2 THEN base ELSE base || '__' || substr(sha1(text), 1, 12) END AS doc_key FROM b""")
def _(t):
    d = t.documents.select("doc_id", "text", "source", F.concat(F.lit("p "), (F.col("doc_id") % 200).cast("string")).alias("pid"))
    return wn.assign_doc_ids(d, "source", "pid", "text").select("doc_id", "doc_key")


@query("tk01_order_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def _(t):
    return tk.order_limit(t.events.select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 25)


_TERMS = ["click", "bucket 7", "k11"]


@query("tk02_working_set_pack", f"""WITH {LEDGER}, act AS (SELECT * FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger x WHERE x.supersedes = l.id)),
pool AS (SELECT * FROM act WHERE type <> 'correction' UNION ALL SELECT * FROM ledger WHERE type = 'correction'),
always AS (SELECT id, type AS section FROM pool WHERE type IN ('pitfall', 'decision', 'correction', 'entity')
  QUALIFY row_number() OVER (PARTITION BY type ORDER BY ts DESC, id DESC) <= CASE type WHEN 'pitfall' THEN 12 WHEN 'decision' THEN 6 WHEN 'correction' THEN 5 ELSE 8 END),
best AS (SELECT id, 'ranked' AS section FROM (SELECT *, CAST(contains(text, 'click') AS INT) + CAST(contains(text, 'bucket 7') AS INT) + CAST(contains(text, 'k11') AS INT) AS s FROM act WHERE id NOT IN (SELECT id FROM always))
  WHERE s > 0 ORDER BY s DESC, ts DESC, id DESC LIMIT 6),
last AS (SELECT id, 'recent' AS section FROM act WHERE id NOT IN (SELECT id FROM always) AND id NOT IN (SELECT id FROM best) ORDER BY ts DESC, id DESC LIMIT 4)
SELECT * FROM always UNION ALL SELECT * FROM best UNION ALL SELECT * FROM last""")
def _(t):
    return tk.working_set_pack(t.ledger, _TERMS).select("id", "section")


@query("tk03_term_overlap_rank", f"""WITH {DOC_LEDGER} SELECT id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'ung') AS INT) AS score
FROM doc_ledger WHERE score > 0 ORDER BY score DESC, ts DESC, id DESC LIMIT 20""")
def _(t):
    return tk.term_overlap_rank(t.doc_ledger, tk.query_terms("What about the License tion, ung?"), 20).select("id", "score")


@query("tk04_keyset_page", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 7000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def _(t):
    p = tk.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", ("1998-06-01 00:00:00", 7000), 30)
    return p.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))


@query("tk05_sample_evenly", """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS c FROM documents)
SELECT doc_id, position FROM n WHERE position IN (SELECT (i * (SELECT max(c) FROM n)) // 37 FROM range(37) t(i))""")
def _(t):
    return tk.sample_evenly(t.documents.select("doc_id"), "doc_id", 37, 256)


@query("tk06_char_budget_pack", """WITH u AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, CAST(least(used, 600) AS BIGINT) AS used, length(substr(text, 1, 600)) AS len FROM u WHERE used <= 600 OR n = 1""")
def _(t):
    return tk.char_budget_pack(t.conversations, ["conv_id"], "turn", "text", 600, 2).select("conv_id", "turn", "used", F.length("text").alias("len"))


@query("tk07_bounded_batch", """WITH p AS (SELECT o_orderkey, o_custkey % 7 + 1 AS pages FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 500),
s AS (SELECT *, sum(pages) OVER (ORDER BY o_orderkey) AS used FROM p) SELECT o_orderkey, CAST(used AS BIGINT) AS pages_used FROM s WHERE used - pages < 1200""")
def _(t):
    p = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_custkey") % 7 + 1).alias("pages"))
    return tk.bounded_batch(p, "o_orderkey", "pages", 500, 1200, 512).select("o_orderkey", "pages_used")


@query("tk08_severity_order", "SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END AS severity_rank FROM events")
def _(t):
    return tk.severity_order(t.events, "event_type", {"error": 0, "purchase": 1, "signup": 2}).select("event_id", "severity_rank")


@query("tk09_head_tail_truncate", r"""WITH m AS (SELECT doc_id, text, length(text) AS n, chr(10) || '... [result-guard: truncated ' || (length(text) - 800) || ' of ' || length(text) || ' chars; re-query more narrowly for the omitted middle] ...' || chr(10) AS mk FROM documents),
b AS (SELECT *, 800 - length(mk) AS budget, CAST(floor((800 - length(mk)) * 0.7::DOUBLE) AS BIGINT) AS h FROM m)
SELECT doc_id, md5(CASE WHEN n <= 800 THEN text ELSE substr(text, 1, h) || mk || substr(text, n - (budget - h) + 1) END) AS cut_md5 FROM b""")
def _(t):
    return t.documents.select("doc_id", F.md5(tk.head_tail(F.col("text"), 800)).alias("cut_md5"))


@query("tk10_latest_snapshot_rows", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y') = (SELECT max(strftime(o_orderdate, '%Y')) FROM orders) AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("snap"), F.when(F.col("o_orderstatus") != "P", "x").alias("digest"))
    return tk.latest_snapshot_rows(o, "snap", "o_orderpriority", "1-URGENT", "digest").select("o_orderkey")


@query("so01_union_feeds", f"""WITH {LEDGER} SELECT id, agent, type FROM ledger l WHERE type IN ('fact', 'decision', 'correction', 'pitfall') AND agent <> 'a2' AND NOT EXISTS (SELECT 1 FROM ledger x WHERE x.supersedes = l.id)
UNION ALL SELECT conv_id || '-' || turn, lower(role), 'fact' FROM conversations WHERE coalesce(text, '') <> ''""")
def _(t):
    a = t.ledger.select("id", "agent", "type", "text", "ts", "supersedes", F.lit("ledger").alias("source"))
    b = t.conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.upper("role").alias("agent"),
                               F.lit("fact").alias("type"), "text", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("supersedes"), F.lit("chat").alias("source"))
    return so.union_feeds(a, b, F.col("agent") == "a2").select("id", "agent", "type")


@query("so02_set_counts", """WITH d AS (SELECT doc_id, true AS a, doc_id IN (SELECT doc_id FROM labels) AS b, doc_id IN (SELECT page_id FROM pages) AS c FROM documents)
SELECT a AS in_a, b AS in_b, c AS in_c, count(*) AS n FROM d GROUP BY ALL""")
def _(t):
    return so.set_counts(t.documents, t.labels, t.pages.select(F.col("page_id").alias("doc_id")), "doc_id")


@query("so03_topk_overlap", """WITH l AS (SELECT user_id, list(event_id ORDER BY value DESC, event_id)[:10] AS a, list(event_id ORDER BY ts DESC)[:8] AS b FROM events GROUP BY user_id)
SELECT user_id, round(len(list_intersect(a, b)) / least(10, len(a), len(b)) * 10000) / 100 AS overlap FROM l""")
def _(t):
    e = t.events
    from tallywright.functions.ordered import top_per_key
    a = top_per_key(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 10).groupBy("user_id").agg(F.collect_list("event_id").alias("a"))
    b = top_per_key(e, ["user_id"], [F.desc("ts")], 8).groupBy("user_id").agg(F.collect_list("event_id").alias("b"))
    return a.join(b, "user_id").select("user_id", so.topk_overlap(F.col("a"), F.col("b"), 10).alias("overlap"))


@query("so04_duplicate_or_conflict", "SELECT k, count(*) AS n, CASE WHEN count(DISTINCT md5(text)) = 1 THEN 'duplicate' ELSE 'conflict' END AS verdict FROM (SELECT source || lang || (n_chars % 50) AS k, text FROM documents) GROUP BY k HAVING count(*) > 1")
def _(t):
    d = t.documents.select(F.concat(F.col("source"), F.col("lang"), (F.col("n_chars") % 50).cast("string")).alias("k"), F.md5("text").alias("h"))
    return so.duplicate_or_conflict(d, "k", "h")


@query("so05_dedupe_by_prefix", "SELECT min(doc_id) AS doc_id FROM documents WHERE length(trim(text)) >= 70 GROUP BY lower(trim(text))")
def _(t):
    return so.dedupe_by_prefix(t.documents.select("doc_id", "text"), "doc_id", "text").select("doc_id")


@query("so06_union_discovered_ids", "SELECT user_id, bool_or(event_type = 'signup') AS via_list, bool_or(event_type = 'purchase' AND value > 50) AS via_search FROM events WHERE event_type = 'signup' OR (event_type = 'purchase' AND value > 50) GROUP BY 1")
def _(t):
    e = t.events
    return so.union_discovered_ids(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase' AND value > 50"), "user_id")


@query("so07_set_changed", "SELECT (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS removed, (SELECT count(DISTINCT s_nationkey + 100) FROM supplier WHERE s_acctbal > 9000) AS added, true AS changed")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("k"))
    cur = n.filter("k % 5 <> 0").union(t.supplier.filter("s_acctbal > 9000").select(F.col("s_nationkey") + 100))
    return so.set_changed(n, cur, "k")


@query("so08_capped_fact_list", """WITH k AS (SELECT conv_id, turn, lower(text) AS p, role = 'user' AS old FROM conversations),
f AS (SELECT conv_id, p, min(turn) AS turn, 0 AS age FROM k WHERE NOT old AND (conv_id, p) NOT IN (SELECT (conv_id, p) FROM k WHERE old) GROUP BY 1, 2 UNION ALL SELECT conv_id, p, turn, 1 FROM k WHERE old)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY age, CASE WHEN age = 0 THEN -turn ELSE turn END) AS INTEGER) AS position FROM f""")
def _(t):
    c = t.conversations.select("conv_id", "turn", "text", "role")
    return so.capped_fact_list(c.filter("role = 'user'").drop("role"), c.filter("role <> 'user'").drop("role"), ["conv_id"], "turn", "text").select("conv_id", "turn", "position")
