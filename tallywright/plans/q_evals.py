"""Queries over evaluation runs, freshness, health, deadlines and retention."""
from pyspark.sql import functions as F

from tallywright.operators import aggregates as ag, evals as ev, joins as jn
from tallywright.plans.q_joins import DIFF_SQL, SCORECARD_SQL, judges, scorecards
from tallywright.plans.registry import query
from tallywright.plans.tables import LEDGER, NOW_E, NOW_EVENTS, NOW_O, NOW_ORDERS, QUEUE, Tables, ts


def now_e():
    return ts(NOW_EVENTS)


def now_o():
    return ts(NOW_ORDERS)


@query("ev05_group_hit_lines", r"""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[' || role || '] [turn] ' || turn ELSE 'line ' || turn END AS line FROM conversations),
n AS (SELECT *, sum(CASE WHEN line LIKE '[%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM l)
SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY g) AS hit_no, text FROM (SELECT conv_id, g, string_agg(line, ' ' ORDER BY turn) AS text FROM n GROUP BY ALL)""")
def _(t):
    line = F.when(F.col("role") == "user", F.concat(F.lit("["), "role", F.lit("] [turn] "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("line "), F.col("turn").cast("string")))
    return ev.group_hit_lines(t.conversations.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line", 3).select("conv_id", "hit_no", "text")


@query("ev07_baseline_gate", f"""WITH {SCORECARD_SQL}, c AS (SELECT agent, CAST(sum(CAST(score AS DECIMAL(24, 9))) AS DOUBLE) / count(score) AS a FROM run WHERE y = 1998 GROUP BY 1), b AS (SELECT agent, CAST(sum(CAST(score + CASE WHEN agent = 'c1' THEN 0.2 ELSE 0 END AS DECIMAL(24, 9))) AS DOUBLE) / count(score) AS a FROM run WHERE y = 1997 AND agent <> 'c4' GROUP BY 1)
SELECT c.agent, round(c.a, 6) AS avg, round(b.a, 6) AS baseline_avg, round(c.a - b.a, 6) AS delta, b.a IS NOT NULL AS has_baseline, coalesce(c.a - b.a < -0.05, false) AS regressed, coalesce(c.a - b.a < -0.05, false) AS blocked FROM c LEFT JOIN b USING (agent)""")
def _(t):
    base, head = scorecards(t)
    base = base.filter("agent <> 'c4'").withColumn("score", F.col("score") + F.when(F.col("agent") == "c1", 0.2).otherwise(0.0))
    g = ev.baseline_gate(head, base, ["agent"], enforce=True)
    return g.select("agent", *[F.round(c, 6).alias(c) for c in ("avg", "baseline_avg", "delta")], "has_baseline", "regressed", "blocked")


@query("ev08_judge_agreement", """WITH c AS (SELECT source AS agent, quality AS a, 1 - toxic AS b, (CASE WHEN (quality = 1) = (toxic = 0) THEN 1 ELSE 0 END + 1) / 2 AS k FROM labels JOIN documents USING (doc_id))
SELECT agent, count(*) AS n, round(avg(abs(a - b)), 6) AS mean_abs_delta, CAST(max(abs(a - b)) AS DOUBLE) AS max_delta, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 6) AS verdict_agreement_rate,
  round(avg(k), 6) AS mean_criterion_agreement, count(*) FILTER (a <> b) AS disagreements FROM c GROUP BY agent""")
def _(t):
    g = ev.judge_agreement(jn.judge_compare(*judges(t)), ["agent"])
    return g.select("agent", "n", F.round("mean_abs_delta", 6).alias("mean_abs_delta"), "max_delta", F.round("verdict_agreement_rate", 6).alias("verdict_agreement_rate"),
                    F.round("mean_criterion_agreement", 6).alias("mean_criterion_agreement"), "disagreements")


def panel(t: Tables):
    """Events of a user are the judges' scores for one task; errors did not return a score."""
    return t.events.select(F.col("user_id").alias("task"), F.when(F.col("event_type") != "error", F.least(F.col("value") / 50, F.lit(1.0))).alias("score"))


_PANEL = "p AS (SELECT user_id AS task, CASE WHEN event_type <> 'error' THEN least(value / 50, 1) END AS score FROM events)"


@query("ev09_panel_score", f"""WITH {_PANEL}, g AS (SELECT task, avg(score) AS m, count(*) AS a, count(score) AS n, stddev_pop(score) AS sd FROM p GROUP BY 1), x AS (SELECT *, CASE WHEN n >= 2 THEN greatest(0, least(1, 1 - sd / 0.5)) END AS agr FROM g)
SELECT task, round(m, 6) AS panel_score, a AS judges_attempted, n AS judges_surviving, round(agr, 6) AS agreement, CASE WHEN n = 0 THEN 'unscored' WHEN n < 2 THEN 'low' WHEN agr >= 0.8 THEN 'high' WHEN agr >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def _(t):
    g = ev.panel_score(panel(t), ["task"])
    return g.withColumn("panel_score", F.round("panel_score", 6)).withColumn("agreement", F.round("agreement", 6))


_PAIRS = "pr AS (SELECT event_id, least(value / 50, 1) AS panel_score, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS human_score FROM events)"
_FIT = f"""{_PAIRS}, b AS (SELECT round(panel_score, 3) AS x, avg(human_score) AS m FROM pr GROUP BY 1), r AS (SELECT x, max(m) OVER (ORDER BY x) AS y FROM b),
pts AS (SELECT x, least(1, greatest(0, y)) AS y FROM (SELECT x, y FROM r UNION ALL SELECT 0.0, 0.0 WHERE (SELECT min(x) FROM r) > 0 UNION ALL SELECT 1.0, (SELECT max(y) FROM r) WHERE (SELECT max(x) FROM r) < 1))"""


def pairs(t: Tables):
    return t.events.select("event_id", F.least(F.col("value") / 50, F.lit(1.0)).alias("panel_score"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("human_score"))


@query("ev10_calibration_fit", f"WITH {_FIT} SELECT round(CAST(x AS DOUBLE), 6) AS x, round(CAST(y AS DOUBLE), 6) AS y FROM pts")
def _(t):
    return ev.calibration_fit(pairs(t)).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("ev11_calibration_apply", f"""WITH {_FIT}, s AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, lead(CAST(x AS DOUBLE)) OVER (ORDER BY x) AS x2, lead(CAST(y AS DOUBLE)) OVER (ORDER BY x) AS y2 FROM pts),
h AS (SELECT event_id, panel_score, min(x) AS x FROM pr JOIN s ON panel_score >= x AND panel_score <= x2 GROUP BY ALL)
SELECT event_id, round(y + (panel_score - s.x) / (x2 - s.x) * (y2 - y), 5) AS calibrated FROM h JOIN s ON s.x = h.x""")
def _(t):
    p = pairs(t)
    return ev.calibration_apply(p, ev.calibration_fit(p)).select("event_id", F.round("calibrated", 5).alias("calibrated"))


@query("ev12_scorecard_summary", f"WITH {SCORECARD_SQL} SELECT agent, count(*) FILTER (pass) AS passed, count(*) AS total, round(avg(score), 6) AS avg, avg(score) < 0.7 AS below_floor FROM run WHERE y = 1998 GROUP BY agent")
def _(t):
    return ev.scorecard_summary(scorecards(t)[1], ["agent"], 0.7).withColumn("avg", F.round("avg", 6))


@query("ev13_repair_plan_by_source", DIFF_SQL + """, r AS (SELECT CASE WHEN id % 9 = 0 THEN NULL ELSE 'prompt' || (id % 4) END AS f, delta FROM d WHERE regressed),
o AS (SELECT CASE WHEN f IS NULL THEN 'no_prompt_file' WHEN f = 'prompt3' THEN 'outside_diff' ELSE 'repair' END AS outcome, f, delta FROM r)
SELECT outcome, CASE WHEN outcome = 'repair' THEN f END AS prompt_file, count(*) AS n_tasks, round(least(min(delta), 0), 6) AS worst_delta FROM o GROUP BY ALL""")
def _(t):
    d = jn.diff_scorecards(*scorecards(t))
    prompts = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("prompt"), (F.col("c_custkey") % 4).cast("string"))).alias("prompt_file"))
    return ev.repair_plan_by_source(d, prompts, ["prompt0", "prompt1", "prompt2"]).withColumn("worst_delta", F.round("worst_delta", 6))


@query("ev15_freshness", f"""WITH s AS (SELECT DISTINCT event_type AS stream, CASE WHEN event_type IN ('view', 'error') THEN 24.2 ELSE 30 END AS max_age_h FROM events UNION ALL SELECT 'refund', 24),
n AS (SELECT event_type, max(ts) AS m FROM events GROUP BY 1)
SELECT stream, CASE WHEN m IS NULL THEN 'NO_DATA' WHEN (epoch_us({NOW_E}) - epoch_us(m)) / 3.6e9 <= max_age_h THEN 'FRESH' ELSE 'STALE' END AS state, round((epoch_us({NOW_E}) - epoch_us(m)) / 3.6e9, 1) AS age_h, CAST(max_age_h AS DOUBLE) AS max_age_h FROM s LEFT JOIN n ON stream = event_type""")
def _(t):
    e = t.events.withColumnRenamed("event_type", "stream")
    slo = e.select("stream").distinct().withColumn("max_age_h", F.when(F.col("stream").isin("view", "error"), 24.2).otherwise(30.0))
    slo = slo.unionByName(slo.limit(1).select(F.lit("refund").alias("stream"), F.lit(24.0).alias("max_age_h")))
    return ev.freshness(e, slo, "stream", now_e())


_MARK = "You keep the notes."


@query("ev16_block_drift", """SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'NO_DATA' WHEN doc_id % 10 > 5 THEN 'ABSENT' WHEN doc_id % 10 = 5 THEN 'DRIFTED' ELSE 'MATCH' END AS state FROM documents""")
def _(t):
    d, m = t.documents, F.col("doc_id") % 10
    blk = F.concat(F.lit(_MARK + "\nStay  factual.\n"), F.when(m == 5, "Add a line.\n").otherwise(""), F.lit("  Voice: calm."))
    text = F.when(m == 9, None).when(m > 5, F.col("text")).otherwise(F.concat("text", F.lit("\n"), blk, F.lit("\n"), "text"))
    return ev.block_drift(d.select("doc_id", text.alias("text")), "text", _MARK, "Voice:", f"{_MARK} Stay factual. Voice: calm.").select("doc_id", "state")


@query("ev17_agent_health", f"""WITH {LEDGER}, r AS (SELECT 'a' || i AS agent FROM range(9) t(i)), n AS (SELECT agent, max(ts) AS m FROM ledger WHERE agent <> 'a1' OR ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT agent, CASE WHEN m IS NULL THEN 'NO-DATA' WHEN round((epoch_us({NOW_E}) - epoch_us(m)) / 6e7) <= 1500 THEN 'LIVE' ELSE 'STALE' END AS status, CAST(round((epoch_us({NOW_E}) - epoch_us(m)) / 6e7) AS BIGINT) AS age_min FROM r LEFT JOIN n USING (agent)""")
def _(t):
    return ev.agent_health(roster(t), shared(t), now_e(), 1500)


def roster(t: Tables):
    """Nine agents, two of which never write."""
    return t.nation.filter("n_nationkey < 9").select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("agent"))


def shared(t: Tables):
    return t.ledger.filter((F.col("agent") != "a1") | (F.col("ts") < ts("2024-01-15 00:00:00")))


@query("ev18_condition_ladder", f"""WITH {LEDGER}, r AS (SELECT 'a' || i AS agent FROM range(9) t(i)), n AS (SELECT agent, max(ts) AS m FROM ledger WHERE agent <> 'a1' OR ts < TIMESTAMP '2024-01-15' GROUP BY 1),
h AS (SELECT agent, CASE WHEN m IS NULL THEN 'NO-DATA' WHEN round((epoch_us({NOW_E}) - epoch_us(m)) / 6e7) <= 1440 THEN 'LIVE' ELSE 'STALE' END AS hs FROM r LEFT JOIN n USING (agent)),
b AS (SELECT * FROM (VALUES ('a0', 'LIVE', 10), ('a2', 'starting', 5), ('a3', 'DARK', 60), ('a4', 'DARK', 900), ('a7', 'LIVE', 100)) v(agent, bs, age)),
c AS (SELECT agent, CASE WHEN age <= 120 AND bs = 'starting' THEN 'STARTING' WHEN age <= 120 AND bs = 'DARK' THEN 'DARK' WHEN (age <= 120 AND bs = 'LIVE') OR hs = 'LIVE' THEN 'HEALTHY' WHEN hs = 'NO-DATA' AND bs IS NULL THEN 'NO-MEMORY' ELSE 'WATCH' END AS condition FROM h LEFT JOIN b USING (agent))
SELECT agent, condition, CASE WHEN condition IN ('DARK', 'NO-MEMORY') THEN 'high' WHEN condition IN ('STARTING', 'HEALTHY') THEN 'ok' ELSE 'low' END AS severity, condition IN ('DARK', 'NO-MEMORY') AS dispatch,
  condition = 'DARK' AS escalate, CASE WHEN condition = 'DARK' THEN 2 ELSE 0 END AS dark_streak, CASE condition WHEN 'DARK' THEN 3 WHEN 'NO-MEMORY' THEN 1 ELSE 0 END AS consecutive_dark FROM c""")
def _(t):
    h = ev.agent_health(roster(t), shared(t), now_e())
    a = F.col("agent")
    status = F.when(a.isin("a0", "a7"), "LIVE").when(a == "a2", "starting").when(a.isin("a3", "a4"), "DARK")
    age = F.when(a == "a0", 10).when(a == "a2", 5).when(a == "a3", 60).when(a == "a4", 900).when(a == "a7", 100)
    b = roster(t).select("agent", status.alias("status"), age.alias("age_min"), F.lit(True).alias("hooks_wired"), F.lit(5).alias("ledger_size")).filter("status IS NOT NULL")
    s = roster(t).filter("agent = 'a3'").select("agent", ts("2024-01-31 00:00:00").alias("last_dispatch"), F.lit(2).alias("consecutive_dark"), F.lit(1).alias("dark_streak"))
    return ev.condition_ladder(h, b, s, now_e())


# Classified decision queue.
SLA = f"""{QUEUE}, cq AS (SELECT *, (epoch_us(expected_by) - epoch_us({NOW_O})) / 8.64e10 AS diff FROM queue),
cl AS (SELECT *, CASE WHEN status = 'closed' THEN 'closed' WHEN diff < 0 THEN 'overdue' WHEN diff <= 2 THEN 'near-due' WHEN status = 'ack' THEN 'ack' ELSE 'open' END AS state FROM cq),
sla AS (SELECT *, CASE WHEN state = 'overdue' THEN -diff ELSE 0 END AS days_overdue, CASE WHEN state = 'overdue' THEN 0 WHEN state = 'closed' THEN NULL ELSE diff END AS days_until_due,
  state = 'overdue' AND status = 'open' AND terminal_policy IS NOT NULL AND -diff > 6 AS terminal FROM cl)"""


def classified(t: Tables):
    return ev.sla_class(t.queue, now_o())


@query("ev19_sla_class", f"WITH {SLA} SELECT id, state, CAST(days_overdue AS DOUBLE) AS days_overdue, CAST(days_until_due AS DOUBLE) AS days_until_due, terminal FROM sla")
def _(t):
    return classified(t).select("id", "state", "days_overdue", "days_until_due", "terminal")


_NUDGE = f"""WITH {SLA}, k AS (SELECT *, terminal AND terminal_policy = 'block' AS blocking FROM sla WHERE state IN ('overdue', 'near-due') AND NOT (terminal AND coalesce(terminal_policy, '') = 'proceed')),
w AS (SELECT *, coalesce(blocking, false) AS b FROM k WHERE NOT (owner = 'BUILDING' AND category <> 'urgent' AND NOT coalesce(blocking, false)))"""


def nudges(t: Tables):
    tier = F.when(F.col("category") == "urgent", 1).otherwise(ev.tier_of(F.col("category")))
    return ev.nudge_lines(classified(t), ["BUILDING"], tier)


@query("ev20_nudge_lines", _NUDGE + """ SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY -days_overdue, id) AS line_no,
  CASE WHEN b THEN 'BLOCKING ' WHEN terminal AND terminal_policy = 'escalate' THEN 'ESCALATED ' ELSE '' END || '[' || category || '] ' || id || ' (' ||
  CASE WHEN state = 'overdue' THEN 'OVERDUE ' || CAST(round(days_overdue) AS BIGINT) || 'd' ELSE 'due in ' || CAST(ceil(days_until_due) AS BIGINT) || 'd' END || ')' AS line FROM w""")
def _(t):
    return nudges(t).select("owner", "id", "line_no", "line")


@query("ev20_nudge_batches", _NUDGE + " SELECT owner, count(*) AS count, count(*) FILTER (b) AS blocking, CAST(max(days_overdue) AS DOUBLE) AS longest_overdue FROM w GROUP BY owner")
def _(t):
    return ev.nudge_batches(nudges(t))


@query("ag07_queue_metrics", f"""WITH {SLA} SELECT owner, count(*) AS total, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'near-due') AS near_due, count(*) FILTER (state = 'overdue') AS overdue,
  count(*) FILTER (state = 'ack') AS ack, CAST(max(days_overdue) AS DOUBLE) AS oldest_wait_days, count(*) FILTER (terminal AND terminal_policy = 'block') AS blocking FROM sla WHERE state <> 'closed' GROUP BY owner""")
def _(t):
    return ag.queue_metrics(classified(t))


@query("ag08_digest_by_category", f"""WITH {SLA} SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY -days_overdue, id) AS position,
  CASE state WHEN 'overdue' THEN 'OVERDUE ' || CAST(round(days_overdue) AS BIGINT) || 'd past SLA' WHEN 'near-due' THEN 'due in ' || CAST(ceil(days_until_due) AS BIGINT) || 'd' ELSE 'acknowledged, still open' END AS tag
FROM sla WHERE category <> 'urgent' AND state IN ('overdue', 'near-due', 'ack')""")
def _(t):
    return ag.digest_by_category(classified(t), F.col("category") == "urgent").select("category", "id", "position", "tag")


@query("ev21_pageable_deadlines", f"""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'personal' ELSE 'company' END AS lane, o_orderkey % 3 <> 0 AND date_diff('day', {NOW_O}, o_orderdate) <= 7 AS pageable,
  CASE WHEN o_orderkey % 3 = 0 THEN 'unverified' WHEN date_diff('day', {NOW_O}, o_orderdate) > 7 THEN 'out-of-window' END AS reason,
  'leg_' || substr(sha256(CASE WHEN o_custkey % 5 = 0 THEN 'personal' ELSE 'firm' END || '|' || o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority), 1, 24) AS row_key FROM orders""")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 5 == 0, "personal").otherwise("firm").alias("ns"), F.to_date("o_orderdate").alias("date"),
                        F.col("o_orderpriority").alias("what"), (F.col("o_orderkey") % 3 != 0).alias("verified"))
    return ev.pageable_deadlines(d, now_o()).select("id", "lane", "pageable", "reason", "row_key")


@query("ev22_grant_expiry", f"""WITH g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 > 0 THEN CAST(date_diff('day', {NOW_O}, CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 6 * 4 AS INTEGER))) AS BIGINT) END AS days_left FROM orders WHERE o_orderstatus = 'O')
SELECT id, days_left, CASE WHEN days_left IS NULL THEN 'no-term-data' WHEN days_left < 0 THEN 'lapsed-but-still-active' WHEN days_left <= 60 THEN 'expiring-soon' ELSE 'healthy' END AS condition FROM g""")
def _(t):
    g = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("done").alias("status"), F.col("o_orderdate").alias("added"),
                        F.when(F.col("o_orderkey") % 6 > 0, (F.col("o_orderkey") % 6 * 4).cast("int")).alias("term_months"))
    return ev.grant_expiry(g, now_o()).select("id", "days_left", "condition")


@query("ev23_review_overdue", f"""SELECT o_orderkey AS id, (epoch_us({NOW_O}) - epoch_us(o_orderdate)) / 8.64e10 AS age_days, CASE WHEN (epoch_us({NOW_O}) - epoch_us(o_orderdate)) / 8.64e10 >= 21 THEN 'high' ELSE 'medium' END AS severity
FROM orders WHERE o_orderstatus <> 'P' AND (epoch_us({NOW_O}) - epoch_us(o_orderdate)) / 8.64e10 >= 7 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    s = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("uploaded"), F.when(F.col("o_orderstatus") == "P", "Superseded by x").otherwise("ok").alias("status"))
    r = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return ev.review_overdue(s, r, "id", now_o()).select("id", "age_days", "severity")


@query("ev24_signal_cooldown", f"""WITH h AS (SELECT user_id, count(*) AS n, max(ts) AS m FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events),
f AS (SELECT u.user_id AS signal, coalesce((epoch_us({NOW_E}) - epoch_us(m)) / 6e7 >= 2880, true) AS fire, coalesce(n, 0) AS n FROM u LEFT JOIN h USING (user_id))
SELECT signal, fire, fire AND n + 1 >= 3 AS escalate, n + CASE WHEN fire THEN 1 ELSE 0 END AS consecutive FROM f""")
def _(t):
    h = t.events.filter((F.col("event_type") == "error") & (F.col("ts") >= ts("2024-01-29 00:00:00"))).select(F.col("user_id").alias("signal"), "ts")
    return ev.signal_cooldown(h, t.events.select(F.col("user_id").alias("signal")).distinct(), now_e(), 2880)


@query("ev25_verdict_gate", f"""WITH {LEDGER}, s AS (SELECT l.id, o.id AS cand_id, o.ts AS cand_ts FROM ledger l JOIN ledger o ON l.supersedes = o.id),
v AS (SELECT id AS row_id, CASE event_id % 4 WHEN 0 THEN ' Contradict' WHEN 1 THEN 'stale-with-material-drift' WHEN 2 THEN 'agree' ELSE '' END AS label, CASE WHEN event_id % 7 = 0 THEN 'none' ELSE supersedes END AS cited_id FROM ledger WHERE supersedes IS NOT NULL),
j AS (SELECT row_id, CASE WHEN lower(trim(label)) = '' THEN 'agree' ELSE lower(trim(label)) END AS label, cited_id, cand_id, cand_ts FROM v LEFT JOIN s ON s.id = row_id AND cand_id = cited_id),
g AS (SELECT *, CASE WHEN label NOT IN ('contradict', 'stale-with-material-drift') THEN 'not a firing label' WHEN cand_id IS NULL THEN 'cited id not in slice'
  WHEN label = 'stale-with-material-drift' AND (epoch_us({NOW_E}) - epoch_us(cand_ts)) / 8.64e10 < 21 THEN 'cited row too young' ELSE 'grounded' END AS gate FROM j)
SELECT row_id, label, cited_id, gate = 'grounded' AS fires, gate FROM g""")
def _(t):
    l, m = t.ledger.filter("supersedes IS NOT NULL"), F.col("event_id") % 4
    sl = jn.supersede_pairs(t.ledger).select(F.col("new_id").alias("id"), F.col("old_id").alias("cand_id"), F.col("old_ts").alias("cand_ts"))
    v = l.select(F.col("id").alias("row_id"), F.when(m == 0, " Contradict").when(m == 1, "stale-with-material-drift").when(m == 2, "agree").otherwise("").alias("label"),
                 F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("supersedes")).alias("cited_id"))
    return ev.verdict_gate(v, sl, now_e())


@query("ev26_expected_vs_observed", """SELECT o_orderkey AS id, CAST(2 AS BIGINT) AS checked, CAST((CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) + (CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS mismatches,
  concat_ws(',', CASE WHEN o_orderpriority <> '5-LOW' THEN 'priority' END, CASE WHEN o_orderstatus <> 'F' THEN 'status' END) AS mismatched, o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AS ok FROM orders""")
def _(t):
    o = t.orders
    e = o.select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("status"), F.lit("F"), F.lit("priority"), F.lit("5-LOW")).alias("expected"))
    s = o.select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("observed"))
    return ev.expected_vs_observed(e, s)


@query("ev27_lane_privilege_class", "SELECT event_id, CASE WHEN event_id % 9 = 0 OR user_id % 7 = 3 THEN 'restricted' ELSE 'general' END AS class FROM events")
def _(t):
    lane = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")))
    return t.events.select("event_id", ev.lane_class(lane, "^a3$").alias("class"))


@query("ev28_note_review_gate", """SELECT event_id, event_type = 'error' AS malformed, CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 'revise' ELSE 'approve' END AS verdict,
  CASE WHEN event_type = 'error' THEN 0 ELSE least(1, value / 20) END::DOUBLE AS confidence, event_type IN ('click', 'purchase') AS revise FROM events""")
def _(t):
    et = F.col("event_type")
    body = F.concat(F.lit('{"verdict":"'), F.when(et == "view", "approve").otherwise("revise"), F.lit('","issues":'),
                    F.when(et == "click", '[{"severity":"high","note":"x"}]').when(et == "signup", '[{"severity":"low","note":"y"}]').otherwise("[]"),
                    F.lit(',"confidence":'), (F.col("value") / 20).cast("string"), F.lit("}"))
    raw = F.when(et == "error", "no json here").when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("text "), body))
    return ev.note_review_gate(t.events.select("event_id", raw.alias("raw")), "raw").select("event_id", "malformed", "verdict", "confidence", "revise")


@query("ev29_retention_select", f"""WITH {LEDGER}, a AS (SELECT id, agent, ts, CASE type WHEN 'status' THEN 5 WHEN 'fact' THEN 20 WHEN 'decision' THEN 10 END AS age, type = 'decision' AS arch FROM ledger),
b AS (SELECT *, CASE WHEN age IS NULL THEN 'report' WHEN (epoch_us({NOW_E}) - epoch_us(ts)) / 8.64e10 > age THEN (CASE WHEN arch THEN 'archive' ELSE 'delete' END) ELSE 'keep' END AS action FROM a)
SELECT id, action, CASE WHEN action = 'archive' THEN '_ARCHIVE/episodes/' || agent || '/' || strftime(ts, '%Y-%m') || '.jsonl' END AS archive_path FROM b""")
def _(t):
    types = t.ledger.select(F.col("type").alias("container")).distinct()
    rules = types.withColumn("max_age_days", F.when(F.col("container") == "status", 5).when(F.col("container") == "fact", 20).when(F.col("container") == "decision", 10)).filter(
        "max_age_days IS NOT NULL").withColumn("archive", F.col("container") == "decision")
    return ev.retention_select(t.ledger, rules, "type", now_e()).select("id", "action", "archive_path")


_IDS = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01'"


def _archive(t: Tables):
    old = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < ts("1996-01-01 00:00:00"))).select("o_orderkey")
    return ev.archive_move(t.orders.select("o_orderkey", "o_totalprice"), old, "o_orderkey", F.lit("1998-01-01"), "stale")


@query("ev30_archive_move", f"SELECT o_orderkey, o_totalprice, '1998-01-01' AS archived_at, 'stale' AS archive_reason FROM orders WHERE o_orderkey IN ({_IDS})")
def _(t):
    return _archive(t)[0]


@query("ev30_archive_keep", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN ({_IDS})")
def _(t):
    return _archive(t)[1]


@query("ev31_heartbeat_status", f"""WITH r AS (SELECT s_suppkey AS job, CASE WHEN s_suppkey % 3 = 0 THEN 2000 WHEN s_suppkey % 3 = 1 THEN 3000 ELSE 0 END AS i FROM supplier), b AS (SELECT user_id AS job, max(ts) AS m FROM events WHERE user_id % 4 <> 0 GROUP BY 1),
j AS (SELECT job, nullif(i, 0) AS i, CAST(round((epoch_us({NOW_E}) - epoch_us(m)) / 6e7) AS BIGINT) AS age FROM r FULL JOIN b USING (job))
SELECT job, CASE WHEN i IS NULL AND age IS NULL THEN 'NO-DATA' WHEN age IS NULL THEN 'DEAD' WHEN age > i * 3 THEN 'DEAD' WHEN age > i THEN 'LATE' ELSE 'LIVE' END AS status, age AS age_min, i AS interval_min FROM j""")
def _(t):
    m = F.col("s_suppkey") % 3
    r = t.supplier.select(F.col("s_suppkey").alias("job"), F.when(m == 0, 2000).when(m == 1, 3000).otherwise(0).alias("interval_min"))
    return ev.heartbeat_status(r, t.events.filter("user_id % 4 <> 0").select(F.col("user_id").alias("job"), "ts"), "job", now_e())


@query("ev32_clean_tail_streak", """WITH f AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
SELECT e.user_id, count(*) FILTER (f.f IS NULL OR (ts, event_id) > f.f) AS streak, count(*) AS receipts, count(*) FILTER (f.f IS NULL OR (ts, event_id) > f.f) >= 2 AS gate FROM events e JOIN f ON e.user_id = f.user_id GROUP BY 1""")
def _(t):
    return ev.clean_tail_streak(t.events, ["user_id"], F.col("event_type") != "error", ["ts", "event_id"])


@query("ev33_due_for_refresh", f"""WITH s AS (SELECT l_suppkey, max(l_shipdate) AS staged, CAST(count(*) AS VARCHAR) AS h FROM lineitem WHERE l_suppkey % 6 <> 0 GROUP BY 1), r AS (SELECT s_suppkey, CAST((SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS h FROM supplier)
SELECT s_suppkey AS unit, coalesce((epoch_us(TIMESTAMP '2001-11-28') - epoch_us(staged)) / 3.6e9 > 20, true) AS due, r.h IS DISTINCT FROM s.h AS changed FROM r LEFT JOIN s ON s_suppkey = l_suppkey""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("unit")).agg(F.max("l_shipdate").alias("staged_at"), F.count("*").alias("n"))
    reg = t.supplier.select(F.col("s_suppkey").alias("unit")).join(n, "unit", "left").select(
        "unit", (F.coalesce("n", F.lit(0)) + F.when(F.col("unit") % 5 == 0, 1).otherwise(0)).cast("string").alias("hash"))
    snap = n.filter("unit % 6 <> 0").select("unit", "staged_at", F.col("n").cast("string").alias("hash"))
    return ev.due_for_refresh(reg, snap, "unit", ts("2001-11-28 00:00:00"))


def covered(t: Tables):
    """Suppliers are threats, their line items the controls."""
    st = F.when(F.col("l_returnflag") == "N", "not_implemented").when(F.col("l_returnflag") == "A", "partial").when(F.col("l_linestatus") == "O", "implemented").otherwise("verified")
    c = t.lineitem.select(F.col("l_suppkey").alias("threat"), st.alias("status"), (F.col("l_linenumber") % 5).cast("double").alias("effectiveness"),
                                                    F.col("l_linestatus").alias("layer"), (F.col("l_partkey") % 3).alias("kind"), (F.col("l_tax") < 0.05).alias("test_passed"))
    return ev.control_coverage(t.supplier.select(F.col("s_suppkey").alias("threat"), F.abs("s_acctbal").alias("risk")), c)


_COV = """WITH c AS (SELECT l_suppkey AS threat, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 0.5 WHEN l_linestatus = 'O' THEN 0.8 ELSE 1 END * (l_linenumber % 5) AS s, l_returnflag <> 'N' AS live, l_linestatus AS layer, l_partkey % 3 AS kind, l_tax < 0.05 AS ok FROM lineitem),
g AS (SELECT threat, sum(s) AS s, count(*) AS n, count(DISTINCT CASE WHEN live THEN layer END) AS layers, count(DISTINCT CASE WHEN live THEN kind END) AS kinds, avg(CASE WHEN ok THEN 1 ELSE 0 END) AS p FROM c GROUP BY 1),
j AS (SELECT s_suppkey AS threat, abs(s_acctbal) AS risk, coalesce(s / (n * 4) * 100, 0)::DOUBLE AS coverage, coalesce(n, 0) AS controls, coalesce(layers, 0) AS layers, coalesce(kinds, 0) AS kinds, p FROM supplier LEFT JOIN g ON threat = s_suppkey),
k AS (SELECT *, concat_ws(',', CASE WHEN coverage < 50 THEN 'insufficient_coverage' END, CASE WHEN layers < 2 THEN 'no_depth' END, CASE WHEN kinds < 2 THEN 'no_diversity' END) AS gaps FROM j)"""


@query("ev34_control_coverage", _COV + " SELECT threat, round(coverage, 4) AS coverage, controls, layers, kinds, round(p, 6) AS test_pass_rate, gaps FROM k")
def _(t):
    return covered(t).select("threat", F.round("coverage", 4).alias("coverage"), "controls", "layers", "kinds", F.round("test_pass_rate", 6).alias("test_pass_rate"), "gaps")


@query("ev34_weighted_coverage", _COV + " SELECT count(*) AS threats, count(*) FILTER (controls = 0) AS unmapped, count(*) FILTER (gaps <> '') AS with_gaps, round(sum(coverage * risk) / sum(risk), 4) AS weighted_coverage FROM k")
def _(t):
    return ev.weighted_coverage(covered(t)).withColumn("weighted_coverage", F.round("weighted_coverage", 4))
