"""Queries over joins."""
from pyspark.sql import functions as F

from tallywright.operators import filters as flt, joins as jn
from tallywright.plans.registry import query
from tallywright.plans.tables import BARS, CATALOG, INVENTORY, LEDGER, Tables, ts

_REASON = """CASE WHEN NOT sidecar THEN 'missing_sidecar_claim' WHEN NOT enriched THEN 'missing_enrichment_claim'
  WHEN enriched_sha256 IS DISTINCT FROM sha256 THEN 'missing_matching_enrichment_hash' WHEN coalesce(err, '') <> '' THEN 'source_error' ELSE 'eligible' END"""


@query("jn01_active_rows", f"WITH {LEDGER} SELECT id, type, ekey FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger x WHERE x.supersedes = l.id)")
def _(t):
    return jn.active_rows(t.ledger).select("id", "type", "ekey")


@query("jn02_supersede_pairs", f"WITH {LEDGER} SELECT o.id AS old_id, n.id AS new_id, o.agent AS old_agent, n.agent AS new_agent FROM ledger o JOIN ledger n ON n.supersedes = o.id")
def _(t):
    return jn.supersede_pairs(t.ledger).select("old_id", "new_id", "old_agent", "new_agent")


@query("jn03_missing_sidecar", f"""WITH {CATALOG} SELECT path AS key FROM catalog WHERE NOT sidecar""")
def _(t):
    return jn.missing_sidecar(t.catalog.select(F.col("path").alias("key")).union(
        t.catalog.filter("sidecar").select(F.concat(F.lit("_TEXT/"), F.upper("path"), F.lit(".TXT")))), ["txt"])


@query("jn04_inventory_reconcile", f"""WITH {INVENTORY}, p AS (
  SELECT c.path, doc_id % 50 = 0 AS repeated, {_REASON} AS reason, o.size AS osize, x.size AS tsize FROM catalog c
  LEFT JOIN inventory o ON o.key = c.path LEFT JOIN inventory x ON x.key = '_TEXT/' || c.path || '.txt')
SELECT reason, count(*) + count(*) FILTER (repeated) AS catalog_rows, count(*) AS paths, count(osize) AS original_present, count(*) - count(osize) AS original_missing,
  count(*) FILTER (osize = 0) AS original_zero, count(*) FILTER (tsize > 0) AS text_nonempty, count(*) FILTER (tsize = 0) AS text_empty,
  count(*) - count(tsize) AS text_missing FROM p GROUP BY reason
UNION ALL SELECT '(invalid path)', count(*), count(DISTINCT source), 0, 0, 0, 0, 0, 0 FROM documents WHERE doc_id % 50 = 1
UNION ALL SELECT '(internal path)', count(*), count(*), 0, 0, 0, 0, 0, 0 FROM documents WHERE doc_id % 50 = 2""")
def _(t):
    # Besides the catalog itself: rows that repeat a path, rows with a path outside the tree, and rows of a reserved root.
    c, k = t.catalog, F.col("doc_id") % 50
    more = c.filter(k < 3).withColumn("path", F.when(k == 1, F.concat(F.lit("../"), "entity")).when(k == 2, F.concat(F.lit("_TEXT/"), "path")).otherwise(F.col("path")))
    return jn.inventory_reconcile(c.unionByName(more), t.inventory, flt.exclusion_reason(None))


_PLAN = f"""WITH {INVENTORY}, j AS (
  SELECT c.path, {_REASON} AS exclusion, o.size AS original_size, x.size AS text_size, o.key AS ok, x.key AS tk, sidecar, err FROM catalog c
  LEFT JOIN inventory o ON o.key = c.path LEFT JOIN inventory x ON x.key = '_TEXT/' || c.path || '.txt'),
plan AS (SELECT path, exclusion, original_size, text_size, CASE WHEN ok IS NULL THEN 'recover_original' WHEN original_size = 0 THEN 'review_zero_original'
  WHEN err <> '' THEN 'review_source_error' WHEN NOT sidecar AND tk IS NULL THEN 'extract_text' WHEN NOT sidecar AND text_size = 0 THEN 'review_empty_text'
  WHEN NOT sidecar THEN 'restore_sidecar_existence' WHEN exclusion IN ('missing_enrichment_claim', 'missing_matching_enrichment_hash', 'eligible')
  THEN 'enrichment_requires_verified_result' ELSE 'review_source_error' END AS action
  FROM j WHERE ok IS NULL OR exclusion IN ('missing_sidecar_claim', 'missing_enrichment_claim'))"""


@query("jn05_repair_plan", _PLAN + " SELECT path, action, exclusion, original_size, text_size FROM plan")
def _(t):
    return jn.repair_plan(t.catalog, t.inventory)


@query("jn05_repair_plan_counts", _PLAN + " SELECT action, count(*) AS n FROM plan GROUP BY action")
def _(t):
    return jn.repair_plan(t.catalog, t.inventory).groupBy("action").agg(F.count("*").alias("n"))


SCORECARD_SQL = """run AS (SELECT year(o_orderdate) AS y, o_custkey AS id, 'c' || (o_custkey % 5) AS agent,
    round(avg(o_totalprice) / max(o_totalprice), 6) AS score, round(avg(o_totalprice) / max(o_totalprice), 6) >= 0.7 AS pass
  FROM orders WHERE year(o_orderdate) IN (1997, 1998) GROUP BY ALL)"""
DIFF_SQL = f"""WITH {SCORECARD_SQL}, d AS (
  SELECT coalesce(h.id, b.id) AS id, coalesce(h.agent, b.agent) AS agent,
    CASE WHEN b.id IS NULL THEN 'new' WHEN h.id IS NULL THEN 'removed' ELSE 'compared' END AS status,
    b.score AS base_score, h.score AS head_score, h.score - b.score AS delta,
    coalesce(b.id IS NOT NULL AND h.id IS NOT NULL AND ((b.pass AND NOT h.pass) OR h.score - b.score <= CAST(-0.15 AS DOUBLE)), false) AS regressed
  FROM (SELECT * FROM run WHERE y = 1997) b FULL JOIN (SELECT * FROM run WHERE y = 1998) h ON b.id = h.id)"""


def scorecards(t: Tables):
    """Two runs from two years of orders."""
    score = F.round(F.avg("o_totalprice") / F.max("o_totalprice"), 6)
    runs = t.orders.filter(F.year("o_orderdate").isin(1997, 1998)).groupBy(
        F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("id")).agg(score.alias("score")).withColumn(
        "agent", F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).withColumn("pass", F.col("score") >= 0.7)
    return runs.filter("y = 1997"), runs.filter("y = 1998")


@query("jn06_diff_scorecards", DIFF_SQL + """ SELECT id, agent, status, base_score, head_score, round(delta, 6) AS delta, regressed,
  coalesce(status = 'compared' AND delta >= CAST(0.15 AS DOUBLE) AND NOT regressed, false) AS improved FROM d""")
def _(t):
    d = jn.diff_scorecards(*scorecards(t))
    return d.withColumn("delta", F.round("delta", 6))


def judges(t: Tables):
    """Judge a scores by quality, judge b by the absence of toxicity."""
    l = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    q, x = F.col("quality"), F.col("toxic")
    a = l.select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), q.cast("double").alias("score"), F.array(q == 1, x == 0).alias("met"))
    b = l.select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), (1 - x).cast("double").alias("score"), F.array(x == 0, x == 0).alias("met"))
    return a, b


@query("jn07_judge_compare_join", """SELECT doc_id AS id, source AS agent, CAST(quality AS DOUBLE) AS score_a, CAST(1 - toxic AS DOUBLE) AS score_b,
  CAST(abs(quality - 1 + toxic) AS DOUBLE) AS score_delta, (quality >= 0.7) = (1 - toxic >= 0.7) AS verdict_agree,
  (CASE WHEN (quality = 1) = (toxic = 0) THEN 1 ELSE 0 END + 1) / 2 AS criterion_agreement FROM labels JOIN documents USING (doc_id)""")
def _(t):
    return jn.judge_compare(*judges(t))


@query("jn08_missing_expected", """WITH e AS (SELECT n_nationkey AS nation FROM nation UNION SELECT n_nationkey + 100 FROM nation), l AS (SELECT s_nationkey AS nation FROM supplier UNION SELECT s_suppkey + 1000 FROM supplier)
SELECT nation, 'missing' AS side FROM e WHERE nation NOT IN (SELECT nation FROM l) UNION ALL SELECT nation, 'orphan' FROM l WHERE nation NOT IN (SELECT nation FROM e)""")
def _(t):
    n, s = t.nation.select(F.col("n_nationkey").cast("long").alias("nation")), t.supplier
    expected = n.union(n.select(F.col("nation") + 100))
    live = s.select(F.col("s_nationkey").cast("long").alias("nation")).union(s.select(F.col("s_suppkey") + 1000))
    return jn.missing_expected(expected, live, "nation")


@query("jn09_registry_health", """SELECT s.s_suppkey AS job, coalesce(h.status, 'MISSING_ROW') AS state, coalesce(h.status, 'MISSING_ROW') <> 'LIVE' AS anomaly
FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey + 1000000 FROM supplier) s LEFT JOIN (SELECT l_suppkey, CASE WHEN max(l_shipdate) >= TIMESTAMP '2001-11-01' THEN 'LIVE' ELSE 'STALE' END AS status
  FROM lineitem GROUP BY 1) h ON s.s_suppkey = h.l_suppkey""")
def _(t):
    status = t.lineitem.groupBy(F.col("l_suppkey").alias("job")).agg(
        F.when(F.max("l_shipdate") >= ts("2001-11-01 00:00:00"), "LIVE").otherwise("STALE").alias("status"))
    jobs = t.supplier.select(F.col("s_suppkey").alias("job"))
    return jn.registry_health(jobs.union(jobs.select(F.col("job") + 1000000)), status, "job")


@query("jn10_constraint_audit", """WITH ix AS (SELECT p_partkey AS "index", CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'Supplier#' || lpad(CAST(p_partkey % 150 AS VARCHAR), 9, '0') END AS w,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'ts' END AS f, CAST(p_size % 6 AS DOUBLE) AS age, p_brand AS service FROM part)
SELECT "index", 'no_writer' AS violation FROM ix WHERE w = ''
UNION ALL SELECT "index", 'unknown_writer' FROM ix WHERE w <> '' AND w NOT IN (SELECT s_name FROM supplier)
UNION ALL SELECT "index", 'no_freshness_field' FROM ix WHERE f IS NULL UNION ALL SELECT "index", 'no_positive_slo' FROM ix WHERE age <= 0
UNION ALL SELECT "index", 'also_retired' FROM ix WHERE "index" % 50 = 1
UNION ALL SELECT "index", 'retired_with_writer' FROM ix WHERE "index" % 100 = 1""")
def _(t):
    p = t.part
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 150).cast("string"), 9, "0"))
    ix = p.select(F.col("p_partkey").alias("index"), F.when(F.col("p_partkey") % 13 == 0, "").otherwise(name).alias("writer_job"),
                  F.when(F.col("p_size") % 10 != 0, "ts").alias("timestamp_field"), (F.col("p_size") % 6).cast("double").alias("max_age_h"),
                  F.col("p_brand").alias("service"))
    retired = p.filter("p_partkey % 50 = 1").select(F.col("p_partkey").alias("index"), F.when(F.col("p_partkey") % 100 == 1, "w").alias("writer_job"))
    return jn.constraint_audit(ix, t.supplier.select(F.col("s_name").alias("job")), retired)


@query("jn11_presence_verdict", """SELECT o_orderkey AS id, CASE WHEN a AND b THEN 'MATCHED' WHEN NOT a AND NOT b THEN 'MISSING_BOTH' WHEN NOT a THEN 'MISSING_LEFT' ELSE 'MISSING_RIGHT' END AS verdict
FROM (SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS a,
  o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') AS b FROM orders)""")
def _(t):
    l = t.lineitem.withColumnRenamed("l_orderkey", "id")
    return jn.presence_verdict(l.filter("l_returnflag = 'R'"), l.filter("l_linestatus = 'O'"), t.orders.select(F.col("o_orderkey").alias("id")), "id")


@query("jn12_asof_forward", """WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) + 1 AS d FROM lineitem WHERE dayofweek(l_shipdate) IN (0, 5)),
ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS x FROM orders),
m AS (SELECT ev.d, x, (SELECT min(days.d) FROM days WHERE days.d >= ev.d) AS day FROM ev)
SELECT CAST(day AS VARCHAR) AS day, string_agg(x, ' | ' ORDER BY fd, x) AS event FROM (SELECT day, x, min(d) AS fd FROM m WHERE day IS NOT NULL GROUP BY day, x) GROUP BY day""")
def _(t):
    o = t.orders.withColumn("date", F.to_date("o_orderdate"))
    # The days after the Fridays and Sundays of all ship dates, so that several days of events meet on one.
    days = t.lineitem.filter(F.dayofweek("l_shipdate").isin(1, 6)).select(F.date_add(F.to_date("l_shipdate"), 1).alias("date"))
    out = jn.asof_forward(o.select("date", F.col("o_orderpriority").alias("text")), days)
    return out.withColumn("day", F.col("day").cast("string"))


@query("jn12_asof_forward_ship_days", """WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS x FROM orders),
m AS (SELECT ev.d, x, (SELECT min(days.d) FROM days WHERE days.d >= ev.d) AS day FROM ev)
SELECT CAST(day AS VARCHAR) AS day, string_agg(x, ' | ' ORDER BY fd, x) AS event FROM (SELECT day, x, min(d) AS fd FROM m WHERE day IS NOT NULL GROUP BY day, x) GROUP BY day""")
def _(t):
    out = jn.asof_forward(t.orders.select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("text")), t.lineitem.select(F.to_date("l_shipdate").alias("date")))
    return out.withColumn("day", F.col("day").cast("string"))


@query("jn13_overlay_by_date", f"""WITH {BARS} SELECT CAST(date AS VARCHAR) AS date, CASE WHEN day(date) <= 10 THEN close * 2 ELSE close END AS close,
  CASE WHEN day(date) <= 10 THEN 'overlay' ELSE 'base' END AS src,
  CASE WHEN volume > 8 THEN 'busy' WHEN day(date) <= 10 THEN 'note' ELSE '' END AS event FROM bars""")
def _(t):
    b = t.daily_bars
    base = b.select("date", "close", F.lit("base").alias("src"), F.when(F.col("volume") > 8, "busy").otherwise("").alias("event"))
    over = b.filter(F.dayofmonth("date") <= 10).select("date", (F.col("close") * 2).alias("close"), F.lit("overlay").alias("src"), F.lit("note").alias("event"))
    return jn.overlay_by_date(base, over).withColumn("date", F.col("date").cast("string"))


@query("jn14_entity_candidate_slice", f"""WITH {LEDGER}, k AS (SELECT id, ts, type, agent, unnest([ekey, 'b' || (event_id % 9)]) AS key, id IN (SELECT supersedes FROM ledger WHERE supersedes IS NOT NULL) AS gone FROM ledger),
c AS (SELECT DISTINCT r.id, p.id AS cand_id, p.ts AS cand_ts FROM k r JOIN k p ON r.key = p.key AND (p.ts, p.id) < (r.ts, r.id)
  WHERE r.ts >= TIMESTAMP '2024-01-25' AND r.agent <> 'a3' AND NOT p.gone AND p.agent <> 'a3')
SELECT id, cand_id, CAST(slot AS INTEGER) AS slot FROM (SELECT id, cand_id, row_number() OVER (PARTITION BY id ORDER BY cand_ts DESC, cand_id DESC) AS slot FROM c) WHERE slot <= 20""")
def _(t):
    l = t.ledger
    gone = l.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("_g")).distinct()
    rows = l.join(gone, F.col("id") == F.col("_g"), "left").select(
        "id", "ts", "agent", "_g", F.array("ekey", F.concat(F.lit("b"), (F.col("event_id") % 9).cast("string"))).alias("keys"))
    ok = F.col("agent") != "a3"
    return jn.entity_candidate_slice(rows, (F.col("ts") >= ts("2024-01-25 00:00:00")) & ok, ok & F.col("_g").isNull()).select("id", "cand_id", "slot")


@query("jn15_batch_lookup", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (1, 2, 3, 5, 8, 13)")
def _(t):
    return jn.batch_lookup(t.customer, t.orders, "c_custkey", "o_custkey", [1, 2, 3, 5, 8, 13]).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("jn16_decorrelated_count", "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS order_count FROM customer")
def _(t):
    return jn.count_per_parent(t.customer, t.orders, "c_custkey", "o_custkey", "order_count").select("c_custkey", "c_name", "order_count")


@query("jn17_batch_update_join", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) THEN 'B' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    upd = t.lineitem.filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("o_orderstatus", F.lit("B"))
    return jn.batch_update(t.orders.select("o_orderkey", "o_orderstatus"), upd, "o_orderkey", ["o_orderstatus"])


PRICE_RULES = [
    {"pattern": "^econ", "input": 0.15, "output": 0.6, "cached": 0.075},
    {"pattern": "^(small|medium)$", "input": 2.5, "output": 10.0, "cached": 1.25},
    {"pattern": "^m", "input": 99.0, "output": 1.0, "cached": 1.0},
    {"pattern": "^large", "input": 4.0, "output": 20.0, "cached": 0.4, "long": {"threshold": 40, "input": 8.0, "output": 30.0, "cached": 0.8}},
]


@query("jn18_price_rule_join", """SELECT l_orderkey, l_linenumber, l_partkey, round((greatest(q - c, 0) * i + c * k + n * o), 6) AS cost_micro, unknown FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS n, l_quantity / 2 AS c,
    CASE WHEN p_type LIKE 'ECON%' THEN 0.15 WHEN p_type IN ('SMALL', 'MEDIUM') THEN 2.5 WHEN p_type = 'LARGE' THEN (CASE WHEN l_quantity > 40 THEN 8 ELSE 4 END) ELSE 8 END::DOUBLE AS i,
    CASE WHEN p_type LIKE 'ECON%' THEN 0.6 WHEN p_type IN ('SMALL', 'MEDIUM') THEN 10 WHEN p_type = 'LARGE' THEN (CASE WHEN l_quantity > 40 THEN 30 ELSE 20 END) ELSE 30 END::DOUBLE AS o,
    CASE WHEN p_type LIKE 'ECON%' THEN 0.075 WHEN p_type IN ('SMALL', 'MEDIUM') THEN 1.25 WHEN p_type = 'LARGE' THEN (CASE WHEN l_quantity > 40 THEN 0.8 ELSE 0.4 END) ELSE 0.8 END::DOUBLE AS k,
    p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE') AS unknown FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def _(t):
    u = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("p_type").alias("model"), F.col("l_quantity").alias("prompt"),
        F.col("l_linenumber").cast("double").alias("completion"), (F.col("l_quantity") / 2).alias("cached"))
    c = jn.price_rule_join(u, PRICE_RULES, "model", "prompt", "completion", "cached")
    return c.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("cost_usd") * 1e6, 6).alias("cost_micro"), "unknown")


@query("jn19_docs_with_text_join", f"""WITH {CATALOG} SELECT path, entity, CASE WHEN doc_id % 6 = 0 THEN '' ELSE lang END AS category,
  CASE WHEN doc_id % 6 = 0 THEN doc_id || '.txt' ELSE 'doc ' || doc_id END AS title, md5(text) AS body_md5 FROM catalog WHERE sidecar""")
def _(t):
    c = t.catalog
    meta = c.filter("doc_id % 6 <> 0").select("path", "entity", F.col("lang").alias("category"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    return jn.docs_with_text(meta, c.filter("sidecar").select("path", F.col("text").alias("body"))).select(
        "path", "entity", "category", "title", F.md5("body").alias("body_md5"))


@query("jn20_spend_join", """WITH a AS (SELECT strftime(f, '%Y-%m') AS month, count(*) AS n FROM (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) GROUP BY 1),
s AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(l_extendedprice * l_tax) AS spend FROM lineitem GROUP BY 1)
SELECT month, n AS customers_acquired, round(spend, 2) AS total_spend, round(spend / n, 2) AS cac FROM a JOIN s USING (month)""")
def _(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("f")).select(F.date_format("f", "yyyy-MM").alias("month"))
    spend = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_extendedprice") * F.col("l_tax")).alias("spend"))
    return jn.spend_join(first, spend).select("month", "customers_acquired", F.round("total_spend", 2).alias("total_spend"), F.round("cac", 2).alias("cac"))
