"""Queries over near-duplicates, clusters and claim trust."""
from pyspark.sql import functions as F

from tallywright.functions import fixed, text as tx
from tallywright.operators import clusters as cl
from tallywright.plans.registry import query
from tallywright.plans.tables import DOC_LEDGER, LEDGER, NOW_EVENTS, NOW_E, Tables, sql_tokens, sql_word, ts
from tallywright.session import cut_lineage

# All pairs by shared token counts, without any prefix rule.
PAIRS = f"""tok AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents), inv AS (SELECT doc_id, unnest(toks) AS w FROM tok),
size AS (SELECT doc_id, len(toks) AS n FROM tok),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM inv a JOIN inv b ON a.w = b.w AND b.doc_id < a.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y, s / (p.n + q.n - s) AS j FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y)"""
VALS = f"vals AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, {sql_word(fixed.VALUE_TOKEN)}), lambda v: regexp_replace(v, '[,$]', '', 'g')))) AS v FROM documents)"
GONE = "y NOT IN (SELECT doc_id - 3 FROM documents WHERE doc_id % 4 = 0)"
NEAR = f"near AS (SELECT x, arg_min(y, (-j, y)) AS y, max(j) AS j FROM pairs WHERE j >= CAST(0.8 AS DOUBLE) AND {GONE} GROUP BY x)"
CONTRA = f"contra AS (SELECT x, min(y) AS y, arg_min(j, y) AS j FROM pairs JOIN vals a ON a.doc_id = x JOIN vals b ON b.doc_id = y WHERE j >= CAST(0.6 AS DOUBLE) AND len(a.v) > 0 AND len(b.v) > 0 AND a.v <> b.v AND {GONE} GROUP BY x)"


@query("cl01_near_duplicate", f"WITH {PAIRS}, {NEAR} SELECT CAST(x AS VARCHAR) AS id, CAST(y AS VARCHAR) AS match_id, round(j, 6) AS score FROM near")
def _(t):
    return cl.near_duplicate(t.doc_ledger, ["ts", "id"]).withColumn("score", F.round("score", 6))


# Documents with a price that changes from one to the next, so that similar ones contradict each other.
PRICED = "priced AS (SELECT doc_id, text || ' costs ' || (doc_id % 3 * 10 + 15) || ' dollars' AS text FROM documents)"
PAIRS_P, VALS_P = (x.replace("FROM documents)", "FROM priced)") for x in (PAIRS, VALS))


def priced(t: Tables):
    return t.doc_ledger.withColumn("text", F.concat("text", F.lit(" costs "), (F.col("doc_id") % 3 * 10 + 15).cast("string"), F.lit(" dollars")))


@query("cl02_value_contradiction", f"WITH {PRICED}, {PAIRS_P}, {VALS_P}, {CONTRA} SELECT CAST(x AS VARCHAR) AS id, CAST(y AS VARCHAR) AS match_id, round(j, 6) AS subject_score FROM contra")
def _(t):
    return cl.value_contradiction(priced(t), ["ts", "id"]).withColumn("subject_score", F.round("subject_score", 6))


@query("cl03_write_advisory", f"""WITH {PRICED}, {PAIRS_P}, {VALS_P}, {NEAR}, {CONTRA} SELECT CAST(d.doc_id AS VARCHAR) AS id,
  CASE WHEN c.y IS NOT NULL THEN 'contradiction' WHEN n.y IS NOT NULL THEN 'near_duplicate' ELSE 'none' END AS advice,
  CAST(coalesce(c.y, n.y) AS VARCHAR) AS match_id, CASE WHEN c.y IS NULL THEN CAST(round(n.j * 100) AS BIGINT) END AS similarity_pct
FROM documents d LEFT JOIN contra c ON c.x = d.doc_id LEFT JOIN near n ON n.x = d.doc_id""")
def _(t):
    return cl.write_advisory(priced(t), ["ts", "id"])


def greedy_sql(rows: str, threshold: float) -> str:
    """Greedy leaders by walking each scope in order: the state is the list of leaders so far. ``rows`` gives (scope, rn, id, toks)."""
    return f"""{rows}, inv AS (SELECT scope, rn, unnest(toks) AS w FROM o),
shared AS (SELECT a.scope, a.rn AS x, b.rn AS y, count(*) AS s FROM inv a JOIN inv b ON a.scope = b.scope AND a.w = b.w AND b.rn < a.rn GROUP BY ALL),
sim AS (SELECT shared.scope AS scope, x, list(y) AS ys FROM shared JOIN o p ON p.scope = shared.scope AND p.rn = x JOIN o q ON q.scope = shared.scope AND q.rn = y WHERE s / (len(p.toks) + len(q.toks) - s) >= CAST({threshold} AS DOUBLE) GROUP BY 1, 2),
step AS (SELECT o.scope, o.rn, coalesce(ys, CAST([] AS BIGINT[])) AS ys FROM o LEFT JOIN sim ON sim.scope = o.scope AND sim.x = o.rn),
walk AS (SELECT scope, rn, [rn] AS heads, rn AS lead FROM step WHERE rn = 1
  UNION ALL SELECT scope, rn, CASE WHEN l IS NULL THEN list_append(heads, rn) ELSE heads END, coalesce(l, rn) FROM (
    SELECT s.scope, s.rn, w.heads, list_min(list_intersect(w.heads, s.ys)) AS l FROM walk w JOIN step s ON s.scope = w.scope AND s.rn = w.rn + 1)),
led AS (SELECT m.id, m.scope, h.id AS leader_id FROM walk JOIN o m ON m.scope = walk.scope AND m.rn = walk.rn JOIN o h ON h.scope = walk.scope AND h.rn = walk.lead)"""


def _docs_sql(scope: str) -> str:
    return f"o AS (SELECT CAST(doc_id AS VARCHAR) AS id, {scope} AS scope, row_number() OVER (PARTITION BY {scope} ORDER BY doc_id) AS rn, {sql_tokens('text')} AS toks FROM documents)"


def _ledger_sql(scope: str) -> str:
    return f"{LEDGER}, o AS (SELECT id, {scope} AS scope, row_number() OVER (PARTITION BY {scope} ORDER BY ts, id) AS rn, {sql_tokens('text')} AS toks FROM ledger)"


@query("cl04_leader_clusters", f"WITH RECURSIVE {greedy_sql(_docs_sql('source'), 0.5)} SELECT id, scope AS agent, leader_id FROM led")
def _(t):
    return cl.leader_clusters(t.doc_ledger, ["ts", "id"], scope=("agent",), threshold=0.5).select("id", "agent", "leader_id")


@query("cl05_subject_partitions", f"""WITH RECURSIVE {greedy_sql(_docs_sql("'all'"), 0.35)}, n AS (SELECT leader_id, count(*) AS size FROM led GROUP BY 1)
SELECT id, 'cluster-' || leader_id AS subject, size, CASE WHEN size < 2 THEN 'single' WHEN size > 40 THEN 'oversized' ELSE 'kept' END AS outcome FROM led JOIN n USING (leader_id)""")
def _(t):
    c = cl.leader_clusters(t.doc_ledger, ["ts", "id"], scope=(), threshold=0.35)
    return cl.subject_partitions(c).select("id", "subject", "size", "outcome")


@query("cl06_group_assertions", f"""WITH RECURSIVE {greedy_sql(_ledger_sql('ekey'), 0.5)}, n AS (SELECT scope, leader_id, count(*) AS c, min(o.rn) AS f FROM led JOIN o USING (id, scope) GROUP BY ALL),
w AS (SELECT scope, leader_id AS claim_id FROM n QUALIFY row_number() OVER (PARTITION BY scope ORDER BY c DESC, f) = 1)
SELECT id, scope AS ekey, leader_id, claim_id, CASE WHEN leader_id = claim_id THEN 'assertion' ELSE 'contradiction' END AS role FROM led JOIN w USING (scope)""")
def _(t):
    c = cl.leader_clusters(t.ledger, ["ts", "id"], scope=("ekey",), threshold=0.5)
    return cl.group_assertions(c, ["ekey"], ["ts", "id"]).select("id", "ekey", "leader_id", "claim_id", "role")


TRUST_SQL = f"""{LEDGER}, a AS (SELECT ekey, agent, ts, id, CASE WHEN type = 'correction' THEN 'contradiction' ELSE 'assertion' END AS role,
    CASE WHEN event_id % 7 = 0 THEN 1.0 WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS conf FROM ledger),
one AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ekey, role, agent ORDER BY ts DESC, id DESC) = 1),
w AS (SELECT *, conf * pow(0.5, greatest((epoch_us({NOW_E}) - epoch_us(ts)) / 8.64e10, 0) / 30) AS w FROM one),
g AS (SELECT ekey, count(*) FILTER (role = 'assertion') AS distinct_agents, count(*) FILTER (role <> 'assertion') AS contradicting_agents,
    sum(CASE WHEN role = 'assertion' THEN w ELSE 0 END) AS sw, sum(CASE WHEN role <> 'assertion' THEN w ELSE 0 END) AS sc, max(CASE WHEN role = 'assertion' THEN ts END) AS newest FROM w GROUP BY ekey),
s AS (SELECT g.*, greatest(0, least(1, 1 - pow(0.5, sw) - 0.6 * sc)) AS trust, (SELECT count(*) FROM a WHERE a.ekey = g.ekey AND role = 'assertion') AS corroborations FROM g),
scored AS (SELECT ekey, corroborations, distinct_agents, contradicting_agents, round(trust, 6) AS trust, CASE WHEN contradicting_agents > 0 AND (contradicting_agents >= distinct_agents OR trust <= 0.55) THEN 'contested'
    WHEN distinct_agents >= 3 THEN 'durable' WHEN distinct_agents >= 2 THEN 'corroborated' ELSE 'unverified' END AS status,
    CAST(round((epoch_us({NOW_E}) - epoch_us(newest)) / 8.64e10) AS BIGINT) AS newest_age_days FROM s)"""


def scored(t: Tables, filters: str | None = None):
    """Ledger keys as claims; corrections contradict."""
    conf = cl.confidence(F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "med").otherwise("low"))
    l = t.ledger.withColumn("role", F.when(F.col("type") == "correction", "contradiction").otherwise("assertion")).withColumn("confidence", F.when(F.col("event_id") % 7 != 0, conf))
    return cl.score_claim(l if filters is None else l.filter(filters), ["ekey"], ts(NOW_EVENTS)).withColumn("trust", F.round("trust", 6))


@query("cl07_score_claim", f"WITH {TRUST_SQL} SELECT * FROM scored")
def _(t):
    return scored(t).orderBy(F.desc("trust"), "ekey")


_CLEAN = TRUST_SQL.replace("::DOUBLE AS conf FROM ledger)", "::DOUBLE AS conf FROM ledger WHERE type IN ('fact', 'decision'))")


@query("cl07_score_claim_uncontested", f"WITH {_CLEAN} SELECT * FROM scored")
def _(t):
    return scored(t, "type IN ('fact', 'decision')")


@query("cl08_promotion", f"""WITH {_CLEAN}
SELECT ekey, status = 'durable' AND trust >= 0.75 AS promote, CASE WHEN status = 'durable' AND trust >= 0.75 THEN 'semantic/durable' ELSE status END AS to_status FROM scored""")
def _(t):
    return cl.promotion(scored(t, "type IN ('fact', 'decision')")).select("ekey", "promote", "to_status")


@query("cl09_contested_groups")
def _(t):
    from tallywright.operators.filters import deny_rule_filter
    rows = deny_rule_filter(t.doc_ledger, ["src3"], ["license"]).select("id", "agent", "ts", "text")
    return cl.contested_groups(rows, ["ts", "id"], ts(NOW_EVENTS), evidence_rows=True)


@query("cl11_compact_ledger")
def _(t):
    from tallywright.operators.ledger import compact_ledger
    return compact_ledger(t.ledger.withColumn("evalue", F.col("text")), ts(NOW_EVENTS))


@query("cl11_value_history", f"""WITH {LEDGER}, c AS (SELECT id, text, row_number() OVER (PARTITION BY ekey ORDER BY ts, event_id) AS position, count(*) OVER (PARTITION BY ekey) AS n,
  last_value(id) OVER (PARTITION BY ekey ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM ledger WHERE type = 'entity') SELECT head, position, id, 'now ' || text AS value FROM c WHERE n > 1""")
def _(t):
    from tallywright.operators.ledger import value_history
    return value_history(t.ledger.withColumn("evalue", F.concat(F.lit("now "), "text"))).select("head", "position", "id", "value")


@query("cl12_memory_diff", f"""WITH {LEDGER}, n AS (SELECT supersedes AS s, arg_max(id, (ts, id)) AS by_id, max(ts) AS by_ts FROM ledger WHERE supersedes IS NOT NULL GROUP BY 1),
r AS (SELECT l.id, l.ts >= TIMESTAMP '2024-01-15' AND l.ts <= {NOW_E} AS here, l.supersedes IS NOT NULL AND EXISTS (SELECT 1 FROM ledger o WHERE o.id = l.supersedes) AS sup,
  n.by_id, n.by_ts >= TIMESTAMP '2024-01-15' AS gone_here FROM ledger l LEFT JOIN n ON n.s = l.id),
d AS (SELECT id, CASE WHEN sup AND here THEN 'changed' WHEN by_id IS NOT NULL AND gone_here AND NOT here THEN 'retired' WHEN here THEN 'added' WHEN by_id IS NULL THEN 'still_true' END AS state, by_id FROM r)
SELECT d.id, state, CASE WHEN state = 'retired' THEN by_id END AS retired_by, CASE WHEN state = 'changed' THEN first_id END AS was, CASE WHEN state = 'changed' THEN place END AS place
FROM d JOIN (SELECT id, first_value(id) OVER w AS first_id, row_number() OVER w AS place FROM ledger WINDOW w AS (PARTITION BY type, ekey ORDER BY ts, event_id)) c ON c.id = d.id WHERE state IS NOT NULL""")
def _(t):
    return cl.memory_diff(t.ledger, ts("2024-01-15 00:00:00"), ts(NOW_EVENTS)).select("id", "state", "retired_by", "was", "place")


@query("cl12_memory_diff_chains", f"""WITH {LEDGER}, c AS (SELECT id, ts, type, ekey, row_number() OVER w AS position, count(*) OVER (PARTITION BY type, ekey) AS chain_length, last_value(id) OVER (PARTITION BY type, ekey ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head
  FROM ledger WHERE type IN ('entity', 'correction') WINDOW w AS (PARTITION BY type, ekey ORDER BY ts, event_id)),
h AS (SELECT id FROM c WHERE id = head AND position > 1 AND ts >= TIMESTAMP '2024-01-15' AND ts <= {NOW_E}) SELECT head, c.id, position, chain_length FROM c JOIN h ON h.id = c.head""")
def _(t):
    rows = cut_lineage(t.ledger)
    return cl.memory_diff_chains(rows, cl.memory_diff(rows, ts("2024-01-15 00:00:00"), ts(NOW_EVENTS)))


@query("cl13_recurring_clusters", f"WITH RECURSIVE {greedy_sql(_ledger_sql('agent'), 0.5)} SELECT scope AS agent, leader_id, count(*) AS count, count(*) >= 2 AS recurring FROM led WHERE scope <> 'a3' GROUP BY ALL")
def _(t):
    c = cl.leader_clusters(t.ledger, ["ts", "id"], scope=("agent",), threshold=0.5)
    return cl.recurring_clusters(c, ["a3"])


@query("cl14_hard_negative_pairs", rf"""WITH {LEDGER}, p AS (SELECT o.id AS old_id, n.id AS new_id, o.agent AS oa, n.agent AS na, n.type AS nt, o.text AS ot, n.text AS nx, {sql_tokens('o.text')} AS a, {sql_tokens('n.text')} AS b FROM ledger o JOIN ledger n ON n.supersedes = o.id),
q AS (SELECT *, len(list_intersect(a, b)) AS s FROM p), j AS (SELECT *, s / (len(a) + len(b) - s) AS jaccard FROM q)
SELECT old_id, new_id, round(jaccard, 6) AS jaccard, CASE WHEN oa = 'a2' OR na = 'a2' THEN 'unsafe_agent' WHEN nt IN ('status', 'episode', 'heartbeat', 'digest') THEN 'exhaust_type'
  WHEN regexp_matches(ot || ' ' || nx, '\bk13\b') THEN 'denied_content' WHEN regexp_matches(ot, 'bucket [01]') AND regexp_matches(nx, 'bucket [01]') THEN 'progress_chatter'
  WHEN jaccard > 0.55 THEN 'near_duplicate' WHEN jaccard < 0.03 THEN 'unrelated' ELSE 'eligible' END AS reason FROM j""")
def _(t):
    return cl.hard_negative_pairs(t.ledger, ["a2"], ["k13"], "bucket [01]").withColumn("jaccard", F.round("jaccard", 6))


def _rerank_sql() -> str:
    from tallywright.plans.q_search import _ONE, BM_TOP, bm25_sql
    rows = f"o AS (SELECT h.id AS id, h.query_id AS scope, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS rn, {sql_tokens('d.text')} AS toks FROM hits h JOIN documents d ON d.doc_id = h.id)"
    return f"""WITH RECURSIVE {bm25_sql(_ONE)}, {BM_TOP.format(k=10)}, {greedy_sql(rows, 0.5)},
ag AS (SELECT led.scope AS scope, led.leader_id AS leader_id, d.source AS agent, max(d.doc_id) AS newest FROM led JOIN documents d ON d.doc_id = led.id GROUP BY ALL),
sc AS (SELECT scope, leader_id, count(*) AS n, sum(pow(0.5, greatest((epoch_us({NOW_E}) - epoch_us(TIMESTAMP '2024-01-01' + to_hours(CAST(newest AS INTEGER)))) / 8.64e10, 0) / 30)) AS w FROM ag GROUP BY ALL),
standing AS (SELECT *, greatest(0, least(1, 1 - pow(0.5, w))) AS trust, CASE WHEN n >= 3 THEN 'durable' WHEN n >= 2 THEN 'corroborated' ELSE 'unverified' END AS status FROM sc)
SELECT led.scope AS query_id, led.id AS id, CAST(o.rn AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY led.scope ORDER BY CASE status WHEN 'durable' THEN 0 WHEN 'corroborated' THEN 1 ELSE 2 END, o.rn) AS INTEGER) AS new_rank, status, round(trust, 6) AS trust
FROM led JOIN o ON o.scope = led.scope AND o.id = led.id JOIN standing ON standing.scope = led.scope AND standing.leader_id = led.leader_id"""


@query("cl10_trust_rerank", _rerank_sql())
def _(t):
    from tallywright.operators.search import with_documents
    from tallywright.plans.q_search import hits_df
    d = t.doc_ledger.select(F.col("doc_id").alias("id"), "agent", "ts", "text")
    h = with_documents(hits_df(t), d)
    return cl.trust_rerank(h, ts(NOW_EVENTS)).select("query_id", "id", "rank", "new_rank", "status", F.round("trust", 6).alias("trust"))
