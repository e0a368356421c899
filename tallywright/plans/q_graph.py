"""Queries over aliases, chains, walks and cycles."""
from pyspark.sql import functions as F

from tallywright.operators import graph as gr
from tallywright.plans.registry import query
from tallywright.plans.tables import LEDGER, Tables


@query("gr01_alias_resolve", """WITH RECURSIVE w(key, cur, i) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT key, cur // 2, i + 1 FROM w WHERE cur % 2 = 1)
SELECT CAST(key AS VARCHAR) AS key, CAST(min(cur) AS VARCHAR) AS target FROM w GROUP BY key""")
def _(t):
    k = t.part.select(F.col("p_partkey").cast("string").alias("key"))
    a = t.part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").cast("string").alias("ekey"), F.floor(F.col("p_partkey") / 2).cast("string").alias("evalue"), F.col("p_size").alias("ts"), F.col("p_partkey").alias("id"))
    return gr.alias_resolve(k, a)


def edges(t: Tables):
    sn = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("seated_in").alias("relation"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    sp = t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.lit("supplied_by").alias("relation"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    nr = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("in").alias("relation"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return sp.unionByName(nr).unionByName(sn).distinct()


_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 'supplied_by' AS relation, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey FROM nation UNION SELECT 's' || s_suppkey, 'seated_in', 'n' || s_nationkey FROM supplier)"


@query("gr02_walk_graph", f"""WITH {_EDGES}, st AS (SELECT 'r' || r_regionkey AS start FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation), b AS (SELECT src AS node, dst AS other, * FROM e UNION ALL SELECT dst, src, * FROM e),
f AS (SELECT start, other, src, relation, dst, 1 AS depth FROM st JOIN b ON start = node), g AS (SELECT DISTINCT start, other AS node FROM f),
a AS (SELECT start, src, relation, dst, depth FROM f UNION ALL SELECT g.start, src, relation, dst, 2 FROM g JOIN b USING (node)) SELECT start, src, relation, dst, min(depth) AS depth FROM a GROUP BY ALL""")
def _(t):
    starts = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start")).unionByName(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start")))
    return gr.walk_graph(edges(t), starts)


@query("gr03_entity_inventory", f"""WITH {LEDGER}, r AS (SELECT id, ts, CASE WHEN event_id % 5 = 0 THEN 'alias' ELSE 'entity' END AS type, ekey, CASE WHEN event_id % 2 = 0 THEN 'k1' ELSE 'k99' END AS evalue, agent, supersedes FROM ledger WHERE type = 'entity'),
l AS (SELECT ekey, bool_or(p IS NOT NULL AND supersedes IS DISTINCT FROM p) AS forked FROM (SELECT *, lag(id) OVER (PARTITION BY type, ekey ORDER BY ts, id) AS p FROM r) GROUP BY 1),
o AS (SELECT ekey, bool_or(agent <> 'a1') AS unexpected_owner, bool_or(type = 'entity') AS present FROM r GROUP BY 1), al AS (SELECT ekey, arg_max(evalue, (ts, id)) = 'k99' AS bad FROM r WHERE type = 'alias' GROUP BY 1), ap AS (SELECT 'k' || i AS ekey FROM range(5, 25) t(i) UNION ALL SELECT 'k1')
SELECT coalesce(o.ekey, ap.ekey) AS ekey, ap.ekey IS NOT NULL AS approved, coalesce(present, false) AS present, coalesce(forked, false) AS forked, coalesce(unexpected_owner, false) AS unexpected_owner, coalesce(bad, false) AS bad_alias_target,
  coalesce(present, false) AND NOT coalesce(forked, false) AND NOT coalesce(unexpected_owner, false) AND NOT coalesce(bad, false) AS ok FROM o JOIN l USING (ekey) LEFT JOIN al USING (ekey) FULL JOIN ap ON ap.ekey = o.ekey""")
def _(t):
    r = t.ledger.filter("type = 'entity'").select("id", "ts", F.when(F.col("event_id") % 5 == 0, "alias").otherwise("entity").alias("type"), "ekey", F.when(F.col("event_id") % 2 == 0, "k1").otherwise("k99").alias("evalue"), "agent", "supersedes")
    ap = t.nation.select(F.concat(F.lit("k"), F.when(F.col("n_nationkey") < 5, 1).otherwise(F.col("n_nationkey")).cast("string")).alias("ekey"))
    return gr.entity_inventory(r, ap, "a1")


@query("gr04_supersede_chain", f"""WITH {LEDGER}, c AS (SELECT id, type, ekey, row_number() OVER (PARTITION BY type, ekey ORDER BY ts, event_id) AS position, count(*) OVER (PARTITION BY type, ekey) AS chain_length,
  last_value(id) OVER (PARTITION BY type, ekey ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM ledger WHERE type IN ('entity', 'correction')) SELECT head, id, position, chain_length FROM c""")
def _(t):
    rows = t.ledger.filter(F.col("type").isin("entity", "correction")).select("id", "supersedes")
    heads = rows.join(rows.select(F.col("supersedes").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_anti").select("id")
    return gr.supersede_chain(rows, heads)


@query("gr05_cycle_check", """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
f AS (SELECT src, dst FROM e UNION SELECT n_nationkey + 100, n_nationkey FROM nation UNION SELECT n_nationkey + 200, n_nationkey + 100 FROM nation),
reach(src, dst) AS (SELECT src, dst FROM f UNION SELECT r.src, f.dst FROM reach r JOIN f ON r.dst = f.src), c AS (SELECT src AS n FROM reach WHERE src = dst),
after AS (SELECT n FROM c UNION SELECT dst FROM reach WHERE src IN (SELECT n FROM c)), before AS (SELECT n FROM c UNION SELECT src FROM reach WHERE dst IN (SELECT n FROM c))
SELECT src, dst, src = dst AS self_edge FROM f WHERE src IN (SELECT n FROM after) AND dst IN (SELECT n FROM before)""")
def _(t):
    e = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    n = t.nation
    return gr.cycle_check(e.union(n.select(F.col("n_nationkey") + 100, "n_nationkey")).union(n.select(F.col("n_nationkey") + 200, F.col("n_nationkey") + 100)))


@query("gr06_entity_keys", r"""WITH d AS (SELECT doc_id, lower(text || ' see app-signing-key and x-token; not-a-thing') AS h FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN regexp_matches(h, '(^|[^a-z0-9])que la([^a-z0-9]|$)') THEN 'que_la' END, CASE WHEN regexp_matches(h, '(^|[^a-z0-9])license([^a-z0-9]|$)') THEN 'license' END, CASE WHEN regexp_matches(h, '(^|[^a-z0-9])in the([^a-z0-9]|$)') THEN 'in_the' END], lambda x: x IS NOT NULL)
  || list_filter(regexp_extract_all(h, '\b[a-z][a-z0-9]*(?:-[a-z0-9]+){1,5}\b'), lambda x: regexp_matches(x, '-(key|secret|token|id|url|endpoint|sa|p8|dsn)$')))), ',') AS keys FROM d""")
def _(t):
    return t.documents.select("doc_id", F.array_join(gr.entity_keys(F.concat("text", F.lit(" see app-signing-key and x-token; not-a-thing")), ["que la", "license", "in the"]), ",").alias("keys"))
