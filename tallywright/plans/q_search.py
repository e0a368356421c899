"""Queries over retrieval and its evaluation."""
from pyspark.sql import functions as F

from tallywright.functions import fixed, text as tx
from tallywright.operators import evals as ev, search as vs
from tallywright.plans.registry import query
from tallywright.plans.tables import Tables
from tallywright.session import cut_lineage

_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


def sql_list(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({e}, '')), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"


def bm25_sql(fields: str, scope: str = "") -> str:
    """BM25 in the oracle's dialect; ``fields`` is a UNION of (scope, id, field, boost, toks)."""
    s = f"{scope}, " if scope else ""
    using = f"({s}field)"
    return f"""qt AS (SELECT DISTINCT item_id AS query_id, unnest({sql_list('text')}) AS token FROM benchmark),
ft AS ({fields}), st AS (SELECT {s}field, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM ft GROUP BY ALL),
tf AS (SELECT {s}id, field, boost, len(toks) AS dl, unnest(toks) AS token FROM ft), tc AS (SELECT {s}id, field, boost, dl, token, count(*) AS tf FROM tf WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
dc AS (SELECT {s}field, token, count(*) AS df FROM tc GROUP BY ALL),
wt AS (SELECT {s}id, field, token, boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len)) AS w FROM tc JOIN dc USING ({s}field, token) JOIN st USING {using}),
fs AS (SELECT query_id, {s}id, field, sum(w) AS s FROM wt JOIN qt USING (token) GROUP BY ALL), bm AS (SELECT query_id, {s}id, max(s) AS score FROM fs GROUP BY ALL)"""


_TWO = f"SELECT doc_id AS id, 'title' AS field, 2.0 AS boost, {sql_list('string_split(text, chr(10))[1]')} AS toks FROM documents UNION ALL SELECT doc_id, 'text', 1.0, {sql_list('text')} FROM documents"
_ONE = f"SELECT doc_id AS id, 'text' AS field, 1.0 AS boost, {sql_list('text')} AS toks FROM documents"
_BY_LANG = f"SELECT lang AS room, doc_id AS id, 'text' AS field, 1.0 AS boost, {sql_list('text')} AS toks FROM documents"
BM_TOP = "hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= {k})"
CENT = """cp AS (SELECT label, i, avg(embedding[i]) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL),
cent AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM cp GROUP BY label),
kn AS (SELECT query_id, vec_id AS id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), v) AS score FROM embeddings, cent)"""


def queries_df(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), tx.token_list(F.col("text")).alias("terms"))


def docs_df(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), "text", "lang")


def vectors_df(t: Tables):
    """The vectors, and two that no search may return or stumble over: one that is null and one with a component that is not a number."""
    bad = t.spark.range(2).select((-1 - F.col("id")).alias("id"), F.when(F.col("id") == 0, F.array(*[F.lit(float("nan"))] * 64)).cast("array<float>").alias("vector"), F.lit(0).alias("label"))
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label").unionByName(bad)


def centroids(t: Tables):
    """One query vector per label: the mean of its vectors."""
    long = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return long.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))


def hits_df(t: Tables, k: int = 10):
    return vs.bm25_search(queries_df(t), docs_df(t), {"text": 1.0}, k)


@query("vs01_bm25_search", f"WITH {bm25_sql(_TWO)}, {BM_TOP.format(k=10)} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def _(t):
    return vs.bm25_search(queries_df(t), docs_df(t), {"title": 2.0, "text": 1.0}, 10).withColumn("score", F.round("score", 6))


@query("vs02_knn_search", f"WITH {CENT} SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM kn QUALIFY rank <= 10")
def _(t):
    return vs.knn_search(centroids(t), vectors_df(t), 10).withColumn("score", F.round("score", 6))


@query("vs03_rrf_fusion", f"""WITH {CENT}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM kn QUALIFY rank <= 20),
q AS (SELECT query_id, vec_id AS id, list_cosine_similarity(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 127) / 127), v) AS score FROM embeddings, cent),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM q QUALIFY rank <= 20)
SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def _(t):
    a = vs.knn_search(centroids(t), vectors_df(t), 20)
    b = vs.knn_search(centroids(t), vectors_df(t).withColumn("vector", vs.quantize(F.col("vector"))), 20)
    return vs.rrf_fusion([a, b]).withColumn("score", F.round("score", 9))


_LAB = "(SELECT count(DISTINCT label) FROM embeddings)"


@query("vs04_hybrid_search", f"""WITH {bm25_sql(_ONE)}, {BM_TOP.format(k=30)}, {CENT},
kt AS (SELECT query_id AS label, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM kn QUALIFY rank <= 30),
qk AS (SELECT item_id AS query_id, id, rank FROM benchmark JOIN kt ON label = item_id % 10),
f AS (SELECT query_id, id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM hits UNION ALL SELECT query_id, id, rank FROM qk) GROUP BY ALL)
SELECT query_id, id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def _(t):
    c = centroids(t).withColumnRenamed("query_id", "label")
    qv = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).cast("int").alias("label")).join(c, "label").select("query_id", "vector")
    return vs.hybrid_search(queries_df(t), docs_df(t), {"text": 1.0}, vectors_df(t), qv, 10).withColumn("score", F.round("score", 9))


_TURNS = f"SELECT conv_id || '-' || turn AS id, 'text' AS field, 1.0 AS boost, {sql_list('text')} AS toks FROM conversations"


@query("vs05_collapse_parents", f"""WITH {bm25_sql(_TURNS)}, {BM_TOP.format(k=50)}, h AS (SELECT query_id, id, round(score, 9) AS score, CAST(string_split(id, '-')[1] AS BIGINT) AS parent_id, CAST(string_split(id, '-')[2] AS BIGINT) AS turn FROM hits),
b AS (SELECT query_id, parent_id, arg_max(id, (score, -turn)) AS id, max(score) AS score FROM h GROUP BY ALL)
SELECT query_id, parent_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 15""")
def _(t):
    turns = t.conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("long").alias("parent_id"), F.col("turn").alias("ordinal"), "text")
    h = vs.with_documents(vs.bm25_search(queries_df(t), turns, {"text": 1.0}, 50), turns.drop("text")).withColumn("score", F.round("score", 9))
    return vs.collapse_parents(h, 15).withColumn("score", F.round("score", 6))


_FED = f"WITH {bm25_sql(_BY_LANG, 'room')}, rh AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id, room ORDER BY round(score, 9) DESC, id) <= 10)"


@query("vs06_federated_search", _FED + " SELECT query_id, room, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, room, id) AS INTEGER) AS rank FROM rh QUALIFY rank <= 14")
def _(t):
    rooms = vs.bm25_search(queries_df(t), docs_df(t).withColumnRenamed("lang", "room"), {"text": 1.0}, 10, ["room"]).drop("rank")
    return vs.federated_search(rooms).withColumn("score", F.round("score", 6))


@query("vs06_search_outcome", _FED + " SELECT (SELECT count(DISTINCT lang) FROM documents) AS attempted, (SELECT count(DISTINCT lang) FROM documents WHERE lang = 'de') AS failed, (SELECT count(*) FROM rh WHERE room <> 'de') AS hits, 'partial' AS verdict")
def _(t):
    hits = vs.bm25_search(queries_df(t), docs_df(t).filter("lang <> 'de'").withColumnRenamed("lang", "room"), {"text": 1.0}, 10, ["room"])
    return vs.search_outcome(t.documents.select(F.col("lang").alias("room")).distinct().withColumn("failed", F.col("room") == "de"), hits)


@query("vs07_quantization_parity", f"""WITH {CENT}, q AS (SELECT query_id, vec_id AS id, list_cosine_similarity(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 127) / 127), v) AS score FROM embeddings, cent),
a AS (SELECT query_id, list(id) AS ids FROM (SELECT query_id, id FROM kn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10) GROUP BY 1),
b AS (SELECT query_id, list(id) AS ids FROM (SELECT query_id, id FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10) GROUP BY 1),
o AS (SELECT a.query_id, round(len(list_intersect(a.ids, b.ids)) / 10 * 10000) / 100 AS overlap_pct FROM a JOIN b ON a.query_id = b.query_id)
SELECT query_id, overlap_pct, CAST(0 AS BIGINT) AS fields_differ, overlap_pct >= 90 AS ok FROM o""")
def _(t):
    v = vectors_df(t)
    return vs.quantization_parity(v, v.withColumn("vector", vs.quantize(F.col("vector"))), centroids(t), 10, other=["label"])


@query("vs08_find_thin_pack", f"""WITH {bm25_sql(_ONE)}, {BM_TOP.format(k=50)}, sem AS (SELECT h.query_id, h.id, d.text, round(h.score, 9) AS score, contains(lower(d.text), lower(b.text)) AS here
  FROM hits h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id),
have AS (SELECT query_id, count(*) FILTER (here) AS n FROM sem GROUP BY 1)
SELECT s.query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, id) AS INTEGER) AS slot FROM sem s JOIN have ON have.query_id = s.query_id
WHERE n < 3 AND trim(text) <> '' AND id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM sem o WHERE o.query_id = s.query_id AND o.here AND lower(o.text) = lower(s.text)) QUALIFY slot <= 3""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), "text")
    wanted = t.benchmark.select(F.col("item_id").alias("query_id"), F.lower("text").alias("wanted"))
    hits = vs.with_documents(vs.bm25_search(queries_df(t), docs_df(t), {"text": 1.0}, 50), d).join(wanted, "query_id")
    hits = cut_lineage(hits.select("query_id", "id", "text", F.round("score", 9).alias("score"), (F.col("id") % 9 == 0).alias("retracted"), F.contains(F.lower("text"), F.col("wanted")).alias("here")))
    return vs.thin_pack_fill(hits.filter("here"), hits.drop("here")).select("query_id", "id", F.round("score", 6).alias("score"), "slot")


# Evaluation of the keyword list: a document is relevant when it contains the benchmark text.
_EV = f"""WITH {bm25_sql(_ONE)}, {BM_TOP.format(k=10)}, marked AS (SELECT h.query_id, h.id, h.rank, contains(lower(d.text), lower(b.text)) AS relevant
  FROM hits h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id),
met AS (SELECT b.item_id AS query_id, coalesce(count(*) FILTER (rank <= 5 AND relevant) / nullif(count(*) FILTER (rank <= 5), 0), 0) AS precision,
  max(CASE WHEN rank <= 5 AND relevant THEN 1 ELSE 0 END) AS hit, coalesce(1 / min(CASE WHEN relevant THEN rank END), 0) AS rr FROM benchmark b LEFT JOIN marked m ON m.query_id = b.item_id GROUP BY 1)"""


def marked(t: Tables):
    h = vs.with_documents(hits_df(t), t.documents.select(F.col("doc_id").alias("id"), "text"))
    expect = t.benchmark.select(F.col("item_id").alias("query_id"), F.array(F.col("text")).alias("expect"))
    return ev.relevance_match(h, expect)


def metrics(t: Tables):
    return ev.query_metrics(marked(t), t.benchmark.select(F.col("item_id").alias("query_id")), 5)


@query("ev01_relevance_match", _EV + " SELECT query_id, id, CAST(rank AS INTEGER) AS rank, relevant FROM marked")
def _(t):
    return marked(t).select("query_id", "id", "rank", "relevant")


@query("ev02_precision_at_k", _EV + " SELECT query_id, round(precision, 6) AS precision FROM met")
def _(t):
    return metrics(t).select("query_id", F.round("precision", 6).alias("precision"))


@query("ev03_hit_at_k", _EV + " SELECT query_id, hit FROM met")
def _(t):
    return metrics(t).select("query_id", "hit")


@query("ev04_reciprocal_rank", _EV + " SELECT query_id, round(rr, 6) AS rr FROM met")
def _(t):
    return metrics(t).select("query_id", F.round("rr", 6).alias("rr"))


@query("ev04_retrieval_summary", _EV + " SELECT count(*) AS n, round(avg(precision), 6) AS mean_precision, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM met")
def _(t):
    s = ev.retrieval_summary(metrics(t))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean_precision", "hit_rate", "mrr")])


_HN = f"""WITH {bm25_sql(_ONE)}, {BM_TOP.format(k=10)}, c AS (SELECT h.query_id, max(CASE WHEN contains(lower(d.text), lower(b.text)) THEN 1 ELSE 0 END) AS n,
  max(CASE WHEN contains(lower(d.text), lower(o.text)) THEN 1 ELSE 0 END) AS l FROM hits h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id
  JOIN benchmark o ON o.item_id = (h.query_id + 1) % (SELECT count(*) FROM benchmark) WHERE rank <= 5 GROUP BY 1),
s AS (SELECT b.item_id AS query_id, coalesce(n, 0) AS new_hit, coalesce(l, 0) AS old_leak, CASE WHEN n = 1 AND l = 0 THEN 1 ELSE 0 END AS passed FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id)"""


def hard_negatives(t: Tables):
    h = vs.with_documents(hits_df(t), t.documents.select(F.col("doc_id").alias("id"), "text"))
    b = t.benchmark
    n = b.agg(F.count("*").alias("c")).scalar()
    new = b.select(F.col("item_id").alias("query_id"), F.array(F.col("text")).alias("expect_new")).withColumn("_n", n).withColumn("_o", (F.col("query_id") + 1) % F.col("_n"))
    old = b.select(F.col("item_id").alias("_o"), F.array(F.col("text")).alias("expect_old"))
    return ev.hard_negative_score(h, new.join(old, "_o").select("query_id", "expect_new", "expect_old"), 5)


@query("ev06_hard_negative_score", _HN + " SELECT * FROM s")
def _(t):
    return hard_negatives(t)


@query("ev06_hard_negative_summary", _HN + " SELECT count(*) AS n, round(avg(new_hit), 6) AS correct_rate, round(avg(old_leak), 6) AS leak_rate, round(avg(passed), 6) AS pass_rate FROM s")
def _(t):
    s = ev.hard_negative_summary(hard_negatives(t))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("correct_rate", "leak_rate", "pass_rate")])


@query("ev14_probe_drift", _FED + """, p AS (SELECT b.item_id, r.room, coalesce(max(score), 0) AS top, count(score) AS n FROM benchmark b CROSS JOIN (SELECT DISTINCT lang AS room FROM documents) r LEFT JOIN rh ON rh.query_id = b.item_id AND rh.room = r.room GROUP BY ALL),
g AS (SELECT room AS "index", avg(top) AS top_score, avg(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS coverage, avg(n) AS hits FROM p GROUP BY room)
SELECT "index", round(top_score, 6) AS top_score, round(coverage, 6) AS coverage, round(hits, 6) AS hits, "index" <> 'es' AS has_baseline, "index" = 'de' AS drifted FROM g""")
def _(t):
    rooms = vs.bm25_search(queries_df(t), docs_df(t).withColumnRenamed("lang", "room"), {"text": 1.0}, 10, ["room"])
    per = rooms.groupBy("query_id", "room").agg(F.max("score").alias("top_score"), F.count("*").alias("hit_count"))
    langs = t.documents.select(F.col("lang").alias("index")).distinct()
    # Every benchmark query probes every room; the rooms are the few languages.
    names = langs.agg(F.collect_set("index").alias("r")).scalar()
    asked = t.benchmark.select(F.col("item_id").alias("query_id")).withColumn("_r", names).select("query_id", F.explode("_r").alias("room"))
    probes = asked.join(per, ["query_id", "room"], "left").select("query_id", F.col("room").alias("index"), "top_score", F.coalesce("hit_count", F.lit(0)).alias("hit_count"))
    base = langs.filter("index <> 'es'").select("index", F.when(F.col("index") == "de", 1e9).otherwise(0.0).alias("top_score"), F.lit(0.0).alias("coverage"))
    d = ev.probe_drift(probes, base)
    return d.select("index", *[F.round(c, 6).alias(c) for c in ("top_score", "coverage", "hits")], "has_baseline", "drifted")
