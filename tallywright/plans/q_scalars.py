"""Queries over scalar expressions."""
from pyspark.sql import functions as F

from tallywright.functions import text as tx
from tallywright.operators import scalars as sc
from tallywright.plans.q_clusters import VALS
from tallywright.plans.registry import query
from tallywright.plans.tables import NOW_O, NOW_ORDERS, sql_tokens, ts


@query("sc01_tokenize", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def _(t):
    d = t.documents.select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("sc02_jaccard", f"""WITH a AS (SELECT doc_id, {sql_tokens('text')} AS x, {sql_tokens('string_split(text, chr(10))[1]')} AS y FROM documents), s AS (SELECT *, len(list_intersect(x, y)) AS n FROM a)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE n / (len(x) + len(y) - n) END, 6) AS similarity FROM s""")
def _(t):
    first = F.element_at(F.split("text", "\n"), 1)
    return t.documents.select("doc_id", F.round(tx.jaccard(tx.tokens(F.col("text")), tx.tokens(first)), 6).alias("similarity"))


@query("sc03_value_tokens", f"WITH {VALS} SELECT doc_id, array_to_string(v, ' ') AS vals FROM vals")
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.value_tokens(F.col("text")), " ").alias("vals"))


@query("sc04_norm_key", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM part")
def _(t):
    return t.part.select("p_partkey", tx.norm_key(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("k"))


@query("sc05_stable_hash_ids", "SELECT doc_id, 'cfr_' || substr(sha256(source || '|doc|' || doc_id || '||' || lang || '|'), 1, 20) AS item_id FROM documents")
def _(t):
    none = F.lit(None)
    return t.documents.select("doc_id", sc.item_id(F.col("source"), F.lit("doc"), F.col("doc_id"), none, F.col("lang"), none).alias("item_id"))


@query("sc05_batch_id", "SELECT conv_id, 'batch_' || substr(sha256('2024-02-01|' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY CAST(turn AS VARCHAR))), 1, 16) AS batch_id FROM conversations GROUP BY conv_id")
def _(t):
    g = t.conversations.groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("ids"))
    return g.select("conv_id", sc.batch_id(F.col("ids"), F.lit("2024-02-01")).alias("batch_id"))


_STRIP = r"""regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li)>', chr(10), 'g')"""
for _i in range(3):
    _STRIP = f"regexp_replace({_STRIP}, '<[^>]*>', '', 'g')"
for _p, _to in (("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("&#39;", "''"), ("&quot;", '"'), ("(?i)&amp;", "&"), ("[ \\t]+", " "), ("\\n{2,}", "\n")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '{_to}', 'g')"


@query("sc06_strip_html", rf"SELECT page_id, md5(regexp_replace({_STRIP}, '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(sc.strip_html(F.col("html"))).alias("text_md5"))


_ASCII = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate(text, '‘’“”–—', '''''\"\"--'), '…', '...'), '\r?\n', ' ', 'g'), '[^\x20-\x7E]', '?', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')".replace('\\"', '"')


@query("sc07_ascii_cap", f"SELECT doc_id, CASE WHEN length(s) <= 200 THEN s ELSE substr(s, 1, 197) || '...' END AS capped FROM (SELECT doc_id, {_ASCII} AS s FROM documents)")
def _(t):
    return t.documents.select("doc_id", sc.ascii_cap(F.col("text"), 200).alias("capped"))


@query("sc08_coerce_enum", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' ELSE '2-High' END ELSE 'other' END AS p FROM orders")
def _(t):
    return t.orders.select("o_orderkey", sc.coerce_enum(F.col("o_orderpriority"), ["1-Urgent", "2-High"], "other").alias("p"))


_DATE = "CAST(1985 + o_orderkey % 130 AS VARCHAR) || '-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') || ' x'"


@query("sc09_valid_date", f"SELECT o_orderkey, CASE WHEN try_cast(substr(d, 1, 10) AS DATE) IS NOT NULL AND CAST(substr(d, 1, 4) AS INT) BETWEEN 1990 AND 2100 THEN substr(d, 1, 10) || 'T00:00:00.000Z' ELSE '' END AS d FROM (SELECT o_orderkey, {_DATE} AS d FROM orders)")
def _(t):
    k = F.col("o_orderkey")
    d = F.concat_ws("-", (k % 130 + 1985).cast("string"), F.lpad((k % 14).cast("string"), 2, "0"), F.concat(F.lpad((k % 33).cast("string"), 2, "0"), F.lit(" x")))
    return t.orders.select("o_orderkey", sc.valid_date(d).alias("d"))


@query("sc10_parse_amount", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_totalprice END AS amount, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE '' END AS currency FROM orders""")
def _(t):
    m, v = F.col("o_orderkey") % 5, F.format_number("o_totalprice", 2)
    s = F.when(m == 0, F.concat(F.lit("$"), v)).when(m == 1, F.concat(F.lit("eur "), v)).when(m == 2, F.concat(v, F.lit(" £"))).when(m == 3, v).otherwise("n/a")
    return t.orders.select("o_orderkey", sc.parse_amount(s).alias("a")).select("o_orderkey", "a.*")


@query("sc11_count_words", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("sc12_path_parts", r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') || '/2024-03-0' || (page_id % 9 + 1) || '/a.PDF' AS path FROM pages)
SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dirname, string_split(path, '/')[1] AS entity, regexp_extract(path, '(\d{4}-\d{2}-\d{2})', 1) AS date, 'pdf' AS ext FROM p""")
def _(t):
    path = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("/2024-03-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("/a.PDF"))
    return t.pages.select("page_id", sc.path_parts(path).alias("p")).select("page_id", "p.*")


@query("sc13_extract_mentions", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'See https://x.example/' || doc_id || '. Last verified as of: 2024-05-0' || (doc_id % 10) || ' Approved by Ann Lee ' || md5(text) || ' ' ELSE '' END || text AS text FROM documents),
e AS (SELECT doc_id, text AS s, text FROM d)
SELECT doc_id, regexp_replace(regexp_extract(s, 'https?://[^\s")\]]+'), '[.,;]+$', '') AS url, regexp_extract(text, '(?i)\b[0-9a-f]{32}\b') AS page_id,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 10 > 0 THEN '2024-05-0' || (doc_id % 10) || 'T00:00:00.000Z' ELSE '' END AS verified_date,
  regexp_extract(s, '(?:signed off by|approved by|reviewed by)[:\s]+([A-Z][a-zA-Z.''-]+(?:\s+[A-Z][a-zA-Z.''-]+){0,2})', 1) AS signed_off_by FROM e""")
def _(t):
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, F.concat(F.lit("See https://x.example/"), k.cast("string"), F.lit(". Last verified as of: 2024-05-0"), (k % 10).cast("string"), F.lit(" Approved by Ann Lee "), F.md5("text"), F.lit(" "))).otherwise("")
    return t.documents.select("doc_id", sc.extract_mentions(F.concat(head, F.col("text"))).alias("m")).select("doc_id", "m.*")


@query("sc14_legacy_date", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' END AS iso FROM events")
def _(t):
    v = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.concat(F.lit("/Date("), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("+0000)/")))
    return t.events.select("event_id", sc.legacy_date(v).alias("iso"))


@query("sc15_day_math", f"SELECT o_orderkey, CAST(date_diff('day', {NOW_O}, o_orderdate) AS INTEGER) AS days, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') AS due, date_diff('day', {NOW_O}, o_orderdate) <= 7 AS tight FROM orders")
def _(t):
    d = sc.days_until(F.col("o_orderdate"), ts(NOW_ORDERS))
    return t.orders.select("o_orderkey", d.alias("days"), F.date_add("o_orderdate", 14).cast("string").alias("due"), (d <= 7).alias("tight"))


@query("sc16_two_digit_year", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 101 < 100 THEN CASE WHEN o_orderkey % 101 <= 69 THEN 2000 ELSE 1900 END + o_orderkey % 101 ELSE 1987 END AS INTEGER) AS y FROM orders")
def _(t):
    k = F.col("o_orderkey") % 101
    return t.orders.select("o_orderkey", sc.expand_year(F.when(k < 100, F.lpad(k.cast("string"), 2, "0")).otherwise("1987"), 69).alias("y"))


@query("sc17_snippet_and_clip", r"""WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 119) || '…' END AS snippet, CASE WHEN length(s) > 160 THEN rtrim(substr(s, 1, 159)) || '…' ELSE s END AS clip FROM c""")
def _(t):
    return t.documents.select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.clip(F.col("text"), 160).alias("clip"))


@query("sc18_canonical_json_hash", """SELECT event_id, sha256('{"a":{"b":[3,{"c":1,"d":2}],"y":"' || event_type || '"},"k":' || json_extract_string(props, '$.k') || ',"z":true}') AS h FROM events""")
def _(t):
    k, e = F.get_json_object("props", "$.k"), F.col("event_type")
    one = F.concat(F.lit('{"z":true, "a":{"y":"'), e, F.lit('","b":[3,{"d":2,"c":1}]},"k":'), k, F.lit("}"))
    two = F.concat(F.lit('{"k":'), k, F.lit(',"a":{"b":[3,{"c":1,"d":2}],"y":"'), e, F.lit('"},"z":true}'))
    return t.events.select("event_id", sc.canonical_json_hash(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("h"))


@query("sc19_parse_labelled_text", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'user ' || user_id END AS subject, 'is ' || event_type AS claim, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence, 'a,b' AS tags,
  concat_ws(';', CASE WHEN event_id % 5 = 0 THEN 'subject is required' END, CASE WHEN event_id % 3 = 2 THEN 'confidence must be low, med or high' END) AS errors,
  concat_ws(' | ', CASE WHEN event_id % 5 <> 0 THEN 'SUBJECT: user ' || user_id END, 'CLAIM: is ' || event_type, CASE event_id % 3 WHEN 0 THEN 'CONF: high' WHEN 1 THEN 'CONF: low' END, 'TAGS: a,b') AS rendered FROM events""")
def _(t):
    m = F.col("event_id") % 3
    raw = F.concat(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("subject: user "), F.col("user_id").cast("string"), F.lit(" | "))).otherwise(""), F.lit("CLAIM:  is "), F.col("event_type"),
                   F.lit("| junk |Conf: "), F.when(m == 0, "HIGH").when(m == 1, "low").otherwise("maybe"), F.lit(" | TAGS: a, b,,a"))
    p = sc.parse_labelled_text(t.events.select("event_id", raw.alias("raw")), "raw")
    return p.select("event_id", "subject", "claim", "confidence", F.array_join("tags", ",").alias("tags"), F.array_join("errors", ";").alias("errors"), "rendered")


@query("sc20_first_json_object", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn * 10 END AS score, CASE WHEN turn % 3 = 0 THEN role END AS who FROM conversations""")
def _(t):
    obj = F.concat(F.lit(' noise {"score": '), (F.col("turn") * 10).cast("string"), F.lit(', "who": "'), F.col("role"), F.lit('"} tail'))
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x"), obj)).when(F.col("turn") % 3 == 1, "none").otherwise("a } b {")
    return t.conversations.select("conv_id", "turn", sc.first_json_object(raw, "score BIGINT, who STRING").alias("o")).select("conv_id", "turn", "o.*")


@query("sc21_price_cost", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * (CASE l_returnflag WHEN 'A' THEN 15 WHEN 'R' THEN 0.8 ELSE 3 END)::DOUBLE + l_linenumber * (CASE l_returnflag WHEN 'A' THEN 75 WHEN 'R' THEN 4 ELSE 15 END)::DOUBLE AS f, l_quantity * 0.8::DOUBLE + l_linenumber * 4 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(f, 4) AS from_micro, round(h, 4) AS to_micro, round((f - h) / f * 100, 4) AS saved_pct FROM c""")
def _(t):
    m = F.when(F.col("l_returnflag") == "A", "Opus-4").when(F.col("l_returnflag") == "R", "haiku").otherwise("x")
    s = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sc.saving(m, F.lit("haiku"), F.col("l_quantity"), F.col("l_linenumber")).alias("s"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("s.from_usd") * 1e6, 4).alias("from_micro"), F.round(F.col("s.to_usd") * 1e6, 4).alias("to_micro"), F.round("s.saved_pct", 4).alias("saved_pct"))


@query("sc22_first_divergence", r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a FROM documents), b AS (SELECT doc_id, a, substr(a, 1, 30 + doc_id % 40) || '#' || substr(a, 32 + doc_id % 40) AS b FROM n WHERE length(a) > 80)
SELECT doc_id, CAST(30 + doc_id % 40 AS INTEGER) AS index, substr(b, greatest(30 + doc_id % 40 - 50, 0) + 1, 30 + doc_id % 40 + 50 - greatest(30 + doc_id % 40 - 50, 0)) AS b_context FROM b WHERE a <> b""")
def _(t):
    k = 30 + F.col("doc_id") % 40
    d = t.documents.select("doc_id", tx.collapse_spaces(F.col("text")).alias("a")).filter(F.length("a") > 80)
    b = F.concat(F.substring("a", F.lit(1), k.cast("int")), F.lit("#"), F.substring("a", (k + 2).cast("int"), F.length("a")))
    d = d.select("doc_id", sc.first_divergence(F.col("a"), b).alias("v")).filter("v IS NOT NULL")
    return d.select("doc_id", "v.index", "v.b_context")
