"""Queries over document processing."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators import documents as dp, ledger, windows as wn
from tallywright.plans.q_scalars import _ASCII
from tallywright.plans.registry import query
from tallywright.plans.tables import CATALOG, LEDGER, Tables


@query("dp01_chunk_text")
def _(t):
    c = dp.chunk_text(t.documents.select("doc_id", "text"), "text", 2000, 200)
    return c.select("doc_id", "ordinal", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query("dp02_chunk_rows")
def _(t):
    return dp.chunk_rows(t.catalog, "store/room").select("chunk_id", "parent_id", "path", "source_path", "title", "ordinal", F.md5("chunk").alias("chunk_md5"), "entity", "word_count")


CATEGORY_RULES = [("00_Licences", r"\blicen[cs]e\b|copyright"), ("01_Contact", r"@[a-z0-9.]+\.(com|org|net)\b|\b\d{3}-\d{4}\b"), ("02_French", r"\bque\b|\bles?\b"), ("03_German", r"\bder\b|\bund\b|ung\b")]


@query("dp03_classify_category", r"""WITH c AS (SELECT doc_id, lower(regexp_replace(path, '[/_-]', ' ', 'g') || ' ' || chr(10) || ' ' || text) AS h FROM (SELECT doc_id, text, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)),
k AS (SELECT doc_id, CASE WHEN regexp_matches(h, '\blicen[cs]e\b|copyright') THEN '00_Licences' WHEN regexp_matches(h, '@[a-z0-9.]+\.(com|org|net)\b|\b\d{3}-\d{4}\b') THEN '01_Contact'
  WHEN regexp_matches(h, '\bque\b|\bles?\b') THEN '02_French' WHEN regexp_matches(h, '\bder\b|\bund\b|ung\b') THEN '03_German' WHEN regexp_matches(h, '\bthe\b') THEN '_NON-ACCOUNTING' ELSE '_INBOX-UNCLASSIFIED' END AS category FROM c)
SELECT doc_id, category, category IN ('00_Licences', '01_Contact') AS material FROM k""")
def _(t):
    return dp.classify_category(t.catalog, "path", "text", CATEGORY_RULES, ["00_Licences", "01_Contact"], r"\bthe\b").select("doc_id", "category", "material")


@query("dp04_rule_metadata", r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'digest/' WHEN 1 THEN 'published/' ELSE '' END || source || '/' || doc_id || CASE WHEN doc_id % 6 = 2 THEN '.json' ELSE '.txt' END AS path,
  CASE doc_id % 5 WHEN 0 THEN 'Attorney-Client memo ' WHEN 1 THEN 'our SSN and reg-fd ' WHEN 2 THEN 'A hearing aid ' ELSE '' END || text AS text FROM documents), h AS (SELECT *, lower(path || ' ' || text) AS h, lower(path) AS p FROM d)
SELECT doc_id, CASE WHEN regexp_matches(p, 'session-checkpoint|digest|_recovery/') THEN 'ai_memo' WHEN regexp_matches(p, '\.(json|csv)$') THEN 'machine_generated' ELSE 'primary_source' END AS source_type,
  CASE WHEN regexp_matches(h, 'attorney[- ]client|attorney[- ]privileged') THEN 'attorney_privileged' WHEN regexp_matches(h, '\bssn\b|social security number') THEN 'personal_pii' WHEN regexp_matches(p, '\bpublished\b|\bpublic[_-]site\b') THEN 'public' ELSE '' END AS confidentiality,
  regexp_matches(h, '\bmnpi\b|material non-?public|reg[- ]fd|insider trading') AS mnpi_flag, regexp_matches(text, '(?i)\bhearing aid\b|\bfda[- ]clear(ed|ance)\b|\btreats? hearing loss\b|medical device claim') AS medical_claims FROM h""")
def _(t):
    k = F.col("doc_id")
    path = F.concat(F.when(k % 4 == 0, "digest/").when(k % 4 == 1, "published/").otherwise(""), F.col("source"), F.lit("/"), k.cast("string"), F.when(k % 6 == 2, ".json").otherwise(".txt"))
    text = F.concat(F.when(k % 5 == 0, "Attorney-Client memo ").when(k % 5 == 1, "our SSN and reg-fd ").when(k % 5 == 2, "A hearing aid ").otherwise(""), F.col("text"))
    return dp.rule_metadata(t.documents.select("doc_id", path.alias("path"), text.alias("text")), "path", "text").drop("path", "text")


FIELDS = [{"name": "doc_title", "kind": "scalar", "max_len": 60}, {"name": "lang", "kind": "scalar", "max_len": 8, "enum": ["EN", "DE", "FR"]}, {"name": "keywords", "kind": "list", "max_items": 3, "max_item_len": 12},
          {"name": "signed", "kind": "bool"}, {"name": "words", "kind": "int"}, {"name": "doc_date", "kind": "date"}, {"name": "price", "kind": "double"}]
_ASC = _ASCII.replace("translate(text,", "translate({e},")


@query("dp05_metadata_conform", f"""WITH d AS (SELECT doc_id, {_ASC.format(e='text')} AS s, lang, string_split(text, ' ') AS kw, toxic, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT *, list_transform(list_filter(kw, lambda x: trim(x) <> '')[1:3], lambda x: {_ASC.format(e='x')}) AS ks FROM d)
SELECT doc_id, nullif(CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 57) || '...' END, '') AS doc_title, CASE WHEN lang IN ('en', 'de', 'fr') THEN upper(lang) END AS lang,
  CASE WHEN len(ks) > 0 THEN array_to_string(list_transform(ks, lambda x: CASE WHEN length(x) <= 12 THEN x ELSE substr(x, 1, 9) || '...' END), '|') END AS keywords,
  coalesce(quality = 1, false) AS signed, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS words, CASE WHEN doc_id % 2 = 0 THEN '2024-02-1' || (doc_id % 10) || 'T00:00:00.000Z' END AS doc_date, CASE WHEN doc_id % 7 > 0 THEN CAST(n_chars AS DOUBLE) / 8 END AS price FROM k""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    k = F.col("doc_id")
    raw = d.select("doc_id", F.col("text").alias("doc_title"), "lang", F.split("text", " ").alias("keywords"), (F.col("quality") == 1).alias("signed"),
                   F.when(k % 3 > 0, F.col("n_chars").cast("string")).otherwise("many").alias("words"),
                   F.when(k % 2 == 0, F.concat(F.lit("2024-02-1"), (k % 10).cast("string"))).otherwise("2024-02-31").alias("doc_date"),
                   F.when(k % 7 > 0, F.col("n_chars") / 8).otherwise(float("nan")).alias("price"))
    return dp.metadata_conform(raw, FIELDS).withColumn("keywords", F.array_join("keywords", "|"))


@query("dp06_segment_labels", """SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant') AND text <> '') AS n_all, count(*) FILTER (role IN ('user', 'assistant') AND text <> '') AS kept, count(*) FILTER (role IN ('user', 'assistant') AND text <> '') > 0 AS mixed,
  coalesce(string_agg(DISTINCT CASE WHEN role IN ('user', 'assistant') AND text <> '' THEN role END, ',' ORDER BY CASE WHEN role IN ('user', 'assistant') AND text <> '' THEN role END), '') AS labels FROM conversations GROUP BY conv_id""")
def _(t):
    seg = F.struct(F.upper("role").alias("label"), F.col("text").alias("locator"), F.lit("r").alias("rationale"))
    d = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))), lambda x: x["s"]).alias("segs"),
                                               F.count_if(F.col("role").isin("user", "assistant") & (F.col("text") != "")).alias("n_all"))
    return dp.segment_labels(d, "segs", ["user", "assistant"]).select("conv_id", "n_all", F.size("segments_kept").cast("long").alias("kept"), "mixed", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query("dp07_shrink_to_budget", """WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS k, CAST(length(text) AS BIGINT) AS a, CAST(length(text) AS BIGINT) AS b, length('summary') + length('keywords') + length('doc_type') + length(lang) AS f FROM documents
  UNION ALL SELECT doc_id, text, k + 1, CASE WHEN k % 2 = 0 AND a > 40 THEN CAST(floor(a * CAST(0.7 AS DOUBLE)) AS BIGINT) ELSE a END, CASE WHEN k % 2 = 1 AND b > 40 THEN CAST(floor(b * CAST(0.7 AS DOUBLE)) AS BIGINT) ELSE b END, f FROM w WHERE a + b + f > 1500 AND (a > 40 OR b > 40)),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)
SELECT doc_id, md5(substr(text, 1, a)) AS summary_md5, CAST(b AS INTEGER) AS kw, CAST(a + b + f AS INTEGER) AS bytes, a + b + f > 1500 AS over_budget FROM l""")
def _(t):
    d = t.documents.select("doc_id", F.col("text").alias("summary"), F.col("text").alias("keywords"), F.col("lang").alias("doc_type"))
    return dp.shrink_to_budget(d, ["summary", "keywords", "doc_type"], 1500).select("doc_id", F.md5("summary").alias("summary_md5"), F.length("keywords").alias("kw"), "bytes", "over_budget")


@query("dp08_context_prefix", r"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<!-- CTX-PREFIX v1 -->' || chr(10) || 'old' || text ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'From ' || source END AS pre FROM documents)
SELECT doc_id, md5(CASE WHEN pre = '' OR starts_with(text, '<!-- CTX-PREFIX v1 -->') THEN text ELSE '<!-- CTX-PREFIX v1 -->' || chr(10) || pre || chr(10) || chr(10) || text END) AS text_md5 FROM p""")
def _(t):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat(F.lit(dp.CONTEXT_MARK + "\nold"), F.col("text"))).otherwise(F.col("text"))
    pre = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("From "), F.col("source")))
    return t.documents.select("doc_id", F.md5(dp.context_prefix(text, pre)).alias("text_md5"))


@query("dp09_additive_schema_merge", "SELECT CAST(NULL AS VARCHAR) AS tier, c_custkey, c_name, CAST(NULL AS DOUBLE) AS score, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    want = T.StructType().add("tier", "string").add("c_custkey", "string").add("c_name", "string").add("score", "double")
    return dp.additive_schema_merge(t.customer, want)


@query("dp10_blocks_to_text", """WITH l AS (SELECT conv_id, turn // 3 + 1 AS page, turn, text FROM conversations WHERE role <> 'system'), p AS (SELECT conv_id, page, string_agg(text, chr(10) ORDER BY turn) AS t FROM l GROUP BY ALL)
SELECT conv_id, count(*) AS pages, md5(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS text_md5 FROM p GROUP BY conv_id""")
def _(t):
    b = t.conversations.select("conv_id", F.when(F.col("role") == "system", "PAGE").otherwise("LINE").alias("block_type"), (F.floor(F.col("turn") / 3) + 1).alias("page"), F.col("turn").alias("ordinal"), "text")
    return dp.blocks_to_text(b, "conv_id").select("conv_id", "pages", F.md5("text").alias("text_md5"))


def dated(t: Tables):
    """Documents with dates of all four forms between their lines, one of them repeated nearby."""
    k = (F.col("doc_id") % 28 + 1).cast("string")
    head = F.concat(F.lit("Response due\n7/"), k, F.lit("/26\nseen 2026-07-"), F.lpad(k, 2, "0"), F.lit(" and July "), k, F.lit(", 2026\n"))
    tail = F.concat(F.lit("\nThe hearing is on "), k, F.lit(" March 2027."))
    return t.documents.select("doc_id", F.concat(head, "text", tail).alias("text"))


@query("dp11_deadline_candidates", r"""WITH d AS (SELECT doc_id, text, CAST(doc_id % 28 + 1 AS VARCHAR) AS k FROM documents),
h AS (SELECT *, 'Response due' || chr(10) || '7/' || k || '/26' || chr(10) || 'seen 2026-07-' || lpad(k, 2, '0') || ' and July ' || k || ', 2026' || chr(10) AS head FROM d),
t AS (SELECT doc_id, k, head || text || chr(10) || 'The hearing is on ' || k || ' March 2027.' AS t, length(head || text) + 19 AS later FROM h),
c AS (SELECT doc_id, t, 13 AS start, '2026-07-' || lpad(k, 2, '0') AS date, '7/' || k || '/26' AS match_text, 'Response due' AS keyword FROM t
  UNION ALL SELECT doc_id, t, later, '2027-03-' || lpad(k, 2, '0'), k || ' March 2027', 'hearing' FROM t)
SELECT doc_id, CAST(start AS INTEGER) AS start, date, trim(regexp_replace(substr(t, greatest(start - 100, 0) + 1, start + length(match_text) + 100 - greatest(start - 100, 0)), '\s+', ' ', 'g')) AS what, match_text, keyword, 'high' AS confidence FROM c""")
def _(t):
    return dp.deadline_candidates(dated(t), "text")


@query("wn11_collapse_near_spans", "SELECT doc_id, 4 AS raw, 2 AS kept, printf('2026-07-%02d,2027-03-%02d', doc_id % 28 + 1, doc_id % 28 + 1) AS dates FROM documents")
def _(t):
    s = dated(t).select("doc_id", dp.raw_spans(F.col("text")).alias("raw"))
    s = s.withColumn("kept", wn.collapse_near_spans(F.col("raw")))
    return s.select("doc_id", F.size("raw").alias("raw"), F.size("kept").alias("kept"), F.array_join(F.transform("kept", lambda x: x["date"]), ",").alias("dates"))


@query("dp12_docket_delta", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 > 0 THEN 'Docket Entry #' || o_orderkey || ': ' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '(no description)' ELSE o_orderpriority || ' ' || o_orderstatus END AS what,
  'court' AS source, false AS verified FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' AND o_orderkey % 7 > 0""")
def _(t):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00")
    e = t.orders.select("o_orderkey", F.when(k % 2 == 0, d).alias("date_filed"), F.when(k % 7 > 0, d).otherwise("n/a").alias("date_created"),
                        F.when(k % 5 > 0, F.concat("o_orderpriority", F.lit("  \n "), "o_orderstatus")).otherwise("").alias("description"), F.when(k % 3 > 0, k).alias("entry_number"))
    e = e.withColumn("date_filed", F.when(k % 7 > 0, F.col("date_filed")))
    return dp.docket_delta(e, "2000-01-01", "court")


@query("dp13_propose_mapping", f"""WITH {CATALOG}, m AS (SELECT doc_id, sha256, CASE WHEN lang = 'de' THEN '_NON-ACCOUNTING/' || entity ELSE entity || '/' || lang END || '/f' || (doc_id % 5) || '.txt' AS target FROM catalog)
SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY target) THEN target ELSE replace(target, '.txt', '_' || substr(sha256, 1, 6) || '.txt') END AS new_path FROM m""")
def _(t):
    c = t.catalog.select("doc_id", "sha256", "entity", F.when(F.col("lang") == "de", "_NON-ACCOUNTING").otherwise(F.col("lang")).alias("category"),
                         F.concat(F.lit("x/f"), (F.col("doc_id") % 5).cast("string"), F.lit(".txt")).alias("path"))
    return dp.propose_mapping(c, "doc_id").select("doc_id", "new_path")


def transcript(t: Tables):
    """Conversation turns as transcript lines: plain content for users, parts for the others, some tool results."""
    c = t.conversations
    stamp = F.concat(F.lit("2024-01-0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("T0"), F.col("turn").cast("string"), F.lit(":00:00Z"))
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("ignored").alias("text")))
    msg = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("user").alias("type"), stamp.alias("timestamp"), F.struct(F.lit("user").alias("role"), F.when(
        F.col("turn") == 2, F.concat(F.lit("tool_result "), "text")).otherwise(F.col("text")).alias("content")).alias("message"))))
    msg = msg.otherwise(F.to_json(F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), F.struct(F.col("role").alias("role"), part.alias("content")).alias("message"))))
    return c.select("conv_id", "turn", msg.alias("line"))


_TURNS = """tr AS (SELECT conv_id, turn, '2024-01-0' || (conv_id % 9 + 1) || 'T0' || turn || ':00:00Z' AS ts, CASE WHEN role = 'user' THEN 'IN' ELSE 'OUT' END AS dir, CASE WHEN role = 'user' THEN text ELSE regexp_replace(text, '^ +| +$', '', 'g') END AS text FROM conversations
  WHERE (role = 'user' AND turn <> 2 AND text <> '') OR (role = 'assistant' AND length(trim(text)) > 20))"""


@query("dp14_journal_turns", f"WITH {_TURNS} SELECT conv_id, turn, ts, dir, md5(text) AS text_md5, substr(ts, 1, 10) AS day FROM tr")
def _(t):
    return dp.journal_turns(transcript(t), "line").select("conv_id", "turn", "ts", "dir", F.md5("text").alias("text_md5"), "day")


@query("dp15_agent_day_body", f"""WITH {_TURNS}, l AS (SELECT substr(ts, 1, 10) AS day, ts, conv_id, turn, '[' || substr(ts, 12, 8) || '] ' || dir || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM tr)
SELECT day, md5(string_agg(line, chr(10) ORDER BY ts, conv_id, turn)) AS body_md5 FROM l GROUP BY day""")
def _(t):
    turns = dp.journal_turns(transcript(t), "line")
    return dp.agent_day_body(turns, ["day"], ["ts", "conv_id", "turn"]).select("day", F.md5("body").alias("body_md5"))


@query("dp16_render_sections", f"""WITH {LEDGER}, live AS (SELECT * FROM ledger l WHERE type = 'correction' OR NOT EXISTS (SELECT 1 FROM ledger x WHERE x.supersedes = l.id))
SELECT type AS section, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN type = 'entity' THEN ekey ELSE '' END, ts DESC, id) AS ordinal,
  CASE WHEN type = 'entity' THEN '- `' || ekey || '` = ' || text || '  `' || id || '`' ELSE '- [' || strftime(ts, '%Y-%m-%d') || '] ' || text || '  `' || id || '`' END AS line FROM live""")
def _(t):
    return ledger.render_sections(t.ledger.withColumn("evalue", F.col("text")))
