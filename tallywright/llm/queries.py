"""The registered queries of this subpackage."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import binary_output, decontaminate, jaccard, language, line_dedup, packing, phrases, pivots, resampling, token_counts, toxicity, url_filter, warc
from tallywright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; every machine has the package at the same place."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query
def op5_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's segments in the written matrices, read back: doc_id, piece, start, length, ids_crc32 (of 2-byte ids), sequence_id, offset."""
    written = binary_output.matrices_in_shared_folder(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return binary_output.segments(written)


@query
def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, size=4096)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


@query
def op4_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and group of every document at Jaccard 0.8 of five-word shingles."""
    return jaccard.near_documents(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


@query
def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives and back."""
    return warc.pages_through_archives(table(spark, sf_dir, "pages"))


ORACLES["op3_arc_to_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query
def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=20_000)


@query
def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: its text, its declared language, its source as host."""
    return language.identify(table(spark, sf_dir, "documents"), "doc_id", declared="lang", host=F.col("source"))


@query
def page_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: text, markup language, address suffix, host."""
    return language.identify(language.page_evidence(table(spark, sf_dir, "pages")), "page_id", declared="declared", suffix=F.col("suffix"), host=F.col("host"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and those that go because an equal line or, from 40 characters, one within two edits stands elsewhere before."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"), edits=2, least=40, exact=1)


ORACLES["op4_pivot_permutation"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= CAST(0.9 AS DOUBLE)),
n AS (SELECT x, count(*) AS c FROM l GROUP BY x), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.x = vec_id
"""
ORACLES["op8_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c = a.n AND c = b.n AS same FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
k AS (SELECT x, count(*) AS links, min(CASE WHEN same THEN y END) AS copy FROM l GROUP BY x),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(copy, doc_id)) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, least(doc_id, coalesce(low, doc_id)) AS group_id, doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN k ON k.x = doc_id LEFT JOIN m ON m.x = doc_id
"""


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the words of the benchmark."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=1, buckets=10_000, least_words=20, percent=10, seed=2024)


# CRC-32 byte by byte with the usual table, itself worked out bit by bit; once for every different word.
ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
words AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
uses AS (SELECT side, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM uses)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM coded, crc),
placed AS (SELECT side, doc_id, bucket, n FROM uses JOIN hashed USING (w)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scores AS (SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0)
  + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS drawn FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM scores LEFT JOIN fit USING (doc_id)
"""


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the trees learn from the URLs that a rule decides."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def page_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page's URL, and the rule's verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    rule, verdict = url_filter.rule_for(F.col("host"), F.col("path"), URL_RULES)
    return pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), rule.alias("rule"), verdict.alias("verdict"))


ORACLES["page_url_rules"] = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*', 0)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(verdict, host, start, rule) AS (VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
  ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')),
m AS (SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.start) GROUP BY p.page_id)
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN m USING (page_id)
"""


@query
def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), size=3, least=10, share=50, first=2000)


ORACLES["op13_phrase_graph"] = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM p),
runs AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, g, count(*) AS a FROM runs GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
inner_runs AS (SELECT lang, g[1:2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 3),
covered AS (SELECT lang, g, max(a) AS longer FROM inner_runs GROUP BY lang, g),
kept AS (SELECT c.* FROM c LEFT JOIN covered v ON c.lang = v.lang AND c.g = v.g WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT lang, g, a, k, unnest(range(1, k)) AS cut FROM kept),
scores AS (SELECT x.lang, x.g, x.a, cut, l.a AS l, r.a AS r, CAST(CAST(1000000 AS HUGEINT) * x.a * x.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.g = x.g[1:cut] JOIN f r ON r.lang = x.lang AND r.g = x.g[cut + 1:x.k]),
best AS (SELECT lang, g, a, min(struct_pack(score := score, cut := cut, l := l, r := r)) AS b FROM scores GROUP BY lang, g, a),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score AS score FROM best)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
