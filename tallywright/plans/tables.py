"""Input tables and the adapters that give them the shapes the operators work on."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.ordered import bucketed_lag, time_bucket

NOW_EVENTS = "2024-02-01 00:00:00"
NOW_ORDERS = "1998-01-01 00:00:00"


def ts(value: str):
    """A zone-free timestamp literal, comparable with the stored columns without a cast on them."""
    return F.lit(value).cast("timestamp_ntz")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                    "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def ledger(self) -> DataFrame:
        """Ledger rows from events: type by event type, key by user, a chain on two of the types."""
        e = self.events.select(
            "event_id", "ts", F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("agent"),
            F.when(F.col("event_type") == "view", "fact").when(F.col("event_type") == "click", "status")
            .when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "signup", "entity")
            .otherwise("correction").alias("type"),
            F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("ekey"),
            F.concat(F.col("event_type"), F.lit(" key k"), (F.col("user_id") % 20).cast("string"),
                     F.lit(" bucket "), (F.col("event_id") % 9).cast("string")).alias("text"),
        ).withColumn("id", F.col("event_id").cast("string"))
        chained = bucketed_lag(e, ["type", "ekey"], time_bucket(), ["ts", "event_id"], {"_prev_id": "id"})
        return chained.select(
            "id", "event_id", "ts", "agent", "type", "ekey", "text",
            F.when(F.col("type").isin("entity", "correction"), F.col("_prev_id")).alias("supersedes"))

    @cached_property
    def doc_ledger(self) -> DataFrame:
        """Ledger rows whose text is a document."""
        return self.documents.select(
            F.col("doc_id").cast("string").alias("id"), "doc_id",
            (ts("2024-01-01 00:00:00") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("ts"),
            F.col("source").alias("agent"), F.lit("fact").alias("type"), "text",
            F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") - 3).cast("string")).alias("supersedes"))

    @cached_property
    def catalog(self) -> DataFrame:
        """One catalog row per document."""
        d, l = self.documents, self.labels
        return d.join(l, "doc_id", "left").select(
            "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
            F.col("source").alias("entity"), "lang", "n_chars", "text",
            F.sha2("text", 256).alias("sha256"), F.col("quality").isNotNull().alias("sidecar"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("enriched"),
            F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.lit(None)).otherwise(F.sha2("text", 256)).alias("enriched_sha256"),
            F.when(F.col("n_chars") < 20, F.lit("empty")).alias("err"), "quality", "toxic")

    @cached_property
    def inventory(self) -> DataFrame:
        """Stored objects: originals and text objects with their sizes."""
        c = self.catalog
        originals = c.filter(F.col("doc_id") % 10 != 0).select(
            F.col("path").alias("key"), F.col("n_chars").alias("size"))
        texts = c.filter("sidecar").select(
            F.concat(F.lit("_TEXT/"), "path", F.lit(".txt")).alias("key"),
            F.when(F.col("quality") == 0, F.lit(0)).otherwise(F.col("n_chars")).cast("long").alias("size"))
        return originals.unionByName(texts)

    @cached_property
    def queue(self) -> DataFrame:
        """Decision queue rows from orders."""
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("owner"),
            F.lower(F.substring("o_orderpriority", 3, 20)).alias("category"),
            F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "ack")
            .otherwise("open").alias("status"),
            (F.col("o_orderdate") + F.expr("interval 30 days")).alias("expected_by"),
            F.when(F.col("o_orderpriority").startswith("1"), "block").when(F.col("o_orderpriority").startswith("2"), "escalate")
            .when(F.col("o_orderpriority").startswith("3"), "proceed").alias("terminal_policy"),
            F.col("o_totalprice").alias("amount"))

    @cached_property
    def daily_bars(self) -> DataFrame:
        """Open, high, low, close and volume per order day."""
        return self.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count("*").alias("volume"))


# The same adapters as SQL for the oracle.
LEDGER = """ledger AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, ts, 'a' || (user_id % 7) AS agent,
    CASE event_type WHEN 'view' THEN 'fact' WHEN 'click' THEN 'status' WHEN 'purchase' THEN 'decision'
      WHEN 'signup' THEN 'entity' ELSE 'correction' END AS type,
    'k' || (user_id % 20) AS ekey,
    event_type || ' key k' || (user_id % 20) || ' bucket ' || (event_id % 9) AS text,
    CASE WHEN event_type IN ('signup', 'error') THEN
      CAST(LAG(event_id) OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts, event_id) AS VARCHAR) END AS supersedes
  FROM events)"""
DOC_LEDGER = """doc_ledger AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS ts,
    source AS agent, 'fact' AS type, text FROM documents)"""
CATALOG = """catalog AS (
  SELECT d.doc_id, source || '/' || lang || '/' || d.doc_id || '.txt' AS path, source AS entity, lang, n_chars, text,
    sha256(text) AS sha256, quality IS NOT NULL AS sidecar, coalesce(quality = 1, false) AS enriched,
    CASE WHEN coalesce(toxic, 0) = 1 THEN NULL ELSE sha256(text) END AS enriched_sha256,
    CASE WHEN n_chars < 20 THEN 'empty' END AS err, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
INVENTORY = CATALOG + """, inventory AS (
  SELECT path AS key, n_chars AS size FROM catalog WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT '_TEXT/' || path || '.txt', CASE WHEN quality = 0 THEN 0 ELSE n_chars END FROM catalog WHERE sidecar)"""
QUEUE = """queue AS (
  SELECT o_orderkey AS id, c_mktsegment AS owner, lower(substr(o_orderpriority, 3)) AS category,
    CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'ack' ELSE 'open' END AS status,
    o_orderdate + INTERVAL 30 DAY AS expected_by,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'block' WHEN '2' THEN 'escalate' WHEN '3' THEN 'proceed' END AS terminal_policy,
    o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
BARS = """bars AS (
  SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1)"""
NOW_E = "TIMESTAMP '2024-02-01 00:00:00'"
NOW_O = "TIMESTAMP '1998-01-01 00:00:00'"


def sql_tokens(expr: str) -> str:
    """The tokenizer in the oracle's dialect."""
    from tallywright.functions.fixed import STOP_WORDS
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '[^a-z0-9]+'), "
            f"lambda x: length(x) > 1 AND x NOT IN ({stop}))))")


def sql_word(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"
