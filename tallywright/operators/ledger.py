"""Ledger compaction and rendering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import fixed
from tallywright.functions.ordered import bucketed_row_number, latest_by
from tallywright.operators.clusters import leader_clusters
from tallywright.operators.graph import chain_members, supersede_chain
from tallywright.operators.joins import active_rows
from tallywright.operators.windows import keep_recent_digest
from tallywright.session import cut_lineage


def _entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity rows that supersede only rows of their own key, current row of every key as id and ekey)."""
    entity = rows.filter((F.col("type") == "entity") & F.col("ekey").isNotNull())
    # The head is the newest row nobody supersedes; when every row is superseded, the newest row.
    gone = rows.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("_g")).distinct()
    e = entity.join(gone, F.col("id") == F.col("_g"), "left").withColumn("_live", F.col("_g").isNull())
    heads = latest_by(e, ["ekey"], ["_live", "ts", "id"]).select("id", "ekey")
    own = entity.select(F.col("id").alias("_p"), F.col("ekey").alias("_k")).distinct()
    chained = entity.join(own, (F.col("supersedes") == F.col("_p")) & (F.col("ekey") == F.col("_k")), "left")
    return chained.withColumn("supersedes", F.col("_p")).drop("_p", "_k"), heads


def value_history(rows: DataFrame) -> DataFrame:
    """CL11. The values behind every current entity and every superseded chain, a row for each: head, position from the oldest (1), id, ts,
    value. The head itself is the last. Rows and not one text, so a chain of any length stays spread."""
    entity, heads = _entities(rows)
    rest = rows.filter(~F.col("type").isin(*fixed.ALWAYS_KEEP_TYPES, "entity"))
    chains = supersede_chain(entity, heads.select("id")).unionByName(supersede_chain(rest, active_rows(rest).select("id")))
    values = rows.select("id", "ts", F.coalesce("evalue", "text", F.lit("")).alias("value"))
    return chains.filter("chain_length > 1").join(values, "id").select("head", "position", "id", "ts", "value")


def compact_ledger(rows: DataFrame, now: Column, dup_threshold: float = 0.8, status_keep: int = 5, status_days: int = 7) -> DataFrame:
    """CL11. The compacted ledger as rows (section, id, ekey, count, note).

    Sections: the always-kept types, the current value per entity key, the heads of superseded chains, one row per
    near-duplicate cluster, recent status rows, and one digest of older status rows. The rows, the members of chains and what remains without
    them are each worked out once: several sections and every round of the joins read them.
    """
    rows = cut_lineage(rows.select("id", "ts", "type", "ekey", "text", "supersedes"))
    out = ["section", "id", "ekey", "count", "note"]
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")

    keep = rows.filter(F.col("type").isin(*fixed.ALWAYS_KEEP_TYPES)).select(
        F.col("type").alias("section"), "id", "ekey", one.alias("count"), none.alias("note"))

    entity, heads = _entities(rows)
    heads = cut_lineage(heads)
    members = chain_members(entity, heads.select("id"))
    size = members.groupBy("head").agg(F.count("*").alias("count"), F.max_by("id", "depth").alias("oldest"))
    current = heads.join(size, F.col("id") == F.col("head")).select(
        F.lit("entity").alias("section"), "id", "ekey", "count",
        F.when(F.col("count") > 1, F.concat(F.lit("superseded "), (F.col("count") - 1).cast("string"), F.lit(" earlier value(s) from id="), "oldest")).alias("note"))

    rest = rows.filter(~F.col("type").isin(*fixed.ALWAYS_KEEP_TYPES, "entity"))
    tops = active_rows(rest).select("id")
    cm = cut_lineage(chain_members(rest, tops))
    cs = cm.groupBy("head").agg(F.count("*").alias("count"), F.max_by("id", "depth").alias("oldest")).filter(F.col("count") > 1)
    chains = cs.select(F.lit("chain").alias("section"), F.col("head").alias("id"), none.alias("ekey"), "count",
                       F.concat(F.lit("superseded "), (F.col("count") - 1).cast("string"), F.lit(" earlier value(s) from id="), "oldest").alias("note"))
    in_chain = cm.join(cs.select("head"), "head", "left_semi").select("id").distinct()
    remaining = cut_lineage(rest.join(in_chain, "id", "left_anti"))

    status = remaining.filter(F.col("type") == "status")
    recent, digest = keep_recent_digest(status, status_keep, now - F.make_dt_interval(days=F.lit(status_days)))
    kept = recent.select(F.lit("status").alias("section"), "id", "ekey", one.alias("count"), none.alias("note"))
    dig = digest.select(F.lit("status_digest").alias("section"), none.alias("id"), none.alias("ekey"), "count",
                        F.concat_ws(" to ", "start_date", "end_date").alias("note"))

    others = remaining.filter(F.col("type") != "status").select("id", "ts", "text", "type", "ekey")
    clustered = leader_clusters(others, ["ts", "id"], scope=(), threshold=dup_threshold)
    c = clustered.groupBy("leader_id").agg(F.max_by(F.struct("id", "ekey"), F.struct("ts", "id")).alias("r"), F.count("*").alias("count"))
    facts = c.select(F.lit("consolidated").alias("section"), F.col("r.id").alias("id"), F.col("r.ekey").alias("ekey"), "count", none.alias("note"))

    result = keep
    for part in (current, chains, facts, kept, dig):
        result = result.unionByName(part.select(*out))
    return result.select(*out)


def compaction_stats(rows: DataFrame, compacted: DataFrame) -> DataFrame:
    """CL11. Rows before, after, preserved and collapsed."""
    before = rows.agg(F.count("*").alias("n")).scalar()
    digest = F.col("section") == "status_digest"
    return compacted.agg(F.count("*").alias("after"), F.count_if(~digest).alias("preserved"),
                         F.sum(F.when(digest, F.col("count")).otherwise(F.col("count") - 1)).alias("collapsed")).withColumn("before", before)


SECTIONS = ["pitfall", "entity", "status", "decision", "fact", "correction"]


def render_sections(rows: DataFrame) -> DataFrame:
    """DP16. Report lines (section, ordinal, line): newest first, entities by key, superseded rows hidden except corrections."""
    live = active_rows(rows).filter(F.col("type") != "correction").unionByName(rows.filter(F.col("type") == "correction"))
    live = live.filter(F.col("type").isin(*SECTIONS))
    line = F.when(F.col("type") == "entity", F.concat(F.lit("- `"), "ekey", F.lit("` = "), F.coalesce("evalue", F.lit("")), F.lit("  `"), "id", F.lit("`"))).otherwise(
        F.concat(F.lit("- ["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), "text", F.lit("  `"), "id", F.lit("`")))
    l = live.withColumn("line", line).withColumn("_neg", -F.unix_micros(F.col("ts").cast("timestamp")))
    keyed = l.withColumn("_k", F.when(F.col("type") == "entity", F.col("ekey")).otherwise(""))
    # Buckets: days counted backwards, or the first characters of the key for entities; both grow with the order.
    bucket = F.concat(F.substring("_k", 1, 4), F.lpad(F.floor(F.col("_neg") / 8.64e10 + 100000000).cast("string"), 12, "0"))
    bucket = F.when(F.col("type") == "entity", F.col("_k")).otherwise(bucket)
    n = bucketed_row_number(keyed.select("type", "line", "_k", "_neg", "id"), ["type"], bucket, ["_k", "_neg", "id"], "ordinal")
    return n.select(F.col("type").alias("section"), "ordinal", "line")


