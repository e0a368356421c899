"""Sorting, limits and budgets."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import fixed
from tallywright.functions.ordered import bucketed_row_number, bucketed_running, id_bucket, top_per_key
from tallywright.operators.joins import active_rows


def order_limit(df: DataFrame, order: Sequence[Column], top: int | None, cap: int | None = None) -> DataFrame:
    """TK01. First rows in order: ``top`` of them, at least one, at most ``cap`` if the caller sets it; all without either."""
    bounds = [x for x in (top, cap) if x is not None]
    ordered = df.orderBy(*order)
    return ordered.limit(max(1, min(bounds))) if bounds else ordered


def query_terms(query: str, max_terms: int | None = None) -> list[str]:
    """Distinct terms of at least three characters, without prompt stop words."""
    out: list[str] = []
    word = ""
    for ch in query.lower() + " ":
        if "a" <= ch <= "z" or "0" <= ch <= "9":
            word += ch
            continue
        if len(word) >= 3 and word not in fixed.PROMPT_STOP_WORDS and word not in out:
            out.append(word)
        word = ""
    return out[:max_terms]


def term_score(text: Column, terms: Sequence[str]) -> Column:
    hay = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(0)
    for t in terms:
        score = score + F.contains(hay, F.lit(t)).cast("int")
    return score


def term_overlap_rank(rows: DataFrame, terms: Sequence[str], n: int, text: str = "text") -> DataFrame:
    """TK03. Rows that contain most of the terms, newest first among equals."""
    return rows.withColumn("score", term_score(F.col(text), terms)).filter("score > 0").orderBy(
        F.desc("score"), F.desc("ts"), F.desc("id")).limit(n)


# Quota per section; corrections are shown although superseded.
SECTION_QUOTA = {"pitfall": 12, "decision": 6, "correction": 5, "entity": 8}


def working_set_pack(rows: DataFrame, terms: Sequence[str], ranked: int = 6, recent: int = 4) -> DataFrame:
    """TK02. Newest rows per section, then best term matches, then newest others; a row appears once."""
    active = active_rows(rows)
    newest = [F.desc("ts"), F.desc("id")]
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_QUOTA.items() for x in kv]), F.col("type")), F.lit(0))
    pool = active.filter(F.col("type") != "correction").unionByName(rows.filter(F.col("type") == "correction"))
    pool = pool.filter(F.col("type").isin(*SECTION_QUOTA))
    always = top_per_key(pool, ["type"], newest, max(SECTION_QUOTA.values()), "slot").filter(F.col("slot") <= quota)
    always = always.withColumn("section", F.col("type"))
    left = active.join(always.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")
    best = term_overlap_rank(left, terms, ranked).drop("score").withColumn("section", F.lit("ranked")) if terms else None
    if best is not None:
        left = left.join(best.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")
    last = left.orderBy(*newest).limit(recent).withColumn("section", F.lit("recent"))
    out = always.drop("slot").unionByName(last)
    return out if best is None else out.unionByName(best)


def keyset_page(df: DataFrame, ts: str, id: str, after: tuple, n: int) -> DataFrame:
    """TK04. Next page below the cursor, newest first."""
    t, i = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
    below = (F.col(ts) < t) | ((F.col(ts) == t) & (F.col(id) < i))
    return df.filter((F.col(ts) <= t) & below).orderBy(F.desc(ts), F.desc(id)).limit(n)


def sample_evenly(df: DataFrame, id: str, n: int, width: int = 65536) -> DataFrame:
    """TK05. Rows at positions floor(i * size / n) in id order.

    A position p is wanted when the smallest i with floor(i * size / n) >= p hits it exactly, so each row decides for itself.
    """
    size = df.agg(F.count("*").alias("c")).scalar()
    pos = F.col("_rn") - 1
    num = bucketed_row_number(df, [], id_bucket(id, width), [id], "_rn").withColumn("_size", size).withColumn(
        "_i", F.ceil(pos * n / F.col("_size")))
    hit = (F.col("_size") <= n) | ((F.col("_i") < n) & (F.floor(F.col("_i") * F.col("_size") / n) == pos))
    return num.filter(hit).withColumn("position", pos).drop("_rn", "_i", "_size")


def char_budget_pack(lines: DataFrame, keys: Sequence[str], order: str, text: str, budget: int, block: int = 4096) -> DataFrame:
    """TK06. Lines of each key in order while the joined text stays within the budget; a first line that is too long is cut."""
    l = bucketed_running(lines, keys, F.floor(F.col(order) / block), [order],
                         {"used": F.length(text) + 1, "_n": F.lit(1)}).withColumn("used", F.col("used") - 1)
    return l.filter((F.col("used") <= budget) | (F.col("_n") == 1)).withColumn(text, F.substring(text, 1, budget)).withColumn(
        "used", F.least(F.col("used"), F.lit(budget))).drop("_n")


def bounded_batch(pending: DataFrame, order: str, pages: str, max_docs: int, max_pages: int, block: int = 4096) -> DataFrame:
    """TK07. Pending rows in order while both the document and the page budget have room before the row."""
    first = pending.orderBy(order).limit(max_docs) if max_docs > 0 else pending
    if max_pages <= 0:
        return first
    used = bucketed_running(first, [], id_bucket(order, block), [order], {"pages_used": F.col(pages)})
    return used.filter(F.col("pages_used") - F.col(pages) < max_pages)


def severity_order(signals: DataFrame, severity: str, ranks: dict[str, int]) -> DataFrame:
    """TK08. Severity as a rank column, most severe first."""
    m = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return signals.withColumn("severity_rank", F.coalesce(F.element_at(m, F.col(severity)), F.lit(9))).orderBy("severity_rank")


def head_tail(text: Column, max_chars: int = 2000, head_ratio: float = 0.7) -> Column:
    """TK09. Over-long text keeps its head and tail round a marker that states what is missing."""
    max_chars, head_ratio = max(200, max_chars), min(0.95, max(0.05, head_ratio))
    s = F.coalesce(text, F.lit(""))
    n = F.length(s)
    marker = F.concat(F.lit("\n... [result-guard: truncated "), (n - max_chars).cast("string"), F.lit(" of "), n.cast("string"),
                      F.lit(" chars; re-query more narrowly for the omitted middle] ...\n"))
    budget = F.lit(max_chars) - F.length(marker)
    head = F.floor(budget * head_ratio).cast("int")
    return F.when(n <= max_chars, s).otherwise(F.concat(F.substring(s, F.lit(1), head), marker, F.right(s, budget - head)))


def latest_snapshot_rows(rows: DataFrame, snapshot: str, bucket: str, wanted: str, digest: str) -> DataFrame:
    """TK10. Rows of one bucket with a digest from the newest snapshot."""
    newest = rows.agg(F.max(snapshot).alias("m")).scalar()
    return rows.filter((F.col(snapshot) == newest) & (F.col(bucket) == wanted) & F.col(digest).isNotNull())
