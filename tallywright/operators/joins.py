"""Joins and reconciliations. Join strategy is left to Spark, which broadcasts a side only when its size is known to be small."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import text as tx
from tallywright.functions.ordered import bucketed_running, next_marked, ranged, top_per_key
from tallywright.operators.filters import exclusion_reason, reserved_path, safe_path, well_formed_path


def active_rows(rows: DataFrame, id: str = "id", supersedes: str = "supersedes") -> DataFrame:
    """JN01. Rows that no other row supersedes."""
    gone = rows.filter(F.col(supersedes).isNotNull() & (F.col(supersedes) != "")).select(F.col(supersedes).alias(id)).distinct()
    return rows.join(gone, id, "left_anti")


def supersede_pairs(rows: DataFrame, carry: Sequence[str] = ("agent", "type", "text", "ts")) -> DataFrame:
    """JN02. (old, new) for every row that supersedes an existing row."""
    new = rows.filter(F.col("supersedes").isNotNull() & (F.col("supersedes") != "")).select(
        F.col("id").alias("new_id"), F.col("supersedes").alias("_ref"), *[F.col(c).alias(f"new_{c}") for c in carry])
    old = rows.select(F.col("id").alias("old_id"), *[F.col(c).alias(f"old_{c}") for c in carry])
    return old.join(new, F.col("old_id") == F.col("_ref")).drop("_ref")


def missing_sidecar(names: DataFrame, extensions: Sequence[str], name: str = "key") -> DataFrame:
    """JN03. Documents of the extensions that have no text object; text object names compare without case."""
    exts = r"(?i)\.(" + "|".join(extensions) + ")$"
    docs = names.filter(F.col(name).rlike(exts) & ~F.col(name).startswith("_TEXT/"))
    side = names.filter(F.col(name).startswith("_TEXT/") & F.lower(name).endswith(".txt")).select(F.lower(name).alias("_side"))
    wanted = F.lower(F.concat(F.lit("_TEXT/"), F.col(name), F.lit(".txt")))
    return docs.join(side, wanted == F.col("_side"), "left_anti")


def presence(catalog: DataFrame, inventory: DataFrame, reason: Column) -> DataFrame:
    """One row per path with its presence in catalog, originals and text objects."""
    cat = catalog.filter(safe_path(F.col("path"))).withColumn("_reason", F.coalesce(reason, F.lit("eligible")))
    cat = cat.groupBy("path").agg(F.max("_reason").alias("reason"), F.count("*").alias("catalog_rows"))
    is_text = F.col("key").startswith("_TEXT/") & F.col("key").endswith(".txt")
    objs = inventory.select(
        F.when(is_text, F.expr("substr(key, 7, length(key) - 10)")).otherwise(F.col("key")).alias("_p"), is_text.alias("_t"), "size")
    objs = objs.filter(safe_path(F.col("_p"))).groupBy("_p").agg(
        F.max(F.when(~F.col("_t"), F.col("size"))).alias("original_size"), F.max(F.when(F.col("_t"), F.col("size"))).alias("text_size"))
    return cat.join(objs, F.col("path") == F.col("_p"), "full_outer").select(
        F.coalesce("path", "_p").alias("path"), F.coalesce("reason", F.lit("(not in catalog)")).alias("reason"),
        F.col("path").isNotNull().alias("in_catalog"), F.coalesce("catalog_rows", F.lit(0)).alias("catalog_rows"), "original_size", "text_size")


def inventory_reconcile(catalog: DataFrame, inventory: DataFrame, reason: Column) -> DataFrame:
    """JN04. Presence counts per exclusion reason, eligible and uncatalogued paths included.

    Catalog rows whose path is malformed, or inside a reserved root, are counted as ``(invalid path)`` and ``(internal path)``; they have no
    presence. So ``catalog_rows`` adds up to the rows of the catalog, and less ``paths`` gives the repeated ones.
    """
    p = presence(catalog, inventory, reason)
    kind = F.when(~well_formed_path(F.col("path")), "(invalid path)").when(reserved_path(F.col("path")), "(internal path)")
    left_out = catalog.select("path", kind.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("catalog_rows"), F.count_distinct("path").alias("paths"))
    counted = p.groupBy("reason").agg(
        F.sum("catalog_rows").alias("catalog_rows"), F.count("*").alias("paths"), F.count("original_size").alias("original_present"),
        F.count_if(F.col("original_size").isNull()).alias("original_missing"),
        F.count_if(F.col("original_size") == 0).alias("original_zero"),
        F.count_if(F.col("text_size") > 0).alias("text_nonempty"), F.count_if(F.col("text_size") == 0).alias("text_empty"),
        F.count_if(F.col("text_size").isNull()).alias("text_missing"))
    zero = [F.lit(0).cast("long").alias(c) for c in counted.columns[3:]]
    return counted.unionByName(left_out.select("reason", "catalog_rows", "paths", *zero))


def repair_plan(catalog: DataFrame, inventory: DataFrame) -> DataFrame:
    """JN05. One action per catalog path that needs repair, with the reason it was excluded."""
    why = F.coalesce(exclusion_reason(None), F.lit("eligible"))
    cat = catalog.filter(safe_path(F.col("path"))).withColumn("exclusion", why)
    inv = inventory.select(F.col("key").alias("_k"), F.col("size").alias("_s"))
    orig = inv.select(F.col("_k").alias("_ok"), F.col("_s").alias("original_size"))
    text = inv.select(F.col("_k").alias("_tk"), F.col("_s").alias("text_size"))
    j = cat.join(orig, F.col("path") == F.col("_ok"), "left").join(
        text, F.concat(F.lit("_TEXT/"), "path", F.lit(".txt")) == F.col("_tk"), "left")
    scope = F.col("_ok").isNull() | F.col("exclusion").isin("missing_sidecar_claim", "missing_enrichment_claim")
    action = (
        F.when(F.col("_ok").isNull(), "recover_original").when(F.col("original_size") == 0, "review_zero_original")
        .when(F.col("sidecar").isNull(), "review_sidecar_schema")
        .when((F.coalesce("err", F.lit("")) != "") | (F.col("exclusion") == "missing_source_hash"), "review_source_error")
        .when(~F.col("sidecar") & F.col("_tk").isNull(), "extract_text")
        .when(~F.col("sidecar") & (F.col("text_size") == 0), "review_empty_text")
        .when(~F.col("sidecar"), "restore_sidecar_existence")
        .when(F.col("exclusion").isin("missing_enrichment_claim", "missing_matching_enrichment_hash", "eligible"),
              "enrichment_requires_verified_result").otherwise("review_source_error"))
    return j.filter(scope).select("path", action.alias("action"), "exclusion", "original_size", "text_size")


def diff_scorecards(base: DataFrame, head: DataFrame, drop: float = 0.15) -> DataFrame:
    """JN06. Scores of two runs side by side; a pass lost or a drop of at least ``drop`` regresses."""
    b = base.select(F.col("id").alias("_bi"), F.col("agent").alias("_ba"), F.col("score").alias("base_score"), F.col("pass").alias("_bp"))
    h = head.select(F.col("id").alias("_hi"), F.col("agent").alias("_ha"), F.col("score").alias("head_score"), F.col("pass").alias("_hp"))
    delta = F.col("head_score") - F.col("base_score")
    both = F.col("_bi").isNotNull() & F.col("_hi").isNotNull()
    regressed = both & ((F.col("_bp") & ~F.col("_hp")) | (delta <= -drop))
    return b.join(h, F.col("_bi") == F.col("_hi"), "full_outer").select(
        F.coalesce("_hi", "_bi").alias("id"), F.coalesce("_ha", "_ba").alias("agent"),
        F.when(F.col("_bi").isNull(), "new").when(F.col("_hi").isNull(), "removed").otherwise("compared").alias("status"),
        "base_score", "head_score", delta.alias("delta"), F.coalesce(regressed, F.lit(False)).alias("regressed"),
        F.coalesce(both & (delta >= drop) & ~regressed, F.lit(False)).alias("improved"))


def judge_compare(a: DataFrame, b: DataFrame, pass_at: float = 0.7) -> DataFrame:
    """JN07. The same task under two judges: score distance, verdict and criterion agreement."""
    l = a.select("id", "agent", F.col("score").alias("_sa"), F.col("met").alias("_ma"))
    r = b.select("id", F.col("score").alias("_sb"), F.col("met").alias("_mb"))
    sa, sb = F.coalesce("_sa", F.lit(0.0)), F.coalesce("_sb", F.lit(0.0))
    same = F.size(F.filter(F.zip_with("_ma", "_mb", lambda x, y: x.eqNullSafe(y)), lambda v: v))
    comparable = (F.size("_ma") == F.size("_mb")) & (F.size("_ma") > 0)
    return l.join(r, "id").select(
        "id", "agent", sa.alias("score_a"), sb.alias("score_b"), F.abs(sa - sb).alias("score_delta"),
        ((sa >= pass_at) == (sb >= pass_at)).alias("verdict_agree"),
        F.when(comparable, same / F.size("_ma")).alias("criterion_agreement"))


def missing_expected(expected: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """JN08. Expected keys that are not live (``missing``) and live keys nobody expects (``orphan``)."""
    e, l = expected.filter(F.col(key).isNotNull()).select(key).distinct(), live.select(key).distinct()
    return e.join(l, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(
        l.join(e, key, "left_anti").select(key, F.lit("orphan").alias("side")))


def registry_health(registry: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """JN09. One row per registered job; jobs without a status row are MISSING_ROW."""
    return registry.join(status, key, "left").withColumn("state", F.coalesce("status", F.lit("MISSING_ROW"))).withColumn(
        "anomaly", F.col("state") != "LIVE").drop("status")


def constraint_audit(indexes: DataFrame, jobs: DataFrame, retired: DataFrame) -> DataFrame:
    """JN10. One row per broken rule of a declared index."""
    j = jobs.select(F.col("job").alias("_job")).distinct()
    r = retired.select(F.col("index").alias("_ret"), F.col("writer_job").alias("_rw"))
    x = indexes.join(j, F.col("writer_job") == F.col("_job"), "left").join(r.select("_ret").distinct(), F.col("index") == F.col("_ret"), "left")
    no_writer = F.coalesce("writer_job", F.lit("")) == ""
    broken = F.array_compact(F.array(
        F.when(no_writer, "no_writer"), F.when(~no_writer & F.col("_job").isNull(), "unknown_writer"),
        F.when(F.coalesce("timestamp_field", F.lit("")) == "", "no_freshness_field"),
        F.when(~(F.coalesce("max_age_h", F.lit(0.0)) > 0), "no_positive_slo"),
        F.when(F.coalesce("service", F.lit("")) == "", "no_service"), F.when(F.col("_ret").isNotNull(), "also_retired")))
    live = x.select("index", F.explode(broken).alias("violation"))
    return live.unionByName(r.filter(F.coalesce("_rw", F.lit("")) != "").select(F.col("_ret").alias("index"), F.lit("retired_with_writer").alias("violation")))


def presence_verdict(left: DataFrame, right: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """JN11. MATCHED, MISSING_BOTH, MISSING_LEFT or MISSING_RIGHT for every key."""
    l = left.select(F.col(key).alias("_l")).distinct()
    r = right.select(F.col(key).alias("_r")).distinct()
    return keys.select(key).distinct().join(l, F.col(key) == F.col("_l"), "left").join(r, F.col(key) == F.col("_r"), "left").select(
        key, F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "MATCHED").when(F.col("_l").isNull() & F.col("_r").isNull(), "MISSING_BOTH")
        .when(F.col("_l").isNull(), "MISSING_LEFT").otherwise("MISSING_RIGHT").alias("verdict"))


def asof_rows(events: DataFrame, days: DataFrame) -> DataFrame:
    """JN12. (day, date, text): every text of ``events`` (date, text) with the first day of ``days`` (date) at or after its date, once
    a day, at its earliest date; texts behind the last day are left out.

    Dates meet days in ranges that carry one row each; the texts follow by a join on the date.
    """
    texts = events.select("date", "text").distinct()
    marks = days.select("date", F.col("date").alias("_day")).union(texts.select("date", F.lit(None).cast(days.schema["date"].dataType))).groupBy("date").agg(F.max("_day").alias("_day"))
    nxt = next_marked(marks, "date", "_day", "day").filter("day IS NOT NULL").select("date", "day")
    return texts.join(nxt, "date").groupBy("day", "text").agg(F.min("date").alias("date")).select("day", "date", "text")


def asof_forward(events: DataFrame, days: DataFrame, sep: str = " | ") -> DataFrame:
    """JN12. The texts of :func:`asof_rows` joined to one string a day, in the order of date and text; a text that the string so far contains is left out, as published.

    The string is the result, so a day's different texts are brought together here and only here; use the rows where a day may have very many.
    """
    listed = asof_rows(events, days).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("date", "text"))).alias("_t"))
    return listed.select("day", F.aggregate(
        "_t", F.lit(""), lambda acc, x: F.when(acc == "", x["text"]).when(F.contains(acc, x["text"]), acc)
        .otherwise(F.concat(acc, F.lit(sep), x["text"]))).alias("event"))


def overlay_by_date(base: DataFrame, overlay: DataFrame, key: str = "date", inherit: Sequence[str] = ("event",)) -> DataFrame:
    """JN13. Overlay rows replace base rows of the same date; the fields in ``inherit`` come from the base when set."""
    b, o = base.alias("b"), overlay.alias("o")
    cols = []
    for c in base.columns:
        bc, oc = F.col(f"b.{c}"), F.col(f"o.{c}")
        if c == key:
            cols.append(F.coalesce(oc, bc).alias(c))
        elif c in inherit:
            cols.append(F.coalesce(F.when(bc != "", bc), oc, F.lit("")).alias(c))
        else:
            cols.append(F.when(F.col(f"o.{key}").isNotNull(), oc).otherwise(bc).alias(c))
    return b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer").select(*cols)


def entity_candidate_slice(rows: DataFrame, asking: Column, eligible: Column, n: int = 20, bucket: Column | None = None) -> DataFrame:
    """JN14. For each asking row the newest ``n`` older eligible rows that share an entity key.

    ``rows`` has (id, ts, keys). Eligible rows are numbered inside each key in (ts, id) order, so the newest ``n``
    before a row are a range of numbers; rows meet in blocks of ``n`` numbers of one key, whatever the key's size. The numbers are worked
    out in ranges of equal row count, or in buckets of ``bucket``.
    The newest ``n`` over all keys are among the newest ``n`` of each key.
    """
    base = rows.withColumn("_ask", asking).withColumn("_ok", eligible)
    k = base.select("id", "ts", "_ask", "_ok", F.explode(F.array_distinct("keys")).alias("key"))
    k = k if bucket is not None else ranged(k, ["key"], ["ts", "id"])
    k = bucketed_running(k, ["key"], bucket if bucket is not None else F.col("_range"), ["ts", "id"], {"pos": F.col("_ok").cast("long")})
    cand = k.filter("_ok").select("key", "pos", F.floor(F.col("pos") / n).alias("blk"), F.col("id").alias("cand_id"), F.col("ts").alias("cand_ts"))
    before = F.col("pos") - F.col("_ok").cast("long")
    ask = k.filter("_ask").withColumn("hi", before).withColumn("lo", F.greatest(before - (n - 1), F.lit(1))).filter("hi >= 1")
    ask = ask.select("id", "key", "hi", "lo", F.explode(F.sequence(F.floor(F.col("lo") / n), F.floor(F.col("hi") / n))).alias("blk"))
    met = ask.join(cand, ["key", "blk"]).filter("pos BETWEEN lo AND hi").select("id", "cand_id", "cand_ts").distinct()
    return top_per_key(met, ["id"], [F.desc("cand_ts"), F.desc("cand_id")], n, "slot")


def batch_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, wanted: Sequence[int]) -> DataFrame:
    """JN15. One join for a list of ids in place of one query per id."""
    return left.filter(F.col(left_key).isin(*wanted)).join(right, F.col(left_key) == F.col(right_key), "left")


def count_per_parent(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, out: str) -> DataFrame:
    """JN16. Children per parent, zero included; counted before the join."""
    n = child.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(out))
    return parent.join(n, F.col(parent_key) == F.col("_k"), "left").drop("_k").fillna(0, [out])


def batch_update(target: DataFrame, updates: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """JN17. Columns of ``target`` replaced where ``updates`` has the key."""
    u = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    return target.join(u, F.col(key) == F.col("_k"), "left").select(
        *[F.coalesce(f"_n_{c}", c).alias(c) if c in cols else F.col(c) for c in target.columns])


def price_rules(model: Column, prompt_tokens: Column, rules: Sequence[dict]) -> dict[str, Column]:
    """JN18 as expressions: prices of the first rule that matches; unknown models get the dearest output price."""
    points = []
    for r in rules:
        points.append((r["input"], r["output"], r["cached"]))
        if r.get("long"):
            points.append((r["long"]["input"], r["long"]["output"], r["long"]["cached"]))
    dearest = max(points, key=lambda p: p[1])
    out = {}
    for i, name in enumerate(("input", "output", "cached")):
        price = None
        for r in rules:
            hit = tx.matches(model, r["pattern"], True)
            value = F.lit(float(r[name]))
            if r.get("long"):
                value = F.when(prompt_tokens > r["long"]["threshold"], float(r["long"][name])).otherwise(value)
            price = F.when(hit, value) if price is None else price.when(hit, value)
        out[name] = price.otherwise(float(dearest[i]))
    known = F.lit(False)
    for r in rules:
        known = known | tx.matches(model, r["pattern"], True)
    out["unknown"] = ~known
    return out


def price_rule_join(usage: DataFrame, rules: Sequence[dict], model: str, prompt: str, completion: str, cached: str) -> DataFrame:
    """JN18. Cost per usage row; cached prompt tokens are billed at the cached rate."""
    p = price_rules(F.col(model), F.col(prompt), rules)
    fresh = F.greatest(F.col(prompt) - F.col(cached), F.lit(0))
    cost = (fresh * p["input"] + F.col(cached) * p["cached"] + F.col(completion) * p["output"]) / 1e6
    return usage.withColumn("cost_usd", cost).withColumn("unknown", p["unknown"])


def docs_with_text(catalog: DataFrame, texts: DataFrame) -> DataFrame:
    """JN19. Every text object with its catalog facts; entity and title fall back to the path."""
    t = texts.select(F.col("path").alias("_p"), F.col("body"))
    j = t.join(catalog.select("path", "entity", "category", "title"), F.col("_p") == F.col("path"), "left")
    return j.select(F.col("_p").alias("path"), F.coalesce("entity", F.element_at(F.split("_p", "/"), 1)).alias("entity"),
                    F.coalesce("category", F.lit("")).alias("category"), F.coalesce("title", tx.basename(F.col("_p"))).alias("title"), "body")


def spend_join(acquired: DataFrame, spend: DataFrame) -> DataFrame:
    """JN20. Acquisition cost per month; both sides are summed by month first, so spend is not multiplied."""
    a = acquired.groupBy("month").agg(F.count("*").alias("customers_acquired"))
    s = spend.groupBy("month").agg(F.sum("spend").alias("total_spend"))
    return a.join(s, "month").select("month", "customers_acquired", "total_spend",
                                     (F.col("total_spend") / F.col("customers_acquired")).alias("cac"))
