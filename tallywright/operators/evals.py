"""Retrieval and evaluation metrics, gates, freshness, deadlines and health states."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import fixed, text as tx
from tallywright.functions.ordered import bucketed_row_number, bucketed_running


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _hours(a: Column, b: Column) -> Column:
    return (_us(a) - _us(b)) / 3.6e9


def _days(a: Column, b: Column) -> Column:
    return (_us(a) - _us(b)) / 8.64e10


# Retrieval -------------------------------------------------------------------------------------------------------

def relevance_match(hits: DataFrame, expect: DataFrame, text: str = "text", out: str = "relevant") -> DataFrame:
    """EV01. Marks hits that contain any expected substring of their query, without regard to case."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    found = F.exists("_e", lambda e: (F.length(e) > 0) & F.contains(hay, F.lower(e)))
    e = expect.select("query_id", F.col("expect").alias("_e"))
    return hits.join(e, "query_id", "left").withColumn(out, F.coalesce(found, F.lit(False))).drop("_e")


def query_metrics(marked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """EV02, EV03, EV04. Precision, hit and reciprocal rank per query; ``rank`` starts at 1; queries without hits score 0."""
    top = F.col("rank") <= k
    rel = F.col("relevant")
    g = marked.groupBy("query_id").agg(F.count_if(top & rel).alias("_rel"), F.count_if(top).alias("_n"),
                                       F.min(F.when(rel, F.col("rank"))).alias("_first"))
    q = queries.select("query_id").join(g, "query_id", "left")
    return q.select("query_id", F.coalesce(F.try_divide(F.col("_rel"), F.col("_n")), F.lit(0.0)).alias("precision"),
                    F.when(F.col("_rel") > 0, 1).otherwise(0).alias("hit"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("rr"))


def retrieval_summary(metrics: DataFrame) -> DataFrame:
    """EV04. Means over the queries."""
    return metrics.agg(F.count("*").alias("n"), F.avg("precision").alias("mean_precision"), F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"))


def group_hit_lines(lines: DataFrame, key: str, order: str, line: str, block: int = 4096) -> DataFrame:
    """EV05. A header line ``[agent] [type] ...`` opens a hit; the lines below are joined to it. Lines before the first header form a hit."""
    head = F.col(line).rlike(r"^\[[^\]]+\]\s*\[[^\]]+\]\s")
    l = lines.withColumn("_h", head.cast("long"))
    l = bucketed_running(l, [key], F.floor(F.col(order) / block), [order], {"_raw": F.col("_h")})
    # A text that starts without a header has a hit 0, so the hits are numbered again from 1.
    g = l.groupBy(key, "_raw").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line]), " ").alias("text"))
    return bucketed_row_number(g, [key], F.floor(F.col("_raw") / block), ["_raw"], "hit_no").drop("_raw")


def hard_negative_score(hits: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """EV06. Per case: the new statement is found and the old one is not, in the first ``k`` hits."""
    hay = F.lower(F.coalesce("text", F.lit("")))
    has = lambda arr: F.coalesce(F.exists(arr, lambda e: (F.length(e) > 0) & F.contains(hay, F.lower(e))), F.lit(False))
    j = hits.filter(F.col("rank") <= k).join(cases, "query_id")
    g = j.groupBy("query_id").agg(F.max(has("expect_new").cast("int")).alias("new_hit"), F.max(has("expect_old").cast("int")).alias("old_leak"))
    c = cases.select("query_id").join(g, "query_id", "left").fillna(0, ["new_hit", "old_leak"])
    return c.withColumn("passed", ((F.col("new_hit") == 1) & (F.col("old_leak") == 0)).cast("int"))


def hard_negative_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.avg("new_hit").alias("correct_rate"), F.avg("old_leak").alias("leak_rate"), F.avg("passed").alias("pass_rate"))


# Scorecards ------------------------------------------------------------------------------------------------------

def baseline_gate(current: DataFrame, baseline: DataFrame, keys: Sequence[str], tolerance: float = 0.05, enforce: bool = False) -> DataFrame:
    """EV07. Average against baseline per key; no baseline or an empty run is not a regression."""
    # Scores are summed as decimals, so an average does not depend on the order of its rows.
    mean = F.sum(F.col("score").cast("decimal(24,9)")).cast("double") / F.count("score")
    c = current.groupBy(*keys).agg(mean.alias("avg"), F.count("*").alias("total"))
    b = baseline.groupBy(*keys).agg(mean.alias("baseline_avg"), F.count("*").alias("_bt"))
    j = c.join(b, list(keys), "left")
    delta = F.col("avg") - F.col("baseline_avg")
    reg = F.coalesce(delta < -tolerance, F.lit(False))
    return j.select(*keys, "avg", "baseline_avg", delta.alias("delta"), F.col("baseline_avg").isNotNull().alias("has_baseline"),
                    reg.alias("regressed"), (reg & F.lit(enforce)).alias("blocked"))


def judge_agreement(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """EV08. Score distance and agreement rates over JN07 rows; the disagreements are the rows with ``NOT verdict_agree``."""
    return compared.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("score_delta").alias("mean_abs_delta"), F.max("score_delta").alias("max_delta"),
        F.avg(F.col("verdict_agree").cast("int")).alias("verdict_agreement_rate"), F.avg("criterion_agreement").alias("mean_criterion_agreement"),
        F.count_if(~F.col("verdict_agree")).alias("disagreements"))


def panel_score(judged: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """EV09. Mean of the finite scores, agreement from their spread, and a confidence label."""
    s = F.when(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")), F.col(score))
    g = judged.groupBy(*key).agg(F.avg(s).alias("panel_score"), F.count("*").alias("judges_attempted"), F.count(s).alias("judges_surviving"), F.stddev_pop(s).alias("_sd"))
    agr = F.when(F.col("judges_surviving") >= 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_sd") / 0.5)))
    g = g.withColumn("agreement", agr)
    label = (F.when(F.col("judges_surviving") == 0, "unscored").when(F.col("judges_surviving") < 2, "low")
             .when(F.col("agreement") >= 0.8, "high").when(F.col("agreement") >= 0.5, "medium").otherwise("low"))
    return g.withColumn("confidence", label).drop("_sd")


def calibration_fit(pairs: DataFrame) -> DataFrame:
    """EV10. Monotone points (x, y): mean human score per panel score rounded to three decimals, running maximum, anchored at 0 and 1.

    Rounding leaves at most 1001 points, so the ordered steps work on a small table whatever the input size.
    """
    p = pairs.filter(F.col("panel_score").isNotNull() & F.col("human_score").isNotNull())
    b = p.groupBy(F.round("panel_score", 3).alias("x")).agg(F.avg("human_score").alias("m"))
    b = b.withColumn("y", F.max("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).select("x", "y")
    ends = b.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("y").alias("top"), F.count("*").alias("n"))
    first = ends.filter("n = 0 OR lo > 0").select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    last = ends.filter("n = 0 OR hi < 1").select(F.lit(1.0).alias("x"), F.coalesce("top", F.lit(1.0)).alias("y"))
    clamp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("y")))
    return b.unionByName(first).unionByName(last).select("x", clamp.alias("y"))


def calibration_apply(scores: DataFrame, points: DataFrame, score: str = "panel_score", out: str = "calibrated") -> DataFrame:
    """EV11. Linear interpolation between the bracketing points.

    The points (at most 1003) become one sorted array that every row searches, so no range join is needed.
    """
    arr = points.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p")).scalar()
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    s = scores.withColumn("_p", arr).withColumn("_x", x)
    hi = F.expr("filter(_p, q -> q.x >= _x)[0]")
    lo = F.expr("element_at(filter(_p, q -> q.x <= _x), -1)")
    s = s.withColumn("_hi", hi).withColumn("_lo", lo)
    span = F.col("_hi.x") - F.col("_lo.x")
    y = F.when(span == 0, F.col("_lo.y")).otherwise(F.col("_lo.y") + (F.col("_x") - F.col("_lo.x")) / F.when(span != 0, span) * (F.col("_hi.y") - F.col("_lo.y")))
    return s.withColumn(out, F.when(F.col(score).isNull() | (F.size("_p") < 2), F.col(score)).otherwise(y)).drop("_p", "_x", "_hi", "_lo")


def scorecard_summary(card: DataFrame, keys: Sequence[str] = (), floor: float = 0.6) -> DataFrame:
    """EV12. Passed, total and average with the floor flag."""
    g = card.groupBy(*keys).agg(F.count_if("pass").alias("passed"), F.count("*").alias("total"), F.avg("score").alias("avg"))
    return g.withColumn("below_floor", (F.col("total") > 0) & (F.col("avg") < floor))


def repair_plan_by_source(diff: DataFrame, prompts: DataFrame, changed: Sequence[str] | None = None) -> DataFrame:
    """EV13. Regressions per prompt file with their worst drop; rows without a usable file are counted with the reason."""
    r = diff.filter("regressed").join(prompts.select("id", "prompt_file"), "id", "left")
    has = F.coalesce("prompt_file", F.lit("")) != ""
    inside = F.lit(True) if changed is None else F.coalesce(F.col("prompt_file").isin(*changed), F.lit(False))
    why = F.when(~has, "no_prompt_file").when(~inside, "outside_diff").otherwise("repair")
    return r.select(F.when(why == "repair", F.col("prompt_file")).alias("prompt_file"), why.alias("outcome"), "delta").groupBy(
        "outcome", "prompt_file").agg(F.count("*").alias("n_tasks"), F.least(F.min("delta"), F.lit(0.0)).alias("worst_delta"))


def probe_drift(probes: DataFrame, baseline: DataFrame, top_drop: float = 0.15, coverage_drop: float = 0.2) -> DataFrame:
    """EV14. Mean top score, coverage and hits per index against the baseline; an index without a baseline does not drift."""
    g = probes.groupBy("index").agg(F.avg(F.coalesce("top_score", F.lit(0.0))).alias("top_score"),
                                    F.avg((F.col("hit_count") > 0).cast("int")).alias("coverage"), F.avg("hit_count").alias("hits"))
    b = baseline.select("index", F.col("top_score").alias("_bt"), F.col("coverage").alias("_bc"))
    j = g.join(b, "index", "left")
    ds, dc = F.col("top_score") - F.col("_bt"), F.col("coverage") - F.col("_bc")
    return j.withColumn("has_baseline", F.col("_bt").isNotNull()).withColumn(
        "drifted", F.coalesce((ds < -top_drop) | (dc < -coverage_drop), F.lit(False))).drop("_bt", "_bc")


# Freshness and health --------------------------------------------------------------------------------------------

def freshness(events: DataFrame, slo: DataFrame, stream: str, now: Column, ts: str = "ts") -> DataFrame:
    """EV15. FRESH, STALE or NO_DATA per declared stream."""
    n = events.groupBy(stream).agg(F.max(ts).alias("_newest"))
    j = slo.join(n, stream, "left")
    age = _hours(now, F.col("_newest"))
    state = F.when(F.col("_newest").isNull(), "NO_DATA").when(age <= F.col("max_age_h"), "FRESH").otherwise("STALE")
    return j.select(stream, state.alias("state"), F.round(age, 1).alias("age_h"), "max_age_h")


def block_drift(docs: DataFrame, text: str, start: str, end: str, canonical: str, window: int = 60) -> DataFrame:
    """EV16. The block from the line with ``start`` to the line that begins with ``end`` against the canonical text."""
    lines = F.split(F.col(text), "\n")
    d = docs.withColumn("_l", lines).withColumn("_s", F.array_position(F.transform("_l", lambda l: F.contains(l, F.lit(start))), True))
    d = d.withColumn("_w", F.when(F.col("_s") > 0, F.slice("_l", F.greatest(F.col("_s").cast("int"), F.lit(1)), F.lit(window))))
    d = d.withColumn("_e", F.coalesce(F.array_position(F.transform("_w", lambda l: F.ltrim(l).startswith(end)), True), F.lit(0)))
    block = F.when(F.col("_e") > 0, F.array_join(F.slice("_w", F.lit(1), F.greatest(F.col("_e").cast("int"), F.lit(1))), "\n"))
    norm = tx.collapse_spaces(block)
    state = F.when(F.col(text).isNull(), "NO_DATA").when(block.isNull(), "ABSENT").when(norm == " ".join(canonical.split()), "MATCH").otherwise("DRIFTED")
    return d.withColumn("state", state).drop("_l", "_s", "_w", "_e")


def agent_health(roster: DataFrame, shared: DataFrame, now: Column, stale_min: int = 1440) -> DataFrame:
    """EV17. LIVE, STALE or NO-DATA per agent of the roster."""
    n = shared.groupBy("agent").agg(F.max("ts").alias("_t"))
    age = F.round(_hours(now, F.col("_t")) * 60).cast("long")
    return roster.join(n, "agent", "left").select("agent", F.when(F.col("_t").isNull(), "NO-DATA").when(age <= stale_min, "LIVE").otherwise("STALE").alias("status"), age.alias("age_min"))


def condition_ladder(health: DataFrame, beacons: DataFrame, state: DataFrame, now: Column, fresh_min: int = 120,
                     cooldown_min: int = 360, escalate_after: int = 3, dark_consecutive: int = 2) -> DataFrame:
    """EV18. Condition, severity, dispatch and escalation per agent from three sources, first rule wins."""
    h = health.select("agent", F.col("status").alias("h_status"), F.col("age_min").alias("h_age"))
    b = beacons.select("agent", F.col("status").alias("b_status"), F.col("age_min").alias("b_age"), "hooks_wired", "ledger_size", F.lit(True).alias("_b"))
    s = state.select("agent", "last_dispatch", "consecutive_dark", "dark_streak")
    j = h.join(b, "agent", "full_outer").join(s, "agent", "left")
    fresh = F.coalesce(F.col("b_age") <= fresh_min, F.lit(False))
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    dark = fresh & (is_("b_status", "DARK") | is_("hooks_wired", False) | is_("ledger_size", 0))
    cond = (F.when(fresh & is_("b_status", "starting"), "STARTING").when(dark, "DARK")
            .when((fresh & is_("b_status", "LIVE")) | is_("h_status", "LIVE"), "HEALTHY")
            .when(is_("h_status", "NO-DATA") & F.col("_b").isNull(), "NO-MEMORY").otherwise("WATCH"))
    j = j.withColumn("condition", cond)
    j = j.withColumn("dark_streak", F.when(F.col("condition") == "DARK", F.coalesce("dark_streak", F.lit(0)) + 1).otherwise(0))
    wants = F.col("condition").isin("DARK", "NO-MEMORY")
    since = _hours(now, F.col("last_dispatch")) * 60
    dispatch = wants & F.coalesce(since >= cooldown_min, F.lit(True)) & ((F.col("condition") != "DARK") | (F.col("dark_streak") >= dark_consecutive))
    cons = F.when(wants, F.coalesce("consecutive_dark", F.lit(0)) + dispatch.cast("int")).otherwise(0)
    sev = F.when(wants, "high").when(F.col("condition").isin("STARTING", "HEALTHY"), "ok").otherwise("low")
    return j.select("agent", "condition", sev.alias("severity"), dispatch.alias("dispatch"), (wants & (cons >= escalate_after)).alias("escalate"), "dark_streak", cons.alias("consecutive_dark"))


# Deadlines -------------------------------------------------------------------------------------------------------

def sla_class(rows: DataFrame, now: Column, near_due_days: int = 2, severe_multiple: int = 3) -> DataFrame:
    """EV19. closed, overdue, near-due, ack or open with days and the terminal flag."""
    diff = _days(F.col("expected_by"), now)
    idle = F.when(F.col("status") == "ack", "ack").otherwise("open")
    state = F.when(F.col("status") == "closed", "closed").when(diff.isNull(), idle).when(diff < 0, "overdue").when(diff <= near_due_days, "near-due").otherwise(idle)
    r = rows.withColumn("state", state)
    over = F.when(F.col("state") == "overdue", -diff).otherwise(0.0)
    until = F.when(F.col("state") == "overdue", 0.0).when(F.col("state") == "closed", None).otherwise(diff)
    term = (F.col("state") == "overdue") & (F.col("status") == "open") & F.coalesce(F.col("terminal_policy").isin(*fixed.TERMINAL_POLICIES), F.lit(False)) & (over > near_due_days * severe_multiple)
    return r.withColumn("days_overdue", over).withColumn("days_until_due", until).withColumn("terminal", term)


def tier_of(category: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in fixed.TIER_BY_CATEGORY.items() for x in kv])
    return F.coalesce(F.element_at(m, category), F.lit(2))


def nudge_lines(classified: DataFrame, tier_one_only: Sequence[str], tier: Column) -> DataFrame:
    """EV20. One line per item that needs attention, numbered inside its owner, longest overdue first."""
    block = F.col("terminal") & (F.col("terminal_policy") == "block")
    keep = F.col("state").isin("overdue", "near-due") & ~(F.col("terminal") & (F.col("terminal_policy") == "proceed"))
    keep = keep & ~(F.col("owner").isin(*tier_one_only) & (tier != 1) & ~F.coalesce(block, F.lit(False)))
    r = classified.filter(F.coalesce(keep, F.col("state").isin("overdue", "near-due"))).withColumn("blocking", F.coalesce(block, F.lit(False)))
    tag = F.when(F.col("state") == "overdue", F.concat(F.lit("OVERDUE "), F.round("days_overdue").cast("long").cast("string"), F.lit("d"))).otherwise(
        F.concat(F.lit("due in "), F.ceil("days_until_due").cast("string"), F.lit("d")))
    prefix = F.when(F.col("blocking"), "BLOCKING ").when(F.col("terminal") & (F.col("terminal_policy") == "escalate"), "ESCALATED ").otherwise("")
    r = r.withColumn("line", F.concat(prefix, F.lit("["), "category", F.lit("] "), F.col("id").cast("string"), F.lit(" ("), tag, F.lit(")"))).withColumn("_w", -F.col("days_overdue"))
    return bucketed_row_number(r, ["owner"], F.floor("_w"), ["_w", "id"], "line_no").drop("_w")


def nudge_batches(lines: DataFrame) -> DataFrame:
    """EV20. One row per owner with its totals; the message is the owner's lines in ``line_no`` order."""
    return lines.groupBy("owner").agg(F.count("*").alias("count"), F.count_if("blocking").alias("blocking"), F.max("days_overdue").alias("longest_overdue"))


def pageable_deadlines(docket: DataFrame, now: Column, window_days: int = 7) -> DataFrame:
    """EV21. Every docket row with its namespace, whether it pages, and the reason when it does not."""
    left = F.datediff(F.col("date"), now)
    tight = F.coalesce(left <= window_days, F.lit(False))
    ver = F.coalesce("verified", F.lit(True))
    key = F.concat(F.lit("leg_"), F.substring(F.sha2(F.concat_ws("|", "ns", F.col("id").cast("string"), F.col("date").cast("string"), "what"), 256), 1, 24))
    return docket.withColumn("row_key", key).withColumn("pageable", ver & tight).withColumn("lane", F.when(F.col("ns") == "personal", "personal").otherwise("company")).withColumn(
        "reason", F.when(~ver, "unverified").when(~tight, "out-of-window"))


def grant_expiry(grants: DataFrame, now: Column, soon_days: int = 60) -> DataFrame:
    """EV22. Active grants by the time left of their term."""
    left = F.round(_days(F.add_months(F.to_date("added"), F.col("term_months")), now)).cast("long")
    g = grants.filter(F.col("status") == "active").withColumn("days_left", F.when(F.coalesce("term_months", F.lit(0)) != 0, left))
    return g.withColumn("condition", F.when(F.col("days_left").isNull(), "no-term-data").when(F.col("days_left") < 0, "lapsed-but-still-active")
                        .when(F.col("days_left") <= soon_days, "expiring-soon").otherwise("healthy"))


def review_overdue(shipped: DataFrame, reviews: DataFrame, key: str, now: Column, overdue_days: int = 7, high_days: int = 21) -> DataFrame:
    """EV23. Shipped rows without a review."""
    age = _days(now, F.col("uploaded"))
    rows = shipped.filter(~F.coalesce(F.col("status").rlike("(?i)superseded"), F.lit(False)) & F.col("uploaded").isNotNull()).withColumn("age_days", age)
    return rows.filter(F.col("age_days") >= overdue_days).join(reviews.select(key), key, "left_anti").withColumn(
        "severity", F.when(F.col("age_days") >= high_days, "high").otherwise("medium"))


def signal_cooldown(history: DataFrame, signals: DataFrame, now: Column, cooldown_min: int = 360, escalate_after: int = 3) -> DataFrame:
    """EV24. Fire when the last firing is old enough; escalate from the third on."""
    h = history.groupBy("signal").agg(F.max("ts").alias("_last"), F.count("*").alias("_n"))
    j = signals.join(h, "signal", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    since = _hours(now, F.col("_last")) * 60
    fire = F.coalesce(since >= cooldown_min, F.lit(True))
    n = F.col("_n") + fire.cast("int")
    return j.select("signal", fire.alias("fire"), (fire & (n >= escalate_after)).alias("escalate"), n.alias("consecutive"))


FIRING_LABELS = ["contradict", "stale-with-material-drift"]


def verdict_gate(verdicts: DataFrame, slices: DataFrame, now: Column, stale_days: int = 21) -> DataFrame:
    """EV25. A verdict fires only when it cites a row of the slice it was shown; staleness needs an old enough row."""
    s = slices.select(F.col("id").alias("_i"), F.col("cand_id").alias("_c"), F.col("cand_ts").alias("_t"))
    j = verdicts.join(s, (F.col("row_id") == F.col("_i")) & (F.col("cited_id") == F.col("_c")), "left")
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    fires = label.isin(*FIRING_LABELS)
    young = (label == "stale-with-material-drift") & (_days(now, F.col("_t")) < stale_days)
    reason = F.when(~fires, "not a firing label").when(F.col("_c").isNull(), "cited id not in slice").when(young, "cited row too young").otherwise("grounded")
    return j.select("row_id", F.when(label == "", "agree").otherwise(label).alias("label"), "cited_id", (reason == "grounded").alias("fires"), reason.alias("gate"))


def expected_vs_observed(expected: DataFrame, observed: DataFrame, id: str = "id") -> DataFrame:
    """EV26. Mismatching keys per scenario; both sides carry a map of strings."""
    e = expected.select(id, F.explode("expected").alias("key", "want"))
    j = e.join(observed.select(id, "observed"), id, "left")
    got = F.try_element_at("observed", F.col("key"))
    g = j.withColumn("_bad", ~F.col("want").eqNullSafe(got)).groupBy(id).agg(
        F.count("*").alias("checked"), F.count_if("_bad").alias("mismatches"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_bad"), F.col("key")))), ",").alias("mismatched"))
    return g.withColumn("ok", F.col("mismatches") == 0)


def lane_class(lane: Column, private_pattern: str) -> Column:
    """EV27. restricted or general; a missing lane is restricted."""
    return F.when((F.coalesce(lane, F.lit("")) == "") | lane.rlike(private_pattern), "restricted").otherwise("general")


_REVIEW = "verdict STRING, issues ARRAY<STRUCT<severity: STRING, note: STRING>>, confidence DOUBLE"


def note_review_gate(notes: DataFrame, raw: str, min_severity: str = "medium") -> DataFrame:
    """EV28. Revise when the verdict says so and any issue is severe enough, or none is listed; broken output never revises."""
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col(raw))
    obj = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    n = notes.withColumn("_v", F.when(F.length(obj) > 0, F.from_json(obj, _REVIEW)))
    order = F.create_map(*[F.lit(x) for kv in {"low": 1, "medium": 2, "high": 3}.items() for x in kv])
    rank = lambda s: F.coalesce(F.try_element_at(order, s), F.lit(2))
    ok = F.coalesce(F.col("_v.verdict").isin("revise", "approve"), F.lit(False))
    issues = F.col("_v.issues")
    severe = F.coalesce(F.size(issues) <= 0, F.lit(True)) | F.exists(issues, lambda i: rank(i["severity"]) >= {"low": 1, "medium": 2, "high": 3}[min_severity])
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_v.confidence", F.lit(0.5))))
    return n.withColumn("malformed", ~ok).withColumn("verdict", F.when(ok, F.col("_v.verdict")).otherwise("approve")).withColumn(
        "confidence", F.when(ok, conf).otherwise(0.0)).withColumn("revise", ok & (F.col("_v.verdict") == "revise") & F.coalesce(severe, F.lit(True))).drop("_v")


def retention_select(rows: DataFrame, rules: DataFrame, container: str, now: Column, ts: str = "ts") -> DataFrame:
    """EV29. keep, delete or archive per row by the age rule of its container; containers without a rule are only reported."""
    r = rules.select(F.col("container").alias("_c"), "max_age_days", "archive")
    j = rows.join(r, F.col(container) == F.col("_c"), "left")
    old = _days(now, F.col(ts)) > F.col("max_age_days")
    ym = F.date_format(ts, "yyyy-MM")
    agent = F.regexp_replace(F.lower(F.coalesce("agent", F.lit("unknown"))), "[^a-z0-9_-]", "_")
    return j.withColumn("action", F.when(F.col("_c").isNull(), "report").when(old & F.col("archive"), "archive").when(old, "delete").otherwise("keep")).withColumn(
        "archive_path", F.when(F.col("action") == "archive", F.concat(F.lit("_ARCHIVE/episodes/"), agent, F.lit("/"), ym, F.lit(".jsonl")))).drop("_c", "max_age_days", "archive")


def archive_move(active: DataFrame, ids: DataFrame, key: str, stamp: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """EV30. (stamped archive rows, rows that stay active)."""
    chosen = ids.select(key).distinct()
    moved = active.join(chosen, key, "left_semi").withColumn("archived_at", stamp).withColumn("archive_reason", F.lit(reason))
    return moved, active.join(chosen, key, "left_anti")


def heartbeat_status(registry: DataFrame, beats: DataFrame, key: str, now: Column) -> DataFrame:
    """EV31. NO-DATA, DEAD, LATE or LIVE for every registered or seen job."""
    b = beats.groupBy(key).agg(F.max("ts").alias("_last"))
    j = registry.join(b, key, "full_outer")
    age = F.round(_hours(now, F.col("_last")) * 60).cast("long")
    i = F.when(F.col("interval_min") > 0, F.col("interval_min"))
    st = (F.when(i.isNull() & F.col("_last").isNull(), "NO-DATA").when(F.col("_last").isNull(), "DEAD").when(age > i * 3, "DEAD").when(age > i, "LATE").otherwise("LIVE"))
    return j.select(key, st.alias("status"), age.alias("age_min"), i.alias("interval_min"))


def clean_tail_streak(receipts: DataFrame, key: Sequence[str], passed: Column, order: Sequence[str], need: int = 2) -> DataFrame:
    """EV32. Passing receipts after the last failure per key, without sorting any group."""
    o = F.struct(*order)
    fail = receipts.groupBy(*key).agg(F.max(F.when(~passed, o)).alias("_f"))
    j = receipts.join(fail, list(key))
    g = j.groupBy(*key).agg(F.count_if(F.col("_f").isNull() | (o > F.col("_f"))).alias("streak"), F.count("*").alias("receipts"))
    return g.withColumn("gate", F.col("streak") >= need)


def due_for_refresh(registry: DataFrame, snapshots: DataFrame, key: str, now: Column, stale_hours: float = 20.0) -> DataFrame:
    """EV33. Whether each unit is due and whether its content hash changed since the last snapshot."""
    s = snapshots.select(key, "staged_at", F.col("hash").alias("_old"))
    j = registry.join(s, key, "left")
    return j.select(key, F.coalesce(_hours(now, F.col("staged_at")) > stale_hours, F.lit(True)).alias("due"), (~F.col("hash").eqNullSafe(F.col("_old"))).alias("changed"))


STATUS_WEIGHT = {"not_implemented": 0.0, "partial": 0.5, "implemented": 0.8, "verified": 1.0}


def control_coverage(threats: DataFrame, controls: DataFrame, max_effect: float = 4.0) -> DataFrame:
    """EV34. Coverage of each threat by its controls, depth, diversity and the first gap reason."""
    w = F.create_map(*[F.lit(x) for kv in STATUS_WEIGHT.items() for x in kv])
    c = controls.withColumn("_s", F.element_at(w, F.col("status")) * F.col("effectiveness"))
    on = F.col("status") != "not_implemented"
    g = c.groupBy("threat").agg(F.sum("_s").alias("_sum"), F.count("*").alias("controls"), F.count_distinct(F.when(on, F.col("layer"))).alias("layers"),
                                F.count_distinct(F.when(on, F.col("kind"))).alias("kinds"), F.avg(F.col("test_passed").cast("int")).alias("test_pass_rate"))
    j = threats.join(g, "threat", "left").fillna(0, ["_sum", "controls", "layers", "kinds"])
    cov = F.coalesce(F.try_divide(F.col("_sum"), F.col("controls") * max_effect) * 100, F.lit(0.0))
    j = j.withColumn("coverage", cov)
    gaps = F.array_compact(F.array(F.when(F.col("coverage") < 50, "insufficient_coverage"), F.when(F.col("layers") < 2, "no_depth"), F.when(F.col("kinds") < 2, "no_diversity")))
    return j.withColumn("gaps", F.array_join(gaps, ",")).drop("_sum")


def weighted_coverage(covered: DataFrame, weight: str = "risk") -> DataFrame:
    """EV34. Coverage over all threats weighted by their risk."""
    return covered.agg(F.count("*").alias("threats"), F.count_if(F.col("controls") == 0).alias("unmapped"), F.count_if(F.col("gaps") != "").alias("with_gaps"),
                       F.try_divide(F.sum(F.col("coverage") * F.col(weight)), F.sum(weight)).alias("weighted_coverage"))
