"""Ratios, valuations, KPI, service levels and billing. Money is double; rounding happens in reports only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import fixed
from tallywright.operators.joins import asof_forward, overlay_by_date
from tallywright.operators.windows import daily_change
from tallywright.sources.feeds import upsert_by_id


def _div(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def financial_ratios(st: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FN01. Ratios per statement row; a missing field counts as 0. ``peg_ratio`` is null unless growth is positive."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in st.columns else F.lit(0.0)
    ni, eq, rev, cogs, oi = c("net_income"), c("shareholders_equity"), c("revenue"), c("cost_of_goods_sold"), c("operating_income")
    ca, cl, inv, cash, debt = c("current_assets"), c("current_liabilities"), c("inventory"), c("cash_and_equivalents"), c("total_debt")
    price, shares = c("share_price"), c("shares_outstanding")
    eps, bvps, growth = _div(ni, shares), _div(eq, shares), c("earnings_growth_rate")
    turn, pe = _div(rev, c("accounts_receivable")), _div(price, eps)
    r = {
        "roe": _div(ni, eq), "roa": _div(ni, c("total_assets")), "gross_margin": _div(rev - cogs, rev), "operating_margin": _div(oi, rev), "net_margin": _div(ni, rev),
        "current_ratio": _div(ca, cl), "quick_ratio": _div(ca - inv, cl), "cash_ratio": _div(cash, cl),
        "debt_to_equity": _div(debt, eq), "interest_coverage": _div(c("ebit"), c("interest_expense")),
        "debt_service_coverage": _div(oi, c("interest_expense") + c("current_portion_long_term_debt")),
        "asset_turnover": _div(rev, c("total_assets")), "inventory_turnover": _div(cogs, inv), "receivables_turnover": turn, "days_sales_outstanding": _div(F.lit(365.0), turn),
        "pe_ratio": pe, "eps": eps, "pb_ratio": _div(price, bvps), "book_value_per_share": bvps, "ps_ratio": _div(price * shares, rev),
        "ev_to_ebitda": _div(price * shares + debt - cash, c("ebitda")), "peg_ratio": F.when(growth > 0, _div(pe, growth * 100)),
    }
    return st.select(*keys, *[v.alias(n) for n, v in r.items()])


def ratio_rating(ratios: DataFrame, keys: Sequence[str], industry: str) -> DataFrame:
    """FN02. One row per statement and rated ratio with its band in the industry (column name of the industry)."""
    names = ["current_ratio", "debt_to_equity", "roe", "gross_margin", "pe_ratio"]
    long = ratios.select(*keys, F.lower(industry).alias("_i"), F.explode(F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(n).alias("value")) for n in names])).alias("_r")).select(*keys, "_i", "_r.*")
    table = []
    for ind, rows in fixed.RATIO_BENCHMARKS.items():
        for n, b in rows.items():
            table += [F.lit(f"{ind}|{n}"), F.array(*[F.lit(float(x)) for x in b])]
    m = F.create_map(*table)
    known = F.when(F.col("_i").isin(*fixed.RATIO_BENCHMARKS), F.col("_i")).otherwise("general")
    long = long.withColumn("_b", F.try_element_at(m, F.concat_ws("|", known, "ratio")))
    v, b = F.col("value"), F.col("_b")
    high = F.when(v >= b[0], "Excellent").when(v >= b[1], "Good").when(v >= b[2], "Acceptable").otherwise("Poor")
    low = F.when(v <= b[0], "Excellent").when(v <= b[1], "Good").when(v <= b[2], "Acceptable").otherwise("Poor")
    pe = F.when(v <= 0, "N/A").when(v < b[0], "Potentially Undervalued").when(v < b[1], "Fair Value").when(v < b[2], "Growth Premium").otherwise("Expensive")
    rating = F.when(b.isNull(), "N/A").when(F.col("ratio") == "debt_to_equity", low).when(F.col("ratio") == "pe_ratio", pe).otherwise(high)
    return long.withColumn("rating", rating).drop("_i", "_b")


def ratio_trend(values: DataFrame, keys: Sequence[str], period: str, ratio: str, value: str) -> DataFrame:
    """FN03. First against last period per key and ratio."""
    g = values.groupBy(*keys, ratio).agg(F.min_by(value, period).alias("_f"), F.max_by(value, period).alias("_l"), F.count("*").alias("periods"))
    change = F.col("_l") - F.col("_f")
    pct = _div(change, F.abs("_f")) * 100
    g = g.withColumn("change", F.when(F.col("periods") >= 2, change)).withColumn("pct_change", F.when(F.col("periods") >= 2, pct))
    up = (F.col("pct_change") > 0) == (F.col(ratio) != "debt_to_equity")
    return g.withColumn("trend", F.when(F.col("periods") < 2, "Insufficient data").when(F.abs("pct_change") < 5, "Stable").when(up, "Improving").otherwise("Deteriorating")).drop("_f", "_l")


def dcf_projection(companies: DataFrame, key: Sequence[str], base: str, growth: Column, margin: Column, capex: Column, nwc: Column, tax_rate: Column) -> DataFrame:
    """FN04. One row per company and year. The assumptions are arrays of one length, one entry per year.

    Revenue of a year is the base times the product of the growth factors so far; working capital of the year before the
    first is a tenth of the base.
    """
    c = companies.select(*key, F.col(base).cast("double").alias("_b"), growth.alias("_g"), margin.alias("_m"), capex.alias("_x"), nwc.alias("_n"), tax_rate.alias("_t"))
    y = c.select("*", F.explode(F.sequence(F.lit(1), F.size("_g"))).alias("year"))
    path = lambda n: F.col("_b") * F.aggregate(F.slice("_g", F.lit(1), n), F.lit(1.0), lambda a, g: a * (1 + g))
    i = F.col("year") - 1
    y = y.withColumn("revenue", path(F.col("year"))).withColumn("_prev", path(i))
    ebitda, dep = F.col("revenue") * F.col("_m")[i], F.col("revenue") * F.col("_x")[i]
    y = y.withColumn("ebitda", ebitda).withColumn("ebit", F.col("ebitda") - dep).withColumn("tax", F.col("ebit") * F.col("_t")).withColumn("nopat", F.col("ebit") - F.col("tax")).withColumn("capex", dep)
    before = F.when(F.col("year") == 1, F.col("_b") * 0.10).otherwise(F.col("_prev") * F.try_element_at("_n", i))
    y = y.withColumn("nwc_change", F.col("revenue") * F.col("_n")[i] - before)
    return y.select(*key, "year", "revenue", "ebitda", "ebit", "tax", "nopat", "capex", "nwc_change", (F.col("nopat") - F.col("nwc_change")).alias("fcf"))


def wacc(risk_free: Column, beta: Column, premium: Column, cost_of_debt: Column, debt_to_equity: Column, tax_rate: Column) -> Column:
    """FN05. Weighted cost of capital with the cost of equity from the capital asset pricing model."""
    equity = 1 / (1 + debt_to_equity)
    return equity * (risk_free + beta * premium) + (1 - equity) * cost_of_debt * (1 - tax_rate)


def dcf_valuation(projection: DataFrame, key: Sequence[str], terms: DataFrame, method: str = "growth") -> DataFrame:
    """FN05. Enterprise and equity value per company. ``terms`` has (key, wacc, terminal_growth, exit_multiple, net_debt, shares)."""
    p = projection.join(terms, list(key))
    w = F.col("wacc")
    g = p.groupBy(*key).agg(
        F.sum(F.col("fcf") / F.pow(1 + w, F.col("year"))).alias("pv_fcf"), F.max("year").alias("_y"), F.max_by("fcf", "year").alias("_fcf"), F.max_by("ebitda", "year").alias("_e"),
        F.first("wacc").alias("wacc"), F.first("terminal_growth").alias("_tg"), F.first("exit_multiple").alias("_x"), F.first("net_debt").alias("net_debt"), F.first("shares").alias("shares"))
    tv = F.col("_fcf") * (1 + F.col("_tg")) / (F.col("wacc") - F.col("_tg")) if method == "growth" else F.col("_e") * F.coalesce("_x", F.lit(10.0))
    g = g.withColumn("terminal_value", tv).withColumn("pv_terminal", F.col("terminal_value") / F.pow(1 + F.col("wacc"), F.col("_y")))
    g = g.withColumn("enterprise_value", F.col("pv_fcf") + F.col("pv_terminal")).withColumn("terminal_percent", _div(F.col("pv_terminal"), F.col("enterprise_value")) * 100)
    g = g.withColumn("equity_value", F.col("enterprise_value") - F.col("net_debt"))
    return g.withColumn("value_per_share", F.when(F.col("shares") > 0, F.col("equity_value") / F.col("shares")).otherwise(0.0)).drop("_y", "_fcf", "_e", "_tg", "_x")


def _explode_values(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def sensitivity_grid(projection: DataFrame, key: Sequence[str], terms: DataFrame, waccs: Sequence[float], growths: Sequence[float]) -> DataFrame:
    """FN06. Enterprise value per company for each pair of cost of capital and terminal growth.

    The grid is a fixed list, so every terms row is expanded in place.
    """
    grid = _explode_values(_explode_values(terms.drop("wacc", "terminal_growth"), "wacc", waccs), "terminal_growth", growths)
    grid = grid.withColumn("grid_wacc", F.col("wacc")).withColumn("grid_growth", F.col("terminal_growth"))
    return dcf_valuation(projection.join(grid.select(*key, "grid_wacc", "grid_growth"), list(key)), [*key, "grid_wacc", "grid_growth"], grid).select(*key, "grid_wacc", "grid_growth", "enterprise_value")


def one_way_sensitivity(projection: DataFrame, key: Sequence[str], terms: DataFrame, variable: str, span: float, steps: int) -> DataFrame:
    """FN06. Enterprise value for ``steps`` values of one variable, ``span`` below to ``span`` above its base."""
    t = terms.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("step", F.col("_k")).drop("_k")
    t = t.withColumn("pct_change", (-span + 2 * span * F.col("step") / (steps - 1)) * 100).withColumn(variable, F.col(variable) * (1 + F.col("pct_change") / 100))
    v = dcf_valuation(projection.join(t.select(*key, "step"), list(key)), [*key, "step"], t)
    return v.join(t.select(*key, "step", "pct_change", F.col(variable).alias("value")), [*key, "step"]).select(*key, "step", "pct_change", "value", F.col("enterprise_value").alias("output"))


def tornado(projection: DataFrame, key: Sequence[str], terms: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """FN07. Output at the low and the high factor of each variable, with the impact against the base; ranked per company."""
    cases = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(s).alias("side"), F.lit(float(x)).alias("factor")) for v, r in ranges.items() for s, x in zip(("low", "high"), r)],
                    F.struct(F.lit("(base)").alias("variable"), F.lit("base").alias("side"), F.lit(1.0).alias("factor")))
    t = terms.withColumn("_c", F.explode(cases)).withColumn("variable", F.col("_c.variable")).withColumn("side", F.col("_c.side"))
    for v in ranges:
        t = t.withColumn(v, F.when(F.col("variable") == v, F.col(v) * F.col("_c.factor")).otherwise(F.col(v)))
    t = t.drop("_c")
    v = dcf_valuation(projection.join(t.select(*key, "variable", "side"), list(key)), [*key, "variable", "side"], t)
    base = v.filter("side = 'base'").select(*key, F.col("enterprise_value").alias("base_output"))
    g = v.filter("side <> 'base'").groupBy(*key, "variable").agg(F.max(F.when(F.col("side") == "low", F.col("enterprise_value"))).alias("low_output"),
                                                              F.max(F.when(F.col("side") == "high", F.col("enterprise_value"))).alias("high_output"))
    g = g.join(base, list(key)).withColumn("impact", F.abs(F.col("high_output") - F.col("low_output"))).withColumn("impact_pct", _div(F.col("impact"), F.col("base_output")) * 100)
    return g.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("impact"), "variable")))


def scenario_expectation(outputs: DataFrame, key: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """FN08. Weighted output per scenario and the expected value; ``outputs`` has (key, scenario, output)."""
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    o = outputs.withColumn("probability", F.coalesce(F.try_element_at(m, F.col("scenario")), F.lit(1.0 / max(1, len(weights))))).withColumn("weighted_output", F.col("output") * F.col("probability"))
    e = o.groupBy(*key).agg(F.sum("weighted_output").alias("output")).select(*key, F.lit("Expected Value").alias("scenario"), "output", F.lit(1.0).alias("probability"), F.col("output").alias("weighted_output"))
    return o.select(*key, "scenario", "output", "probability", "weighted_output").unionByName(e)


def beta(returns: DataFrame, keys: Sequence[str], stock: str, market: str, sample_variance: bool = False) -> DataFrame:
    """FN09. Sample covariance over population variance, as published; ``sample_variance`` gives the consistent form."""
    var = F.var_samp(market) if sample_variance else F.var_pop(market)
    return returns.groupBy(*keys).agg(F.covar_samp(stock, market).alias("_c"), var.alias("_v")).select(*keys, F.when(F.col("_v") == 0, 1.0).otherwise(F.col("_c") / F.when(F.col("_v") != 0, F.col("_v"))).alias("beta"))


def cagr(series: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """FN09. Compound growth per period; 0 with fewer than two periods or a value that is not positive at an end."""
    g = series.groupBy(*keys).agg(F.min_by(value, period).alias("_a"), F.max_by(value, period).alias("_b"), F.count("*").alias("_n"))
    ok = (F.col("_n") >= 2) & (F.col("_a") > 0) & (F.col("_b") > 0)
    return g.select(*keys, F.when(ok, F.pow(F.col("_b") / F.when(ok, F.col("_a")), 1 / F.when(ok, F.col("_n") - 1)) - 1).otherwise(0.0).alias("cagr"))


def mrr_normalised(subs: DataFrame, month: Column) -> DataFrame:
    """FN10. Active amounts as monthly amounts, per month."""
    a = F.when(F.col("interval") == "monthly", F.col("amount")).when(F.col("interval") == "yearly", F.col("amount") / 12).when(F.col("interval") == "quarterly", F.col("amount") / 3)
    return subs.filter(F.col("status") == "active").groupBy(month.alias("month")).agg(F.sum(a).alias("mrr"))


def cohort_retention(activity: DataFrame, user: str, ts: str, unit: str = "month") -> DataFrame:
    """FN11. Active users of each cohort per period since their first activity, over the size of the cohort.

    Activity is reduced to one row per user and period before the join.
    """
    a = activity.select(user, F.to_date(F.date_trunc(unit, F.col(ts))).alias("period")).distinct()
    first = a.groupBy(user).agg(F.min("period").alias("cohort"))
    size = first.groupBy("cohort").agg(F.count("*").alias("cohort_size"))
    since = F.months_between("period", "cohort").cast("int") if unit == "month" else F.floor(F.datediff("period", "cohort") / {"week": 7, "day": 1}[unit]).cast("int")
    g = a.join(first, user).groupBy("cohort", since.alias("since")).agg(F.count("*").alias("active_users"))
    return g.join(size, "cohort").withColumn("retention_pct", F.col("active_users") / F.col("cohort_size") * 100)


def unit_economics(m: DataFrame) -> DataFrame:
    """FN12. Columns from (cohort_size, retention, arpu, cash, revenue, expenses, spend, new_customers, lifetime_months, gross_margin, pre_money, investment)."""
    d = m.withColumn("mrr", F.col("cohort_size") * F.col("retention") * F.col("arpu"))
    d = d.withColumn("arr", F.col("mrr") * 12).withColumn("monthly_burn", F.col("expenses") - F.col("revenue"))
    d = d.withColumn("runway_months", F.when(F.col("monthly_burn") > 0, F.col("cash") / F.when(F.col("monthly_burn") > 0, F.col("monthly_burn"))))
    d = d.withColumn("cac", _div(F.col("spend"), F.col("new_customers"))).withColumn("ltv", F.col("arpu") * F.col("gross_margin") * F.col("lifetime_months"))
    d = d.withColumn("ltv_to_cac", _div(F.col("ltv"), F.col("cac"))).withColumn("payback_months", _div(F.col("cac"), F.col("arpu") * F.col("gross_margin")))
    return d.withColumn("post_money", F.col("pre_money") + F.col("investment")).withColumn("dilution_pct", _div(F.col("investment"), F.col("post_money")) * 100)


def market_sizing(segments: DataFrame, keys: Sequence[str], size: str, price: str, serviceable: Column, capture: float) -> DataFrame:
    """FN13. Bottom-up market: total, the share of segments that can be served, and the realistic part of it."""
    g = segments.groupBy(*keys).agg(F.sum(F.col(size) * F.col(price)).alias("tam"), (F.count_if(serviceable) / F.count("*")).alias("_s"))
    return g.withColumn("sam", F.col("tam") * F.col("_s")).withColumn("som", F.col("sam") * capture).drop("_s")


def value_based_sizing(segments: DataFrame, keys: Sequence[str], customers: str, cost: str, solved: float, willingness: float, criteria: float, adoption: float) -> DataFrame:
    """FN13. Value-based market from the cost of the problem."""
    g = segments.groupBy(*keys).agg(F.sum(F.col(customers) * F.col(cost) * solved * willingness).alias("tam"))
    return g.withColumn("sam", F.col("tam") * criteria).withColumn("som", F.col("sam") * adoption)


def sli_slo(events: DataFrame, keys: Sequence[str], since: Column, good: Column, fast: Column, slo: float = 0.999, latency_slo: float = 0.99) -> DataFrame:
    """FN14. Availability and latency ratios of the window, compliance and the error budget left in percent."""
    g = events.filter(F.col("ts") >= since).groupBy(*keys).agg(F.avg(good.cast("int")).alias("availability"), F.avg(fast.cast("int")).alias("latency"), F.count("*").alias("requests"))
    return g.withColumn("available", F.col("availability") >= slo).withColumn("fast_enough", F.col("latency") >= latency_slo).withColumn("budget_left_pct", (F.col("availability") - slo) / (1 - slo) * 100)


def burn_rate(events: DataFrame, error: Column, slo: float = 0.999, step: str = "5 minutes", fast: float = 14.4, slow: float = 6.0) -> DataFrame:
    """FN15. Burn rates of the trailing 5m, 30m, 1h and 6h at every step, with the two-window alerts.

    Events are counted once per step; the longer windows are ranges over those counts, cut by day so that a long
    history is not one task: each day also gets the last six hours of the day before.
    """
    b = events.groupBy(F.window(F.col("ts"), step).alias("w")).agg(F.count("*").alias("n"), F.count_if(error).alias("bad"))
    b = b.select(F.col("w.end").cast("timestamp").cast("long").alias("t"), "n", "bad")
    day, spill = F.floor((F.col("t") - 1) / 86400), F.floor((F.col("t") - 1 + 21600) / 86400)
    copies = b.withColumn("_day", F.explode(F.array_distinct(F.array(day, spill)))).withColumn("_own", F.col("_day") == day)
    out = copies
    for name, sec in (("5m", 300), ("30m", 1800), ("1h", 3600), ("6h", 21600)):
        w = Window.partitionBy("_day").orderBy("t").rangeBetween(-(sec - 1), 0)
        out = out.withColumn(f"burn_{name}", F.sum("bad").over(w) / F.sum("n").over(w) / (1 - slo))
    out = out.filter("_own").withColumn("fast_alert", (F.col("burn_1h") > fast) & (F.col("burn_5m") > fast)).withColumn("slow_alert", (F.col("burn_6h") > slow) & (F.col("burn_30m") > slow))
    return out.select(F.timestamp_seconds("t").alias("window_end"), "n", "bad", "burn_5m", "burn_30m", "burn_1h", "burn_6h", "fast_alert", "slow_alert")


def kpi_snapshot(current: DataFrame, measured: DataFrame) -> DataFrame:
    """FN16. The snapshot table (metric, value, snapshot_at) with new values in place of old ones."""
    return upsert_by_id(current, measured, "metric")


def price_history_merge(base: DataFrame, overlay: DataFrame, events: DataFrame, splits: Sequence[tuple[str, float, float]]) -> DataFrame:
    """FN17. Two price feeds as one, the overlay winning, with event texts on trading days and the derived columns.

    Both feeds have (date, open, high, low, close, volume, vwap_true, src, event).
    """
    m = overlay_by_date(base, overlay)
    ev = asof_forward(events, m.select("date")).withColumnRenamed("event", "_ev")
    m = m.join(ev, F.col("date") == F.col("day"), "left")
    own, new = F.coalesce("event", F.lit("")), F.coalesce("_ev", F.lit(""))
    both = F.when(new == "", own).when(own == "", new).when(F.contains(own, new), own).otherwise(F.concat(own, F.lit(" | "), new))
    return daily_change(m.withColumn("event", both).drop("day", "_ev"), splits)


def proration(changes: DataFrame) -> DataFrame:
    """FN18. Credit, charge and net of a plan change, and the charge of added seats, from (old_amount, new_amount, seats_before, seats_after, seat_price, period_start, period_end, change_date)."""
    total = F.datediff("period_end", "period_start")
    left = F.datediff("period_end", "change_date")
    part = lambda a: _div(a * left, total)
    d = changes.withColumn("days_used", F.datediff("change_date", "period_start")).withColumn("days_remaining", left)
    d = d.withColumn("old_plan_credit", -part(F.col("old_amount"))).withColumn("new_plan_charge", part(F.col("new_amount")))
    d = d.withColumn("net_proration", F.col("new_plan_charge") + F.col("old_plan_credit"))
    added = F.col("seats_after") - F.col("seats_before")
    return d.withColumn("additional_seats", added).withColumn("seat_charge", F.greatest(F.lit(0.0), part(added * F.col("seat_price"))))


def usage_charges(usage: DataFrame, keys: Sequence[str], quantity: str, plan: Column, unit_price: float, tiers: Sequence[tuple[float, float, float]]) -> DataFrame:
    """FN19. Usage per key priced per unit, or by tiers (from, up_to, price) of which each takes its slice in order."""
    g = usage.groupBy(*keys).agg(F.sum(quantity).alias("usage"), F.first(plan).alias("plan"))
    tiered, used = F.lit(0.0), 0.0
    for lo, hi, price in sorted(tiers, key=lambda x: x[1]):
        width = hi - lo
        tiered = tiered + F.greatest(F.lit(0.0), F.least(F.col("usage") - used, F.lit(float(width)))) * price
        used += width
    return g.withColumn("charge", F.when(F.col("plan") == "tiered", tiered).when(F.col("plan") == "per_unit", F.col("usage") * unit_price))


def invoice_totals(lines: DataFrame, invoice: str, amount: Column, quantity: Column, jurisdiction: str) -> DataFrame:
    """FN20. Subtotal, tax of the jurisdiction (0 when it is unknown) and total per invoice."""
    rate = F.create_map(*[F.lit(x) for kv in fixed.TAX_RATES.items() for x in kv])
    g = lines.groupBy(invoice).agg(F.sum(amount * quantity).alias("subtotal"), F.count("*").alias("lines"), F.max(jurisdiction).alias("jurisdiction"))
    g = g.withColumn("tax_rate", F.coalesce(F.try_element_at(rate, F.col("jurisdiction")), F.lit(0.0)))
    return g.withColumn("tax", F.col("subtotal") * F.col("tax_rate")).withColumn("total", F.col("subtotal") + F.col("tax"))


def next_billing(subs: DataFrame, start: str, interval: str) -> DataFrame:
    """FN21. Next billing date by fixed days."""
    days = F.when(F.col(interval) == "month", 30).when(F.col(interval) == "year", 365).when(F.col(interval) == "week", 7)
    return subs.withColumn("next_billing", F.date_add(F.to_date(start), days))


def dunning_schedule(failed: DataFrame, day: str) -> DataFrame:
    """FN21. One row per retry of a failed invoice, 3, 7 and 14 days on."""
    steps = F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(d).alias("days"), F.lit(t).alias("template")) for i, (d, t) in enumerate(
        ((3, "payment_failed_first"), (7, "payment_failed_reminder"), (14, "payment_failed_final")), 1)])
    return failed.withColumn("_s", F.explode(steps)).withColumn("attempt", F.col("_s.attempt")).withColumn("template", F.col("_s.template")).withColumn(
        "retry_on", F.date_add(F.to_date(day), F.col("_s.days"))).drop("_s")
