"""Queries over finance, KPI, service levels and billing."""
from pyspark.sql import functions as F

from tallywright.operators import finance as fn
from tallywright.plans.q_aggregates import SPLIT_SQL, SPLITS
from tallywright.plans.registry import query
from tallywright.plans.tables import BARS, Tables, ts


# Statements: one per supplier and year, with proxies for the lines the tables do not have.
ST = """st AS (SELECT l_suppkey AS company, year(l_shipdate) AS period, sum(l_extendedprice) AS revenue, sum(l_extendedprice * l_discount) * 8 AS cost_of_goods_sold, sum(l_extendedprice * l_tax) AS net_income,
    sum(l_extendedprice * l_tax) * 1.5 AS operating_income, count(*) AS n, max(s_acctbal) AS bal, max(s_nationkey) AS nat FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
sx AS (SELECT company, period, revenue, cost_of_goods_sold, net_income, operating_income, operating_income AS ebit, operating_income * 1.2 AS ebitda, bal * 10 AS shareholders_equity, abs(bal) * 20 AS total_assets,
    abs(bal) * 3 AS current_assets, abs(bal) * 2 AS current_liabilities, abs(bal) * 1.0 AS inventory, abs(bal) * 0.5 AS cash_and_equivalents, n * 100.0 AS total_debt, n * 7.0 AS interest_expense,
    n * 3.0 AS current_portion_long_term_debt, revenue * 0.1 AS accounts_receivable, 20.0 AS share_price, n * 10.0 AS shares_outstanding, CASE WHEN n % 2 = 0 THEN 0.05 ELSE 0 END AS earnings_growth_rate, nat FROM st)"""


def statements(t: Tables):
    x = F.col("l_extendedprice")
    st = t.lineitem.groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("period")).agg(
        F.sum(x).alias("revenue"), (F.sum(x * F.col("l_discount")) * 8).alias("cost_of_goods_sold"), F.sum(x * F.col("l_tax")).alias("net_income"),
        (F.sum(x * F.col("l_tax")) * 1.5).alias("operating_income"), F.count("*").alias("n"))
    s = t.supplier.select(F.col("s_suppkey").alias("company"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"))
    j = st.join(s, "company")
    b, n, a = F.col("bal"), F.col("n"), F.abs("bal")
    cols = {"ebit": F.col("operating_income"), "ebitda": F.col("operating_income") * 1.2, "shareholders_equity": b * 10, "total_assets": a * 20, "current_assets": a * 3, "current_liabilities": a * 2,
            "inventory": a, "cash_and_equivalents": a * 0.5, "total_debt": n * 100.0, "interest_expense": n * 7.0, "current_portion_long_term_debt": n * 3.0, "accounts_receivable": F.col("revenue") * 0.1,
            "share_price": F.lit(20.0), "shares_outstanding": n * 10.0, "earnings_growth_rate": F.when(n % 2 == 0, 0.05).otherwise(0.0)}
    return j.select("company", "period", "nat", "revenue", "cost_of_goods_sold", "net_income", "operating_income", *[c.alias(k) for k, c in cols.items()])


_RATIOS = ["roe", "roa", "gross_margin", "operating_margin", "net_margin", "current_ratio", "quick_ratio", "cash_ratio", "debt_to_equity", "interest_coverage", "debt_service_coverage", "asset_turnover", "inventory_turnover",
           "receivables_turnover", "days_sales_outstanding", "pe_ratio", "eps", "pb_ratio", "book_value_per_share", "ps_ratio", "ev_to_ebitda", "peg_ratio"]


def _d(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b}), 0), 0)"


RT = f"""{ST}, r0 AS (SELECT *, {_d('net_income', 'shares_outstanding')} AS eps, {_d('shareholders_equity', 'shares_outstanding')} AS book_value_per_share, {_d('revenue', 'accounts_receivable')} AS receivables_turnover FROM sx),
r1 AS (SELECT *, {_d('share_price', 'eps')} AS pe_ratio FROM r0),
rt AS (SELECT company, period, nat, {_d('net_income', 'shareholders_equity')} AS roe, {_d('net_income', 'total_assets')} AS roa, {_d('revenue - cost_of_goods_sold', 'revenue')} AS gross_margin, {_d('operating_income', 'revenue')} AS operating_margin,
  {_d('net_income', 'revenue')} AS net_margin, {_d('current_assets', 'current_liabilities')} AS current_ratio, {_d('current_assets - inventory', 'current_liabilities')} AS quick_ratio, {_d('cash_and_equivalents', 'current_liabilities')} AS cash_ratio,
  {_d('total_debt', 'shareholders_equity')} AS debt_to_equity, {_d('ebit', 'interest_expense')} AS interest_coverage, {_d('operating_income', 'interest_expense + current_portion_long_term_debt')} AS debt_service_coverage,
  {_d('revenue', 'total_assets')} AS asset_turnover, {_d('cost_of_goods_sold', 'inventory')} AS inventory_turnover, receivables_turnover, {_d('365', 'receivables_turnover')} AS days_sales_outstanding, pe_ratio, eps,
  {_d('share_price', 'book_value_per_share')} AS pb_ratio, book_value_per_share, {_d('share_price * shares_outstanding', 'revenue')} AS ps_ratio, {_d('share_price * shares_outstanding + total_debt - cash_and_equivalents', 'ebitda')} AS ev_to_ebitda,
  CASE WHEN earnings_growth_rate > 0 THEN {_d('pe_ratio', 'earnings_growth_rate * 100')} END AS peg_ratio FROM r1)"""


@query("fn01_financial_ratios", f"WITH {RT} SELECT company, CAST(period AS INTEGER) AS period, {', '.join(f'round({r}, 4) AS {r}' for r in _RATIOS)} FROM rt")
def _(t):
    r = fn.financial_ratios(statements(t), ["company", "period"])
    return r.select("company", "period", *[F.round(c, 4).alias(c) for c in _RATIOS])


@query("fn02_ratio_rating", f"""WITH {RT}, l AS (SELECT company, period, CASE WHEN nat % 2 = 0 THEN 'retail' ELSE 'other' END AS ind, unnest(['current_ratio', 'debt_to_equity', 'roe', 'gross_margin', 'pe_ratio']) AS ratio, unnest([current_ratio, debt_to_equity, roe, gross_margin, pe_ratio]) AS v FROM rt),
b AS (SELECT * FROM (VALUES ('retail', 'current_ratio', 2.0, 1.5, 1.0), ('retail', 'debt_to_equity', 0.5, 0.8, 1.5), ('retail', 'roe', 0.2, 0.15, 0.1), ('retail', 'gross_margin', 0.4, 0.3, 0.2), ('retail', 'pe_ratio', 12, 18, 25),
  ('other', 'current_ratio', 2.0, 1.5, 1.0), ('other', 'debt_to_equity', 0.5, 1.0, 1.5), ('other', 'roe', 0.2, 0.15, 0.1), ('other', 'gross_margin', 0.4, 0.3, 0.2), ('other', 'pe_ratio', 15, 22, 30)) v(ind, ratio, a, g, c))
SELECT company, CAST(period AS INTEGER) AS period, ratio, CASE WHEN ratio = 'pe_ratio' THEN CASE WHEN v <= 0 THEN 'N/A' WHEN v < a THEN 'Potentially Undervalued' WHEN v < g THEN 'Fair Value' WHEN v < c THEN 'Growth Premium' ELSE 'Expensive' END
  WHEN ratio = 'debt_to_equity' THEN CASE WHEN v <= a THEN 'Excellent' WHEN v <= g THEN 'Good' WHEN v <= c THEN 'Acceptable' ELSE 'Poor' END
  ELSE CASE WHEN v >= a THEN 'Excellent' WHEN v >= g THEN 'Good' WHEN v >= c THEN 'Acceptable' ELSE 'Poor' END END AS rating FROM l JOIN b USING (ind, ratio)""")
def _(t):
    s = statements(t)
    r = fn.financial_ratios(s, ["company", "period", "nat"]).withColumn("industry", F.when(F.col("nat") % 2 == 0, "Retail").otherwise("other"))
    return fn.ratio_rating(r, ["company", "period"], "industry").select("company", "period", "ratio", "rating")


@query("fn03_ratio_trend", f"""WITH {RT}, l AS (SELECT company, period, unnest(['debt_to_equity', 'net_margin']) AS ratio, unnest([debt_to_equity, net_margin]) AS v FROM rt),
g AS (SELECT company, ratio, arg_min(v, period) AS f, arg_max(v, period) AS l, count(*) AS periods FROM l GROUP BY 1, 2), c AS (SELECT *, l - f AS change, coalesce((l - f) / nullif(abs(f), 0), 0) * 100 AS pct FROM g)
SELECT company, ratio, periods, round(pct, 4) AS pct_change, CASE WHEN periods < 2 THEN 'Insufficient data' WHEN abs(pct) < 5 THEN 'Stable' WHEN (pct > 0) = (ratio <> 'debt_to_equity') THEN 'Improving' ELSE 'Deteriorating' END AS trend FROM c""")
def _(t):
    r = fn.financial_ratios(statements(t), ["company", "period"])
    l = r.select("company", "period", F.explode(F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(n).alias("v")) for n in ("debt_to_equity", "net_margin")])).alias("x")).select("company", "period", "x.*")
    return fn.ratio_trend(l, ["company"], "period", "ratio", "v").select("company", "ratio", "periods", F.round("pct_change", 4).alias("pct_change"), "trend")


def _arr(*v: float):
    return F.array(*[F.lit(float(x)) for x in v])


def projection(t: Tables):
    base = t.lineitem.groupBy(F.col("l_suppkey").alias("company")).agg(F.sum("l_extendedprice").alias("base"))
    return fn.dcf_projection(base, ["company"], "base", _arr(.15, .12, .10, .08, .06), _arr(.20, .21, .22, .22, .23), _arr(.05, .045, .04, .035, .03), _arr(.10, .1, .09, .09, .08), F.lit(0.25))


PJ = """bs AS (SELECT l_suppkey AS company, sum(l_extendedprice) AS base FROM lineitem GROUP BY 1),
a AS (SELECT * FROM (VALUES (1, 1.15, 1.0, .20, .05, .10, .10), (2, 1.15 * 1.12, 1.15, .21, .045, .1, .10), (3, 1.15 * 1.12 * 1.10, 1.15 * 1.12, .22, .04, .09, .1), (4, 1.15 * 1.12 * 1.10 * 1.08, 1.15 * 1.12 * 1.10, .22, .035, .09, .09),
  (5, 1.15 * 1.12 * 1.10 * 1.08 * 1.06, 1.15 * 1.12 * 1.10 * 1.08, .23, .03, .08, .09)) v(year, f, pf, m, x, n, pn)),
pj AS (SELECT company, year, base * f AS revenue, base * f * m AS ebitda, base * f * (m - x) AS ebit, base * f * (m - x) * 0.25 AS tax, base * f * (m - x) * 0.75 AS nopat, base * f * x AS capex, base * f * n - base * pf * pn AS nwc_change,
  base * f * (m - x) * 0.75 - (base * f * n - base * pf * pn) AS fcf FROM bs, a)"""


@query("fn04_dcf_projection", f"WITH {PJ} SELECT company, year, {', '.join(f'round(CAST({c} AS DOUBLE), 1) AS {c}' for c in ('revenue', 'ebitda', 'ebit', 'tax', 'nopat', 'capex', 'nwc_change', 'fcf'))} FROM pj")
def _(t):
    return projection(t).select("company", "year", *[F.round(c, 1).alias(c) for c in ("revenue", "ebitda", "ebit", "tax", "nopat", "capex", "nwc_change", "fcf")])


def terms(t: Tables):
    s = t.supplier
    w = fn.wacc(F.lit(0.04), 0.8 + F.col("s_nationkey") / 50, F.lit(0.06), F.lit(0.05), F.lit(0.5), F.lit(0.25))
    return s.select(F.col("s_suppkey").alias("company"), w.alias("wacc"), F.lit(0.025).alias("terminal_growth"), F.lit(9.0).alias("exit_multiple"), (F.col("s_acctbal") * 10).alias("net_debt"), F.lit(100.0).alias("shares"))


TM = "tm AS (SELECT s_suppkey AS company, (1 / 1.5) * (0.04 + (0.8 + s_nationkey / 50) * 0.06) + (0.5 / 1.5) * 0.05 * 0.75 AS wacc, 0.025 AS tg, 9.0 AS mult, s_acctbal * 10 AS net_debt FROM supplier)"
EV = "ev AS (SELECT company, {k} sum(fcf / pow(1 + wacc, year)) AS pv, arg_max(fcf, year) * (1 + max(tg)) / (max(wacc) - max(tg)) AS tv, max(wacc) AS wacc, arg_max(ebitda, year) * max(mult) AS tvm, max(net_debt) AS nd FROM pj JOIN {t} USING (company) GROUP BY ALL)"


@query("fn05_dcf_valuation", f"""WITH {PJ}, {TM}, {EV.format(k='', t='tm')} SELECT company, round(pv, 1) AS pv_fcf, round(tv, 1) AS terminal_value, round(pv + tv / pow(1 + wacc, 5), 1) AS enterprise_value,
  round(pv + tv / pow(1 + wacc, 5) - nd, 1) AS equity_value, round((pv + tv / pow(1 + wacc, 5) - nd) / 100, 2) AS value_per_share, round(tv / pow(1 + wacc, 5) / (pv + tv / pow(1 + wacc, 5)) * 100, 4) AS terminal_percent FROM ev""")
def _(t):
    v = fn.dcf_valuation(projection(t), ["company"], terms(t))
    return v.select("company", *[F.round(c, 1).alias(c) for c in ("pv_fcf", "terminal_value", "enterprise_value", "equity_value")], F.round("value_per_share", 2).alias("value_per_share"), F.round("terminal_percent", 4).alias("terminal_percent"))


@query("fn05_dcf_valuation_multiple", f"WITH {PJ}, {TM}, {EV.format(k='', t='tm')} SELECT company, round(pv + tvm / pow(1 + wacc, 5), 1) AS enterprise_value FROM ev")
def _(t):
    return fn.dcf_valuation(projection(t), ["company"], terms(t), "multiple").select("company", F.round("enterprise_value", 1).alias("enterprise_value"))


@query("fn06_sensitivity_grid", f"""WITH {PJ}, gr AS (SELECT company, w AS wacc, g AS tg, 9.0 AS mult, s_acctbal * 10 AS net_debt, w AS grid_wacc, g AS grid_growth FROM (SELECT s_suppkey AS company, s_acctbal FROM supplier), (VALUES (0.08::DOUBLE), (0.10::DOUBLE), (0.12::DOUBLE)) a(w), (VALUES (0.02::DOUBLE), (0.03::DOUBLE)) b(g)),
{EV.format(k='grid_wacc, grid_growth,', t='gr')} SELECT company, grid_wacc, grid_growth, round(pv + tv / pow(1 + wacc, 5), 1) AS enterprise_value FROM ev""")
def _(t):
    return fn.sensitivity_grid(projection(t), ["company"], terms(t), [0.08, 0.10, 0.12], [0.02, 0.03]).withColumn("enterprise_value", F.round("enterprise_value", 1))


@query("fn06_one_way_sensitivity", f"""WITH {PJ}, {TM}, s1 AS (SELECT tm.company, i AS step, wacc, tg * (1 + (-0.2 + 0.1 * i)) AS tg, mult, net_debt FROM tm, range(5) r(i)), {EV.format(k='step,', t='s1')}
SELECT company, CAST(step AS INTEGER) AS step, round(-20.0 + 10.0 * step, 6)::DOUBLE AS pct_change, round(pv + tv / pow(1 + wacc, 5), 1) AS output FROM ev""")
def _(t):
    s = fn.one_way_sensitivity(projection(t), ["company"], terms(t), "terminal_growth", 0.2, 5)
    return s.select("company", "step", F.round("pct_change", 6).alias("pct_change"), F.round("output", 1).alias("output"))


_TOR = f"""WITH {PJ}, {TM}, cs AS (SELECT * FROM (VALUES ('terminal_growth', 'low', 1.0, 0.8), ('terminal_growth', 'high', 1.0, 1.2), ('wacc', 'low', 0.9, 1.0), ('wacc', 'high', 1.1, 1.0), ('(base)', 'base', 1.0, 1.0)) v(variable, side, fw, fg)),
tc AS (SELECT company, variable, side, wacc * fw AS wacc, tg * fg AS tg, mult, net_debt FROM tm, cs), {EV.format(k='variable, side,', t='tc')}, o AS (SELECT company, variable, side, pv + tv / pow(1 + wacc, 5) AS v FROM ev),
g AS (SELECT company, variable, max(CASE WHEN side = 'low' THEN v END) AS lo, max(CASE WHEN side = 'high' THEN v END) AS hi FROM o WHERE side <> 'base' GROUP BY ALL)"""


@query("fn07_tornado", _TOR + """ SELECT g.company, g.variable, round(lo, 1) AS low_output, round(hi, 1) AS high_output, round(abs(hi - lo), 1) AS impact, CAST(row_number() OVER (PARTITION BY g.company ORDER BY abs(hi - lo) DESC, g.variable) AS INTEGER) AS position FROM g""")
def _(t):
    d = fn.tornado(projection(t), ["company"], terms(t), {"wacc": (0.9, 1.1), "terminal_growth": (0.8, 1.2)})
    return d.select("company", "variable", *[F.round(c, 1).alias(c) for c in ("low_output", "high_output", "impact")], "position")


@query("fn08_scenario_expectation", """WITH o AS (SELECT l_suppkey AS company, CASE l_returnflag WHEN 'A' THEN 'bear' WHEN 'N' THEN 'base' ELSE 'bull' END AS scenario, sum(l_extendedprice) AS output FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, CASE scenario WHEN 'bear' THEN 0.25 WHEN 'base' THEN 0.5 ELSE 0.25 END::DOUBLE AS probability FROM o)
SELECT company, scenario, round(output, 1) AS output, probability, round(output * probability, 1) AS weighted_output FROM w UNION ALL SELECT company, 'Expected Value', round(sum(output * probability), 1), 1.0, round(sum(output * probability), 1) FROM w GROUP BY 1""")
def _(t):
    s = F.when(F.col("l_returnflag") == "A", "bear").when(F.col("l_returnflag") == "N", "base").otherwise("bull")
    o = t.lineitem.groupBy(F.col("l_suppkey").alias("company"), s.alias("scenario")).agg(F.sum("l_extendedprice").alias("output"))
    e = fn.scenario_expectation(o, ["company"], {"bear": 0.25, "base": 0.5, "bull": 0.25})
    return e.withColumn("output", F.round("output", 1)).withColumn("weighted_output", F.round("weighted_output", 1))


_MONTHLY = "m AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), k AS (SELECT month, sum(v) AS mv FROM m GROUP BY 1)"


@query("fn09_beta", f"WITH {_MONTHLY} SELECT p, round(covar_samp(v, mv) / var_pop(mv), 6) AS beta FROM m JOIN k USING (month) GROUP BY p")
def _(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    k = m.groupBy("month").agg(F.sum("v").alias("mv"))
    return fn.beta(m.join(k, "month"), ["p"], "v", "mv").withColumn("beta", F.round("beta", 6))


@query("fn09_cagr", "WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, sum(o_totalprice) - 290000000 AS v FROM orders GROUP BY 1, 2), g AS (SELECT p, arg_min(v, y) AS a, arg_max(v, y) AS b, count(*) AS n FROM y GROUP BY 1) SELECT p, round(CASE WHEN n >= 2 AND a > 0 AND b > 0 THEN pow(b / a, 1 / (n - 1)) - 1 ELSE 0 END, 6) AS cagr FROM g")
def _(t):
    y = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") - 290000000).alias("v"))
    return fn.cagr(y, ["p"], "y", "v").withColumn("cagr", F.round("cagr", 6))


@query("fn10_mrr_normalised", """SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 12 ELSE o_totalprice / 3 END), 2) AS mrr FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def _(t):
    k = F.col("o_orderkey") % 3
    s = t.orders.select(F.when(k == 0, "monthly").when(k == 1, "yearly").otherwise("quarterly").alias("interval"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("done").alias("status"), "o_orderdate")
    return fn.mrr_normalised(s, F.date_format("o_orderdate", "yyyy-MM")).withColumn("mrr", F.round("mrr", 2))


@query("fn11_cohort_retention", """WITH a AS (SELECT DISTINCT o_custkey AS u, CAST(date_trunc('month', o_orderdate) AS DATE) AS p FROM orders), f AS (SELECT u, min(p) AS c FROM a GROUP BY 1), z AS (SELECT c, count(*) AS n FROM f GROUP BY 1)
SELECT CAST(c AS VARCHAR) AS cohort, CAST(date_diff('month', c, p) AS INTEGER) AS since, count(*) AS active_users, max(n) AS cohort_size, round(count(*) / max(n) * 100, 4) AS retention_pct FROM a JOIN f USING (u) JOIN z USING (c) GROUP BY c, p""")
def _(t):
    r = fn.cohort_retention(t.orders, "o_custkey", "o_orderdate")
    return r.select(F.col("cohort").cast("string").alias("cohort"), "since", "active_users", "cohort_size", F.round("retention_pct", 4).alias("retention_pct"))


@query("fn12_unit_economics", """WITH m AS (SELECT c_mktsegment AS segment, count(*) * 1.0 AS n, avg(c_acctbal) AS arpu FROM customer GROUP BY 1), d AS (SELECT *, n * 0.9 * arpu AS mrr, n * arpu * 0.8 AS revenue, n * arpu AS expenses, n * 300 / (n * 0.1) AS cac FROM m)
SELECT segment, round(mrr, 2) AS mrr, round(mrr * 12, 2) AS arr, round(5e7 / (expenses - revenue), 4) AS runway_months, round(cac, 4) AS cac, round(arpu * 0.7 * 24 / cac, 4) AS ltv_to_cac, round(cac / (arpu * 0.7), 6) AS payback_months, round(2 / 10 * 100, 4) AS dilution_pct FROM d""")
def _(t):
    m = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").cast("double").alias("cohort_size"), F.avg("c_acctbal").alias("arpu"))
    n, a = F.col("cohort_size"), F.col("arpu")
    m = m.select("segment", "cohort_size", "arpu", F.lit(0.9).alias("retention"), F.lit(5e7).alias("cash"), (n * a * 0.8).alias("revenue"), (n * a).alias("expenses"), (n * 300).alias("spend"), (n * 0.1).alias("new_customers"),
                 F.lit(24.0).alias("lifetime_months"), F.lit(0.7).alias("gross_margin"), F.lit(8.0).alias("pre_money"), F.lit(2.0).alias("investment"))
    u = fn.unit_economics(m)
    return u.select("segment", F.round("mrr", 2).alias("mrr"), F.round("arr", 2).alias("arr"), *[F.round(c, 4).alias(c) for c in ("runway_months", "cac", "ltv_to_cac")], F.round("payback_months", 6).alias("payback_months"), F.round("dilution_pct", 4).alias("dilution_pct"))


@query("fn13_market_sizing", """WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS p FROM customer GROUP BY 1, 2), g AS (SELECT c_nationkey, sum(n * p) AS tam, count(*) FILTER (c_mktsegment <> 'MACHINERY') / count(*) AS f FROM s GROUP BY 1)
SELECT c_nationkey, round(tam, 2) AS tam, round(tam * f, 2) AS sam, round(tam * f * 0.03, 2) AS som FROM g""")
def _(t):
    s = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("p"))
    return fn.market_sizing(s, ["c_nationkey"], "n", "p", F.col("c_mktsegment") != "MACHINERY", 0.03).select("c_nationkey", *[F.round(c, 2).alias(c) for c in ("tam", "sam", "som")])


@query("fn13_value_based_sizing", "WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS p FROM customer GROUP BY 1, 2) SELECT c_nationkey, round(sum(n * p * 0.6 * 0.2), 2) AS tam, round(sum(n * p * 0.6 * 0.2) * 0.4, 2) AS sam, round(sum(n * p * 0.6 * 0.2) * 0.4 * 0.1, 2) AS som FROM s GROUP BY 1")
def _(t):
    s = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("p"))
    return fn.value_based_sizing(s, ["c_nationkey"], "n", "p", 0.6, 0.2, 0.4, 0.1).select("c_nationkey", *[F.round(c, 2).alias(c) for c in ("tam", "sam", "som")])


@query("fn14_sli_slo", """SELECT user_id % 5 AS service, round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS availability, round(avg(CASE WHEN value < 50 THEN 1 ELSE 0 END), 6) AS latency, count(*) AS requests,
  avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) >= 0.8 AS available, avg(CASE WHEN value < 50 THEN 1 ELSE 0 END) >= 0.99 AS fast_enough, round((avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) - 0.8) / 0.2 * 100, 4) AS budget_left_pct FROM events WHERE ts >= TIMESTAMP '2024-01-04' GROUP BY 1""")
def _(t):
    g = fn.sli_slo(t.events.withColumn("service", F.col("user_id") % 5), ["service"], ts("2024-01-04 00:00:00"), F.col("event_type") != "error", F.col("value") < 50, 0.8)
    return g.withColumn("availability", F.round("availability", 6)).withColumn("latency", F.round("latency", 6)).withColumn("budget_left_pct", F.round("budget_left_pct", 4))


_BURN_W = ", ".join(f"sum(bad) OVER (ORDER BY e RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW) / sum(n) OVER (ORDER BY e RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW) / 0.05 AS b{k}" for k, s in (("5m", 300), ("30m", 1800), ("1h", 3600), ("6h", 21600)))


@query("fn15_burn_rate", f"""WITH w AS (SELECT (epoch_us(ts) // 300000000 + 1) * 300 AS e, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1), b AS (SELECT e, n, bad, {_BURN_W} FROM w)
SELECT strftime(make_timestamp(e * 1000000), '%Y-%m-%d %H:%M') AS window_end, n, bad, round(b5m, 6) AS burn_5m, round(b30m, 6) AS burn_30m, round(b1h, 6) AS burn_1h, round(b6h, 6) AS burn_6h, b1h > 6 AND b5m > 6 AS fast_alert, b6h > 4 AND b30m > 4 AS slow_alert FROM b""")
def _(t):
    b = fn.burn_rate(t.events, F.col("event_type") == "error", 0.95, fast=6.0, slow=4.0)
    return b.select(F.date_format("window_end", "yyyy-MM-dd HH:mm").alias("window_end"), "n", "bad", *[F.round(f"burn_{k}", 6).alias(f"burn_{k}") for k in ("5m", "30m", "1h", "6h")], "fast_alert", "slow_alert")


@query("fn16_kpi_snapshot", "SELECT 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value, 'new' AS snapshot_at FROM orders UNION ALL SELECT 'revenue', round(sum(o_totalprice), 2), 'new' FROM orders UNION ALL SELECT 'customers', CAST(count(*) AS DOUBLE), 'old' FROM customer")
def _(t):
    one = lambda df, name, v, at: df.agg(v.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value", F.lit(at).alias("snapshot_at"))
    old = one(t.customer, "customers", F.count("*"), "old").unionByName(one(t.customer, "orders", F.lit(0), "old"))
    new = one(t.orders, "orders", F.count("*"), "new").unionByName(one(t.orders, "revenue", F.round(F.sum("o_totalprice"), 2), "new"))
    return fn.kpi_snapshot(old, new)


@query("fn17_price_history_merge", f"""WITH {BARS}, m AS (SELECT date, CASE WHEN day(date) <= 10 THEN close * 2 ELSE close END AS close, high, low, volume, CASE WHEN day(date) <= 10 THEN close END AS vt, CASE WHEN day(date) <= 10 THEN 'overlay' ELSE 'base' END AS src FROM bars),
e AS (SELECT date, CASE WHEN volume > 9 THEN 'busy' ELSE '' END AS ev FROM bars), a AS (SELECT m.*, ev, close * {SPLIT_SQL} AS adj FROM m JOIN e USING (date)), p AS (SELECT *, lag(adj) OVER (ORDER BY date) AS prev FROM a)
SELECT CAST(date AS VARCHAR) AS date, round(adj, 6) AS split_adj_close, round((adj - prev) / prev * 100, 4) AS change_pct, round(coalesce(vt, (high + low + close) / 3) * volume, 2) AS traded_value, ev AS event, src FROM p""")
def _(t):
    b = t.daily_bars.withColumn("vwap_true", F.lit(None).cast("double")).withColumn("src", F.lit("base")).withColumn("event", F.lit(""))
    over = t.daily_bars.filter(F.dayofmonth("date") <= 10).select("date", "open", "high", "low", (F.col("close") * 2).alias("close"), "volume", F.col("close").alias("vwap_true"), F.lit("overlay").alias("src"), F.lit("").alias("event"))
    events = t.daily_bars.filter("volume > 9").select("date", F.lit("busy").alias("text"))
    m = fn.price_history_merge(b, over, events, SPLITS)
    return m.select(F.col("date").cast("string").alias("date"), F.round("split_adj_close", 6).alias("split_adj_close"), F.round("change_pct", 4).alias("change_pct"), F.round("traded_value", 2).alias("traded_value"), "event", "src")


@query("fn18_proration", """WITH c AS (SELECT o_orderkey AS id, o_totalprice AS a, o_totalprice * 1.5 AS b, o_custkey % 5 AS s0, o_custkey % 7 AS s1, o_orderkey % 30 AS used FROM orders)
SELECT id, CAST(used AS INTEGER) AS days_used, CAST(30 - used AS INTEGER) AS days_remaining, round(-(a * (30 - used) / 30), 6) AS old_plan_credit, round(b * (30 - used) / 30, 6) AS new_plan_charge, round((b - a) * (30 - used) / 30, 6) AS net_proration, s1 - s0 AS additional_seats, round(greatest(0, (s1 - s0) * 12.5 * (30 - used) / 30), 4)::DOUBLE AS seat_charge FROM c""")
def _(t):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    c = t.orders.select(k.alias("id"), F.col("o_totalprice").alias("old_amount"), (F.col("o_totalprice") * 1.5).alias("new_amount"), (F.col("o_custkey") % 5).alias("seats_before"), (F.col("o_custkey") % 7).alias("seats_after"),
                        F.lit(12.5).alias("seat_price"), d.alias("period_start"), F.date_add(d, 30).alias("period_end"), F.date_add(d, (k % 30).cast("int")).alias("change_date"))
    p = fn.proration(c)
    return p.select("id", "days_used", "days_remaining", F.round("old_plan_credit", 6).alias("old_plan_credit"), F.round("new_plan_charge", 6).alias("new_plan_charge"), F.round("net_proration", 6).alias("net_proration"), "additional_seats", F.round("seat_charge", 4).alias("seat_charge"))


@query("fn19_usage_charges", """WITH u AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(y AS INTEGER) AS y, q AS usage, round(CASE WHEN l_suppkey % 2 = 0 THEN least(q, 1000) * 1.0 + greatest(0, least(q - 1000, 1000)) * 0.8 + greatest(0, least(q - 2000, 8000)) * 0.5 ELSE q * 0.9 END, 4) AS charge FROM u""")
def _(t):
    u = t.lineitem.withColumn("y", F.year("l_shipdate"))
    c = fn.usage_charges(u, ["l_suppkey", "y"], "l_quantity", F.when(F.col("l_suppkey") % 2 == 0, "tiered").otherwise("per_unit"), 0.9, [(0, 1000, 1.0), (1000, 2000, 0.8), (2000, 10000, 0.5)])
    return c.select("l_suppkey", "y", "usage", F.round("charge", 4).alias("charge"))


@query("fn20_invoice_totals", """WITH j AS (SELECT l_orderkey, l_extendedprice * l_quantity AS v, CASE c_nationkey WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'US_CA' ELSE 'XX' END AS jur FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
g AS (SELECT l_orderkey, sum(v) AS s, count(*) AS lines, max(jur) AS jurisdiction, CASE max(jur) WHEN 'GB' THEN 0.2 WHEN 'DE' THEN 0.19 WHEN 'US_CA' THEN 0.0725 ELSE 0 END::DOUBLE AS r FROM j GROUP BY 1)
SELECT l_orderkey, lines, jurisdiction, round(s, 2) AS subtotal, round(s * r, 6) AS tax, round(s + s * r, 6) AS total FROM g""")
def _(t):
    cust = t.customer.select("c_custkey", F.when(F.col("c_nationkey") == 0, "GB").when(F.col("c_nationkey") == 1, "DE").when(F.col("c_nationkey") == 2, "US_CA").otherwise("XX").alias("jur"))
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    i = fn.invoice_totals(j, "l_orderkey", F.col("l_extendedprice"), F.col("l_quantity"), "jur")
    return i.select("l_orderkey", "lines", "jurisdiction", F.round("subtotal", 2).alias("subtotal"), F.round("tax", 6).alias("tax"), F.round("total", 6).alias("total"))


@query("fn21_billing_schedule", "SELECT o_orderkey, strftime(o_orderdate + to_days(CAST(CASE o_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 365 ELSE 7 END AS INTEGER)), '%Y-%m-%d') AS next_billing FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    s = t.orders.withColumn("interval", F.when(k == 0, "month").when(k == 1, "year").otherwise("week"))
    return fn.next_billing(s, "o_orderdate", "interval").select("o_orderkey", F.col("next_billing").cast("string").alias("next_billing"))


@query("fn21_dunning_schedule", "SELECT o_orderkey, a AS attempt, strftime(o_orderdate + to_days(CAST(d AS INTEGER)), '%Y-%m-%d') AS retry_on, tpl AS template FROM orders, (VALUES (1, 3, 'payment_failed_first'), (2, 7, 'payment_failed_reminder'), (3, 14, 'payment_failed_final')) v(a, d, tpl) WHERE o_orderstatus = 'P'")
def _(t):
    d = fn.dunning_schedule(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return d.select("o_orderkey", "attempt", F.col("retry_on").cast("string").alias("retry_on"), "template")
