"""Registered queries over portfolios with calendars of their own, on one VaR base, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import locale as L
from tidemark.operators import allocation as A
from tidemark.operators import book as Y
from tidemark.operators import documents as D
from tidemark.operators import exposure as E
from tidemark.operators import factors as X
from tidemark.operators import panel as N
from tidemark.operators import rates as I
from tidemark.operators import risk as R
from tidemark.operators import structure as U
from tidemark.operators import valuation as V
from tidemark.plans import catalog as C
from tidemark.sources import roles as S
from tidemark.sources import tables as K
from tidemark.sources.store import Store

#: Foreign currencies by kind, as prices of the panel with gaps; the fund whose style is looked through, and the factor that is the currency.
FOREIGN = {"usd": "1-URGENT", "eur": "5-LOW"}
FUND, CURRENCY = "4-NOT SPECIFIED", "1-URGENT"
STYLE = ["1-URGENT", "5-LOW"]


def _extended_sql(name: str) -> str:
    from tidemark.plans import extended

    return extended.oracle_sql()[name]


def _book(spark: SparkSession, d: str) -> Y.Book:
    """The books with gaps; what several figures read is written once."""
    return Y.Book(S.gap_prices(spark, d), S.gap_holdings(spark, d), keep=K.written)


def _lazy(spark: SparkSession, d: str) -> Y.Book:
    return Y.Book(S.gap_prices(spark, d), S.gap_holdings(spark, d))


def _choices(spark: SparkSession, d: str) -> DataFrame:
    """Each book's benchmark by its nation: a rate, a deposit, an overnight rate, one of two currencies, or none."""
    k = F.element_at(F.split("portfolio_id", "/"), -1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("rate", "deposit", "tlref", "usd", "eur"))), (k % 6 + 1).cast("int"))
    books = S.gap_holdings(spark, d).select("portfolio_id").distinct()
    return books.where(k % 6 < 5).select("portfolio_id", kind.alias("kind"), (0.1 + k / 100).alias("annual"))


def _foreign(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("asset") == FOREIGN["usd"], "usd").when(F.col("asset") == FOREIGN["eur"], "eur")
    return S.gap_prices(spark, d).select(kind.alias("kind"), "d", "px").where("kind IS NOT NULL")


def _benchmarked(spark: SparkSession, d: str, asof: bool = False) -> DataFrame:
    return I.with_benchmark(_lazy(spark, d).series, _choices(spark, d), _foreign(spark, d), asof)


def _score(spark: SparkSession, d: str) -> DataFrame:
    """The score's parts from one book: its figures, the Sharpe ratio's lower bound, bets, inflation and falls."""
    book = C._book(spark, d)
    return A.composite_score(_parts(spark, d, book))


def _parts(spark: SparkSession, d: str, book: Y.Book) -> DataFrame:
    f, s = book.figures, book.series
    tail = F.coalesce(F.try_divide("es_fhs", "var_fhs"), F.try_divide("es", "var_historical"))
    parts = f.select("portfolio_id", tail.alias("tail_ratio"), "zone")
    year = R.sharpe(s, 0.0001, (252,)).select("portfolio_id", F.col("sharpe_252").alias("sharpe_year"))
    for more in (
        R.sharpe_confidence(s, 0.0001).select("portfolio_id", F.col("low").alias("sharpe")), year, A.real_returns(s, S.price_index(spark, d)).select("portfolio_id", "prob_loss"),
        R.drawdown(s).select("portfolio_id", "max_drawdown", "calmar"), U.concentration(book.moments, book.covariance, book.weights).select("portfolio_id", "n_assets", "effective_bets"),
        U.expected_drawdown(s).select("portfolio_id", "expected_drawdown"),
    ):
        parts = parts.join(more, "portfolio_id", "left")
    return parts.withColumn("sharpe", F.coalesce("sharpe", "sharpe_year"))


def _exits(book: Y.Book) -> DataFrame:
    """Days to leave the books' positions: fund 4, the rest liquid."""
    return E.liquidity(book.weights.select("portfolio_id", "asset", "value", F.when(F.col("asset") == FUND, "fund").otherwise("liquid").alias("kind"), F.lit(None).cast("double").alias("adv")))


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """The quarters of the orders' years as scenarios, each in the region of its number."""
    days = S.table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    first = days.select(F.explode(F.expr("sequence(trunc(a, 'quarter'), trunc(b, 'quarter'), interval 3 months)")).alias("start"))
    return first.select(F.date_format("start", "yyyy-'q'q").alias("scenario"), "start", F.last_day(F.add_months("start", 2)).alias("end"), F.concat(F.lit("q"), F.quarter("start")).alias("region"))


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    own = _lazy(spark, d)
    out = E.stress(own.prices, own.weights, _quarters(spark, d), ["q1", "q3"])
    return out.withColumn("missing_assets", F.array_join("missing_assets", ",")).withColumns({c: F.round(c, 4) for c in ("impact", "missing")})


def _styles(spark: SparkSession, d: str) -> DataFrame:
    """The styles of the fund's own returns on two factors with gaps."""
    prices = S.gap_prices(spark, d)
    panel = X.style_panel(prices, {STYLE[1]: STYLE[1], STYLE[0]: STYLE[0]}, {}, CURRENCY)
    fund = prices.where(F.col("asset") == FUND)
    own = N.set_returns(fund, fund.select(F.lit("fund").alias("set_id"), "asset").distinct()).select(F.col("asset").alias("key"), "d", "r")
    return X.style(X.moments(own, panel, STYLE, 1), STYLE)


def _looked_through(spark: SparkSession, d: str) -> DataFrame:
    own = _lazy(spark, d)
    fx = E.log_change(S.gap_prices(spark, d).where(F.col("asset") == CURRENCY))
    return E.currency_split(own.series, own.weights, fx, ["1-URGENT", "2-HIGH"], E.looked_through(own.weights, _styles(spark, d), CURRENCY))


def _style_panel(spark: SparkSession, d: str) -> DataFrame:
    interest = I.rate_history(S.price_index(spark, d).select(F.lit("deposit").alias("series"), "d", (20 + F.col("v") / 10000).alias("v")))
    return X.style_panel(S.gap_prices(spark, d), {"index": "5-LOW", "currency": "1-URGENT"}, {"gold": "2-HIGH", "shares": "3-MEDIUM"}, "1-URGENT", interest.select("d", "rate"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The books kept in a store, then those of odd nations doubled, and those of nations divisible by five emptied."""
    held = S.gap_holdings(spark, d)
    nation = F.element_at(F.split("portfolio_id", "/"), -1).cast("int")
    store = Store(spark, f"{K.shared_dir(spark).rstrip('/')}/tidemark-store-{uuid.uuid4().hex}", "portfolio_id", "portfolio_id string, asset string, quantity double")
    store.replace(held)
    store.replace(store.read().where(nation % 2 == 1).withColumn("quantity", F.col("quantity") * 2))
    store.replace(held.limit(0), held.where(nation % 5 == 0).select("portfolio_id"))
    return store.read()


def _problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders as positions of their customers, some with faults, and what is wrong with them."""
    o = S.table(spark, d, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("portfolio_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_clerk") if "o_clerk" in o.columns else F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_orderkey") % 5 == 0, "EUR").otherwise("TRY").alias("currency"), F.when(F.col("o_orderkey") % 3 == 0, "tefas").otherwise("yahoo").alias("source"), (F.col("o_totalprice") - 20000).cast("double").alias("quantity"),
    )
    found = V.problems(rows, V.POSITION_RULES).select("portfolio_id", F.explode_outer("problems").alias("problem"))
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("portfolio_id").alias("portfolios"))


def _written_numbers(spark: SparkSession, d: str) -> DataFrame:
    values = _lazy(spark, d).values
    one, share = F.col("value"), (F.col("value") % 997 - 300) / 4096
    each = [f(x, F.lit(lang)).alias(f"{name}_{lang}") for lang in ("tr", "en") for name, f, x in (("amount", L.money, one), ("share", L.percent, share))]
    return values.select("portfolio_id", *each)


def _analysis(spark: SparkSession, d: str) -> DataFrame:
    own = _book(spark, d)
    benchmarked = I.with_benchmark(own.series, _choices(spark, d), _foreign(spark, d))
    return D.analysis(own, benchmarked, _quarters(spark, d), _exits(own), 0.3)


def _simulation(spark: SparkSession, d: str) -> DataFrame:
    own = _book(spark, d)
    return D.simulation(own.prices, own.weights, "1996-03-01", "1998-09-30", K.written, D.CENTS)


def _by_customer(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders by priority as a portfolio: many portfolios of few sets of assets."""
    held = S.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("portfolio_id"), F.col("o_orderpriority").alias("asset")).agg(F.count("*").cast("double").alias("quantity"))
    own = Y.Book(S.gap_prices(spark, d), held)
    return N.portfolio_quantiles(own.returns, own.weights, 1 - own.confidence).withColumnRenamed("q", "var")


def queries() -> dict:
    rounded = lambda f, digits=6: lambda spark, d: C._rounded(f(spark, d), digits)
    series = lambda f, digits=6: lambda spark, d: C._rounded(f(_lazy(spark, d).series), digits)
    return {
        "q_gap_returns": series(lambda s: s, 8),
        "q_gap_set_returns": rounded(lambda spark, d: N.held_returns(S.gap_prices(spark, d), S.gap_holdings(spark, d)), 8),
        "q_gap_es": series(R.expected_shortfall, 8),
        "q_gap_drawdown": series(R.drawdown),
        "q_gap_sharpe": series(R.sharpe),
        "q_gap_fhs": series(lambda s: R.filtered_historical(R.ewma_path(s)), 8),
        "q_gap_srri": series(R.srri),
        "q_gap_evt": series(R.evt_tail),
        "q_figures": rounded(lambda spark, d: _book(spark, d).figures.withColumns({c: F.round(c, 2) for c in ("value", "var_value")})),
        "q_headline_diversification": rounded(lambda spark, d: Y.diversification(_book(spark, d)), 4),
        "q_headline_attribution": rounded(lambda spark, d: Y.attribution(_book(spark, d)), 4),
        "q_headline_lvar": rounded(lambda spark, d: Y.liquidity_var(b := _book(spark, d), _exits(b)), 4),
        "q_sharpe_choice": rounded(lambda spark, d: I.sharpe_by_choice(_benchmarked(spark, d))),
        "q_sharpe_choice_asof": rounded(lambda spark, d: I.sharpe_by_choice(_benchmarked(spark, d, True))),
        "q_sharpe_choice_ci": rounded(lambda spark, d: I.confidence_by_choice(_benchmarked(spark, d), 0.3)),
        "q_score_full": _score,
        "q_scenarios": rounded(_scenarios),
        "q_look_through": rounded(_looked_through),
        "q_style_panel_gaps": rounded(_style_panel),
        "q_store": rounded(_stored),
        "q_problems": rounded(_problems),
        "q_written_numbers": _written_numbers,
        "q_analysis_json": _analysis,
        "q_simulation_json": _simulation,
        "q_customer_var": rounded(_by_customer, 8),
    }


GAP = """
WITH RECURSIVE gap_days AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS e, count(*) AS v FROM orders GROUP BY 1, 2),
prices AS (SELECT asset, d, CAST(sum(e) OVER w AS DOUBLE) / CAST(sum(v) OVER w AS DOUBLE) AS px FROM gap_days WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
holdings AS (SELECT c_mktsegment || '/' || c_nationkey AS portfolio_id, o_orderpriority AS asset, count(*)::DOUBLE AS quantity FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_nationkey + CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) % 3 <> 0 GROUP BY 1, 2),
last_px AS (SELECT asset, max_by(px, d) AS last FROM prices GROUP BY asset),
weights AS (SELECT portfolio_id, asset, quantity * last AS value, quantity * last / sum(quantity * last) OVER (PARTITION BY portfolio_id) AS w, count(*) OVER (PARTITION BY portfolio_id) AS k FROM holdings JOIN last_px USING (asset)),
held AS (SELECT portfolio_id, asset, d, px, w, k, count(*) OVER (PARTITION BY portfolio_id, d) AS n FROM prices JOIN weights USING (asset)),
moves AS (SELECT * FROM (SELECT portfolio_id, asset, d, w, ln(px / lag(px) OVER (PARTITION BY portfolio_id, asset ORDER BY d)) AS r FROM held WHERE n = k) WHERE r IS NOT NULL),
series AS (SELECT portfolio_id, d, r, row_number() OVER (PARTITION BY portfolio_id ORDER BY d) - 1 AS i FROM (SELECT portfolio_id, d, sum(w * r) AS r FROM moves GROUP BY 1, 2)),
hv AS (SELECT portfolio_id, count(r) AS n, quantile_cont(r, 0.010000000000000009) AS var FROM series GROUP BY 1)
"""


def oracle_sql() -> dict[str, str]:
    cat = C.oracle_sql()
    gap = lambda name: cat[name].replace(C.BASE.rstrip(), GAP.rstrip())
    q975 = "0.025000000000000022"
    headline = gap("q_headline_var").split("\nSELECT portfolio_id, model,")[0]
    z, pdf = C.NormalDist().inv_cdf(1 - 0.99), C.NormalDist().pdf(C.NormalDist().inv_cdf(1 - 0.99))
    fig = headline + f""", tails AS (SELECT portfolio_id, avg(CASE WHEN r / sigma <= q THEN r / sigma END) AS zm FROM ewma JOIN zz USING (portfolio_id) WHERE i >= 30 GROUP BY 1),
wide5 AS (SELECT portfolio_id, quantile_cont(r, {q975}) AS v FROM series GROUP BY 1), es AS (SELECT portfolio_id, avg(CASE WHEN r <= var THEN r END) AS es, avg(CASE WHEN r <= v THEN r END) AS es5 FROM series JOIN hv USING (portfolio_id) JOIN wide5 USING (portfolio_id) GROUP BY 1),
totals AS (SELECT portfolio_id, sum(value) AS value FROM weights GROUP BY 1),
f0 AS (SELECT portfolio_id, hv.n, value, hv.var AS vh, CASE WHEN hv.n >= 60 THEN es END AS es, CASE WHEN hv.n >= 60 THEN es5 END AS es5, CASE WHEN hv.n >= 120 THEN t END AS t, q, zm, b.model, b.zone, b.kupiec_p
    FROM best b JOIN hv USING (portfolio_id) JOIN today USING (portfolio_id) LEFT JOIN zz USING (portfolio_id) LEFT JOIN tails USING (portfolio_id) JOIN es USING (portfolio_id) JOIN totals USING (portfolio_id) WHERE b.k = 1),
fig AS (SELECT *, coalesce(CASE model WHEN 'fhs' THEN q * t WHEN 'ewma' THEN {z!r}::DOUBLE * t END, vh) AS var FROM f0)"""
    cov = """, x AS (SELECT portfolio_id, asset, d, r - avg(r) OVER (PARTITION BY portfolio_id, asset) AS x FROM moves),
mo AS (SELECT portfolio_id, p.asset AS a, q.asset AS b, count(*) AS n, avg(p.x * q.x) AS s, avg(p.x * p.x * q.x * q.x) AS q, avg(p.x * p.x * p.x * q.x) AS c FROM x p JOIN x q USING (portfolio_id, d) GROUP BY 1, 2, 3),
own AS (SELECT m.*, sqrt(va.s) AS sa, sqrt(vb.s) AS sb FROM mo m JOIN mo va ON va.portfolio_id = m.portfolio_id AND va.a = m.a AND va.b = m.a JOIN mo vb ON vb.portfolio_id = m.portfolio_id AND vb.a = m.b AND vb.b = m.b),
su AS (SELECT portfolio_id, avg(CASE WHEN a <> b THEN s / (sa * sb) END) AS rbar, sum(q - s * s) AS pi, sum(CASE WHEN a = b THEN q - s * s END) AS rho, sum(CASE WHEN a <> b THEN (c - sa * sa * s) * sb / (sa * (sb + 1e-12)) END) AS lean FROM own GROUP BY 1),
ta AS (SELECT *, CASE WHEN a <> b THEN rbar * sa * sb ELSE s END AS t FROM own JOIN su USING (portfolio_id)),
de AS (SELECT portfolio_id, CASE WHEN sum((t - s) * (t - s)) > 0 THEN greatest(0.0, least(1.0, (max(pi) - max(rho) - max(rbar) * max(lean)) / sum((t - s) * (t - s)) / max(n))) ELSE 0.0 END AS delta FROM ta GROUP BY 1),
cov AS (SELECT portfolio_id, a, b, n, delta, s + delta * (t - s) AS cov FROM ta JOIN de USING (portfolio_id)),
ro AS (SELECT portfolio_id, a AS asset, min(n) AS n, sum(cov * value) AS m, sum(CASE WHEN a = b THEN cov END) AS c FROM cov JOIN weights w USING (portfolio_id) WHERE w.asset = b GROUP BY 1, 2),
ea AS (SELECT portfolio_id, asset, w.value, w, m, c, CASE WHEN w.k >= 2 AND ro.n >= 60 AND sum(w.value * m) OVER p > 0 THEN 1 END AS ok, abs(fig.var) * sum(w.value) OVER p AS money, sum(w.value * m) OVER p AS v FROM weights w LEFT JOIN ro USING (portfolio_id, asset) LEFT JOIN fig USING (portfolio_id) WINDOW p AS (PARTITION BY portfolio_id))"""
    choices = """, picked AS (SELECT portfolio_id, CAST(split_part(portfolio_id, '/', 2) AS INTEGER) AS nation FROM (SELECT DISTINCT portfolio_id FROM series)),
choice AS (SELECT portfolio_id, ['rate', 'deposit', 'tlref', 'usd', 'eur'][nation % 6 + 1] AS kind, 0.1::DOUBLE + nation / 100::DOUBLE AS annual FROM picked WHERE nation % 6 < 5),
fxs AS (SELECT CASE asset WHEN '1-URGENT' THEN 'usd' ELSE 'eur' END AS kind, d, ln(px / lag(px) OVER (PARTITION BY asset ORDER BY d)) AS quote FROM prices WHERE asset IN ('1-URGENT', '5-LOW')),
{more}bm AS (SELECT s.portfolio_id, s.i, s.d, s.r, c.kind, CASE WHEN c.kind IN ('rate', 'deposit', 'tlref') THEN ln(1 + c.annual) / 252 END AS rate, q.quote FROM series s LEFT JOIN choice c USING (portfolio_id) LEFT JOIN {fx} q ON q.kind = c.kind AND q.d = s.d)"""
    filled = """fxd AS (SELECT kind, CAST(unnest(generate_series(min(d), (SELECT max(d) FROM series), INTERVAL 1 DAY)) AS DATE) AS d FROM fxs WHERE quote IS NOT NULL GROUP BY kind),
fxa AS (SELECT kind, d, last_value(quote IGNORE NULLS) OVER (PARTITION BY kind ORDER BY d) AS quote FROM fxd LEFT JOIN (SELECT * FROM fxs WHERE quote IS NOT NULL) USING (kind, d)),
"""
    by_window = """, hz AS (SELECT b.*, h AS horizon FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY i DESC) AS back FROM bm) b JOIN (SELECT unnest([252, 756, 1260]) AS h) ON back <= h),
cr AS (SELECT portfolio_id, horizon, kind, r, coalesce(rate, last_value(quote IGNORE NULLS) OVER (PARTITION BY portfolio_id, horizon ORDER BY i)) AS rf FROM hz),
ag AS (SELECT portfolio_id, horizon, kind, count(*) FILTER (rf IS NOT NULL) AS n, avg(r) FILTER (rf IS NOT NULL) AS m, stddev_samp(r) FILTER (rf IS NOT NULL) AS s, avg(rf) AS f FROM cr GROUP BY 1, 2, 3),
ok AS (SELECT *, n >= CASE WHEN horizon <= 252 THEN 60 ELSE floor(horizon * 0.6) END AND s > 0 AS fine FROM ag)
SELECT portfolio_id, horizon::BIGINT AS horizon, kind, CASE WHEN fine THEN round((m - f) * 252 / (s * sqrt(252)), 6) END AS sharpe, CASE WHEN fine THEN round(m * 252, 6) END AS ann_return, CASE WHEN fine THEN round(s * sqrt(252), 6) END AS ann_vol, CASE WHEN fine THEN round(f * 252, 6) END AS ann_rf, CASE WHEN fine THEN n END AS observations FROM ok"""
    quarters = """qd AS (SELECT CAST(unnest(generate_series(date_trunc('quarter', min(CAST(o_orderdate AS DATE))), date_trunc('quarter', max(CAST(o_orderdate AS DATE))), INTERVAL 3 MONTH)) AS DATE) AS a FROM orders),
scen AS (SELECT year(a)::VARCHAR || '-q' || quarter(a)::VARCHAR AS scenario, a, last_day(CAST(a + INTERVAL 2 MONTH AS DATE)) AS b, 'q' || quarter(a)::VARCHAR AS region FROM qd)"""
    stress = f""", {quarters},
inside AS (SELECT scenario, asset, d, px, dense_rank() OVER (PARTITION BY scenario ORDER BY d) AS kk FROM prices JOIN scen ON d BETWEEN a AND b),
st_moved AS (SELECT * FROM (SELECT scenario, asset, d, kk, ln(px / lag(px) OVER o) AS r, lag(kk) OVER o AS k0 FROM inside WHERE px > 0 WINDOW o AS (PARTITION BY scenario, asset ORDER BY d)) WHERE k0 = kk - 1),
active AS (SELECT scenario, portfolio_id, asset, value / sum(value) OVER p AS part, sum(value) OVER p AS held_value, count(*) OVER p AS n FROM (SELECT DISTINCT scenario, asset FROM inside WHERE px > 0) JOIN weights USING (asset) WINDOW p AS (PARTITION BY scenario, portfolio_id)),
st_days AS (SELECT scenario, portfolio_id, d, max(held_value) AS held_value, sum(part * r) AS r FROM st_moved JOIN active USING (scenario, asset) GROUP BY scenario, portfolio_id, d HAVING count(*) = max(n)),
cum AS (SELECT scenario, portfolio_id, count(*) AS n_days, max(held_value) AS held_value, exp(sum(r)) - 1 AS c FROM st_days GROUP BY scenario, portfolio_id),
worth AS (SELECT portfolio_id, sum(value) AS value, list_sort(list(asset)) AS assets FROM weights GROUP BY portfolio_id), had AS (SELECT scenario, portfolio_id, list(asset) AS present FROM active GROUP BY 1, 2),
stressed AS (SELECT scenario, region, portfolio_id, coalesce(n_days, 0)::BIGINT AS n_days, c AS cumulative_return, held_value * c AS impact, value - coalesce(held_value, 0) AS missing, coalesce(held_value, 0) / value AS coverage,
    list_filter(assets, lambda x: c IS NULL OR NOT list_contains(present, x)) AS missing_assets FROM scen CROSS JOIN worth LEFT JOIN cum USING (scenario, portfolio_id) LEFT JOIN had USING (scenario, portfolio_id))"""
    drawn = """, drawn AS (SELECT portfolio_id, n, k, t, ((k + 1) * 104729 + (t + 1) * 15485863 + 12345) % 2147483647 AS x FROM (SELECT portfolio_id, n, unnest(range(400)) AS k FROM (SELECT portfolio_id, count(*)::BIGINT AS n FROM series GROUP BY 1) WHERE n >= 120), (SELECT unnest(range(100000)) AS t) WHERE t < n),
mixed AS (SELECT *, (x * x) % 2147483647 * ((x + 12345) % 2147483647) % 2147483647 AS z FROM drawn), picks AS (SELECT portfolio_id, k, t, ((z * z + x) % 2147483647 * n) // 2147483647 AS i FROM mixed),
levels AS (SELECT p.portfolio_id, k, t, sum(r) OVER (PARTITION BY p.portfolio_id, k ORDER BY t) AS level FROM picks p JOIN series s ON s.portfolio_id = p.portfolio_id AND s.i = p.i),
falls AS (SELECT portfolio_id, k, min(gap) AS low FROM (SELECT portfolio_id, k, level - max(level) OVER (PARTITION BY portfolio_id, k ORDER BY t) AS gap FROM levels) GROUP BY 1, 2),
expected AS (SELECT portfolio_id, quantile_cont(exp(low) - 1, 0.5) AS e FROM falls GROUP BY 1)"""
    part = lambda name: f"({cat[name]})"
    clamp = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(100.0, {x})) END"
    parts = {"sharpe": clamp("50 + 50 * ci.low"), "diversification": clamp("CASE WHEN cc.n_assets >= 2 THEN (cc.effective_bets - 1) / (least(cc.n_assets, 5) - 1) * 100 END"), "tail": clamp("(1.8 - f.es_fhs / f.var_fhs) / 0.8 * 100"),
             "model": "CASE h.zone WHEN 'green' THEN 100.0 WHEN 'yellow' THEN 50.0 WHEN 'red' THEN 0.0 END", "real": clamp("(0.6 - re.prob_loss) / 0.6 * 100"), "drawdown": clamp("85 - 40 * dd.max_drawdown / ex.expected_drawdown")}
    score = "SELECT portfolio_id, " + ", ".join(f'CAST({x} AS DOUBLE) AS "{n}"' for n, x in parts.items()) + " FROM " + part("q_sharpe_ci") + " ci " + " ".join(
        f"LEFT JOIN {sql} {alias} USING (portfolio_id)" for alias, sql in (("cc", f"({_extended_sql('q_concentration')})"), ("f", part("q_fhs")), ("h", part("q_headline_var")), ("re", part("q_real")), ("dd", part("q_drawdown")),
        ("ex", f"({C.BASE.rstrip()}{drawn} SELECT portfolio_id, e AS expected_drawdown FROM expected)")))
    present = " + ".join(f'coalesce("{n}" * {w}, 0)' for n, w in A.SCORE_WEIGHTS.items()), " + ".join(f'CASE WHEN "{n}" IS NOT NULL THEN {w} ELSE 0 END' for n, w in A.SCORE_WEIGHTS.items())
    dec = lambda x, digits=6: f"coalesce(CAST(CAST(round({x}, {digits}) AS DECIMAL(38,{digits})) AS VARCHAR), 'null')"
    whole = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'null')"
    word = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
    names = lambda x: f"('[' || array_to_string(list_transform({x}, lambda x: '\"' || x || '\"'), ',') || ']')"
    body = lambda *fields: "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {x}" for n, x in fields) + " || '}'"
    block = lambda name, sql, *fields: f"SELECT portfolio_id, '{name}' AS block, {body(*fields)} AS body FROM ({sql})"
    several = lambda name, sql, order, *fields: f"SELECT portfolio_id, '{name}' AS block, '[' || string_agg({body(*fields)}, ',' ORDER BY {order}) || ']' AS body FROM ({sql}) GROUP BY portfolio_id"
    d6 = lambda *columns: [(c, dec(c, D.CENTS if c in D.MONEY else 6)) for c in columns]
    d4 = lambda *columns: [(c, dec(c, D.CENTS if c in D.MONEY else 4)) for c in columns]
    cdf = cat["q_sharpe_ci"].split("ts AS (SELECT *, ")[1].split(" AS t FROM ys)")[0]
    out = {
        "q_gap_returns": gap("q_portfolio_returns"),
        "q_gap_set_returns": GAP + "SELECT portfolio_id, asset, d, round(r, 8) AS r FROM moves",
        "q_gap_es": gap("q_es"),
        "q_gap_drawdown": gap("q_drawdown"),
        "q_gap_sharpe": gap("q_sharpe_multi"),
        "q_gap_fhs": gap("q_fhs"),
        "q_gap_srri": gap("q_srri"),
        "q_gap_evt": gap("q_evt"),
        "q_figures": fig + f""" SELECT portfolio_id, n, round(value, 2) AS value, round(vh, 6) AS var_historical, round(es, 6) AS es, round(es5, 6) AS es_975, round(t, 6) AS sigma_today, round({z!r}::DOUBLE * t, 6) AS var_ewma, round({-pdf / (1 - 0.99)!r}::DOUBLE * t, 6) AS es_ewma,
round(q * t, 6) AS var_fhs, round(zm * t, 6) AS es_fhs, model, zone, kupiec_p, round(var, 6) AS var, round(var / vh, 6) AS scale, round(var * value, 2) AS var_value FROM fig""",
        "q_headline_diversification": fig + """, alone AS (SELECT portfolio_id, asset, quantile_cont(r, 0.010000000000000009) AS av FROM moves GROUP BY 1, 2), sv AS (SELECT portfolio_id, sum(value * av) AS sv FROM weights JOIN alone USING (portfolio_id, asset) GROUP BY 1)
SELECT portfolio_id, round(sv * var / vh, 4) AS sum_var, round(var * value, 4) AS portfolio_var, round((abs(sv) - abs(vh * value)) * var / vh, 4) AS benefit FROM sv JOIN fig USING (portfolio_id)""",
        "q_headline_attribution": fig + cov + """ SELECT portfolio_id, asset, CASE WHEN ok = 1 THEN round(w, 4) END AS weight, CASE WHEN ok = 1 THEN round(value * m / v * money, 4) END AS component, CASE WHEN ok = 1 AND money <> 0 THEN round(value * m / v, 4) END AS share,
CASE WHEN ok = 1 THEN round(money * (sqrt(greatest(0.0, v - 2 * value * m + value * value * c) / v) - 1), 4) END AS incremental FROM ea""",
        "q_headline_lvar": fig + """, mu AS (SELECT portfolio_id, sum(w * sqrt(CASE WHEN asset = '4-NOT SPECIFIED' THEN 2.0::DOUBLE ELSE 1.0 END)) AS k FROM weights GROUP BY 1)
SELECT portfolio_id, round(mu.k, 4) AS multiplier, round(var * value, 4) AS var_value, round(var * value * mu.k, 4) AS lvar_value FROM mu LEFT JOIN fig USING (portfolio_id)""",
        "q_sharpe_choice": GAP.rstrip() + choices.format(more="", fx="fxs") + by_window,
        "q_sharpe_choice_asof": GAP.rstrip() + choices.format(more=filled, fx="fxa") + by_window,
        "q_sharpe_choice_ci": GAP.rstrip() + choices.format(more="", fx="fxs") + f""", lt AS (SELECT portfolio_id, r - coalesce(rate, last_value(quote IGNORE NULLS) OVER (PARTITION BY portfolio_id ORDER BY i), CASE WHEN kind IS NULL THEN ln(1.3::DOUBLE) / 252 END) AS x FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY i DESC) AS back FROM bm) WHERE back <= 252),
m AS (SELECT portfolio_id, count(*) AS rows, count(x) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM lt GROUP BY 1),
g AS (SELECT portfolio_id, n, mu / sd AS sr, avg(pow((x - mu) / sd, 3)) AS g3, avg(pow((x - mu) / sd, 4)) AS g4 FROM lt JOIN m USING (portfolio_id) WHERE rows >= 120 AND sd > 0 GROUP BY portfolio_id, n, mu, sd),
zs AS (SELECT *, sqrt((1 + 0.5 * sr * sr) / n) * sqrt(252) AS se, sr * sqrt(n - 1) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-9)) AS z FROM g), ys AS (SELECT *, abs(z) AS y FROM zs), ts AS (SELECT *, {cdf} AS t FROM ys)
SELECT portfolio_id, n, round(sr * sqrt(252), 6) AS sharpe, round(se, 6) AS se, round(sr * sqrt(252) - 1.96 * se, 6) AS low, round(sr * sqrt(252) + 1.96 * se, 6) AS high, round(CASE WHEN z > 0 THEN 1 - t ELSE t END, 6) AS psr, round(g3, 6) AS skew, round(g4 - 3, 6) AS excess_kurtosis FROM (SELECT DISTINCT portfolio_id FROM series) LEFT JOIN ts USING (portfolio_id)""",
    }
    spread = out["q_headline_diversification"].replace(", 4)", ", 9)")  # the document rounds to cents
    shares = out["q_headline_attribution"].replace(", 4)", ", 9)")
    choice_ci = out["q_sharpe_choice_ci"].replace("CASE WHEN kind IS NULL THEN ln(1.3::DOUBLE) / 252 END", "CASE WHEN kind IS NULL THEN 0.0 END")
    beat = gap("q_beat_deposit").replace("ln(1 + 0.4)", "ln(1 + 0.3)")
    regime = gap("q_vol_regime")
    corr = GAP + "SELECT portfolio_id, p.asset AS a, q.asset AS b, round_even(corr(p.r, q.r), 4) AS rho FROM moves p JOIN moves q USING (portfolio_id, d) WHERE p.asset < q.asset GROUP BY 1, 2, 3"
    tails = GAP.rstrip() + """, cut AS (SELECT portfolio_id, asset, quantile_cont(r, 0.05) AS cut, count(*) AS n FROM moves GROUP BY 1, 2), mk AS (SELECT m.portfolio_id, m.asset, m.d, m.r, c.n, m.r <= c.cut AS low FROM moves m JOIN cut c USING (portfolio_id, asset) WHERE c.n >= 300),
pr AS (SELECT portfolio_id, p.asset AS a, q.asset AS b, count(*) FILTER (p.low AND q.low) AS co_exceedances, corr(p.r, q.r) AS pearson, max(p.n) AS n FROM mk p JOIN mk q USING (portfolio_id, d) WHERE p.asset < q.asset GROUP BY 1, 2, 3)
SELECT portfolio_id, a, b, co_exceedances, co_exceedances / (0.05::DOUBLE * n) AS tail_lambda, pearson, row_number() OVER (PARTITION BY portfolio_id ORDER BY co_exceedances DESC, a, b) AS place FROM pr QUALIFY place <= 5"""
    exits = GAP + "SELECT portfolio_id, asset, CASE WHEN asset = '4-NOT SPECIFIED' THEN 2.0::DOUBLE ELSE 1.0 END AS days_to_exit, w AS value_share FROM weights"
    blocks = [
        block("risk", fig + f" SELECT *, var * value AS var_value, vh AS var_historical, es5 AS es_975, {z!r}::DOUBLE * t AS var_ewma, {-pdf / (1 - 0.99)!r}::DOUBLE * t AS es_ewma, q * t AS var_fhs, zm * t AS es_fhs FROM fig",
              ("n", whole("n")), *d6("value", "var", "var_value", "var_historical", "es", "es_975"), ("model", word("model")), ("zone", word("zone")), *d6("kupiec_p", "var_ewma", "var_fhs", "es_ewma", "es_fhs")),
        several("sharpe", f"SELECT * FROM ({out['q_sharpe_choice']}) WHERE sharpe IS NOT NULL", "horizon", ("horizon", whole("horizon")), ("kind", word("kind")), *d6("sharpe", "ann_return", "ann_vol", "ann_rf"), ("observations", whole("observations"))),
        block("sharpe_ci", f"SELECT * FROM ({choice_ci}) WHERE sharpe IS NOT NULL", *d6("sharpe", "se", "low", "high", "psr"), ("n", whole("n"))),
        block("beat_deposit", f"SELECT * FROM ({beat}) WHERE n >= 120", *d6("below", "below_point")),
        several("correlation", corr, "a, b", ("a", word("a")), ("b", word("b")), *d4("rho")),
        block("diversification", spread, *d4("sum_var", "portfolio_var", "benefit")),
        several("stress_tests", GAP.rstrip() + stress + " SELECT * FROM stressed", "impact IS NULL, round(impact, 2), scenario", ("scenario", word("scenario")), ("region", word("region")), *d4("cumulative_return", "impact", "coverage"), ("missing_assets", names("missing_assets"))),
        several("attribution", f"SELECT * FROM ({shares}) WHERE component IS NOT NULL", "round(component, 4) DESC, asset", ("asset", word("asset")), *d4("weight", "component", "share", "incremental")),
        block("drawdown", f"SELECT * FROM ({out['q_gap_drawdown']}) WHERE max_drawdown IS NOT NULL", *d6("max_drawdown", "ulcer", "calmar"), ("longest_run", whole("longest_run")), ("current_run", whole("current_run"))),
        block("tail", f"SELECT * FROM ({out['q_gap_evt']}) WHERE xi IS NOT NULL", *d6("xi", "beta", "var_evt", "es_evt", "threshold"), ("exceedances", whole("exceedances"))),
        several("tail_dependence", tails, "place", ("a", word("a")), ("b", word("b")), ("co_exceedances", whole("co_exceedances")), *d6("tail_lambda", "pearson")),
        block("vol_regime", f"SELECT * FROM ({regime}) WHERE current_vol IS NOT NULL", *d6("current_vol", "percentile", "median_vol"), ("observations", whole("observations"))),
        several("liquidity", exits, "days_to_exit DESC, asset", ("asset", word("asset")), *d6("days_to_exit", "value_share")),
        block("risk_class", f"SELECT * FROM ({out['q_gap_srri']}) WHERE volatility IS NOT NULL", ("srri", whole("srri")), *d6("volatility"), ("weeks", whole("weeks"))),
    ]
    united = lambda sqls: " UNION ALL ".join(f"SELECT * FROM ({x})" for x in sqls)
    joined = lambda order: " || ".join(f"',\"{n}\":' || coalesce(max(CASE WHEN block = '{n}' THEN body END), 'null')" for n in order)
    books = f"(SELECT DISTINCT portfolio_id FROM ({GAP} SELECT portfolio_id FROM weights))"
    sim = GAP.rstrip() + """, scen AS (SELECT 'range' AS scenario, DATE '1996-03-01' AS a, DATE '1998-09-30' AS b, '' AS region)""" + stress.split(", 'q' || quarter(a)::VARCHAR AS region FROM qd)")[1] + """,
sim_held AS (SELECT w.portfolio_id, w.asset, w.value FROM weights w JOIN stressed s USING (portfolio_id) WHERE s.cumulative_return IS NOT NULL AND NOT list_contains(s.missing_assets, w.asset)),
sim_base AS (SELECT portfolio_id, sum(value) AS base, count(*) AS k FROM sim_held GROUP BY 1),
sim_px AS (SELECT portfolio_id, asset, d, px, value / base AS part, count(*) OVER (PARTITION BY portfolio_id, d) AS n, k FROM sim_held JOIN sim_base USING (portfolio_id) JOIN prices USING (asset) WHERE d BETWEEN DATE '1996-03-01' AND DATE '1998-09-30'),
sim_r AS (SELECT portfolio_id, d, part * ln(px / lag(px) OVER (PARTITION BY portfolio_id, asset ORDER BY d)) AS r FROM sim_px WHERE n = k), sim_d AS (SELECT portfolio_id, d, sum(r) AS r FROM sim_r GROUP BY 1, 2),
sim_path AS (SELECT portfolio_id, d, row_number() OVER p - 1 AS point, base * exp(coalesce(sum(r) OVER p, 0)) AS value, count(*) OVER (PARTITION BY portfolio_id) AS n FROM sim_d JOIN sim_base USING (portfolio_id) WINDOW p AS (PARTITION BY portfolio_id ORDER BY d)),
sim_kept AS (SELECT portfolio_id, d, point, value, unnest(range(CASE WHEN n > 300 AND point % (n // 300 + 1) = 0 AND point = n - 1 THEN 2 ELSE 1 END)) AS again FROM sim_path WHERE n <= 300 OR point % (n // 300 + 1) = 0 OR point = n - 1),
sim_last AS (SELECT portfolio_id, arg_max(value, point) AS final FROM sim_path GROUP BY 1)"""
    result = body(("start", "'\"1996-03-01\"'"), ("end", "'\"1998-09-30\"'"), ("cumulative_return", dec("cumulative_return")), ("impact", dec("impact", 2)), ("base_value", dec("base", 2)), ("final_value", dec("final", 2)))
    style = GAP.rstrip() + f""", st_cal AS (SELECT DISTINCT d FROM prices WHERE asset IN ('{STYLE[0]}', '{STYLE[1]}')), st_wide AS (SELECT d, p.px AS a, q.px AS b FROM st_cal LEFT JOIN (SELECT d, px FROM prices WHERE asset = '{STYLE[0]}') p USING (d) LEFT JOIN (SELECT d, px FROM prices WHERE asset = '{STYLE[1]}') q USING (d)),
st_f AS (SELECT d, ln(a / lag(a) OVER (ORDER BY d)) AS x1, ln(b / lag(b) OVER (ORDER BY d)) AS x2 FROM st_wide), st_fund AS (SELECT d, ln(px / lag(px) OVER (ORDER BY d)) AS r FROM prices WHERE asset = '{FUND}'),
st_y AS (SELECT d, 0 AS lag, r AS y FROM st_fund WHERE r IS NOT NULL UNION ALL SELECT d, 1, lead(r) OVER (ORDER BY d) FROM st_fund WHERE r IS NOT NULL), st_yx AS (SELECT * FROM st_y JOIN st_f USING (d) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
st_w AS (SELECT lag, greatest(0.0, least(1.0, sum((x1 - x2) * (y - x2)) / sum((x1 - x2) * (x1 - x2)))) AS w FROM st_yx GROUP BY 1 HAVING count(*) >= 120), st_r AS (SELECT lag, max(w) AS w, 1 - sum(pow(y - w * x1 - (1 - w) * x2, 2)) / (var_pop(y) * count(*)) AS r2 FROM st_yx JOIN st_w USING (lag) GROUP BY 1),
st_best AS (SELECT w FROM st_r ORDER BY r2 DESC, lag LIMIT 1), st_fx AS (SELECT d, ln(px / lag(px) OVER (ORDER BY d)) AS f FROM prices WHERE asset = '{CURRENCY}'),
st_e AS (SELECT portfolio_id, least(1.0, coalesce(sum(CASE WHEN asset IN ('1-URGENT', '2-HIGH') THEN w END), 0.0) + coalesce(sum(CASE WHEN asset = '{FUND}' THEN w END), 0.0) * coalesce((SELECT w FROM st_best), 0.0)) AS e FROM weights GROUP BY 1),
v AS (SELECT portfolio_id, e, count(*) AS n, var_samp(r) AS vp, var_samp(r - e * f) AS vl, var_samp(e * f) AS vf, var_samp(f) AS vx, avg(f) AS m FROM series JOIN st_fx USING (d) JOIN st_e USING (portfolio_id) WHERE f IS NOT NULL GROUP BY 1, 2),
v_ok AS (SELECT * FROM v WHERE n >= 120 AND vp > 0 AND vx > 0)"""
    amount = lambda x: f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS BIGINT)"
    share = "((value % 997 - 300) / 4096)"
    two = f"(CASE WHEN {share} < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(round_even({share} * 100, 2))) || '%')"
    faults = ("SELECT o_custkey, CASE WHEN o_totalprice - 20000 <= 0 THEN 'quantity' END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'currency' END AS b, CASE WHEN o_orderkey % 7 = 0 THEN 'name' END AS c, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 50 THEN 'count' END AS d FROM orders")
    return out | {
        "q_expected_drawdown": C.BASE.rstrip() + drawn + ", cnt AS (SELECT portfolio_id, count(*)::BIGINT AS n FROM series GROUP BY 1) SELECT portfolio_id, n, round(e, 6) AS expected_drawdown FROM cnt LEFT JOIN expected USING (portfolio_id)",
        "q_score_full": f"WITH p AS ({score}) SELECT portfolio_id, " + ", ".join(f'round_even("{n}", 1) AS "{n}"' for n in parts) + f", round_even(({present[0]}) / nullif({present[1]}, 0), 1) AS score FROM p",
        "q_scenarios": GAP.rstrip() + stress + " SELECT scenario, region, portfolio_id, n_days, round(cumulative_return, 6) AS cumulative_return, round(impact, 4) AS impact, round(missing, 4) AS missing, round(coverage, 6) AS coverage, array_to_string(missing_assets, ',') AS missing_assets FROM stressed WHERE region IN ('q1', 'q3')",
        "q_look_through": style + " SELECT portfolio_id, round(o.e, 6) AS exposure, round(vl / vp, 6) AS local_share, round(vf / vp, 6) AS fx_share, round((vp - vl - vf) / vp, 6) AS cov_share, round(sqrt(vx * 252), 6) AS fx_vol, round(m * 252, 6) AS fx_drift FROM st_e LEFT JOIN v_ok o USING (portfolio_id)",
        "q_style_panel_gaps": GAP.rstrip() + """, idx AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS v FROM orders GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM idx), rh AS (SELECT d, last_value(20 + v / 10000::DOUBLE IGNORE NULLS) OVER (ORDER BY d) / 100 * 0.85::DOUBLE AS rate FROM cal LEFT JOIN idx USING (d)),
wide AS (SELECT d, max(CASE WHEN asset = '5-LOW' THEN px END) AS a, max(CASE WHEN asset = '1-URGENT' THEN px END) AS b, max(CASE WHEN asset = '2-HIGH' THEN px END) AS g, max(CASE WHEN asset = '3-MEDIUM' THEN px END) AS s FROM prices WHERE asset IN ('5-LOW', '1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY d),
fx AS (SELECT *, last_value(b IGNORE NULLS) OVER (ORDER BY d) AS rate_now FROM wide), each AS (SELECT d, unnest(['index', 'currency', 'gold', 'shares']) AS factor, unnest([a, b, g * rate_now, s * rate_now]) AS v FROM fx),
mv AS (SELECT factor, d, ln(v / lag(v) OVER (PARTITION BY factor ORDER BY d)) AS f FROM each), cash AS (SELECT d, ln(1 + last_value(rate IGNORE NULLS) OVER (ORDER BY d)) / 252 AS f FROM wide LEFT JOIN rh USING (d))
SELECT factor, d, round(f, 6) AS f FROM mv WHERE f IS NOT NULL UNION ALL SELECT 'cash', d, round(f, 6) FROM cash WHERE f IS NOT NULL""",
        "q_store": GAP + "SELECT portfolio_id, asset, CASE WHEN CAST(split_part(portfolio_id, '/', 2) AS INTEGER) % 2 = 1 THEN quantity * 2 ELSE quantity END AS quantity FROM holdings WHERE CAST(split_part(portfolio_id, '/', 2) AS INTEGER) % 5 <> 0",
        "q_problems": f"WITH f AS ({faults}), e AS (SELECT o_custkey, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS problem FROM (SELECT o_custkey, list_filter([a, b, c, d], lambda y: y IS NOT NULL) AS x FROM f)) SELECT problem, count(*) AS n, count(DISTINCT o_custkey) AS portfolios FROM e GROUP BY 1",
        "q_written_numbers": GAP.rstrip() + f", v AS (SELECT portfolio_id, sum(value) AS value FROM weights GROUP BY 1) SELECT portfolio_id, replace(format('{{:,}}', {amount('value')}), ',', '.') || ' TL' AS amount_tr, replace({two}, '.', ',') AS share_tr, format('{{:,}}', {amount('value')}) || ' TRY' AS amount_en, {two} AS share_en FROM v",
        "q_analysis_json": f"WITH blocks AS ({united(blocks)}) SELECT portfolio_id, '{{\"portfolio_id\":\"' || portfolio_id || '\"' || {joined(D.ANALYSIS)} || '}}' AS document FROM {books} LEFT JOIN blocks USING (portfolio_id) GROUP BY portfolio_id",
        "q_simulation_json": f"""WITH blocks AS ({united([
            f"{sim} SELECT portfolio_id, 'result' AS block, {result} AS body FROM stressed JOIN sim_base USING (portfolio_id) JOIN sim_last USING (portfolio_id) WHERE cumulative_return IS NOT NULL",
            f"{sim} SELECT portfolio_id, 'missing_assets' AS block, {body(('missing_assets', names('missing_assets')))} AS body FROM stressed",
            several("series", sim + " SELECT * FROM sim_kept", "point", ("date", word("CAST(d AS VARCHAR)")), *d6("value")),
        ])}) SELECT portfolio_id, '{{\"portfolio_id\":\"' || portfolio_id || '\"' || {joined(["result", "missing_assets", "series"])} || '}}' AS document FROM {books} LEFT JOIN blocks USING (portfolio_id) GROUP BY portfolio_id""",
        "q_customer_var": GAP.replace(GAP.split("holdings AS (")[1].split("),\nlast_px")[0], "SELECT CAST(o_custkey AS VARCHAR) AS portfolio_id, o_orderpriority AS asset, count(*)::DOUBLE AS quantity FROM orders GROUP BY 1, 2") + "SELECT portfolio_id, n, round(var, 8) AS var FROM hv",
    }
