"""Registered queries on several currencies, reports, rates, factors and the make-up of portfolios, and their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bonds as B
from tidemark.operators import exposure as E
from tidemark.operators import factors as X
from tidemark.operators import rates as I
from tidemark.operators import reports as P
from tidemark.operators import risk as R
from tidemark.operators import structure as U
from tidemark.operators import valuation as V
from tidemark.plans import catalog as C
from tidemark.sources import roles as S
from tidemark.sources import snapshots as K

FX, GOLD, FACTORS = "1-URGENT", "2-HIGH", ["1-URGENT", "5-LOW"]
SHOCKS = [("devaluation", "1-URGENT", 0.3), ("devaluation", "5-LOW", -0.1), ("calm", "1-URGENT", -0.05), ("slump", "5-LOW", -0.25), ("elsewhere", "other", 0.5)]


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return S.sparse_prices(spark, d).withColumn("px", F.col("px") / 99991)


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's positions in the priorities by count of orders at their average value, and one that nobody quotes."""
    o, c = S.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice"), S.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    name = F.col("o_orderpriority").alias("name")
    sums = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("portfolio_id"), name)
    held = sums.agg(F.count("*").cast("double").alias("quantity"), (F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double") / F.count("*") / 99991).alias("cost"))
    none = c.select(F.col("c_mktsegment").alias("portfolio_id"), F.lit("unquoted").alias("name"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("cost")).distinct()
    source = F.when(F.col("name") == GOLD, "gram").when(F.col("name").startswith("4"), "fund").otherwise("quote")
    rows = held.unionByName(none).withColumn("ticker", F.col("name")).withColumn("source", source)
    return rows.withColumn("currency", F.when(F.col("name").startswith("3"), "USD").otherwise("TRY")).withColumn("kind", F.lit("market")).withColumn("cost", F.when(F.col("name") != "5-LOW", F.col("cost")))


def _local(spark: SparkSession, d: str) -> DataFrame:
    return _instruments(spark, d).withColumnRenamed("ticker", "name").select("name", "d", "px", "native")


def _instruments(spark: SparkSession, d: str) -> DataFrame:
    return V.local_prices(_quotes(spark, d), _positions(spark, d), FX, GOLD, V.INSTRUMENT)


def _market(spark: SparkSession, d: str) -> DataFrame:
    last = _instruments(spark, d).groupBy(*V.INSTRUMENT).agg(F.max_by("native", "d").alias("last"))
    return V.position_values(_positions(spark, d), last, V.rate_now(_quotes(spark, d), FX, required=True), V.INSTRUMENT)


def _bonds(spark: SparkSession, d: str) -> DataFrame:
    """The bonds, spread over the segments by number, half of them in foreign currency."""
    segments = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    k = F.col("bond_id")
    rows = B.metrics(S.bonds(spark, d)).withColumn("portfolio_id", segments[(k % 5).cast("int")]).withColumn("name", k.cast("string"))
    return rows.withColumn("currency", F.when(k % 2 == 0, "USD").otherwise("TRY")).withColumn("cost", F.when(k % 3 > 0, F.lit(90.0)))


def _valued(spark: SparkSession, d: str) -> DataFrame:
    return V.with_bonds(_market(spark, d), _bonds(spark, d), V.rate_now(_quotes(spark, d), FX))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return P.value_series(_quotes(spark, d), _positions(spark, d).select("portfolio_id", F.col("name").alias("asset"), "quantity"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The price index as documents of statistics, a document a year, with days written in three ways and values that aren't there."""
    rows = S.price_index(spark, d).select("d", F.col("v").cast("string").alias("v"), F.trunc("d", "month").alias("m"))
    way = F.when(F.month("d") % 3 == 0, F.date_format("m", "dd-MM-yyyy")).when(F.month("d") % 3 == 1, F.date_format("m", "yyyy-M")).otherwise(F.date_format("m", "yyyy-MM-dd"))
    item = lambda v: F.create_map(F.lit("Tarih"), way, F.lit("V"), v)
    items = rows.groupBy(F.year("d").alias("y")).agg(F.flatten(F.collect_list(F.array(item(F.col("v")), item(F.lit("null")), item(F.lit(""))))).alias("items"))
    return items.select(F.lit("index").alias("series"), F.to_json(F.struct("items")).alias("doc"))


def _rates(spark: SparkSession, d: str) -> DataFrame:
    """A made-up deposit rate in percent from the price index."""
    return S.price_index(spark, d).select(F.lit("deposit").alias("series"), "d", (20 + F.col("v") / 10000).alias("v"))


def _rf(spark: SparkSession, d: str) -> DataFrame:
    return I.rate_history(_rates(spark, d)).select("d", (F.log(1 + F.col("rate")) / 252).alias("rf"))


def _sums(spark: SparkSession, d: str, lags: int) -> DataFrame:
    panel = X.log_panel(S.sparse_prices(spark, d).where(F.col("asset").isin(FACTORS)).withColumnRenamed("asset", "factor"))
    return X.moments(C._returns(spark, d).withColumnRenamed("asset", "key"), panel, FACTORS, lags)


def _factor_shocks(spark: SparkSession, d: str) -> DataFrame:
    betas = X.portfolio_betas(X.betas(_sums(spark, d, 0), FACTORS), C._weights(spark, d))
    return X.real_impact(E.shock_grid(betas, C._values(spark, d), SHOCKS), SHOCKS, FX)


def _concentration(spark: SparkSession, d: str) -> DataFrame:
    book = C._book(spark, d)
    return U.concentration(book.moments, book.covariance, book.weights)


def _parity(spark: SparkSession, d: str) -> DataFrame:
    book = C._book(spark, d)
    return U.hierarchical_parity(book.moments, book.weights)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of the correlation matrix, to four digits."""
    upper = R.correlations(r := C._returns(spark, d)).select("a", "b", F.bround("rho", 4).alias("rho"))
    own = r.select(F.col("asset").alias("a"), F.col("asset").alias("b"), F.lit(1.0).alias("rho")).distinct()
    return upper.unionByName(upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho")).unionByName(own)


def _liquidity_var(spark: SparkSession, d: str) -> DataFrame:
    by = C._liquidity(spark, d).groupBy("portfolio_id").agg(F.max("lvar_multiplier").alias("multiplier"))
    return by.join(R.historical_var(C._series(spark, d)), "portfolio_id").select("portfolio_id", "multiplier", "var", (F.col("var") * F.col("multiplier")).alias("lvar"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Two priorities from the open orders, what these lack from all; values under 1,000 stand for no price."""
    px = F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice").cast("double")).otherwise(0.0)
    rows = S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").alias("seq"), px.alias("px"), "o_orderstatus")
    return K.merged(rows.where(F.col("asset").isin("1-URGENT", "3-MEDIUM") & (F.col("o_orderstatus") == "O")).drop("o_orderstatus"), rows.drop("o_orderstatus"))


def _recent_volume(spark: SparkSession, d: str) -> DataFrame:
    """Average daily quantity of the last ninety days of the table, of assets with ten days or more."""
    daily = S.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").cast("date").alias("d")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    last = daily.agg(F.date_sub(F.max("d"), 90).alias("since"))
    rows = daily.join(F.broadcast(last), F.expr("d > since")).where("v > 0")  # one row
    return rows.groupBy("asset").agg(F.count("*").alias("days"), F.avg("v").alias("adv")).where("days >= 10")


def _search(spark: SparkSession, d: str) -> DataFrame:
    parts = S.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    taken = S.table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_name").alias("name"))
    return P.search(parts, taken, "CUSTOMER#0000", ["BUILDING", "MACHINERY"])


def _recipients(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users: verified with a positive balance, reports for odd nations; positions are the orders, bonds the customer of each supplier's number."""
    c = S.table(spark, d, "customer")
    users = c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("portfolio_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("nickname"),
        F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@example.org")).alias("email"), (F.col("c_acctbal") > 0).alias("verified"), (F.col("c_nationkey") % 2 == 1).alias("weekly"),
    )
    held = S.table(spark, d, "orders").where("o_totalprice > 20000").select(F.col("o_custkey").alias("portfolio_id"))
    return P.recipients(users, held, S.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("portfolio_id")), "weekly")


def queries() -> dict:
    rounded = lambda f, digits=6: lambda spark, d: C._rounded(f(spark, d), digits)
    series = lambda f, digits=8: lambda spark, d: C._rounded(f(C._series(spark, d)), digits)
    return {
        "q_local_prices": rounded(_local, 6),
        "q_full_valuation": rounded(_valued, 4),
        "q_valuation_totals": rounded(lambda spark, d: V.totals(_valued(spark, d)), 2),
        "q_valuation_json": lambda spark, d: V.documents(_market(spark, d)),
        "q_accepted": rounded(lambda spark, d: V.accepted(_positions(spark, d)).groupBy("portfolio_id", "problem").agg(F.count("*").alias("n"))),
        "q_value_series": rounded(_values, 4),
        "q_period_stats": rounded(lambda spark, d: P.period_stats(_values(spark, d))),
        "q_observations": rounded(lambda spark, d: I.observations(_documents(spark, d), "V")),
        "q_latest_rates": rounded(lambda spark, d: I.latest_rates(_rates(spark, d))),
        "q_rate_history": rounded(lambda spark, d: I.rate_history(_rates(spark, d))),
        "q_sharpe_series": rounded(lambda spark, d: I.sharpe_over_series(C._series(spark, d), _rf(spark, d))),
        "q_factor_betas": rounded(lambda spark, d: X.betas(_sums(spark, d, 1), FACTORS)),
        "q_factor_shocks": rounded(_factor_shocks, 4),
        "q_style": rounded(lambda spark, d: X.style(_sums(spark, d, 1), FACTORS)),
        "q_style_panel": rounded(lambda spark, d: X.with_cash(X.log_panel(S.sparse_prices(spark, d).withColumnRenamed("asset", "factor")), I.rate_history(_rates(spark, d)))),
        "q_concentration": rounded(_concentration),
        "q_hrp": rounded(_parity),
        "q_expected_drawdown": series(U.expected_drawdown, 6),
        "q_corr_matrix": _matrix,
        "q_ewma_var": series(lambda s: R.parametric(R.ewma_path(s))),
        "q_lvar": rounded(_liquidity_var),
        "q_tail_pairs": rounded(lambda spark, d: R.tail_pairs(C._returns(spark, d)).drop("set_id", "place")),
        "q_merged_prices": rounded(_merged, 2),
        "q_adv_recent": rounded(_recent_volume),
        "q_search": _search,
        "q_recipients": _recipients,
    }


def oracle_sql() -> dict[str, str]:
    quotes = """quotes AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) / 99991 AS px FROM orders GROUP BY 1, 2)"""
    positions = """pos AS (SELECT c_mktsegment AS portfolio_id, o_orderpriority AS name, count(*)::DOUBLE AS quantity, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) / 99991 END AS cost
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 UNION ALL SELECT DISTINCT c_mktsegment, 'unquoted', 1.0::DOUBLE, 1.0::DOUBLE FROM customer)"""
    local = f"""WITH {quotes}, {positions},
rate AS (SELECT d, last_value(x IGNORE NULLS) OVER (ORDER BY d) AS rate FROM (SELECT d, max(CASE WHEN asset = '{FX}' THEN px END) AS x FROM quotes GROUP BY d)),
local AS (SELECT asset AS name, d, CASE WHEN asset = '{GOLD}' THEN px * rate / 31.1034768::DOUBLE WHEN asset LIKE '3%' THEN px * rate ELSE px END AS px, CASE WHEN asset = '{GOLD}' THEN px * rate / 31.1034768::DOUBLE ELSE px END AS native FROM quotes LEFT JOIN rate USING (d)),
last AS (SELECT name, arg_max(native, d) AS last FROM local WHERE native IS NOT NULL GROUP BY 1), now AS (SELECT arg_max(px, d) AS fx FROM quotes WHERE asset = '{FX}'),
val AS (SELECT portfolio_id, name, 'market' AS kind, CASE WHEN name LIKE '3%' THEN 'USD' ELSE 'TRY' END AS currency, last IS NULL AS failed, quantity * last AS value, CASE WHEN last IS NOT NULL THEN quantity * cost END AS cost_total, quantity * last - quantity * cost AS pnl,
    (quantity * last - quantity * cost) * 100 / (quantity * cost) AS pnl_pct, CASE WHEN name LIKE '3%' THEN fx ELSE 1 END AS f FROM pos LEFT JOIN last USING (name) CROSS JOIN now),
market AS (SELECT portfolio_id, name, kind, currency, failed, value, cost_total, pnl, pnl_pct, value * f AS local_value, pnl * f AS local_pnl FROM val)"""
    bonds = C.BONDS.strip().removeprefix("WITH ")
    both = local + f""", {bonds},
held AS (SELECT ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][(bond_id % 5)::INTEGER + 1] AS portfolio_id, bond_id::VARCHAR AS name, 'bond' AS kind, CASE WHEN bond_id % 2 = 0 THEN 'USD' ELSE 'TRY' END AS currency, FALSE AS failed,
    nominal / 100 * price AS value, CASE WHEN bond_id % 3 > 0 THEN nominal / 100 * 90 END AS cost, CASE WHEN bond_id % 2 = 0 THEN fx ELSE 1 END AS f, m.fair, m.macaulay, m.modified, ytm FROM b JOIN m USING (bond_id) CROSS JOIN now),
valued AS (SELECT *, NULL::DOUBLE AS fair, NULL::DOUBLE AS macaulay, NULL::DOUBLE AS modified, NULL::DOUBLE AS ytm FROM market UNION ALL
    SELECT portfolio_id, name, kind, currency, failed, value, cost, value - cost, (value - cost) * 100 / cost, value * f, (value - cost) * f, fair, macaulay, modified, ytm FROM held)"""
    values = f"""WITH {quotes}, {positions}, own AS (SELECT portfolio_id, name AS asset, quantity FROM pos WHERE name <> 'unquoted'),
grid AS (SELECT DISTINCT portfolio_id, d FROM own JOIN quotes USING (asset)),
fill AS (SELECT portfolio_id, asset, d, quantity, last_value(px IGNORE NULLS) OVER (PARTITION BY portfolio_id, asset ORDER BY d) AS px FROM grid JOIN own USING (portfolio_id) LEFT JOIN quotes USING (asset, d)),
vs AS (SELECT portfolio_id, d, sum(px * quantity) AS value FROM fill GROUP BY 1, 2 HAVING count(px) = count(*))"""
    index = "idx AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS v FROM orders GROUP BY 1), dep AS (SELECT d, 20 + v / 10000::DOUBLE AS v FROM idx)"
    history = index + ", cal AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM dep), rh AS (SELECT d, last_value(v IGNORE NULLS) OVER (ORDER BY d) / 100 * 0.85::DOUBLE AS rate FROM cal LEFT JOIN dep USING (d))"
    period = lambda k, n, days: f"SELECT portfolio_id, d, '{k}' AS period, {n} AS step, value / lag(value, {days or 1}) OVER (PARTITION BY portfolio_id ORDER BY d) - 1 AS ret FROM {'daily' if days else 'vs'}"
    moves = " UNION ALL ".join(period(k, n, days) for k, (n, days) in P.PERIODS.items())
    then = lambda n: f"quantile_cont(CASE WHEN back > {n} THEN r END, 0.010000000000000009)"
    panel = f""", f0 AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS px FROM orders WHERE o_orderpriority IN ('{FACTORS[0]}', '{FACTORS[1]}') GROUP BY 1, 2),
f1 AS (SELECT asset, d, ln(px / lag(px) OVER (PARTITION BY asset ORDER BY d)) AS f FROM f0), fp AS (SELECT p.d, p.f AS x1, q.f AS x2 FROM f1 p JOIN f1 q USING (d) WHERE p.asset = '{FACTORS[0]}' AND q.asset = '{FACTORS[1]}' AND p.f IS NOT NULL AND q.f IS NOT NULL),
ys AS (SELECT asset AS key, d, 0 AS lag, r AS y FROM returns UNION ALL SELECT asset, d, 1, lead(r) OVER (PARTITION BY asset ORDER BY d) FROM returns), yx AS (SELECT * FROM ys JOIN fp USING (d) WHERE y IS NOT NULL),
g AS (SELECT key, lag, count(*) AS n, covar_pop(x1, x1) AS c11, covar_pop(x2, x2) AS c22, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, var_pop(y) AS v FROM yx GROUP BY 1, 2 HAVING count(*) >= 120),
fit AS (SELECT key, lag, n, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) AS b1, (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) AS b2, c1, c2, v FROM g), ols AS (SELECT *, (b1 * c1 + b2 * c2) / v AS r2 FROM fit)"""
    listed = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in SHOCKS)
    best = lambda t: f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY r2 DESC, lag) AS k FROM {t})"
    pairs = """, cv AS (SELECT p.asset AS a, q.asset AS b, covar_samp(p.r, q.r) AS c, corr(p.r, q.r) AS rho FROM returns p JOIN returns q USING (d) GROUP BY 1, 2), one AS (SELECT max(CASE WHEN a = 'A' AND b = 'N' THEN rho END) AS an, max(CASE WHEN a = 'A' AND b = 'R' THEN rho END) AS ar,
max(CASE WHEN a = 'N' AND b = 'R' THEN rho END) AS nr, max(CASE WHEN a = 'A' AND b = 'A' THEN c END) AS va, max(CASE WHEN a = 'N' AND b = 'N' THEN c END) AS vn, max(CASE WHEN a = 'R' AND b = 'R' THEN c END) AS vr, max(CASE WHEN a = 'N' AND b = 'R' THEN c END) AS cnr,
max(CASE WHEN a = 'A' AND b = 'N' THEN c END) AS can, max(CASE WHEN a = 'A' AND b = 'R' THEN c END) AS car FROM cv)"""
    normal = NormalDist()
    z = normal.inv_cdf(1 - 0.99)
    cat = C.oracle_sql()
    lw = cat["q_lw_cov"].rsplit(" SELECT portfolio_id, a, b", 1)[0]
    r = lambda *names, n=6: ", ".join(f"round({x}, {n}) AS {x}" for x in names)
    money = lambda c: f"CAST(CAST(round({c}, 2) AS DECIMAL(30,2)) AS VARCHAR)"
    return {
        "q_local_prices": local + " SELECT name, d, round(px, 6) AS px, round(native, 6) AS native FROM local",
        "q_full_valuation": both + f" SELECT portfolio_id, name, kind, currency, failed, {r('value', 'cost_total', 'pnl', 'pnl_pct', 'local_value', 'local_pnl', 'fair', 'macaulay', 'modified', 'ytm', n=4)} FROM valued",
        "q_valuation_totals": both + """ SELECT portfolio_id, round(sum(local_value), 2) AS total, round(sum(CASE WHEN kind = 'market' THEN local_value END), 2) AS market, round(sum(CASE WHEN kind = 'bond' THEN local_value END), 2) AS bonds, round(sum(local_pnl), 2) AS pnl,
string_agg(CASE WHEN failed THEN name END, ',' ORDER BY name) AS failed, round(avg(CASE WHEN failed THEN 0.0 ELSE 1.0 END), 2) AS coverage, round(sum(modified * local_value) / sum(CASE WHEN kind = 'bond' THEN local_value END), 2) AS duration,
round(sum(modified * local_value) * 1e-4, 2) AS dv01, round(sum(modified * local_value) / sum(local_value), 2) AS contribution FROM valued GROUP BY 1""",
        "q_valuation_json": local + f""", rows AS (SELECT portfolio_id, name, failed, '{{"name":"' || name || '","kind":"' || kind || '","currency":"' || currency || '","value":"' || {money('value')} || '","local_value":"' || {money('local_value')} || '","local_pnl":' || coalesce('"' || {money('local_pnl')} || '"', 'null') || '}}' AS j FROM market)
SELECT portfolio_id, '{{"portfolio_id":"' || portfolio_id || '","valuation":[' || string_agg(j, ',' ORDER BY name) || '],"failed_assets":["' || string_agg(CASE WHEN failed THEN name END, '","' ORDER BY name) || '"]}}' AS document FROM rows GROUP BY 1""",
        "q_accepted": f"WITH {positions}, p AS (SELECT portfolio_id, CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'quantity' WHEN cost < 0 THEN 'cost' WHEN count(*) OVER (PARTITION BY portfolio_id) > 50 THEN 'count' END AS problem FROM pos) SELECT portfolio_id, problem, count(*) AS n FROM p GROUP BY 1, 2",
        "q_value_series": values + " SELECT portfolio_id, d, round(value, 4) AS value FROM vs",
        "q_period_stats": values + f""", cal AS (SELECT portfolio_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM vs GROUP BY 1), daily AS (SELECT portfolio_id, d, last_value(value IGNORE NULLS) OVER (PARTITION BY portfolio_id ORDER BY d) AS value FROM cal LEFT JOIN vs USING (portfolio_id, d)),
moves AS (SELECT * FROM ({moves}) WHERE ret IS NOT NULL), ends AS (SELECT *, arg_max(ret, d) OVER p AS cur, max(d) OVER p AS e FROM moves WINDOW p AS (PARTITION BY portfolio_id, period)),
st AS (SELECT portfolio_id, period, max(step) AS step, max(cur) AS ret, count(*) FILTER (d < e) AS k, avg((ret < cur)::INT) FILTER (d < e) AS below FROM ends GROUP BY 1, 2),
dl AS (SELECT portfolio_id, ln(value / lag(value) OVER (PARTITION BY portfolio_id ORDER BY d)) AS r, row_number() OVER (PARTITION BY portfolio_id ORDER BY d DESC) AS back FROM vs),
vr AS (SELECT portfolio_id, count(*) AS m, count(r) AS n, quantile_cont(r, 0.010000000000000009) AS now, {then(1)} AS t1, {then(5)} AS t5, {then(21)} AS t21, {then(252)} AS t252 FROM dl GROUP BY 1)
SELECT portfolio_id, period, round(ret, 6) AS ret, CASE WHEN k >= 20 THEN round(below * 100, 6) END AS percentile, CASE WHEN n >= 60 THEN round(now, 6) END AS var_now,
CASE WHEN n > step + 60 THEN round(CASE step WHEN 1 THEN t1 WHEN 5 THEN t5 WHEN 21 THEN t21 ELSE t252 END, 6) END AS var_prev FROM st JOIN vr USING (portfolio_id) WHERE m > step + 2""",
        "q_observations": f"WITH {index} SELECT 'index' AS series, CAST(date_trunc('month', d) AS DATE) AS d, round(v, 6) AS v FROM idx",
        "q_latest_rates": f"WITH {index} SELECT 'deposit' AS series, max(d) AS as_of, round(arg_max(v, d) / 100, 6) AS gross, round(arg_max(v, d) / 100 * 0.85::DOUBLE, 6) AS net FROM dep",
        "q_rate_history": f"WITH {history} SELECT 'deposit' AS series, d, round(rate, 6) AS rate FROM rh",
        "q_sharpe_series": C.BASE.rstrip() + f""", {history}, hz AS (SELECT s.portfolio_id, h AS horizon, s.i, s.r, ln(1 + rate) / 252 AS rf FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY i DESC) AS back FROM series) s JOIN (SELECT unnest([252, 756, 1260]) AS h) ON back <= h LEFT JOIN rh USING (d)),
cr AS (SELECT portfolio_id, horizon, r, last_value(rf IGNORE NULLS) OVER (PARTITION BY portfolio_id, horizon ORDER BY i) AS rf FROM hz), ag AS (SELECT portfolio_id, horizon, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, avg(rf) AS f FROM cr WHERE rf IS NOT NULL GROUP BY 1, 2),
ok AS (SELECT * FROM ag WHERE n >= CASE WHEN horizon <= 252 THEN 60 ELSE floor(horizon * 0.6) END AND s > 0)
SELECT portfolio_id, horizon::BIGINT AS horizon, round((m - f) * 252 / (s * sqrt(252)), 6) AS sharpe, round(m * 252, 6) AS ann_return, round(s * sqrt(252), 6) AS ann_vol, round(f * 252, 6) AS ann_rf, n AS observations FROM (SELECT DISTINCT portfolio_id, horizon FROM hz) LEFT JOIN ok USING (portfolio_id, horizon)""",
        "q_factor_betas": C.BASE.rstrip() + panel + f" SELECT key, lag::BIGINT AS lag, n, round(r2, 6) AS r2, unnest(['{FACTORS[0]}', '{FACTORS[1]}']) AS factor, round(unnest([b1, b2]), 6) AS beta FROM {best('ols')} WHERE k = 1",
        "q_factor_shocks": C.BASE.rstrip() + panel + f""", pb AS (SELECT portfolio_id, sum(w * b1) AS b1, sum(w * b2) AS b2 FROM weights JOIN ols ON asset = key WHERE lag = 0 GROUP BY 1), totals AS (SELECT portfolio_id, sum(value) AS value FROM weights GROUP BY 1), shocks(scenario, factor, shock) AS (VALUES {listed}),
sc AS (SELECT scenario, sum(CASE WHEN factor = '{FACTORS[0]}' THEN shock ELSE 0 END) AS s1, sum(CASE WHEN factor = '{FACTORS[1]}' THEN shock ELSE 0 END) AS s2 FROM shocks GROUP BY 1)
SELECT portfolio_id, scenario, round(0.0 + b1 * s1 + b2 * s2, 4) AS change, round(0.0 + (b1 * s1 + b2 * s2) * value, 4) AS impact, round(0.0 + b1 * s1 + b2 * s2 - 0.4::DOUBLE * s1, 4) AS change_real FROM pb JOIN totals USING (portfolio_id) CROSS JOIN sc""",
        "q_style": C.BASE.rstrip() + panel + f""", sw AS (SELECT key, lag, greatest(0.0, least(1.0, sum((x1 - x2) * (y - x2)) / sum((x1 - x2) * (x1 - x2)))) AS w FROM yx GROUP BY 1, 2 HAVING count(*) >= 120),
sr AS (SELECT key, lag, max(w) AS w, count(*) AS n, 1 - sum(pow(y - w * x1 - (1 - w) * x2, 2)) / (var_pop(y) * count(*)) AS r2, stddev_pop(y - w * x1 - (1 - w) * x2) * sqrt(252) AS te, avg(y - w * x1 - (1 - w) * x2) * 252 AS al FROM yx JOIN sw USING (key, lag) GROUP BY 1, 2)
SELECT key, lag::BIGINT AS lag, n, round(r2, 6) AS r2, round(te, 6) AS tracking_error, round(al, 6) AS alpha, round(al / te, 6) AS information_ratio, unnest(['{FACTORS[0]}', '{FACTORS[1]}']) AS factor, round(unnest([w, 1 - w]), 6) AS weight FROM {best('sr')} WHERE k = 1""",
        "q_style_panel": f"""WITH {quotes}, {history}, mv AS (SELECT asset AS factor, d, ln(px / lag(px) OVER (PARTITION BY asset ORDER BY d)) AS f FROM quotes), ok AS (SELECT d FROM mv WHERE f IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT factor) FROM mv WHERE f IS NOT NULL)),
cash AS (SELECT 'cash' AS factor, d, ln(1 + last_value(rate IGNORE NULLS) OVER (ORDER BY d)) / 252 AS f FROM ok LEFT JOIN rh USING (d))
SELECT factor, d, round(f, 6) AS f FROM mv JOIN ok USING (d) WHERE f IS NOT NULL UNION ALL SELECT factor, d, round(f, 6) FROM cash WHERE f IS NOT NULL""",
        "q_concentration": lw + pairs + """, pq AS (SELECT sqrt((an * an + ar * ar + nr * nr) / 3) AS p, an * ar * nr AS t FROM one), ei AS (SELECT p, acos(greatest(-1, least(1, t / (p * p * p)))) / 3 AS u FROM pq), ee AS (SELECT 1 + 2 * p * cos(u) AS e1, 1 + 2 * p * cos(u + 2 * pi() / 3) AS e3 FROM ei),
bets AS (SELECT exp(-(e1 / 3 * ln(e1 / 3) + (3 - e1 - e3) / 3 * ln((3 - e1 - e3) / 3) + e3 / 3 * ln(e3 / 3))) AS eb FROM ee),
vl AS (SELECT portfolio_id, sqrt(sum(p.w * q.w * cov)) AS vol FROM cov JOIN weights p USING (portfolio_id) JOIN weights q USING (portfolio_id) WHERE p.asset = cov.a AND q.asset = cov.b GROUP BY 1),
al AS (SELECT portfolio_id, count(*) AS n_assets, sum(w * w) AS h, sum(w * sqrt(c)) AS v FROM weights JOIN cv ON a = asset AND b = asset GROUP BY 1)
SELECT portfolio_id, n_assets, round(h, 6) AS hhi, round(1 / h, 6) AS effective_positions, round(v / vol, 6) AS diversification_ratio, round(eb, 6) AS effective_bets FROM al JOIN vl USING (portfolio_id) CROSS JOIN bets""",
        "q_hrp": C.BASE.rstrip() + pairs + """, near AS (SELECT *, CASE WHEN an >= ar AND an >= nr THEN ['A', 'N', 'R'] WHEN ar >= nr THEN ['A', 'R', 'N'] ELSE ['A', 'N', 'R'] END AS leaves FROM one),
leaf AS (SELECT leaves, MAP {'A': va, 'N': vn, 'R': vr} AS v, MAP {'AN': can, 'NA': can, 'AR': car, 'RA': car, 'NR': cnr, 'RN': cnr} AS c FROM near),
halves AS (SELECT leaves, v[leaves[1]] AS v1, v[leaves[2]] AS v2, v[leaves[3]] AS v3, c[leaves[2] || leaves[3]] AS c FROM leaf),
inverse AS (SELECT *, v3 / (v2 + v3) AS i2, v2 / (v2 + v3) AS i3 FROM halves), second AS (SELECT *, i2 * i2 * v2 + i3 * i3 * v3 + 2 * i2 * i3 * c AS vc FROM inverse), split AS (SELECT *, 1 - v1 / (v1 + vc) AS s FROM second),
res AS (SELECT unnest(leaves) AS asset, unnest([s, (1 - s) * i2, (1 - s) * i3]) AS weight, least(v1, v2, v3) AS low FROM split), own AS (SELECT a AS asset, sqrt(c * 252) < 0.05 AS cash FROM cv WHERE a = b)
SELECT portfolio_id, asset, CASE WHEN sqrt(low * 252) >= 0.05 THEN round(weight, 6) END AS weight, cash AS cash_like FROM weights JOIN res USING (asset) JOIN own USING (asset)""",
        "q_corr_matrix": C.BASE + " SELECT p.asset AS a, q.asset AS b, CASE WHEN p.asset = q.asset THEN 1.0 ELSE round_even(corr(p.r, q.r), 4) END AS rho FROM returns p JOIN returns q USING (d) GROUP BY 1, 2, p.asset = q.asset",
        "q_ewma_var": C.BASE.rstrip() + C.EWMA.rstrip() + f""" SELECT portfolio_id, CASE WHEN count(*) >= 120 THEN round({z!r}::DOUBLE * sqrt(0.94 * pow(max_by(sigma, i), 2) + 0.06 * pow(max_by(r, i), 2)), 8) END AS var_ewma,
CASE WHEN count(*) >= 120 THEN round({-normal.pdf(z) / (1 - 0.99)!r}::DOUBLE * sqrt(0.94 * pow(max_by(sigma, i), 2) + 0.06 * pow(max_by(r, i), 2)), 8) END AS es_ewma FROM ewma GROUP BY 1""",
        "q_lvar": C.BASE.rstrip() + """, adv AS (SELECT asset, avg(v) AS adv FROM daily WHERE v > 0 GROUP BY 1 HAVING count(*) >= 10), t AS (SELECT portfolio_id, sum(w * sqrt(CASE asset WHEN 'A' THEN 2.0::DOUBLE WHEN 'R' THEN greatest(1.0::DOUBLE, coalesce(value / (0.25::DOUBLE * adv * last), 1.0)) ELSE 1.0 END)) AS k FROM weights LEFT JOIN adv USING (asset) JOIN last_px USING (asset) GROUP BY 1)
SELECT portfolio_id, round(k, 6) AS multiplier, round(var, 6) AS var, round(var * k, 6) AS lvar FROM t JOIN hv USING (portfolio_id)""",
        "q_tail_pairs": C.BASE.rstrip() + """, cut AS (SELECT asset, quantile_cont(r, 0.05) AS cut, count(*) AS n FROM returns GROUP BY 1), mk AS (SELECT asset, d, r, n, r <= cut AS low FROM returns JOIN cut USING (asset) WHERE n >= 300),
pr AS (SELECT p.asset AS a, q.asset AS b, count(*) FILTER (p.low AND q.low) AS co_exceedances, corr(p.r, q.r) AS pearson, max(p.n) AS n FROM mk p JOIN mk q ON p.d = q.d AND p.asset < q.asset GROUP BY 1, 2)
SELECT a, b, co_exceedances, round(co_exceedances / (0.05::DOUBLE * n), 6) AS tail_lambda, round(pearson, 6) AS pearson, floor(0.05::DOUBLE * n)::BIGINT AS tail_obs, round_even(0.05::DOUBLE * floor(0.05::DOUBLE * n), 1) AS expected_co FROM pr ORDER BY tail_lambda DESC, a, b LIMIT 5""",
        "q_merged_prices": """WITH rows AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq, o_totalprice::DOUBLE AS px, o_orderstatus AS s FROM orders WHERE o_totalprice >= 1000), a AS (SELECT * FROM rows WHERE asset IN ('1-URGENT', '3-MEDIUM') AND s = 'O'),
u AS (SELECT asset, d, seq, px FROM a UNION ALL SELECT asset, d, seq, px FROM rows WHERE asset NOT IN (SELECT asset FROM a)) SELECT asset, d, round(arg_max(px, seq), 2) AS px FROM u GROUP BY 1, 2""",
        "q_adv_recent": C.BASE + " SELECT asset, count(*) AS days, round(avg(v), 6) AS adv FROM daily WHERE v > 0 AND d > (SELECT max(d) FROM daily) - 90 GROUP BY 1 HAVING count(*) >= 10",
        "q_search": "SELECT c_name AS name, c_mktsegment AS category FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(c_name), 'customer#0000') AND c_name NOT IN (SELECT c_name FROM customer WHERE c_acctbal < 0) ORDER BY name LIMIT 60",
        "q_recipients": """SELECT c_custkey AS user_id, c_custkey AS portfolio_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'u' || c_custkey END AS shown FROM customer WHERE c_acctbal > 0 AND c_nationkey % 2 = 1
AND (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 20000) OR c_custkey IN (SELECT s_suppkey FROM supplier))""",
    }
