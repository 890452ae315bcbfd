"""Exposures of portfolios: currency, liquidity, shocks to factors, odds against a deposit, and value paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf
from tidemark.operators.panel import clean, gated

#: Share of a day's volume that can be sold, days to redeem a fund, most points of a path.
SOLD_SHARE, FUND_DAYS, MOST_POINTS = 0.25, 2.0, 300


def log_change(series: DataFrame, value: str = "px") -> DataFrame:
    """d, f: log change of a single series from row to row. One series, so a window without keys: a row a day."""
    w = Window.orderBy("d")
    return series.select("d", F.log(F.col(value) / F.lag(value).over(w)).alias("f")).where("f IS NOT NULL")


def looked_through(weights: DataFrame, styles: DataFrame, factor: str) -> DataFrame:
    """portfolio_id, indirect: what funds add to a portfolio's exposure to a factor: the fund's share by its style weight (see factors.style).

    styles(key, factor, weight): weights below 0 count as 0, funds without a style or that a portfolio doesn't hold add nothing."""
    own = styles.where(F.col("factor") == factor).select(F.col("key").alias("asset"), F.greatest(F.col("weight"), F.lit(0.0)).alias("part"))
    return weights.join(own, "asset").groupBy("portfolio_id").agg(F.sum(F.col("w") * F.col("part")).alias("indirect"))


def currency_split(series: DataFrame, weights: DataFrame, fx: DataFrame, direct: list[str], indirect: DataFrame | None = None, least: int = 120) -> DataFrame:
    """Variance of portfolio returns split into local, currency and covariance shares, with the currency's volatility and drift.

    The exposure is the weight of the assets named plus what a portfolio's funds hold, indirect(portfolio_id, indirect), at most 1.
    Days without an fx return (d, f) don't count; fewer than `least`, or no variance of either, give nulls."""
    named = weights.groupBy("portfolio_id").agg(F.coalesce(F.sum(F.when(F.col("asset").isin(direct), F.col("w"))), F.lit(0.0)).alias("exposure"))
    if indirect is not None:
        more = F.greatest(F.coalesce("indirect", F.lit(0.0)), F.lit(0.0))
        named = named.join(indirect, "portfolio_id", "left").select("portfolio_id", (F.col("exposure") + more).alias("exposure"))
    held = named.select("portfolio_id", F.least(F.lit(1.0), F.col("exposure")).alias("exposure"))
    days = series.join(fx, "d").join(held, "portfolio_id")
    part = F.col("exposure") * F.col("f")
    v = days.groupBy("portfolio_id", "exposure").agg(
        F.count("*").alias("n"), F.var_samp("r").alias("vp"), F.var_samp(F.col("r") - part).alias("vl"), F.var_samp(part).alias("vf"), F.var_samp("f").alias("vx"), F.avg("f").alias("m")
    )
    ok = lambda c: F.when((F.col("n") >= least) & (F.col("vp") > 0) & (F.col("vx") > 0), c)
    share = lambda c: ok(F.try_divide(c, F.col("vp")))
    rows = held.select("portfolio_id").join(v, "portfolio_id", "left")
    return rows.select(
        "portfolio_id", ok(F.col("exposure")).alias("exposure"), share(F.col("vl")).alias("local_share"), share(F.col("vf")).alias("fx_share"),
        share(F.col("vp") - F.col("vl") - F.col("vf")).alias("cov_share"), ok(F.sqrt(F.col("vx") * 252)).alias("fx_vol"), ok(F.col("m") * 252).alias("fx_drift"),
    )


def liquidity(positions: DataFrame) -> DataFrame:
    """Days to leave each position and the portfolio's multiplier of VaR, from positions(portfolio_id, asset, value, adv, kind).

    A fund takes two days; an equity its value over a quarter of the daily volume, a day at least; all else, or an equity
    without volume, a day. Portfolios without value get null shares and multiplier."""
    slow = (F.col("kind") == "equity") & (F.coalesce("adv", F.lit(0.0)) > 0)
    days = F.when(F.col("kind") == "fund", FUND_DAYS).when(slow, F.greatest(F.lit(1.0), F.try_divide("value", F.col("adv") * SOLD_SHARE))).otherwise(1.0)
    own = Window.partitionBy("portfolio_id")
    total = F.sum("value").over(own)
    each = positions.select("portfolio_id", "asset", "value", days.alias("days"), F.when(total > 0, F.col("value") / total).alias("value_share"))
    return each.select("portfolio_id", "asset", F.bround("days", 1).alias("days_to_exit"), "value_share", F.sum(F.col("value_share") * F.sqrt("days")).over(own).alias("lvar_multiplier"))


def factor_betas(series: DataFrame, factors: DataFrame) -> DataFrame:
    """portfolio_id, factor, beta of each portfolio on each factor(factor, d, f) alone."""
    return series.join(factors, "d").groupBy("portfolio_id", "factor").agg(F.regr_slope("r", "f").alias("beta"))


def shock_grid(betas: DataFrame, values: DataFrame, shocks: list[tuple[str, str, float]]) -> DataFrame:
    """portfolio_id, scenario, change, impact: sum of beta times shock, and in money; a factor without beta counts as 0.

    shocks, (scenario, factor, shock), is a parameter and stands in the plan: each portfolio's row is exploded by it."""
    listed = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(f).alias("factor"), F.lit(x).alias("shock")) for s, f, x in shocks])
    asked = values.select("portfolio_id", "value", F.inline(listed))
    moved = asked.join(betas, ["portfolio_id", "factor"], "left").groupBy("portfolio_id", "scenario", "value").agg(F.sum(F.coalesce("beta", F.lit(0.0)) * F.col("shock")).alias("change"))
    return moved.select("portfolio_id", "scenario", "change", (F.col("change") * F.col("value")).alias("impact"))


def scenario_table(spark: SparkSession, scenarios: list[tuple[str, str, str, str]]) -> DataFrame:
    """scenario, start, end, region from rows (name, first day, last day, region)."""
    rows = spark.createDataFrame(scenarios, "scenario string, start string, end string, region string")
    return rows.select("scenario", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "region")


def in_scenarios(prices: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario, asset, d, px of the prices inside each of scenarios(scenario, start, end), both days included.

    Scenarios are exploded to their months and meet the prices by month, then by the exact days; so the join has a key, and a
    thousand scenarios are a table, not a plan. A scenario that ends before it starts has no month."""
    months = F.when(F.col("start") <= F.col("end"), F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month")))
    asked = scenarios.select("scenario", "start", "end", F.explode(months).alias("month"))
    return prices.withColumn("month", F.trunc("d", "month")).join(asked, "month").where(F.col("d").between(F.col("start"), F.col("end"))).select("scenario", "asset", "d", "px")


def stress(prices: DataFrame, weights: DataFrame, scenarios: DataFrame | list[tuple[str, str, str, str]], regions: list[str] | None = None) -> DataFrame:
    """What each portfolio's present positions returned in each of scenarios(scenario, start, end, region), of the named regions alone if any are.

    scenario, region, portfolio_id, n_days, cumulative_return, impact, missing, coverage, missing_assets. Returns are those between
    neighbours on the raw calendar of the scenario, on days when all of the portfolio's assets that trade in it have one; the weights
    are those of these assets alone. missing is the value of the others, coverage the share of the rest in the portfolio's value. A
    scenario without data stays, with a null return, everything missing and no coverage. Days are settled for each set of assets
    (see panel.asset_sets), and as a sum over days and assets may be taken in either order, a portfolio meets one row an asset."""
    if not isinstance(scenarios, DataFrame):
        scenarios = scenario_table(prices.sparkSession, scenarios)
    if regions:
        scenarios = scenarios.where(F.col("region").isin(regions))
    held = weights if "set_id" in weights.columns else weights.withColumn("set_id", F.col("portfolio_id"))
    inside = in_scenarios(prices, scenarios)
    days = inside.select("scenario", "d").distinct().withColumn("k", F.row_number().over(Window.partitionBy("scenario").orderBy("d")))
    w = Window.partitionBy("scenario", "asset").orderBy("d")
    ranked = clean(inside).join(days, ["scenario", "d"]).withColumns({"before": F.lag("px").over(w), "k0": F.lag("k").over(w)})
    moved = ranked.where("k0 = k - 1").select("scenario", "asset", "d", F.log(F.col("px") / F.col("before")).alias("r"))
    own = ["scenario", "set_id"]
    active = clean(inside).select("scenario", "asset").distinct().join(held.select("set_id", "asset").distinct(), "asset")
    size = active.groupBy(*own).agg(F.count("*").alias("assets"))
    daily = moved.join(active, ["scenario", "asset"]).withColumn("n", F.count("*").over(Window.partitionBy(*own, "d")))
    sums = daily.join(size, own).where("n = assets").groupBy(*own, "asset").agg(F.count("*").alias("n_days"), F.sum("r").alias("r"))
    present = active.join(sums, [*own, "asset"], "left")
    total = held.groupBy("portfolio_id").agg(F.sum("value").alias("value"), F.array_sort(F.collect_list("asset")).alias("assets"))
    found = held.join(present, ["set_id", "asset"]).groupBy("portfolio_id", "scenario").agg(
        F.sum("value").alias("held"), F.sum(F.col("value") * F.col("r")).alias("r"), F.max("n_days").alias("n_days"), F.collect_list("asset").alias("present")
    )
    each = F.collect_list(F.struct("scenario", "region")).alias("each")
    asked = total.join(F.broadcast(scenarios.agg(each))).select("portfolio_id", "value", "assets", F.inline("each"))  # one row, as long as the scenarios
    cum = F.expm1(F.when(F.col("held") > 0, F.col("r") / F.col("held")))
    rows = asked.join(found, ["portfolio_id", "scenario"], "left").withColumn("held", F.when(cum.isNotNull(), F.col("held")))
    missing = F.array_except("assets", F.when(F.col("held").isNotNull(), F.col("present")).otherwise(F.array().cast("array<string>")))
    return rows.select(
        "scenario", "region", "portfolio_id", F.coalesce("n_days", F.lit(0).cast("long")).alias("n_days"), cum.alias("cumulative_return"), (F.col("held") * cum).alias("impact"),
        (F.col("value") - F.coalesce("held", F.lit(0.0))).alias("missing"), F.try_divide(F.coalesce("held", F.lit(0.0)), F.col("value")).alias("coverage"), missing.alias("missing_assets"),
    )


def beat_deposit(series: DataFrame, annual: float | DataFrame | None, horizon: int = 252, least: int = 120) -> DataFrame:
    """Odds of ending below a deposit's rate after the horizon, plain and widened by the Sharpe ratio's own error; null without a rate.

    annual: one rate for all, or annual(portfolio_id, annual) with each portfolio's own."""
    m = series.groupBy("portfolio_id").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    m = m.join(annual, "portfolio_id", "left") if isinstance(annual, DataFrame) else m.withColumn("annual", F.lit(annual).cast("double"))
    rate = F.log(1 + F.greatest(F.col("annual"), F.lit(-0.99))) / 252  # of a null rate nothing is made below
    m = m.withColumn("sr", F.when(F.col("annual").isNotNull() & (F.col("sd") > 0), F.try_divide(F.col("mean") - rate, F.col("sd"))))
    point = F.col("sr") * F.sqrt(F.lit(float(horizon)))
    error = (1 + 0.5 * F.col("sr") ** 2) / F.col("n") * float(horizon)
    g = lambda c: gated(F.col("n"), least, c)
    return m.select("portfolio_id", "n", g(norm_cdf(-point / F.sqrt(1 + error))).alias("below"), g(norm_cdf(-point)).alias("below_point"))


def value_path(series: DataFrame, values: DataFrame, repeat_last: bool = False) -> DataFrame:
    """portfolio_id, point, d, value: the start value, then its growth by the returns; beyond 300 points every so many and the last.

    The start is point 0 and has no date; the last point stands alone where thinning has already kept it, or twice with repeat_last."""
    w = Window.partitionBy("portfolio_id").orderBy("i")
    grown = series.join(values.select("portfolio_id", "value"), "portfolio_id").select("portfolio_id", (F.col("i") + 1).alias("point"), "d", (F.col("value") * F.exp(F.sum("r").over(w))).alias("value"))
    whole = values.select("portfolio_id", F.lit(0).alias("point"), F.lit(None).cast("date").alias("d"), "value").unionAll(grown)
    counted = whole.withColumn("n", F.count("*").over(Window.partitionBy("portfolio_id")))
    step = F.when(F.col("n") > MOST_POINTS, F.floor(F.col("n") / MOST_POINTS) + 1).otherwise(1)
    last = F.col("point") == F.col("n") - 1
    kept = counted.where((F.col("point") % step == 0) | last)
    if repeat_last:
        twice = last & (F.col("n") > MOST_POINTS) & (F.col("point") % step == 0)
        kept = kept.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))))
    return kept.select("portfolio_id", "point", "d", "value")
