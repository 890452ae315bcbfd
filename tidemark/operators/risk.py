"""Risk statistics of portfolio return series, a row for each portfolio; too little data gives nulls, never a lost row."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf
from tidemark.operators.panel import gated

#: The volatility bounds of the risk classes; the decay of the volatility and the rows that it starts from.
BANDS = [0.005, 0.02, 0.05, 0.10, 0.15, 0.25]
LAMBDA, SEED_ROWS = 0.94, 30
#: Rows of a block of the volatility's recursion, the seed's among the first.
BLOCK = 128


def historical_var(series: DataFrame, key: str | list[str] = "portfolio_id", confidence: float = 0.99) -> DataFrame:
    """The quantile of returns at 1 - confidence, interpolated linearly, and the number of returns."""
    return series.groupBy(*([key] if isinstance(key, str) else key)).agg(F.count("r").alias("n"), F.percentile("r", 1 - confidence).alias("var"))


def expected_shortfall(series: DataFrame, confidence: float = 0.99, least: int = 60) -> DataFrame:
    """The mean of the returns at or below the quantile."""
    q = historical_var(series, confidence=confidence)
    tail = series.join(q, "portfolio_id").groupBy("portfolio_id", "n", "var").agg(F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("es"))
    return tail.select("portfolio_id", "n", gated(F.col("n"), least, F.col("var")).alias("var"), gated(F.col("n"), least, F.col("es")).alias("es"))


def diversification(returns: DataFrame, weights: DataFrame, series: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Sum of the positions' own VaR against the portfolio's, in money."""
    keys = by_set(returns, "asset")
    own = historical_var(returns, keys, confidence).select(*keys, "var")
    alone = weights.join(own, keys).groupBy("portfolio_id").agg(F.sum(F.col("value") * F.col("var")).alias("sum_var"), F.sum("value").alias("total"))
    both = alone.join(historical_var(series, confidence=confidence), "portfolio_id")
    port = F.col("var") * F.col("total")
    return both.select("portfolio_id", "sum_var", port.alias("portfolio_var"), (F.abs("sum_var") - F.abs(port)).alias("benefit"))


def by_set(df: DataFrame, *keys: str) -> list[str]:
    """The keys, with the set of assets before them where df has one (see panel.asset_sets)."""
    return [*(["set_id"] if "set_id" in df.columns else []), *keys]


def upper_pairs(returns: DataFrame) -> GroupedData:
    """Rows x and y of the same day, and set, by their assets a before b: only assets of one set meet, so rows don't grow with the square of the universe."""
    keys = by_set(returns)
    same = " AND ".join(f"x.{k} = y.{k}" for k in [*keys, "d"])
    pairs = returns.alias("x").join(returns.alias("y"), F.expr(f"{same} AND x.asset < y.asset"))
    return pairs.groupBy(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.asset").alias("a"), F.col("y.asset").alias("b"))


def correlations(returns: DataFrame) -> DataFrame:
    """a, b, n, rho, cov of every pair of assets, or of every pair in a set with a set_id, a first in order."""
    return upper_pairs(returns).agg(F.count("*").alias("n"), F.corr("x.r", "y.r").alias("rho"), F.covar_samp("x.r", "y.r").alias("cov"))


def sharpe(series: DataFrame, rf_daily: float = 0.0, windows: tuple[int, ...] = (252, 756, 1260)) -> DataFrame:
    """Annualised Sharpe ratio over the last rows of each window; a window needs 60 rows, or six tenths of itself if it is over a year."""
    last = series.withColumn("back", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("i"))))
    out = []
    for w in windows:
        r = F.when(F.col("back") <= w, F.col("r") - rf_daily)
        out += [F.count(r).alias(f"n_{w}"), F.avg(r).alias(f"m_{w}"), F.stddev_samp(r).alias(f"s_{w}")]
    stats = last.groupBy("portfolio_id").agg(*out)
    ratio = lambda w: F.when((F.col(f"n_{w}") >= (60 if w <= 252 else int(0.6 * w))) & (F.col(f"s_{w}") > 0), F.col(f"m_{w}") * 252 / (F.col(f"s_{w}") * F.sqrt(F.lit(252.0)))).alias(f"sharpe_{w}")
    return stats.select("portfolio_id", *[x for w in windows for x in (F.col(f"n_{w}"), ratio(w))])


def sharpe_confidence(series: DataFrame, rf_daily: float = 0.0, window: int = 252, least: int = 120) -> DataFrame:
    """Sharpe ratio with the standard error, interval and probability of being positive that skewness and kurtosis imply."""
    last = series.withColumn("back", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("i")))).where(F.col("back") <= window)
    x = F.col("r") - rf_daily
    m = last.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("g3"), (F.kurtosis(x) + 3).alias("g4"))
    m = m.withColumn("sr", F.when((F.col("n") >= least) & (F.col("sd") > 0), F.try_divide("mu", "sd")))
    se = F.sqrt((1 + 0.5 * F.col("sr") ** 2) / F.col("n"))
    z = F.col("sr") * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") ** 2, F.lit(1e-9)))
    year = F.sqrt(F.lit(252.0))
    return m.select("portfolio_id", "n", (F.col("sr") * year).alias("sharpe"), ((F.col("sr") - 1.96 * se) * year).alias("low"), ((F.col("sr") + 1.96 * se) * year).alias("high"), norm_cdf(z).alias("psr"))


def drawdown(series: DataFrame, least: int = 120) -> DataFrame:
    """Deepest fall from the running peak, its root mean square, Calmar ratio, and the longest and present run below the peak."""
    p = Window.partitionBy("portfolio_id").orderBy("i")
    cum = series.select("portfolio_id", "i", "r", F.exp(F.sum("r").over(p)).alias("c"))
    dd = cum.select("portfolio_id", "i", "r", (F.col("c") / F.max("c").over(p) - 1).alias("dd")).withColumn("island", F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(p))
    runs = dd.groupBy("portfolio_id", "island").agg(F.count_if(F.col("dd") < 0).alias("run"))
    length = runs.groupBy("portfolio_id").agg(F.max("run").alias("longest"), F.max_by("run", "island").alias("now"))
    s = dd.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.min("dd").alias("mdd"), F.sqrt(F.avg(F.col("dd") ** 2)).alias("ulcer"), (F.exp(F.avg("r") * 252) - 1).alias("annual"))
    s = s.join(length, "portfolio_id")
    g = lambda c: gated(F.col("n"), least, c)
    return s.select("portfolio_id", "n", g(F.col("mdd")).alias("max_drawdown"), g(F.col("ulcer")).alias("ulcer"), g(F.when(F.col("mdd") < 0, F.try_divide("annual", F.abs("mdd")))).alias("calmar"), g(F.col("longest")).alias("longest_run"), g(F.col("now")).alias("current_run"))


def ewma_path(series: DataFrame) -> DataFrame:
    """portfolio_id, i, r, sigma: the exponentially weighted volatility known before each return; i counts a portfolio's rows from 0.

    The recursion v' = LAMBDA v + (1 - LAMBDA) r**2 begins with the variance of the first SEED_ROWS. Rows are cut into blocks of BLOCK:
    within one, v is a running sum of squares divided by powers of LAMBDA; from block to block a fold over the portfolio's few block
    sums carries it, so that no power leaves the range of doubles however long a series is."""
    k, block = F.pmod("i", F.lit(BLOCK)), F.floor(F.col("i") / BLOCK)
    rows = series.select("portfolio_id", "i", "r", block.alias("block"), F.pow(F.lit(LAMBDA), k).alias("decay"))
    rows = rows.withColumn("square", (1 - LAMBDA) / LAMBDA * F.col("r") ** 2 / F.col("decay"))
    sums = rows.groupBy("portfolio_id", "block").agg(F.sum("square").alias("s"), F.collect_list(F.when(F.col("i") < SEED_ROWS, F.col("r"))).alias("head"))
    each = sums.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.struct("block", "s"))).alias("blocks"), F.max_by("head", -F.col("block")).alias("head"))
    mean = F.aggregate("head", F.lit(0.0), lambda t, x: t + x) / F.size("head")
    seed = F.aggregate("head", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) ** 2) / F.size("head")
    each = each.withColumn("mean", mean).withColumn("v", F.when(seed > 0, seed).otherwise(1e-8))
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("block"), F.col("v").alias("v")))
    carry = lambda t, x: F.concat(t, F.array(F.struct((x["block"] + 1).alias("block"), (LAMBDA**BLOCK * (F.element_at(t, -1)["v"] + x["s"])).alias("v"))))
    starts = each.select("portfolio_id", F.inline(F.aggregate("blocks", first, carry)))
    before = Window.partitionBy("portfolio_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("before", F.coalesce(F.sum("square").over(before), F.lit(0.0))).join(starts, ["portfolio_id", "block"])
    return own.select("portfolio_id", F.col("i").cast("int").alias("i"), "r", F.sqrt(F.col("decay") * (F.col("v") + F.col("before"))).alias("sigma"))


def next_sigma(path: DataFrame) -> DataFrame:
    """portfolio_id, n, sigma_next: the rows of each path and the volatility that its last row implies for the next day."""
    last = path.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.max_by(F.struct("r", "sigma"), "i").alias("l"))
    return last.select("portfolio_id", "n", F.sqrt(LAMBDA * F.col("l.sigma") ** 2 + (1 - LAMBDA) * F.col("l.r") ** 2).alias("sigma_next"))


def filtered_historical(path: DataFrame, confidence: float = 0.99, least: int = 120) -> DataFrame:
    """Volatility of the next day, and VaR and shortfall from standardised returns scaled by it."""
    today = next_sigma(path).withColumnRenamed("sigma_next", "today")
    z = path.where(F.col("i") >= SEED_ROWS).select("portfolio_id", F.try_divide("r", "sigma").alias("z"))
    q = z.groupBy("portfolio_id").agg(F.percentile("z", 1 - confidence).alias("q"))
    tail = z.join(q, "portfolio_id").groupBy("portfolio_id", "q").agg(F.avg(F.when(F.col("z") <= F.col("q"), F.col("z"))).alias("zm"))
    both = today.join(tail, "portfolio_id", "left")
    g = lambda c: gated(F.col("n"), least, c)
    return both.select("portfolio_id", "n", g(F.col("today")).alias("sigma_today"), g(F.col("q") * F.col("today")).alias("var_fhs"), g(F.col("zm") * F.col("today")).alias("es_fhs"))


def parametric(path: DataFrame, confidence: float = 0.99, least: int = 120) -> DataFrame:
    """portfolio_id, var_ewma, es_ewma: VaR and shortfall of a normal variable with the volatility of the next day."""
    normal, p = NormalDist(), 1 - confidence
    z = normal.inv_cdf(p)
    g = lambda c: gated(F.col("n"), least, c * F.col("sigma_next"))
    return next_sigma(path).select("portfolio_id", g(F.lit(z)).alias("var_ewma"), g(F.lit(-normal.pdf(z) / p)).alias("es_ewma"))


def evt_tail(series: DataFrame, share: float = 0.95, target: float = 0.995, least: int = 500) -> DataFrame:
    """Generalised Pareto tail by probability-weighted moments of the losses over their quantile, with that threshold and how many exceed it."""
    u = series.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.percentile(-F.col("r"), share).alias("u"))
    over = series.join(u, "portfolio_id").where(-F.col("r") > F.col("u")).select("portfolio_id", "n", "u", (-F.col("r") - F.col("u")).alias("y"))
    ranked = over.withColumn("j", F.row_number().over(Window.partitionBy("portfolio_id").orderBy("y"))).withColumn("k", F.count("*").over(Window.partitionBy("portfolio_id")))
    a = ranked.groupBy("portfolio_id", "n", "u", "k").agg(F.avg("y").alias("a0"), F.avg((1 - (F.col("j") - 0.35) / F.col("k")) * F.col("y")).alias("a1"))
    gap = F.col("a0") - 2 * F.col("a1")
    a = a.withColumn("xi", F.when(gap > 0, 2 - F.col("a0") / gap)).withColumn("beta", F.when(gap > 0, 2 * F.col("a0") * F.col("a1") / gap))
    ratio = F.col("n") / F.col("k") * (1 - target)
    var = F.col("u") + F.when(F.abs("xi") > 1e-6, F.col("beta") / F.col("xi") * (F.pow(ratio, -F.col("xi")) - 1)).otherwise(-F.col("beta") * F.log(ratio))
    ok = (F.col("n") >= least) & (F.col("k") >= 30) & (F.col("xi") < 0.95) & (F.col("beta") > 0)
    a = a.withColumn("v", F.when(ok, var))
    es = (F.col("v") + F.col("beta") - F.col("xi") * F.col("u")) / (1 - F.col("xi"))
    return series.select("portfolio_id").distinct().join(a, "portfolio_id", "left").select("portfolio_id", F.when(ok, F.col("xi")).alias("xi"), F.when(ok, F.col("beta")).alias("beta"), (-F.col("v")).alias("var_evt"), (-es).alias("es_evt"), F.when(ok, F.col("u")).alias("threshold"), F.when(ok, F.col("k")).alias("exceedances"))


def tail_dependence(returns: DataFrame, q: float = 0.05) -> DataFrame:
    """a, b, lambda: how often both assets are in their own tails, against the expected size of one."""
    keys = by_set(returns, "asset")
    cut = returns.groupBy(*keys).agg(F.percentile("r", q).alias("cut"), F.count("*").alias("n"))
    low = returns.join(cut, keys).where("r <= cut").select(*keys, "d", "n")
    both = upper_pairs(low).agg(F.count("*").alias("both"), F.max("x.n").alias("n"))
    return both.select(*by_set(returns), "a", "b", "both", (F.col("both") / (q * F.col("n"))).alias("tail_lambda"))


def tail_pairs(returns: DataFrame, q: float = 0.05, least: int = 300, first: int = 5) -> DataFrame:
    """a, b, co_exceedances, tail_lambda, pearson, tail_obs, expected_co: the pairs of assets that fall together most often, none left out.

    With a set_id the first pairs of each set. Pairs with no common tail day count as 0; ties go by name. Fewer than `least` days:
    no rows. Returns are aligned, so a day joins the pairs of its assets once, and sums combine before the shuffle by pair."""
    keys, sets = by_set(returns, "asset"), by_set(returns)
    cut = returns.groupBy(*keys).agg(F.percentile("r", q).alias("cut"), F.count("*").alias("n"))
    marked = returns.join(cut.where(F.col("n") >= least), keys).select(*keys, "d", "r", "n", (F.col("r") <= F.col("cut")).alias("low"))
    m = upper_pairs(marked).agg(F.count_if(F.col("x.low") & F.col("y.low")).alias("both"), F.corr("x.r", "y.r").alias("pearson"), F.max("x.n").alias("n"))
    size = F.col("n") * q
    out = m.select(*sets, "a", "b", F.col("both").alias("co_exceedances"), (F.col("both") / size).alias("tail_lambda"), "pearson", F.floor(size).alias("tail_obs"), F.bround(q * F.floor(size), 1).alias("expected_co"))
    if not sets:
        return out.orderBy(F.desc("tail_lambda"), "a", "b").limit(first)
    place = F.row_number().over(Window.partitionBy(*sets).orderBy(F.desc("tail_lambda"), "a", "b"))
    return out.withColumn("place", place).where(F.col("place") <= first)


def srri(series: DataFrame, least: int = 120) -> DataFrame:
    """Risk class 1 to 7 by the volatility of weekly returns over five years; weeks without trades count as 0.

    Fewer than `least` returns, or than 24 weeks, give no class."""
    weekly = series.groupBy("portfolio_id", F.date_trunc("week", "d").cast("date").alias("week")).agg(F.sum("r").alias("r"))
    span = weekly.groupBy("portfolio_id").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    weeks = span.select("portfolio_id", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week")).join(weekly, ["portfolio_id", "week"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    last = weeks.withColumn("back", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("week")))).where("back <= 260")
    vol = last.groupBy("portfolio_id").agg(F.count("*").alias("weeks"), (F.stddev_samp("r") * F.sqrt(F.lit(52.0))).alias("volatility"))
    band = F.lit(1)
    for k, bound in enumerate(BANDS):
        band = F.when(F.col("volatility") >= bound, k + 2).otherwise(band)
    n = series.groupBy("portfolio_id").agg(F.count("r").alias("days"))
    ok = (F.col("weeks") >= 24) & (F.col("days") >= least)
    return vol.join(n, "portfolio_id").select("portfolio_id", "weeks", F.when(ok, F.col("volatility")).alias("volatility"), F.when(ok, band).alias("srri"))


def concentration(weights: DataFrame) -> DataFrame:
    """Herfindahl index of the weights and its inverse, the effective number of positions."""
    h = weights.groupBy("portfolio_id").agg(F.sum(F.col("w") ** 2).alias("hhi"))
    return h.select("portfolio_id", "hhi", F.try_divide(F.lit(1.0), F.col("hhi")).alias("effective_positions"))


def beta(returns: DataFrame, factor: DataFrame) -> DataFrame:
    """asset, n, beta, r2 of a one-factor regression on factor(d, f), by set where both have a set_id."""
    return returns.join(factor, by_set(factor, "d")).groupBy(*by_set(factor, "asset")).agg(F.count("*").alias("n"), F.regr_slope("r", "f").alias("beta"), F.regr_r2("r", "f").alias("r2"))
