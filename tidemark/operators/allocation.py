"""What positions add to a portfolio's risk: shrunk covariance and attribution; returns after inflation; the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf
from tidemark.operators.risk import by_set

TINY = 1e-12
#: The weights of the score's components.
SCORE_WEIGHTS = {"sharpe": 35, "diversification": 20, "tail": 15, "model": 10, "real": 10, "drawdown": 10}


def pair_moments(returns: DataFrame) -> DataFrame:
    """a, b, n, s, q, c of every ordered pair of assets, each with itself too: the means of xy, x2y2 and x3y of centred returns.

    With a set_id only the assets of a set meet, once for all portfolios that hold it: the rows joined grow with the days and the
    squares of the sets, not with the square of all assets, and are summed before the shuffle."""
    keys = by_set(returns)
    x = returns.join(returns.groupBy(*keys, "asset").agg(F.avg("r").alias("m")), [*keys, "asset"]).select(*keys, "asset", "d", (F.col("r") - F.col("m")).alias("x"))
    p, q = F.col("p.x"), F.col("q.x")
    same = " AND ".join(f"p.{k} = q.{k}" for k in [*keys, "d"])
    pairs = x.alias("p").join(x.alias("q"), F.expr(same)).groupBy(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.asset").alias("a"), F.col("q.asset").alias("b"))
    return pairs.agg(F.count("*").alias("n"), F.avg(p * q).alias("s"), F.avg(p * p * q * q).alias("q"), F.avg(p * p * p * q).alias("c"))


def shrunk_covariance(moments: DataFrame, weights: DataFrame, textbook: bool = False) -> DataFrame:
    """portfolio_id, a, b, n, shrinkage, cov: covariance of each portfolio's assets, drawn towards one common correlation.

    The target's correlation and the shrinkage follow from the portfolio's own assets. The term for the target's own
    error takes the weight 1 / sd(a), or sd(b) / sd(a) with `textbook`. One asset: its variance, no shrinkage."""
    keys = by_set(moments)
    held = weights.select("portfolio_id", *keys, "asset")
    own = moments.join(held.withColumnRenamed("asset", "a"), [*keys, "a"]).join(held.withColumnRenamed("asset", "b"), [*keys, "portfolio_id", "b"])
    var = moments.where("a = b").select(*keys, F.col("a").alias("asset"), F.sqrt("s").alias("sd"))
    own = own.join(var.select(*keys, F.col("asset").alias("a"), F.col("sd").alias("sa")), [*keys, "a"]).join(var.select(*keys, F.col("asset").alias("b"), F.col("sd").alias("sb")), [*keys, "b"])
    size = F.when(F.col("sa") * F.col("sb") == 0, TINY).otherwise(F.col("sa") * F.col("sb"))
    off, noise = F.col("a") != F.col("b"), F.col("q") - F.col("s") ** 2
    lean = (F.col("c") - F.col("sa") ** 2 * F.col("s")) * F.col("sb") / F.when(F.lit(textbook), F.col("sa")).otherwise(F.col("sa") * (F.col("sb") + TINY))
    own = own.withColumn("size", size).withColumn("off", off)
    sums = own.groupBy("portfolio_id").agg(
        F.avg(F.when(off, F.col("s") / F.col("size"))).alias("rbar"), F.sum(noise).alias("pi"), F.sum(F.when(~off, noise)).alias("rho"), F.sum(F.when(off, lean)).alias("lean")
    )
    both = own.join(sums, "portfolio_id").withColumn("target", F.when(F.col("off"), F.col("rbar") * F.col("size")).otherwise(F.col("s")))
    gaps = both.groupBy("portfolio_id", "pi", "rho", "lean", "rbar", "n").agg(F.sum((F.col("target") - F.col("s")) ** 2).alias("gap"))
    kappa = (F.col("pi") - F.col("rho") - F.col("rbar") * F.col("lean")) / F.col("gap") / F.col("n")
    shrinkage = gaps.select("portfolio_id", F.when(F.col("gap") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), kappa))).otherwise(0.0).alias("shrinkage"))
    drawn = F.col("s") + F.when(F.col("off"), F.col("shrinkage") * (F.col("target") - F.col("s"))).otherwise(0.0)
    return both.join(shrinkage, "portfolio_id").select("portfolio_id", "a", "b", "n", "shrinkage", drawn.alias("cov"))


def attribution(cov: DataFrame, weights: DataFrame, var: DataFrame, least: int = 60) -> DataFrame:
    """portfolio_id, asset, weight, component, share, incremental: what each position adds to VaR in money, and what selling it changes.

    var: portfolio_id, var as a share of the value. The components sum to the VaR; a sold position becomes cash and the
    others stay. Fewer than two assets, fewer than `least` days, or no variance give nulls."""
    value = weights.select("portfolio_id", F.col("asset").alias("a"), F.col("value").alias("va"))
    pairs = cov.join(value.withColumnRenamed("a", "b").withColumnRenamed("va", "vb"), ["portfolio_id", "b"])
    row = pairs.groupBy("portfolio_id", "a").agg(F.min("n").alias("n"), F.sum(F.col("cov") * F.col("vb")).alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("cov"))).alias("own"))
    each = value.join(row, ["portfolio_id", "a"], "left").join(var.select("portfolio_id", "var"), "portfolio_id", "left")
    p = Window.partitionBy("portfolio_id")
    each = each.withColumn("total", F.sum("va").over(p)).withColumn("v", F.sum(F.col("va") * F.col("m")).over(p)).withColumn("assets", F.count("m").over(p))
    ok = (F.col("assets") >= 2) & (F.col("n") >= least) & (F.col("total") > 0) & (F.col("v") > 0)
    money = F.abs("var") * F.col("total")
    share = F.try_divide(F.col("va") * F.col("m"), F.col("v"))
    rest = F.greatest(F.lit(0.0), F.col("v") - 2 * F.col("va") * F.col("m") + F.col("va") ** 2 * F.col("own"))
    change = money * (F.sqrt(F.try_divide(rest, F.col("v"))) - 1)
    return each.select("portfolio_id", F.col("a").alias("asset"), *[F.when(ok, c).alias(n) for n, c in (("weight", F.try_divide("va", "total")), ("component", share * money), ("share", F.when(money != 0, share)), ("incremental", change))])


def real_returns(series: DataFrame, cpi: DataFrame, least: int = 120) -> DataFrame:
    """portfolio_id, n, inflation, nominal, real, prob_loss, aligned: returns over the twelve months of the index cpi(d, v), and after inflation.

    Where fewer than 60 returns lie in those months the last 252 count instead and `aligned` is false. prob_loss: the
    odds of a year below inflation, by the last 504 returns. Fewer than `least` returns, or 13 months, give nulls.
    The index is one series with a row a month, so it is gathered into one row and broadcast."""
    months = cpi.where("v IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("c"))
    at = lambda k: F.try_element_at("c", F.lit(-k))
    year = months.select(F.lit(1).alias("one"), at(13)["d"].alias("a"), at(1)["d"].alias("b"), F.when(F.size("c") >= 13, at(1)["v"] / at(13)["v"] - 1).alias("inflation"))
    back = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("i")))
    rows = series.withColumn("one", F.lit(1)).withColumn("back", back).join(F.broadcast(year), "one")
    inside = (F.col("d") > F.col("a")) & (F.col("d") <= F.col("b"))
    last = F.when(F.col("back") <= 504, F.col("r"))
    m = rows.groupBy("portfolio_id", "inflation").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("k"), F.sum(F.when(inside, F.col("r"))).alias("within"), F.sum(F.when(F.col("back") <= 252, F.col("r"))).alias("latest"),
        (F.avg(last) * 252).alias("mu"), (F.stddev_samp(last) * F.sqrt(F.lit(252.0))).alias("sigma"),
    )
    aligned = F.col("k") >= 60
    nominal = F.exp(F.when(aligned, F.col("within")).otherwise(F.col("latest"))) - 1
    loss = norm_cdf(F.when(F.col("sigma") > 0, (F.log(1 + F.col("inflation")) - F.col("mu")) / F.col("sigma")))
    ok = (F.col("n") >= least) & F.col("inflation").isNotNull()
    found = (("inflation", F.col("inflation")), ("nominal", nominal), ("real", (1 + nominal) / (1 + F.col("inflation")) - 1), ("prob_loss", loss), ("aligned", aligned))
    return m.select("portfolio_id", "n", *[F.when(ok, c).alias(k) for k, c in found])


def composite_score(parts: DataFrame) -> DataFrame:
    """portfolio_id, the six components and score, each 0 to 100, from parts with any of these columns null or absent:

    sharpe (its lower bound), effective_bets and n_assets, tail_ratio (shortfall over VaR), zone, prob_loss,
    max_drawdown with expected_drawdown, calmar. The weights of missing components pass to the others; none: null."""
    c = lambda name, kind="double": F.col(name) if name in parts.columns else F.lit(None).cast(kind)
    clamp = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))
    assets = F.when(c("n_assets", "long") >= 2, F.least(c("n_assets", "long"), F.lit(5)))
    ratio = F.when((c("expected_drawdown") < 0) & (c("max_drawdown") < 0), c("max_drawdown") / c("expected_drawdown"))
    fallen = F.coalesce(85 - 40 * ratio, F.when(c("max_drawdown").isNotNull(), c("calmar") / 2 * 100))
    zone = c("zone", "string")
    made: dict[str, Column] = {
        "sharpe": clamp(50 + 50 * c("sharpe")),
        "diversification": clamp(F.try_divide(c("effective_bets") - 1, assets - 1) * 100),
        "tail": clamp(F.when(c("tail_ratio") > 0, (1.8 - c("tail_ratio")) / 0.8 * 100)),
        "model": F.when(zone == "green", 100.0).when(zone == "yellow", 50.0).when(zone == "red", 0.0),
        "real": clamp((0.6 - c("prob_loss")) / 0.6 * 100),
        "drawdown": clamp(fallen),
    }
    rows = parts.select("portfolio_id", *[x.cast("double").alias(k) for k, x in made.items()])
    total = sum(F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in SCORE_WEIGHTS.items())
    weight = sum(F.when(F.col(k).isNotNull(), w).otherwise(0) for k, w in SCORE_WEIGHTS.items())
    return rows.select("portfolio_id", *[F.bround(k, 1).alias(k) for k in made], F.bround(F.try_divide(total, weight), 1).alias("score"))
