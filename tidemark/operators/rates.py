"""Interest: observations of statistical documents, deposit rates after tax, and Sharpe ratios against a series of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf
from tidemark.operators.panel import daily_fill

#: Fixed value: the tax withheld from interest on deposits.
WITHHELD = 0.15


def observations(documents: DataFrame, field: str, day: str = "Tarih") -> DataFrame:
    """series, d, v of documents(series, doc): the items' values, by day. Unreadable documents, days and values give no row.

    Days may be written dd-MM-yyyy, yyyy-MM (its first day) or yyyy-MM-dd, else with the day first and / . or - between; null, empty and 'null' values are left out."""
    items = F.explode(F.from_json("doc", "items array<map<string,string>>")["items"]).alias("m")
    rows = documents.select("series", items).select("series", F.trim(F.col("m")[day]).alias("t"), F.trim(F.col("m")[field]).alias("v"))
    forms = ("dd-MM-yyyy", "yyyy-M", "yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "d MMM yyyy", "yyyy/M/d", "yyyy-M-d")
    at = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in forms]).cast("date")
    return rows.where("v IS NOT NULL AND v NOT IN ('', 'null')").select("series", at.alias("d"), F.expr("try_cast(v AS double)").alias("v")).where("d IS NOT NULL AND v IS NOT NULL")


def latest_rates(rates: DataFrame) -> DataFrame:
    """series, as_of, gross, net: the last rate of each series, given in percent, as a share and after tax."""
    gross = F.max_by("v", "d") / 100
    return rates.groupBy("series").agg(F.max("d").alias("as_of"), gross.alias("gross"), (gross * (1 - WITHHELD)).alias("net"))


def rate_history(rates: DataFrame, taxed: bool = True) -> DataFrame:
    """series, d, rate: annual rates of each calendar day, carried on between observations, after tax if `taxed`."""
    return daily_fill(rates, ["series"], "v").select("series", "d", (F.col("v") / 100 * ((1 - WITHHELD) if taxed else 1.0)).alias("rate"))


def daily_rate(annual: Column) -> Column:
    """The log return of a day that a constant annual rate gives; what is below -99 % counts as that, null stays null."""
    return F.log(1 + F.when(annual.isNotNull(), F.greatest(annual, F.lit(-0.99)))) / 252


#: Kinds of a constant annual rate; every other kind names a currency.
CONSTANT_KINDS = ("rate", "deposit", "tlref")


def with_benchmark(series: DataFrame, choices: DataFrame, foreign: DataFrame, asof: bool = False) -> DataFrame:
    """series with kind, rate and quote: what each portfolio is compared with by its row in choices(portfolio_id, kind, annual).

    rate: the daily log return of a constant annual rate, for CONSTANT_KINDS. quote: the log change of the chosen currency on this
    day, from foreign(kind, d, px); null on days without one, which are filled where they are used, along the portfolio's own days.
    asof: a day takes the latest change at or before it, so that changes on days that the portfolio doesn't have aren't lost.
    Without a choice, or with an unknown kind or a null rate, both stay null."""
    w = Window.partitionBy("kind").orderBy("d")
    moved = foreign.where("px > 0").select("kind", "d", F.log(F.col("px") / F.lag("px").over(w)).alias("quote")).where("quote IS NOT NULL")
    if asof:
        end = moved.select("kind").distinct().join(F.broadcast(series.agg(F.max("d").alias("d")))).select("kind", "d", F.lit(None).cast("double").alias("quote"))  # one row
        moved = daily_fill(moved.unionByName(end).groupBy("kind", "d").agg(F.max("quote").alias("quote")), ["kind"], "quote")
    chosen = choices.select("portfolio_id", "kind", F.when(F.col("kind").isin(*CONSTANT_KINDS), daily_rate(F.col("annual"))).alias("rate"))
    return series.join(chosen, "portfolio_id", "left").join(moved, ["kind", "d"], "left").select("portfolio_id", "i", "d", "r", "kind", "rate", "quote")


def _carried(own: list[str]) -> Column:
    """The benchmark's return of a day: the constant one, or the last quote within the rows at hand."""
    return F.coalesce("rate", F.last("quote", True).over(Window.partitionBy(*own).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))


def sharpe_by_choice(rows: DataFrame, windows: tuple[int, ...] = (252, 756, 1260)) -> DataFrame:
    """portfolio_id, horizon, kind, sharpe, ann_return, ann_vol, ann_rf, observations of rows with a benchmark (see with_benchmark).

    A currency's changes are carried on along the window's days; days before the first don't count. A window needs 60 rows, or six
    tenths of itself if it is over a year; else, and without a benchmark, its figures are null."""
    back = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("i")))
    fits = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= F.col("back"))
    own = ["portfolio_id", "horizon"]
    each = rows.withColumn("back", back).where(F.col("back") <= max(windows)).withColumn("horizon", F.explode(fits)).withColumn("rf", _carried(own))
    kept = F.when(F.col("rf").isNotNull(), F.col("r"))
    m = each.groupBy(*own, "kind").agg(F.count(kept).alias("n"), F.avg(kept).alias("m"), F.stddev_samp(kept).alias("s"), F.avg("rf").alias("f"))
    least = F.when(F.col("horizon") <= 252, 60).otherwise(F.floor(F.col("horizon") * 0.6))
    ok = (F.col("n") >= least) & (F.col("s") > 0)
    vol = F.col("s") * F.sqrt(F.lit(252.0))
    found = (("sharpe", (F.col("m") - F.col("f")) * 252 / vol), ("ann_return", F.col("m") * 252), ("ann_vol", vol), ("ann_rf", F.col("f") * 252), ("observations", F.col("n")))
    return m.select(*own, "kind", *[F.when(ok, c).alias(k) for k, c in found])


def confidence_by_choice(rows: DataFrame, fallback: float | None = None, window: int = 252, least: int = 120) -> DataFrame:
    """portfolio_id, n, sharpe, se, low, high, psr, skew, excess_kurtosis: the uncertainty of the Sharpe ratio against the same benchmark.

    Of the last `window` rows, `least` or more, those count whose benchmark is known; without a choice the annual rate `fallback`
    is taken, or none. Returns without variance give nulls."""
    own = ["portfolio_id"]
    last = rows.withColumn("back", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("i")))).where(F.col("back") <= window)
    none = F.when(F.col("kind").isNull(), daily_rate(F.lit(fallback).cast("double")) if fallback is not None else F.lit(0.0))
    x = F.col("r") - F.coalesce(_carried(own), none)
    m = last.withColumn("x", x).groupBy(*own).agg(F.count("*").alias("rows"), F.count("x").alias("n"), F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"), F.skewness("x").alias("g3"), F.kurtosis("x").alias("g4"))
    m = m.withColumn("sr", F.when((F.col("rows") >= least) & (F.col("sd") > 0), F.try_divide("mu", "sd")))
    year, sr = F.sqrt(F.lit(252.0)), F.col("sr")
    se = F.sqrt((1 + 0.5 * sr**2) / F.col("n")) * year
    z = sr * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(1 - F.col("g3") * sr + (F.col("g4") + 2) / 4 * sr**2, F.lit(1e-9)))
    ok = lambda c: F.when(sr.isNotNull(), c)
    found = (("n", F.col("n")), ("sharpe", sr * year), ("se", se), ("low", sr * year - 1.96 * se), ("high", sr * year + 1.96 * se), ("psr", norm_cdf(z)), ("skew", F.col("g3")), ("excess_kurtosis", F.col("g4")))
    return m.select(*own, *[ok(c).alias(k) for k, c in found])


def sharpe_over_series(series: DataFrame, rf: DataFrame, windows: tuple[int, ...] = (252, 756, 1260)) -> DataFrame:
    """portfolio_id, horizon, sharpe, ann_return, ann_vol, ann_rf, observations against rf(d, rf), daily log returns, one row a day.

    A window's rates are carried on along its own days; rates of other days are lost, and days before the first rate don't count.
    A window needs 60 rows, or six tenths of itself if it is over a year, before and after; else its figures are null."""
    back = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("i")))
    fits = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= F.col("back"))
    rows = series.withColumn("back", back).where(F.col("back") <= max(windows)).join(rf, "d", "left").select("portfolio_id", "i", "r", "rf", F.explode(fits).alias("horizon"))
    own = ["portfolio_id", "horizon"]
    carried = rows.withColumn("rf", F.last("rf", True).over(Window.partitionBy(*own).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("rf").isNotNull(), F.col("r"))
    m = carried.groupBy(*own).agg(F.count("*").alias("all"), F.count(kept).alias("n"), F.avg(kept).alias("m"), F.stddev_samp(kept).alias("s"), F.avg("rf").alias("f"))
    least = F.when(F.col("horizon") <= 252, 60).otherwise(F.floor(F.col("horizon") * 0.6))
    ok = (F.col("n") >= least) & (F.col("s") > 0)
    vol = F.col("s") * F.sqrt(F.lit(252.0))
    found = (("sharpe", (F.col("m") - F.col("f")) * 252 / vol), ("ann_return", F.col("m") * 252), ("ann_vol", vol), ("ann_rf", F.col("f") * 252), ("observations", F.col("n")))
    return m.select(*own, *[F.when(ok, c).alias(k) for k, c in found])
