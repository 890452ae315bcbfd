"""Reports of a period: value series of portfolios, the period's return among those before, and VaR now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import clean, daily_fill

#: Rows and calendar days of each period; a day compares rows.
PERIODS = {"daily": (1, None), "weekly": (5, 7), "monthly": (21, 30), "yearly": (252, 365)}


def value_series(prices: DataFrame, holdings: DataFrame) -> DataFrame:
    """portfolio_id, d, value: what the present positions were worth on each day on which one of them trades, from the day all are known.

    prices(asset, d, px) are carried on; positions without any price don't count. Rows grow with the days of each position."""
    held = clean(prices).join(holdings.groupBy("portfolio_id", "asset").agg(F.sum("quantity").alias("quantity")), "asset")
    own = held.select("portfolio_id", "asset", "quantity").distinct()
    grid = held.select("portfolio_id", "d").distinct().join(own, "portfolio_id")
    w = Window.partitionBy("portfolio_id", "asset").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(held.select("portfolio_id", "asset", "d", "px"), ["portfolio_id", "asset", "d"], "left").withColumn("px", F.last("px", True).over(w))
    day = filled.groupBy("portfolio_id", "d").agg(F.count("*").alias("n"), F.count("px").alias("known"), F.sum(F.col("px") * F.col("quantity")).alias("value"))
    return day.where("n = known").select("portfolio_id", "d", "value")


def period_stats(values: DataFrame, least: int = 60, confidence: float = 0.99) -> DataFrame:
    """portfolio_id, period, ret, percentile, var_now, var_prev of value series, a row for each period that the rows suffice for.

    ret: over a row, or over the period's calendar days with values carried on. percentile: how many of the earlier returns are lower, of
    at least 20. VaR: of daily log returns, and of those without the period's last rows; `least` returns are needed."""
    w = Window.partitionBy("portfolio_id").orderBy("d")
    filled = daily_fill(values, ["portfolio_id"], "value")
    rows = values.select("portfolio_id", "d", F.lit("daily").alias("period"), (F.col("value") / F.lag("value").over(w) - 1).alias("ret"))
    longer = [F.struct(F.lit(k).alias("period"), (F.col("value") / F.lag("value", days).over(w) - 1).alias("ret")) for k, (_, days) in PERIODS.items() if days]
    moved = rows.unionByName(filled.select("portfolio_id", "d", F.array(*longer).alias("a")).select("portfolio_id", "d", F.inline("a"))).where("ret IS NOT NULL")
    own = ["portfolio_id", "period"]
    last = moved.groupBy(*own).agg(F.max_by("ret", "d").alias("current"), F.max("d").alias("at"))
    rank = moved.join(last, own).groupBy(*own, "current").agg(F.count_if(F.col("d") < F.col("at")).alias("before"), F.avg(F.when(F.col("d") < F.col("at"), (F.col("ret") < F.col("current")).cast("double"))).alias("below"))
    daily = clean(values.withColumnRenamed("value", "px")).withColumn("r", F.log(F.col("px") / F.lag("px").over(w)))
    daily = daily.withColumn("back", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("d"))))
    p = 1 - confidence
    some = daily.groupBy("portfolio_id").agg(
        F.count("*").alias("rows"), F.count("r").alias("n"), F.percentile("r", p).alias("now"), *[F.percentile(F.when(F.col("back") > n, F.col("r")), p).alias(f"then_{k}") for k, (n, _) in PERIODS.items()]
    )
    each = F.array(*[F.struct(F.lit(k).alias("period"), F.lit(n).alias("step"), F.col(f"then_{k}").alias("then")) for k, (n, _) in PERIODS.items()])
    var = some.select("portfolio_id", "rows", "n", "now", F.inline(each))
    return rank.join(var, own).where("rows > step + 2").select(
        *own, F.col("current").alias("ret"), F.when(F.col("before") >= 20, F.col("below") * 100).alias("percentile"),
        F.when(F.col("n") >= least, F.col("now")).alias("var_now"), F.when((F.col("n") >= least) & (F.col("n") > F.col("step") + least), F.col("then")).alias("var_prev"),
    )


def report_rows(valued: DataFrame, changes: DataFrame, place: str = "place") -> DataFrame:
    """The rows of a report: portfolio_id, place, name, kind, quantity, amount, change, gain, and priced, false where there is no data.

    valued: position_values and bonds with a column that gives their order, and their quantity (a bond's is its nominal). amount is in
    the local currency; change is the period's (changes(name, change)), gain the profit as a share of the cost; bonds have neither."""
    rows = valued.join(changes.select("name", "change"), "name", "left")
    market = F.col("kind") != "bond"
    return rows.select(
        "portfolio_id", F.col(place).alias("place"), "name", "kind", "quantity", F.col("local_value").alias("amount"), F.when(market & ~F.col("failed"), F.col("change")).alias("change"),
        F.when(market, F.col("pnl_pct") / 100).alias("gain"), (~F.col("failed")).alias("priced"),
    )


def report_totals(rows: DataFrame) -> DataFrame:
    """portfolio_id, total, bonds, market, n_priced of report rows; a portfolio with neither a priced position nor the value of a bond has no report and no row."""
    bond = F.col("kind") == "bond"
    zero = F.lit(0.0)
    sums = rows.groupBy("portfolio_id").agg(
        F.coalesce(F.sum("amount"), zero).alias("total"), F.coalesce(F.sum(F.when(bond, F.col("amount"))), zero).alias("bonds"), F.count_if(~bond & F.col("priced")).alias("n_priced")
    )
    return sums.where("n_priced > 0 OR bonds > 0").select("portfolio_id", "total", "bonds", (F.col("total") - F.col("bonds")).alias("market"), "n_priced")


def search(universe: DataFrame, taken: DataFrame, text: str, categories: list[str], first: int = 60) -> DataFrame:
    """The first instruments(name, category) by name whose category is asked for, that hold the text in any case, and aren't taken(name)."""
    fit = universe.where(F.col("category").isin(categories) & F.contains(F.lower("name"), F.lit(text.lower())))
    return fit.join(taken.select("name").distinct(), "name", "left_anti").orderBy("name").limit(first)


def recipients(users: DataFrame, positions: DataFrame, bonds: DataFrame, option: str) -> DataFrame:
    """Verified users who want the report and hold a position or a bond; the name shown is the nickname, else the address before the @."""
    holding = positions.select("portfolio_id").unionByName(bonds.select("portfolio_id"))
    shown = F.coalesce(F.nullif(F.trim("nickname"), F.lit("")), F.substring_index("email", "@", 1))
    return users.where(F.col("verified") & F.col(option)).join(holding, "portfolio_id", "left_semi").select("user_id", "portfolio_id", shown.alias("shown"))
