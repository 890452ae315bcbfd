"""Positions in one currency: price routes, filled exchange rates, values with profit and loss, totals and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import clean

#: Grams of a troy ounce; most positions and bonds of a stored portfolio.
OUNCE, MOST_POSITIONS, MOST_BONDS = 31.1034768, 50, 10


def filled_rate(quotes: DataFrame, ticker: str) -> DataFrame:
    """d, rate: the last price of the ticker on each day on which anything is quoted, from its own first day on.

    The window has no key: it runs over one row a day, made by an aggregate."""
    days = quotes.groupBy("d").agg(F.max(F.when((F.col("asset") == ticker) & (F.col("px") > 0), F.col("px"))).alias("x"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("d", F.last("x", True).over(w).alias("rate")).where("rate IS NOT NULL")


def rate_now(quotes: DataFrame, ticker: str, required: bool = False) -> DataFrame:
    """rate_now: one row, null without any price of the ticker; with `required` the query fails then, as nothing foreign can be valued."""
    last = F.max_by("px", "d")
    missing = F.raise_error(F.lit(f"no rate of exchange: {ticker} has no price")).cast("double")
    return quotes.where((F.col("asset") == ticker) & (F.col("px") > 0)).agg((F.coalesce(last, missing) if required else last).alias("rate_now"))


#: What tells instruments apart, whatever portfolios call them.
INSTRUMENT = ("ticker", "currency", "source")


def local_prices(quotes: DataFrame, instruments: DataFrame, fx: str, gold: str, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """keys, d, px, native of instruments(keys, ticker, currency, source): px in the local currency, native as quoted.

    With keys=INSTRUMENT an instrument is priced once, however many portfolios hold it and whatever they call it.

    Foreign quotes are multiplied by the filled rate; the source `gram` takes the gold ounce times the rate by the gram; a fund's
    price stays. Days before the first rate give no price to what needs one. Instruments without any quote have no row."""
    ticker = F.when(F.col("source") == "gram", F.lit(gold)).otherwise(F.col("ticker")).alias("asset")
    given = list(dict.fromkeys([*keys, "currency", "source"]))
    routed = clean(quotes).join(instruments.select(*given, ticker).distinct(), "asset").join(filled_rate(quotes, fx), "d", "left")
    gram = F.col("px") * F.col("rate") / OUNCE
    local = F.when(F.col("source") == "gram", gram).when((F.col("source") != "fund") & (F.col("currency") == "USD"), F.col("px") * F.col("rate")).otherwise(F.col("px"))
    native = F.when(F.col("source") == "gram", gram).otherwise(F.col("px"))
    return routed.select(*keys, "d", local.alias("px"), native.alias("native"))


def position_values(positions: DataFrame, last: DataFrame | None, now: DataFrame, keys: tuple[str, ...] = ("name",), carried: tuple[str, ...] = ()) -> DataFrame:
    """Positions(portfolio_id, name, kind, currency, quantity, cost) at last(keys, last), in their own and the local currency.

    Without last the positions bear their own price in a column of that name. Names belong to their portfolio: where two use one name
    for different things, keys has to tell them apart (INSTRUMENT, or portfolio_id and name).

    failed: no price, so all values are null. Without a positive cost the profit is unknown (null), not zero. now is one row."""
    rows = (positions if last is None else positions.join(last, list(keys), "left")).join(F.broadcast(now))  # one row
    fx = F.when(F.col("currency") == "USD", F.col("rate_now")).otherwise(1.0)
    paid = F.when(F.col("cost") > 0, F.col("quantity") * F.col("cost"))
    value = F.col("quantity") * F.col("last")
    gain = value - paid
    return rows.select(
        "portfolio_id", "name", "kind", "currency", F.col("last").isNull().alias("failed"), value.alias("value"), F.when(value.isNotNull(), paid).alias("cost_total"), gain.alias("pnl"),
        F.try_divide(gain * 100, paid).alias("pnl_pct"), (value * fx).alias("local_value"), (gain * fx).alias("local_pnl"), *carried,
    )


def with_bonds(market: DataFrame, bonds: DataFrame, now: DataFrame) -> DataFrame:
    """The market rows and, with their durations, those of measured bonds(portfolio_id, name, currency, nominal, price, cost, ...)."""
    held = bonds.withColumn("quantity", F.col("nominal") / 100).withColumn("kind", F.lit("bond"))
    measures = ("fair", "macaulay", "modified", "ytm")
    rows = position_values(held.select("portfolio_id", "name", "kind", "currency", "quantity", "cost", F.col("price").alias("last"), *measures), None, now, carried=measures)
    return market.unionByName(rows, allowMissingColumns=True)


def totals(valued: DataFrame) -> DataFrame:
    """portfolio_id, total, market, bonds, pnl, failed names (sorted, comma-joined), coverage, durations of valued rows.

    pnl is null where no row has one. coverage: the share of names that have a price. duration: of the bonds by value; contribution: as
    a share of everything. A portfolio's failed names are bounded by its positions."""
    bond = F.col("kind") == "bond"
    amount = F.sum(F.when(bond, F.col("local_value")))
    weighted = F.sum(F.when(bond, F.col("modified") * F.col("local_value")))
    return valued.groupBy("portfolio_id").agg(
        F.sum("local_value").alias("total"), F.sum(F.when(~bond, F.col("local_value"))).alias("market"), amount.alias("bonds"), F.sum("local_pnl").alias("pnl"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("name")))), ",").alias("failed"), F.avg((~F.col("failed")).cast("double")).alias("coverage"),
        F.try_divide(weighted, amount).alias("duration"), (weighted * 1e-4).alias("dv01"), F.try_divide(weighted, F.sum("local_value")).alias("contribution"),
    )


def documents(market: DataFrame) -> DataFrame:
    """portfolio_id, document: the market rows of a portfolio as one canonical JSON text, by name; amounts are decimal strings.

    A stored portfolio has at most MOST_POSITIONS positions, which bounds a row; `accepted` is what to call before."""
    money = lambda c: F.round(c, 2).cast("decimal(30,2)").cast("string").alias(c)
    row = F.struct("name", "kind", "currency", money("value"), money("local_value"), money("local_pnl"))
    rows = market.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.when(~F.col("failed"), row))).alias("valuation"), F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("name")))).alias("failed_assets"))
    return rows.select("portfolio_id", F.to_json(F.struct("portfolio_id", "valuation", "failed_assets"), {"ignoreNullFields": "false"}).alias("document"))


#: Rules of positions and bonds, (name, condition that a row fails), for `problems`; a null fails a rule that asks for a value.
POSITION_RULES = (
    ("quantity", "coalesce(quantity <= 0, true)"), ("currency", "coalesce(currency NOT IN ('TRY', 'USD'), true)"), ("source", "coalesce(source NOT IN ('yahoo', 'tefas'), true)"),
    ("name", "coalesce(length(trim(name)) = 0, true)"), ("count", f"portfolio_rows > {MOST_POSITIONS}"),
)
BOND_RULES = (
    ("nominal", "coalesce(nominal <= 0, true)"), ("price", "coalesce(price <= 0, true)"), ("coupon", "coalesce(coupon < 0, true)"), ("years", "coalesce(years <= 0, true)"), ("ytm", "coalesce(ytm <= 0, true)"),
    ("frequency", "coalesce(frequency < 1, true)"), ("count", f"portfolio_rows > {MOST_BONDS}"),
)
REQUEST_RULES = (
    ("confidence", "confidence <= 0.5 OR confidence >= 1"), ("rate", "annual < 0 OR annual > 3"), ("kind", "kind IS NOT NULL AND kind NOT IN ('rate', 'deposit', 'tlref', 'usd', 'eur')"),
    ("dates", "start >= end"), ("future", "end > today"), ("empty", "positions + bonds = 0"),
)


def problems(rows: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """rows with `problems`: the names of all rules that a row fails, in the rules' order; empty for what may be stored or run.

    A rule is an SQL condition over the row's columns and portfolio_rows, the rows of its portfolio. Nothing is dropped."""
    counted = rows.withColumn("portfolio_rows", F.count("*").over(Window.partitionBy("portfolio_id"))) if "portfolio_id" in rows.columns else rows
    found = F.array(*[F.when(F.expr(f"coalesce({condition}, false)"), F.lit(name)) for name, condition in rules])
    return counted.withColumn("problems", F.array_compact(found)).drop("portfolio_rows")


def tidied(positions: DataFrame) -> DataFrame:
    """What a form's rows become before they are asked for problems: rows without a positive quantity go, a cost that isn't positive is unknown."""
    return positions.where("quantity > 0").withColumn("cost", F.when(F.col("cost") > 0, F.col("cost")))


def equity_tickers(positions: DataFrame, gold: str) -> DataFrame:
    """ticker: the distinct quoted tickers that have a volume: not gold by the gram, no currency (=) and no coin (-)."""
    quoted = positions.where((F.col("source") == "yahoo") & (F.col("ticker") != gold))
    return quoted.where(~F.contains("ticker", F.lit("=")) & ~F.contains("ticker", F.lit("-"))).select("ticker").distinct()


def accepted(positions: DataFrame) -> DataFrame:
    """positions with `problem`: null for what may be stored, else why not: quantity, cost or count (over MOST_POSITIONS in the portfolio).

    Nothing is dropped: who stores takes the rows without a problem, who reports the others."""
    n = F.count("*").over(Window.partitionBy("portfolio_id"))
    bad = F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity").when(F.col("cost") < 0, "cost").when(n > MOST_POSITIONS, "count")
    return positions.withColumn("problem", bad)
