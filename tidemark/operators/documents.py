"""Documents of portfolios: blocks of figures put together as one JSON text for each portfolio."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import locale
from tidemark.functions.stats import compensated_sum
from tidemark.operators import backtest, exposure, panel, rates, risk
from tidemark.operators.book import Book, attribution, diversification

#: Digits of numbers in documents.
DIGITS = 6


#: Digits of amounts of money, whose columns are named in MONEY.
CENTS = 2
MONEY = {"value", "var_value", "sum_var", "portfolio_var", "benefit", "impact", "component", "incremental", "base_value", "final_value"}


def _plain(df: DataFrame, columns: list[str], digits: int, money: int = CENTS) -> list[Column]:
    """The columns, fractions as decimals of so many digits, amounts of `money`, so that a number has one spelling."""
    kinds = dict(df.dtypes)
    places = {c: money if c in MONEY else digits for c in columns}
    return [F.round(c, places[c]).cast(f"decimal(38,{places[c]})").alias(c) if kinds[c] == "double" else F.col(c) for c in columns]


def single(name: str, df: DataFrame, *columns: str, digits: int = DIGITS, money: int = CENTS) -> DataFrame:
    """portfolio_id, block, body: a block of the named columns, null where the first of them is."""
    body = F.when(F.col(columns[0]).isNotNull(), F.to_json(F.struct(*_plain(df, list(columns), digits, money)), {"ignoreNullFields": "false"}))
    return df.select("portfolio_id", F.lit(name).alias("block"), body.alias("body"))


def listed(name: str, df: DataFrame, order: list[Column], *columns: str, digits: int = DIGITS, money: int = CENTS) -> DataFrame:
    """portfolio_id, block, body: a block of the named columns of all of a portfolio's rows, sorted by `order`, ties by the columns themselves.

    Descending keys are given negated; a null key sorts first, so nulls-last is F.col(x).isNull() before it. A portfolio's rows meet
    in one array: they are bounded by its positions, pairs or scenarios."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*_plain(df, list(columns), digits, money)).alias("row"))))
    body = F.to_json(F.transform(rows, lambda x: x["row"]), {"ignoreNullFields": "false"})
    return df.groupBy("portfolio_id").agg(body.alias("body")).select("portfolio_id", F.lit(name).alias("block"), "body")


def document(portfolios: DataFrame, blocks: list[DataFrame], names: list[str]) -> DataFrame:
    """portfolio_id, document: the named blocks of each of portfolios(portfolio_id), in this order, null where a portfolio has none.

    The blocks' rows are united and meet once, by portfolio; a block that failed for a portfolio, or has no row, leaves null and
    nothing else is lost."""
    every = reduce(DataFrame.unionAll, [b.select("portfolio_id", "block", "body") for b in blocks])
    maps = every.where("body IS NOT NULL").groupBy("portfolio_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "body"))).alias("m"))
    parts = [x for n in names for x in (F.lit(f',"{n}":'), F.coalesce(F.try_element_at("m", F.lit(n)), F.lit("null")))]
    head = F.concat(F.lit('{"portfolio_id":'), F.expr("substring(to_json(array(portfolio_id)), 2, length(to_json(array(portfolio_id))) - 2)"))
    return portfolios.select("portfolio_id").distinct().join(maps, "portfolio_id", "left").select("portfolio_id", F.concat(head, *parts, F.lit("}")).alias("document"))


#: The blocks of an analysis, in their order.
ANALYSIS = ["risk", "sharpe", "sharpe_ci", "beat_deposit", "correlation", "diversification", "stress_tests", "attribution", "drawdown", "tail", "tail_dependence", "vol_regime", "liquidity", "risk_class"]


def analysis(book: Book, benchmarked: DataFrame, scenarios: DataFrame, exits: DataFrame, deposit: float | DataFrame | None = None, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """portfolio_id, document: the market risk of each portfolio of a book as one JSON text, all on the headline VaR.

    benchmarked: its series with rates.with_benchmark; exits: exposure.liquidity; deposit: as in exposure.beat_deposit. Components are
    sorted by what they add to the VaR, scenarios by impact (the worst first, those without data last), exits by days (the longest
    first). more: further blocks by name (portfolio_id, block, body), of single or listed. Portfolios of priced positions without a
    single joint return keep a document of nulls."""
    f, s = book.figures, book.series
    of = book.weights.select("portfolio_id", "set_id").distinct()
    pairs = risk.correlations(book.returns).join(of, "set_id").withColumn("rho", F.bround("rho", 4))
    tails = risk.tail_pairs(book.returns).join(of, "set_id")
    tests = exposure.stress(book.prices, book.weights, scenarios)
    parts = attribution(book).where("component IS NOT NULL")
    blocks = [
        single("risk", f, "n", "value", "var", "var_value", "var_historical", "es", "es_975", "model", "zone", "kupiec_p", "var_ewma", "var_fhs", "es_ewma", "es_fhs"),
        listed("sharpe", rates.sharpe_by_choice(benchmarked).where("sharpe IS NOT NULL"), [F.col("horizon")], "horizon", "kind", "sharpe", "ann_return", "ann_vol", "ann_rf", "observations"),
        single("sharpe_ci", rates.confidence_by_choice(benchmarked), "sharpe", "se", "low", "high", "psr", "n"),
        single("beat_deposit", exposure.beat_deposit(s, deposit), "below", "below_point"),
        listed("correlation", pairs, [F.col("a"), F.col("b")], "a", "b", "rho", digits=4),
        single("diversification", diversification(book), "sum_var", "portfolio_var", "benefit", digits=4),
        listed("stress_tests", tests, [F.col("impact").isNull(), F.round("impact", 2), F.col("scenario")], "scenario", "region", "cumulative_return", "impact", "coverage", "missing_assets", digits=4),
        listed("attribution", parts, [-F.round("component", 4), F.col("asset")], "asset", "weight", "component", "share", "incremental", digits=4),
        single("drawdown", risk.drawdown(s), "max_drawdown", "ulcer", "calmar", "longest_run", "current_run"),
        single("tail", risk.evt_tail(s), "xi", "beta", "var_evt", "es_evt", "threshold", "exceedances"),
        listed("tail_dependence", tails, [F.col("place")], "a", "b", "co_exceedances", "tail_lambda", "pearson"),
        single("vol_regime", backtest.vol_regime(book.path), "current_vol", "percentile", "median_vol", "observations"),
        listed("liquidity", exits, [-F.col("days_to_exit"), F.col("asset")], "asset", "days_to_exit", "value_share"),
        single("risk_class", risk.srri(s), "srri", "volatility", "weeks"),
        *(more or {}).values(),
    ]
    return document(book.weights, blocks, [*ANALYSIS, *(more or {})])


def report(rows: DataFrame, totals: DataFrame, stats: DataFrame, lang: str = "tr") -> DataFrame:
    """portfolio_id, document: a period's report: rows in the order of the positions, totals, statistics, and what the reader may sort by.

    rows and totals of reports.report_rows and report_totals, stats of one period of reports.period_stats. Amounts and shares are
    written as people of the language write them; allocation is by descending amount, gains by descending profit without those
    that have none, both with ties by place. A portfolio without totals has no report."""
    language = F.lit(lang)
    shown = rows.select(
        "*", locale.money(F.col("amount"), language).alias("value"), locale.percent(F.col("change"), language).alias("moved"), locale.percent(F.col("gain"), language).alias("result"),
        F.try_divide("amount", F.sum("amount").over(Window.partitionBy("portfolio_id"))).alias("share"),
    )
    total = totals.select("portfolio_id", locale.money(F.col("total"), language).alias("total"), locale.money(F.col("bonds"), language).alias("bonds"), "n_priced")
    figures = stats.select("portfolio_id", *[locale.percent(F.col(c), language).alias(c) for c in ("ret", "var_now", "var_prev")], F.bround("percentile", 0).cast("int").alias("percentile"))
    place = F.col("place")
    blocks = [
        single("totals", total, "total", "bonds", "n_priced"),
        single("statistics", figures, "ret", "percentile", "var_now", "var_prev"),
        listed("rows", shown, [place], "name", "kind", "quantity", "value", "moved", "result", "priced"),
        listed("allocation", shown.where("amount IS NOT NULL"), [-F.col("amount"), place], "name", "share"),
        listed("gains", shown.where("gain IS NOT NULL"), [-F.col("gain"), place], "name", "result"),
    ]
    return document(totals, blocks, ["totals", "statistics", "rows", "allocation", "gains"])


def simulation(prices: DataFrame, weights: DataFrame, start: str, end: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, money: int = DIGITS) -> DataFrame:
    """portfolio_id, document: how each portfolio's present positions would have gone between two days, as one JSON text.

    The return is that of exposure.stress over the days, with its assets that are missing; the path is that of the others' present value
    along the days on which all of them trade, its first day before any return, thinned as exposure.value_path does. A portfolio without
    a return between the days has nulls and no path. keep: as for Book, applied to what several blocks read; money: digits of amounts.
    The value at the start is summed in the order of the assets with what rounding loses, so that its cents don't depend on the order of rows."""
    spark = prices.sparkSession
    scenario = exposure.scenario_table(spark, [("range", start, end, "")])
    res = keep(exposure.stress(prices, weights, scenario), "stressed")
    inside = prices.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    covered = res.where("cumulative_return IS NOT NULL").select("portfolio_id", "missing_assets")
    held = weights.select("portfolio_id", "asset", "value").join(covered, "portfolio_id").where("NOT array_contains(missing_assets, asset)").drop("missing_assets")
    of, members = panel.asset_sets(inside, held)
    positions = F.array_sort(F.collect_list(F.struct("asset", "value")).over(Window.partitionBy("portfolio_id")))
    totalled = held.withColumn("total", compensated_sum(F.transform(positions, lambda x: x["value"])))
    own = keep(totalled.withColumn("w", F.col("value") / F.col("total")).join(of, "portfolio_id"), "covered")
    series = panel.portfolio_returns(panel.set_returns(inside, members), own)
    base = own.groupBy("portfolio_id", "set_id").agg(F.max("total").alias("value"))
    size = members.groupBy("set_id").agg(F.count("*").alias("k"))
    first = panel.clean(inside).join(members, "asset").groupBy("set_id", "d").agg(F.count("*").alias("n")).join(size, "set_id").where("n = k").groupBy("set_id").agg(F.min("d").alias("first"))
    path = exposure.value_path(series, base, repeat_last=True).join(base.join(first, "set_id").select("portfolio_id", "first"), "portfolio_id")
    path = keep(path.select("portfolio_id", "point", F.coalesce("d", "first").alias("date"), "value"), "path")
    last = path.groupBy("portfolio_id").agg(F.max_by("value", "point").alias("final_value"))
    figures = res.join(base.select("portfolio_id", F.col("value").alias("base_value")), "portfolio_id", "left").join(last, "portfolio_id", "left")
    figures = figures.withColumns({"start": F.lit(start), "end": F.lit(end)})
    blocks = [
        single("result", figures.where("cumulative_return IS NOT NULL"), "start", "end", "cumulative_return", "impact", "base_value", "final_value", money=money),
        single("missing_assets", figures.select("portfolio_id", "missing_assets"), "missing_assets"),
        listed("series", path, [F.col("point")], "date", "value", money=money),
    ]
    return document(weights, blocks, ["result", "missing_assets", "series"])
