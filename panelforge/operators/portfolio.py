"""Top-k portfolios, the sequential execution simulator and performance figures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import div, upto
from ..sources.staging import durable

DAYS = 252


def rebalance_dates(calendar: DataFrame) -> DataFrame:
    """The last date of each week that ends on a Friday, a partial last week included."""
    return calendar.groupBy(F.next_day(F.date_sub("dt", 1), "FRI").alias("_w")).agg(F.max("dt").alias("dt")).select("dt")


def top_k_weights(grid: DataFrame, signal: str = "signal", k: int = 5, least: float = 0.0, rebalance: DataFrame | None = None) -> DataFrame:
    """(dt, symbol, weight): on rebalance dates the k best tradable names above ``least`` share equally, others have 0;
    between them weights stay.  Before the first rebalance weights are 0."""
    dates = rebalance_dates(grid.select("dt").distinct()) if rebalance is None else rebalance
    d = grid.join(F.broadcast(dates.withColumn("_reb", F.lit(True))), "dt", "left")
    s = F.col(signal)
    good = F.col("_reb") & F.col("close").isNotNull() & (F.col("volume") > 0) & s.isNotNull() & ~F.isnan(s.cast("double")) & (F.abs(s) < F.lit(float("inf"))) & (s > least)
    d = d.withColumn("_s", F.when(good, s))
    order = Window.partitionBy("dt").orderBy(F.col("_s").desc_nulls_last(), "symbol")
    d = d.withColumn("_pick", F.col("_s").isNotNull() & (F.row_number().over(order) <= k))
    n = F.sum(F.col("_pick").cast("int")).over(Window.partitionBy("dt"))
    d = d.withColumn("_n", n)
    at = F.when(F.col("_reb"), F.when(F.col("_pick"), F.lit(1.0) / F.col("_n")).otherwise(F.lit(0.0)))
    return d.withColumn("_w", at).select("dt", "symbol", F.coalesce(F.last("_w", ignorenulls=True).over(upto()), F.lit(0.0)).alias("weight"))


@dataclass(frozen=True)
class Simulation:
    """``records``: one row for each strategy and date, with its positions and trades as arrays."""

    records: DataFrame

    @property
    def daily(self) -> DataFrame:
        """Equity, cash, net asset value, return, turnover, costs and shares traded on each date."""
        return self.records.drop("positions", "trades")

    @property
    def trades(self) -> DataFrame:
        """Each trade: signed shares, price, notional, costs, and cash, position and equity after it."""
        return self.records.select("strategy", "dt", F.explode("trades").alias("t")).select("strategy", "dt", "t.*")

    @property
    def rebalance_records(self) -> DataFrame:
        """Each trade as a reader wants it: action, shares, price, notional and the balance after it."""
        return self.trades.select("strategy", "dt", "symbol", "action", F.abs("shares").alias("shares"), "price", "notional", F.col("cash_after").alias("balance"))

    @property
    def positions(self) -> DataFrame:
        """Shares and weight of each name held after a date's trades."""
        return self.records.select("strategy", "dt", F.explode("positions").alias("p")).select("strategy", "dt", "p.*")


_MONEY = ("equity", "cash", "nav", "ret", "turnover", "notional", "commission", "slippage", "cost", "bought", "sold")
_TRADE = ("shares", "price", "notional", "commission", "slippage", "cost", "cash_after", "position_after", "equity_after")
_RECORDS = (
    "strategy string, dt date, " + ", ".join(f"{c} double" for c in _MONEY) + ", positions array<struct<symbol: string, shares: double, weight: double>>, "
    "trades array<struct<symbol: string, action: string, " + ", ".join(f"{c}: double" for c in _TRADE) + ">>"
)


class _Account:
    """Cash and whole shares (as doubles, which no equity can overflow) of one strategy."""

    def __init__(self, names: list[str], capital: float, commission: float, slippage: float):
        self.names, self.cash, self.shares = names, capital, np.zeros(len(names))
        self.rates = commission, slippage
        self.trades: list[dict] = []

    def worth(self, price: np.ndarray) -> float:
        return self.cash + float(self.shares @ price)

    def trade(self, i: int, shares: float, price: np.ndarray) -> None:
        notional = abs(shares) * price[i]
        commission, slippage = (notional * r for r in self.rates)
        self.cash -= shares * price[i] + commission + slippage
        self.shares[i] += shares
        values = shares, price[i], notional, commission, slippage, commission + slippage, self.cash, self.shares[i], self.worth(price)
        self.trades.append({"symbol": self.names[i], "action": "buy" if shares > 0 else "sell", **dict(zip(_TRADE, map(float, values), strict=True))})

    def rebalance(self, weight: np.ndarray, price: np.ndarray) -> None:
        """Sales first, then purchases, the heaviest first, as cash lasts.  A name without a positive price has no target."""
        unit = price * (1.0 + sum(self.rates))
        budget = max(self.worth(price), 0.0) * weight
        target = np.floor(np.divide(budget, unit, out=np.zeros(len(unit)), where=unit > 0))
        for i in np.flatnonzero(target < self.shares):
            self.trade(i, target[i] - self.shares[i], price)
        for i in sorted(np.flatnonzero(weight > 0), key=lambda j: (-weight[j], j)):
            shares = min(target[i] - self.shares[i], self.cash // unit[i] if unit[i] > 0 else 0.0)
            if shares > 0:
                self.trade(i, shares, price)


def _simulated(commission: float, slippage: float, capital: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dates = np.sort(pdf["dt"].unique())
        held = pdf[pdf["symbol"].notna()]
        by_date = lambda c: held.pivot(index="dt", columns="symbol", values=c).sort_index(axis=1).reindex(dates).ffill()
        prices, weights = by_date("price"), by_date("weight").shift(1).fillna(0.0).clip(lower=0.0).to_numpy(dtype=float)
        names = [str(c) for c in prices.columns]
        prices = np.maximum(np.nan_to_num(prices.to_numpy(dtype=float), nan=0.0, posinf=0.0, neginf=0.0), 0.0)
        account, last, rows = _Account(names, capital, commission, slippage), capital, []
        for date, weight, price in zip(dates, weights, prices, strict=True):
            before, account.trades = account.worth(price), []
            account.rebalance(weight, price)
            equity, done = account.worth(price), account.trades
            total = {c: sum(t[c] for t in done) for c in ("notional", "commission", "slippage", "cost")}
            bought, sold = (sum(abs(t["shares"]) for t in done if t["action"] == a) for a in ("buy", "sell"))
            money = equity, account.cash, equity / capital, equity / last - 1 if last > 0 else 0.0, total["notional"] / before if before > 0 else 0.0, *total.values(), bought, sold
            positions = [{"symbol": names[i], "shares": float(account.shares[i]), "weight": float(account.shares[i] * price[i] / equity) if equity > 0 else 0.0} for i in np.flatnonzero(account.shares)]
            rows.append([pdf["strategy"].iloc[0], date, *map(float, money), positions, done])
            last = equity
        return pd.DataFrame(rows, columns=["strategy", "dt", *_MONEY, "positions", "trades"])

    return run


def simulate(weights: DataFrame, bars: DataFrame, price: str | None = None, capital: float = 1_000_000.0, commission: float = 0.001, slippage: float = 0.001) -> Simulation:
    """Weights of a date are traded at the next date's price in whole shares: sales first, then purchases by weight as cash lasts.

    The dates are those of ``bars``; prices (``adj_close`` if there is one, else ``close``) and weights are carried
    forward, and weights below 0 count as 0.  The fold is sequential within a strategy and parallel over strategies (column ``strategy``; one
    if absent).  Only names that a strategy ever holds reach its fold.  Its records are written once: daily rows, trades
    and positions are read from them.
    """
    if capital <= 0:
        raise ValueError("capital must be positive")
    price = price or ("adj_close" if "adj_close" in bars.columns else "close")
    w = weights if "strategy" in weights.columns else weights.withColumn("strategy", F.lit("main"))
    ever = w.where("weight > 0").select("strategy", "symbol").distinct()
    priced = bars.join(ever, "symbol").select("strategy", "dt", "symbol", F.col(price).cast("double").alias("price"))
    rows = priced.join(w.select("strategy", "dt", "symbol", F.col("weight").cast("double").alias("weight")), ["strategy", "dt", "symbol"], "left")
    # Every date of the calendar is a row of every strategy, whether a held name has a bar or not.
    days = w.select("strategy").distinct().crossJoin(bars.select("dt").distinct())
    rows = rows.select("strategy", "dt", F.col("symbol").cast("string").alias("symbol"), "weight", "price").unionByName(days, allowMissingColumns=True)
    return Simulation(durable(rows.groupBy("strategy").applyInPandas(_simulated(commission, slippage, capital), _RECORDS), "simulation"))


def performance(daily: DataFrame, ret: str = "ret", by: tuple[str, ...] = (), free: float = 0.0) -> DataFrame:
    """One row for each series: totals, annual figures (population deviation), drawdown and its longest run, win rate, profit-loss ratio."""
    w = Window.partitionBy(*by).orderBy("dt")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_v", F.product(1 + F.col(ret)).over(running))
    d = d.withColumn("_dd", div(F.col("_v"), F.max("_v").over(running)) - 1)
    d = d.withColumn("_calm", F.sum(F.when(F.col("_dd") >= 0, 1).otherwise(0)).over(running))
    d = d.withColumn("_run", F.sum(F.when(F.col("_dd") < 0, 1).otherwise(0)).over(Window.partitionBy(*by, "_calm")))
    n, prod, r = F.count(ret), F.product(1 + F.col(ret)), F.col(ret)
    annual = F.when(prod > 0, F.pow(prod, F.lit(float(DAYS)) / n) - 1).otherwise(F.lit(-1.0))
    dd = F.min("_dd")
    gain, loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, r))
    aggs = [
        (prod - 1).alias("total_return"), annual.alias("annual_return"), (F.stddev_pop(r) * math.sqrt(DAYS)).alias("annual_vol"), F.coalesce(div(F.avg(r) - free / DAYS, F.stddev_pop(r)) * math.sqrt(DAYS), F.lit(0.0)).alias("sharpe"),
        dd.alias("max_drawdown"), F.when(dd < 0, annual / F.abs(dd)).otherwise(F.lit(0.0)).alias("calmar"), F.max("_run").alias("drawdown_days"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), div(gain, F.abs(loss)).alias("profit_loss"), n.alias("n"),
    ]
    return (d.groupBy(*by) if by else d).agg(*aggs)


def excess(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(dt, excess): strategy less benchmark on common dates."""
    return daily.select("dt", "ret").join(benchmark.select("dt", F.col("ret").alias("_b")), "dt").select("dt", (F.col("ret") - F.col("_b")).alias("excess"))


def monthly_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("dt").alias("year"), F.month("dt").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def rolling_sharpe(daily: DataFrame, n: int = 60, free: float = 0.0) -> DataFrame:
    w = Window.orderBy("dt").rowsBetween(-(n - 1), 0)  # one series: calendar-sized
    s: Column = div(F.avg("ret").over(w) - free / DAYS, F.stddev_pop("ret").over(w)) * math.sqrt(DAYS)
    return daily.select("dt", F.when(F.count("ret").over(w) == n, s).alias("sharpe"))


def timing_returns(signals: DataFrame, closes: DataFrame, scale: float = 1.0) -> DataFrame:
    """(symbol, dt, r, s, ret, nav): per symbol its own return, the sign of the signal, and what holding ``scale`` times that
    sign from the second date after it returns, with the net asset value that this makes of 1."""
    w = Window.partitionBy("symbol").orderBy("dt")
    d = signals.join(closes.select("dt", "symbol", "close"), ["dt", "symbol"]).where("signal IS NOT NULL AND close IS NOT NULL")
    d = d.withColumn("r", div("close", F.lag("close").over(w)) - 1).withColumn("s", F.signum("signal"))
    d = d.withColumn("ret", F.coalesce(F.lag("s", 2).over(w) * F.col("r") * scale, F.lit(0.0)))
    return d.select("symbol", "dt", "r", "s", "ret", F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("nav"))


def benchmark_close(closes: DataFrame, symbol: object | None = None) -> DataFrame:
    """(dt, close) of one symbol, or of the first symbol of each date."""
    if symbol is not None:
        return closes.where(F.col("symbol") == F.lit(symbol)).select("dt", "close")
    return closes.groupBy("dt").agg(F.min_by("close", "symbol").alias("close"))


def benchmark_nav(close: DataFrame) -> DataFrame:
    """(dt, ret, nav): buy and hold from the first close on.  One series: calendar-sized."""
    w = Window.orderBy("dt")
    first = F.first("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return close.select("dt", (div("close", F.lag("close").over(w)) - 1).alias("ret"), div(F.col("close"), first).alias("nav"))


def timing_summary(signals: DataFrame, closes: DataFrame, scale: float = 1.0, benchmark: DataFrame | None = None) -> DataFrame:
    """Per symbol: direction win rate (over dates with a signal), the figures of its strategy (see ``timing_returns``), and the
    annual return and Calmar ratio of its excess over a ``benchmark`` (dt, ret), null with fewer than two common dates;
    without a benchmark the excess is the strategy itself."""
    d = timing_returns(signals, closes, scale)
    hits = d.groupBy("symbol").agg(F.avg(F.when((F.col("s") != 0) & F.col("r").isNotNull(), (F.col("s") == F.signum("r")).cast("double"))).alias("direction_win_rate"))
    over = d.select("symbol", "dt", "ret")
    if benchmark is not None:
        over = over.join(benchmark.where("ret IS NOT NULL").select("dt", F.col("ret").alias("_b")), "dt").select("symbol", "dt", (F.col("ret") - F.col("_b")).alias("ret"))
    more = performance(over, by=("symbol",)).where("n > 1").select("symbol", F.col("annual_return").alias("excess_annual"), F.col("calmar").alias("excess_calmar"))
    return performance(d, by=("symbol",)).join(hits, "symbol").join(more, "symbol", "left")
