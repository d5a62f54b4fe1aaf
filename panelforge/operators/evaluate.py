"""Factor evaluation: returns, information coefficients, layers, turnover, reports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import average_rank, by_date, by_symbol, correlation, div
from .alignment import calendar, next_date

#: Trading periods between rebalances.
PERIODS = {"week": 5, "half_month": 10, "month": 21, "none": 1}


def forward_returns(grid: DataFrame, periods: tuple[int, ...] = (1, 5, 10, 20), price: str = "close") -> DataFrame:
    """P[t+1+p] / P[t+1] - 1 for each period, as ``fwd_<p>``."""
    lead = lambda k: F.lead(price, k).over(by_symbol())
    return grid.select("dt", "symbol", *[(div(lead(1 + p), lead(1)) - 1).alias(f"fwd_{p}") for p in periods])


def rebalance_returns(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """From the open of the first trading date after a signal to the close of the next signal's date; the last signal has none."""
    nxt = signals.select("dt", F.lead("dt").over(Window.orderBy("dt")).alias("exit_dt")).where("exit_dt IS NOT NULL")
    plan = nxt.join(next_date(nxt.select("dt"), calendar(bars)), "dt").where("next_dt IS NOT NULL")  # calendar-sized
    entry = plan.join(bars.select(F.col("dt").alias("next_dt"), "symbol", "open"), "next_dt")
    both = entry.join(bars.select(F.col("dt").alias("exit_dt"), "symbol", "close"), ["exit_dt", "symbol"])
    return both.select("dt", "symbol", (div("close", "open") - 1).alias("fwd_ret")).where("fwd_ret IS NOT NULL")


def ic_series(pairs: DataFrame, factor: str = "factor", ret: str = "fwd_ret", method: str = "spearman", least: int = 3) -> DataFrame:
    """(dt, ic) per date; NULL for fewer than ``least`` pairs or a constant side."""
    d = pairs.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    x, y = F.col(factor), F.col(ret)
    if method == "spearman":
        d = d.withColumn("_x", average_rank(x)).withColumn("_y", average_rank(y))
        x, y = F.col("_x"), F.col("_y")
    agg = d.groupBy("dt").agg(correlation(x, y).alias("ic"), F.count(F.lit(1)).alias("n"))
    return agg.select("dt", F.when(F.col("n") >= least, F.col("ic")).alias("ic"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def t_test(mean: float | None, std: float | None, n: int) -> tuple[float | None, float | None]:
    """One-sample t against 0 and its two-sided p-value."""
    if mean is None or not std or n < 2:
        return None, None
    t = mean / (std / math.sqrt(n))
    return t, _beta_fraction((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def benchmark_forward(bars: DataFrame, price: str = "close") -> DataFrame:
    """(dt, symbol, total): running product of P[t+2] / P[t+1], unknown steps counting as none, less 1."""
    lead = lambda k: F.lead(price, k).over(by_symbol())
    step = bars.withColumn("_r", F.coalesce(div(lead(2), lead(1)) - 1, F.lit(0.0)))
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return step.select("dt", "symbol", (F.product(1 + F.col("_r")).over(w) - 1).alias("total"))


def icir(mean: Column, std: Column, period: int = 1, annual: bool = True, per_year: int = 252) -> Column:
    return div(mean, std) * F.lit(math.sqrt(per_year / period) if annual else 1 / math.sqrt(period))


#: An IC counts as positive above this: exact zeros carry rounding noise of either sign.
NOISE = 1e-12


def ic_summary(ic: DataFrame, period: int = 1) -> DataFrame:
    """One row: mean, std, ICIR, t, share of positive ICs (of all dates) and number of dates."""
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    positive = F.sum(F.when(F.col("ic") > NOISE, 1).otherwise(0))
    return ic.agg(mean.alias("ic_mean"), std.alias("ic_std"), F.when(n >= 2, icir(mean, std, period)).alias("icir"), div(mean * F.sqrt(n), std).alias("t_stat"), div(positive, F.count(F.lit(1))).alias("positive_ratio"), n.alias("n"))


def yearly_ic(ic: DataFrame) -> DataFrame:
    mean, std = F.avg("ic"), F.stddev_samp("ic")
    return ic.where("ic IS NOT NULL").groupBy(F.year("dt").alias("year")).agg(mean.alias("ic_mean"), std.alias("ic_std"), div(mean, std).alias("icir"), div(F.sum(F.when(F.col("ic") > NOISE, 1).otherwise(0)), F.count(F.lit(1))).alias("positive_ratio"), F.count(F.lit(1)).alias("n"))


def ic_decay(panel: DataFrame, factor: str = "factor", ret: str = "fwd_ret", most: int = 20) -> DataFrame:
    """(lag, ic): mean rank IC with the return row ``lag - 1`` dates later; all lags in one pass over the grid."""
    shifted = panel.select("dt", factor, F.array(*[F.lead(ret, k).over(by_symbol()) if k else F.col(ret) for k in range(most)]).alias("_r"))
    d = shifted.select("dt", factor, F.posexplode("_r").alias("k", "r")).where(F.col(factor).isNotNull() & F.col("r").isNotNull())
    keys = ["dt", "k"]
    d = d.withColumn("_x", average_rank(factor, among=keys)).withColumn("_y", average_rank("r", among=keys))
    ic = d.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, correlation(F.col("_x"), F.col("_y"))).alias("ic"))
    return ic.groupBy((F.col("k") + 1).alias("lag")).agg(F.avg("ic").alias("ic"))


def quantile_group(x: str, q: int) -> Column:
    """1..q by rank with ties in symbol order: the smallest group whose upper edge, on a line from the first to the last rank, holds the rank."""
    rn = F.row_number().over(Window.partitionBy("dt").orderBy(x, "symbol"))
    n = F.count(F.lit(1)).over(by_date())
    return F.greatest(F.lit(1), F.ceil(div((rn - 1) * q, n - 1))).cast("int")


def layers(pairs: DataFrame, q: int = 5, factor: str = "factor", ret: str = "fwd_ret") -> DataFrame:
    """(dt, grp, ret): mean return of each quantile group on dates with at least ``q`` names."""
    d = pairs.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    d = d.withColumn("_n", F.count(F.lit(1)).over(by_date())).where(F.col("_n") >= q)
    return d.withColumn("grp", quantile_group(factor, q)).groupBy("dt", "grp").agg(F.avg(ret).alias("ret"))


def layer_summary(layer: DataFrame, q: int = 5, per_year: int = 252, period: int = 1) -> DataFrame:
    """(grp, total, annual, sharpe) of each group."""
    n, prod = F.count("ret"), F.product(1 + F.col("ret"))
    ppy = per_year / period
    return layer.groupBy("grp").agg((prod - 1).alias("total"), F.when(prod > 0, F.pow(prod, F.lit(float(ppy)) / n) - 1).alias("annual"), F.coalesce(div(F.avg("ret"), F.stddev_samp("ret")) * F.lit(math.sqrt(ppy)), F.lit(0.0)).alias("sharpe"), n.alias("n"))


def drawdown(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """(dt, wealth, drawdown) of a calendar-sized return series; the peak starts at the first wealth."""
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("wealth", F.product(1 + F.col(ret)).over(w))
    return d.withColumn("drawdown", div(F.col("wealth") - F.max("wealth").over(w), F.max("wealth").over(w)))


def spread_series(layer: DataFrame, q: int = 5) -> DataFrame:
    """(dt, top, short, excess): the top group, the bottom group sold, and the top less the mean of groups."""
    top, low = (F.max(F.when(F.col("grp") == g, F.col("ret"))) for g in (q, 1))
    return layer.groupBy("dt").agg(top.alias("top"), (-low).alias("short"), (top - F.avg("ret")).alias("excess"))


@dataclass(frozen=True)
class LayeredResult:
    groups: DataFrame
    summary: DataFrame
    spreads: DataFrame
    long_drawdown: float
    short_drawdown: float
    excess_annual: float | None
    excess_drawdown: float
    excess_calmar: float


def rolling_ic(ic: DataFrame, n: int = 20) -> DataFrame:
    """(dt, ic): the mean IC of the last ``n`` dates, once all of them have one.  One series: calendar-sized."""
    w = Window.orderBy("dt").rowsBetween(-(n - 1), 0)
    return ic.select("dt", F.when(F.count("ic").over(w) == n, F.avg("ic").over(w)).alias("ic"))


def layer_extremes(spreads: DataFrame, per_year: int = 252, period: int = 1) -> DataFrame:
    """One row: drawdowns of the top group, of the bottom group sold and of the top's excess, and that excess a year (null when it
    loses everything, 0 without dates) and by its drawdown."""
    sides = spreads.select("dt", F.posexplode(F.array("top", "short", "excess")).alias("side", "ret")).where("ret IS NOT NULL")
    by = Window.partitionBy("side").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    sides = sides.withColumn("wealth", F.product(1 + F.col("ret")).over(by))
    sides = sides.withColumn("dd", div(F.col("wealth") - F.max("wealth").over(by), F.max("wealth").over(by)))
    worst = lambda k: F.coalesce(F.min(F.when(F.col("side") == k, F.col("dd"))), F.lit(0.0))
    prod, n = F.product(F.when(F.col("side") == 2, 1 + F.col("ret"))), F.count(F.when(F.col("side") == 2, 1))
    annual = F.when(n == 0, F.lit(0.0)).when(prod > 0, F.pow(prod, F.lit(per_year / period) / n) - 1)
    out = sides.agg(worst(0).alias("long_drawdown"), worst(1).alias("short_drawdown"), annual.alias("excess_annual"), worst(2).alias("excess_drawdown"))
    return out.withColumn("excess_calmar", F.when(F.col("excess_annual").isNotNull() & (F.col("excess_drawdown") < 0), F.col("excess_annual") / F.abs("excess_drawdown")).otherwise(F.lit(0.0)))


def layered_backtest(pairs: DataFrame, q: int = 5, per_year: int = 252, period: int = 1) -> LayeredResult:
    layer = layers(pairs, q)
    spreads = spread_series(layer, q)
    x = layer_extremes(spreads, per_year, period).first()
    return LayeredResult(layer, layer_summary(layer, q, per_year, period), spreads, x.long_drawdown, x.short_drawdown, x.excess_annual, x.excess_drawdown, x.excess_calmar)


def turnover(pairs: DataFrame, q: int = 5, factor: str = "factor") -> DataFrame:
    """(dt, turnover): half the change of the top group's equal weights; the first date counts as 0, and a date with fewer than
    ``q`` names as empty weights.  Weights are joined date to date by symbol; only held names are shuffled."""
    dates = pairs.select("dt").distinct().withColumn("prev", F.lag("dt").over(Window.orderBy("dt")))
    d = pairs.where(F.col(factor).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(by_date())).where(F.col("_n") >= q)
    held = d.withColumn("grp", quantile_group(factor, q)).where(F.col("grp") == q)
    held = held.select("dt", "symbol", (F.lit(1.0) / F.count(F.lit(1)).over(by_date())).alias("w"))
    nxt = dates.where("prev IS NOT NULL").select(F.col("prev").alias("dt"), F.col("dt").alias("to"))
    changes = held.select("dt", "symbol", "w").unionByName(held.join(nxt, "dt").select(F.col("to").alias("dt"), "symbol", (-F.col("w")).alias("w")))
    moved = changes.groupBy("dt", "symbol").agg(F.sum("w").alias("w")).groupBy("dt").agg((F.sum(F.abs("w")) / 2).alias("turnover"))
    first = F.col("prev").isNull()
    return dates.join(moved, "dt", "left").select("dt", F.when(first, F.lit(0.0)).otherwise(F.coalesce("turnover", F.lit(0.0))).alias("turnover"))


def top_holdings(pairs: DataFrame, q: int = 5, factor: str = "factor") -> DataFrame:
    """(dt, symbols): names of the top group, best first."""
    d = pairs.where(F.col(factor).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(by_date())).where(F.col("_n") >= q)
    d = d.withColumn("grp", quantile_group(factor, q)).where(F.col("grp") == q)
    best = F.array_sort(F.collect_list(F.struct((-F.col(factor)).alias("f"), F.col("symbol").alias("s"))))
    return d.groupBy("dt").agg(F.array_join(F.transform(best, lambda x: x["s"].cast("string")), ", ").alias("symbols"))


def factor_report(pairs: DataFrame, rebalance: str = "none", q: int = 5) -> dict:
    """The summary row of a factor: numbers for a report, rounded to four places (p to six)."""
    period = PERIODS[rebalance]
    ic = ic_series(pairs)
    s = ic_summary(ic, period).first()
    _, p = t_test(s.ic_mean, s.ic_std, s.n)
    lay = layered_backtest(pairs, q, period=period)
    top = lay.summary.where(F.col("grp") == q).first()
    rounded = lambda v, d=4: None if v is None else round(v, d)
    return {
        "period": period, "IC_mean": rounded(s.ic_mean), "IC_std": rounded(s.ic_std), "ICIR": rounded(s.icir), "t_stat": rounded(s.t_stat), "p_value": rounded(p, 6), "IC>0_ratio": rounded(s.positive_ratio),
        "turnover": rounded(turnover(pairs).agg(F.avg("turnover")).first()[0]), "long_sharpe": rounded(top.sharpe if top else 0.0), "long_max_drawdown": rounded(lay.long_drawdown), "short_max_drawdown": rounded(lay.short_drawdown),
        "top_excess_annual": rounded(lay.excess_annual), "top_excess_max_dd": rounded(lay.excess_drawdown), "top_excess_calmar": rounded(lay.excess_calmar),
    }
