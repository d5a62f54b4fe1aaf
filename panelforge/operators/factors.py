"""Factors and their registry."""

from __future__ import annotations

import importlib.util
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, div, ewm_means, full, last_rows, pct_change, rolling, upto
from .features import all_features, derived, feature_names, features


class Registry:
    """Named factors.  A selection factor maps a dense grid to (dt, symbol, value); a timing factor is a column over a symbol's own rows."""

    def __init__(self):
        self.selection: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.timing: dict[str, Callable[[], Column]] = {}
        self.needs: dict[str, tuple[str, ...]] = {}

    def register(self, name: str, make: Callable, kind: str = "selection", needs: tuple[str, ...] = ()) -> Callable:
        """``needs``: columns beyond those of bars that a grid must have for the factor."""
        if not name:
            raise ValueError("a factor needs a name")
        if kind not in ("selection", "timing"):
            raise ValueError(f"no kind {kind!r}")
        table = getattr(self, kind)
        if name in table:
            warnings.warn(f"factor {name} is replaced", stacklevel=2)
        table[name], self.needs[name] = make, needs
        return make

    def get(self, name: str) -> Callable:
        return self.selection[name] if name in self.selection else self.timing[name]

    def names(self, kind: str = "selection") -> list[str]:
        return sorted(getattr(self, kind))

    def details(self) -> list[dict]:
        """Name, kind, needed columns and the first line of the description of every factor."""
        line = lambda f: ((getattr(f, "__doc__", None) or "").strip().splitlines() or [""])[0]
        return [{"name": n, "kind": k, "needs": list(self.needs.get(n, ())), "description": line(getattr(self, k)[n])} for k in ("selection", "timing") for n in self.names(k)]

    def generate(self, grid: DataFrame, names: list[str] | None = None) -> DataFrame:
        """(dt, symbol, one column for each factor); features share one select, other factors are joined by key.

        Without names, all factors whose needed columns the grid has."""
        names = names or [n for n in self.names() if set(self.needs.get(n, ())) <= set(grid.columns)]
        if missing := [n for n in names if n not in self.selection]:
            raise KeyError(missing[0])
        made = all_features()
        shared = [n for n in names if n in made]
        out = derived(grid).select("dt", "symbol", *[made[n].alias(n) for n in shared])
        for n in names:
            if n not in made:
                out = out.join(self.selection[n](grid).withColumnRenamed("value", n), ["dt", "symbol"], "full")
        return out

    def reset(self) -> None:
        self.selection.clear()
        self.timing.clear()
        self.needs.clear()

    def discover(self, folder: str) -> list[str]:
        """Runs the Python files of a folder that don't start with ``_``; each may call ``register``.  Only for trusted folders."""
        before = set(self.selection) | set(self.timing)
        for path in sorted(Path(folder).glob("[!_]*.py")):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
        return sorted((set(self.selection) | set(self.timing)) - before)


def of_column(value: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda grid: grid.select("dt", "symbol", value().alias("value"))


def momentum(n: int) -> Column:
    return pct_change("close", n)


def volatility(n: int = 20) -> DataFrame | Callable:
    """Standard deviation of the last n returns (this library's definition)."""
    return lambda grid: grid.withColumn("_r", pct_change("close")).select("dt", "symbol", rolling(F.stddev_samp, "_r", n).alias("value"))


def high_low_spread(n: int = 20) -> Callable:
    """Mean of (high - low) / close over the last n dates (this library's definition)."""
    return lambda grid: grid.withColumn("_s", div(F.col("high") - F.col("low"), "close")).select("dt", "symbol", rolling(F.avg, "_s", n).alias("value"))


def market_returns(panel: DataFrame, cap: str | None = "market_cap") -> DataFrame:
    """(dt, mkt): returns weighted by cap over the names that have both."""
    d = panel.withColumn("_r", pct_change("close"))
    w = F.when(F.col("_r").isNotNull() & (F.col(cap) > 0), F.col(cap)) if cap else F.when(F.col("_r").isNotNull(), F.lit(1.0))
    return d.groupBy("dt").agg(div(F.sum(F.col("_r") * w), F.sum(w)).alias("mkt"))


def capm_beta(panel: DataFrame, lookback: int = 252, least: int = 120, clip: float = 3.0, month_end: bool = True, cap: str = "market_cap") -> DataFrame:
    """Rolling beta against the cap-weighted market; the market table is calendar-sized.  Caps are carried forward on the grid."""
    p = panel.withColumn(cap, F.last(cap, ignorenulls=True).over(upto()))
    d = p.withColumn("_r", pct_change("close")).join(market_returns(p, cap), "dt")
    w = last_rows(lookback)
    both = F.col("_r").isNotNull() & F.col("mkt").isNotNull()
    r, m = F.when(both, F.col("_r")), F.when(both, F.col("mkt"))
    cov = F.when(F.count(r).over(w) >= least, F.covar_samp(r, m).over(w))
    var = F.when(F.count("mkt").over(w) >= least, F.var_samp("mkt").over(w))
    beta = div(cov, var)
    out = d.select("dt", "symbol", F.when(beta.isNotNull() & F.lit(least <= lookback), F.greatest(F.least(beta, F.lit(clip)), F.lit(-clip))).alias("value"))
    if not month_end:
        return out
    ends = panel.select("dt").distinct().groupBy(F.trunc("dt", "MM")).agg(F.max("dt").alias("dt")).select("dt")
    return out.join(ends, "dt", "left_semi")


def three_factor_volatility(panel: DataFrame, size: DataFrame, value: DataFrame, market: DataFrame, n: int = 20, per_year: int = 252) -> DataFrame:
    """Annualised deviation of the residuals of a return on market, size and value spreads over the last ``n`` dates.

    Window sums of cross-products give the residual sum of squares by elimination, so the fit stays in the JVM.
    The spread tables have a row for each date.
    """
    d = panel.withColumn("y", pct_change("close")).join(market, "dt").join(size, "dt").join(value, "dt")
    names = ["y", "mkt", "smb", "hml"]
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    d = d.withColumn("_ok", F.when(whole, F.lit(1)))
    w = last_rows(n)
    at = {(a, b): F.covar_samp(F.when(whole, F.col(a)), F.when(whole, F.col(b))).over(w) for i, a in enumerate(names) for b in names[i:]}
    d = d.withColumns({f"_{a}_{b}": c for (a, b), c in at.items()} | {"_n": F.count("_ok").over(w)})
    s = lambda a, b: F.col(f"_{a}_{b}" if names.index(a) <= names.index(b) else f"_{b}_{a}")
    cov = {(a, b): s(a, b) for a in names for b in names}
    for p in names[1:]:  # eliminate one regressor after the other; one without variation is left out
        left = sorted({a for a, _ in cov} - {p})
        cov = {(a, b): cov[a, b] - F.coalesce(F.when(cov[p, p] > 1e-18, F.try_divide(cov[a, p] * cov[p, b], cov[p, p])), F.lit(0.0)) for a in left for b in left}
    return d.select("dt", "symbol", F.when(F.col("_n") == n, F.sqrt(F.greatest(cov["y", "y"], F.lit(0.0))) * F.sqrt(F.lit(float(per_year)))).alias("value"))


def ma_cross(fast: int = 5, slow: int = 20) -> Column:
    """Sign of the fast less the slow mean over a symbol's own rows; 0 while undefined."""
    return F.coalesce(F.signum(rolling(F.avg, "close", fast) - rolling(F.avg, "close", slow)), F.lit(0.0))


def rsi(df: DataFrame, period: int = 14, low: float = 30, high: float = 70, fixed: bool = False) -> DataFrame:
    """(dt, symbol, rsi, signal): +1 below ``low``, -1 above ``high``.  Without losses RSI is 0, or with ``fixed`` 100."""
    d = df.withColumn("_d", F.col("close") - F.lag("close").over(by_symbol()))
    part = lambda sign: F.when(F.col("_d").isNotNull(), F.greatest(sign * F.col("_d"), F.lit(0.0)))
    d = ewm_means(d, {"_g": part(1), "_l": part(-1)}, 1 / period, period)
    rs = F.when(F.col("_l") == 0, F.lit(None if fixed else 0.0).cast("double")).otherwise(div("_g", "_l"))
    value = 100 - F.lit(100.0) / (1 + rs)
    if fixed:
        value = F.when(F.col("_l") == 0, F.lit(100.0)).otherwise(value)
    d = d.withColumn("rsi", value)
    signal = F.when(F.col("rsi") < low, 1.0).when(F.col("rsi") > high, -1.0).otherwise(0.0)
    return d.select("dt", "symbol", "rsi", signal.alias("signal"))


#: Quality sub-factors: names, and which of them are growth.
PROFIT = ("roeq", "roaq", "gpoaq", "gmarq")
GROWTH = ("droeq", "droaq", "dgpoaq", "dgmarq")


def quality_subfactors(statements: DataFrame) -> DataFrame:
    """Profitability and its change over four statements, per (symbol, dt) of a statement table; the last row wins per date."""
    w = Window.partitionBy("symbol").orderBy("dt", "report_date")
    one = Window.partitionBy("symbol", "dt").orderBy(F.desc("report_date"))
    s = statements.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
    s = s.withColumn("gross_profit", F.coalesce("gross_profit", F.col("revenue") - F.col("cost_revenue")))
    back = lambda c: F.lag(c, 4).over(w)
    s = s.withColumn("_avg", (F.col("total_assets") + F.lag("total_assets").over(w)) / 2)
    change = lambda c, base: div(F.col(c) - back(c), back(base))
    return s.select(
        "symbol", "dt", "report_date", div("net_income", "equity").alias("roeq"), div("net_income", "_avg").alias("roaq"), div("gross_profit", "_avg").alias("gpoaq"), div("gross_profit", "revenue").alias("gmarq"),
        change("net_income", "equity").alias("droeq"), change("net_income", "total_assets").alias("droaq"), change("gross_profit", "total_assets").alias("dgpoaq"), change("gross_profit", "revenue").alias("dgmarq"),
    )


def quality_increase(scores: DataFrame, rows: int = 4) -> DataFrame:
    """Score less the score ``rows`` dates before."""
    return scores.select("dt", "symbol", (F.col("score") - F.lag("score", rows).over(by_symbol())).alias("increase"))


REGISTRY = Registry()
for _name in feature_names():
    REGISTRY.register(_name, lambda grid, n=_name: features(grid, [n]).withColumnRenamed(n, "value"))
for _n in (5, 10, 20):
    REGISTRY.register(f"momentum_{_n}", of_column(lambda n=_n: momentum(n)))
REGISTRY.register("volatility_20", volatility(20))
REGISTRY.register("highlow_spread_20", high_low_spread(20))
REGISTRY.register("capm_beta", capm_beta, needs=("market_cap",))
REGISTRY.register("ma_cross_timing", ma_cross, "timing")
REGISTRY.register("rsi_timing", rsi, "timing")

__all__ = ["REGISTRY", "Registry", "capm_beta", "full", "high_low_spread", "ma_cross", "market_returns", "momentum", "quality_increase", "quality_subfactors", "rsi", "three_factor_volatility", "volatility"]
