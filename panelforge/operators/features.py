"""The 158 price-volume features as column factories: name -> Column over a dense grid with ``i`` as date index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, correlation, div, full, last_rows, rolling, rolling_correlation

WINDOWS = (5, 10, 20, 30, 60)
O, H, L, C, V = "open", "high", "low", "close", "volume"


def _c(name: str) -> Column:
    return F.col(name)


def kline() -> dict[str, Column]:
    o, h, lo, c = map(_c, (O, H, L, C))
    top, bottom, span = F.when(o >= c, o).otherwise(c), F.when(o <= c, o).otherwise(c), h - lo
    parts = {"kmid": c - o, "kup": h - top, "klow": bottom - lo, "ksft": 2 * c - h - lo}
    out = {"klen": div(span, o)}
    for name, part in parts.items():
        out[name], out[f"{name}2"] = div(part, o), div(part, span)
    return {f"alpha158_{k}": v for k, v in out.items()}


def price(has_vwap: bool = False) -> dict[str, Column]:
    o, h, lo, c = map(_c, (O, H, L, C))
    traded = div("amount", "volume")
    vwap = F.coalesce(*([_c("vwap")] if has_vwap else []), F.when(div(traded, c).between(0.5, 1.5), traded), (o + h + lo + c) / 4)
    return {"alpha158_open0": div(o, c), "alpha158_high0": div(h, c), "alpha158_low0": div(lo, c), "alpha158_vwap0": div(vwap, c)}


def derived(grid: DataFrame) -> DataFrame:
    """The grid with the changes that the rolling features share, computed once."""
    prev = lambda x: F.lag(x).over(by_symbol())
    g = grid.withColumn("lv", F.when(_c(V) > 0, F.log(_c(V).cast("double"))))
    g = g.withColumns({"dc": _c(C) - prev(C), "ret": div(C, prev(C)) - 1, "dlv": _c("lv") - prev("lv"), "dv": _c(V) - prev(V)})
    return g.withColumn("rv", F.abs("ret") * _c(V))


def _extreme(x: str, n: int, pick) -> Column:
    values = F.collect_list(x).over(last_rows(n))
    return full(F.array_position(values, pick(F.col(x)).over(last_rows(n))) - 1, x, n)


def _rank(n: int) -> Column:
    values = F.collect_list(C).over(last_rows(n))
    less, same = F.size(F.filter(values, lambda v: v < _c(C))), F.size(F.filter(values, lambda v: v == _c(C)))
    return full((less + (same + 1) / F.lit(2.0)) / n, C, n)


def _share(x: str, n: int, test: Callable[[Column], Column]) -> Column:
    return rolling(F.avg, F.when(F.col(x).isNotNull(), test(F.col(x)).cast("double")), n)


def _part(x: str, n: int, sign: int) -> Column:
    total = rolling(F.sum, F.abs(F.col(x)), n)
    return div(rolling(F.sum, F.when(F.col(x).isNotNull(), F.greatest(sign * F.col(x), F.lit(0.0))), n), total)


def _fit(function, n: int) -> Column:
    return full(function(_c(C), F.col("i").cast("double")).over(last_rows(n)), C, n)


def _rsqr(n: int) -> Column:
    constant = F.max(C).over(last_rows(n)) == F.min(C).over(last_rows(n))
    return full(F.when(constant, F.lit(1.0)).otherwise(F.regr_r2(_c(C), F.col("i").cast("double")).over(last_rows(n))), C, n)


ROLLING: dict[str, Callable[[int], Column]] = {
    "roc": lambda n: div(F.lag(C, n).over(by_symbol()), C),
    "ma": lambda n: div(rolling(F.avg, C, n), C),
    "std": lambda n: div(rolling(F.stddev_samp, C, n), C),
    "beta": lambda n: div(_fit(F.regr_slope, n), C),
    "rsqr": _rsqr,
    "resi": lambda n: div(_c(C) - (_fit(F.regr_intercept, n) + _fit(F.regr_slope, n) * F.col("i")), C),
    "max": lambda n: div(rolling(F.max, H, n), C),
    "min": lambda n: div(rolling(F.min, L, n), C),
    "qtlu": lambda n: div(rolling(lambda x: F.percentile(x, 0.8), C, n), C),
    "qtld": lambda n: div(rolling(lambda x: F.percentile(x, 0.2), C, n), C),
    "rank": _rank,
    "rsv": lambda n: div(_c(C) - rolling(F.min, L, n), rolling(F.max, H, n) - rolling(F.min, L, n)),
    "imax": lambda n: _extreme(H, n, F.max) / (n - 1),
    "imin": lambda n: _extreme(L, n, F.min) / (n - 1),
    "imxd": lambda n: (_extreme(H, n, F.max) - _extreme(L, n, F.min)) / (n - 1),
    "corr": lambda n: rolling_correlation(_c(C), F.col("lv"), n),
    "cord": lambda n: rolling_correlation(F.col("ret"), F.col("dlv"), n),
    "cntp": lambda n: _share("dc", n, lambda d: d > 0),
    "cntn": lambda n: _share("dc", n, lambda d: d < 0),
    "cntd": lambda n: _share("dc", n, lambda d: d > 0) - _share("dc", n, lambda d: d < 0),
    "sump": lambda n: _part("dc", n, 1),
    "sumn": lambda n: _part("dc", n, -1),
    "sumd": lambda n: _part("dc", n, 1) - _part("dc", n, -1),
    "vma": lambda n: div(rolling(F.avg, V, n), V),
    "vstd": lambda n: div(rolling(F.stddev_samp, V, n), V),
    "wvma": lambda n: div(rolling(F.stddev_samp, "rv", n), rolling(F.avg, "rv", n)),
    "vsump": lambda n: _part("dv", n, 1),
    "vsumn": lambda n: _part("dv", n, -1),
    "vsumd": lambda n: _part("dv", n, 1) - _part("dv", n, -1),
}


def all_features() -> dict[str, Column]:
    """All 158, by name; one select evaluates them over one sort."""
    return {**kline(), **price(), **{f"alpha158_{p}{n}": f(n) for p, f in ROLLING.items() for n in WINDOWS}}


def feature_names() -> list[str]:
    """The names of all 158, known without a session."""
    line = [f"alpha158_{k}" for k in ("klen", "kmid", "kmid2", "kup", "kup2", "klow", "klow2", "ksft", "ksft2")]
    return [*line, *[f"alpha158_{k}0" for k in ("open", "high", "low", "vwap")], *[f"alpha158_{p}{n}" for p in ROLLING for n in WINDOWS]]


def features(grid: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named features (all 158) in one select.

    A row costs hundreds of window updates, far more than its bytes suggest, so symbols are dealt to a
    fixed number of partitions, which adaptive execution doesn't merge; all windows share that one shuffle.
    """
    made = all_features()
    dealt = grid.repartition(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")
    return derived(dealt).select("dt", "symbol", *[made[n].alias(n) for n in names or made])


__all__ = ["ROLLING", "WINDOWS", "all_features", "correlation", "derived", "feature_names", "features", "kline", "price"]
