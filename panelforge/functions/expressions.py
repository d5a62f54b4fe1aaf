"""Column builders shared by the operators.  A missing value is NULL; NaN and infinities never leave a builder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL, DATE = "symbol", "dt"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """``c`` with NaN and infinities as NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def div(a: Column | str, b: Column | str) -> Column:
    """Quotient; NULL where the divisor is 0 or the quotient is not finite."""
    return finite(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def by_symbol() -> WindowSpec:
    return Window.partitionBy(SYMBOL).orderBy(DATE)


def by_date() -> WindowSpec:
    return Window.partitionBy(DATE)


def last_rows(n: int, skip: int = 0) -> WindowSpec:
    """The last ``n`` rows of a symbol; with ``skip`` 1 without the current one."""
    return by_symbol().rowsBetween(-(n - 1) - skip, -skip)


def upto() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, over: Column | str, n: int, least: int | None = None, skip: int = 0) -> Column:
    """``value`` where the window holds at least ``least`` (all ``n``) values of ``over``."""
    return F.when(F.count(col(over)).over(last_rows(n, skip)) >= (n if least is None else least), value)


def rolling(function, x: Column | str, n: int, least: int | None = None, skip: int = 0) -> Column:
    return full(function(col(x)).over(last_rows(n, skip)), x, n, least, skip)


def pct_change(x: Column | str, n: int = 1) -> Column:
    return div(col(x), F.lag(col(x), n).over(by_symbol())) - 1


def pct_change_padded(x: Column | str, n: int = 1) -> Column:
    """The change of the value carried forward over gaps: after a gap it is taken against the last known value, within one it is 0."""
    past = F.last(col(x), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -n))
    return div(ffill(x), past) - 1


def ffill(x: Column | str) -> Column:
    return F.last(col(x), ignorenulls=True).over(upto())


def average_rank(x: Column | str, window: WindowSpec | None = None, among: list[str] | None = None) -> Column:
    """Rank from 1 with ties averaged, within a date (or ``among``); NULL for NULL."""
    x, keys = col(x), among or [DATE]
    order = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # peers: the same sort serves both
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / F.lit(2.0))


def correlation(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    """Pearson correlation over the pairs without NULL; NULL where either side is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)]
    cov, sx, sy = [p.over(window) for p in parts] if window is not None else parts
    return div(cov, sx * sy)


def rolling_correlation(x: Column, y: Column, n: int) -> Column:
    pair = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    return F.when(F.count(pair).over(last_rows(n)) == n, correlation(x, y, last_rows(n)))


def ewm_means(df: DataFrame, inputs: dict[str, Column], alpha: float, least: int) -> DataFrame:
    """Adds exponentially weighted means, with normalised weights, over all rows of a symbol so far; missing rows keep their age.

    A symbol's rows are cut into blocks.  Within one, sums of ``x / (1 - alpha) ** k`` run along, k being the row's place in it; what
    earlier blocks hand on is folded over their totals.  So a row costs the same however long the history is.
    """
    keep = 1.0 - alpha
    rows = max(1, min(512, int(460 / -math.log(keep)))) if keep > 0 else 1
    d = df.withColumn("_ew_i", F.row_number().over(by_symbol()) - 1)
    d = d.withColumn("_ew_b", F.floor(F.col("_ew_i") / rows)).withColumn("_ew_k", (F.col("_ew_i") % rows).cast("double"))
    d = d.withColumns({f"_ew_{n}": x.cast("double") for n, x in inputs.items()})
    grow = F.pow(F.lit(1.0 / keep) if keep > 0 else F.lit(1.0), F.col("_ew_k"))
    parts = {}
    for n in inputs:
        parts[f"_ew_s_{n}"] = F.coalesce(F.col(f"_ew_{n}"), F.lit(0.0)) * grow
        parts[f"_ew_w_{n}"] = F.when(F.col(f"_ew_{n}").isNotNull(), grow).otherwise(F.lit(0.0))
    d = d.withColumns(parts)
    totals = d.groupBy(SYMBOL, "_ew_b").agg(*[(F.sum(c) * keep ** (rows - 1)).alias(c) for c in parts])
    earlier = Window.partitionBy(SYMBOL).orderBy("_ew_b").rowsBetween(Window.unboundedPreceding, -1)
    fold = lambda c: F.aggregate(F.collect_list(c).over(earlier), F.lit(0.0), lambda acc, x: acc * F.lit(keep**rows) + x)
    carried = totals.select(F.col(SYMBOL).alias("_ew_symbol"), F.col("_ew_b").alias("_ew_at"), *[fold(c).alias(f"{c}_before") for c in parts])
    inside = Window.partitionBy(SYMBOL, "_ew_b").orderBy("_ew_k").rowsBetween(Window.unboundedPreceding, 0)
    here = F.pow(F.lit(keep), F.col("_ew_k"))
    sums = d.withColumns({c: F.sum(c).over(inside) * here for c in parts} | {f"_ew_n_{n}": F.count(f"_ew_{n}").over(upto()) for n in inputs})
    out = sums.join(carried, (F.col(SYMBOL) == F.col("_ew_symbol")) & (F.col("_ew_b") == F.col("_ew_at")), "left")
    whole = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_before"), F.lit(0.0)) * here * keep
    made = {n: F.when((F.col(f"_ew_n_{n}") >= least) & F.col(f"_ew_{n}").isNotNull(), div(whole(f"_ew_s_{n}"), whole(f"_ew_w_{n}"))) for n in inputs}
    return out.select(*[F.col(c) for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])
