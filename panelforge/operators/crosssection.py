"""Per-date operators: clipping, scores, neutralisation, factor weights and their combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import average_rank, by_date, col, correlation, div


def winsorise(x: Column | str, lo: float = 0.01, hi: float = 0.99) -> Column:
    x = col(x)
    low, high = (F.percentile(x, q).over(by_date()) for q in (lo, hi))
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def median_filled(x: Column | str, otherwise: float | None = None) -> Column:
    x = col(x)
    return F.coalesce(x, F.median(x).over(by_date()), *([] if otherwise is None else [F.lit(otherwise)]))


def zscore(x: Column | str, constant: float | None = None) -> Column:
    """(x - mean) / std; a constant cross-section gives NULL, or ``constant``."""
    x = col(x)
    z = div(x - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date()))
    return z if constant is None else F.when(x.isNotNull(), F.coalesce(z, F.lit(constant)))


def mad_winsorise(x: Column | str, times: float = 5.0) -> Column:
    """Clips to median +- ``times`` median absolute deviations; a deviation of 0 clips nothing.  The median must be a column already."""
    x = col(x)
    mid, mad = F.col("_median"), F.median(F.abs(x - F.col("_median"))).over(by_date())
    return F.when(mad > 0, F.greatest(F.least(x, mid + times * mad), mid - times * mad)).otherwise(x)


def mad_winsorised(df: DataFrame, x: str, times: float = 5.0) -> DataFrame:
    return df.withColumn("_median", F.median(x).over(by_date())).withColumn(x, F.when(F.col(x).isNotNull(), mad_winsorise(x, times))).drop("_median")


def size_neutral(y: Column | str, size: Column | str, least: int = 3) -> Column:
    """Residual of y on size per date; with fewer than ``least`` pairs NULL."""
    y, s = col(y), col(size)
    pair = y.isNotNull() & s.isNotNull()
    a, b = F.when(pair, y), F.when(pair, s)
    slope = div(F.covar_samp(a, b).over(by_date()), F.var_samp(b).over(by_date()))
    resid = (y - F.avg(a).over(by_date())) - F.coalesce(slope, F.lit(0.0)) * (s - F.avg(b).over(by_date()))
    return F.when(pair & (F.count(a).over(by_date()) >= least), resid)


def industry_neutral(df: DataFrame, y: str, size: str, industry: str, out: str, least: int = 3) -> DataFrame:
    """Residual of y on size and industry dummies per date.

    By the Frisch-Waugh theorem: y and size lose their industry means, then one slope per
    date remains.  With as many regressors as names, y loses its mean only; without size
    variation inside industries the slope is 0.
    """
    pair = F.col(y).isNotNull() & F.col(size).isNotNull()
    ind = Window.partitionBy("dt", industry)
    d = df.withColumn("_y", F.when(pair, F.col(y))).withColumn("_s", F.when(pair, F.col(size)))
    d = d.withColumn("_ry", F.col("_y") - F.avg("_y").over(ind)).withColumn("_rs", F.col("_s") - F.avg("_s").over(ind))
    first = F.row_number().over(Window.partitionBy("dt", industry).orderBy(F.col("_y").isNull(), "symbol")) == 1
    d = d.withColumn("_g", F.when(first & F.col("_y").isNotNull(), F.lit(1)))
    w = by_date()
    n, p = F.count("_y").over(w), F.count("_g").over(w) + 1
    slope = F.coalesce(div(F.sum(F.col("_ry") * F.col("_rs")).over(w), F.sum(F.col("_rs") * F.col("_rs")).over(w)), F.lit(0.0))
    resid = F.when(n <= p, F.col("_y") - F.avg("_y").over(w)).otherwise(F.col("_ry") - slope * F.col("_rs"))
    return d.withColumn(out, F.when((n >= least) & F.col("_y").isNotNull(), resid)).drop("_y", "_s", "_ry", "_rs", "_g")


def long_form(panel: DataFrame, factors: Sequence[str], keep: Sequence[str] = ("dt", "symbol")) -> DataFrame:
    """(keep, factor, value): one row for each factor, without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors])
    return panel.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.factor", "p.value")


def valid_dates(panel: DataFrame, factors: Sequence[str], least: int = 5) -> DataFrame:
    """Dates on which every factor has at least ``least`` values."""
    counts = panel.groupBy("dt").agg(*[F.count(f).alias(f) for f in factors])
    test = F.lit(True)
    for f in factors:
        test = test & (F.col(f) >= least)
    return counts.where(test).select("dt")


def factor_rank_ic(long: DataFrame, least: int = 5) -> DataFrame:
    """(dt, factor, ic) of (dt, symbol, factor, value, fwd): Spearman, NULL for few names or constant sides."""
    pairs = long.where("value IS NOT NULL AND fwd IS NOT NULL")
    keys = ["dt", "factor"]
    ranked = pairs.withColumn("rv", average_rank("value", among=keys)).withColumn("rf", average_rank("fwd", among=keys))
    ic = ranked.groupBy(*keys).agg(correlation(F.col("rv"), F.col("rf")).alias("ic"), F.count(F.lit(1)).alias("n"))
    return ic.withColumn("ic", F.when(F.col("n") >= least, F.col("ic"))).select("dt", "factor", "ic")


def rank_icir_weights(ic: DataFrame, window: int = 24, least: int = 6) -> DataFrame:
    """(dt, factor, weight): the ICIR of the rows before a date, floored at 0 and scaled to sum 1 per date; if nothing is
    positive, equal weights over the factors with enough history."""
    past = Window.partitionBy("factor").orderBy("dt").rowsBetween(-window, -1)
    enough = F.count("ic").over(past) >= least
    score = F.when(enough, F.greatest(F.coalesce(div(F.avg("ic").over(past), F.stddev_samp("ic").over(past)), F.lit(0.0)), F.lit(0.0)))
    d = ic.withColumn("score", score)
    w = Window.partitionBy("dt")
    total, known = F.sum("score").over(w), F.count("score").over(w)
    return d.withColumn("weight", F.when(F.col("score").isNull(), None).when(total > 0, F.col("score") / total).otherwise(F.lit(1.0) / known)).select("dt", "factor", "weight")


def stabilised(weights: DataFrame, least: int = 3) -> DataFrame:
    """Dates with fewer than ``least`` positive weights get equal weights over the known ones, or none."""
    w = Window.partitionBy("dt")
    positive, known = F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)).over(w), F.count("weight").over(w)
    weight = F.when(positive >= least, F.col("weight")).when((known >= least) & F.col("weight").isNotNull(), F.lit(1.0) / known)
    return weights.withColumn("_w", weight).select("dt", "factor", F.col("_w").alias("weight"))


def combined(long: DataFrame, weights: DataFrame, least: int = 3, out: str = "score") -> DataFrame:
    """Weighted mean of the factors that a symbol has, if at least ``least``."""
    both = long.join(weights, ["dt", "factor"]).where("value IS NOT NULL AND weight IS NOT NULL")
    agg = both.groupBy("dt", "symbol").agg(div(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias(out), F.count(F.lit(1)).alias("n"))
    return agg.where(F.col("n") >= least).select("dt", "symbol", out)


def long_short(panel: DataFrame, factor: str, ret: str, share: float = 0.2, least: int = 5) -> DataFrame:
    """Mean return of the top less the bottom ``share`` of names by factor, per date."""
    d = panel.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    n = F.count(F.lit(1)).over(by_date())
    k = F.greatest(F.lit(1), F.floor(n * F.lit(share)))
    up = F.row_number().over(Window.partitionBy("dt").orderBy(F.desc(factor), "symbol"))
    down = F.row_number().over(Window.partitionBy("dt").orderBy(factor, "symbol"))
    d = d.withColumn("_top", up <= k).withColumn("_low", down <= k).withColumn("_n", n).where(F.col("_n") >= least)
    return d.groupBy("dt").agg((F.avg(F.when(F.col("_top"), F.col(ret))) - F.avg(F.when(F.col("_low"), F.col(ret)))).alias("long_short"))


def quantile_spread(panel: DataFrame, factor: str, ret: str, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    """Mean return at or above the ``hi`` quantile less that at or below the ``lo``; NULL with fewer than two names."""
    d = panel.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    d = d.withColumn("_lo", F.percentile(factor, lo).over(by_date())).withColumn("_hi", F.percentile(factor, hi).over(by_date()))
    spread = F.avg(F.when(F.col(factor) >= F.col("_hi"), F.col(ret))) - F.avg(F.when(F.col(factor) <= F.col("_lo"), F.col(ret)))
    return d.groupBy("dt").agg(F.when(F.count(F.lit(1)) >= 2, spread).alias("spread"))
