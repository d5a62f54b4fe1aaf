"""Composite factors: the quality family and factor rotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import div, finite
from ..sources.staging import durable
from . import alignment as A
from . import crosssection as X
from .factors import GROWTH, PROFIT, quality_subfactors

#: The ninth sub-factor: dividends of the last year over market value.
DIVIDEND = "dividend_ratio"
#: The variants of the quality family: sub-factors, equal weights, and whether the increase is blended in.
VARIANTS = {
    "quality": ((*PROFIT, *GROWTH, DIVIDEND), False, True),
    "quality_equal_weight": ((*PROFIT, *GROWTH, DIVIDEND), True, True),
    "profitability": (PROFIT, False, False),
    "growth": (GROWTH, False, False),
}


def clean_scores(long: DataFrame, size: str | None = None, industry: str | None = None) -> DataFrame:
    """(.., factor, value) with each factor clipped at 1 and 99 percent, filled with the date's median and standardised; with ``size``,
    neutralised and standardised again.  All factors go through the same few windows.

    Names with an ``industry`` are neutralised by size and industry, names without one by size alone, each among
    themselves; with fewer than three names, or as many regressors as names, they lose their mean only.  Unknown sizes
    count as the median one; sizes that are unknown throughout or all the same don't count.  Scores have ten decimals: the order in which sums are
    made decides no ranks later."""
    by = Window.partitionBy("dt", "factor")
    scored = lambda d: d.withColumn("value", F.round(div(F.col("value") - F.avg("value").over(by), F.stddev_samp("value").over(by)), 10))
    d = long.withColumn("value", finite(F.col("value")))
    d = d.withColumn("_lo", F.percentile("value", 0.01).over(by)).withColumn("_hi", F.percentile("value", 0.99).over(by))
    d = d.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.least("value", "_hi"), "_lo"))).drop("_lo", "_hi")
    d = scored(d.withColumn("value", F.coalesce("value", F.median("value").over(by))))
    if size is None:
        return d
    # Frisch-Waugh: value and size lose their group means, then one slope per date, factor and side remains.
    d = d.withColumn("_ind", F.col(industry).cast("string") if industry else F.lit(None).cast("string")).withColumn("_has", F.col("_ind").isNotNull())
    side, group = Window.partitionBy("dt", "factor", "_has"), Window.partitionBy("dt", "factor", "_has", "_ind")
    y = F.col("value")
    known = F.when(y.isNotNull(), F.col(size))
    d = d.withColumns({"_k": F.count(known).over(side), "_same": F.max(known).over(side) == F.min(known).over(side), "_mid": F.median(known).over(side)})
    use = (F.col("_k") >= 3) & ~F.col("_same")
    d = d.withColumn("_s", F.when(y.isNotNull(), F.when(use, F.coalesce(F.col(size), F.col("_mid"))).otherwise(F.lit(0.0))))
    d = d.withColumn("_ry", y - F.avg(y).over(group)).withColumn("_rs", F.col("_s") - F.avg("_s").over(group))
    groups = F.when(F.col("_has"), F.size(F.collect_set(F.when(y.isNotNull(), F.col("_ind"))).over(side))).otherwise(F.lit(1))
    n, columns = F.count(y).over(side), groups + F.coalesce(use, F.lit(False)).cast("int")
    slope = F.coalesce(div(F.sum(F.col("_ry") * F.col("_rs")).over(side), F.sum(F.col("_rs") * F.col("_rs")).over(side)), F.lit(0.0))
    resid = F.when((n < 3) | (columns >= n), y - F.avg(y).over(side)).otherwise(F.col("_ry") - slope * F.col("_rs"))
    resid = F.when(F.count(y).over(by) >= 3, resid)
    return scored(d.withColumn("value", resid).drop("_ind", "_has", "_k", "_same", "_mid", "_s", "_ry", "_rs"))


def dividend_ratio(panel: DataFrame, cap: str, dividends: DataFrame | None = None, statements: DataFrame | None = None, paid: str = "dividends_paid", days: int = 365) -> DataFrame:
    """``panel`` with ``dividend_ratio``: dividends of the last ``days`` over a positive ``cap``.

    They come from events (dt, symbol, dividend), a name without any having paid nothing; without events from what statements
    say was paid, where a name without a statement is null."""
    made = lambda total: F.when(F.col(cap) > 0, div(total, F.col(cap)))
    if dividends is not None:
        return A.trailing_sum(panel, dividends, "dividend", days, "_ttm").withColumn(DIVIDEND, made(F.coalesce("_ttm", F.lit(0.0)))).drop("_ttm")
    if statements is None or paid not in statements.columns:
        return panel.withColumn(DIVIDEND, F.lit(None).cast("double"))
    stated = statements.select("symbol", "dt", F.col(paid).alias("dividend")).where("dividend IS NOT NULL")
    some = stated.select("symbol").distinct().withColumn("_some", F.lit(True))
    out = A.trailing_sum(panel, stated, "dividend", days, "_ttm").join(some, "symbol", "left")
    return out.withColumn(DIVIDEND, made(F.when(F.col("_some"), F.coalesce("_ttm", F.lit(0.0))))).select(*panel.columns, DIVIDEND)


def forward_on_dates(closes: DataFrame) -> DataFrame:
    """(dt, symbol, fwd): return to the next signal date, closes carried forward over gaps."""
    w = Window.partitionBy("symbol").orderBy("dt")
    filled = closes.withColumn("_c", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.select("dt", "symbol", (div(F.lead("_c").over(w), "_c") - 1).alias("fwd"))


def increase(scores: DataFrame, lag: str = "report") -> DataFrame:
    """(dt, symbol, increase): against the comparable report of a year before (``report``), or so many dates before (``4q``, ``12m``)."""
    if lag == "report":
        return year_on_year(scores)
    back = F.lag("score", {"4q": 4, "12m": 12}[lag]).over(Window.partitionBy("symbol").orderBy("dt"))
    return scores.select("dt", "symbol", (F.col("score") - back).alias("increase"))


def year_on_year(scores: DataFrame) -> DataFrame:
    """(dt, symbol, increase) of (dt, symbol, score, report_date): less the last score that belonged to the report of a year before.

    The lookup spans the whole sample, so it can hold a score dated later; where it gives nothing at all, the score four dates before is used.
    """
    by_report = Window.partitionBy("symbol", "report_date").orderBy(F.desc("dt"))
    known = scores.where("score IS NOT NULL AND report_date IS NOT NULL")
    last = known.withColumn("_n", F.row_number().over(by_report)).where("_n = 1").select("symbol", F.col("report_date").alias("_rd"), F.col("score").alias("_then"))
    yoy = scores.withColumn("_rd", F.add_months("report_date", -12)).join(last, ["symbol", "_rd"], "left").select("dt", "symbol", (F.col("score") - F.col("_then")).alias("increase"))
    if yoy.where("increase IS NOT NULL").isEmpty():
        w = Window.partitionBy("symbol").orderBy("dt")
        yoy = scores.select("dt", "symbol", (F.col("score") - F.lag("score", 4).over(w)).alias("increase"))
    return yoy


def quality_composite(
    panel: DataFrame,
    statements: DataFrame,
    variant: str = "quality",
    industry: DataFrame | None = None,
    window: int = 24,
    least: int = 6,
    members: DataFrame | None = None,
    dividends: DataFrame | None = None,
    lag: str = "report",
) -> DataFrame:
    """(dt, symbol, value) from a panel of signal dates (dt, symbol, close, size, the log of market value, and ``cap``, that value) and statements.

    Sub-factors as of each date, cleaned on dates where all have five names; weights by their past rank ICIR; and for
    the blended variants the same again over the score and its increase (see ``increase``).  ``members`` are dated snapshots
    (dt, symbol): names of the latest snapshot at or before any signal date stay; without such a snapshot all do.
    The dividend sub-factor needs ``dividends`` or statements with ``dividends_paid``; without either, the variants that
    hold it do without.
    """
    names, equal, blend = VARIANTS[variant]
    if DIVIDEND in names and dividends is None and "dividends_paid" not in statements.columns:
        names = tuple(n for n in names if n != DIVIDEND)
    if members is not None:
        kept = durable(A.members_as_of(panel.select("dt").distinct(), members), "quality-members")
        if not kept.isEmpty():
            panel = panel.join(kept, "symbol", "left_semi")
    fwd = forward_on_dates(panel.select("dt", "symbol", "close"))
    stated = [n for n in names if n != DIVIDEND]
    base = A.as_of(panel.select("dt", "symbol", "size", *(["cap"] if DIVIDEND in names else [])), quality_subfactors(statements), ["report_date", *stated])
    if DIVIDEND in names:
        base = dividend_ratio(base, "cap", dividends, statements)
    base = base.join(X.valid_dates(base, names), "dt", "left_semi")
    if industry is not None:
        base = base.join(industry.select("symbol", "industry"), "symbol", "left")
    keep = ("dt", "symbol", "report_date", "size", *(["industry"] if industry is not None else []))
    clean = clean_scores(X.long_form(base, names, keep), "size", "industry" if industry is not None else None)
    long = durable(clean.join(fwd, ["dt", "symbol"], "left"), "quality-clean")
    if equal:
        score = long.where("value IS NOT NULL").groupBy("dt", "symbol").agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
    else:
        score = X.combined(long, X.stabilised(X.rank_icir_weights(X.factor_rank_ic(long), window, least)))
    if not blend:
        return score.withColumnRenamed("score", "value")
    cells = long.where(F.col("factor") == names[0]).select("dt", "symbol", "report_date", "fwd")
    scored = durable(cells.join(score, ["dt", "symbol"], "left"), "quality-score")
    both = scored.join(increase(scored, lag), ["dt", "symbol"])
    both = both.join(X.valid_dates(both, ["score", "increase"]), "dt", "left_semi")
    pair = durable(clean_scores(X.long_form(both, ["score", "increase"], ("dt", "symbol", "fwd"))), "quality-pair")
    return X.combined(pair, X.rank_icir_weights(X.factor_rank_ic(pair), window, least), 1).withColumnRenamed("score", "value")


def rotation_weights(returns: DataFrame, names: Sequence[str], window: int = 60, least: int = 5) -> DataFrame:
    """(dt, factor, weight) of factor returns (dt, factor, ret): by the rank of each factor's mean over the ``window`` dates before.

    With fewer than ``least`` factors known a date takes the last weights, and before any equal ones.  Ties rank in the order of ``names``.
    """
    past = Window.partitionBy("factor").orderBy("dt").rowsBetween(-window, -1)
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("factor"))
    d = returns.withColumn("_m", F.avg("ret").over(past))
    day = Window.partitionBy("dt")
    d = d.withColumn("_k", F.count("_m").over(day)).withColumn("_r", F.row_number().over(day.orderBy(F.col("_m").desc_nulls_last(), order)))
    ranked = F.when(F.col("_m").isNull(), F.lit(0.0)).otherwise((F.col("_k") - F.col("_r") + 1) / (F.col("_k") * (F.col("_k") + 1) / F.lit(2.0)))
    d = d.withColumn("_w", F.when(F.col("_k") >= least, ranked))
    upto = Window.partitionBy("factor").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("dt", "factor", F.coalesce(F.last("_w", ignorenulls=True).over(upto), F.lit(1.0 / len(names))).alias("weight"))


def factor_rotation(panel: DataFrame, names: Sequence[str], ret: str = "fwd", window: int = 60, least_factors: int = 5, least_stock: int = 3) -> DataFrame:
    """(dt, symbol, value): factors combined by rotation weights, on the path that needs no ordinal model.

    The return of a factor on a date is that of the names it ranks highest less those it ranks lowest, and
    is known from the next date on.
    """
    long = X.long_form(panel, names, ("dt", "symbol", ret))
    good = long.where(F.col("value").isNotNull() & F.col(ret).isNotNull())
    by = Window.partitionBy("dt", "factor")
    good = good.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.2)))
    good = good.withColumn("_u", F.row_number().over(by.orderBy(F.desc("value"), "symbol"))).withColumn("_d", F.row_number().over(by.orderBy("value", "symbol"))).where("_n >= 5")
    spread = F.avg(F.when(F.col("_u") <= F.col("_k"), F.col(ret))) - F.avg(F.when(F.col("_d") <= F.col("_k"), F.col(ret)))
    dates = panel.select("dt").distinct()
    every = dates.select("dt", F.explode(F.array(*[F.lit(n) for n in names])).alias("factor"))
    returns = every.join(good.groupBy("dt", "factor").agg(spread.alias("ret")), ["dt", "factor"], "left")
    weights = rotation_weights(returns, names, window, least_factors)
    scored = panel.select("dt", "symbol", *names)
    for n in names:
        scored = scored.withColumn(n, X.winsorise(n)).withColumn(n, X.zscore(n))
    rows = X.long_form(scored, names)
    return X.combined(rows, weights.where("weight > 0"), least_stock).withColumnRenamed("score", "value")
