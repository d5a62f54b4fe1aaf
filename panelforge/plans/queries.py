"""Registered queries of the core library: one for each operator, over panels derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import symbols as Y
from ..functions.expressions import by_symbol, div, pct_change, pct_change_padded
from ..operators import alignment as A
from ..operators import composites as C
from ..operators import crosssection as X
from ..operators import evaluate as E
from ..operators import factors as Fa
from ..operators import features as Fe
from ..operators import kernel_svm as K
from ..operators import ml as M
from ..operators import portfolio as P
from ..sources import catalog as T
from ..sources import panels as S
from ..streaming import bars as B
from .oracles import ORACLES

QUERIES: dict = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Rounded for comparison.  A small shift keeps quotients of whole cents off the ties, and adding 0 turns a negative zero into a zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(2.3e-10), 6) + F.lit(0.0) for c in cols})


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return A.dense_grid(S.monthly_bars(spark, sf))


def week_grid(spark: SparkSession, sf: str) -> DataFrame:
    return A.dense_grid(S.weekly_bars(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum over five months, and the next month's return from open to close."""
    lead = lambda c: F.lead(c).over(by_symbol())
    return grid(spark, sf).select("dt", "symbol", pct_change("close", 5).alias("factor"), (div(lead("close"), lead("open")) - 1).alias("fwd_ret"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).where("factor IS NOT NULL AND fwd_ret IS NOT NULL")


def capped(spark: SparkSession, sf: str) -> DataFrame:
    total = F.sum("amount").over(by_symbol().rowsBetween(-11, 0))
    return grid(spark, sf).select("dt", "symbol", pct_change("close", 5).alias("factor"), F.when(total > 0, F.log(total)).alias("size"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-weight returns; derived prices jump, so a hundredth of them."""
    return grid(spark, sf).withColumn("r", pct_change("close")).where("r IS NOT NULL").groupBy("dt").agg((F.avg("r") / 100).alias("ret"))


def factor_panel(spark: SparkSession, sf: str) -> DataFrame:
    lead = lambda c: F.lead(c).over(by_symbol())
    return grid(spark, sf).select("dt", "symbol", pct_change("close").alias("m1"), pct_change("close", 3).alias("m3"), div(F.col("high") - F.col("low"), "close").alias("spread"), F.col("volume").alias("vol"), (div(lead("close"), lead("open")) - 1).alias("fwd"))


FACTORS = ("m1", "m3", "spread", "vol")


@query("panel_monthly_bars")
def _(spark, sf):
    return r6(S.monthly_bars(spark, sf), "open", "high", "low", "close").withColumn("amount", F.round("amount", 2))


@query("scan_filtered")
def _(spark, sf):
    out = S.restricted(S.monthly_bars(spark, sf), [1, 2, 3, 4, 5], "1997-01-01", "1998-12-31", [3])
    return r6(out, "close").select("dt", "symbol", "close")


QUERIES["scan_symbols"] = lambda spark, sf: S.symbols_of(S.monthly_bars(spark, sf))


@query("scan_statements_delayed")
def _(spark, sf):
    out = S.restricted(S.quarterly_statements(spark, sf), start="1999-01-01")
    return out.select("symbol", "dt", "report_date", F.round("revenue", 2).alias("revenue"), F.round("net_income", 2).alias("net_income"))


QUERIES["dense_grid"] = lambda spark, sf: r6(grid(spark, sf).select("dt", "symbol", "i", "close"), "close")
QUERIES["ic_series_rank"] = lambda spark, sf: r6(E.ic_series(pairs(spark, sf)), "ic")
QUERIES["ic_series_pearson"] = lambda spark, sf: r6(E.ic_series(pairs(spark, sf), method="pearson"), "ic")
QUERIES["ic_summary"] = lambda spark, sf: r6(E.ic_summary(E.ic_series(pairs(spark, sf)), 21), "ic_mean", "ic_std", "icir", "t_stat", "positive_ratio")
QUERIES["yearly_ic"] = lambda spark, sf: r6(E.yearly_ic(E.ic_series(pairs(spark, sf))), "ic_mean", "ic_std", "icir", "positive_ratio")
QUERIES["ic_decay"] = lambda spark, sf: r6(E.ic_decay(panel(spark, sf), most=6), "ic")
QUERIES["forward_returns"] = lambda spark, sf: r6(E.forward_returns(grid(spark, sf), (1, 5)), "fwd_1", "fwd_5")


@query("rebalance_returns")
def _(spark, sf):
    bars = S.monthly_bars(spark, sf)
    return r6(E.rebalance_returns(bars, A.calendar(bars).where(F.month("dt").isin(1, 4, 7, 10))), "fwd_ret")


QUERIES["layers"] = lambda spark, sf: r6(E.layers(pairs(spark, sf)), "ret")
QUERIES["layer_summary"] = lambda spark, sf: r6(E.layer_summary(E.layers(pairs(spark, sf)).withColumn("ret", F.col("ret") / 100), period=21), "total", "annual", "sharpe")
QUERIES["layer_spreads"] = lambda spark, sf: r6(E.spread_series(E.layers(pairs(spark, sf))), "top", "short", "excess")
QUERIES["layer_extremes"] = lambda spark, sf: r6(E.layer_extremes(E.spread_series(E.layers(pairs(spark, sf)).withColumn("ret", F.col("ret") / 100)), period=21), "long_drawdown", "short_drawdown", "excess_annual", "excess_drawdown", "excess_calmar")
QUERIES["rolling_ic"] = lambda spark, sf: r6(E.rolling_ic(E.ic_series(pairs(spark, sf)), 12), "ic")
QUERIES["pct_change_padded"] = lambda spark, sf: r6(grid(spark, sf).select("dt", "symbol", pct_change_padded("close", 3).alias("change")), "change")
QUERIES["drawdown"] = lambda spark, sf: r6(E.drawdown(series(spark, sf)).select("dt", "wealth", "drawdown"), "wealth", "drawdown")
QUERIES["turnover"] = lambda spark, sf: r6(E.turnover(panel(spark, sf)), "turnover")
QUERIES["top_holdings"] = lambda spark, sf: E.top_holdings(panel(spark, sf))


@query("features_kline")
def _(spark, sf):
    made = Fe.kline()
    return r6(grid(spark, sf).select("dt", "symbol", *[c.alias(n) for n, c in made.items()]), *made)


@query("features_price")
def _(spark, sf):
    made = Fe.price()
    return r6(grid(spark, sf).select("dt", "symbol", *[c.alias(n) for n, c in made.items()]), *made)


def _rolling(prefix: str):
    def run(spark, sf):
        made = {f"{prefix}{n}": Fe.ROLLING[prefix](n) for n in Fe.WINDOWS}
        return r6(Fe.derived(week_grid(spark, sf)).select("dt", "symbol", *[c.alias(n) for n, c in made.items()]), *made)

    return run


for _p in Fe.ROLLING:
    QUERIES[f"rolling_{_p}"] = _rolling(_p)
for _n in (5, 10, 20):
    QUERIES[f"momentum_{_n}"] = lambda spark, sf, n=_n: r6(Fa.REGISTRY.get(f"momentum_{n}")(grid(spark, sf)), "value")
for _n in ("volatility_20", "highlow_spread_20"):
    QUERIES[_n] = lambda spark, sf, n=_n: r6(Fa.REGISTRY.get(n)(week_grid(spark, sf)), "value")
for _r in ("month", "half_month"):
    QUERIES[f"resample_{_r}"] = lambda spark, sf, r=_r: r6(A.resample(S.weekly_bars(spark, sf), r), "open", "high", "low", "close")


@query("features_all_158")
def _(spark, sf):
    """All features in one pass."""
    return r6(Fe.features(week_grid(spark, sf)), *Fe.feature_names())


@query("as_of_statements")
def _(spark, sf):
    out = A.as_of(grid(spark, sf).select("dt", "symbol"), S.quarterly_statements(spark, sf), ["report_date", "net_income"])
    return out.withColumn("net_income", F.round("net_income", 2))


@query("trailing_dividends")
def _(spark, sf):
    return A.trailing_sum(grid(spark, sf).select("dt", "symbol"), S.dividends(spark, sf), "dividend", 365, "ttm").withColumn("ttm", F.round(F.col("ttm") + F.lit(3.1e-5), 2))


@query("upsert_keep_last")
def _(spark, sf):
    bars = S.monthly_bars(spark, sf).select("dt", "symbol", "close")
    return r6(A.upsert(bars, bars.where("dt >= DATE'2000-01-01'").withColumn("close", F.col("close") * 2), ["dt", "symbol"]), "close")


@query("universe_active")
def _(spark, sf):
    day = F.to_date("l_shipdate")
    listing = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.min(day).alias("list_date"), F.max(day).alias("delist_date"))
    return S.active_universe(listing, "1995-01-10", "1995-02-01")


@query("universe_pending_anti")
def _(spark, sf):
    done = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_shipdate < TIMESTAMP'1995-01-05'").select(F.col("l_suppkey").alias("symbol"))
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("symbol")).join(done, "symbol", "left_anti")


@query("membership_as_of")
def _(spark, sf):
    best = Window.partitionBy("quarter").orderBy(F.desc("revenue"), "symbol")
    snaps = S.quarterly_statements(spark, sf).withColumn("n", F.row_number().over(best)).where("n <= 5").select(F.col("quarter").alias("dt"), "symbol")
    dates = spark.createDataFrame([("1996-05-05",), ("1998-02-01",), ("2000-11-11",)], "dt string").select(F.to_date("dt").alias("dt"))
    return A.members_as_of(dates, snaps)


@query("winsor_zscore")
def _(spark, sf):
    d = capped(spark, sf).withColumn("v", X.winsorise("factor")).withColumn("v", X.median_filled("v"))
    return r6(d.select("dt", "symbol", X.zscore("v").alias("z")), "z")


QUERIES["mad_winsor"] = lambda spark, sf: r6(X.mad_winsorised(capped(spark, sf), "factor").select("dt", "symbol", "factor"), "factor")
QUERIES["size_neutral"] = lambda spark, sf: r6(capped(spark, sf).select("dt", "symbol", X.size_neutral("factor", "size").alias("resid")), "resid")


@query("industry_neutral")
def _(spark, sf):
    d = capped(spark, sf).where("factor IS NOT NULL AND size IS NOT NULL").join(S.industries(spark, sf), "symbol")
    return r6(X.industry_neutral(d, "factor", "size", "industry", "resid").select("dt", "symbol", "resid"), "resid")


def _long(spark, sf):
    return X.long_form(factor_panel(spark, sf), FACTORS, ("dt", "symbol", "fwd"))


QUERIES["valid_dates"] = lambda spark, sf: X.valid_dates(factor_panel(spark, sf), FACTORS)
QUERIES["factor_rank_ic"] = lambda spark, sf: r6(X.factor_rank_ic(_long(spark, sf)), "ic")
QUERIES["rank_icir_weights"] = lambda spark, sf: r6(X.rank_icir_weights(X.factor_rank_ic(_long(spark, sf))), "weight")


@query("combined_score")
def _(spark, sf):
    long = _long(spark, sf)
    return r6(X.combined(long, X.rank_icir_weights(X.factor_rank_ic(long))), "score")


QUERIES["long_short_return"] = lambda spark, sf: r6(X.long_short(pairs(spark, sf), "factor", "fwd_ret"), "long_short")
QUERIES["quantile_spread"] = lambda spark, sf: r6(X.quantile_spread(pairs(spark, sf), "factor", "fwd_ret"), "spread")


@query("capm_beta")
def _(spark, sf):
    p = grid(spark, sf).withColumnRenamed("amount", "market_cap")
    return r6(Fa.capm_beta(p, lookback=24, least=12, month_end=False), "value")


@query("three_factor_volatility")
def _(spark, sf):
    p = grid(spark, sf).withColumn("ret", pct_change("close"))
    size = X.quantile_spread(p, "amount", "ret").select("dt", (-F.col("spread")).alias("smb"))
    value = X.quantile_spread(p, "volume", "ret").select("dt", F.col("spread").alias("hml"))
    return r6(Fa.three_factor_volatility(p, size, value, Fa.market_returns(p, "amount")), "value")


@query("quality_subfactors")
def _(spark, sf):
    return r6(Fa.quality_subfactors(S.quarterly_statements(spark, sf)), *Fa.PROFIT, *Fa.GROWTH)


@query("quality_increase")
def _(spark, sf):
    q = Fa.quality_subfactors(S.quarterly_statements(spark, sf)).select("dt", "symbol", F.col("roeq").alias("score"))
    return r6(Fa.quality_increase(q), "increase")


def _quality(variant: str, dated: bool = False):
    """Market values are a year's trades; a third of the names have no industry."""

    def run(spark, sf):
        total = F.sum("amount").over(by_symbol().rowsBetween(-11, 0))
        signal = grid(spark, sf).select("dt", "symbol", "close", total.alias("cap"), F.when(total > 0, F.log(total)).alias("size"))
        industry = S.industries(spark, sf).select("symbol", F.when(F.col("symbol") % 3 > 0, F.col("industry")).alias("industry"))
        quarters = S.quarterly_statements(spark, sf)
        best = Window.partitionBy("quarter").orderBy(F.desc("revenue"), "symbol")
        members = quarters.withColumn("n", F.row_number().over(best)).where("n <= 8").select(F.col("quarter").alias("dt"), "symbol") if dated else None
        return r6(C.quality_composite(signal, quarters, variant, industry, members=members, dividends=S.dividends(spark, sf)), "value")

    return run


for _v in C.VARIANTS:
    QUERIES[f"composite_{_v}"] = _quality(_v)
QUERIES["composite_members"] = _quality("profitability", True)


@query("factor_rotation")
def _(spark, sf):
    return r6(C.factor_rotation(factor_panel(spark, sf), FACTORS, least_factors=3), "value")


def _weights(spark, sf):
    return P.top_k_weights(grid(spark, sf).withColumn("signal", pct_change("close", 5)))


QUERIES["top_k_weights"] = lambda spark, sf: r6(_weights(spark, sf), "weight")


def _simulation(spark, sf):
    """Derived prices jump by factors, so their logarithms are traded."""
    return P.simulate(_weights(spark, sf), S.monthly_bars(spark, sf).withColumn("close", F.log("close")))


@query("execution_simulation")
def _(spark, sf):
    cents = {c: F.round(c, 2) for c in ("equity", "cash", "notional", "commission", "slippage", "cost")}
    return r6(_simulation(spark, sf).daily.drop("strategy"), "nav", "ret", "turnover").withColumns(cents)


@query("execution_positions")
def _(spark, sf):
    return r6(_simulation(spark, sf).positions, "weight").drop("strategy")


@query("rebalance_records")
def _(spark, sf):
    out = _simulation(spark, sf).rebalance_records.drop("strategy", "balance")
    return r6(out, "price").withColumn("notional", F.round("notional", 2))


_PERF = ("total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown", "calmar", "win_rate", "profit_loss")
QUERIES["performance"] = lambda spark, sf: r6(P.performance(series(spark, sf)), *_PERF).select(*_PERF, "drawdown_days", "n")
QUERIES["monthly_returns"] = lambda spark, sf: r6(P.monthly_returns(series(spark, sf)), "ret")
QUERIES["rolling_sharpe"] = lambda spark, sf: r6(P.rolling_sharpe(series(spark, sf), 12), "sharpe")


@query("benchmark_excess")
def _(spark, sf):
    one = grid(spark, sf).where("symbol = 1").select("dt", pct_change("close").alias("ret"))
    return r6(P.excess(series(spark, sf), one), "excess")


QUERIES["ma_cross"] = lambda spark, sf: S.weekly_bars(spark, sf).select("dt", "symbol", Fa.ma_cross().alias("signal"))
QUERIES["rsi"] = lambda spark, sf: r6(Fa.rsi(S.weekly_bars(spark, sf)), "rsi")


def _timed(spark, sf):
    bars = S.weekly_bars(spark, sf)
    return bars.select("dt", "symbol", Fa.ma_cross().alias("signal")), bars


def _damped(spark, sf):
    return S.weekly_bars(spark, sf).withColumn("close", F.log("close"))


QUERIES["timing_nav"] = lambda spark, sf: r6(P.timing_returns(*_timed(spark, sf), scale=0.01).select("symbol", "dt", "ret", "nav"), "ret", "nav")
QUERIES["benchmark_nav"] = lambda spark, sf: r6(P.benchmark_nav(P.benchmark_close(_damped(spark, sf))), "ret", "nav")


@query("timing_summary")
def _(spark, sf):
    one = P.benchmark_nav(P.benchmark_close(_damped(spark, sf), 3))
    made = ("direction_win_rate", *_PERF, "excess_annual", "excess_calmar")
    return r6(P.timing_summary(*_timed(spark, sf), scale=0.01, benchmark=one), *made).select("symbol", *made, "drawdown_days", "n")


QUERIES["class_labels"] = lambda spark, sf: M.class_labels(panel(spark, sf)).select("dt", "symbol", "label")
QUERIES["time_folds"] = lambda spark, sf: M.time_folds(A.calendar(S.monthly_bars(spark, sf)))

@query("stale_symbols")
def _(spark, sf):
    listing = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("symbol"), F.lit(None).cast("date").alias("delist_date"))
    return S.stale_symbols(S.monthly_bars(spark, sf), listing, "2001-12-01")


def _catalog(spark, sf) -> T.Catalog:
    """The star schema as raw tables of a panel database."""
    bars, statements = S.monthly_bars(spark, sf), S.quarterly_statements(spark, sf)
    line = {c.removeprefix("_"): v for c, v in Fe.kline().items()}
    best = Window.partitionBy("quarter").orderBy(F.desc("revenue"), "symbol")
    events = spark.read.parquet(f"{sf}/events.parquet")
    frames = {
        "market": bars,
        "etf": bars.where("symbol <= 3"),
        "fundamental": statements.select("symbol", F.col("report_date").alias("date"), (F.col("revenue") / F.col("total_assets")).alias("ps"), F.col("equity").alias("market_cap"), F.col("cost_revenue").alias("ignored")),
        "alpha158": A.dense_grid(bars).select("dt", "symbol", "close", *[c.alias(n) for n, c in line.items()]),
        "statement": statements.select("symbol", "report_date", "filing_date", "revenue", "net_income"),
        "macro": events.groupBy(F.to_date("ts").cast("string").alias("dt"), F.col("event_type").alias("series_id")).agg(
            F.date_format(F.min("ts"), "yyyy-MM-dd").alias("observation_date"), F.max("value").alias("value"), F.lit("unit").alias("units"), F.count(F.lit(1)).alias("n")
        ),
        "sp500_constituents": statements.withColumn("k", F.row_number().over(best)).where("k <= 5").select("symbol", F.col("quarter").alias("dt"), F.when(F.col("k") == 1, F.lit("unknown")).otherwise(F.col("quarter").cast("string")).alias("updated_at")),
        "industry": S.industries(spark, sf).select("symbol", F.col("industry").alias("sector"), "book"),
    }
    return T.Catalog.of_frames(spark, frames, blocked=(3,))


QUERIES["table_market"] = lambda spark, sf: r6(_catalog(spark, sf).table("market", [1, 2, 3, 4], "1996-01-01", "1997-06-30").select("dt", "symbol", "close", "adj_close"), "close", "adj_close")
QUERIES["table_etf"] = lambda spark, sf: r6(_catalog(spark, sf).table("etf", [9], "1996-01-01").select("dt", "symbol", "close"), "close")
QUERIES["table_fundamental"] = lambda spark, sf: r6(_catalog(spark, sf).table("fundamental", end="2000-12-31"), "ps", "market_cap")
QUERIES["table_macro"] = lambda spark, sf: r6(_catalog(spark, sf).table("macro"), "value").withColumn("observation_date", F.to_date("observation_date"))
QUERIES["table_constituents"] = lambda spark, sf: _catalog(spark, sf).table("sp500_constituents", start="1997-01-01").withColumn("updated_at", F.to_date("updated_at"))
QUERIES["table_industry"] = lambda spark, sf: _catalog(spark, sf).table("industry", [1, 2, 3])
QUERIES["preload_ranges"] = lambda spark, sf: _catalog(spark, sf).preload_ranges("1996-03-15")


@query("table_alpha158")
def _(spark, sf):
    out = _catalog(spark, sf).table("alpha158", start="1998-01-01")
    return r6(out, *[c for c in out.columns if c not in ("dt", "symbol")])


@query("table_statement")
def _(spark, sf):
    out = _catalog(spark, sf).table("statement", start="1999-01-01", end="2000-03-31")
    return out.select("dt", "symbol", "report_date", F.round("revenue", 2).alias("revenue"), F.round("net_income", 2).alias("net_income"))


@query("preload_rows")
def _(spark, sf):
    parts = [d.groupBy().agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last")) for n, d in _catalog(spark, sf).preload("1996-03-15").items()]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


@query("report_rows")
def _(spark, sf):
    """Statements as a site would print them: slashes in dates, separators in numbers, dashes for what is missing."""
    q = S.quarterly_statements(spark, sf)
    raw = q.select(
        F.concat(F.lit(" "), F.col("symbol").cast("string")).alias("Code"), F.date_format("report_date", "yyyy/M/d").alias("Report date"), F.when(F.col("symbol") % 5 == 0, F.lit("--")).otherwise(F.date_format("filing_date", "yyyyMMdd")).alias("Filed"),
        F.format_number("revenue", 2).alias("Revenue"), F.when(F.col("net_income") > 1e6, F.lit("n/a")).otherwise(F.round("net_income", 2).cast("string")).alias("Net"), F.lit("x").alias("Extra"),
    )
    names = {"Code": "symbol", "Report date": "report_date", "Filed": "filing_date", "Revenue": "revenue", "Net": "net_income", "Absent": "equity"}
    return T.report_rows(raw, names)


@query("month_end_panel")
def _(spark, sf):
    return r6(M.month_end_panel(week_grid(spark, sf), ["close"]), "close")


@query("forward_excess")
def _(spark, sf):
    bars = S.monthly_bars(spark, sf).withColumn("close", F.log("close"))
    quarters = A.calendar(bars).where(F.month("dt").isin(1, 4, 7, 10)).select("dt")
    return r6(M.forward_excess(bars, bars.where("symbol = 1").select("dt", "close"), quarters), "fwd_ret", "excess")


def _labelled(spark, sf):
    made = factor_panel(spark, sf)
    return M.supervised(made, M.class_labels(made, "fwd"), FACTORS)


QUERIES["supervised_set"] = lambda spark, sf: r6(_labelled(spark, sf), *FACTORS)


@query("classifier_figures")
def _(spark, sf):
    return r6(M.classifier_figures(_labelled(spark, sf).withColumn("score", F.col("m3") - 1)), "auc", "accuracy")


@query("complete_dates")
def _(spark, sf):
    d = S.quarterly_statements(spark, sf)
    return M.gate_complete_dates(Fa.quality_subfactors(d).select("dt", "symbol", "roeq", "droeq"), ["roeq", "droeq"]).select("dt", "symbol")


@query("svm_scores")
def _(spark, sf):
    """A Gaussian-kernel machine on cleaned factors, and its scores: beyond SQL, so counted only; the tests hold it against a plain fit."""
    raw = factor_panel(spark, sf)
    ready = M.preprocessed(raw.dropna(subset=list(FACTORS)), FACTORS)
    trained = K.train_pipeline(ready, M.class_labels(raw, "fwd", least=8), FACTORS, costs=(1.0,), gammas=(0.05,), width=64, rounds=10)
    return K.selection_scores(raw.dropna(subset=list(FACTORS)), trained, FACTORS)


@query("symbol_codes")
def _(spark, sf):
    code = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    d = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", code.alias("code"))
    return d.select("p_partkey", Y.with_suffix(F.col("code")).alias("suffixed"), Y.with_prefix(F.col("code")).alias("prefixed"))


@query("benchmark_forward")
def _(spark, sf):
    damped = S.weekly_bars(spark, sf).withColumn("close", F.log("close"))
    return r6(E.benchmark_forward(damped), "total")


QUERIES["event_bars"] = lambda spark, sf: r6(B.tumbling_bars(spark.read.parquet(f"{sf}/events.parquet")), "open", "high", "low", "close")

__all__ = ["ORACLES", "QUERIES"]
