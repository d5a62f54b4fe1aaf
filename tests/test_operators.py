"""Operators against known values and plain numpy or pandas versions."""

import datetime as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import alignment as A
from panelforge.operators import crosssection as X
from panelforge.operators import evaluate as E
from panelforge.operators import factors as Fa
from panelforge.operators import ml as M
from panelforge.operators import portfolio as P
from panelforge.plans.pipelines import SelectionPipeline, StrategyPipeline, TimingPipeline
from panelforge.sources import panels as S
from panelforge.sources import sinks
from panelforge.streaming.bars import tumbling_bars

DAY = D.date(2020, 1, 1)


def days(n):
    return [d.date() for d in pd.bdate_range(DAY, periods=n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def walk(spark, n=80, k=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(k):
        c = 100 * np.exp(np.cumsum(0.01 * rng.standard_normal(n)))
        rows += [(d, f"S{s}", float(x * 0.999), float(x * 1.01), float(x * 0.98), float(x), 1000.0 + i, float(x * (1000 + i))) for i, (d, x) in enumerate(zip(days(n), c, strict=True))]
    return frame(spark, rows, "dt date, symbol string, open double, high double, low double, close double, volume double, amount double")


def test_trades_follow_a_day_later_in_whole_shares(spark):
    px = [100.0, 110.0, 121.0, 133.1]
    bars = frame(spark, [(d, "A", p, 1e6) for d, p in zip(days(4), px, strict=True)], "dt date, symbol string, close double, volume double")
    w = bars.select("dt", "symbol", F.lit(1.0).alias("weight"))
    sim = P.simulate(w, bars, capital=1000.0, commission=0.0, slippage=0.0)
    daily = sim.daily.orderBy("dt").toPandas()
    assert daily.ret.tolist() == pytest.approx([0, 0, 0.099, 9 * 12.1 / 1099])
    first = sim.trades.orderBy("dt").first()
    assert (first.shares, first.price) == (9, 110.0)


def test_registry_knows_what_factors_need(spark):
    from panelforge.operators.factors import REGISTRY
    from panelforge.sources.panels import without_annual_rows

    beta = next(x for x in REGISTRY.details() if x["name"] == "capm_beta")
    assert beta["needs"] == ["market_cap"] and beta["kind"] == "selection" and beta["description"].startswith("Rolling beta")
    assert {x["kind"] for x in REGISTRY.details()} == {"selection", "timing"}
    rows = frame(spark, [("A", 0), ("A", 1), ("A", None)], "symbol string, fiscal_quarter int")
    assert [r.fiscal_quarter for r in without_annual_rows(rows).collect()] == [1, None] and without_annual_rows(rows.select("symbol")).count() == 3


def test_simulator_sells_before_it_buys(spark):
    d = days(4)
    bars = frame(spark, [(x, s, 10.0) for x in d for s in "AB"], "dt date, symbol string, close double")
    w = frame(spark, [(d[0], "A", 1.0), (d[0], "B", 0.0), (d[1], "A", 0.0), (d[1], "B", 1.0), (d[2], "A", 0.0), (d[2], "B", 1.0), (d[3], "A", 0.0), (d[3], "B", 1.0)], "dt date, symbol string, weight double")
    got = P.simulate(w, bars, capital=100.0, commission=0, slippage=0).trades.orderBy("dt", "shares").select("symbol", "shares").collect()
    assert [tuple(r) for r in got] == [("A", 10), ("A", -10), ("B", 10)]


def test_simulator_records(spark):
    """Costs, carried weights and prices, negative weights, a name without a price, and a date without bars of the held name."""
    d = days(4)
    bars = frame(spark, [(d[0], "A", 10.0), (d[0], "B", 5.0), (d[1], "A", 20.0), (d[2], "B", 5.0), (d[3], "A", 0.0), (d[3], "B", 5.0)], "dt date, symbol string, adj_close double").withColumn("close", F.lit(1.0))
    w = frame(spark, [(d[0], "A", 0.5), (d[0], "B", -0.5), (d[0], "C", 0.5)], "dt date, symbol string, weight double")
    sim = P.simulate(w, bars, capital=1000.0, commission=0.01, slippage=0.02)
    daily = sim.daily.orderBy("dt").collect()
    bought = int(500 // (20 * 1.03))
    less = int(0.5 * (1000 - 0.6 * bought) // (20 * 1.03))  # the carried weight of what costs have left
    assert [r.bought for r in daily] == [0, bought, 0, 0] and [r.notional for r in daily] == [0, 20.0 * bought, 20.0 * (bought - less), 0]
    assert (daily[1].commission, daily[1].slippage, daily[1].cost) == pytest.approx((0.2 * bought, 0.4 * bought, 0.6 * bought))
    assert daily[1].equity == pytest.approx(1000 - 0.6 * bought) and daily[1].nav == pytest.approx(daily[1].equity / 1000)
    assert daily[3].sold == less and daily[3].equity == pytest.approx(daily[2].cash)  # at a price of 0 there is no target
    held = sim.positions.where(F.col("dt") == F.lit(d[2])).collect()
    assert [(r.symbol, r.shares) for r in held] == [("A", less)] and held[0].weight == pytest.approx(20.0 * less / daily[2].equity)
    trade = sim.trades.orderBy("dt").first()
    assert (trade.action, trade.position_after) == ("buy", bought) and trade.cash_after == pytest.approx(daily[1].cash)
    with pytest.raises(ValueError):
        P.simulate(w, bars, capital=0.0)


def test_timing_against_a_benchmark(spark):
    d = days(5)
    closes = frame(spark, [(x, s, c) for s, cs in (("A", (10.0, 11.0, 12.1, 13.31, 14.641)), ("Z", (5.0, 5.0, 5.0, 5.5, 5.5))) for x, c in zip(d, cs, strict=True)], "dt date, symbol string, close double")
    signals = closes.where("symbol = 'A'").select("dt", "symbol", F.lit(1.0).alias("signal"))
    bench = P.benchmark_nav(P.benchmark_close(closes, "Z"))
    assert [r.nav for r in bench.orderBy("dt").collect()] == pytest.approx([1, 1, 1, 1.1, 1.1])
    assert [r.close for r in P.benchmark_close(closes).orderBy("dt").collect()] == [10.0, 11.0, 12.1, 13.31, 14.641]
    got = P.timing_summary(signals, closes, benchmark=bench).first()
    excess = np.array([0, 0.1, 0.1 - 0.1, 0.1])
    assert got.excess_annual == pytest.approx(np.prod(1 + excess) ** (252 / 4) - 1) and got.excess_calmar == 0
    alone = P.timing_summary(signals, closes).first()
    assert alone.excess_annual == pytest.approx(alone.annual_return)


def test_rebalance_returns(spark):
    d = days(5)
    rows = [(d[i], "A", 10.0 + i, 10.5 + i) for i in range(5)] + [(d[i], "B", 20.0 + 2 * i, 20.5 + 2 * i) for i in range(5)]
    bars = frame(spark, rows, "dt date, symbol string, open double, close double")
    sig = frame(spark, [(d[0],), (d[2],), (d[4],)], "dt date")
    got = {(r.dt, r.symbol): r.fwd_ret for r in E.rebalance_returns(bars, sig).collect()}
    assert got == pytest.approx({(d[0], "A"): 12.5 / 11 - 1, (d[2], "A"): 14.5 / 13 - 1, (d[0], "B"): 24.5 / 22 - 1, (d[2], "B"): 28.5 / 26 - 1})


def two_groups(spark, low, high):
    d = days(3)
    rows = [(d[i], f"S{s}", float(s), (low if s < 2 else high)[i]) for i in range(3) for s in range(4)]
    return frame(spark, rows, "dt date, symbol string, factor double, fwd_ret double")


def test_layered_drawdowns_and_annual_figures(spark):
    res = E.layered_backtest(two_groups(spark, (0.10, -0.20, 0.05), (0.10, -0.10, 0.02)), q=2)
    assert (res.long_drawdown, res.short_drawdown) == pytest.approx((-0.10, -0.05))
    s = E.layered_backtest(two_groups(spark, (0.0, 0.0, 0.0), (0.06, 0.03, 0.05)), q=2, period=5).summary.where("grp = 2").first()
    r = np.array([0.06, 0.03, 0.05])
    assert s.annual == pytest.approx(np.prod(1 + r) ** (252 / 5 / 3) - 1)
    assert s.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * np.sqrt(252 / 5))
    bad = E.layered_backtest(two_groups(spark, (0.0, 0.0, 0.0), (-3.0, 0.1, 0.1)), q=2)
    assert bad.excess_annual is None and bad.excess_calmar == 0
    assert E.layers(two_groups(spark, (0.0,) * 3, (0.0,) * 3), q=5).count() == 0


def test_ic_edges(spark):
    d = days(1)[0]
    schema = "dt date, symbol string, factor double, fwd_ret double"
    assert E.ic_series(frame(spark, [(d, s, float(i), float(i)) for i, s in enumerate("ABCD")], schema)).first().ic == pytest.approx(1)
    assert E.ic_series(frame(spark, [(d, s, float(i), -float(i)) for i, s in enumerate("ABCD")], schema)).first().ic == pytest.approx(-1)
    assert E.ic_series(frame(spark, [(d, "A", 1.0, 1.0), (d, "B", 2.0, 2.0)], schema)).first().ic is None
    assert E.ic_series(frame(spark, [(d, s, 1.0, float(i)) for i, s in enumerate("ABCD")], schema)).first().ic is None


def test_icir_and_t(spark):
    x = np.array([0.1, 0.2, 0.15, 0.05, 0.1])
    ic = frame(spark, list(zip(days(5), x.tolist(), strict=True)), "dt date, ic double")
    s = E.ic_summary(ic, 1).first()
    assert s.icir == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(252))
    t, p = E.t_test(s.ic_mean, s.ic_std, s.n)
    assert t == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(5)))
    assert p == pytest.approx(0.009253, abs=2e-4)  # t of 4.706 with four degrees of freedom
    assert E.t_test(None, None, 0) == (None, None)


def test_turnover_of_static_and_switching_factors(spark):
    d = days(2)
    schema = "dt date, symbol string, factor double"
    few = frame(spark, [(x, s, float(i)) for x in d for i, s in enumerate("ABC")], schema)
    assert [r.turnover for r in E.turnover(few).collect()] == [0, 0]
    flip = frame(spark, [(d[j], s, float(i if j == 0 else -i)) for j in range(2) for i, s in enumerate("ABCDE")], schema)
    assert [r.turnover for r in E.turnover(flip).orderBy("dt").collect()] == [0, 1]


@pytest.mark.parametrize("n,q", [(5, 2), (7, 5), (23, 5), (40, 2)])
def test_groups_are_those_of_pandas(spark, n, q):
    v = np.random.default_rng(n).permutation(n).astype(float)
    df = frame(spark, [(DAY, f"S{i:03d}", x) for i, x in enumerate(v.tolist())], "dt date, symbol string, factor double")
    got = df.withColumn("g", E.quantile_group("factor", q)).orderBy("symbol").toPandas().g
    assert got.tolist() == (pd.qcut(pd.Series(v).rank(method="first"), q, labels=False) + 1).tolist()


def test_rsi(spark):
    rise = frame(spark, [(d, "A", float(i + 1)) for i, d in enumerate(days(30))], "dt date, symbol string, close double")
    last = Fa.rsi(rise).orderBy(F.desc("dt")).first()
    assert (last.rsi, last.signal) == (0.0, 1.0)
    assert Fa.rsi(rise, fixed=True).orderBy(F.desc("dt")).first().rsi == 100.0
    x = pd.Series(100 + np.random.default_rng(0).standard_normal(60).cumsum())
    d = x.diff()
    g, lo = d.clip(lower=0).ewm(com=13, min_periods=14).mean(), (-d.clip(upper=0)).ewm(com=13, min_periods=14).mean()
    want = 100 - 100 / (1 + g / lo)
    got = Fa.rsi(frame(spark, list(zip(days(60), ["A"] * 60, x.tolist(), strict=True)), "dt date, symbol string, close double")).orderBy("dt").toPandas().rsi
    np.testing.assert_allclose(got.astype(float), want, atol=1e-9)


def test_beta_recovers_slopes(spark):
    rng, n = np.random.default_rng(7), 320
    m = 0.01 * rng.standard_normal(n)
    rows = []
    for name, r, cap in (("B2", 2 * m, 1.0), ("B05", 0.5 * m, 1.0), ("M", m, 1e12)):
        c = 100 * np.cumprod(1 + r)
        rows += [(d, name, float(x), cap) for d, x in zip(days(n), c, strict=True)]
    p = frame(spark, rows, "dt date, symbol string, close double, market_cap double")
    out = Fa.capm_beta(p).where("value IS NOT NULL").toPandas().sort_values("dt").groupby("symbol").value.last()
    assert out["B2"] == pytest.approx(2, abs=0.05) and out["B05"] == pytest.approx(0.5, abs=0.05)
    assert Fa.capm_beta(p, lookback=10, least=20).where("value IS NOT NULL").count() == 0


def test_three_factor_residuals_equal_least_squares(spark):
    rng, n = np.random.default_rng(1), 30
    f = 0.01 * rng.standard_normal((n, 3))
    r = f @ [1.0, 0.5, -0.3] + 0.01 * rng.standard_normal(n)
    c = 100 * np.cumprod(1 + r)
    d = days(n)
    p = frame(spark, [(x, "A", float(v)) for x, v in zip(d, c, strict=True)], "dt date, symbol string, close double")
    t = [frame(spark, [(x, float(v)) for x, v in zip(d, f[:, i], strict=True)], f"dt date, {name} double") for i, name in enumerate(("mkt", "smb", "hml"))]
    got = Fa.three_factor_volatility(p, t[1], t[2], t[0]).orderBy(F.desc("dt")).first().value
    xs = np.c_[np.ones(20), f[-20:]]
    res = r[-20:] - xs @ np.linalg.lstsq(xs, r[-20:], rcond=None)[0]
    assert got == pytest.approx(res.std(ddof=1) * np.sqrt(252), rel=1e-9)


def test_industry_neutral_equals_dummies(spark):
    rng, n = np.random.default_rng(2), 40
    y, s, ind = rng.standard_normal(n), rng.standard_normal(n), rng.integers(0, 4, n)
    df = frame(spark, [(DAY, f"S{i:02d}", float(y[i]), float(s[i]), f"I{ind[i]}") for i in range(n)], "dt date, symbol string, y double, s double, industry string")
    got = X.industry_neutral(df, "y", "s", "industry", "r").orderBy("symbol").toPandas().r
    xs = np.c_[s, np.eye(4)[ind]]
    np.testing.assert_allclose(got, y - xs @ np.linalg.lstsq(xs, y, rcond=None)[0], atol=1e-10)


def test_weights_fall_back_to_equal(spark):
    ic = frame(spark, [(d, f, -0.1 - 0.01 * i if f == "a" else -0.2 + 0.01 * i) for i, d in enumerate(days(10)) for f in "ab"], "dt date, factor string, ic double")
    last = X.rank_icir_weights(ic).where(F.col("dt") == days(10)[-1]).collect()
    assert [r.weight for r in last] == [0.5, 0.5]
    assert X.rank_icir_weights(ic).where(F.col("dt") == days(10)[2]).first().weight is None


def test_as_of_and_trailing_sum(spark):
    left = frame(spark, [(D.date(2020, 1, k), "A") for k in (1, 5, 9)], "dt date, symbol string")
    right = frame(spark, [(D.date(2020, 1, 5), "A", 1.0), (D.date(2020, 1, 8), "A", 2.0)], "dt date, symbol string, v double")
    assert [r.v for r in A.as_of(left, right, ["v"]).orderBy("dt").collect()] == [None, 1.0, 2.0]
    assert [r.total for r in A.trailing_sum(left, right, "v", 4).orderBy("dt").collect()] == [None, 1.0, 2.0]


def test_grid_and_empty_panels(spark):
    bars = walk(spark, 5, 2).where("NOT (symbol = 'S1' AND close IS NOT NULL AND day(dt) = 2)")
    assert A.dense_grid(bars).count() == 10
    assert A.dense_grid(bars.limit(0)).count() == 0


def test_resample_drops_symbols_that_end_early(spark):
    d = [D.date(2020, 1, 6), D.date(2020, 1, 7), D.date(2020, 1, 10)]
    rows = [(x, "A", None if i == 0 else 1.0 + i, 9.0, 0.5, 2.0 + i, 10.0) for i, x in enumerate(d)] + [(d[0], "B", 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = A.resample(frame(spark, rows, "dt date, symbol string, open double, high double, low double, close double, volume double"), "week").collect()
    assert [(r.symbol, r.dt, r.open, r.close, r.volume) for r in got] == [("A", d[2], 2.0, 4.0, 30.0)]


def test_registry():
    r = Fa.Registry()
    r.register("x", lambda g: g)
    with pytest.warns(UserWarning):
        r.register("x", lambda g: g)
    with pytest.raises(ValueError):
        r.register("", lambda g: g)
    with pytest.raises(KeyError):
        r.get("y")
    assert len([n for n in Fa.REGISTRY.names() if n.startswith("alpha158_")]) == 158


def test_missing_values_are_normalised(spark):
    df = frame(spark, [("2020-01-01", "A", float("nan")), ("2020-01-02", "A", float("inf")), ("2020-01-03", "A", 1.0)], "day string, code string, close double")
    out = S.standardise(df, {"day": "dt", "code": "symbol"}).orderBy("dt").collect()
    assert [r.close for r in out] == [None, None, 1.0]
    assert S.restricted(S.standardise(df, {"day": "dt", "code": "symbol"}), start="2020-01-02", end="2020-01-02").count() == 1


def test_upsert_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "symbol string, dt date, close double, year int"
    sinks.upsert_partitions(frame(spark, [("A", D.date(2020, 1, 1), 1.0, 2020), ("A", D.date(2021, 1, 1), 5.0, 2021)], schema), path, ["symbol", "dt"], "year")
    sinks.upsert_partitions(frame(spark, [("A", D.date(2020, 1, 1), 2.0, 2020), ("B", D.date(2020, 1, 1), 3.0, 2020)], schema), path, ["symbol", "dt"], "year")
    got = {(r.symbol, r.year): r.close for r in spark.read.parquet(path).collect()}
    assert got == {("A", 2020): 2.0, ("B", 2020): 3.0, ("A", 2021): 5.0}
    assert "| a |" in sinks.markdown([{"a": 1.0}])


def test_auc_and_linear_models(spark):
    df = frame(spark, [(0.1, -1), (0.4, -1), (0.35, 1), (0.8, 1)], "score double, label int")
    assert M.auc(df).first().auc == pytest.approx(0.75)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 2))
    y = x @ [1.0, -2.0]
    rows = frame(spark, [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    model, importance = M.linear_model(rows, ["a", "b"], "y", alpha=1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-3)
    assert importance[0][0] == "b"


def test_flows(spark):
    bars = walk(spark, 90)
    report = SelectionPipeline(bars, start="2020-02-15", rebalance="week").add("momentum_5", "alpha158_ma5").run(q=2)
    assert set(report) == {"momentum_5", "alpha158_ma5"} and report["momentum_5"]["period"] == 5
    sig = A.dense_grid(bars).select("dt", "symbol", Fa.momentum(5).alias("signal"))
    out = StrategyPipeline(bars, sig, k=2).run()
    stats = out["stats"].first()
    assert stats.n == 90 and out["trades"].count() > 0
    assert TimingPipeline(bars).run()["ma_cross_timing"].count() == 6


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    t0 = D.datetime(2020, 1, 1)
    rows = [(i, t0 + D.timedelta(minutes=7 * i), "x" if i % 2 else "y", float(i % 11)) for i in range(60)]
    events = frame(spark, rows, "event_id long, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = tumbling_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_test").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("bars_test").collect()}
    assert got == {tuple(r) for r in tumbling_bars(events).collect()}


def test_entry_imports_without_the_optional_package():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['panelforge.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'ic_series_rank' in e.queries(); assert not any(n.startswith('op1_') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
