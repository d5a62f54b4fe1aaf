"""Composite factors against plain numpy and pandas versions."""

import datetime as D

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelforge.functions.expressions import ewm_means
from panelforge.operators import composites as C

DATES = [d.date() for d in pd.date_range("2015-01-31", periods=40, freq="ME")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scores_equal_dummy_regression(spark):
    rng, n = np.random.default_rng(4), 30
    y, s, ind = rng.standard_normal(n), rng.standard_normal(n), rng.integers(0, 3, n)
    df = frame(spark, [(DATES[0], f"S{i:02d}", "f", float(y[i]), float(s[i]), f"I{ind[i]}") for i in range(n)], "dt date, symbol string, factor string, value double, size double, industry string")
    got = C.clean_scores(df, "size", "industry").orderBy("symbol").toPandas().value
    v = np.clip(y, *np.quantile(y, [0.01, 0.99]))
    v = (v - v.mean()) / v.std(ddof=1)
    x = np.c_[s, np.eye(3)[ind]]
    r = v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
    np.testing.assert_allclose(got, (r - r.mean()) / r.std(ddof=1), atol=1e-9)


def test_missing_values_take_the_median_and_constant_dates_none(spark):
    rows = [(DATES[0], f"S{i}", "f", v) for i, v in enumerate([1.0, None, 3.0, float("inf")])] + [(DATES[1], "S0", "f", 5.0), (DATES[1], "S1", "f", 5.0)]
    got = C.clean_scores(frame(spark, rows, "dt date, symbol string, factor string, value double")).orderBy("dt", "symbol").collect()
    assert got[1].value == got[3].value and got[4].value is None


def test_rotation_weights_follow_past_means(spark):
    rng = np.random.default_rng(1)
    names, rows = ["a", "b", "c"], []
    r = rng.standard_normal((12, 3))
    rows = [(DATES[i], n, float(r[i, j])) for i in range(12) for j, n in enumerate(names)]
    got = C.rotation_weights(frame(spark, rows, "dt date, factor string, ret double"), names, window=5, least=3).toPandas().pivot(index="dt", columns="factor", values="weight")
    for i in range(12):
        hist = r[max(0, i - 5) : i]
        want = np.full(3, 1 / 3) if i == 0 else (4 - pd.Series(hist.mean(0)).rank(ascending=False, method="first")) / 6
        np.testing.assert_allclose(got.loc[DATES[i]], want, atol=1e-12)


def test_year_on_year_and_its_fallback(spark):
    schema = "dt date, symbol string, report_date date, score double"
    rows = [(D.date(2020, 2, 1), "A", D.date(2019, 12, 31), 1.0), (D.date(2020, 3, 1), "A", D.date(2019, 12, 31), 2.0), (D.date(2021, 2, 1), "A", D.date(2020, 12, 31), 5.0)]
    got = {r.dt: r.increase for r in C.year_on_year(frame(spark, rows, schema)).collect()}
    assert got[D.date(2021, 2, 1)] == 3.0 and got[D.date(2020, 2, 1)] is None
    rows = [(d, "A", None, float(i)) for i, d in enumerate(DATES[:6])]
    got = [r.increase for r in C.year_on_year(frame(spark, rows, schema)).orderBy("dt").collect()]
    assert got == [None] * 4 + [4.0, 4.0]


def test_quality_composite_prefers_what_pays(spark):
    """One quality ordering that predicts returns: the composite ranks names by it."""
    n, rows, stm = 12, [], []
    for i in range(n):
        c = 100.0
        for k, d in enumerate(DATES):
            rows.append((d, f"S{i:02d}", c, 10.0 + (i * 7 % 5)))
            c *= 1 + 0.002 * i + 0.001 * ((k * i) % 3)
            if k % 3 == 0:
                rev = 100.0 + k
                stm.append((f"S{i:02d}", d, d, rev, rev * (0.9 - 0.03 * i), rev * (0.05 + 0.01 * i), 50.0, 20.0))
    panel = frame(spark, rows, "dt date, symbol string, close double, size double")
    statements = frame(spark, stm, "symbol string, dt date, report_date date, revenue double, cost_revenue double, net_income double, total_assets double, equity double").withColumn("gross_profit", F.lit(None).cast("double"))
    last = C.quality_composite(panel, statements, "profitability").where(F.col("dt") == DATES[-2]).orderBy("symbol").toPandas()
    assert len(last) == n and pd.Series(last.value).rank().corr(pd.Series(range(n), dtype=float)) > 0.9
    assert C.quality_composite(panel, statements, "quality").columns == ["dt", "symbol", "value"]


def test_ewm_means_over_blocks(spark):
    """Against pandas, over more rows than a block holds, with gaps, for slow and fast decay."""
    r = np.random.default_rng(3)
    rows = [(s, i, None if r.random() < 0.1 else float(r.normal())) for s in ("A", "B") for i in range(1300)]
    df = spark.createDataFrame(rows, "symbol string, dt int, x double")
    for alpha in (1 / 14, 0.001, 0.9, 1.0):
        got = ewm_means(df, {"m": F.col("x")}, alpha, 5).toPandas().sort_values(["symbol", "dt"])
        for _, g in got.groupby("symbol"):
            want = g["x"].ewm(alpha=alpha, adjust=True, min_periods=5).mean().where(g["x"].notna())
            np.testing.assert_allclose(g["m"].astype(float), want, atol=1e-9)
    assert pd.notna(got["m"]).any()


def test_names_without_industry_are_neutralised_apart(spark):
    r = np.random.default_rng(4)
    n = 24
    size, value = r.normal(10, 1, n), r.normal(0, 1, n)
    ind = [None if i % 3 == 0 else f"i{i % 2}" for i in range(n)]
    gone = 5  # one size is unknown and counts as the median of its side
    rows = [("2020-01-31", f"S{i:02d}", None if i == gone else float(size[i]), ind[i], "f", float(value[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "dt string, symbol string, size double, industry string, factor string, value double")
    got = np.array([x.value for x in C.clean_scores(df, "size", "industry").orderBy("symbol").collect()])
    y = np.clip(value, *np.quantile(value, [0.01, 0.99]))
    y = (y - y.mean()) / y.std(ddof=1)
    want = np.zeros(n)
    for has in (True, False):
        at = np.array([i for i in range(n) if (ind[i] is not None) == has])
        s = size[at].copy()
        if gone in at:
            s[at == gone] = np.median(s[at != gone])
        x = np.column_stack([np.ones(len(at)), s, *([[ind[i] == "i1" for i in at]] if has else [])]).astype(float)
        want[at] = y[at] - x @ np.linalg.lstsq(x, y[at], rcond=None)[0]
    want = (want - want.mean()) / want.std(ddof=1)
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_dividend_ratio_sources(spark):
    panel = spark.createDataFrame([(D.date(2020, 6, 1), "A", 10.0), (D.date(2020, 6, 1), "B", 0.0), (D.date(2020, 6, 1), "C", 4.0)], "dt date, symbol string, cap double")
    paid = spark.createDataFrame([(D.date(2020, 6, 1), "A", -1.0), (D.date(2019, 6, 3), "A", 1.0), (D.date(2019, 6, 2), "A", 9.0)], "dt date, symbol string, dividend double")
    rows = {r.symbol: r.dividend_ratio for r in C.dividend_ratio(panel, "cap", paid).collect()}
    assert rows == {"A": 0.2, "B": None, "C": 0.0}
    stated = paid.withColumnRenamed("dividend", "dividends_paid")
    assert {r.symbol: r.dividend_ratio for r in C.dividend_ratio(panel, "cap", None, stated).collect()} == {"A": 0.2, "B": None, "C": None}
    assert {r.dividend_ratio for r in C.dividend_ratio(panel, "cap").collect()} == {None}


def test_increase_lags(spark):
    rows = [(D.date(2020, 1, 1) + D.timedelta(days=31 * i), "A", float(i * i), None) for i in range(13)]
    df = spark.createDataFrame(rows, "dt date, symbol string, score double, report_date date")
    last = lambda lag: C.increase(df, lag).orderBy(F.desc("dt")).first().increase
    assert (last("4q"), last("12m")) == (144.0 - 64.0, 144.0)
