"""The table catalog, tolerant readers, and the learning flow."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import kernel_svm as K
from panelforge.operators import ml as M
from panelforge.sources import catalog as T


def test_folder_catalog_prunes_and_tolerates(spark, tmp_path):
    rows = [("A", "2020-01-02", 1.0, 9), ("A", "2021-01-04", float("nan"), 9), ("XAUUSD", "2021-01-04", 2.0, 9)]
    bars = spark.createDataFrame(rows, "symbol string, dt string, close double, other int").withColumn("dt", F.to_date("dt"))
    bars.write.partitionBy("dt").parquet(f"{tmp_path}/market")
    c = T.Catalog.of_folder(spark, str(tmp_path))
    got = c.table("market", start="2021-01-01")
    assert [(r.symbol, r.dt, r.close, r.adj_close) for r in got.collect()] == [("A", dt.date(2021, 1, 4), None, None)] and "other" not in got.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "other" not in plan
    assert c.table("sp500_constituents").count() == 0 and c.table("industry").columns == ["symbol"]
    with pytest.raises(KeyError):
        c.table("macro")
    assert set(c.load()) == {"market", "sp500_constituents", "industry"}
    assert [tuple(r) for r in c.preload_ranges("2021-01-01").collect()] == [("market", dt.date(2020, 1, 2), dt.date(2020, 12, 31))]
    assert c.preload("2021-01-01")["market"].count() == 1 and c.preload_ranges("2020-01-02").count() == 0


def test_statements_move_by_their_delay(spark):
    raw = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("A", dt.date(2020, 3, 1)), ("B", None)], "symbol string, filing_date date")
    c = T.Catalog.of_frames(spark, {"statement": raw})
    assert [r.dt for r in c.table("statement", start="2020-02-01", end="2020-02-28").collect()] == [dt.date(2020, 2, 15)]
    assert c.table("statement").count() == 2


def test_tolerant_readers(spark):
    raw = spark.createDataFrame([("A ", "2020/1/31", "1,234.5", "3%"), ("B", "20200131", "--", ""), (None, "2020-01-31", "1", "1"), ("C", "soon", "1", "1")], "c string, d string, x string, y string")
    got = T.report_rows(raw, {"c": "symbol", "d": "report_date", "x": "revenue", "y": "margin"}).orderBy("symbol").collect()
    assert [tuple(r) for r in got] == [("A", dt.date(2020, 1, 31), 1234.5, 3.0), ("B", dt.date(2020, 1, 31), None, None)]
    bars = spark.createDataFrame([("2020-01-02", "1", "x"), ("bad", "1", "2"), ("2020-01-03", "--", "2")], "day string, last string, volume string")
    got = T.clean_bars(bars.withColumn("symbol", F.lit(7)), {"day": "dt", "last": "close"}).collect()
    assert [(r.dt, r.symbol, r.close, r.volume) for r in got] == [(dt.date(2020, 1, 2), "7", 1.0, None)]


def test_tables_are_created_once(spark):
    assert len(T.create_tables(spark)) == 4 == len(T.create_tables(spark))
    assert spark.table("trade_calendar").dtypes == [("dt", "date"), ("is_open", "boolean")]
    for name in T.SCHEMAS:
        spark.sql(f"DROP TABLE {name}")


def rings(spark, n=600, seed=0):
    """Two classes that no line separates."""
    r = np.random.default_rng(seed)
    angle, label = r.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 2, 1, -1)
    radius = np.where(label > 0, 1.0, 3.0) + r.normal(0, 0.2, n)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i % 20), f"S{i}", float(radius[i] * np.cos(angle[i])), float(radius[i] * np.sin(angle[i])), int(label[i])) for i in range(n)]
    return spark.createDataFrame(rows, "dt date, symbol string, x double, y double, label int")


def test_kernel_machine_separates_rings(spark, tmp_path):
    d = rings(spark)
    trained = K.train_pipeline(d.drop("label"), d.select("dt", "symbol", "label"), ["x", "y"], costs=(1.0,), gammas=(0.001, 0.5), width=128, rounds=20)
    assert trained.machine.gamma == 0.5 and trained.results[0]["valid_auc"] > 0.98 > trained.results[1]["valid_auc"]
    assert len(trained.explained) == 2 and sum(trained.explained) == pytest.approx(1)
    assert sum(trained.results[0][k] for k in ("valid_sample_count", "train_sample_count")) == 600
    scored = trained.score(d)
    assert M.classifier_figures(scored).first().accuracy > 0.97
    trained.machine.save(spark, f"{tmp_path}/machine")
    assert K.KernelSvm.load(spark, f"{tmp_path}/machine") == trained.machine
    with pytest.raises(ValueError):
        K.train_pipeline(d.drop("label"), d.select("dt", "symbol", "label").limit(0), ["x", "y"])
    gap = trained.machine.score(spark.createDataFrame([(1.0, None)], "pc_001 double, pc_002 double")).first()
    assert gap.score is None


def test_components_are_those_of_the_training_rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3)) @ np.diag([3.0, 1.0, 0.1]) + 5
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    transform, explained = M.fit_pca(df, ["a", "b", "c"], share=0.95)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = values[::-1] / values.sum()
    assert len(explained) == 2 and explained == pytest.approx(want[:2])
    got = transform(df).orderBy("id").toPandas()
    mine = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :2]
    np.testing.assert_allclose(np.abs(got[["pc_001", "pc_002"]].to_numpy()), np.abs(mine), atol=1e-8)


def test_split_is_stable_and_stratified(spark):
    d = rings(spark)
    train, valid = M.train_valid(d, 0.2)
    again = M.train_valid(d.repartition(7), 0.2)[1]
    assert {r.symbol for r in valid.collect()} == {r.symbol for r in again.collect()} and train.count() + valid.count() == 600
    share = [valid.where(F.col("label") == x).count() / 300 for x in (1, -1)]
    assert all(0.13 < s < 0.27 for s in share)


def test_forward_excess_and_gates(spark):
    days = [dt.date(2020, m, 28) for m in (1, 2, 3)]
    closes = spark.createDataFrame([(days[0], "A", 10.0), (days[1], "A", 11.0), (days[2], "A", 12.1), (days[0], "B", 5.0), (days[2], "B", 6.0)], "dt date, symbol string, close double")
    bench = spark.createDataFrame([(days[0], 100.0), (days[1], 105.0), (days[2], 105.0)], "dt date, close double")
    got = {(r.dt, r.symbol): (r.fwd_ret, r.excess) for r in M.forward_excess(closes, bench).collect()}
    assert got[days[0], "A"] == pytest.approx((0.1, 0.05)) and got[days[1], "A"] == pytest.approx((0.1, 0.1))
    assert got[days[0], "B"] == (None, None) and got[days[2], "A"] == (None, None)
    assert M.gate_complete_dates(closes.withColumn("v", F.when(F.col("symbol") == "A", 1.0)), ["v"]).select("dt").distinct().collect() == [(days[1],)]


def test_boosted_trees_rank_features(spark):
    d = rings(spark, 300).withColumn("z", F.lit(0.0)).withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).withColumn("out", F.col("label").cast("double"))
    _, importance = M.boosted_trees(d, ["z", "r"], "out", rounds=5)
    assert importance[0][0] == "r"
