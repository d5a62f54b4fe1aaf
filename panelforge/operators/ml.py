"""Learning operators: labels, cleaning, splits, linear models, rank-sum AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import average_rank, by_date, correlation, div
from .crosssection import mad_winsorised, median_filled, size_neutral, zscore


def month_ends(dates: DataFrame) -> DataFrame:
    return dates.groupBy(F.trunc("dt", "MM")).agg(F.max("dt").alias("dt")).select("dt")


def class_labels(panel: DataFrame, ret: str = "fwd_ret", share: float = 0.3, least: int = 30) -> DataFrame:
    """+1 for the top and -1 for the bottom ``share`` of names per date; the others, and dates with few names, go."""
    d = panel.where(F.col(ret).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(by_date())).where(F.col("_n") >= least)
    k = F.floor(F.col("_n") * F.lit(share))
    up = F.row_number().over(Window.partitionBy("dt").orderBy(F.desc(ret), "symbol"))
    down = F.row_number().over(Window.partitionBy("dt").orderBy(ret, "symbol"))
    d = d.withColumn("_up", up).withColumn("_down", down)
    return d.withColumn("label", F.when(F.col("_up") <= k, 1).when(F.col("_down") <= k, -1)).where("label IS NOT NULL").drop("_n", "_up", "_down")


def preprocessed(panel: DataFrame, names: Sequence[str], size: str | None = None) -> DataFrame:
    """MAD clipping, market-median fill, size neutralisation on request, standardisation."""
    out = panel
    for n in names:
        out = mad_winsorised(out, n).withColumn(n, median_filled(n, 0.0))
        if size:
            out = out.withColumn(n, F.coalesce(size_neutral(n, size, 30), F.col(n)))
        out = out.withColumn(n, zscore(n, 0.0))
    return out


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rank-sum AUC in one row; ranks over scores are global, so ties are counted by value first."""
    c = scored.groupBy(score).agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.sum((F.col(label) <= 0).cast("long")).alias("n"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return c.agg(div(F.sum(F.col("p") * (F.col("below") + F.col("n") / F.lit(2.0))), F.sum("p") * F.sum("n")).alias("auc"))


def time_folds(panel: DataFrame, folds: int = 5) -> DataFrame:
    """``fold`` 1..folds of each date's block (0: always training): train on dates of smaller folds, validate on the fold's."""
    dates = panel.select("dt").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy("dt")) - 1
    size = F.floor(n / (folds + 1))
    first = n - size * folds
    return panel.join(dates.withColumn("fold", F.when(k < first, 0).otherwise(F.floor((k - first) / size) + 1).cast("int")), "dt")


def linear_model(train: DataFrame, names: Sequence[str], label: str, kind: str = "ridge", alpha: float = 1.0):
    """Ridge (squared error plus alpha times squared weights) or lasso (half the mean squared error plus alpha times absolute weights).

    Spark's penalty is per row, and its squared part is relative to the label's deviation; ridge's alpha is turned into that.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=list(names), outputCol="_x").transform(train.dropna(subset=[*names, label]))
    n, std = rows.agg(F.count(F.lit(1)), F.stddev_samp(label)).first()
    reg = alpha * (std or 1.0) / n if kind == "ridge" else alpha
    model = LinearRegression(featuresCol="_x", labelCol=label, regParam=reg, elasticNetParam=0.0 if kind == "ridge" else 1.0, standardization=False).fit(rows)
    importance = sorted(zip(names, map(abs, model.coefficients.toArray()), strict=True), key=lambda x: -x[1])
    return model, importance


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation over all rows; for reports on small frames."""
    one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_one", F.lit(1))
    ranked = one.withColumn("_a", average_rank(a, among=["_one"])).withColumn("_b", average_rank(b, among=["_one"]))
    return ranked.agg(correlation(F.col("_a"), F.col("_b")).alias("rho"))


def month_end_panel(panel: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The rows of a panel on the last date of each month, with the named columns (all, if none)."""
    ends = month_ends(panel.select("dt").distinct())
    return panel.join(ends, "dt", "left_semi").select("dt", "symbol", *(columns or [c for c in panel.columns if c not in ("dt", "symbol")]))


def forward_excess(closes: DataFrame, benchmark: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(dt, symbol, fwd_ret, excess): the return from each of ``dates`` (all) to the next, and what it is above that of the
    benchmark (dt, close) between the same dates; null where either close is missing."""
    if dates is not None:
        closes, benchmark = (d.join(dates, "dt", "left_semi") for d in (closes, benchmark))
    order = closes.select("dt").distinct().withColumn("_next", F.lead("dt").over(Window.orderBy("dt")))  # calendar-sized
    step = closes.select("dt", "symbol", "close").join(order, "dt")
    later = closes.select(F.col("dt").alias("_next"), "symbol", F.col("close").alias("_then"))
    own = step.join(later, ["_next", "symbol"], "left").select("dt", "symbol", "_next", (div("_then", "close") - 1).alias("fwd_ret"))
    marks = order.join(benchmark.select("dt", F.col("close").alias("_now")), "dt").join(benchmark.select(F.col("dt").alias("_next"), F.col("close").alias("_then")), "_next")
    marks = marks.select("dt", (div("_then", "_now") - 1).alias("_bench"))
    return own.join(marks, "dt", "left").select("dt", "symbol", "fwd_ret", (F.col("fwd_ret") - F.col("_bench")).alias("excess"))


def supervised(features: DataFrame, labels: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    """Rows that have a label of 1 or -1 and all features finite."""
    whole = F.col(label).isin(1, -1)
    for n in names:
        whole = whole & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) < F.lit(float("inf")))
    return features.select("dt", "symbol", *names).join(labels.select("dt", "symbol", label), ["dt", "symbol"]).where(whole)


def train_valid(rows: DataFrame, share: float = 0.1, seed: int = 42, keys: Sequence[str] = ("dt", "symbol")) -> tuple[DataFrame, DataFrame]:
    """Rows in two parts by a hash of their key: about ``share`` of each label's rows validate, the same on every run and
    for every partitioning."""
    held = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    return rows.where(~held), rows.where(held)


def fit_pca(train: DataFrame, names: Sequence[str], k: int | None = None, share: float | None = None):
    """Principal components of the training rows: (transform, explained).  ``k`` components (all), or as many as explain
    ``share`` of the variance; ``transform`` replaces the features of any frame by ``pc_001`` and so on, centred as the training rows are."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=list(names), outputCol="_x")
    rows = assemble.transform(train)
    model = PCA(k=k or len(names), inputCol="_x", outputCol="_pc").fit(rows)
    explained = [float(x) for x in model.explainedVariance.toArray()]
    if share is not None:
        total, kept = 0.0, 0
        while kept < len(explained) and total < share - 1e-12:
            total, kept = total + explained[kept], kept + 1
        explained = explained[: max(kept, 1)]
    means = train.agg(*[F.avg(n).alias(n) for n in names]).first()
    load = model.pc.toArray()
    shift = [float(sum((means[n] or 0.0) * load[j][i] for j, n in enumerate(names))) for i in range(len(explained))]

    def transform(df: DataFrame) -> DataFrame:
        out = model.transform(assemble.transform(df)).withColumn("_a", vector_to_array("_pc"))
        made = [(F.col("_a")[i] - F.lit(shift[i])).alias(f"pc_{i + 1:03d}") for i in range(len(explained))]
        return out.select(*[c for c in df.columns if c not in names], *made)

    return transform, explained


def classifier_figures(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: AUC of the score, accuracy of its sign (a score of 0 counts as -1), and counts."""
    hit = (F.col(score) > 0) == (F.col(label) > 0)
    up = F.col(label) > 0
    counts = scored.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.when(up, 1)).alias("positive_count"), F.count(F.when(~up, 1)).alias("negative_count"), F.count(F.lit(1)).alias("sample_count"))
    return auc(scored, score, label).crossJoin(counts)  # one row each


def gate_complete_dates(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of dates on which every row has all features."""
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
    bad = panel.groupBy("dt").agg(F.max(missing.cast("int")).alias("_bad")).where("_bad = 0").select("dt")
    return panel.join(bad, "dt", "left_semi")


def boosted_trees(train: DataFrame, names: Sequence[str], label: str, rounds: int = 100, depth: int = 5, step: float = 0.05, seed: int = 42):
    """Gradient-boosted regression trees, and features by importance (of rows with all features and a label)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=list(names), outputCol="_x").transform(train.dropna(subset=[*names, label]))
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(rows)
    return model, sorted(zip(names, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: -x[1])
