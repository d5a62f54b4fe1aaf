"""Grids, calendars, resampling and point-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol

#: Dates in a calendar that may be broadcast: some three hundred years of days.
CALENDAR_ROWS = 100_000


def calendar(df: DataFrame) -> DataFrame:
    return df.select("dt").distinct()


def dense_grid(bars: DataFrame) -> DataFrame:
    """Every symbol on every date, so that windows count dates.

    The calendar's size is bounded by time, not data; it is collected (and checked) and
    exploded for each symbol, so the grid is built without a join, and bars are joined by key.
    """
    dates = [r.dt for r in calendar(bars).orderBy("dt").limit(CALENDAR_ROWS + 1).collect()]
    if len(dates) > CALENDAR_ROWS:
        raise ValueError("a calendar of more than a hundred thousand dates")
    slots = F.array(*[F.lit(d) for d in dates]) if dates else F.array().cast("array<date>")
    cells = bars.select("symbol").distinct().select("symbol", F.posexplode(slots).alias("i", "dt"))
    return cells.join(bars, ["symbol", "dt"], "left")


def as_of(left: DataFrame, right: DataFrame, values: Sequence[str], by: str = "symbol", on: str = "dt") -> DataFrame:
    """``left`` with the latest ``values`` of ``right`` at or before each date: one union, one sort, no range join."""
    both = left.withColumn("_v", F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType)).withColumn("_left", F.lit(1))
    known = right.select(by, on, F.struct(*values).alias("_v")).withColumn("_left", F.lit(0))
    w = Window.partitionBy(by).orderBy(on, "_left").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(known, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left = 1")
    return out.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def trailing_sum(left: DataFrame, events: DataFrame, value: str, days: int = 365, out: str = "total") -> DataFrame:
    """The events in (date - ``days``, date] of each left row, summed in absolute value: a range window over both sides."""
    both = left.withColumn("_v", F.lit(None).cast("double")).withColumn("_left", F.lit(1))
    rows = events.select("symbol", "dt", F.abs(F.col(value)).cast("double").alias("_v")).withColumn("_left", F.lit(0))
    w = Window.partitionBy("symbol").orderBy(F.unix_date("dt")).rangeBetween(-(days - 1), 0)
    return both.unionByName(rows, allowMissingColumns=True).withColumn(out, F.sum("_v").over(w)).where("_left = 1").select(*left.columns, out)


def next_date(dates: DataFrame, trading: DataFrame) -> DataFrame:
    """For each date the first trading date after it; calendar-sized tables."""
    both = dates.select("dt", F.lit(0).alias("_t")).unionByName(trading.select("dt", F.lit(1).alias("_t")))
    nums = both.withColumn("_d", F.unix_date("dt"))
    w = Window.orderBy("_d").rangeBetween(1, Window.unboundedFollowing)
    return nums.withColumn("next_dt", F.min(F.when(F.col("_t") == 1, F.col("dt"))).over(w)).where("_t = 0").select("dt", "next_dt")


def period_key(rule: str, dt: Column) -> Column:
    month = F.date_format(dt, "yyyy-MM")
    if rule == "week":
        return F.date_format(F.date_trunc("week", dt), "yyyy-MM-dd")
    if rule == "month":
        return month
    if rule == "half_month":
        return F.concat(month, F.when(F.dayofmonth(dt) > 15, F.lit("-H2")).otherwise(F.lit("-H1")))
    raise ValueError(f"no period {rule!r}")


def resample(bars: DataFrame, rule: str) -> DataFrame:
    """Bars of periods, dated by their last date.  Open and close skip nulls; a symbol whose last bar is not the
    period's last date is dropped there, as are bars with a null price."""
    def last_known(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("dt")))

    agg = bars.withColumn("period", period_key(rule, F.col("dt"))).groupBy("symbol", "period").agg(
        F.max("dt").alias("dt"), F.min_by("open", F.when(F.col("open").isNotNull(), F.col("dt"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last_known("close").alias("close"), F.sum("volume").alias("volume"),
    )
    ends = agg.groupBy("period").agg(F.max("dt").alias("end"))  # calendar-sized
    return agg.join(ends, "period").where(F.col("dt") == F.col("end")).drop("end").dropna(subset=["open", "high", "low", "close"])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the last in ``order``.  The limit of one is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides, the new row winning where keys meet."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.col("_src")]).drop("_src")


def members_as_of(dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Symbols of the latest membership snapshot at or before any of the dates: (symbol)."""
    known = snapshots.select("dt").distinct()
    both = dates.select("dt", F.lit(1).alias("_left")).unionByName(known.select("dt", F.lit(0).alias("_left")))
    w = Window.orderBy("dt", "_left").rowsBetween(Window.unboundedPreceding, 0)
    used = both.withColumn("snap", F.last(F.when(F.col("_left") == 0, F.col("dt")), ignorenulls=True).over(w)).where("_left = 1").select(F.col("snap").alias("dt")).distinct()
    return snapshots.join(used, "dt", "left_semi").select("symbol").distinct()


def with_index(grid: DataFrame) -> DataFrame:
    return grid.withColumn("i", F.row_number().over(by_symbol()) - 1)
