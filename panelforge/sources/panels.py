"""Sources: long panels (dt, symbol, measures) from files and from the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import div, finite

#: Canonical names of a market panel.
MARKET = ("dt", "symbol", "open", "high", "low", "close", "volume")
#: A trading total order of lineitem: (l_orderkey, l_linenumber) is not a key.
TOTAL_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def first_existing(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of ``names`` that is a column, decided when the plan is made."""
    return next((n for n in names if n in df.columns), None)


def standardise(df: DataFrame, renames: dict[str, str], date: str = "dt", symbol: str = "symbol") -> DataFrame:
    """Renames, casts the key, and turns NaN and infinities of floating columns into NULL."""
    out = df.withColumnsRenamed(renames)
    floats = [n for n, t in out.dtypes if t in ("double", "float")]
    return out.withColumns({date: F.to_date(F.col(date)), symbol: F.col(symbol).cast("string"), **{n: finite(F.col(n).cast("double")) for n in floats}})


def restricted(df: DataFrame, symbols: Sequence | None = None, start: str | None = None, end: str | None = None, blocked: Sequence = (), date: str = "dt", symbol: str = "symbol") -> DataFrame:
    """Symbols, an inclusive date range and a block-list, as typed predicates that reach the scan."""
    if symbols is not None:
        df = df.where(F.col(symbol).isin(list(symbols)))
    if blocked:
        df = df.where(~F.col(symbol).isin(list(blocked)))
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", renames: dict[str, str] | None = None, columns: Sequence[str] | None = None, **limits) -> DataFrame:
    """A panel of files, Hive partitions pruned; unreadable files are skipped, missing columns left out."""
    reader = spark.read.format(fmt).option("ignoreCorruptFiles", "true")
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    df = standardise(reader.load(path), renames or {})
    if columns is not None:
        df = df.select(*[c for c in columns if c in df.columns])
    return restricted(df, **limits)


def read_table(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None, renames: dict[str, str] | None = None, **limits) -> DataFrame:
    """A panel of a database table over JDBC; predicates are pushed down."""
    return restricted(standardise(spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load(), renames or {}), **limits)


def active_universe(listing: DataFrame, start: str, end: str) -> DataFrame:
    """Symbols listed at some time in a range; unknown dates count as open."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return listing.where((F.col("list_date").isNull() | (F.col("list_date") <= e)) & (F.col("delist_date").isNull() | (F.col("delist_date") >= s))).select("symbol").distinct()


def delayed_statements(statements: DataFrame, days: int = 45, start: str | None = None, end: str | None = None) -> DataFrame:
    """Statements with a filing date, known ``days`` after it."""
    return restricted(statements.where("filing_date IS NOT NULL").withColumn("dt", F.date_add("filing_date", days)), start=start, end=end)


def without_annual_rows(statements: DataFrame, quarter: str = "fiscal_quarter") -> DataFrame:
    """Quarterly rows: those whose quarter is not 0, or not known."""
    return statements if quarter not in statements.columns else statements.where((F.col(quarter) != 0) | F.col(quarter).isNull())


def warm_up(df: DataFrame, start: str, years: int = 1) -> DataFrame:
    """The rows before ``start`` that windows need: at most ``years`` back."""
    s = F.lit(start).cast("date")
    return df.where((F.col("dt") >= F.add_months(s, -12 * years)) & (F.col("dt") < s))


def stale_symbols(bars: DataFrame, listing: DataFrame, today: str, tolerance: int = 30) -> DataFrame:
    """(symbol, last_dt, n): listed symbols whose last bar lies more than ``tolerance`` days before the end of their listing (or today), or that have none."""
    have = bars.groupBy("symbol").agg(F.max("dt").alias("last_dt"), F.count(F.lit(1)).alias("n"))
    end = F.least(F.coalesce("delist_date", F.lit(today).cast("date")), F.lit(today).cast("date"))
    out = listing.join(have, "symbol", "left").where(F.col("last_dt").isNull() | (F.date_add("last_dt", tolerance) < end))
    return out.select("symbol", "last_dt", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def symbols_of(df: DataFrame) -> DataFrame:
    return df.select("symbol").distinct()


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _bars(rows: DataFrame, period: Column, symbol: Column) -> DataFrame:
    """Bars in one partial-then-final aggregate: open and close are the prices at the ends of the total order."""
    order = F.struct(*TOTAL_ORDER)
    px = div("l_extendedprice", "l_quantity")
    r = rows.select(period.alias("dt"), symbol.alias("symbol"), px.alias("px"), order.alias("o"), "l_quantity", "l_extendedprice").where("px IS NOT NULL")
    return r.groupBy("dt", "symbol").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel BM: supplier by month."""
    return _bars(_lineitem(spark, sf_dir), F.to_date(F.date_trunc("month", "l_shipdate")), F.col("l_suppkey"))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel BW: supplier nation by week.  The supplier table is a dimension: Spark broadcasts it where it is small."""
    nation = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return _bars(_lineitem(spark, sf_dir).join(nation, "l_suppkey"), F.to_date(F.date_trunc("week", "l_shipdate")), F.col("s_nationkey"))


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to region and account balance: the static map."""
    r = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    s = r("supplier").join(r("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(r("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("industry"), F.col("s_acctbal").alias("book"))


def quarterly_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel QS: supplier by quarter; filed at the quarter's end, known 45 days later."""
    q = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = _lineitem(spark, sf_dir).groupBy(F.col("l_suppkey").alias("symbol"), q.alias("quarter")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(net * F.lit(0.6)).alias("cost_revenue"), F.sum(net * (1 - F.col("l_tax"))).alias("net_income"),
        F.sum(F.col("l_quantity") * 100).alias("total_assets"), F.sum(F.col("l_quantity") * 40).alias("equity"),
    )
    report = F.date_sub(F.add_months("quarter", 3), 1)
    return delayed_statements(out.withColumn("report_date", report).withColumn("filing_date", report).withColumn("gross_profit", F.col("revenue") - F.col("cost_revenue")))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items stand in for dividend events: (dt, symbol, dividend)."""
    return _lineitem(spark, sf_dir).where("l_returnflag = 'R'").groupBy(F.to_date("l_shipdate").alias("dt"), F.col("l_suppkey").alias("symbol")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("dividend"))
