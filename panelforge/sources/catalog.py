"""A catalog of named tables, read lazily with one rule for each table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import finite
from .panels import delayed_statements, first_existing, restricted

#: A symbol whose rows are not to be used, as in the data that the tables come from.
BLOCKED = ("XAUUSD",)


@dataclass(frozen=True)
class Table:
    """How a table is read.  ``columns``: those kept, where they exist (all, if empty), with ``prefix`` for further ones;
    ``date``: the column that becomes ``dt`` (none for a static map); ``stamps``: columns of times that may be malformed;
    ``by_symbol``: whether symbols and the block-list select rows; ``delay``: days from a filing to its date."""

    name: str
    date: str | None = "dt"
    columns: tuple[str, ...] = ()
    prefix: str | None = None
    stamps: tuple[str, ...] = ()
    by_symbol: bool = True
    blocked: bool = True
    delay: int | None = None
    optional: bool = False


BARS = ("open", "high", "low", "close", "volume", "amount", "turnover", "adj_close")
#: The tables and columns of a panel database.
TABLES = (
    Table("market", columns=BARS),
    Table("etf", columns=BARS, by_symbol=False),
    Table("fundamental", columns=("pe", "pe_ttm", "pb", "ps", "ps_ttm", "market_cap", "total_mv", "circ_mv", "roe", "roa", "gross_margin", "profit_growth", "debt_ratio", "current_ratio")),
    Table("alpha158", prefix="alpha158_", columns=("symbol",)),
    Table("statement", date="filing_date", delay=45),
    Table("macro", columns=("series_id", "observation_date", "value", "units", "updated_at"), stamps=("observation_date",), by_symbol=False, blocked=False),
    Table("sp500_constituents", columns=("updated_at",), stamps=("updated_at",), by_symbol=False, blocked=False, optional=True),
    Table("industry", date=None, columns=("name", "sector", "sub_industry", "sector_etf", "updated_at"), stamps=("updated_at",), blocked=False, optional=True),
)


@dataclass
class Catalog:
    """Tables by name: ``read`` gives the raw table of a name, or None where there is none.

    Rows are selected by typed predicates on the raw columns, so that they reach the scan, and only the columns that a
    table's rule names are read.  A missing optional table is empty; another one raises ``KeyError``.
    """

    spark: SparkSession
    read: Callable[[str], DataFrame | None]
    blocked: Sequence = BLOCKED
    tables: dict[str, Table] = field(default_factory=lambda: {t.name: t for t in TABLES})

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, fmt: str = "parquet", **options) -> Catalog:
        """Tables in the folders or files ``root/<name>`` or ``root/<name>.<fmt>``."""
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import AnalysisException

        def read(name: str) -> DataFrame | None:
            for path in (f"{root}/{name}", f"{root}/{name}.{fmt}"):
                try:
                    return spark.read.format(fmt).option("ignoreCorruptFiles", "true").load(path)
                except (AnalysisException, Py4JJavaError) as e:
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
            return None

        return cls(spark, read, **options)

    @classmethod
    def of_frames(cls, spark: SparkSession, frames: dict[str, DataFrame], **options) -> Catalog:
        return cls(spark, frames.get, **options)

    def table(self, name: str, symbols: Sequence | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows of a table for symbols and an inclusive range of dates."""
        rule, raw = self.tables[name], self.read(name)
        if raw is None:
            if rule.optional:
                return self.spark.createDataFrame([], "symbol string" if rule.date is None else "dt date, symbol string")
            raise KeyError(name)
        return self._selected(rule, raw, symbols, start, end)

    def _selected(self, rule: Table, raw: DataFrame, symbols: Sequence | None, start: str | None, end: str | None) -> DataFrame:
        if rule.by_symbol and symbols:
            raw = raw.where(F.col("symbol").isin(list(symbols)))
        if rule.blocked and self.blocked and "symbol" in raw.columns:
            raw = raw.where(~F.col("symbol").isin(list(self.blocked)))
        if rule.date is None:
            out = raw
        elif rule.delay is not None:
            shifted = lambda d: None if d is None else F.date_sub(F.lit(d).cast("date"), rule.delay)
            if start is not None:
                raw = raw.where(F.col(rule.date) >= shifted(start))
            if end is not None:
                raw = raw.where(F.col(rule.date) <= shifted(end))
            out = delayed_statements(raw.withColumnRenamed(rule.date, "filing_date"), rule.delay)
        else:
            date = rule.date if rule.date in raw.columns else first_existing(raw, ("dt", "date", "trade_date"))
            raw = raw.withColumnRenamed(date, "dt")
            if dict(raw.dtypes)["dt"] != "date":
                raw = raw.withColumn("dt", F.to_date("dt"))
            out = restricted(raw, start=start, end=end)
        return self._shaped(rule, out)

    def _shaped(self, rule: Table, out: DataFrame) -> DataFrame:
        keys = [c for c in ("dt", "symbol") if c in out.columns]
        if rule.columns or rule.prefix:
            kept = [c for c in rule.columns if c in out.columns and c not in keys]
            kept += [c for c in out.columns if rule.prefix and c.startswith(rule.prefix)]
            out = out.select(*keys, *kept)
        if "close" in out.columns and "adj_close" not in out.columns:
            out = out.withColumn("adj_close", F.col("close"))
        made = {c: finite(F.col(c).cast("double")) for c, t in out.dtypes if t in ("double", "float") and c not in keys}
        made |= {c: F.try_to_timestamp(F.col(c).cast("string")) for c in rule.stamps if c in out.columns}
        if "symbol" in out.columns:
            made["symbol"] = F.col("symbol").cast("string")
        return out.withColumns(made) if made else out

    def load(self, symbols: Sequence | None = None, start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
        """Every table that there is."""
        return {n: self.table(n, symbols, start, end) for n, t in self.tables.items() if t.optional or self.read(n) is not None}

    def first_dates(self, symbols: Sequence | None = None) -> DataFrame:
        """(table, first): the first date of each dated table."""
        out = None
        for n, t in self.tables.items():
            if t.date is not None and self.read(n) is not None:
                one = self.table(n, symbols).agg(F.min("dt").alias("first")).select(F.lit(n).alias("table"), "first")
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "table string, first date")

    def preload_ranges(self, start: str, symbols: Sequence | None = None, years: int = 1) -> DataFrame:
        """(table, first, last): what windows need before ``start``, from ``years`` back or the table's first date to the day
        before; a table without such days has no row."""
        s = F.lit(start).cast("date")
        out = self.first_dates(symbols).select("table", F.greatest(F.add_months(s, -12 * years), F.coalesce("first", F.add_months(s, -12 * years))).alias("first"), F.date_sub(s, 1).alias("last"))
        return out.where("first <= last")

    def preload(self, start: str, symbols: Sequence | None = None, years: int = 1) -> dict[str, DataFrame]:
        """The rows of those ranges; the first date needs no look-up, since there is nothing before it."""
        s = F.lit(start).cast("date")
        before = lambda d: d.where((F.col("dt") >= F.add_months(s, -12 * years)) & (F.col("dt") < s))
        return {n: before(self.table(n, symbols)) for n, t in self.tables.items() if t.date is not None and self.read(n) is not None}


def report_rows(raw: DataFrame, renames: dict[str, str], symbol: str = "symbol", dates: Sequence[str] = ("report_date", "filing_date"), texts: Sequence[str] = ("report_type",)) -> DataFrame:
    """Downloaded report rows in canonical columns: headers renamed, dates and numbers read tolerantly (a malformed one
    is null; thousands separators and percent signs are removed), rows without a symbol or report date dropped."""
    out = raw.withColumnsRenamed({k: v for k, v in renames.items() if k in raw.columns})
    out = out.select(*[c for c in dict.fromkeys(renames.values()) if c in out.columns])
    made = {}
    for c in out.columns:
        if c in dates:
            text = F.regexp_replace(F.trim(F.col(c).cast("string")), "[/.]", "-")
            made[c] = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-M-d")), F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text)).cast("date")
        elif c == symbol or c in texts:
            made[c] = F.trim(F.col(c).cast("string"))
        else:
            made[c] = finite(F.regexp_replace(F.trim(F.col(c).cast("string")), "[,%]", "").try_cast("double"))
    out = out.withColumns(made)
    return out.where(" AND ".join(f"{c} IS NOT NULL" for c in (symbol, "report_date") if c in out.columns) or "true")


def clean_bars(raw: DataFrame, renames: dict[str, str], numbers: Sequence[str] = ("open", "high", "low", "close", "volume", "amount")) -> DataFrame:
    """Downloaded bars: headers renamed, numbers and dates read tolerantly, rows without a date or close dropped."""
    out = raw.withColumnsRenamed({k: v for k, v in renames.items() if k in raw.columns})
    made = {c: finite(F.col(c).cast("string").try_cast("double")) for c in numbers if c in out.columns}
    return out.withColumns(made | {"dt": F.try_to_timestamp(F.col("dt").cast("string")).cast("date"), "symbol": F.col("symbol").cast("string")}).where("dt IS NOT NULL AND close IS NOT NULL")


#: The columns of stored tables.
SCHEMAS = {
    "securities": "symbol STRING, name STRING, exchange STRING, list_date DATE, delist_date DATE, status STRING",
    "trade_calendar": "dt DATE, is_open BOOLEAN",
    "financial_reports": "symbol STRING, report_date DATE, filing_date DATE, report_type STRING, revenue DOUBLE, net_profit DOUBLE, total_assets DOUBLE, equity DOUBLE",
    "daily_valuation": "symbol STRING, dt DATE, pe DOUBLE, pe_ttm DOUBLE, pb DOUBLE, ps DOUBLE, ps_ttm DOUBLE, total_mv DOUBLE, circ_mv DOUBLE",
}


def create_tables(spark: SparkSession, database: str = "default", schemas: dict[str, str] | None = None) -> list[str]:
    """Creates the stored tables that aren't there yet; returns their names."""
    names = []
    for name, columns in (SCHEMAS if schemas is None else schemas).items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
        names.append(f"{database}.{name}")
    return names
