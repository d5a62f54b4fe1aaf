"""Shared helpers: words, durable intermediate tables, distributed numbering."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.sources.staging import durable, shared_dir

#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\f\r"
#: A word, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Bounds the rows and bytes of an Arrow batch, for workers that read whole texts.

    Both are settings of the session, read when a plan runs; larger ones are lowered and stay so.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def per_worker(key: tuple, make):
    """What ``make`` returns, kept for the tasks that the same Python worker runs after this one.

    A worker keeps one such thing: that of another operator goes first.
    """
    store = sys.modules.setdefault("_panelforge_worker", types.ModuleType("_panelforge_worker"))
    held = getattr(store, "held", None)
    if held is None or held[0] != key:
        store.held = None
        store.held = held = key, make()
    return held[1]


def map_beside(df: DataFrame, run, made: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` that adds the columns ``made`` behind those of ``df``, whose names may be any."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *made]))
    return out.toDF(*df.columns, *[f.name for f in made])


def text_parts(batch: pa.RecordBatch, text_at: int, most: int, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``most`` bytes together, or that hold one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and (total + size > most or k - at >= rows):
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += size
    if batch.num_rows > at:
        yield batch.slice(at)


def most_frequent(counts: DataFrame, most: int, times: str = "times") -> DataFrame:
    """The rows whose count is above the lowest threshold that leaves at most ``most`` of them; a tie at it goes as a whole.

    A histogram of counts, which has a row for each distinct count, gives the threshold, so
    no partition hands on more than what is kept overall.
    """
    from pyspark.sql import Window

    upto = Window.orderBy(F.desc(times)).rowsBetween(Window.unboundedPreceding, 0)
    least = counts.groupBy(times).agg(F.count(F.lit(1)).alias("_n")).withColumn("_sum", F.sum("_n").over(upto)).where(F.col("_sum") <= most).agg(F.min(times)).first()[0]
    return counts.where(F.lit(False)) if least is None else counts.where(F.col(times) >= least)


#: Rows of a table of key bits, and bits of each: 8 MB in all, whatever the number of keys.
BIT_ROWS, BITS = 2048, 32_768


def key_bits(hashes: DataFrame) -> DataFrame:
    """A set of 64-bit hashes (the one column) as bits: at most ``BIT_ROWS`` rows of ``BITS`` bits, for ``maybe_in``."""
    h = F.col(hashes.columns[0])
    at = F.shiftrightunsigned(h, 11).bitwiseAND(F.lit(BITS - 1))
    bits = hashes.where(h.isNotNull()).groupBy(h.bitwiseAND(F.lit(BIT_ROWS - 1)).cast("int").alias("_bit_row")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    return durable(bits, "key-bits")


def maybe_in(df: DataFrame, h: Column, bits: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: false only for rows whose hash is not in the set; true also for a share of others that grows with the set.

    The broadcast table is bounded by its making.  With it, rows that a key table can't touch stay where they are,
    and only the others go through an exact join.
    """
    at = F.shiftrightunsigned(h, 11).bitwiseAND(F.lit(BITS - 1))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(bits), h.bitwiseAND(F.lit(BIT_ROWS - 1)).cast("int") == F.col("_bit_row"), "left")
    return joined.withColumn(out, hit).drop("_bit_row", "_bits")


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(
    df: DataFrame, group: list[str], order: list[Column], spread: Column, weight: Column | None, out: str, rows_per_cell: int = 20_000, rows: int | None = None
) -> DataFrame:
    """Adds ``out``: a gapless running number (or running ``weight`` total) within ``group``.

    No task ever holds a group: rows are dealt to cells by ``spread``, numbered
    within their cell, and shifted by the totals of the cells before it.  The
    number starts at 0 and excludes the row's own weight.  ``order`` must be total
    for reruns to agree.  The cell totals (a row for each group and cell) are joined
    by key, broadcast by Spark only when it finds them small.  Names that start with
    ``_nb`` are reserved.
    """
    from pyspark.sql import Window

    rows = df.count() if rows is None else rows
    cells = max(64, -(-rows // rows_per_cell))
    w = F.lit(1).cast("long") if weight is None else weight
    celled = df.withColumn("_nb_cell", F.pmod(spread, F.lit(cells)).cast("int")).withColumn("_nb_w", w)
    keys = [*group, "_nb_cell"]
    totals = celled.groupBy(*keys).agg(F.sum("_nb_w").alias("_nb_total"))
    before = Window.partitionBy(*group).orderBy("_nb_cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumn("_nb_shift", F.coalesce(F.sum("_nb_total").over(before), F.lit(0))).select(*[F.col(k).alias(f"_nbk_{k}") for k in keys], "_nb_shift")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = celled.withColumn("_nb_local", F.coalesce(F.sum("_nb_w").over(inside), F.lit(0)))
    cond = [F.col(k).eqNullSafe(F.col(f"_nbk_{k}")) for k in keys]
    joined = local.join(shifts, cond, "left")
    return joined.withColumn(out, (F.col("_nb_local") + F.col("_nb_shift")).cast("long")).drop("_nb_cell", "_nb_w", "_nb_local", "_nb_shift", *[f"_nbk_{k}" for k in keys])


__all__ = ["SPACES", "WORD", "durable", "key_bits", "map_beside", "maybe_in", "most_frequent", "n_words", "numbered", "per_worker", "shared_dir", "small_batches", "text_parts"]
