"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, durable, key_bits, maybe_in


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:  # much faster than one translation
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", prefix: int = 256) -> DataFrame:
    """Adds ``keep_id``, ``group_size`` and ``kept`` to every row of ``docs``; columns of these names are replaced.

    Two texts are equal when they are identical after white space is deleted.

    1. Length: rows are counted by the byte length of the normalised text; a
       length that occurs once needs nothing more.
    2. Prefix hash: of the rest, rows are counted by length and hash of the first
       ``prefix`` characters.
    3. Full hash: SHA-256 over the full content is computed only for rows whose length and prefix hash both recur.

    Steps 1 and 2 work on one narrow table of lengths and hashes.  The groups that survive become a bit set of fixed
    size, so rows outside it are told apart where they lie: they get their result without a shuffle, at
    any size.  Rows in it (all that survive, and a share of others that full hashes then rule out) are joined
    to their groups by full hash; hot groups are split by adaptive execution.  Of a group, the row
    with the most code points in its original text stays, then the smallest key.

    Nulls: a null text equals an empty one; rows with a null key join groups, and
    stay only when all keys of the group are null.  Rows that repeat a key and
    text stay or go together.  An empty table gives an empty result.  Further
    columns are passed through; names starting with ``_xd_`` are reserved.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c in (key, text) or c not in ("keep_id", "group_size", "kept")])
    t, k = F.col(f"`{text}`"), F.col(f"`{key}`")
    body = docs.withColumn("_xd_n", normalised(t))
    body = body.withColumn("_xd_len", F.octet_length("_xd_n")).withColumn("_xd_head", F.xxhash64(F.substring("_xd_n", 1, prefix)))

    narrow = durable(body.groupBy("_xd_len", "_xd_head").count(), "xd-prefix")
    lengths = narrow.groupBy("_xd_len").agg(F.sum("count").alias("_xd_all")).where("_xd_all > 1").select("_xd_len")
    heads = narrow.where("count > 1").join(lengths, "_xd_len", "left_semi")
    which = F.xxhash64("_xd_len", "_xd_head")
    body = maybe_in(body, which, key_bits(heads.select(which.alias("h"))), "_xd_hit")

    full = F.unhex(F.sha2("_xd_n", 256))
    hits = body.where("_xd_hit").withColumn("_xd_full", full).drop("_xd_n", "_xd_len", "_xd_head", "_xd_hit")
    length = F.char_length(F.coalesce(t, F.lit("")))
    best = F.min(F.struct((-length).alias("c"), k.isNull().alias("n"), k.alias("k")))["k"]
    groups = hits.groupBy(F.col("_xd_full").alias("_xd_group")).agg(F.count(F.lit(1)).alias("_xd_size"), best.alias("_xd_keep")).where("_xd_size > 1")
    groups = durable(groups, "xd-full")

    size, kept = F.col("_xd_size"), k.eqNullSafe(F.col("keep_id"))
    found = hits.join(groups, F.col("_xd_full") == F.col("_xd_group"), "left").withColumn("keep_id", F.when(size.isNotNull(), F.col("_xd_keep")).otherwise(k))
    found = found.withColumn("group_size", F.coalesce(size, F.lit(1)).cast("long")).withColumn("kept", kept)
    alone = body.where("NOT _xd_hit").withColumn("keep_id", k).withColumn("group_size", F.lit(1).cast("long")).withColumn("kept", F.lit(True))
    made = [*[f"`{c}`" for c in docs.columns], "keep_id", "group_size", "kept"]
    return found.select(*made).unionByName(alone.select(*made))
