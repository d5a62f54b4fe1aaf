"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered


def _unit(hash64: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1, from its upper 53 bits."""
    return (F.shiftrightunsigned(hash64, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard with the highest score ``-weight / ln(u)``, ``u`` from a hash of key and shard.

    A shard's score depends on the key, the shard's number and its own weight only,
    so adding shards or raising a weight takes rows into the shard in question and
    moves none between the others.  A shard of weight 0 gets nothing; ties go to the
    smaller number.  A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, with one above 0")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    scores = [F.struct((F.lit(float(w)) / -F.log(_unit(F.xxhash64(F.lit(seed), F.lit(i), text)))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["i"]).cast("int")


def shard(
    docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None, text: str = "text", key: str = "doc_id", seed: int = 0, slots: bool = True
) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one more shard of mean weight) and ``slot``.

    The law is ``key``: key and shard count decide.  ``slot`` numbers the rows of each
    shard from 0 without gaps; rows are numbered in cells (see ``numbered``), so no
    task holds a shard.  Weights have one entry per shard; the default is equal.

    Null keys share a shard; repeated keys get the same shard and different slots.  An
    empty table gives an empty result; other columns are passed through, those of the outputs' names replaced.
    Names that start with ``_nb`` are reserved.
    """
    weights = [1.0] * shards if weights is None else [float(w) for w in weights]
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    k = F.col(f"`{key}`")
    grown = [*weights, sum(weights) / len(weights)]
    out = docs.withColumn("shard", rendezvous(k, weights, seed)).withColumn("grown_shard", rendezvous(k, grown, seed))
    if not slots:
        return out
    tie = [c for c in out.columns if c not in (key, "shard", "grown_shard") and dict(out.dtypes)[c] in ("bigint", "int", "string", "double", "boolean")]
    order = [k.asc_nulls_last(), *[F.col(f"`{c}`") for c in tie]]
    return numbered(out, ["shard"], order, F.xxhash64(k, *[F.col(f"`{c}`") for c in tie]), None, "slot", rows=docs.count())
