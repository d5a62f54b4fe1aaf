"""Mixing sources to target weights: blocks of words, drawn for output shards and joined by index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, n_words, numbered

#: Rounds of a permutation; each is its own inverse.
ROUNDS = 16
#: Slots that are generated from one row.
SLOTS_A_ROW = 1 << 15


@dataclass(frozen=True)
class Mix:
    """``documents``: the input with a hash of key and text as ``_row``; ``sized``: source, key, ``_row`` and size of each;
    ``slots``: one row for each slot, with its output shard and block;
    ``pieces``: the words of each document that lie in each block."""

    documents: DataFrame
    sized: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    @property
    def shards(self) -> DataFrame:
        """How many slots of each source an output shard has."""
        return self.slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("drawn"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """One row for each source: size, weight and target.

    Sources in code point order, null last, take the weights in turn.  Targets share
    the size of all sources by weight; a target stops at ``cap`` times its source's
    size and the excess is shared anew by weight until none is above.  The fixed
    point is ``min(cap * size, level * weight)``; sources sorted by ``size / weight``
    reach their cap in that order, so the level follows from running sums.  The
    table has a row for each source; only that is sorted in one task.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(n)).cast("int") + 1))
    everything = Window.partitionBy()
    ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("w_all", F.sum("w").over(everything))
    s = s.withColumn("capped", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))).withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # The first source, in this order, that its share does not lift to its cap sets the level for itself and all after it.
    level = F.col("total") - F.col("capped")
    free = level * F.col("w") / F.col("w_left") < F.lit(cap) * F.col("source_size")
    s = s.withColumn("level", F.min(F.when(free, F.struct((F.col("source_size") / F.col("w")).alias("r"), (level / F.col("w_left")).alias("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.lit(cap) * F.col("source_size")).otherwise(F.least(F.lit(cap) * F.col("source_size"), F.col("level") * F.col("w")))
    return s.select("source", F.col("source_size").cast("long"), "w", target.cast("double").alias("target"))


def permuted(df: DataFrame, out: str, k: Column, n: Column, key: Column, inverse: bool = False) -> DataFrame:
    """Adds ``out``: where a pseudorandom permutation of 0..n-1, chosen by the number ``key``, takes ``k``.

    Swap-or-not rounds: an index and its mirror image, ``(c - k) mod n`` for a constant c of
    the round, are swapped or not by a hash of the larger of the two.  Any n works and
    nothing is stored or sorted.  Each round is a column of its own, so that all is compiled code.
    """
    df = df.withColumns({out: F.coalesce(k.cast("long"), F.lit(0).cast("long")), "_pm_n": F.coalesce(n.cast("long"), F.lit(1).cast("long")), "_pm_k": key})
    x, n, mirror = F.col(out), F.col("_pm_n"), F.col("_pm_m")
    for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        c = F.pmod(F.xxhash64("_pm_k", F.lit(r)), n)
        df = df.withColumn("_pm_m", c - x).withColumn("_pm_m", F.when(mirror < 0, mirror + n).otherwise(mirror))
        df = df.withColumn(out, F.when(F.xxhash64("_pm_k", F.lit(-1 - r), F.greatest(x, mirror)) < 0, mirror).otherwise(x))
    return df.drop("_pm_n", "_pm_k", "_pm_m")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    block_words: int = 64,
    shard_slots: int = 1024,
    seed: int = 17,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
) -> Mix:
    """Draws an output mix in which each source has its target share of words.

    The words of a source, its documents in pseudorandom order, form one sequence that
    is cut into blocks of ``block_words`` (the last may be shorter).  Each source has as many slots as blocks come
    nearest to its target, and a pseudorandom permutation deals the slots of all sources to output shards of
    ``shard_slots`` slots: the counts of sources in a shard are a multinomial draw by target weights, given that
    all draws together meet the targets.  The k-th slot of a source maps to pass ``k div blocks``
    and to a pseudorandom permutation of the source's block indices, chosen by source
    and pass, at ``k mod blocks``; slots join blocks by that index.  There are at most ``cap`` passes,
    so no document exceeds ``cap`` times its size.  Offsets are in closed form: slots are made from
    rows of ``SLOTS_A_ROW`` each, wherever they run.

    Null texts have size 0 and take nothing; null sources form a source of their own;
    rows that repeat key and text each count.  Empty tables give empty results.  Other
    columns are passed through in ``documents``; their names may not start with an underscore.
    Keys and texts decide the order, so reruns agree.
    """
    passes = int(cap)
    base = docs.withColumn("_row", F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")))
    sized = base.select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), "_row", n_words(F.col(f"`{text}`")).alias("size"))
    sized = durable(sized, "mix-size")
    sources = source_targets(sized, weights, cap)
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    slots = F.least(F.round(F.col("blocks") * F.col("target") / F.col("source_size")).cast("long"), F.col("blocks") * passes)
    sources = sources.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0).cast("long")))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sources = durable(sources.withColumn("first", F.coalesce(F.sum("slots").over(upto), F.lit(0).cast("long"))), "mix-sources")

    total = max(sources.agg(F.sum("slots")).first()[0] or 0, 1)
    n = F.lit(SLOTS_A_ROW).cast("long")
    rows = sources.where("slots > 0").select("source", "blocks", "slots", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / n))).alias("_at"))
    # Few rows make many slots: a number of partitions by the slots keeps the work spread out.
    rows = rows.repartition(max(8, total // SLOTS_A_ROW + 1), "source", "_at")
    slots = rows.select("source", "blocks", "first", F.explode(F.sequence(F.col("_at") * n, F.least((F.col("_at") + 1) * n, F.col("slots")) - 1)).alias("k"))
    slots = slots.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("int"))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    slots = permuted(slots, "block", F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), name, F.col("pass")))
    slots = permuted(slots, "place", F.col("first") + F.col("k"), F.lit(total), F.xxhash64(F.lit(seed), F.lit("shards")))
    slots = slots.select(F.floor(F.col("place") / F.lit(shard_slots)).cast("long").alias("shard"), "source", "k", "pass", "block")
    # Written, since a condition that the optimiser moved below the rounds would double in each of them.
    slots = durable(slots, "mix-slots")

    # The words of each document, as ranges of the blocks that they lie in.
    placed = numbered(sized.where("size > 0"), ["source"], [F.col("_row"), F.col("key").asc_nulls_last(), F.col("size")], F.xxhash64("_row", F.lit(1)), F.col("size"), "start", rows=sized.count())
    b = F.lit(block_words)
    pieces = placed.select(
        "source", "key", "_row", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"),
    )
    lo = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
    pieces = pieces.select("source", "key", "_row", "start", "block", lo.cast("long").alias("word"), (hi - lo).cast("long").alias("words"))
    return Mix(base, sized, sources, slots, pieces)


def _taken(m: Mix, lists: bool) -> DataFrame:
    """For each document row (``_row``, ``start``): the words taken, the first shard that takes some, and on request the ranges."""
    uses = m.slots.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count(F.lit(1)).alias("uses"), F.min("shard").alias("shard"))
    hit = m.pieces.hint("merge").join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    aggs = [F.sum(F.col("words") * F.col("uses")).cast("long").alias("taken"), F.min("shard").alias("shard")]
    if lists:
        aggs.append(F.array_sort(F.collect_list(F.struct("word", "words", "uses"))).alias("ranges"))
    return hit.groupBy("key", "_row", "start").agg(*aggs)


def mix_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's), ``taken`` (words that the mix takes) and ``first_shard``
    (of the output; null where nothing is taken).  Columns of these names are replaced.

    Rows that repeat key and text share their words evenly: such rows differ in place
    only, and the sum of what they take is divided in key order.
    """
    m = mix(docs, text=text, key=key, source=source, **options)
    per_row = _taken(m, False).groupBy(F.col("key").alias("_k"), F.col("_row").alias("_r")).agg(F.sum("taken").alias("_t"), F.count(F.lit(1)).alias("_c"), F.max("taken").alias("_m"), F.min("shard").alias("first_shard"))
    sizes = m.sized.groupBy("key", "_row").agg(F.min("size").alias("size"))  # rows of a key and text have one size
    sizes = sizes.join(per_row, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left").drop("_k", "_r")
    sizes = sizes.withColumnsRenamed({"key": "_k", "_row": "_r"})
    made = ("size", "source_size", "target", "taken", "first_shard")
    kept = m.documents.select(*[f"`{c}`" for c in docs.columns if c not in made or c in (text, key, source)], "_row")
    out = kept.join(sizes, F.col(f"`{key}`").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left")
    facts = m.sources.select(F.col("source").alias("_s"), "source_size", "target")
    out = out.join(facts, F.col(f"`{source}`").eqNullSafe(F.col("_s")), "left")
    taken = F.coalesce(F.when(F.col("_c") == 1, F.col("_m")).otherwise(F.floor(F.col("_t") / F.col("_c"))), F.lit(0)).cast("long")
    return out.withColumn("taken", taken).drop("_row", "_k", "_r", "_t", "_c", "_m", "_s")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix as documents: each row's text holds the word ranges that are taken, once per pass, joined by blanks.

    Rows of which nothing is taken go.  ``n_chars`` follows the text where the column exists.
    """
    m = mix(docs, text=text, key=key, source=source, **options)
    ranges = _taken(m, True).groupBy(F.col("key").alias("_k"), F.col("_row").alias("_r")).agg(F.min(F.struct("start", "ranges"))["ranges"].alias("_ranges"))
    out = m.documents.join(ranges, F.col(f"`{key}`").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")))
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    most = F.array_max(F.transform("_ranges", lambda r: r["uses"])).cast("int")

    def taken(w: Column) -> Column:
        cut = lambda r: F.slice(w, (r["word"] + 1).cast("int"), r["words"].cast("int"))
        passes = F.transform(F.sequence(F.lit(1), most), lambda p: F.flatten(F.transform(F.filter(F.col("_ranges"), lambda r: r["uses"] >= p), cut)))
        return F.array_join(F.flatten(passes), " ")

    # The words are bound once, as a lambda's variable; as a column they would be cut anew for every range.
    out = out.withColumn(text, F.get(F.transform(F.array(words), taken), F.lit(0)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
