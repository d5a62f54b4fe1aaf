"""Approximate nearest neighbours by inner product: cross-polytope hashing and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small_batches

#: Bytes of vectors in a block, which one task holds at a time, and the rows from which small tables get more blocks.
BLOCK_BYTES, BLOCK_ROWS, LEAST_BLOCKS = 160 << 20, 4096, 6
#: Queries that a task compares at a time, and what it may find for them before it keeps the nearest alone.
QUERIES, FOUND = 8192, 400_000
#: Vectors of a block that give a first bound for queries without one.
BOUND_ROWS = 2048
#: Signed axes of a hash are twice so many at most; a table has the square of that in buckets with two hashes.
AXES = 64
#: From so many vectors of a range on, two hashes.
TWO_HASHES = 1 << 17
#: Blocks from which the first twelfth (one at least) is searched ahead of the others, for bounds, by so many tasks or more.
TWO_WAVES, WAVE_TASKS = 6, 6
#: Vectors that a task remembers, so as not to send their copies again.
SEEN = 200_000
#: The largest norm of a range over its smallest, at most.
NORM_RANGE = 1.25


class CrossPolytope:
    """``tables`` x ``hashes`` pseudo-rotations (sign flips and Hadamard transforms, three times), each
    followed by the nearest of the first ``axes`` signed axes.  A bucket is a table's ``hashes`` axes in turn."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, axes: int | None = None, seed: int = 29):
        self.dim, self.width = dim, 1 << max(1, (dim - 1).bit_length())
        self.tables, self.hashes, self.probes, self.axes = tables, hashes, probes, axes or self.width
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, self.width))

    def _rotated(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        for signs in self.signs[table, k]:
            x, h = x * signs, 1
            while h < self.width:
                y = x.reshape(len(x), -1, 2, h)
                x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.width)
                h *= 2
        return x

    def _axes(self, x: np.ndarray, table: int, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest signed axes of each row, and how far each is behind the nearest."""
        r = self._rotated(x, table, k)[:, : self.axes]
        both = np.concatenate([r, -r], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :most]
        value = np.take_along_axis(both, order, axis=1)
        return order, value[:, :1] - value

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row."""
        x, out = self._padded(x), np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for k in range(self.hashes):
                out[:, t] = out[:, t] * (2 * self.axes) + self._axes(x, t, k, 1)[0][:, 0]
        return out

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the buckets whose axes lie nearest to each row together."""
        x, out = self._padded(x), []
        for t in range(self.tables):
            code, behind = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
            for k in range(self.hashes):
                axis, more = self._axes(x, t, k, min(self.probes, 2 * self.axes))
                code = (code[:, :, None] * (2 * self.axes) + axis[:, None, :]).reshape(len(x), -1)
                behind = (behind[:, :, None] + more[:, None, :]).reshape(len(x), -1)
                best = np.argsort(behind, axis=1, kind="stable")[:, : self.probes]
                code, behind = np.take_along_axis(code, best, axis=1), np.take_along_axis(behind, best, axis=1)
            out.append(code)
        return np.stack(out, axis=1)

    def behind(self, x: np.ndarray) -> list[np.ndarray]:
        """For each hash of the first table, how far each signed axis is behind a row's nearest: (rows, 2 * axes)."""
        x, out = self._padded(x), []
        for k in range(self.hashes):
            r = self._rotated(x, 0, k)[:, : self.axes]
            both = np.concatenate([r, -r], axis=1)
            out.append(both.max(axis=1, keepdims=True) - both)
        return out

    def cuts(self, x: np.ndarray) -> np.ndarray:
        """How far the last of the ``probes`` nearest buckets of the first table is behind, all hashes together."""
        total, *more = self.behind(x)
        for b in more:
            total = (total[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        last = min(self.probes, total.shape[1]) - 1
        return np.partition(total, last, axis=1)[:, last]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(ranges: dict[int, tuple[CrossPolytope, int, int]], top: float, lo: int, hi: int, dim: int):
    """Rows (h, h2, id, vec), by id, of blocks lo to hi as (at, h, id, vec): ``at`` is the block and the bucket.  A vector's later copies stay
    behind.  ``ranges`` has the index, first block and blocks of each range of norms."""
    known = np.array(sorted(ranges))
    first, count = (np.array([ranges[r][i] for r in known.tolist()]) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x = _matrix(part.column(3), dim)
                most = np.abs(x).max(axis=1)
                log = np.log(most) + np.log(np.square(x / most[:, None]).sum(axis=1)) / 2
                own = np.floor((top + 1e-9 - log) / math.log(NORM_RANGE)).astype(np.int64)
                own = np.maximum(np.searchsorted(known, own, side="right") - 1, 0)  # rounding may differ from the plan's
                block = first[own] + part.column(1).to_numpy() % count[own]
                fresh = []
                for i in np.flatnonzero((block >= lo) & (block < hi)).tolist():
                    key = part.column(0)[i].as_py(), part.column(1)[i].as_py()
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        fresh.append(i)
                if not fresh:
                    continue
                part, x, own, at = part.take(pa.array(fresh)), _directions(x[fresh]), own[fresh], block[fresh] << 32
                for r in np.unique(own).tolist():
                    which = np.flatnonzero(own == r)
                    at[which] += ranges[int(known[r])][0].buckets(x[which])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(at), part.column(0), part.column(2), part.column(3)], ["at", "h", "id", "vec"])

    return run


def _probing(indexes: list[CrossPolytope], dim: int):
    """Queries (query, log, vec) with their cuts in each index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = _directions(_matrix(part.column(2), dim))
                cuts = np.stack([index.cuts(x) for index in indexes], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, cuts.size + 1, cuts.shape[1], dtype=np.int32), pa.array(cuts.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["query", "log", "vec", "cuts"])

    return run


class _Block:
    """Vectors of a block in the order of their buckets, and the search in them."""

    def __init__(self, k: int, index: CrossPolytope, dim: int, kind: np.dtype, rows: int, top: float):
        self.k, self.index, self.dim, self.slack = k, index, dim, 1e-5 * top
        self.x, self.ids, self.cells, self.n, self.last = np.empty((rows, dim), kind), np.empty(rows, np.int64), np.empty(rows, np.int64), 0, None
        self.starts: np.ndarray | None = None

    def add(self, cells: np.ndarray, h: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows by (bucket, h, id): of equal vectors the first counts."""
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (x[1:] == x[:-1]).all(axis=1)
        if self.last is not None:
            same[0] = self.last[0] == h[0] and (self.last[1] == x[0]).all()
        self.last = h[-1], x[-1].copy()
        new, was = ~same, self.n
        self.n += int(new.sum())
        if self.n > len(self.x):
            more = self.n + self.n // 4
            for name in ("x", "ids", "cells"):
                old = getattr(self, name)
                grown = np.empty((more, *old.shape[1:]), old.dtype)
                grown[:was] = old[:was]
                setattr(self, name, grown)
        self.x[was : self.n], self.ids[was : self.n], self.cells[was : self.n] = x[new], ids[new], cells[new]

    def _nearest(self, q: np.ndarray, unit: np.ndarray, i: np.ndarray, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of finds (query, row, product in the matrix's precision) the k nearest of each query, by exact inner products."""
        order = np.lexsort((-s, i))
        i, x, s = i[order], x[order], s[order]
        first = np.searchsorted(i, i)
        kth = first + self.k - 1
        own = (kth < len(i)) & (i[np.minimum(kth, len(i) - 1)] == i)
        keep = ~own | (s >= np.where(own, s[np.minimum(kth, len(i) - 1)], 0) - 2 * self.slack)
        i, x = i[keep], x[keep]
        score = np.zeros(len(i))
        for at in range(0, len(i), 8192):
            a, b, some = q[i[at : at + 8192]], self.x[x[at : at + 8192]], score[at : at + 8192]
            for j in range(self.dim):  # one order of addition for a pair, wherever it is scored
                some += a[:, j] * b[:, j].astype(np.float64)
        order = np.lexsort((self.ids[x], -score, i))
        i, x, score = i[order], x[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        i, x, score = i[keep], x[keep], score[keep]
        return i, x, score / unit[i], score

    def search(self, q: np.ndarray, cut: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of up to k nearest of each query in the buckets it probes that reach its bound ``least``, a product with the query's direction."""
        if self.starts is None:
            cells = self.cells[: self.n]
            self.starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            self.stops = np.r_[self.starts[1:], self.n]
        unit = np.abs(q).max(axis=1)
        unit = unit * np.linalg.norm(q / unit[:, None], axis=1)
        direction = _directions(q)
        way = direction.astype(self.x.dtype)
        least = least - self.slack
        behind = [np.ascontiguousarray(b.T) for b in self.index.behind(direction)]
        width = 2 * self.index.axes
        new = np.flatnonzero(np.isneginf(least))
        some = np.unique(np.linspace(0, self.n - 1, BOUND_ROWS).astype(np.int64))
        for at in range(0, len(new) if len(some) > self.k else 0, 512):
            ask, cell = new[at : at + 512], self.cells[some]
            far = behind[0][:, ask][cell] if len(behind) == 1 else behind[0][:, ask][cell // width] + behind[1][:, ask][cell % width]
            s = np.where(far.T <= cut[ask, None], way[ask] @ self.x[some].T, -np.inf)
            least[ask] = np.partition(s, len(some) - self.k, axis=1)[:, len(some) - self.k] - 2 * self.slack
        found, size = [], 0
        a_now, left, rest = -1, None, None
        for at, stop in zip(self.starts.tolist(), self.stops.tolist(), strict=True):
            cell = int(self.cells[at])
            if len(behind) == 1:
                which = np.flatnonzero(behind[0][cell] <= cut)
            else:
                a, b = divmod(cell, width)
                if a != a_now:
                    limit = cut - behind[0][a]
                    left = np.flatnonzero(limit >= 0)
                    rest, a_now = behind[1][:, left] <= limit[left], a
                which = left[np.flatnonzero(rest[b])]
            for lo in range(at, stop, 4096) if len(which) else ():
                hi = min(lo + 4096, stop)
                for k in range(0, len(which), 1024):
                    w = which[k : k + 1024]
                    s = way[w] @ self.x[lo:hi].T
                    hit = np.flatnonzero(s >= least[w].astype(s.dtype)[:, None])
                    if len(hit):
                        i, x = np.divmod(hit, hi - lo)
                        found.append((w[i], x + lo, s.reshape(-1)[hit].astype(np.float64)))
                        size += len(hit)
                        if size > FOUND:
                            i, x, s, _ = self._nearest(q, unit, *(np.concatenate(c) for c in zip(*found, strict=True)))
                            found, size = [(i, x, s)], len(i)
                            full = np.arange(len(i)) - np.searchsorted(i, i) == self.k - 1
                            least[i[full]] = np.maximum(least[i[full]], s[full] - 2 * self.slack)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        i, x, _, score = self._nearest(q, unit, *(np.concatenate(c) for c in zip(*found, strict=True)))
        return i, self.ids[x], score


def _searched(k: int, dim: int, kinds: dict[int, tuple[CrossPolytope, np.dtype, int, float]]):
    """Rows (at, h, id, vec, cut, least), by (at, h, id): a block's vectors, then its queries.  A task holds one block and a few queries at a time."""
    schema = pa.schema([("query", pa.int64()), ("cand", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, waiting, count = None, None, [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, count
            if count and held is not None and held.n:
                ids, q, cut, least = (np.concatenate(c) for c in zip(*waiting, strict=True))
                i, cand, score = held.search(q, cut, least)
                for at in range(0, len(i), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i[part]]), pa.array(cand[part]), pa.array(score[part])], schema=schema)
            waiting, count = [], 0

        for batch in batches:
            at = batch.column(0).to_numpy()
            asks = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(np.r_[True, (at[1:] >> 32 != at[:-1] >> 32) | (asks[1:] != asks[:-1])])
            for lo, hi in zip(runs.tolist(), [*runs[1:].tolist(), batch.num_rows], strict=True):
                now = int(at[lo] >> 32)  # block * WAVE_TASKS + part of the queries
                if now != block:
                    yield from answers()
                    held, block = None, now
                    index, kind, rows, top = kinds[now // WAVE_TASKS]
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    held = held or _Block(k, index, dim, kind, rows, top)
                    held.add(at[lo:hi] & 0xFFFFFFFF, part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim))
                    continue
                for j in range(0, hi - lo, QUERIES):
                    few = part.slice(j, QUERIES)
                    waiting.append((few.column(2).to_numpy(), _matrix(few.column(3), dim), few.column(4).to_numpy(), few.column(5).to_numpy()))
                    count += few.num_rows
                    if count >= QUERIES:
                        yield from answers()
        yield from answers()

    return run


def usable(vector: Column, dim: int) -> Column:
    """Vectors that take part: of the right length, finite throughout and not zero."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & good & F.exists(vector, lambda c: c != 0), F.lit(False))


def _index(n: int, dim: int, hashes: int | None) -> tuple[int, int, int]:
    """Hash functions, axes and probed buckets for a range of about n vectors (a power of two)."""
    width = min(AXES, 1 << max(1, (dim - 1).bit_length()))
    h = hashes or (1 if n <= TWO_HASHES else 2)
    axes = width if n > 1024 or hashes else min(max(1, width // 2), 1 << max(0, (n // 64).bit_length() - 1))
    if h == 1:
        share = 0.92 if n <= 1024 else 0.85 if n <= 4096 else 0.7 if n <= 32_768 else 0.6
    else:
        share = min(0.5, 0.28 * (1e6 / n) ** 0.2)
    return h, axes, math.ceil(share * (2 * axes) ** h)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, hashes: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows (largest inner product) found for each row that ``queries`` selects.

    Every row is indexed.  Rows with the same vector (by a 128-bit hash) are indexed once, with their k + 1
    smallest keys, which loses nothing; every query row gets its own answer.  Candidates are ranked by inner products in
    double precision, ties to the smaller key; a row is never its own neighbour.

    Rows are split into ranges of norms, of a factor ``NORM_RANGE`` each, counted from the largest norm down.  Each range
    is hashed by direction and every query searches all of them, so no norm hides another.  A range's vectors are dealt to blocks
    of bounded bytes, each shipped once; a task holds one block, ordered by bucket, and streams the
    queries past it, so its memory follows neither the table nor a bucket.  A query is compared with all rows of the
    buckets it probes; those whose product is below its bound (the k + 1 nearest of some vectors, which are real candidates)
    can't be among its nearest.  Large tables search a twelfth of the blocks first, which gives the others close bounds.

    ``hashes`` (1 or 2) per range and the share of buckets probed follow its number of distinct vectors; recall at 20 against brute force is
    measured for vectors without structure (see the tests and README).

    Vectors that are null, of another length than the longest, zero, or hold a null or non-finite component take no part,
    and null keys neither; rows that repeat a key and vector count once.  Other columns are ignored, whatever their names.  An empty table, or no query, gives an empty result.
    """
    if hashes not in (None, 1, 2):
        raise ValueError("hashes: 1 or 2")
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vec"), queries.alias("is_query")).where("id IS NOT NULL AND vec IS NOT NULL")
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim < 1:
        return empty
    largest = F.array_max(F.transform("vec", lambda c: F.abs(c.cast("double"))))
    scaled2 = lambda a, c: a + (c.cast("double") / F.col("_m")) * (c.cast("double") / F.col("_m"))
    rows = rows.where(usable(F.col("vec"), dim)).withColumn("_m", largest).withColumn("log", F.log("_m") + F.log(F.aggregate("vec", F.lit(0.0), scaled2)) / 2).drop("_m")
    rows = rows.withColumn("h", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(29), "vec"))
    same = Window.partitionBy("h", "h2").orderBy("id")
    keys = rows.select("h", "h2", "id", "log").groupBy("h", "h2", "id").agg(F.min("log").alias("log"))
    first = keys.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    groups = durable(first.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"), F.min("log").alias("log")), "nn-groups")
    top = groups.agg(F.max("log")).first()[0]
    if top is None:
        return empty
    # Norms that are equal but for rounding share a range.
    in_range = F.floor((F.lit(top + 1e-9) - F.col("log")) / math.log(NORM_RANGE)).cast("int")
    sizes = {r["range"]: r["count"] for r in groups.groupBy(in_range.alias("range")).count().collect()}

    asked = rows.where("is_query").select("id", "h", "h2", "log", "vec")
    asking = asked.withColumn("n", F.row_number().over(same)).where("n = 1").select(F.col("id").alias("query"), "log", "vec", "h", "h2")
    asking = durable(asking, "nn-asking")
    asked = durable(asked.select(F.col("id").alias("query_id"), "h", "h2").distinct().join(asking.select("h", "h2", "query"), ["h", "h2"]).select("query_id", "query"), "nn-queries")

    shapes = {r: _index(1 << (n - 1).bit_length(), dim, hashes) for r, n in sizes.items()}
    index_at = {shape: i for i, shape in enumerate(sorted(set(shapes.values())))}
    indexes = [CrossPolytope(dim, 1, h, probes, axes) for h, axes, probes in index_at]
    element = dict(rows.dtypes)["vec"].removeprefix("array<").removesuffix(">")
    kinds, blocks, base = {}, [], {}
    for r in sorted(sizes):
        high = top - r * math.log(NORM_RANGE)
        kind = np.dtype(np.float32 if element == "float" and abs(high) < 27 else np.float64)
        cut = max(-(-sizes[r] * dim * kind.itemsize // BLOCK_BYTES), min(LEAST_BLOCKS, sizes[r] // BLOCK_ROWS), 1)
        base[r] = len(blocks), cut
        for _ in range(cut):
            kinds[len(blocks)] = indexes[index_at[shapes[r]]], kind, int(1.02 * sizes[r] / cut) + 1000, math.exp(min(high, 709.0))
            blocks.append((len(blocks), index_at[shapes[r]], high))
    vec = f"array<{element}>"
    plan = F.broadcast(spark.createDataFrame(blocks, "block int, at_index int, high double"))
    asking = durable(asking.select("query", "log", "vec").repartition("query").mapInArrow(_probing(indexes, dim), f"query long, log double, vec {vec}, cuts array<double>"), "nn-probes")
    own = {r: (indexes[index_at[shape]], *base[r]) for r, shape in shapes.items()}

    def found(lo: int, hi: int, asking: DataFrame) -> DataFrame:
        """What blocks lo to hi have for the queries (with ``least``, a bound for products with the query's direction, or null).
        Where there are few blocks, each is copied to several tasks, which share its queries."""
        ways = min(WAVE_TASKS, -(-WAVE_TASKS // (hi - lo))) if hi < len(blocks) else 1
        at = lambda block, way, bucket: F.shiftleft((block * WAVE_TASKS + way).cast("long"), 32) + bucket
        data = rows.select("h", "h2", "id", "vec").sortWithinPartitions("id").mapInArrow(_coded(own, top, lo, hi, dim), f"at long, h long, id long, vec {vec}")
        if ways > 1:
            data = data.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        bucket, way = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)), F.col("way") if ways > 1 else F.lit(0)
        none = F.lit(None).cast("double")
        data = data.select(at(F.shiftright("at", 32), way, bucket).alias("at"), "h", "id", "vec", none.alias("cut"), none.alias("least"))
        ask = asking.join(plan.where(F.col("block").between(lo, hi - 1)), F.col("least").isNull() | (F.col("least") <= F.exp("high") * (1 + 1e-6)))
        last = at(F.col("block"), F.pmod(F.xxhash64("query"), F.lit(ways)), F.lit((1 << 32) - 1))
        ask = ask.select(last.alias("at"), F.lit(0).cast("long").alias("h"), F.col("query").alias("id"), "vec", F.get("cuts", "at_index").alias("cut"), F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        both = data.unionByName(ask).withColumn("block", F.shiftright("at", 32))
        both = both.repartition("block").sortWithinPartitions("block", "at", "h", "id").drop("block")
        return both.mapInArrow(_searched(k + 1, dim, {b: kinds[b] for b in range(lo, hi)}), "query long, cand long, score double")

    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "cand")
    best = lambda df: df.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k + 1)
    ahead = max(1, len(blocks) // 12) if len(blocks) >= TWO_WAVES else 0
    no_bound = asking.withColumn("least", F.lit(None).cast("double"))
    if ahead:
        some = durable(best(found(0, ahead, no_bound)), "nn-ahead")
        bound = some.where(F.col("r") == k + 1).select(F.col("query").alias("_q"), "score")
        bounded = asking.join(bound, F.col("query") == F.col("_q"), "left").withColumn("least", F.col("score") / F.exp("log")).drop("_q", "score")
        pairs = some.drop("r").unionByName(found(ahead, len(blocks), bounded))
    else:
        pairs = found(0, len(blocks), no_bound)
    best = durable(best(pairs).drop("r"), "nn-best")
    members = best.join(groups.select(F.col("rep").alias("cand"), "ids"), "cand").select("query", "score", F.explode("ids").alias("vec_id"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k + 1)
    lists = members.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    own_list = F.slice(F.filter("list", lambda m: m["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(lists, "query").select("query_id", F.posexplode(own_list).alias("pos", "m"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("m.vec_id").alias("vec_id"), F.col("m.score").alias("score"))
