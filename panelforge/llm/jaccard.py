"""Jaccard join of documents on word n-grams.

The join is exact.  Shingles are 64-bit hashes, and a document's set is their sorted array.

1. *Classes.*  Documents with equal sets form a class (128-bit hash); only classes are joined.
2. *Common shingles.*  Each task counts the shingles of its documents and hands on its most
   frequent ones; the ``COMMON`` most frequent overall come last in the order of shingles
   (by count), the others first (by hash).  Any order that all documents share keeps
   the join exact; this one only makes it cheap where passages recur.
3. *Prefixes.*  Sets with similarity t share one of the first ``n - ceil(t n) + 1`` shingles.  Rows
   (shingle, class) are shuffled by shingle, and very common ones are spread over salts.
4. *Hubs.*  In each shingle's group every class is paired with one hub; pairs that
   share enough prefix shingles are compared, and components found.  So a group of near
   copies costs a comparison for each member, not for each pair.
5. *The rest.*  Groups that still span several components are compared across components.  Small
   groups are joined with themselves; a pair needs as many common prefix shingles as its
   sizes demand.  Large groups are cut into tiles of bounded size, ordered by set size; in
   a tile the classes' hashed parity bitmaps are compared block by block, within the sizes that can
   match: bits that differ bound the overlap from above.  A tile sends the likeliest pair of each component
   in it, and once those are decided and contracted, the classes that still have a pair within the bound across
   components; their sets are compared in the tile, and links that join components leave it.  So a tile's
   output is bounded by its classes, never their pairs.
6. *Decision.*  Pairs meet in tiles by size band, which hold each set once with its bitmap; pairs
   within the bitmaps' bound are decided by intersecting the sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable, key_bits, maybe_in, most_frequent, small_batches
from .components import components

WORDS = 5
#: Shingles that are ordered last; 16 bytes each on the driver and in each Python worker.
COMMON = 1 << 17
#: Rows of a shingle, as counted, beyond which it is spread over salts.
SALT_ROWS = 50_000
#: Entries of a worker's cache of word hashes.
CACHE = 150_000
#: Sets that a task remembers, so as not to send their copies again.
SEEN = 200_000
#: Bytes of sets in a tile (each set counted for each pair), and its pairs.
TILE_BYTES = 8 << 20
TILE_PAIRS = 800
#: Pairs of a set that stay in one tile, so that the set is sent once for them.
PAIRS_TOGETHER = 64
#: Groups of a shingle with more classes than this are compared in tiles of at most about so many rows a side.
LARGE_GROUP, GROUP_TILE = 64, 2048
#: Shingles of all sets of such a side, at most about (8 bytes each, and as many bits in bitmaps).
GROUP_SHINGLES = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


class _WordHashes(dict):
    def __init__(self, of_word):
        self.of_word = of_word

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.of_word(word)
        return h


class Shingler:
    """Sorted distinct shingle hashes of a text, and the hash of that array."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.cache, self.of_array = words, _WordHashes(xxhash.xxh64_intdigest), xxhash.xxh3_128_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() folds A-Z alone, and bytes.split() splits at \x20 and \x09-\x0D alone.
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, dtype=np.uint64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        w = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        k = min(self.words, len(w))
        s = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            s = (s ^ w[j : j + len(s)]) * _MIX[j % 5]
            s ^= s >> np.uint64(31)
        s.sort()
        first = np.empty(len(s), dtype=bool)
        first[0], first[1:] = True, s[1:] != s[:-1]
        return s if first.all() else s[first]

    def digest(self, shingles: np.ndarray) -> tuple[int, int]:
        """The 128-bit hash of a set, as two signed integers."""
        h = self.of_array(shingles.tobytes())
        return tuple(np.array([h & (2**64 - 1), h >> 64], dtype=np.uint64).view(np.int64).tolist())


class _Counter:
    """Frequent shingles of a task in bounded memory: the least frequent go when the table is full."""

    def __init__(self, held: int = 100_000, buffer: int = 1_000_000):
        self.held, self.buffer = held, buffer
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, shingles: np.ndarray) -> None:
        self.waiting.append(shingles)
        self.size += len(shingles)
        if self.size > self.buffer:
            self._merge()

    def _merge(self) -> None:
        new, n = np.unique(np.concatenate([np.empty(0, np.uint64), *self.waiting]), return_counts=True)
        keys, inverse = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([self.counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > self.held:
            best = np.argpartition(-counts, self.held)[: self.held]
            keys, counts = keys[best], counts[best]
        self.keys, self.counts, self.waiting, self.size = keys, counts, [], 0

    def top(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        often = self.counts >= 3
        keys, counts = self.keys[often], self.counts[often]
        best = np.argsort(-counts, kind="stable")[:n]
        return keys[best], counts[best]


def _classes(words: int, handed_on: int = 20_000):
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingle", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counter, seen = Shingler(words), _Counter(), set()
        for batch in batches:
            docs, sizes, keys = batch.column(0), [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                key = shingler.digest(s) if len(s) else (None, None)
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    counter.add(s)
                sizes.append(len(s))
                keys.append(key)
            none = pa.nulls(len(sizes), pa.int64())
            first, second = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([docs, pa.array(sizes, pa.int64()), first, second, none, none], schema=schema)
        keys, counts = counter.top(handed_on)
        none = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)

    return run


def prefix_size(n: np.ndarray | int, percent: int):
    return n - -(-percent * n // 100) + 1


def _prefixes(words: int, percent: int, common: tuple[np.ndarray, np.ndarray]):
    keys, counts = common  # sorted by key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            got = []
            for text in batch.column(0):
                s = shingler(text.as_py())
                if not len(s):
                    continue
                key = shingler.digest(s)
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                take = prefix_size(len(s), percent)
                times = np.zeros(len(s), dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    hit = keys[at] == s
                    times[hit] = counts[at[hit]]
                    rare = np.flatnonzero(~hit)  # in hash order already
                    if len(rare) >= take:
                        first = rare[:take]
                    else:
                        often = np.flatnonzero(hit)
                        first = np.concatenate([rare, often[np.argsort(times[often], kind="stable")][: take - len(rare)]])
                else:
                    first = np.arange(take)
                parts = -(-times[first] // SALT_ROWS)
                salt = np.where(parts > 1, 1 + key[0] % np.maximum(parts, 1), 0)
                got.append((s[first].view(np.int64), np.full(take, key[0]), np.full(take, len(s)), salt))
            if got:
                shingle, s1, n, salt = (np.concatenate(c) for c in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(s1), pa.array(n.astype(np.int32)), pa.array(salt.astype(np.int32))], ["shingle", "s1", "n", "salt"])

    return run


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit i tells whether an odd number of shingles hash to i; eight bits or more for each shingle."""
    bits = max(256, 1 << (8 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bits: halves are combined by exclusive or, which keeps parities."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def overlap_bound(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray) -> int:
    """The most elements that two sets can share: every bit that differs is an element of one alone."""
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return (n_a + n_b - differ) // 2


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough: by their exact intersection."""
    if len(x) > len(y):
        x, y = y, x
    where = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[where] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                sets = [shingler(t.as_py()) for t in part.column(1)]
                keys = [shingler.digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["rep", "s1", "s2", "n", "bits", "shingles"],
                )

    return run


def _compare(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        is_set = tile["rep"].is_valid().to_numpy()
        sets, pairs = tile.filter(pa.array(is_set)), tile.filter(pa.array(~is_set))
        at: dict[int, list[int]] = {}
        for i, s in enumerate(sets["s1"].to_pylist()):
            at.setdefault(s, []).append(i)
        rep, n = sets["rep"].to_pylist(), sets["n"].to_pylist()
        bits = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in sets["bits"]]
        arrays = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in sets["shingles"]]
        links = []
        for a, b in zip(pairs["s1"].to_pylist(), pairs["s2"].to_pylist(), strict=True):
            for i in at.get(a, []):
                for j in at.get(b, []):
                    least = -(-percent * (n[i] + n[j]) // (100 + percent))
                    if overlap_bound(n[i], n[j], bits[i], bits[j]) < least:
                        continue
                    if similar(arrays[i], arrays[j], percent):
                        links.append((rep[i], rep[j]))
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _bound(percent: int, tile: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a tile whose rows are sorted by set size: places of rows and of columns, and for each two of them by how much
    the bitmaps' bound exceeds the least overlap; -1 for pairs of one label, or that the tile is not for."""
    n, label, part = (tile[c].to_numpy() for c in ("n", "label", "part"))
    bits = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in tile["bits"]]
    width = np.array([len(x) for x in bits])
    cross = tile["lo"][0].as_py() != tile["hi"][0].as_py()
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        # Sizes that match differ by a factor of two at most, and so do the widths of their bitmaps.
        stop = int(np.searchsorted(n, n[own[-1]] * 100 // percent, side="right"))
        words = np.stack([folded(bits[j], w) for j in range(own[0], stop)], axis=1)
        for at in range(own[0], own[-1] + 1, 256):
            end = min(at + 256, own[-1] + 1)
            last = int(np.searchsorted(n, n[end - 1] * 100 // percent, side="right"))
            rows, cols = np.arange(at, end), np.arange(at, last)
            differ = np.zeros((len(rows), len(cols)), dtype=np.int32)
            for k in range(w):
                differ += np.bitwise_count(words[k, rows - own[0]][:, None] ^ words[k, cols - own[0]][None, :])
            both = n[rows][:, None] + n[cols][None, :]
            spare = (both - differ) // 2 - -(-percent * both // (100 + percent))
            ok = (label[rows][:, None] != label[cols][None, :]) & (rows[:, None] < cols[None, :])
            if cross:
                ok &= part[rows][:, None] != part[cols][None, :]
            yield rows, cols, np.where(ok, spare, -1)


def _likeliest(percent: int):
    """Of each label in a tile the likeliest pair with another one: at most a pair for each label."""
    schema = pa.schema([("a", pa.int64()), ("n_a", pa.int64()), ("b", pa.int64()), ("n_b", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("n", "ascending"), ("s1", "ascending")])
        n, s1 = tile["n"].to_numpy(), tile["s1"].to_numpy()
        best, mate = np.full(len(n), -1), np.zeros(len(n), dtype=np.int64)
        for rows, cols, spare in _bound(percent, tile):
            for here, there, x in ((rows, cols, spare), (cols, rows, spare.T)):
                at = x.argmax(axis=1)
                most = x[np.arange(len(here)), at]
                better = most > best[here]
                best[here[better]], mate[here[better]] = most[better], there[at[better]]
        _, label = np.unique(tile["label"].to_numpy(), return_inverse=True)
        order = np.lexsort((s1, -best, label))
        first = order[np.r_[True, label[order][1:] != label[order][:-1]]]
        i = first[best[first] >= 0]
        j = mate[i]
        swap = s1[i] > s1[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.Table.from_arrays([pa.array(x) for x in (s1[i], n[i], s1[j], n[j])], schema=schema)

    return run


def _undecided(percent: int):
    """The classes of a tile that the bitmaps leave a pair with another label."""
    schema = pa.schema([("shingle", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.int32()), ("s1", pa.int64()), ("n", pa.int64()), ("label", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("n")
        some = np.zeros(tile.num_rows, dtype=bool)
        for rows, cols, spare in _bound(percent, tile):
            some[rows] |= (spare >= 0).any(axis=1)
            some[cols] |= (spare >= 0).any(axis=0)
        return tile.select(schema.names).filter(pa.array(some)).cast(schema)

    return run


def _spanning(percent: int):
    """Links of a tile that join its labels as all its links do: a pair within a component that is known so far is not compared."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("n")
        n, rep = tile["n"].to_numpy(), tile["rep"].to_numpy()
        arrays = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in tile["shingles"]]
        _, label = np.unique(tile["label"].to_numpy(), return_inverse=True)
        links = []
        for rows, cols, spare in _bound(percent, tile):
            i, j = np.nonzero(spare >= 0)
            order = np.argsort(-spare[i, j], kind="stable")
            for x, y in zip(rows[i[order]].tolist(), cols[j[order]].tolist(), strict=True):
                if label[x] != label[y] and similar(arrays[x], arrays[y], percent):
                    links.append((rep[x], rep[y]))
                    label[label == label[y]] = label[x]
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _cut(big: DataFrame) -> DataFrame:
    """Large groups in slices of bounded rows and set bytes, each two of which meet in a tile (shingle, lo, hi)."""
    slices = F.ceil(F.greatest(F.col("size") / GROUP_TILE, F.col("weight") / GROUP_SHINGLES)).cast("int")
    cut = big.withColumn("part", F.pmod(F.xxhash64("s1"), slices).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), slices - 1)))
    return cut.select("shingle", F.least("part", "_k").alias("lo"), F.greatest("part", "_k").alias("hi"), "part", "s1", F.col("n").cast("long").alias("n"), "label")


def _set_table(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Sets and bitmaps of the classes whose ``s1`` is wanted, from their representatives' texts."""
    wanted = durable(classes.join(wanted.distinct(), "s1").select("rep", "s1", "s2"), "jj-wanted")
    # A bit set of bounded size picks the texts where they lie; keys that it lets through in error go in the join below.
    own = maybe_in(docs, F.xxhash64("doc"), key_bits(wanted.select(F.xxhash64("rep"))), "_in").where("_in").select("doc", "text")
    sets = own.mapInArrow(_sets(words), "rep long, s1 long, s2 long, n long, bits binary, shingles binary")
    # A key may repeat with another text: only the class that it stands for counts.
    return durable(sets.join(wanted.hint("merge"), ["rep", "s1", "s2"], "left_semi").dropDuplicates(["s1", "s2"]), "jj-sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("s1")).unionByName(pairs.select(F.col("b").alias("s1")))


def _decided(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, n_a, b, n_b) of classes, those that are similar, as keys of representatives."""
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / F.lit(float(np.log(1.25)))).cast("int")
    banded = pairs.withColumn("band_a", band("n_a")).withColumn("band_b", band("n_b"))
    # One row for each pair of bands that sizes allow: a few hundred at most, so they go into the plan as a literal.
    work = banded.groupBy("band_a", "band_b").agg(F.sum((F.col("n_a") + F.col("n_b")) * 10).alias("bytes"), F.count(F.lit(1)).alias("pairs")).collect()
    chunks = {f"{r.band_a}:{r.band_b}": max(-(-int(r.bytes) // TILE_BYTES), -(-r.pairs // TILE_PAIRS)) for r in work}
    of_band = F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv]) if chunks else F.create_map(F.lit(""), F.lit(1))
    bands = F.concat_ws(":", "band_a", "band_b")
    # Pairs are dealt by their first class, a hub's many pairs in parts: by the second, a hub's set would go to every tile.
    many = banded.groupBy("a", "band_b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_TOGETHER).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    dealt = F.pmod(F.xxhash64("a", part), F.element_at(of_band, bands))
    tiled = banded.join(many, ["a", "band_b"], "left").withColumn("tile", F.xxhash64("band_a", "band_b", dealt)).select("tile", "a", "b")
    held = tiled.select("tile", F.col("a").alias("s1")).unionByName(tiled.select("tile", F.col("b").alias("s1"))).distinct().join(sets, "s1")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = held.select("tile", "rep", "s1", "s2", "n", "bits", "shingles").unionByName(
        tiled.select("tile", none("long", "rep"), F.col("a").alias("s1"), F.col("b").alias("s2"), none("long", "n"), none("binary", "bits"), none("binary", "shingles"))
    )
    return durable(rows.groupBy("tile").applyInArrow(_compare(percent), "a long, b long"), "jj-links")


def _labelled(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the label of their component so far; a class without links is its own."""
    names = classes.select("s1", "rep").join(found, F.col("rep") == F.col("node")).select("s1", F.xxhash64("component").alias("label"))
    return members.join(names, "s1", "left").withColumn("label", F.coalesce("label", "s1"))


def _enough(common: Column, percent: int) -> Column:
    """Whether two sets that share at most so many prefix shingles, and any others, can be similar."""
    a, b = F.col("n_a"), F.col("n_b")
    least = F.ceil((a + b) * percent / (100 + percent) - F.lit(1e-9))
    rest = lambda n: F.ceil(n * percent / 100 - F.lit(1e-9)) - 1  # noqa: E731  what the prefix leaves
    return common >= least - F.greatest(rest(a), rest(b))


def jaccard_classes(docs: DataFrame, percent: int = 80, words: int = WORDS, text: str = "text", key: str = "doc_id", common: int = COMMON) -> DataFrame:
    """One row for each row of ``docs``: the key, ``n_shingles``, ``component_id`` (the smallest key reachable by links, its own
    included) and ``n_copies`` (documents with the same set).

    Two documents link when ``100 * common >= percent * union`` of their sets of distinct
    ``words``-word shingles; A-Z is lower-cased and words are what white space (ASCII) separates.
    With fewer words the whole sequence is the one shingle; a text without words, or a null one, has none and
    links with nothing.  Whole texts are used, and no link is lost: see the module's steps.

    Rows that repeat a key and text are rows of one class.  Null keys get the component of their class.
    Empty tables give empty results.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    first = durable(docs.mapInArrow(_classes(words), "doc long, n long, s1 long, s2 long, shingle long, times long"), "jj-first")
    rows = first.where("n IS NOT NULL").select("doc", "n", "s1", "s2")
    classes = durable(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "jj-classes")

    often = durable(first.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")), "jj-often")
    often = most_frequent(often, common).collect()
    often = np.array([(r.shingle, r.times) for r in often], dtype=np.int64).reshape(-1, 2)
    shingle, times = often[:, 0].copy().view(np.uint64), often[:, 1].copy()
    order = np.argsort(shingle)

    rows_of_prefixes = docs.select("text").mapInArrow(_prefixes(words, percent, (shingle[order], times[order])), "shingle long, s1 long, n int, salt int")
    by_shingle = Window.partitionBy("shingle", "salt").orderBy("s1", "n")
    pre = rows_of_prefixes.repartition("shingle", "salt")
    pre = pre.withColumn("hub", F.first("s1").over(by_shingle)).withColumn("n_hub", F.first("n").over(by_shingle))
    pre = pre.withColumn("again", (F.lag("s1").over(by_shingle) == F.col("s1")) & (F.lag("n").over(by_shingle) == F.col("n")))
    alone = (F.col("s1") == F.col("hub")) & (F.col("n") == F.col("n_hub"))
    shared = durable(pre.where(~F.coalesce("again", F.lit(False)) & (~alone | (F.col("salt") > 0))).drop("again"), "jj-shared")

    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    hubs = shared.where(~alone).select(F.col("hub").alias("a"), F.col("n_hub").alias("n_a"), F.col("s1").alias("b"), F.col("n").alias("n_b")).where(fits)
    hubs = hubs.groupBy("a", "n_a", "b", "n_b").agg(F.count(F.lit(1)).alias("c")).where(_enough(F.col("c"), percent))
    hubs = durable(hubs.drop("c"), "jj-pairs")
    links = _decided(_set_table(docs, classes, _ends(hubs), words), hubs, percent)
    # The groups again, with their hubs, and the component that each class is in so far.
    members = shared.select("shingle", "s1", "n").unionByName(shared.select("shingle", F.col("hub").alias("s1"), F.col("n_hub").alias("n")).distinct()).distinct()
    members = durable(_labelled(members, classes, components(links)), "jj-members")
    groups = members.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    groups = groups.where("low <> high").select("shingle", "size", "weight")
    members = durable(members.join(groups, "shingle"), "jj-open")

    large = F.col("size") > LARGE_GROUP
    big = members.where(large)
    in_big = big.groupBy(F.col("s1").alias("_s")).agg(F.count(F.lit(1)).alias("big"))  # common shingles that small groups don't show
    few = members.where(~large).join(in_big, F.col("s1") == F.col("_s"), "left").withColumn("big", F.coalesce("big", F.lit(0)))
    side = lambda x: few.select("shingle", F.col("s1").alias(x), F.col("n").alias(f"n_{x}"), F.col("label").alias(f"label_{x}"), F.col("big").alias(f"big_{x}"))
    across = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & fits
    rest = side("a").hint("merge").join(side("b").hint("merge"), "shingle").where(across)
    rest = rest.groupBy("a", "n_a", "b", "n_b").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("big_a", "big_b")).alias("big"))
    rest = durable(rest.where(_enough(F.col("c") + F.col("big"), percent)).drop("c", "big"), "jj-pairs")

    sets = _set_table(docs, classes, _ends(rest).unionByName(in_big.select(F.col("_s").alias("s1"))), words)
    # First each component that a tile holds sends its likeliest pair, which joins most of what hangs together; then what
    # bitmaps still leave across components is decided within the tiles.
    bits, pairs_of = sets.select("s1", "n", "bits"), "a long, n_a long, b long, n_b long"
    tile = ["shingle", "lo", "hi"]
    likeliest = _cut(big).join(bits, ["s1", "n"]).groupBy(*tile).applyInArrow(_likeliest(percent), pairs_of)
    near = rest.select("a", F.col("n_a").cast("long"), "b", F.col("n_b").cast("long"))
    links = durable(links.unionByName(_decided(sets, durable(likeliest.unionByName(near).distinct(), "jj-pairs"), percent)), "jj-links")
    big = _labelled(big.drop("label"), classes, components(links))
    left = _cut(big).join(bits, ["s1", "n"]).groupBy(*tile).applyInArrow(_undecided(percent), "shingle long, lo int, hi int, part int, s1 long, n long, label long")
    left = durable(left, "jj-left").join(sets.select("rep", "s1", "n", "bits", "shingles"), ["s1", "n"])
    links = links.unionByName(left.groupBy(*tile).applyInArrow(_spanning(percent), "a long, b long"))

    final = components(links).select(F.col("node").alias("rep"), "component")
    named = classes.join(final, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"), F.col("copies").alias("n_copies"))
    out = rows.join(named, ["s1", "s2"], "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
