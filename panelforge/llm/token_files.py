"""Token ids in fixed-width bit-packed files: encode, pack, write, read back, random access.

A file set is a Parquet folder with one row per segment; any Spark file system
works, and Spark's commit protocol keeps files whole when tasks are tried again.
Columns of a segment: ``part``, ``segment`` (their order is the order of the ids),
``n_ids``, ``bits``, ``block_ids``, ``block_offsets`` (byte offset of each block in
the payload), ``doc_ids``, ``doc_lengths`` and ``payload``.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_worker, shared_dir, small_batches

#: Ids in a block, a multiple of 64: every block starts at a whole 64-bit word.
BLOCK_IDS = 4096
#: A segment ends after the document that takes it to this many ids.
SEGMENT_IDS = 1 << 18
#: Entries that a worker keeps of its cache of encoded chunks.
CACHE = 800_000
#: Lower-case letters of Latin-1, which every version of Unicode agrees on; and such letters with marks after them.
_LETTERS = re.compile("[a-zªµºß-öø-ÿ]+")
_TAIL = re.compile("([a-zªµºß-öø-ÿ]+)([,.!?;:]+)\\Z")

SEGMENTS = (
    "part int, segment int, n_ids long, bits int, block_ids int, block_offsets array<long>, doc_ids array<long>, doc_lengths array<long>, payload binary"
)


def min_bits(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Packs ids, low bits first, into ``bits`` bits each; 64 ids fill ``bits`` 64-bit words."""
    n = len(ids)
    lanes = np.zeros((-(-n // 64), 64), dtype=np.uint64)
    lanes.reshape(-1)[:n] = ids
    words = np.zeros((len(lanes), bits), dtype=np.uint64)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        words[:, w] |= lanes[:, j] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= lanes[:, j] >> np.uint64(64 - s)
    return words.astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    """The ``n`` ids that ``pack`` has packed, as 32-bit integers."""
    words = np.frombuffer(payload, dtype="<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        x = words[:, w] >> np.uint64(s)
        if s + bits > 64:
            x = x | (words[:, w + 1] << np.uint64(64 - s))
        lanes[:, j] = x & mask
    return lanes.reshape(-1)[:n]


def unpack_range(payload: bytes, bits: int, block_ids: int, offsets: list[int], n_ids: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a segment; only the blocks that hold them are unpacked."""
    n = max(0, min(n, n_ids - start))
    if not n:
        return np.empty(0, dtype=np.uint32)
    first, last = start // block_ids, (start + n - 1) // block_ids
    end = offsets[last + 1] if last + 1 < len(offsets) else len(payload)
    got = unpack(payload[offsets[first] : end], bits, min((last + 1) * block_ids, n_ids) - first * block_ids)
    return got[start - first * block_ids :][:n]


class ChunkEncoder:
    """Encodes texts, each distinct chunk once.

    For a tokenizer that lower-cases, turns white space into blanks, drops them before its
    merges and marks the ends of words, the ids of a text are those of its
    blank-separated chunks in turn, and a chunk that ends in commas, stops or marks after letters falls
    apart there too.  Chunks are kept in a bounded cache.  Those that are missing are encoded
    in one call, as words of one text, and told apart by the pieces that end a word.
    Texts for which lower-casing and composing might not commute are encoded whole;
    ``whole`` does that with all texts, for other tokenizers.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = whole
        pieces = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.ends = np.zeros(pieces[-1][1] + 1, dtype=bool)
        self.ends[[i for p, i in pieces if p.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}
        if not whole:
            # Words that are lower-case letters in composed form already need no normaliser.
            from tokenizers import normalizers, pre_tokenizers

            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, missing: set[str]) -> None:
        cache = self.cache
        letters = set(filter(_LETTERS.fullmatch, missing))
        cut = {c: m for c in missing - letters if (m := _TAIL.match(c))}
        letters.update(h for m in cut.values() if (h := m[1]) not in cache)
        other = [c for c in {m[2] for m in cut.values()} | (missing - letters - cut.keys()) if c not in cache]
        letters = list(letters)
        for k in range(0, len(letters), 5_000):
            some = letters[k : k + 5_000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * stops).tolist()]
                self.cache.update(zip(some, [data[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
            else:
                self.cache.update(zip(some, self._encode(some), strict=True))
        if other:
            self.cache.update(zip(other, self._encode(other), strict=True))
        self.cache.update((c, self.cache[m[1]] + self.cache[m[2]]) for c, m in cut.items())

    def _chunks(self, text: str) -> list[str] | None:
        if not text.isascii() and ("\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text)):
            return None
        if "<|" in text:
            return None
        return text.lower().replace("\n", " ").split(" ")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        chunks = [None if self.whole else self._chunks(t) for t in texts]
        missing: set[str] = set()
        for c in chunks:
            if c is not None:
                missing |= set(c).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE:
            self.cache = {"": b""}
            missing = set().union(*(c for c in chunks if c is not None)) - {""}
        self._fill(missing)
        rest = iter(self._encode([t for t, c in zip(texts, chunks, strict=True) if c is None]))
        get = self.cache.__getitem__
        return [np.frombuffer(next(rest) if c is None else b"".join(map(get, c)), dtype="<u4") for c in chunks]


def _chunked(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _segments(path: str, vocabulary: int, end_id: int, whole: bool):
    bits = min_bits(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = per_worker(("tokens", path, whole), lambda: ChunkEncoder(path, whole)), TaskContext.get().partitionId(), 0
        held, docs, total = [], [], 0
        end = np.array([end_id], dtype=np.uint32)

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.empty(0, dtype=np.uint32)
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"an id does not fit {bits} bits")
            per_block = BLOCK_IDS * bits // 8
            return pa.RecordBatch.from_pylist([{
                "part": part, "segment": segment, "n_ids": len(ids), "bits": bits, "block_ids": BLOCK_IDS, "block_offsets": [k * per_block for k in range(-(-len(ids) // BLOCK_IDS))],
                "doc_ids": docs, "doc_lengths": [len(x) for x in held], "payload": pack(ids, bits),
            }], schema=ARROW_SEGMENTS)

        for batch in (s for b in batches for s in _chunked(b)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(texts), strict=True):
                held.append(np.concatenate([ids, end]))
                docs.append(doc)
                total += len(ids) + 1
                if total >= SEGMENT_IDS:
                    yield close()
                    segment += 1
                    held, docs, total = [], [], 0
        if docs:
            yield close()

    return run


ARROW_SEGMENTS = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("block_ids", pa.int32()), ("block_offsets", pa.list_(pa.int64())),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def write_tokens(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2, out: str | None = None, text: str = "text", key: str = "doc_id", whole: bool = False) -> str:
    """Encodes every text, appends ``end_id`` and writes the ids in ascending key order; returns the folder.

    Rows are dealt by key range and sorted within ranges, so the segments in order hold
    all documents in order and no task sees more than its range.  A null text counts as
    empty (its end id only); null keys come first; rows with equal keys lie side by
    side, ordered by text.  An empty table writes an empty file set.  Other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    out = out or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_segments(tokenizer, vocabulary, end_id, whole), SEGMENTS).write.option("compression", "zstd").parquet(out)
    return out


def _bases(segments: DataFrame) -> DataFrame:
    """part, segment and ``base``: the ids before each segment.  Parts are summed first, so the
    only table sorted in one task has a row for each part."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("of_part"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("segment"))), F.lit(0))
    return segments.select("part", "segment", inside.alias("in_part")).join(parts, "part").select("part", "segment", (F.col("in_part") + F.col("of_part")).alias("base"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack(r["payload"], r["bits"], r["n_ids"]).astype("<u4")
            ends = np.cumsum(np.array(r["doc_lengths"], dtype=np.int64))
            starts = ends - r["doc_lengths"]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([r["part"]] * len(starts), pa.int32()), "segment": pa.array([r["segment"]] * len(starts), pa.int32()), "doc_id": pa.array(r["doc_ids"], pa.int64()),
                "start": pa.array(starts), "ids": pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.view(np.int32))),
            })


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _documents([batch]):
            flat, offs = part.column(4).values.to_numpy(), part.column(4).offsets.to_numpy()
            data = flat.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "segment", "doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    segments = spark.read.parquet(path)
    return segments.mapInArrow(read, schema).join(_bases(segments.select("part", "segment", "n_ids")), ["part", "segment"]).withColumn("start", F.col("start") + F.col("base")).drop("part", "segment", "base")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: doc_id, start (ids of all documents before it), ids."""
    return _placed(spark, path, _documents, "part int, segment int, doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) from the files."""
    return _placed(spark, path, _digests, "part int, segment int, doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of the whole file set: reads the segments that hold them only."""
    segments = spark.read.parquet(path)
    wanted: Column = (F.col("base") < start + n) & (F.col("base") + F.col("n_ids") > start)
    rows = segments.join(_bases(segments.select("part", "segment", "n_ids")), ["part", "segment"]).where(wanted).orderBy("base").collect()
    got = [unpack_range(bytes(r.payload), r.bits, r.block_ids, r.block_offsets, r.n_ids, max(0, start - r.base), min(start + n, r.base + r.n_ids) - max(start, r.base)) for r in rows]
    return np.concatenate(got) if got else np.empty(0, dtype=np.uint32)
