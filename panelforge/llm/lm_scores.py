"""Language-model scores: stupid backoff over n-grams of all words, fitted on the corpus that it scores.

Words are keyed by 64-bit hashes and n-grams by hashes of those, so no vocabulary is kept.  Tables and their keys:

* counts of the n-grams of each order, words being order 1, partitioned by ranges of the hash into buckets.
  A chunk of documents sends each of its distinct n-grams to its bucket once, with its sum; the
  bucket adds the sums of all chunks and sends the totals back;
* the words of a chunk's documents, by chunk, where the totals are joined to them and scores are summed per document.

Rows are packed: one for each chunk and bucket.  An n-gram in a third of all documents reaches its
bucket as a number for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, small_batches

#: Longest n-grams of the model.
ORDER = 2
#: Factor for each step back.
ALPHA = 0.4
#: Longer n-grams than words that are rarer in the corpus count as unseen.
CUTOFF = 2
#: Documents and words after which a chunk closes.
CHUNK_DOCS, CHUNK_WORDS = 2048, 1 << 21
#: N-grams of chunks in a bucket, at most.
BUCKET_ROWS = 2_000_000
#: Hashes of words that a worker keeps.
CACHE = 200_000
#: Scores are sums of whole micro-nats: their order doesn't matter.
UNIT = 1e6

NAMES = ["place", "chunk", "bucket", "grams", "times", "ids", "lengths"]
PACKED = "place long, chunk long, bucket int, grams binary, times binary, ids binary, lengths binary"
KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(len(_words(text.as_py())) for batch in batches for text in batch.column(0))
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["times"])


class _Hashes(dict):
    def __missing__(self, word):
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that are one word longer."""
    h = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _by_order(words: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the positions in ``words`` where its n-grams end, and their hashes; none crosses documents."""
    inside = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends, grams = np.arange(len(words)), words
    for n in range(1, order + 1):
        if n > 1:
            kept = inside[ends] >= n - 1
            ends = ends[kept]
            grams = _longer(before[ends - 1], words[ends])
        before = np.zeros(len(words), dtype=np.uint64)
        before[ends] = grams
        yield ends, grams


def _packed(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next: equal ones lie together and compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpacked(data, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _packed_grams(every: np.ndarray) -> bytes:
    """Sorted hashes, as the steps between them."""
    return _packed(np.diff(every, prepend=np.uint64(0)))


def _grams(data) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _packed_keys(keys: list[int | None]) -> bytes:
    """Keys, then a byte for each that tells whether it is null."""
    return np.array([k or 0 for k in keys], dtype="<i8").tobytes() + bytes(k is None for k in keys)


def _keys(data: bytes) -> pa.Array:
    n = len(data) // 9
    return pa.array(np.frombuffer(data, "<i8", n), mask=np.frombuffer(data, bool, n, 8 * n))


def _bucket_starts(every: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets, which are equal ranges of hashes, begin and end in sorted hashes."""
    bounds = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(every, bounds), len(every))


def _exploded(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker(("lm-words",), _Hashes)
        chunk = TaskContext.get().partitionId() << 32
        docs, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            words, rows = np.concatenate(texts), []
            for n, (_, grams) in enumerate(_by_order(words, lengths, order)):
                every, times = np.unique(grams, return_counts=True)
                at = _bucket_starts(every, buckets)
                for b in np.flatnonzero(np.diff(at)).tolist():
                    part, bucket = slice(at[b], at[b + 1]), n * buckets + b
                    rows.append((bucket, chunk, bucket, _packed_grams(every[part]), _packed(times[part].astype("<u4")), None, None))
            # The documents' own row: distinct words, and the place of each word among them.
            every, which = np.unique(words, return_inverse=True)
            rows.append((order * buckets + chunk, chunk, -1, _packed_grams(every), _packed(which.astype("<u4")), _packed_keys(docs), lengths.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = _words(text.as_py())
                docs.append(doc)
                texts.append(np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens)))
                size += len(tokens)
                if len(hashes) > CACHE:
                    hashes.clear()
                if len(docs) >= CHUNK_DOCS or size >= CHUNK_WORDS:
                    yield close()
                    chunk, docs, texts, size = chunk + 1, [], [], 0
        if docs:
            yield close()

    return run


def _totals(group: pa.Table) -> pa.Table:
    """A bucket's n-grams: for each chunk, how often the corpus has those that it sent."""
    if group["bucket"][0].as_py() < 0:  # a chunk's own row passes
        return group.drop_columns(["place"])
    sent = [_grams(g.as_buffer()) for g in group["grams"]]
    every, inverse = np.unique(np.concatenate(sent), return_inverse=True)
    times = np.concatenate([_unpacked(t.as_buffer(), "<u4") for t in group["times"]])
    total = np.bincount(inverse, weights=times, minlength=len(every)).astype("<i8")[inverse]
    parts = np.split(total, np.cumsum([len(g) for g in sent])[:-1])
    none = pa.nulls(len(sent), pa.binary())
    return pa.Table.from_arrays([group["chunk"], group["bucket"], none, pa.array([_packed(p) for p in parts], pa.binary()), none, none], NAMES[1:])


def _summed(order: int, alpha: float, cutoff: int, n_words: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["bucket"])
        own, replies = rows[0], rows[1:]
        docs, lengths = _keys(own["ids"]), np.frombuffer(own["lengths"], "<i8")
        words = _grams(own["grams"])[_unpacked(own["times"], "<u4")]
        totals = np.concatenate([np.empty(0, np.int64), *[_unpacked(r["times"], "<i8") for r in replies]])
        # From words upward: the longest n-gram that is seen often enough stands; each longer one that is not adds a step back.
        value, base, at = np.zeros(len(words)), np.empty(0), 0
        for n, (ends, grams) in enumerate(_by_order(words, lengths, order), 1):
            found, inverse = np.unique(grams, return_inverse=True)
            times = totals[at : at + len(found)][inverse]
            at += len(found)
            logs = np.log(np.maximum(times, 1))
            if n == 1:
                value = logs - np.log(max(n_words, 1))
            else:
                value[ends] = np.where(times >= cutoff, logs - base[ends - 1], np.log(alpha) + value[ends])
            base = np.zeros(len(words))
            base[ends] = logs
        upto = np.concatenate([[0], np.cumsum(np.rint(UNIT * value).astype(np.int64))])
        stop = np.cumsum(lengths)
        return pa.Table.from_arrays([docs, pa.array(lengths), pa.array(upto[stop] - upto[stop - lengths])], ["doc", "n_words", "micro"])

    return run


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, cutoff: int = CUTOFF, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: the key, ``n_words``, ``score`` (natural log) and ``per_word``.

    Words are lower-cased (A-Z) and separated by ASCII white space.  All documents and all words are counted.  A word w
    after the n - 1 words h, n being ``order`` or what the document's beginning leaves, scores ``c(h w) / c(h)`` if
    ``c(h w)`` is ``cutoff`` or more, else ``alpha`` times its score after h without its first word; after no word it
    scores ``c(w) / N``.  A ``cutoff`` of 1 takes all n-grams.  Each logarithm is rounded to a
    millionth, and the sums are exact.  N-grams are told apart by 64-bit hashes.

    A null or empty text scores 0 with a null ``per_word``; repeated rows are scored, and counted, each; null keys are kept;
    an empty table gives an empty result.  Other columns are ignored.
    """
    if order < 1:
        raise ValueError("order is 1 at least")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    total = rows.select("text").mapInArrow(_count, "times long").agg(F.sum("times")).first()[0] or 0
    buckets = max(4, -(-total // BUCKET_ROWS))
    packed = rows.mapInArrow(_exploded(order, buckets), PACKED)
    totals = packed.groupBy("place").applyInArrow(_totals, PACKED.removeprefix("place long, "))
    summed = totals.groupBy("chunk").applyInArrow(_summed(order, alpha, cutoff, total), "doc long, n_words long, micro long")
    score = F.col("micro") / F.lit(UNIT)
    return summed.select(F.col("doc").alias(key), "n_words", score.alias("score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("per_word"))
