"""Language ID: each document as a mixture of languages, inferred by expectation maximisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_beside, per_worker, small_batches, text_parts

#: Feature slots: character n-grams are hashed to so many.
SLOTS = 1 << 15
#: Characters of the n-grams.
ORDERS = (1, 2, 3)
#: Labelled rows that the model is fitted on, for each language; the sample's bound.
SAMPLE_ROWS = 2_000
ROUNDS = 12
#: Times the Bayesian penalty of half the log of the n-grams for each further language.
PENALTY = 8.0

#: Bytes of texts that are worked on at a time, and characters beyond which one text is worked on in parts.
PART_BYTES, LONG_TEXT = 1 << 18, 1 << 16

UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark that goes with one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Characters in lower case; what is no letter as a blank."""
    wide = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(per_worker(("letters",), _letters)[wide], wide, 32).astype(np.uint64)


def _slots(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of the n-gram that begins at each place, and whether it counts: of one or two characters, not all are blanks."""
    h = np.full(max(len(flat) - n + 1, 0), n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ flat[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ok = flat[: len(h)] != 32
    for k in range(1, n):
        ok |= flat[k : k + len(h)] != 32
    return (h >> np.uint64(40)) % np.uint64(SLOTS), ok if n < 3 else np.ones(len(h), dtype=bool)


def _of_long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of one text, part by part: what is held at a time doesn't grow with the text."""
    total, carry = np.zeros(SLOTS), np.full(1, 32, dtype=np.uint64)
    for at in range(0, len(text) + 1, LONG_TEXT):
        part = _codes(text[at : at + LONG_TEXT])
        flat = np.concatenate([carry, part, carry[:0] if at + LONG_TEXT <= len(text) else np.full(1, 32, dtype=np.uint64)])
        keep = np.r_[True, (flat[1:] != 32) | (flat[:-1] != 32)]
        keep[: len(carry)] = True
        flat = flat[keep]
        for n in ORDERS:
            slot, ok = _slots(flat, n)
            first = max(len(carry) - n + 1, 0)  # earlier ones end before this part
            total += np.bincount(slot[first:][ok[first:]].astype(np.int64), minlength=SLOTS)
        carry = flat[-(max(ORDERS) - 1) :]
    slot = np.flatnonzero(total)
    return slot, total[slot]


def _of_short(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = np.full(1, 32, dtype=np.uint64)
    wide = [_codes(t) for t in texts]
    flat = np.concatenate([x for t in wide for x in (blank, t, blank)])
    owner = np.repeat(np.arange(len(wide)), [len(t) + 2 for t in wide])
    keep = np.r_[True, (flat[1:] != 32) | (flat[:-1] != 32) | (owner[1:] != owner[:-1])]
    flat, owner = flat[keep], owner[keep]
    seen = []
    for n in ORDERS:
        slot, ok = _slots(flat, n)
        ok &= owner[: len(slot)] == owner[len(owner) - len(slot) :]
        seen.append((owner[: len(slot)][ok].astype(np.uint64) << np.uint64(32)) | slot[ok])
    both, count = np.unique(np.concatenate(seen), return_counts=True)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), count.astype(np.float64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts: text, slot and count of every n-gram slot that a text has, by text."""
    got = []
    short = [i for i, t in enumerate(texts) if len(t) <= LONG_TEXT]
    if short:
        own, slot, count = _of_short([texts[i] for i in short])
        got.append((np.array(short)[own], slot, count))
    for i, t in enumerate(texts):
        if len(t) > LONG_TEXT:
            slot, count = _of_long(t)
            got.append((np.full(len(slot), i), slot, count))
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    own, slot, count = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(own, kind="stable")
    return own[order], slot[order], count[order]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to a row of slot counts for each language of a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in text_parts(batch, 1, PART_BYTES):
            names = part.column(0).to_pylist()
            own, slot, count = features([t or "" for t in part.column(1).to_pylist()])
            for lang in set(names):
                of = np.array([x == lang for x in names])[own] if len(own) else np.empty(0, bool)
                total.setdefault(lang, np.zeros(SLOTS))
                total[lang] += np.bincount(slot[of], weights=count[of], minlength=SLOTS)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(list(total), SLOTS).tolist(), pa.string()), pa.array(np.tile(np.arange(SLOTS), len(total)), pa.int32()), pa.array(np.concatenate(list(total.values())).astype(np.int64))], ["lang", "slot", "n"]
        )


class LanguageModel:
    """Probabilities of slots given languages; its size depends on the number of languages only."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        self.p = ((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1])).T.copy() if langs else np.empty((SLOTS, 0))

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions of each text over its language set (0 outside), n-grams of each text, and log-likelihood per n-gram.

        EM over all languages orders them by proportion; for each k the first k are
        fitted again, and the set with the highest penalised likelihood is taken.
        """
        n, k = len(texts), len(self.langs)
        own, slot, count = features(texts)
        total = np.bincount(own, weights=count, minlength=n)
        if not k or not len(own):
            return np.zeros((n, k)), total, np.zeros(n)
        p = np.ascontiguousarray(self.p[slot].T)  # a row for each language: sums over them run along whole rows
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rows = own[first]
        total_rows = total[rows]

        def fit(mask: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            pi = (mask / mask.sum(axis=1, keepdims=True)).T
            sizes = np.diff(np.r_[first, len(own)])
            for _ in range(rounds):
                mixed = np.repeat(pi, sizes, axis=1) * p
                pi = np.add.reduceat(mixed * (count / mixed.sum(axis=0)), first, axis=1) / total_rows
            likely = np.log((np.repeat(pi, sizes, axis=1) * p).sum(axis=0)) * count
            return pi.T, np.add.reduceat(likely, first)

        full, _ = fit(np.ones((len(rows), k)), ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        best_pi, best, like = np.zeros((len(rows), k)), np.full(len(rows), -np.inf), np.zeros(len(rows))
        for m in range(1, k + 1):
            mask = np.zeros((len(rows), k))
            np.put_along_axis(mask, order[:, :m], 1.0, axis=1)
            pi, ll = fit(mask, 0 if m == 1 else ROUNDS // 2)
            score = ll - PENALTY * (m - 1) * 0.5 * np.log(np.maximum(total[rows], 2))
            better = score > best
            best_pi[better], best[better], like[better] = pi[better], score[better], ll[better]
        pis = np.zeros((n, k))
        pis[rows] = best_pi
        per = np.zeros(n)
        per[rows] = like / total[rows]
        return pis, total, per


def fit_languages(labelled: DataFrame, lang: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS, order: Column | None = None) -> LanguageModel:
    """A model from at most ``sample_rows`` distinct labelled texts of each language.

    They come in the order of ``order`` (default: a hash of the text), so the sample is
    the same for every partitioning.  Rows with a null language or text are left out.
    The driver receives one row of slot counts for each language.
    """
    from pyspark.sql import Window

    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    own = F.xxhash64("text", F.lit(11))
    rows = rows.withColumn("_h", own if order is None else order)
    # The bound on the hash that about sample_rows texts of each language pass; the rest never reach a window.
    sizes = rows.select("lang", own.alias("_t")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    span = float(1 << 64)
    limit = F.coalesce(*[F.when(F.col("lang") == r.lang, F.lit(-(2.0**63) + span * min(1.0, 1.5 * sample_rows / r.rows + 0.0))) for r in sizes], F.lit(2.0**63)) if sizes else F.lit(2.0**63)
    near = rows.where(F.col("_h").cast("double") <= limit).groupBy("lang", "text").agg(F.min("_h").alias("_h"))
    by = Window.partitionBy("lang").orderBy("_h", "text")
    sample = near.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= sample_rows).select("lang", "text")
    counts = sample.repartition(24).mapInArrow(_counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).where("n > 0")
    per_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c")).orderBy("lang").collect()
    table = np.zeros((len(per_lang), SLOTS))
    for i, r in enumerate(per_lang):
        table[i, [c.slot for c in r.c]] = [c.n for c in r.c]
    return LanguageModel([r.lang for r in per_lang], table)


def _predict(model: LanguageModel, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in text_parts(batch, text_at, PART_BYTES):
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                pi, total, _ = model.mixtures(texts)
                empty = (total == 0) | np.array([not any(map(str.isalpha, t)) for t in texts])
                best = pi.argmax(axis=1) if len(model.langs) else np.zeros(len(texts), dtype=int)
                pred = np.where(empty | (not model.langs), len(model.langs), best)
                score = np.where(pred < len(model.langs), pi.max(axis=1, initial=0.0), 0.0)
                mixed = [[model.langs[j] for j in np.argsort(-row, kind="stable") if row[j] > 0] for row in np.where(empty[:, None], 0.0, pi)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(mixed, pa.list_(pa.string()))], [*part.schema.names, "lang_pred", "score", "languages"]
                )

    return run


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (its proportion, 0 to 1) and ``languages`` (the language set, largest share first).

    Whole texts are read in one narrow pass, in parts of bounded size: neither many long texts
    nor one very long one add to what a worker holds, but for the text itself.  A text that is null or has no letter, or
    any text where the model has no language, is ``und`` with score 0 and an empty set.
    A letter is what Unicode calls one.  Ties go to the language that sorts first.  Rows that repeat get equal results.  Other columns are passed through; those
    with an output's name are replaced.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score", "languages")])
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))]
    return map_beside(kept, _predict(model, kept.columns.index(text)), made)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is 2 modulo 4; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))
