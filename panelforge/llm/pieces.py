"""SentencePiece encoding with byte spans in the original text, and decoding."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_beside, per_worker, small_batches, text_parts

BLANK = "▁"
#: Entries that a worker keeps of its cache of encoded chunks.
CACHE = 200_000
#: Bytes of texts that are encoded at a time (one longer text alone).
PART_BYTES = 1 << 20


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 keys and the strings that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key that ``data`` has at ``at``: its length and its replacement."""
        units, best = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


class Normaliser:
    """Longest-prefix normalisation that records, for each normalised character, the original byte
    where its source begins."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @property
    def plain(self) -> bool:
        """Every character stands for itself and blanks are kept."""
        return not self.map and not self.squeeze and self.dummy and self.escape

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and the alignment, one longer than the text."""
        if not text:
            return "", np.zeros(1, dtype=np.int64)
        if self.plain:
            wide = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            lengths = 1 + (wide > 0x7F) + (wide > 0x7FF) + (wide > 0xFFFF)
            return BLANK + text.replace(" ", BLANK), np.concatenate([[0, 0], np.cumsum(lengths)])
        data, out, at = text.encode(), [], 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            if found is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = n, data[at : at + n]
            out += [(c, at, at + found[0]) for c in found[1].decode()]
            if not found[1]:
                out.append(("", at, at + found[0]))
            at += found[0]
        if self.squeeze:
            while out and out[0][0] in ("", " "):
                out.pop(0)
            while out and out[-1][0] in ("", " "):
                out.pop()
        chars, starts, end = [], [], 0
        for c, begin, end in out:  # noqa: B007
            if c and not (self.squeeze and c == " " and chars and chars[-1] == " "):
                chars.append(c)
                starts.append(begin)
        if self.dummy and chars:
            chars.insert(0, " ")
            starts.insert(0, starts[0])
        text = "".join(chars)
        return text.replace(" ", BLANK) if self.escape else text, np.array([*starts, end], dtype=np.int64)


class PieceEncoder:
    """Ids, and on request spans, exactly as the library encodes whole texts.

    No piece of a model that splits by white space has a blank after another character,
    so no merge crosses the start of a run of blanks: the ids of a text are those of its
    chunks in turn.  That is read off the vocabulary; models for which it does not
    hold, and texts with a literal U+2581 or NUL, are encoded whole.  Each distinct
    chunk is encoded once and kept in a bounded cache.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model_pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.normalise = Normaliser(proto.normalizer_spec)
        pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.by_chunk = self.normalise.plain and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces) and 4 not in kinds and not proto.trainer_spec.treat_whitespace_as_suffix
        #: Normalised characters of each id; a byte piece has none until its character is whole.
        self.chars = np.array([len(p) if k != 6 else 0 for p, k in zip(pieces, kinds, strict=True)], dtype=np.int64)
        self.byte = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 6}
        self.unknown = [i for i, k in enumerate(kinds) if k == 2]
        self.cache: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without end ids."""
        if not self.by_chunk:
            return [np.array(x, dtype="<i4") for x in self.sp.encode(texts, num_threads=1)]
        # A chunk keeps all its blanks but the first, which stands for the blank that the library puts before it.
        chunks = [[t] if BLANK in t or "\0" in t else re.findall(r" ( *[^ ]+(?: +\Z)?| +\Z)", " " + t) if t else [] for t in texts]
        every = set().union(*chunks)
        missing = [c for c in every if c not in self.cache]
        if len(self.cache) + len(missing) > CACHE:
            self.cache = {}
            missing = list(every)
        for k in range(0, len(missing), 20_000):
            some = missing[k : k + 20_000]
            self.cache.update((c, np.array(x, dtype="<i4").tobytes()) for c, x in zip(some, self.sp.encode(some, num_threads=1), strict=True))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, c)), dtype="<i4") for c in chunks]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte, in the original text, of each piece.

        Of the byte pieces of one character, the last has the character's span and the
        others are empty, before it.
        """
        normal, align = self.normalise(text)
        took = self.chars[ids].copy()
        left = 0
        for at in np.flatnonzero(took == 0):
            lead = self.byte.get(int(ids[at]))
            if lead is None:
                continue
            if not left:
                left = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            left -= 1
            took[at] = left == 0
        if np.isin(ids, self.unknown).any():  # without byte fallback an unknown piece takes what the next known piece leaves
            took = self._with_unknown(normal, ids, took)
        ends = np.cumsum(took)
        return align[ends - took], align[ends]

    def _with_unknown(self, normal: str, ids: np.ndarray, took: np.ndarray) -> np.ndarray:
        at = 0
        for k, i in enumerate(ids):
            if i in self.unknown:
                rest = next((self.sp.id_to_piece(int(j)) for j in ids[k + 1 :] if j not in self.unknown), "")
                took[k] = (normal.index(rest, at + 1) if rest else len(normal)) - at
            at += took[k]
        return took


def _encode(model: str, text_at: int, ends: bool, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("pieces", model), lambda: PieceEncoder(model))
        tail = np.array([encoder.sp.eos_id()] if ends else [], dtype="<i4")
        for batch in batches:
            for part in text_parts(batch, text_at, PART_BYTES):
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                bare = encoder.ids(texts)
                ids = [np.concatenate([x, tail]) for x in bare]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                made = {"ids": lambda: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))}  # noqa: B023
                if "begins" in outputs or "ends" in outputs:
                    spans = [encoder.spans(t, x) for t, x in zip(texts, bare, strict=True)]
                    last = [len(t.encode()) for t in texts]
                    for which, name in enumerate(("begins", "ends")):
                        flat = np.concatenate([np.append(s[which], [n] * len(tail)) for s, n in zip(spans, last, strict=True)]).astype(np.int32)
                        made[name] = lambda flat=flat: pa.ListArray.from_arrays(offsets, pa.array(flat))  # noqa: B023
                made["decoded"] = lambda: pa.array([encoder.sp.decode(x.tolist()) for x in ids], pa.string())  # noqa: B023
                yield pa.RecordBatch.from_arrays([*part.columns, *[made[o]() for o in outputs]], [*part.schema.names, *outputs])

    return run


def encode_pieces(docs: DataFrame, model: str, text: str = "text", end_id: bool = True, outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """Adds, as asked for, ``ids``, ``begins`` and ``ends`` (bytes of the original text) and ``decoded``.

    Whole texts are encoded as the library does, in one narrow pass without a shuffle.
    The end id has an empty span after the text.  ``decoded`` is the library's decoding
    of the ids.  A null text counts as empty.  Other columns are passed through; one
    that has an output's name is replaced.  An empty table gives an empty result.
    ``model`` is a file that every executor has.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in outputs or c == text])
    kinds = {"ids": T.ArrayType(T.IntegerType()), "begins": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    return map_beside(kept, _encode(model, kept.columns.index(text), end_id, tuple(outputs)), [T.StructField(o, kinds[o]) for o in outputs])
