"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary comes as a table of byte strings and ranks. The driver derives
the merge list from the ranks once and ships the finished tokenizer (a few MB,
bounded by the vocabulary, not by the data) to the executors; there the
``tokenizers`` library encodes slices of each Arrow batch. Map-only: no
shuffle, and memory is bounded by one slice of texts.

Defined results: a null text encodes as the empty text (no ids); repeated rows
and columns beside the named ones pass through; output columns that clash with
an input column replace it; a text longer than a slice is a slice of its own;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradeweave.llm import hashing
from gradeweave.llm.common import SLICE_BYTES, arrow_map, rows_by_bytes


#: Bytes of known units that a worker of ``encode`` keeps, about; growing and sorting them takes several times as much for a moment.
KNOWN_BYTES = 16 << 20


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 byte string and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _halves(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``, by running the merges below its rank."""
    top = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], top))
        if ranks.get(parts[best] + parts[best + 1], top) >= top:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A ``tokenizers`` definition that encodes as the ranks do.

    ``ignore_merges`` gives a word that is itself in the vocabulary its own id
    at once, as rank-based encoders do.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    char = byte_characters()
    shown = {token: "".join(char[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := _halves(ranks, token)):
            merges.append((shown[pair[0]], shown[pair[1]]))
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def local_tokenizer(definition: str):
    """Built once per Python worker; its own threads stay off, Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.encode_special_tokens = True
    return made


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LAST = np.zeros(256, bool)  # last bytes of white space beyond ASCII
_LAST[[*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_MARK = np.zeros(256, bool)  # printable ASCII beside letters, digits and the apostrophe, which begins contractions
_MARK[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def unit_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over bytes: where units begin (the first two and the last byte never do), and what belongs to no letter from A to U+00FF."""
    white = _WHITE[data]
    other = np.zeros(len(data), bool)
    if len(at := np.flatnonzero(_LAST[data[2:]]) + 2):  # white space beyond ASCII, or taken for it: no unit ends there
        other[at] = (data[at - 1] == 0xC2) | ((data[at - 2] >= 0xE1) & (data[at - 2] <= 0xE3))
    out = np.zeros(len(data), bool)
    out[1:] = white[1:] & ~white[:-1] & ~other[:-1]
    letter = _LETTER[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[_LATIN[data[at + 1]]]
    letter[at + 1] = True
    out[1:-1] |= _MARK[data[1:-1]] & letter[:-2]
    letter[at] = True
    return out, ~letter


class _Growing:
    """An array that doubles its room when it is full."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1 << 10, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if (need := self.n + len(values)) > len(self.room):
            wider = np.zeros(max(need, 2 * len(self.room)), self.room.dtype)
            wider[: self.n] = self.room[: self.n]
            self.room = wider
        self.room[self.n : need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class _Places:
    """Hashes to places: a large sorted table and a small one that takes what is new."""

    def __init__(self):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.tables = [none, none]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for known, place in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = place[at[hit]]
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        new = (hashes, np.arange(first, first + len(hashes), dtype=np.int32))
        large, small = self.tables
        small = self._merged(small, new)
        if len(small[0]) * 4 > len(large[0]):
            large, small = self._merged(large, small), (small[0][:0], small[1][:0])
        self.tables = [large, small]

    @staticmethod
    def _merged(a, b):
        keys, places = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(keys, kind="stable")
        return keys[order], places[order]


class Encoder:
    """Texts to ids, as bytes, with a memory of units already encoded that takes ``most`` bytes, about.

    Byte-level patterns never match across the begin of a unit: a run of white
    space and what follows it, or a mark after a letter. So a text's ids are
    its units' ids in order. The units of a slice are told apart by 64-bit
    hashes, and the library encodes each new one once; units of letters alone
    go straight to its merges. Tokenizers of other kinds get whole texts.
    """

    def __init__(self, definition: str, by_units: bool = True, dtype: str = "<u4", most: int = 64 << 20):
        self.tokenizer, self.by_units, self.dtype, self.most = local_tokenizer(definition), by_units, dtype, most
        if by_units:
            d = json.loads(definition)
            d |= {"pre_tokenizer": None, "post_processor": None, "normalizer": None, "added_tokens": []}
            self.merges = local_tokenizer(json.dumps(d)).model
            self.characters = np.array([ord(c) for c in byte_characters()], "<u4")
            self.characters[10] = 10  # parts the units
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size, self.ids = _Places(), _Growing(np.int64), _Growing(np.int32), _Growing(self.dtype)

    def _bytes(self) -> int:
        return self.at.n * (8 + 4 + 8 + 4) + self.ids.n * self.ids.room.itemsize

    def _learn(self, hashes: np.ndarray, units: list[bytes], plain: np.ndarray) -> None:
        """Encode new units; those of letters alone (and a space before) need no splitting."""
        made: list = [None] * len(units)
        alone, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        if alone:
            shown = self.characters[np.frombuffer(b"\n".join([units[i] for i in alone]), np.uint8)].tobytes().decode("utf-32-le").split("\n")
            merge = self.merges.tokenize
            for i, text in zip(alone, shown):
                made[i] = [t.id for t in merge(text)]
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([units[i].decode() for i in some], add_special_tokens=False)):
                made[i] = e.ids
        size = np.fromiter(map(len, made), np.int64, len(made))
        self.known.add(hashes, self.at.n)
        self.at.extend(self.ids.n + np.cumsum(size) - size)
        self.size.extend(size)
        self.ids.extend(np.fromiter(chain.from_iterable(made), self.dtype, int(size.sum())))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_units:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self._bytes() > self.most:
            self._forget()
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n\n" + b"\n".join(raw) + b"\n", np.uint8)
        edges = 2 + np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        begins, other = unit_starts(data)
        begins[edges[:-1]] = True
        begins[edges[1:] - 1] = False  # what parts the texts
        start = np.flatnonzero(begins)
        if not len(start):
            return [b""] * len(texts)
        bounds = np.searchsorted(start, edges)
        end = np.append(start[1:], len(data))
        end = np.minimum(end, np.repeat(edges[1:] - 1, np.diff(bounds)))
        unique, first, inverse = np.unique(hashing.spans(data, start, end), return_index=True, return_inverse=True)
        slot = self.known.find(unique)
        if len(new := np.flatnonzero(slot < 0)):
            slot[new] = np.arange(self.at.n, self.at.n + len(new))
            whole = data.tobytes()
            a, b = start[first[new]], end[first[new]]
            letters = a + (data[a] == 0x20)
            others = np.concatenate(([0], np.cumsum(other, dtype=np.int32)))
            self._learn(unique[new], [whole[i:j] for i, j in zip(a.tolist(), b.tolist())], (others[b] == others[letters]) & (letters < b))
        slot = slot[inverse]
        size = self.size.values[slot].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids.values[np.repeat(self.at.values[slot] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def worker_encoder(definition: str, by_units: bool = True, dtype: str = "<u4", most: int = 64 << 20) -> Encoder:
    """The Python worker's encoder: tasks that follow each other in a worker share what it knows."""
    return Encoder(definition, by_units, dtype, most)


def splits_by_units(definition: str) -> bool:
    """Whether a tokenizer leaves its text as it is and splits it by the byte-level pattern."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    return not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def _with(schema: T.StructType, *more: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in more}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(more))


def _batch(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    names = {n.lower() for n in more}
    cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n.lower() not in names}
    return pa.RecordBatch.from_arrays([*cols.values(), *more.values()], names=[*cols, *more])


def byte_offsets(pieces: list[bytes], ids: list[int]) -> np.ndarray:
    """Start of each token in the text's bytes, and the end of the last."""
    return np.concatenate(([0], np.cumsum([len(pieces[i]) for i in ids]))).astype(np.int64)


def char_offsets(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """The code point that each byte offset lies in (a split character counts for both sides)."""
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(starts)))
    inside = np.concatenate((starts, [True]))[offsets]
    return before[offsets] - ~inside


def _joined(pieces: list[bytes], ids: bytes | None) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Add ``ids`` (little-endian uint32 ids as binary) and ``n_tokens``.

    With ``offsets`` also ``byte_offsets`` and ``char_offsets``: one start per
    token and a last end, in bytes and in code points. With ``decoded`` also
    the bytes that the ids decode to, in the same pass: what ``decode`` gives.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((tokenizer_json(ranks, pattern), sorted(ranks, key=ranks.get) if offsets or decoded else None))
    more = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if offsets:
        more += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("byte_offsets", "char_offsets")]
    if decoded:
        more.append(T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, pieces = shared.value
        encoder = worker_encoder(definition, most=KNOWN_BYTES)
        for whole in batches:
            for batch in rows_by_bytes(whole, text, SLICE_BYTES // 2):
                texts = [x or "" for x in batch.column(text).to_pylist()]
                ids = encoder(texts)
                made = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if offsets:
                    at = [byte_offsets(pieces, np.frombuffer(x, "<u4").tolist()) for x in ids]
                    made["byte_offsets"] = pa.array(at, pa.list_(pa.int64()))
                    made["char_offsets"] = pa.array([char_offsets(t.encode(), a) for t, a in zip(texts, at)], pa.list_(pa.int64()))
                if decoded:
                    made["decoded"] = pa.array([_joined(pieces, x) for x in ids], pa.binary())
                yield _batch(batch, made)

    return df.transform(arrow_map, run, _with(df.schema, *more))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", as_text: bool = False) -> DataFrame:
    """Add ``decoded`` (the exact bytes) and, if asked for, ``decoded_text``.

    Bytes are joined before they become characters, so characters that tokens
    split come back whole; bytes that are no UTF-8 show as U+FFFD in
    ``decoded_text`` only. Null ids decode as no bytes.
    """
    shared = df.sparkSession.sparkContext.broadcast(sorted(ranks, key=ranks.get))
    more = [T.StructField("decoded", T.BinaryType()), *([T.StructField("decoded_text", T.StringType())] if as_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for whole in batches:
            for batch in rows_by_bytes(whole, ids, 4 * SLICE_BYTES):
                data = [_joined(pieces, x) for x in batch.column(ids).to_pylist()]
                made = {"decoded": pa.array(data, pa.binary())}
                if as_text:
                    made["decoded_text"] = pa.array([x.decode("utf-8", "replace") for x in data], pa.string())
                yield _batch(batch, made)

    return df.transform(arrow_map, run, _with(df.schema, *more))


def definition_of(path: str) -> str:
    """A tokenizer file as one compact string for shipping to executors."""
    with open(path, encoding="utf-8") as f:
        return json.dumps(json.load(f), ensure_ascii=False)
