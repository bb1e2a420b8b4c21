"""Token-id output as wavelet matrices, one compressed file per shard.

Documents are range-sorted by key; each task encodes its range and writes a
file whenever it holds ``shard_tokens`` ids, so memory is bounded by a shard
plus one slice of texts. A file holds, for each bit of the ids (high bit
first), a bit-plane in blocks compressed one by one, with the count of ones
before each block. Access, rank, counting and occurrence lookup touch one
block a level and question; reading everything inverts the matrix at once.

File: ``magic | header length | header JSON | directory | blocks``. The
directory is an Arrow stream with each document's key and id count. Files are
named anew by every task attempt and the manifest, written as Parquet, names
those of the attempts that were committed; retries never share a file.

Defined results: a null text encodes as no ids and gets its end id only; null
keys sort first; equal keys sort by text; columns beside key and text leave,
whatever their names; a text that alone fills a shard is a shard of its own; an
empty table makes no file.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gradeweave.llm import bpe
from gradeweave.llm.common import arrow_map, attempt_name, materialize, new_dir, read_buffer, rows_by_bytes, write_bytes

MAGIC = b"GWWM0001"
BLOCK = 4096  # bytes of a plane in a block


def build(ids: np.ndarray, keys: pa.Array, lengths: np.ndarray) -> bytes:
    """The file of one shard: its ids in order, and whose they are."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, ranks, sizes, blocks = [], [], [], []
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for level in range(levels):
        ones = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
        plane = np.packbits(ones, bitorder="little")
        low, high = now[~ones], now[ones]
        zeros.append(len(low))
        now = np.concatenate((low, high))
        plane = np.pad(plane, (0, -len(plane) % BLOCK))
        counts = np.bitwise_count(plane.reshape(-1, BLOCK)).sum(axis=1, dtype=np.int64)
        ranks.append(np.concatenate(([0], np.cumsum(counts))))
        for row in plane.reshape(-1, BLOCK):
            raw = row.tobytes()
            small = squeeze(raw)
            blocks.append(small if len(small) < BLOCK else raw)
            sizes.append(len(blocks[-1]))
    sink = pa.BufferOutputStream()
    table = pa.table({"key": keys, "n": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    directory = sink.getvalue().to_pybytes()
    tables = squeeze(np.array(ranks, "<i8").tobytes() + np.array(sizes, "<i8").tobytes())
    header = json.dumps({"n": n, "levels": levels, "zeros": zeros, "directory": len(directory), "tables": len(tables)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, directory, tables, *blocks])


class WaveletMatrix:
    """A shard's file: random access to its ids without reading the rest."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", data[8:12])
        head = json.loads(bytes(data[12 : 12 + size]))
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        at = 12 + size
        self.directory = pa.ipc.open_stream(pa.py_buffer(data[at : at + head["directory"]])).read_all()
        at += head["directory"]
        per = max(0, math.ceil(math.ceil(self.n / 8) / BLOCK))
        tables = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data[at : at + head["tables"]])), "<i8")
        self.ranks = tables[: self.levels * (per + 1)].reshape(self.levels, per + 1)
        self.sizes = tables[self.levels * (per + 1) :]
        at += head["tables"]
        self.starts = at + np.concatenate(([0], np.cumsum(self.sizes)))
        self.per, self.data = per, data
        self._block = lru_cache(maxsize=256)(self._load)

    def _load(self, level: int, block: int) -> np.ndarray:
        k = level * self.per + block
        raw = bytes(self.data[self.starts[k] : self.starts[k + 1]])
        return np.frombuffer(raw if len(raw) == BLOCK else zstandard.ZstdDecompressor().decompress(raw), np.uint8)

    def _ones(self, level: int, at: int) -> int:
        """Ones before position ``at`` of a plane."""
        block, bit = divmod(at, BLOCK * 8)
        found = int(self.ranks[level][block])
        if bit:
            row = self._block(level, block)
            whole, rest = divmod(bit, 8)
            found += int(np.bitwise_count(row[:whole]).sum(dtype=np.int64))
            if rest:
                found += (int(row[whole]) & ((1 << rest) - 1)).bit_count()
        return found

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level]
        counts = ranks if bit else np.arange(len(ranks)) * (BLOCK * 8) - ranks
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self._block(level, block), bitorder="little")
        return block * BLOCK * 8 + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        found = 0
        for level in range(self.levels):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            found = found << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return found

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs before position i."""
        return self.count(token, 0, i)

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the id occurs in [start, end)."""
        end = self.n if end is None else min(end, self.n)
        if token < 0 or token >> self.levels or start >= end:
            return 0
        a, b = self._range(token, start, end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids in order: the levels are undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            plane = np.concatenate([self._load(level, b) for b in range(self.per)]) if self.per else np.zeros(0, np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(now)
            out[~ones] = now[: self.zeros[level]]
            high = now[self.zeros[level] :]
            high |= now.dtype.type(1 << (self.levels - 1 - level))
            out[ones] = high
            now = out
        return now


MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def write(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_tokens: int = 1 << 20, out_dir: str | None = None) -> DataFrame:
    """Encode, write the shards' files, and return the manifest with each shard's first position.

    Columns: part, seq, path, n_docs, n_tokens, start.
    """
    spark = df.sparkSession
    out_dir = out_dir or new_dir(spark, "wavelet")
    definition = bpe.definition_of(tokenizer_path)
    by_units = bpe.splits_by_units(definition)
    from tokenizers import Tokenizer

    wide = Tokenizer.from_str(definition).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    shared = spark.sparkContext.broadcast(definition)
    width = 4 if wide else 2
    kind = to_arrow_type(df.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = bpe.worker_encoder(shared.value, by_units, f"<u{width}")
        end = np.array([end_id], f"<u{width}").tobytes()
        keys, chunks, held = [], [], 0

        def flush():
            nonlocal seq, keys, chunks, held
            data = build(np.frombuffer(b"".join(chunks), f"<u{width}"), pa.array(keys, kind), np.array([len(x) // width for x in chunks]))
            path = f"{out_dir}/{part:06d}-{seq:06d}-{attempt_name()}.wm"
            write_bytes(path, data)
            row = [[part], [seq], [path], [len(keys)], [held]]
            seq, keys, chunks, held = seq + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=MANIFEST.names)

        for whole in batches:
            for batch in rows_by_bytes(whole, "__text", 2 << 20):
                for k, ids in zip(batch.column("__key").to_pylist(), encoder([x or "" for x in batch.column("__text").to_pylist()])):
                    keys.append(k)
                    chunks.append(ids + end)
                    held += len(ids) // width + 1
                    if held >= shard_tokens:
                        yield flush()
        if keys:
            yield flush()

    ordered = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).repartitionByRange("__key").sortWithinPartitions("__key", "__text")
    made = materialize(ordered.transform(arrow_map, run, MANIFEST), "wavelet-manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the writing stage
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return made.join(parts, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("base")


def read(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Each document's key, start and ids (little-endian uint32 as binary), from the files.

    ``key_type`` is the type that the key had when it was written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                matrix = WaveletMatrix(read_buffer(path))
                ids = matrix.ids()
                n = matrix.directory["n"].to_numpy()
                at = np.concatenate(([0], np.cumsum(n)))
                for lo in range(0, len(n), 256):
                    hi = min(len(n), lo + 256)
                    data = [ids[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(lo, hi)]
                    keys = matrix.directory["key"].slice(lo, hi - lo).combine_chunks()
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + at[lo:hi], pa.int64()), pa.array(n[lo:hi], pa.int64()), pa.array(data, pa.binary())], names=["key", "start", "n_tokens", "ids"])

    files = manifest.count()
    dealt = manifest.select("path", "start").repartition(max(1, min(-(-files // 6), 20_000)))  # a few files a task
    return dealt.transform(arrow_map, run, f"key {key_type}, start bigint, n_tokens bigint, ids binary")

