"""Best-fit packing of documents into token sequences by linear grouping.

1. Pieces: documents are encoded where they are read, get an end id, and are
   cut where longer than ``cap`` (whole pieces last, the first takes the rest).
   Each task numbers its pieces of each length. Ids are written once.
2. Plan, from the counts of each length alone. There are at most ``cap``
   lengths, so the plan's work and size depend on ``cap`` and not on the
   documents: lengths over a share of ``cap`` are cut, longest first, into
   groups of equal cardinality and rounded up to their group's longest; the
   tightest of a few settings of share and groups is taken; configurations of these few sizes are optimised as a linear
   program by column generation (a knapsack prices a new configuration), and
   whole multiples are kept. Actual lengths take the configurations' places,
   longest first, which leaves more room than the rounded ones; all others go,
   longest first, to the fullest sequence that has room (best fit).
3. Places: the plan is a list of runs, each giving consecutive pieces of one
   length to consecutive sequences. A piece's number among all of its length is
   its number in its task plus those of earlier tasks; with it, its run gives
   the sequence and offset. One length, whatever its share of the rows, is
   spread over all tasks.

Defined results: a null text is empty and packs its end id only; null and
repeated keys are rows like others; an empty table packs nothing; a text longer
than a slice is a slice of its own; other columns are ignored, whatever their
names; reruns pack as tightly, but equal lengths may change places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gradeweave.llm import bpe
from gradeweave.llm.common import arrow_map, new_dir, rows_by_bytes

CAP = 2048
#: Groups, and the share of ``cap`` over which lengths are grouped: many sizes of two or three a sequence, or few of up to seven.
SETTINGS = ((256, 1 / 3), (48, 1 / 8))


class Run(NamedTuple):
    """Pieces ``first``, ``first + 1``... of a length go to sequences from ``sequence`` on, ``each`` to one, from ``offset``."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


def best_pattern(sizes: list[int], values: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``cap`` of the highest value, by rounds of one more item."""
    best, picks = np.zeros(cap + 1), []
    for _ in range(cap // min(sizes)):
        more, pick = best.copy(), np.full(cap + 1, -1)
        for i, (size, value) in enumerate(zip(sizes, values)):
            found = best[: cap + 1 - size] + value
            better = found > more[size:] + 1e-12
            more[size:][better] = found[better]
            pick[size:][better] = i
        if (pick < 0).all():
            break
        picks.append(pick)
        best = more
    pattern, room = np.zeros(len(sizes)), cap
    for pick in reversed(picks):
        if (i := pick[room]) >= 0:
            pattern[i] += 1
            room -= sizes[i]
    return float(best[cap]), pattern


def configurations(sizes: list[int], demand: list[int], cap: int) -> list[tuple[np.ndarray, float]]:
    """Fewest sequences for a demand of few sizes, as (pattern, how often), fractions allowed.

    Column generation: the basis starts with one size a pattern; the prices of
    the sizes show by a knapsack whether any pattern betters it. Every basis on
    the way covers the demand, so the bound on rounds costs tightness only.
    """
    k = len(sizes)
    patterns = np.diag([float(cap // s) for s in sizes])
    inverse = np.diag([1.0 / (cap // s) for s in sizes])
    often = inverse @ np.array(demand, float)
    for _ in range(30 * k):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), cap)
        if value <= 1 + 1e-9:
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-9, often / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        often = np.maximum(often - ratio[out] * move, 0)
        often[out] = ratio[out]
        patterns[:, out] = pattern
        inverse[out] /= move[out]
        for i in range(k):
            if i != out:
                inverse[i] -= move[i] * inverse[out]
    return [(patterns[:, i], float(often[i])) for i in range(k)]


def grouped(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, in groups of equal cardinality; a length may go on in the next group."""
    quota = -(-sum(c for _, c in counts) // groups)
    out, room = [], 0
    for length, count in counts:
        while count:
            if not room:
                out.append([])
                room = quota
            take = min(room, count)
            out[-1].append((length, take))
            count, room = count - take, room - take
    return out


def plan(counts: Mapping[int, int], cap: int = CAP, settings: Sequence[tuple[int, float]] = SETTINGS) -> tuple[list[Run], int]:
    """Runs that place ``counts[length]`` pieces of each length, and the number of sequences: the tightest that a setting gives."""
    return min((_plan(counts, cap, *s) for s in settings), key=lambda p: p[1])


def _plan(counts: Mapping[int, int], cap: int, groups: int, small: float) -> tuple[list[Run], int]:
    runs, used, sequences = [], dict.fromkeys(counts, 0), 0
    if counts.get(cap):
        runs.append(Run(cap, 0, 0, 1, 0))
        used[cap] = sequences = counts[cap]
    large = sorted(((n, c) for n, c in counts.items() if small * cap < n < cap and c), reverse=True)
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: first sequence and how many
    rooms: list[int] = []  # those with any, in order

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if not open_.get(room):
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, many))

    if large:
        queues = [q[::-1] for q in grouped(large, groups)]
        sizes = [q[-1][0] for q in queues]
        for pattern, often in configurations(sizes, [sum(c for _, c in q) for q in queues], cap):
            many = int(often + 1e-9)
            if not many:
                continue
            spans = [(sequences, sequences + many, 0)]
            sequences += many
            for g in np.repeat(np.arange(len(sizes)), pattern.astype(int)):
                after = []
                for lo, hi, filled in spans:
                    while lo < hi and queues[g]:
                        length, count = queues[g].pop()
                        take = min(count, hi - lo)
                        runs.append(Run(length, used[length], lo, 1, filled))
                        used[length] += take
                        after.append((lo, lo + take, filled + length))
                        lo += take
                        if take < count:
                            queues[g].append((length, count - take))
                    if lo < hi:
                        after.append((lo, hi, filled))
                spans = after
            for lo, hi, filled in spans:
                leave(cap - filled, lo, hi - lo)
    for length in sorted(counts, reverse=True):
        rest = counts[length] - used[length]
        while rest:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                many = -(-rest // (cap // length))
                leave(cap, sequences, many)
                sequences += many
                continue
            room = rooms[at]
            first, many = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            # the fullest with room stays the fullest until it has none
            each = min(room // length, rest)
            full = min(many, rest // each)
            runs.append(Run(length, used[length], first, each, cap - room))
            used[length] += full * each
            rest -= full * each
            leave(room - each * length, first, full)
            leave(room, first + full, many - full)
    return runs, sequences


def pieces(df: DataFrame, tokenizer_path: str, cap: int = CAP, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode and cut: key, piece, start, length, ids, ids_crc32 and a piece's task and number there among its length.

    ``ids`` holds little-endian unsigned 32-bit integers. Written once.
    """
    spark = df.sparkSession
    definition = bpe.definition_of(tokenizer_path)
    by_units = bpe.splits_by_units(definition)
    shared = spark.sparkContext.broadcast(definition)
    fields = [("key", df.schema[key].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("number", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, end = bpe.worker_encoder(shared.value, by_units), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(cap + 1, np.int64)
        for whole in batches:
            for batch in rows_by_bytes(whole, "__text", 2 << 20):
                keys, rows = batch.column("__key"), []
                for i, ids in enumerate(encoder([x or "" for x in batch.column("__text").to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % cap or cap, n + 1, cap)] if n > cap else [0, n]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a : 4 * b]
                        rows.append((i, j, a, b - a, part, zlib.crc32(part), task, int(seen[b - a])))
                        seen[b - a] += 1
                of, *columns = zip(*rows)
                arrays = [keys.take(pa.array(of)), *(pa.array(c, t) for c, t in zip(columns, kinds[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    made = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).transform(arrow_map, run, schema)
    path = new_dir(spark, "pieces")
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def placed(cut: DataFrame, cap: int = CAP, settings: Sequence[tuple[int, float]] = SETTINGS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of task and number."""
    spark = cut.sparkSession
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("many"))
    found = dict(tuple(r) for r in counts.groupBy("length").agg(F.sum("many")).collect())  # a row a length: at most ``cap``
    runs, _ = plan(found, cap, settings)
    table = np.array(sorted(runs), np.int64).reshape(-1, len(Run._fields))
    shared = spark.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("__before"))
    kept = [c for c in cut.columns if c not in ("task", "number")]
    numbered = cut.join(before, ["task", "length"]).select(*kept, (F.col("__before") + F.col("number")).alias("__rank"))
    schema = T.StructType([*(cut.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            at = table[np.searchsorted(starts, (length << 48) | rank, "right") - 1]
            past = rank - at[:, 1]
            sequence, offset = at[:, 2] + past // at[:, 3], at[:, 4] + past % at[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=schema.names)

    return numbered.transform(arrow_map, run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids, and as ``parts`` which piece of which key stands where."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "key", "piece", "start", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    spans = F.transform("parts", lambda p: F.struct(p["key"].alias("key"), p["piece"].alias("piece"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length")))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return whole.select("sequence_id", n.alias("n_tokens"), ids.alias("ids"), spans.alias("parts"))


def pack(df: DataFrame, tokenizer_path: str, cap: int = CAP, key: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and offset; ``sequences`` puts the ids together.

    Without ids they are written all the same, but not shuffled.
    """
    cut = pieces(df, tokenizer_path, cap, key, text, end_id)
    return placed(cut if with_ids else cut.drop("ids"), cap)
