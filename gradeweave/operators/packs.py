"""Next-fit packing of ordered rows as a composition of transition functions.

Where a range of rows begins, all that matters of what came before is how full
the open pack is: a number from 0 to the cap. A range is thus a function of
that number, giving the packs it begins and how full its last one is. The
function has few pieces, one for each row that may begin the range's first new
pack, and two functions in a row compose to a third. So:

1. rows are range-sorted once, and the ranges are kept (lengths and keys only);
2. each range reduces its rows to its function, batch by batch;
3. the driver walks the ranges with the number that each hands to the next: a
   row a range, of at most cap + 2 pieces, whatever the rows;
4. each range numbers its rows, now that it knows where it begins.

Both passes over the ranges are single, for any lengths; the packs are those of
one fold over all rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.sources.tables import held


class Transition(NamedTuple):
    """Pieces by how full the open pack is, ascending: from ``least[i]`` on, ``packs[i]`` begin and the last holds ``used[i]``.

    Where ``packs[i]`` is 0 the open pack goes on, and ``used[i]`` comes on top
    of what it holds. No open pack counts as one of cap + 1.
    """

    least: list[int]
    packs: list[int]
    used: list[int]

    def __call__(self, full: int) -> tuple[int, int]:
        i = bisect_right(self.least, full) - 1
        return self.packs[i], self.used[i] + (0 if self.packs[i] else full)


def next_starts(ends: np.ndarray, cap: int) -> np.ndarray:
    """For each row, the row that begins the next pack if it begins one; ``ends`` are running sums from 0."""
    return np.searchsorted(ends, ends[:-1] + cap, "right") - 1


def transition(lengths: np.ndarray, cap: int) -> Transition:
    """The function of some rows: chains of packs from each row that may begin the first are followed side by side."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    first = np.flatnonzero(ends[:-1] <= cap)
    first = first[(lengths[first] > 0) | (first == 0)]  # rows of no length begin no pack, unless none is open
    jump = np.append(next_starts(ends, cap), len(lengths))
    at, last, packs = first, first, np.zeros(len(first), np.int64)
    while len(at) and (live := at < len(lengths)).any():
        packs += live
        last = np.where(live, at, last)
        at = jump[at]
    used = ends[-1] - ends[last]
    least = np.maximum(cap - ends[first + 1] + 1, 0)
    pieces = list(zip(least.tolist(), packs.tolist(), used.tolist()))[::-1]
    if ends[-1] <= cap:  # all rows may fit into the open pack
        pieces.insert(0, (0, 0, int(ends[-1])))
    pieces = [p for p, after in zip(pieces, pieces[1:] + [(cap + 2,)]) if p[0] < after[0]]
    return Transition(*map(list, zip(*pieces)))


def compose(a: Transition, b: Transition, cap: int) -> Transition:
    """What ``a`` and then ``b`` do."""
    least, packs, used = [], [], []
    for i, start in enumerate(a.least):
        if a.packs[i]:
            more, full = b(a.used[i])
            parts = [(start, a.packs[i] + more, full)]
        else:  # the open pack goes on, so b's pieces show through, moved by what a adds
            end = a.least[i + 1] if i + 1 < len(a.least) else cap + 2
            parts = [(max(start, at - a.used[i]), p, u + (0 if p else a.used[i])) for at, p, u in zip(*b)]
            parts = [p for p, after in zip(parts, parts[1:] + [(end,)]) if p[0] < min(after[0], end)]
        for part in parts:
            for column, x in zip((least, packs, used), part):
                column.append(x)
    return Transition(least, packs, used)


def pack_assignment(rows: DataFrame, cap: int, order: str = "example_id", length: str = "length", chunks: int | None = None) -> DataFrame:
    """Next-fit packs in row order: (order, pack_id); rows over the cap leave."""
    chunks = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = held(rows.select(order, F.col(length).cast("int").alias("__n")).where(F.col("__n") <= cap))
    ranged = slim.repartitionByRange(chunks, order, "__n").sortWithinPartitions(order, "__n")
    ranged = held(ranged.withColumn("__range", F.spark_partition_id()))
    found = ranged.mapInArrow(_reduced(cap), "range int, least array<bigint>, packs array<bigint>, used array<bigint>").collect()  # a row a range
    entry, begun, full = {}, 0, cap + 1
    for r in sorted(found, key=lambda r: r["range"]):
        entry[r["range"]] = (begun, full)
        packs, full = Transition(r.least, r.packs, r.used)(full)
        begun += packs
    return ranged.mapInArrow(_numbered(cap, entry), slim.select(order).schema.add("pack_id", "long"))


def _reduced(cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mark = None, None
        for batch in batches:
            if batch.num_rows:
                mark = batch.column("__range")[0].as_py()
                f = transition(batch.column("__n").to_numpy(), cap)
                now = f if now is None else compose(now, f, cap)
        if now is not None:
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int32()), *(pa.array([x], lists) for x in now)], names=["range", *now._fields])

    return run


def _numbered(cap: int, entry: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            begun, full = state or entry[batch.column("__range")[0].as_py()]
            ends = np.concatenate(([0], np.cumsum(batch.column("__n").to_numpy(), dtype=np.int64)))
            jump, starts = next_starts(ends, cap), np.zeros(batch.num_rows, np.int64)
            first = at = max(0, int(np.searchsorted(ends, cap - full, "right")) - 1)
            while at < batch.num_rows:
                starts[at], last = 1, at
                at = int(jump[at])
            full = int(ends[-1] - ends[last]) if first < batch.num_rows else full + int(ends[-1])
            packs = begun - 1 + np.cumsum(starts)
            state = (begun + int(starts.sum()), full)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packs)], names=[batch.schema.names[0], "pack_id"])

    return run


def packed(rows: DataFrame, cap: int, order: str = "example_id", chunks: int | None = None) -> DataFrame:
    """pack_id, input_ids, attention_mask, labels, length: a pack's rows end to end, in order."""
    assigned = pack_assignment(rows, cap, order, chunks=chunks)
    parts = rows.join(assigned, order).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct(order, "input_ids", "attention_mask", "labels"))).alias("rows"))
    out = parts.select("pack_id", *(F.flatten(F.col(f"rows.{c}")).alias(c) for c in ("input_ids", "attention_mask", "labels")))
    return out.withColumn("length", F.size("input_ids"))
