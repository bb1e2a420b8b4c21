"""Ranks of an external trainer as one barrier stage.

All ranks start together or not at all, each with its share of the token rows,
the addresses of the others and its device; they meet at barriers and exchange
texts. If one is lost, the stage starts again as a whole, from shares that were
kept. A barrier stage needs a free slot for each rank, and no dynamic
allocation.

The trainer is a function of (rank, batches): ``batches`` are Arrow batches of
the rank's rows, and what it returns (a mapping) is the rank's result as JSON.
Ranks may have one row (in length groups: one batch) more or less than others; ``rank.steps`` is the number
of batches that all of them take, so that collective steps don't wait for a
rank that has none left.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.sources.tables import held

PORT = 29500


@dataclass(frozen=True)
class Rank:
    rank: int
    world_size: int
    addresses: list[str]
    attempt: int
    steps: int
    device: str | None = None
    context: Any = field(default=None, repr=False)

    @property
    def local_rank(self) -> int:
        """Its place among the ranks of its host."""
        hosts = [a.rsplit(":", 1)[0] for a in self.addresses]
        return hosts[: self.rank].count(hosts[self.rank])

    def barrier(self) -> None:
        self.context.barrier()

    def all_gather(self, text: str) -> list[str]:
        """Each rank's text, by rank; every rank must call."""
        return self.context.allGather(text)

    def environment(self, port: int = PORT) -> dict[str, str]:
        """The variables by which process groups find each other. An attempt has a port of its own, as the last one's may linger."""
        out = {"RANK": self.rank, "LOCAL_RANK": self.local_rank, "WORLD_SIZE": self.world_size, "MASTER_ADDR": self.addresses[0].rsplit(":", 1)[0], "MASTER_PORT": port + self.attempt}
        if self.device is not None:
            out["CUDA_VISIBLE_DEVICES"] = self.device
        return {k: str(v) for k, v in out.items()}


def dealt(rows: DataFrame, ranks: int, place: str | None = None, batch_size: int = 1) -> DataFrame:
    """Rows in ``ranks`` partitions, kept so that a stage that starts again finds the same.

    They differ by few rows; with a column ``place`` (from 0, without gaps)
    batches of places go to the ranks in turn, so that the batches of a step
    stand next to each other, and each rank has its rows in order.
    """
    if place is None:
        return held(rows.repartition(ranks))
    turn = F.pmod(F.floor(F.col(place) / batch_size), F.lit(ranks)).cast("int")
    return held(rows.repartitionById(ranks, turn).sortWithinPartitions(place).drop(place))


def in_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one smaller, wherever Arrow's own batches end."""
    rest: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        at = 0
        while batch.num_rows - at >= size - have:
            yield pa.concat_batches([*rest, batch.slice(at, size - have)])
            rest, at, have = [], at + size - have, 0
        if at < batch.num_rows:
            rest.append(batch.slice(at))
            have += batch.num_rows - at
    if rest:
        yield pa.concat_batches(rest)


def run(rows: DataFrame, ranks: int, trainer: Callable[[Rank, Iterator[pa.RecordBatch]], Mapping | None], batch_size: int = 1, place: str | None = None) -> DataFrame:
    """One row a rank: rank, world_size, rows, steps, attempt, result (JSON). The stage runs when the result is asked for.

    ``place`` is a column that says in what order ranks read (see ``dealt``).
    """
    shares = dealt(rows, ranks, place, batch_size)
    sizes = {r[0]: r[1] for r in shares.groupBy(F.spark_partition_id().alias("rank")).count().collect()}  # a row a rank
    planned = [sizes.get(k, 0) for k in range(ranks)]
    steps = math.ceil(max(planned) / batch_size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        gpus = context.resources().get("gpu")
        me = Rank(context.partitionId(), ranks, [i.address for i in context.getTaskInfos()], context.attemptNumber(), steps, ",".join(gpus.addresses) if gpus else None, context)
        os.environ.update(me.environment())
        context.barrier()  # all are there before any begins
        read = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal read
            for batch in in_batches(batches, batch_size):
                read += batch.num_rows
                yield batch

        mine = counted()
        result = trainer(me, mine) or {}
        for _ in mine:  # rows that the trainer left count as dealt, too
            pass
        found = [int(x) for x in context.allGather(str(read))]
        if found != planned:
            raise RuntimeError(f"ranks read {found} rows, {planned} were dealt")
        row = [[me.rank], [ranks], [read], [steps], [me.attempt], [json.dumps(result, sort_keys=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["rank", "world_size", "rows", "steps", "attempt", "result"])

    return shares.mapInArrow(work, "rank int, world_size int, rows bigint, steps bigint, attempt int, result string", barrier=True)
