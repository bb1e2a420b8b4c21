"""A bit table of bounded size that tells rows which surely have no partner.

Before texts are shuffled to meet a table of keys, each row's key is looked up
in a table of bits that the keys have set. Rows whose bit isn't set have no
partner and stay where they are; only the others are shuffled and joined, which
is exact. The table takes ``most`` bits at most, whatever the keys: beyond some
ten million keys it lets more rows through, never fewer. It is built by an
aggregate, a row for each word of it, and broadcast.

Defined results: null hashes set no bit and never pass; no keys let nothing
pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 26


def sieve(hashes: DataFrame, column: str, most: int = MOST) -> Callable[[Column], Column]:
    """A function of a column of 64-bit hashes: whether any of ``hashes`` may equal it."""
    spark = hashes.sparkSession
    count = hashes.count()
    bits = min(most, max(1 << 10, 1 << (32 * count).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.where(F.col(column).isNotNull()).select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def may(values: pa.Array) -> pa.Array:
        at = values.to_numpy(zero_copy_only=False) & (bits - 1)
        return pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return lambda c: c.isNotNull() & may(F.coalesce(c, F.lit(0)))
