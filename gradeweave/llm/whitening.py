"""Whitening of embeddings on exactly centred integer vectors.

Each entry c becomes the long x = floor(64 * c) + 1000000. Sums S of each
dimension are exact (decimals, combined map-side, one row a dimension). A row
is centred exactly: with q = S div n and r = S mod n, n*x - S = n*(x - q) - r
in longs, and only its quotient by n is rounded. MLlib's ``RowMatrix`` sums the
Gramian of the centred rows over all tasks; divided by n it is the covariance.
The driver takes eigenvectors of that one matrix, whose size is the dimension's
square, and broadcasts the projection; rows are whitened in Arrow batches and
written once. The error against the identity is measured on those written rows,
centred again, not derived from the fit.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries take no part, nor do entries beyond 2^56, whose x no long holds; of
vectors of different lengths those of the commonest length (ties: the longer)
take part; null and repeated keys are rows like others; a component without
variance (an eigenvalue at most dimension * 2^-52 of the largest) whitens to 0
and counts in the error; ``explained`` is null if there is no variance at all;
``deviation`` is null where it exceeds a long; fewer dimensions than components
give as many; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeweave.llm.common import materialize

SCALE, SHIFT, LIMIT = 64, 1_000_000, float(2**56)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, exact sums, covariance, eigenvalues by fall and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; 0 where there is no variance."""
        floor = len(self.values) * 2.0**-52 * max(self.values.max(initial=0.0), 0.0)
        kept = self.values > floor
        return self.vectors * np.where(kept, 1 / np.sqrt(np.where(kept, self.values, 1.0)), 0.0)

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [float(e) / trace if trace > 0 else None for e in self.values]


def integer_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows that take part, of any length."""
    v = F.col(f"`{vector}`")
    plain = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) <= LIMIT, F.lit(False)))
    # a NaN is greater than any bound, and so fails it
    # the bound again, as a filter on x may compute it before rows are dropped
    x = F.transform(v, lambda c: F.when(F.abs(c.cast("double")) <= LIMIT, F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")))
    return df.where(plain).select(F.col(f"`{key}`").alias("key"), x.alias("x"))


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """Add ``scaled``, the longs n*x - S (null where none holds them), and ``centred``, the doubles x - S/n."""
    quotient, rest = zip(*(divmod(s, n) for s in sums))
    both = rows.withColumns({"__q": _longs(quotient), "__r": _longs(rest)})
    off = F.zip_with("x", "__q", lambda x, q: x - q)
    scaled = F.zip_with("__off", "__r", lambda d, r: F.try_subtract(F.try_multiply(d, F.lit(n).cast("long")), r))
    near = F.zip_with("__off", "__r", lambda d, r: d.cast("double") - r / F.lit(float(n)))
    both = both.withColumn("__off", off).withColumns({"scaled": scaled, "__near": near})
    return both.withColumn("centred", F.zip_with("scaled", "__near", lambda s, near: F.coalesce(s / F.lit(float(n)), near))).drop("__q", "__r", "__off", "__near")


def gramian(rows: DataFrame, column: str, n: int, width: int) -> np.ndarray:
    """Sum of the outer products of an array column's rows, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors, n, width).computeGramianMatrix().toArray()


def fit(rows: DataFrame) -> Whitening | None:
    """Covariance and components of ``integer_rows`` of one length; None without rows."""
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    found = sums.orderBy("at").collect()  # one row a dimension
    if not found:
        return None
    n, total = found[0]["n"], [int(r["s"]) for r in found]
    v = gramian(centred(rows, n, total), "centred", n, len(total)) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, total, v, values[order], vectors[:, order])


def one_length(rows: DataFrame) -> DataFrame:
    """The rows of the commonest length."""
    best = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (best["d"] if best else 0))


def transform(rows: DataFrame, fitted: Whitening, components: int = 32) -> DataFrame:
    """(key, deviation, whitened) with the first components' values as an array; written once and read back."""
    out = T.StructType([rows.schema["key"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType(), False))])
    shared = rows.sparkSession.sparkContext.broadcast(fitted.projection[:, :components])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection = shared.value
        for frame in frames:
            if len(frame):
                white = np.stack(frame["centred"].to_list()) @ projection
                frame = frame[["key", "deviation"]].assign(whitened=list(white))
                yield frame

    squares = F.aggregate("scaled", F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    ready = centred(rows, fitted.n, fitted.sums).select("key", squares.alias("deviation"), "centred")
    return materialize(_keeping_longs(ready, run, out), "whitened")


def _keeping_longs(df: DataFrame, run, out: T.StructType) -> DataFrame:
    """``mapInPandas`` with key and deviation as strings: pandas would make doubles of longs beside nulls."""
    key = out["key"].dataType
    shown = df.select(F.col("key").cast("string").alias("key"), F.col("deviation").cast("string").alias("deviation"), "centred")
    made = shown.mapInPandas(run, "key string, deviation string, whitened array<double>")
    return made.select(F.col("key").cast(key), F.col("deviation").cast("long"), "whitened")


def identity_error(white: DataFrame, n: int, width: int) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    vectors = MLUtils.convertVectorColumnsFromML(white.select(array_to_vector(F.col("whitened")).alias("v")), "v")
    mean = RowMatrix(vectors, n, width).computeColumnSummaryStatistics().mean()
    means = F.array(*(F.lit(float(m)) for m in mean))
    again = white.select(F.zip_with("whitened", means, lambda w, m: w - m).alias("c"))
    return float(np.abs(gramian(again, "c", n, width) / n - np.eye(width)).max())


def whiten(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = one_length(integer_rows(df, key, vector))
    fitted = fit(rows)
    if fitted is None:
        return rows.select("key", F.lit(0).alias("component"), *(F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    width = min(components, len(fitted.sums))
    white = transform(rows, fitted, width)
    error = identity_error(white, fitted.n, width)
    share = F.array(*(F.lit(e).cast("double") for e in fitted.explained[:width]))
    each = white.select("key", "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return each.select(
        "key", (F.col("__at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("__at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
