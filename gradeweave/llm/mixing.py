"""Mixing sources to target weights on a time-varying curriculum.

Each source has a weight. The mix shares a budget of words by weight, no
source beyond ``most`` times its own size: the excess goes to the others by
weight until none is above. With sources in order of ``cap / weight`` that has
a closed form (a water level), so three running sums over the small table of
sources replace the rounds.

Within a source, documents stand in the order of the MD5 of seed and key;
running sums of their words say which copies the mix takes: whole passes first, then those
below the rest. Sums run in buckets of the order (a bucket's sum, then sums
over buckets), so one source holding any share of the rows is spread over all
tasks.

A source's weight over training time t in [0, 1] runs linearly from ``begin``
to ``end`` times its weight. Its integral is the share of its words that is
due by t; inverting it at a copy's running sum gives the copy's position.
Documents are range-sorted by position.

All of it is DataFrame operations. Defined results: a null text has size 0 and
a size of 0 is taken 0 times; a null source is a source, last in order; rows
with equal keys, or null ones, are told apart by a hash of all their columns,
and rows that are equal in all columns are each taken as planned; a source
without weight or words has the target 0; texts of any length are counted
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.llm.common import materialize, n_words_col


def row_id(docs: DataFrame) -> Column:
    """64-bit hash of a row's columns; nulls count by their place."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns))


#: Rows of a bucket of the order, about.
BUCKET_ROWS = 2048


def targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Weights repeat over the sources in code point order, null last. A row per
    source goes through windows without a partition.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    repeated = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.element_at(repeated, (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    # sources without weight come last and get nothing
    by = Window.orderBy(F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf"))), F.col("source").asc_nulls_last())
    over = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    # The level if the sources before this one, and no others, are capped. It
    # rises while those are rightly capped and falls after, so the top is it.
    s = s.withColumn("__cap", cap).withColumn("__level", F.try_divide(budget - F.coalesce(F.sum(cap).over(over), F.lit(0.0)), F.sum("weight").over(rest)))
    level = F.max("__level").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("target", F.least(F.col("__cap"), F.coalesce(level * F.col("weight"), F.lit(0.0)))).drop("__level", "__cap")


def position(done: Column, begin: Column, end: Column) -> Column:
    """t at which a source whose weight goes from ``begin`` to ``end`` has given the share ``done``.

    The share is (begin*t + (end-begin)*t^2/2) / ((begin+end)/2).
    """
    a, b = (end - begin) / 2, begin
    c = -(done * (begin + end) / 2)
    # the root in [0, 1], in the form that stays exact where a is 0; a weight that is 0 at first divides 0 by 0 at the start
    root = F.try_divide(-2 * c, b + F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * a * c)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(root, F.lit(0.0))))


def schedule(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, ramps: Sequence[tuple[float, float]] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)), seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, row_id, source, size, source_size, weight, target, copies, taken, done, begin, end.

    ``copies`` is how often the mix takes it, ``done`` the share of its
    source's target that stands before its first copy.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select(F.col(key).alias("key"), row_id(docs).alias("row_id"), F.col(source).alias("source"), n_words_col(F.col(text)).alias("size")), "mix-sizes")
    rows = sized.count()
    buckets = max(1, rows // BUCKET_ROWS)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.concat(F.lit("null:"), F.col("row_id").cast("string")))))
    # buckets are ranges of the order
    place = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("__order", order).withColumn("__bucket", F.shiftright(place * buckets, 32))
    sums = materialize(sized.groupBy("source", "__bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most, share)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ramp = F.element_at(F.array(*(F.struct(F.lit(float(a)).alias("begin"), F.lit(float(b)).alias("end")) for a, b in ramps)), (place % len(ramps) + 1).cast("int"))
    plan = materialize(plan.withColumn("__ramp", ramp).select("*", "__ramp.begin", "__ramp.end").drop("__ramp"), "mix-targets")
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("__before", before).drop("bucket_size")
    joined = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select("p.*", "o.__bucket", "o.__before")
    joined = joined.withColumnRenamed("source", "__source").withColumnRenamed("__bucket", "__b")
    d = sized.join(joined, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("source", "__bucket").orderBy("__order", "key", "size", "row_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("__at", F.col("__before") + inner)
    passes = F.floor(F.try_divide("target", "source_size"))
    rest = F.col("target") - passes * F.col("source_size")
    more = (F.col("__at") + F.col("size") / 2.0 < rest) & (passes < most)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.coalesce(passes, F.lit(0)) + F.when(more, 1).otherwise(0)).cast("int")
    return d.select("key", "row_id", "source", "size", "source_size", "weight", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.when(F.col("target") > 0, F.col("__at") / F.col("target")).otherwise(0.0).alias("done"), "begin", "end")


def placed(planned: DataFrame) -> DataFrame:
    """The schedule with ``first_position``, where training first meets a document (null: never), range-sorted by it."""
    first = F.when(F.col("copies") > 0, position(F.least(F.lit(1.0), F.col("done")), F.col("begin"), F.col("end")))
    return planned.withColumn("first_position", first).repartitionByRange("first_position", "key", "row_id").sortWithinPartitions("first_position", "key", "row_id")


def mix(docs: DataFrame, planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents' columns, one row for each copy taken, range-sorted by training position.

    ``planned`` is the schedule of the same ``docs``. Rows that are equal in
    all columns meet their places as one row, so r of them give r times their
    copies.
    """
    have = {c.lower() for c in docs.columns}
    planned_, row, at = (next(n for n in (f"{name}{'_' * i}" for i in range(len(have) + 1)) if n not in have) for name in ("__planned", "__row", "__position"))
    step = F.try_divide("source_size", "target")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("__copy")
    places = planned.where("copies > 0").select(F.col("row_id").alias(planned_), "done", "begin", "end", step.alias("__step"), copy)
    places = places.select(planned_, position(F.least(F.lit(1.0), F.col("done") + F.col("__copy") * F.col("__step")), F.col("begin"), F.col("end")).alias(at))
    one = docs.withColumn(row, row_id(docs)).dropDuplicates([row])
    out = one.join(places, F.col(row) == F.col(planned_))
    return out.repartitionByRange(at, F.col(f"`{key}`"), row).sortWithinPartitions(at, F.col(f"`{key}`"), row).select(*(F.col(f"`{c}`") for c in docs.columns))
