"""Training batches of rows of like length.

Rows are shuffled by a hash of their key, cut into mega-batches of ``mega``
batches, and sorted by length within each, longest first. A batch then pads
little, while what stands in it still changes with seed and epoch.

A row's place in the shuffled order comes from counts by the hash's first
characters (65,536 at most) and its place among the rows of its own prefix, so
that no task orders more than a prefix's rows or a mega-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.functions.scalar import sample_rank
from gradeweave.operators.splits import PREFIX

MEGA = 50


def shuffled(rows: DataFrame, seed: int = 42, key: str = "example_id") -> DataFrame:
    """Add ``at``: a row's place from 0 in the order by hash. Keys are unique."""
    ranked = rows.withColumn("__rank", sample_rank(F.col(key), seed)).withColumn("__p", F.substring("__rank", 1, PREFIX))
    counts = ranked.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__rank", key))
    return ranked.join(starts, "__p").withColumn("at", F.col("__start") + place - 1).drop("__rank", "__p", "__start")


def length_grouped(rows: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, key: str = "example_id", length: str = "length", mega: int = MEGA) -> DataFrame:
    """key, length, place, batch: each row once, ``place`` from 0 without gaps, ``batch`` a run of ``batch_size`` places.

    Only keys and lengths are moved. Rows of the same length keep the shuffled
    order; a null length counts as the shortest. An empty table gives none.
    """
    if batch_size < 1 or mega < 1:
        raise ValueError(f"batch_size {batch_size} and mega {mega} must be 1 at least")
    many = batch_size * mega
    slim = shuffled(rows.select(key, F.col(length).alias("length")), seed + epoch, key).withColumn("__mega", F.floor(F.col("at") / many))
    within = Window.partitionBy("__mega").orderBy(F.desc_nulls_last("length"), "at")
    out = slim.withColumn("place", F.col("__mega") * many + F.row_number().over(within) - 1)
    return out.select(key, "length", "place", F.floor(F.col("place") / batch_size).alias("batch"))


def padding_share(places: DataFrame) -> DataFrame:
    """One row: rows, batches, tokens, and the share of what the batches hold that is padding (0 if they hold nothing)."""
    each = places.groupBy("batch").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), (F.max("length") * F.count("*")).alias("held"))
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("batches"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("held"), F.lit(0)).alias("__held"))
    share = F.when(F.col("__held") == 0, 0.0).otherwise(1 - F.col("tokens") / F.col("__held"))
    return one.select("rows", "batches", "tokens", share.alias("padding"))
