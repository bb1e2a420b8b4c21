"""Training-side rows and arithmetic: padding, weights, losses, steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.scalar import IGNORED_LABEL, SCORES, logsumexp, ratio


def padded(rows: DataFrame, batch_size: int, pad_id: int = 0, order: str = "example_id", labels_are_rows: bool = True) -> DataFrame:
    """Rows right-padded to the longest of their batch; a batch is a run of ``batch_size`` rows by a dense ``order``."""
    batch = F.floor(F.col(order) / batch_size)
    most = rows.groupBy(batch.alias("batch")).agg(F.max("length").alias("width"))
    out = rows.withColumn("batch", batch).join(most, "batch")
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.col("width") - F.col("length")))
    made = {"input_ids": fill("input_ids", pad_id), "attention_mask": fill("attention_mask", 0)}
    if labels_are_rows:
        made["labels"] = fill("labels", IGNORED_LABEL)
    return out.withColumns(made)


def inverse_frequency_weights(train: DataFrame) -> DataFrame:
    """target_score, n, weight = all / (5 n), 0 where there are none."""
    counts = train.where(F.col("target_score").isin(*SCORES)).groupBy("target_score").agg(F.count("*").alias("n"))
    every = train.sparkSession.createDataFrame([(s,) for s in SCORES], "target_score int")
    out = every.join(counts, "target_score", "left").na.fill(0, ["n"])
    total = out.agg(F.sum("n").alias("all"))
    return out.crossJoin(F.broadcast(total)).select("target_score", "n", ratio(F.col("all"), 5 * F.col("n")).alias("weight"))  # five rows and one


def class_weights(train: DataFrame, training: dict) -> list[float] | None:
    """The weights the configuration asks for, in order of precedence."""
    asked = (training.get("loss") or {}).get("class_weights")
    if isinstance(asked, (list, tuple)):
        return [float(x) for x in asked]
    if asked not in ("balanced", "inverse_frequency"):
        if training.get("score_class_weights"):
            return [float(x) for x in training["score_class_weights"]]
        if training.get("class_weighting") != "inverse_frequency":
            return None
    return [r.weight for r in inverse_frequency_weights(train).orderBy("target_score").collect()]


def _of_target(logits: Sequence[str], target: Column) -> Column:
    out = F.col(logits[0])
    for k, c in enumerate(logits[1:], 2):
        out = F.when(target == k, F.col(c)).otherwise(out)
    return out


def _weight(target: Column, weights: Sequence[float] | None) -> Column:
    if weights is None:
        return F.lit(1.0)
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), target)


def restricted_cross_entropy(df: DataFrame, logits: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """One row: the weighted mean of -log softmax(five logits)[target]."""
    w = _weight(F.col("target_score"), weights)
    ce = logsumexp(*map(F.col, logits)) - _of_target(logits, F.col("target_score"))
    return df.agg(ratio(F.sum(w * ce), F.sum(w)).alias("ce_loss"))


def ce_with_binary(df: DataFrame, logits: Sequence[str], weight: float = 0.5, weights: Sequence[float] | None = None) -> DataFrame:
    """One row: five-way loss, two-way loss (1 and 2 against 3 to 5, unweighted) and their sum."""
    x = [F.col(c) for c in logits]
    low, high = logsumexp(*x[:2]), logsumexp(*x[2:])
    binary = logsumexp(low, high) - F.when(F.col("target_score") >= 3, high).otherwise(low)
    w = _weight(F.col("target_score"), weights)
    ce = logsumexp(*x) - _of_target(logits, F.col("target_score"))
    out = df.agg(ratio(F.sum(w * ce), F.sum(w)).alias("ce_loss"), F.coalesce(F.avg(binary), F.lit(0.0)).alias("binary_loss"))
    return out.withColumn("loss", F.col("ce_loss") + weight * F.col("binary_loss"))


def optimisation_steps(examples: int, batch: int, accumulation: int, epochs: float, world_size: int = 1) -> int:
    per_rank = math.ceil(examples / (batch * world_size))
    return math.ceil(math.ceil(per_rank / accumulation) * epochs)


def warmup_steps(total: int, ratio_: float = 0.0, explicit: int | None = None) -> int:
    return explicit if explicit else math.ceil(total * ratio_)


def global_batch(batch: int, accumulation: int, world_size: int) -> int:
    return batch * accumulation * world_size
