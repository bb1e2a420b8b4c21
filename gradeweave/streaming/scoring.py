"""Scoring as a stream: an extra beside the batch plans.

Rendering, lengths and scores are row-wise, so the batch expressions run on a
stream as they are; counts by window need a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.operators.scoring import normalised


def scored_stream(stream: DataFrame, logits, threshold: int = 3) -> DataFrame:
    return normalised(stream, logits, threshold)


def windowed_accuracy(stream: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Accuracy and count by event-time window; rows later than ``late`` are left out, and state is dropped."""
    hit = (F.col("target_score") == F.col("pred_score")).cast("double")
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).select("w.start", "w.end", "n", "accuracy")
