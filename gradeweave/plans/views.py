"""The domain's tables derived from the driver's: response scores and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.functions.scalar import binary_label
from gradeweave.operators.scoring import normalised
from gradeweave.operators.targets import with_targets
from gradeweave.operators.tokens import with_response_lengths, with_sequence_lengths

SYSTEM_PROMPT = "Return one score."
MAX_DISAGREEMENT, MAX_RESPONSE, MAX_SEQUENCE = 1, 4096, 3072
VALIDATION, TEST = ("src3", "src7", "src11"), ("src5", "src13")
BUCKETS = (0, 500, 1000, 2000, 4096)
LOGITS = [f"logit_{k}" for k in range(1, 6)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical columns as a source file would have them. Items join by key; Spark broadcasts them where their size allows."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    q = items.select(F.col("item_id").alias("__q"), F.col("text").alias("question"))
    r = items.select(F.col("item_id").alias("__r"), F.col("text").alias("ground_truth"))
    base = (F.col("doc_id") * 7 + F.col("n_chars")) % 5 + 1
    d = docs.select(
        F.col("doc_id").alias("instance_id"), F.col("text").alias("response"), F.col("source").alias("model"), F.col("lang").alias("task"),
        F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")).alias("bench"),
        base.cast("double").alias("score_a"), F.greatest(F.lit(1), F.least(F.lit(5), base + F.col("n_chars") % 4 - 1)).cast("double").alias("score_b"),
        (F.col("doc_id") % 40).alias("__q"), ((F.col("doc_id") * 7 + 3) % 40).alias("__r"),
    )
    return d.join(q, "__q").join(r, "__r").drop("__q", "__r")


COLUMNS = {
    "question": "question", "reference_answer": "ground_truth", "response": "response", "judge_1_score": "score_a", "judge_2_score": "score_b",
    "model_id": "model", "benchmark": "bench", "task": "task", "example_id": "instance_id",
}


def targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.operators.targets import canonicalise

    return with_targets(canonicalise(raw_scores(spark, sf_dir), COLUMNS))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sequence_lengths(with_response_lengths(targeted(spark, sf_dir)), SYSTEM_PROMPT)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared rows, after the three filters."""
    from gradeweave.operators.filters import apply_filters, sequence_filter

    return sequence_filter(apply_filters(measured(spark, sf_dir), MAX_DISAGREEMENT, MAX_RESPONSE), MAX_SEQUENCE)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    made = [(((F.col("l_partkey") * k + F.col("l_suppkey") * (k + 3) + F.col("l_linenumber") * 7) % 97).cast("double") / 10).alias(f"logit_{k}") for k in range(1, 6)]
    target = F.ceil(F.col("l_quantity") / 10.0).cast("int")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.concat(F.lit("m"), (F.col("l_suppkey") % 12).cast("string")).alias("model_id"), F.col("l_returnflag").alias("benchmark"),
        F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("task"), target.alias("target_score"), binary_label(target).alias("target_binary"),
        (F.floor("l_extendedprice").cast("long") % 5000).alias("response_token_length"), *made,
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.functions.scalar import length_bucket

    p = normalised(logits(spark, sf_dir), LOGITS)
    return p.withColumn("response_length_bucket", length_bucket(F.col("response_token_length"), BUCKETS))
