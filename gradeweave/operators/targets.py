"""From a source table to integer targets: canonical columns, checks, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.scalar import binary_label

#: Logical columns.
REQUIRED = ("question", "reference_answer", "response", "judge_1_score", "judge_2_score", "model_id")
OPTIONAL = ("benchmark", "task", "example_id", "source")


def column_name(columns: Mapping[str, str], logical: str) -> str:
    return columns[logical]


def validate_columns(df: DataFrame, columns: Mapping[str, str]) -> None:
    """Every required logical column must be mapped to one that exists; all that aren't are named."""
    missing = [f"{c} -> {columns.get(c)}" for c in REQUIRED if columns.get(c) not in df.columns]
    if missing:
        raise ValueError("columns missing from the source: " + ", ".join(missing))


def canonicalise(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Physical columns under their logical names; unmapped optional ones are null strings."""
    out = [F.col(f"`{p}`").alias(logical) for logical, p in columns.items() if p in df.columns]
    have = {logical for logical, p in columns.items() if p in df.columns}
    out += [F.lit(None).cast("string").alias(c) for c in OPTIONAL if c not in have]
    return df.select(*out)


def _number(name: str):
    x = F.col(name).try_cast("double")
    return F.when(~F.isnan(x), x)


def score_violations(df: DataFrame) -> dict[str, int]:
    """Rows whose judge scores aren't numbers in 1..5, by column: one aggregate."""
    bad = lambda c: F.count_if(_number(c).isNull() | ~_number(c).between(1, 5)).alias(c)
    return df.agg(bad("judge_1_score"), bad("judge_2_score")).first().asDict()


def validate_scores(df: DataFrame) -> None:
    for column, n in score_violations(df).items():
        if n:
            raise ValueError(f"{column}: {n} rows outside [1, 5] or not numeric")


def with_targets(df: DataFrame, threshold: int = 3) -> DataFrame:
    """Add disagreement, mean_score, target_score and target_binary."""
    a, b = (F.col(c).cast("double") for c in ("judge_1_score", "judge_2_score"))
    df = df.withColumns({"judge_1_score": a, "judge_2_score": b})
    mean = (F.col("judge_1_score") + F.col("judge_2_score")) / 2
    df = df.withColumns({"disagreement": F.abs(F.col("judge_1_score") - F.col("judge_2_score")), "mean_score": mean, "target_score": F.floor(mean).cast("int")})
    return df.withColumn("target_binary", binary_label(F.col("target_score"), threshold))


def load_targets(df: DataFrame, columns: Mapping[str, str], threshold: int = 3) -> DataFrame:
    validate_columns(df, columns)
    canonical = canonicalise(df, columns)
    validate_scores(canonical)
    return with_targets(canonical, threshold)
