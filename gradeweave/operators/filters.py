"""The funnel: disagreement, response length, sequence length, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gradeweave.functions.scalar import percent

DISTRIBUTION_COLUMNS = ("model_id", "benchmark", "task", "target_score", "target_binary")
LENGTH_COLUMNS = ("response_token_length", "prompt_token_length", "target_token_length", "sequence_length")
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def stage_col(max_disagreement: float | None, max_response_tokens: int | None, max_seq_length: int | None = None):
    """How many filters a row passes, in order: 0, 1, 2 or 3; a filter of null passes all."""
    passes = lambda c, most: F.lit(True) if most is None else F.coalesce(F.col(c) <= most, F.lit(False))
    a, b = passes("disagreement", max_disagreement), passes("response_token_length", max_response_tokens)
    c = passes("sequence_length", max_seq_length)
    return F.when(~a, 0).when(~b, 1).when(~c, 2).otherwise(3)


def apply_filters(df: DataFrame, max_disagreement: float | None, max_response_tokens: int | None) -> DataFrame:
    if max_disagreement is not None:
        df = df.where(F.col("disagreement") <= max_disagreement)
    if max_response_tokens is not None:
        df = df.where(F.col("response_token_length") <= max_response_tokens)
    return df


def sequence_filter(df: DataFrame, max_seq_length: int, on_overflow: str = "skip") -> DataFrame:
    """Rows that fit; in ``error`` mode one that doesn't raises."""
    if on_overflow == "error":
        n = df.where(F.col("sequence_length") > max_seq_length).limit(1).count()
        if n:
            raise ValueError(f"sequences are over max_seq_length {max_seq_length}")
        return df
    if on_overflow != "skip":
        raise ValueError(f"on_sequence_overflow: {on_overflow}")
    return df.where(F.col("sequence_length") <= max_seq_length)


def observed(df: DataFrame, observation: Observation, max_disagreement: float | None, max_response_tokens: int | None, max_seq_length: int | None) -> DataFrame:
    """Add ``stage``; the funnel's counts come with whatever action reads the rows."""
    s = F.col("stage")
    named = ((1, "after_disagreement"), (2, "after_response_length"), (3, "after_sequence_length"))
    return df.withColumn("stage", stage_col(max_disagreement, max_response_tokens, max_seq_length)).observe(observation, F.count(F.lit(1)).alias("raw"), *(F.count_if(s >= k).alias(n) for k, n in named))


def funnel_of(counts: dict) -> dict:
    """The funnel's row from observed counts."""
    out, names = dict(counts), ("raw", "after_disagreement", "after_response_length", "after_sequence_length")
    for before, after in zip(names, names[1:]):
        gone, name = counts[before] - counts[after], after.removeprefix("after_")
        out |= {f"removed_by_{name}": gone, f"removed_by_{name}_pct": round(100 * gone / counts[before], 6) if counts[before] else 0.0}
    return out


def funnel(df: DataFrame, max_disagreement: float | None, max_response_tokens: int | None, max_seq_length: int | None) -> DataFrame:
    """One row: rows left after each filter, and what each removed of those before it. One scan."""
    s = df.select(stage_col(max_disagreement, max_response_tokens, max_seq_length).alias("s"))
    n = s.agg(F.count("*").alias("raw"), *(F.count_if(F.col("s") >= k).alias(name) for k, name in ((1, "after_disagreement"), (2, "after_response_length"), (3, "after_sequence_length"))))
    steps = (("raw", "after_disagreement", "disagreement"), ("after_disagreement", "after_response_length", "response_length"), ("after_response_length", "after_sequence_length", "sequence_length"))
    for before, after, name in steps:
        gone = F.col(before) - F.col(after)
        n = n.withColumns({f"removed_by_{name}": gone, f"removed_by_{name}_pct": F.round(percent(gone, F.col(before)), 6)})
    return n


def distributions(df: DataFrame, columns: Sequence[str] = DISTRIBUTION_COLUMNS, most: int = 100) -> DataFrame:
    """column, value, n, truncated: the commonest values of each column, null included, ties by value."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column")
    ranked = counts.withColumns({"place": F.row_number().over(by.orderBy(F.desc("n"), F.asc_nulls_first("value"))), "kinds": F.count("*").over(by)})
    return ranked.where(F.col("place") <= most).select("column", "value", "n", (F.col("kinds") > most).alias("truncated"))


def stage_distributions(df: DataFrame, max_disagreement, max_response_tokens, max_seq_length, columns: Sequence[str] = DISTRIBUTION_COLUMNS) -> DataFrame:
    """stage, column, value, n over the rows each stage keeps: one scan, each row counted for every stage it reaches."""
    names = F.array(*(F.lit(x) for x in ("raw", "after_disagreement", "after_response_length", "after_sequence_length")))
    # the counts are combined per stage and value before the stages multiply the rows
    base = df.select(stage_col(max_disagreement, max_response_tokens, max_seq_length).alias("s"), *(F.col(c).cast("string").alias(c) for c in columns))
    counts = base.unpivot(["s"], list(columns), "column", "value").groupBy("s", "column", "value").agg(F.count("*").alias("n"))
    return counts.select(F.explode(F.sequence(F.lit(0), "s")).alias("k"), "column", "value", "n").groupBy("k", "column", "value").agg(F.sum("n").alias("n")).select(F.element_at(names, F.col("k") + 1).alias("stage"), "column", "value", "n")


def length_statistics(df: DataFrame, columns: Sequence[str] = LENGTH_COLUMNS) -> DataFrame:
    """name, num_examples, min, max, mean, p50 to p99 (exact, interpolated): one aggregate, then rows."""
    have = [c for c in columns if c in df.columns]
    kind = "struct<min:bigint,max:bigint,mean:double,p:array<double>>"
    stats = [F.struct(F.min(c).cast("long").alias("min"), F.max(c).cast("long").alias("max"), F.avg(c).alias("mean"), F.percentile(c, F.array(*map(F.lit, PERCENTILES))).alias("p")).cast(kind).alias(c) for c in have]
    one = df.agg(F.count("*").alias("num_examples"), *stats).unpivot(["num_examples"], have, "name", "s")
    return one.select("name", "num_examples", "s.min", "s.max", F.round("s.mean", 6).alias("mean"), *(F.round(F.get("s.p", F.lit(i)), 6).alias(f"p{round(p * 100)}") for i, p in enumerate(PERCENTILES)))


def overflow_reason(objective: str) -> str:
    parts = "prompt" if objective == "sequence_classification" else "prompt, score and end token"
    return f"the {parts} of these rows are longer than max_seq_length"


def length_warnings(max_seq_length: int | None, max_response_tokens: int | None, small_budget: int = 1024) -> list[str]:
    """What is odd about the two caps."""
    if max_seq_length is None or max_response_tokens is None:
        return []
    out, budget = [], max_seq_length - max_response_tokens
    if max_response_tokens >= max_seq_length:
        out.append(f"max_response_tokens {max_response_tokens} is not below max_seq_length {max_seq_length}")
    if budget < small_budget:
        out.append(f"prompt budget {budget} is below {small_budget} tokens")
    return out


def warned_rows(df: DataFrame, max_seq_length: int, max_response_tokens: int, small_budget: int = 1024) -> DataFrame:
    """warning, rows: what is odd about the caps, and how many measured rows it concerns, in one aggregate.

    A response cap that isn't below the sequence's concerns responses that the
    one lets pass and the other never can; a small budget concerns rows whose
    prompt without the response is over it.
    """
    found = length_warnings(max_seq_length, max_response_tokens, small_budget)
    passes = F.col("response_token_length") <= max_response_tokens
    over_cap = passes & (F.col("response_token_length") >= max_seq_length)
    over_budget = passes & (F.col("prompt_token_length") - F.col("response_token_length") > max_seq_length - max_response_tokens)
    conditions = [over_cap if w.startswith("max_response_tokens") else over_budget for w in found]
    if not found:
        return df.sparkSession.createDataFrame([], "warning string, rows bigint")
    one = df.agg(*(F.count_if(c).alias(str(i)) for i, c in enumerate(conditions)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(w).alias("warning"), F.col(str(i)).alias("rows")) for i, w in enumerate(found)))))
