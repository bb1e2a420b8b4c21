"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels and score domain.
CORRECT, INCORRECT = "CORRECT", "INCORRECT"
SCORES = (1, 2, 3, 4, 5)
IGNORED_LABEL = -100


def clean_text(value: Column, fallback: str = "N/A") -> Column:
    """Missing text (null, empty, or ``nan`` in any case) becomes the fallback; white space stays."""
    s = value.cast("string")
    return F.when(s.isNull() | (s == "") | (F.lower(s) == "nan"), F.lit(fallback)).otherwise(s)


def binary_label(score: Column, threshold: int = 3) -> Column:
    return F.when(score >= threshold, F.lit(CORRECT)).otherwise(F.lit(INCORRECT))


def class_id(score: Column) -> Column:
    """Scores 1..5 to classes 0..4; anything else raises."""
    return F.when(score.between(1, 5), (score - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("score outside 1..5: "), F.coalesce(score.cast("string"), F.lit("null")))).cast("int"))


def score_of_class(label: Column) -> Column:
    """Classes 0..4 to scores 1..5; anything else raises."""
    return F.when(label.between(0, 4), (label + 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("class outside 0..4: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("int"))


def score_of_metric_label(label: Column, token_scores: dict[int, int] | None = None) -> Column:
    """A label as a score: by token id first, then as a score 1..5, then as a class 0..4; else null."""
    by_token = F.create_map(*(F.lit(x) for kv in token_scores.items() for x in kv))[label] if token_scores else F.lit(None).cast("int")
    return F.coalesce(by_token, F.when(label.between(1, 5), label), F.when(label.between(0, 4), label + 1)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    return ratio(num, den) * 100


def length_bucket(value: Column, edges: Sequence[int]) -> Column:
    """``lo-hi`` of the half-open bucket; ``nan`` below the first edge, from the last on, and for null."""
    out = F.lit("nan")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value >= lo) & (value < hi), F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def safe_name(value: Column) -> Column:
    return F.translate(value, "/ ", "__")


def sample_rank(key: Column, seed: int) -> Column:
    """A reproducible order for sampling, the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def argmax_score(logits: Column) -> Column:
    """1-based place of the first maximum."""
    return F.array_position(logits, F.array_max(logits)).cast("int")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    # the sum is bound once, not written into each element's expression
    both = F.transform(F.array(F.struct(e.alias("e"))), lambda s: F.struct(s["e"].alias("e"), F.aggregate(s["e"], F.lit(0.0), lambda a, x: a + x).alias("z")))
    return F.flatten(F.transform(both, lambda s: F.transform(s["e"], lambda x: x / s["z"])))


def margin(logits: Column) -> Column:
    ordered = F.sort_array(logits, asc=False)
    return ordered[0] - ordered[1]


def entropy(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda a, p: a + p * F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))))


def entropy_of(probs: Sequence[Column]) -> Column:
    """The same over columns."""
    out = F.lit(0.0)
    for p in probs:
        out = out + p * F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))
    return -out


def logsumexp(*parts: Column) -> Column:
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = F.exp(parts[0] - top)
    for p in parts[1:]:
        total = total + F.exp(p - top)
    return top + F.log(total)
