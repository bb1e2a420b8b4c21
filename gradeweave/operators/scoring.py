"""From five logits to predictions, and the hook for an external scorer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeweave.functions.scalar import IGNORED_LABEL, SCORES, argmax_score, binary_label, entropy, entropy_of, margin, score_of_metric_label, softmax
from gradeweave.functions.text import prompt, user_message
from gradeweave.operators.inference import CLASSIFIER, FAST, Scores
from gradeweave.operators.metrics import all_metrics
from gradeweave.operators.tokens import has_template, prompt_col, rendered, token_count

PREDICTION_KEYS = ("pred_score int, pred_binary string, target_score int, target_binary string, model_id string, benchmark string, task string, example_id string, "
                   "response_token_length bigint, sequence_length bigint, prompt_token_length_inference bigint, score_margin double, score_entropy double, scoring_method string, candidate_token_ids string")


def sorted_scores(allowed: Sequence[str]) -> list[str]:
    """Classes are scores in numeric order, however the configuration lists them."""
    return sorted(allowed, key=int)


def normalised(df: DataFrame, logits: Sequence[str], threshold: int = 3, order: Sequence[int] = SCORES) -> DataFrame:
    """Add pred_score, pred_binary, prob_1..5, score_margin and score_entropy from five logit columns, in order of the scores. Of equal ones the first by ``order`` is predicted.

    Plain columns, step by step: each step's expressions are used more than
    once by the next, so the optimizer keeps them apart and compiles all.
    """
    x = {s: F.col(c).cast("double") for s, c in zip(SCORES, logits)}
    df = df.withColumns({f"__x{s}": v for s, v in x.items()})
    x = {s: F.col(f"__x{s}") for s in SCORES}
    known = x[1].isNotNull()
    for s in SCORES[1:]:
        known = known & x[s].isNotNull()
    df = df.withColumn("__top", F.when(known, F.greatest(*x.values())))
    top = F.col("__top")
    pred = F.lit(None).cast("int")
    for s in reversed(order):
        pred = F.when(x[s] == top, F.lit(s)).otherwise(pred)
    df = df.withColumns({"pred_score": pred, **{f"__e{s}": F.exp(x[s] - top) for s in SCORES}})
    # the highest beside the first highest
    second = F.greatest(*(F.when(F.col("pred_score") != s, x[s]) for s in SCORES))
    total = sum((F.col(f"__e{s}") for s in SCORES[1:]), F.col("__e1"))
    df = df.withColumns({"__z": total, "score_margin": top - second})
    df = df.withColumns({f"prob_{s}": F.col(f"__e{s}") / F.col("__z") for s in SCORES})
    out = df.withColumns({"score_entropy": entropy_of([F.col(f"prob_{s}") for s in SCORES]), "pred_binary": binary_label(F.col("pred_score"), threshold)})
    kept = [c for c in out.columns if not c.startswith("__x") and not c.startswith("__e") and c not in ("__top", "__z")]
    order = ["pred_score", *(f"prob_{s}" for s in SCORES), "score_margin", "score_entropy", "pred_binary"]
    return out.select(*(c for c in kept if c not in order), *order)


def log_probs(logits: Column) -> Column:
    """Log-softmax of an array."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    return F.transform(logits, lambda x: x - lse)


def candidate_ids_json(ids: dict[str, list[int]]) -> str:
    return json.dumps(ids, sort_keys=True)


#: Prompts to five values each, or to ``Scores``.
Scorer = Callable[[list[str]], "list[list[float]] | Scores"]


def _scored(score: Scorer, prompts: list[str], batch_size: int) -> list[tuple]:
    """(values, length, method) of each prompt. Prompts of like length share a batch, so that little is padded."""
    found: list[tuple] = [()] * len(prompts)
    order = sorted(range(len(prompts)), key=lambda i: len(prompts[i] or ""))
    for at in range(0, len(order), batch_size):
        some = order[at : at + batch_size]
        got = score([prompts[i] for i in some])
        got = got if isinstance(got, Scores) else Scores(got)
        for place, values, length in zip(some, got.values, got.lengths or [None] * len(some), strict=True):
            found[place] = (values, length, got.method)
    return found


def predict(
    df: DataFrame, scorer: Callable[[], Scorer], system_prompt: str, threshold: int = 3, batch_size: int = 64, method: str = FAST, candidate_ids: dict | None = None, tokenizer=None, order: Sequence[int] = SCORES
) -> DataFrame:
    """Score a table's prompts with an external model and normalise.

    ``scorer`` makes the model once in each Python worker; the model takes
    prompts and gives five values each: log-probabilities, or a classifier's
    logits. What it says of lengths and method stands; else the prompt's
    length is the tokenizer's count, and ``method`` the method.
    """
    prefix = "logit" if method == CLASSIFIER else "logprob"
    df = df.withColumn("__prompt", prompt_col(system_prompt, tokenizer))
    made = [T.StructField("__values", T.ArrayType(T.DoubleType())), T.StructField("__length", T.LongType()), T.StructField("__method", T.StringType())]
    schema = T.StructType(df.schema.fields + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for whole in batches:
            found = _scored(score, whole.column("__prompt").to_pylist(), batch_size)
            more = [pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), (pa.list_(pa.float64()), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*whole.columns, *more], names=schema.names)

    scored = df.mapInArrow(run, schema)
    names = [f"{prefix}_{s}" for s in SCORES]
    scored = scored.withColumns({n: F.col("__values")[i] for i, n in enumerate(names)})
    out = normalised(scored, names, threshold, SCORES if prefix == "logit" else order)
    extra = {"scoring_method": F.coalesce("__method", F.lit(method)), "candidate_token_ids": F.lit(candidate_ids_json(candidate_ids or {})), "prompt_token_length_inference": F.coalesce("__length", token_count(F.col("__prompt"), tokenizer))}
    return out.withColumns(extra).drop("__prompt", "__values", "__length", "__method")


def empty_predictions(spark, prefix: str = "logprob") -> DataFrame:
    return spark.createDataFrame([], PREDICTION_KEYS + "".join(f", {prefix}_{s} double" for s in SCORES) + "".join(f", prob_{s} double" for s in SCORES))


def validate_record(reference: str = "reference_answer", truth: str = "ground_truth") -> Column:
    """Missing fields of a record to score, as a list; empty if it is complete."""
    missing = F.array(
        F.when(F.col("question").isNull(), F.lit("question")),
        F.when(F.col("model_response").isNull(), F.lit("model_response")),
        F.when(F.coalesce(F.col(reference), F.col(truth)).isNull(), F.lit("reference_answer or ground_truth")),
    )
    return F.filter(missing, lambda x: x.isNotNull())


def score_records(df: DataFrame, logits: Column, threshold: int = 3) -> DataFrame:
    """Add the output of one scored record: score, label, confidence, margin, entropy, probs and logprobs (JSON)."""
    df = df.withColumn("__l", logits)
    df = df.withColumns({"__p": softmax(F.col("__l")), "__lp": log_probs(F.col("__l"))})
    score = argmax_score(F.col("__l"))
    return df.withColumns({"score": score, "confidence": F.array_max("__p"), "margin": margin(F.col("__lp")), "entropy": entropy(F.col("__p"))}).withColumn("label", binary_label(F.col("score"), threshold)).withColumnsRenamed({"__p": "probs", "__lp": "logprobs"}).drop("__l")


def record_prompt(system_prompt: str, tokenizer=None) -> Column:
    """The prompt of a record to score: its response is ``model_response``, its reference either of two names."""
    reference = F.coalesce(F.col("reference_answer"), F.col("ground_truth"))
    if has_template(tokenizer):
        return rendered(user_message(F.col("question"), reference, F.col("model_response")), system_prompt, tokenizer)
    return prompt(F.col("question"), reference, F.col("model_response"), system_prompt)


def predict_records(df: DataFrame, scorer: Callable[[], Scorer], settings: dict, tokenizer=None, batch_size: int = 64) -> DataFrame:
    """Check, render, score: records with question, model_response and a reference get the columns of ``score_records``.

    Incomplete records raise with the names of what is missing.
    """
    for c in ("reference_answer", "ground_truth"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    missing = validate_record()
    checked = F.when(F.size(missing) == 0, record_prompt(settings["system_prompt"], tokenizer)).otherwise(F.raise_error(F.concat(F.lit("record without "), F.array_join(missing, ", "))))
    df = df.withColumn("__prompt", checked)
    schema = T.StructType(df.schema.fields + [T.StructField("__values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for whole in batches:
            found = _scored(score, whole.column("__prompt").to_pylist(), batch_size)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array([v for v, *_ in found], pa.list_(pa.float64()))], names=schema.names)

    return score_records(df.mapInArrow(run, schema), F.col("__values"), settings["binary_threshold"]).drop("__prompt", "__values")


def _first_supervised(labels: Column) -> Column:
    """Place (from 1) of the first label that counts; 0 if there is none."""
    return F.array_position(F.transform(labels, lambda x: x != IGNORED_LABEL), True)


def score_logits(df: DataFrame, token_ids: Sequence[int], logits: str = "logits", labels: str = "labels") -> DataFrame:
    """Add logit_1..5: the scores' logits where the target is predicted, one place before the first supervised label.

    ``logits`` is an array by place and token, or one place's array by token,
    or the five values themselves.
    """
    c = F.col(logits)
    nested = isinstance(df.schema[logits].dataType.elementType, T.ArrayType)
    if nested:
        df = df.withColumn("__at", F.get(c, F.greatest(_first_supervised(F.col(labels)) - 2, F.lit(0)).cast("int")))
        c = F.col("__at")
    pick = lambda i, t: F.get(c, F.lit(t)) if nested else F.when(F.size(c) == len(token_ids), F.get(c, F.lit(i))).otherwise(F.get(c, F.lit(t)))
    return df.withColumns({f"logit_{s}": pick(i, t) for i, (s, t) in enumerate(zip(SCORES, token_ids))}).drop("__at")


def labelled_scores(df: DataFrame, token_ids: Sequence[int], labels: str = "labels") -> DataFrame:
    """Add target_score from the first supervised token (or the plain label); rows without a valid one leave."""
    label = F.col(labels)
    if isinstance(df.schema[labels].dataType, T.ArrayType):
        label = F.get(label, (_first_supervised(label) - 1).cast("int"))
    target = score_of_metric_label(label, {t: s for s, t in zip(SCORES, token_ids)})
    return df.withColumn("target_score", target).where(F.col("target_score").isNotNull())


def labelled_classes(df: DataFrame, label: str = "labels") -> DataFrame:
    """Add target_score of classes 0 to 4; other labels leave."""
    return df.where(F.col(label).between(0, len(SCORES) - 1)).withColumn("target_score", (F.col(label) + 1).cast("int"))


def logit_metrics(df: DataFrame, threshold: int = 3, token_ids: Sequence[int] | None = None, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """Metrics of an evaluation pass's logits and labels: by the scores' tokens, or without them by class. No valid row, no metrics."""
    if token_ids is None:
        rows = labelled_classes(df, labels).withColumns({f"logit_{s}": F.get(F.col(logits), F.lit(i)) for i, s in enumerate(SCORES)})
    else:
        rows = labelled_scores(score_logits(df, token_ids, logits, labels), token_ids, labels)
    return all_metrics(normalised(rows, [f"logit_{s}" for s in SCORES], threshold), threshold).where("num_examples > 0")
