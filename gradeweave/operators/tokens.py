"""Token counts, token rows and their checks.

The code-point tokenizer is pure expressions. Any other tokenizer is a
``Tokenizer``: a picklable object with ``encode(texts) -> list of id lists``,
run over Arrow batches. A tokenizer that brings a chat template (``chat_template``
and ``apply_chat_template``) renders its own prompts; others get the plain one.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.scalar import IGNORED_LABEL, class_id, clean_text
from gradeweave.functions.text import ROLE, prompt, prompt_overhead, user_message
from gradeweave.operators.filters import overflow_reason

#: Fixed value: the template argument of the thinking mode.
THINKING = "enable_thinking"

#: Characters that a Python function renders or encodes at once, however many rows its batch has.
SLICE_CHARS = 1 << 18


class Tokenizer(Protocol):
    eos_token_id: int | None

    def encode(self, texts: Sequence[str]) -> list[list[int]]: ...


class CodePoints:
    """One token a character; end and padding are 0."""

    eos_token_id = 0
    pad_token_id = 0

    def encode(self, texts):
        return [[ord(c) for c in t] for t in texts]

    def decode(self, ids):
        return "".join(map(chr, ids))


class ChatTokenizer:
    """A tokenizer with the thinking mode that its prompts are rendered in.

    Takes tokenizers with ``encode(texts)`` and those that are called with
    texts and return ``input_ids``.
    """

    def __init__(self, inner, enabled: bool | None = None, apply_if_supported: bool = True):
        self.inner, self.arguments = inner, thinking_arguments(inner, enabled, apply_if_supported)
        self.eos_token_id, self.pad_token_id = getattr(inner, "eos_token_id", None), getattr(inner, "pad_token_id", None)
        if self.pad_token_id is None:  # the end token pads where there is no other
            self.pad_token_id = self.eos_token_id
        self.padding_side = getattr(inner, "padding_side", "right")
        self.chat_template = getattr(inner, "chat_template", None)
        self.name_or_path = getattr(inner, "name_or_path", type(inner).__name__)

    def encode(self, texts):
        if callable(self.inner):
            return self.inner(list(texts), add_special_tokens=False, truncation=False)["input_ids"]
        return self.inner.encode(list(texts))

    def apply_chat_template(self, messages, tokenize=False, add_generation_prompt=True):
        return self.inner.apply_chat_template(messages, tokenize=tokenize, add_generation_prompt=add_generation_prompt, **self.arguments)


def chat_tokenizer(tokenizer, config: dict):
    """The tokenizer with the configured thinking mode; none stays none."""
    mode = (config.get("model") or {}).get("thinking_mode") or {}
    return tokenizer if tokenizer is None or isinstance(tokenizer, ChatTokenizer) else ChatTokenizer(tokenizer, mode.get("enabled"), mode.get("apply_if_supported", True))


def has_template(tokenizer) -> bool:
    return bool(getattr(tokenizer, "chat_template", None)) and hasattr(tokenizer, "apply_chat_template")


def counts_characters(tokenizer) -> bool:
    return tokenizer is None or isinstance(getattr(tokenizer, "inner", tokenizer), CodePoints)


def render(messages: Sequence[dict], tokenizer=None, add_generation_prompt: bool = True) -> str:
    """Messages as one text: by the tokenizer's template, else by the plain one."""
    if has_template(tokenizer):
        return tokenizer.apply_chat_template(list(messages), tokenize=False, add_generation_prompt=add_generation_prompt)
    parts = [ROLE.format(m["role"]) + m["content"] for m in messages]
    return "\n".join([*parts, ROLE.format("assistant")] if add_generation_prompt else parts)


def _slices(s: pd.Series) -> Iterator[pd.Series]:
    """Rows of a batch with some ``SLICE_CHARS`` characters at most (one row at least); nulls are empty."""
    s = s.fillna("")
    end = s.str.len().to_numpy().cumsum()
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield s.iloc[at:to]
        at = to


def rendered(user: Column, system_prompt: str, tokenizer: Tokenizer) -> Column:
    """Prompts by the tokenizer's own template, in Arrow batches."""
    system = {"role": "system", "content": system_prompt.strip()}

    @F.pandas_udf("string")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for whole in batches:
            for s in _slices(whole):
                yield pd.Series([render([system, {"role": "user", "content": u}], tokenizer) for u in s])

    return shown(user)


def code_points(text: Column) -> Column:
    """array<int> of a text's code points; the empty text has none."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def encoded(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    if counts_characters(tokenizer):
        return code_points(text)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for whole in batches:
            for s in _slices(whole):
                yield pd.Series([np.asarray(ids, np.int32) for ids in tokenizer.encode(s.tolist())])

    return encode.asNondeterministic()(text)  # else a filter on the ids' number would encode once more


def token_count(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    if counts_characters(tokenizer):
        return F.length(text).cast("long")

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for whole in batches:
            for s in _slices(whole):
                yield pd.Series([len(x) for x in tokenizer.encode(s.tolist())])

    return count(text)


def with_response_lengths(df: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    return df.withColumn("response_token_length", token_count(clean_text(F.col("response"), ""), tokenizer))


def prompt_col(system_prompt: str, tokenizer: Tokenizer | None = None, response: str = "response") -> Column:
    texts = F.col("question"), F.col("reference_answer"), F.col(response)
    return rendered(user_message(*texts), system_prompt, tokenizer) if has_template(tokenizer) else prompt(*texts, system_prompt)


def with_sequence_lengths(df: DataFrame, system_prompt: str, objective: str = "causal_lm", tokenizer: Tokenizer | None = None) -> DataFrame:
    """Add prompt_token_length, target_token_length and sequence_length.

    A language-model row ends with its score's token and the end token; a
    classifier's row is the prompt alone.
    """
    if counts_characters(tokenizer) and not has_template(tokenizer):
        texts = sum((F.length(c) for c in (clean_text(F.col("question")), clean_text(F.col("reference_answer")), clean_text(F.col("response"), ""))), F.lit(prompt_overhead(system_prompt)))
        length = texts.cast("long")
    else:
        length = token_count(prompt_col(system_prompt, tokenizer), tokenizer)
    target = F.lit(1).cast("long") if counts_characters(tokenizer) else token_count(F.col("target_score").cast("string"), tokenizer)
    end = int((tokenizer or CodePoints()).eos_token_id is not None)
    if objective == "sequence_classification":
        target, end = F.lit(0).cast("long"), 0
    df = df.withColumns({"prompt_token_length": length, "target_token_length": target})
    return df.withColumn("sequence_length", F.col("prompt_token_length") + F.col("target_token_length") + end)


def token_rows(df: DataFrame, system_prompt: str, objective: str = "causal_lm", max_seq_length: int = 3072, on_overflow: str = "skip", tokenizer: Tokenizer | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Training rows: example_id, input_ids, attention_mask, labels, length, prompt_length, target_score, and columns to ``keep``.

    Labels of a language model are ignored on the prompt and the end token;
    a classifier has its class. Overflowing rows leave, or raise; so does a
    classifier's score outside 1 to 5.
    """
    if on_overflow not in ("skip", "error"):
        raise ValueError(f"on_sequence_overflow: {on_overflow}")
    classes = objective == "sequence_classification"
    if counts_characters(tokenizer) and not has_template(tokenizer) and on_overflow == "skip":
        # lengths are known before anything is encoded
        df = with_sequence_lengths(df, system_prompt, objective, tokenizer).where(F.col("sequence_length") <= max_seq_length)
    eos = (tokenizer or CodePoints()).eos_token_id
    end = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<int>")
    df = df.withColumn("__p", encoded(prompt_col(system_prompt, tokenizer), tokenizer))
    ids = lambda n, value: F.array_repeat(F.lit(value), n)
    if classes:
        rows = df.withColumns({"input_ids": F.col("__p"), "labels": class_id(F.col("target_score")), "__n": F.size("__p")})
    else:
        df = df.withColumn("__t", encoded(F.col("target_score").cast("string"), tokenizer))
        hidden = IGNORED_LABEL
        rows = df.withColumns({"input_ids": F.concat("__p", "__t", end), "labels": F.concat(ids(F.size("__p"), hidden), "__t", ids(F.lit(int(eos is not None)), hidden)), "__n": F.size("__p") + F.size("__t") + F.lit(int(eos is not None))})
    rows = rows.withColumns({"attention_mask": ids(F.col("__n"), 1), "length": F.col("__n"), "prompt_length": F.size("__p")})
    if on_overflow == "error":
        over = F.raise_error(F.concat(F.lit(overflow_reason(objective) + ": "), F.col("length").cast("string"))).cast("boolean")
        rows = rows.where(F.when(F.col("length") > max_seq_length, over).otherwise(F.lit(True)))
    elif not counts_characters(tokenizer) or has_template(tokenizer):
        rows = rows.where(F.col("length") <= max_seq_length)
    return rows.select("example_id", "input_ids", "attention_mask", "labels", "length", "prompt_length", "target_score", *keep)


def token_debug(rows: DataFrame) -> DataFrame:
    """One row per token: position, token_id, supervised, label_id."""
    pairs = F.posexplode(F.arrays_zip(F.col("input_ids").alias("i"), F.col("labels").alias("l"))).alias("position", "t")
    out = rows.select("example_id", pairs)
    seen = F.col("t.l") != IGNORED_LABEL
    return out.select("example_id", "position", F.col("t.i").alias("token_id"), seen.alias("supervised"), F.col("t.l").alias("label_id"))


def score_tokens(tokenizer: Tokenizer, scores: Sequence[str] = ("1", "2", "3", "4", "5")) -> list[dict]:
    """Each allowed score's tokens: a handful of rows, on the driver."""
    return [{"score": s, "token_ids": ids, "num_tokens": len(ids)} for s, ids in zip(scores, tokenizer.encode(list(scores)))]


def validate_score_tokens(tokenizer: Tokenizer, scores: Sequence[str], require_single: bool = False) -> list[dict]:
    """Scores must be exactly 1 to 5, tokenise to something, differently, and to one token if asked."""
    if sorted(scores) != ["1", "2", "3", "4", "5"]:
        raise ValueError(f"allowed scores must be 1 to 5: {list(scores)}")
    report = score_tokens(tokenizer, scores)
    seen = [tuple(r["token_ids"]) for r in report]
    if not all(seen) or len(set(seen)) < len(seen):
        raise ValueError("scores must have different, non-empty tokens")
    if require_single and any(len(x) != 1 for x in seen):
        raise ValueError("scores must be single tokens")
    return report


def score_token_use(rows: DataFrame, tokenizer: Tokenizer, scores: Sequence[str] = ("1", "2", "3", "4", "5"), require_single: bool = False) -> DataFrame:
    """score, token_id (its first), num_tokens, rows: how many token rows have the score, and how many of them begin their supervised tokens otherwise (``astray``)."""
    report = validate_score_tokens(tokenizer, scores, require_single)
    every = rows.sparkSession.createDataFrame([(r["score"], int(r["token_ids"][0]), r["num_tokens"]) for r in report], "score string, token_id int, num_tokens int")
    first = F.get(F.filter("labels", lambda x: x != IGNORED_LABEL), F.lit(0))
    counts = rows.groupBy(F.col("target_score").cast("string").alias("score"), first.alias("first")).agg(F.count("*").alias("n"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    joined = every.join(counts, "score", "left")
    return joined.groupBy("score", "token_id", "num_tokens").agg(n("n").alias("rows"), n(F.when(~F.col("first").eqNullSafe(F.col("token_id")), F.col("n"))).alias("astray"))


def takes_thinking(tokenizer) -> bool:
    """Whether the template can be called with a thinking mode."""
    call = getattr(tokenizer, "apply_chat_template", None)
    try:
        given = inspect.signature(call).parameters if call else {}
    except (TypeError, ValueError):  # no signature to see
        return False
    return THINKING in given or any(p.kind is p.VAR_KEYWORD for p in given.values())


def supports_thinking(tokenizer) -> bool:
    """Whether the template takes the mode and, by its text or the model's name, knows it."""
    if not takes_thinking(tokenizer):
        return False
    more = getattr(tokenizer, "init_kwargs", None)
    named = [getattr(tokenizer, k, None) for k in ("name_or_path", "_name_or_path", "model_name")] + ([more.get(k) for k in ("name_or_path", "tokenizer_file")] if isinstance(more, dict) else [])
    return THINKING in str(getattr(tokenizer, "chat_template", "") or "") or any("qwen3" in str(n).lower() for n in named if n)


def thinking_arguments(tokenizer, enabled: bool | None, apply_if_supported: bool = True) -> dict:
    """Template arguments for the thinking mode: none unless it is set and the tokenizer knows it."""
    return {THINKING: bool(enabled)} if enabled is not None and apply_if_supported and supports_thinking(tokenizer) else {}
