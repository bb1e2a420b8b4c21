"""Scoring prompts with a model: plain functions that run in Arrow batches.

A model is any object that is called with token ids and their mask (two arrays
of batch x length) and returns logits: batch x length x vocabulary for a
language model, batch x classes for a classifier.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np

#: How scores were made.
SINGLE, MULTI, CLASSIFIER = "single_forward_single_token", "multi_forward_continuation", "sequence_classification_logits"
FAST = "restricted_continuation_logprobs_fast"


class Model(Protocol):
    def __call__(self, input_ids: np.ndarray, attention_mask: np.ndarray) -> np.ndarray: ...


@dataclass
class Scores:
    """Five values a prompt, the prompts' token counts, and how the values were made."""

    values: list[list[float]]
    lengths: list[int] | None = None
    method: str | None = None


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    shifted = x - x.max(axis=-1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=-1, keepdims=True))


def padded(rows: Sequence[Sequence[int]], pad_id: int = 0, side: str = "right") -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of rows padded to the longest, on either side."""
    width = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), width), pad_id, np.int64), np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        at = slice(width - len(row), width) if side == "left" else slice(0, len(row))
        ids[i, at], mask[i, at] = row, 1
    return ids, mask


def last_places(mask: np.ndarray) -> np.ndarray:
    """The last place of each row that holds a token, whichever side is padded."""
    return mask.shape[1] - 1 - mask[:, ::-1].argmax(axis=1)


def continuation_logprob(model: Model, prompt: Sequence[int], continuation: Sequence[int]) -> float:
    """Log-probability of a continuation; of one without tokens, or after no prompt, minus infinity."""
    if not len(continuation) or not len(prompt):
        return float("-inf")
    ids = np.array([[*prompt, *continuation]], np.int64)
    rows = log_softmax(model(ids, np.ones_like(ids))[0])[len(prompt) - 1 : -1]
    return float(rows[np.arange(len(continuation)), list(continuation)].sum())


def continuation_logprobs(model: Model, prompts: Sequence[Sequence[int]], continuations: Sequence[Sequence[int]], pad_id: int = 0, side: str = "right", batch_size: int | None = None) -> list[list[float]]:
    """``continuation_logprob`` of each continuation after each prompt, in as few forward passes as batches of ``batch_size`` sequences allow (default: as many as there are prompts).

    All that has to be read is a tree of tokens: one sequence that runs through
    another's tokens gives its values, too, as a token's logits depend on what
    stands before it alone. So only the tree's leaves are passed forward, each
    once, in order of length, so that a batch pads little.
    """
    values = [[float("-inf")] * len(continuations) for _ in prompts]
    asked = [(p, k, (*prompt, *c), len(prompt)) for p, prompt in enumerate(prompts) if len(prompt) for k, c in enumerate(continuations) if len(c)]
    paths = sorted({path[:-1] for _, _, path, _ in asked})  # the last token is looked up, not read
    leaf_of, leaves = {}, []
    for i in range(len(paths) - 1, -1, -1):  # in this order what runs through a path follows it directly
        if not leaves or leaves[-1][: len(paths[i])] != paths[i]:
            leaves.append(paths[i])
        leaf_of[paths[i]] = len(leaves) - 1
    wanted: list[list] = [[] for _ in leaves]
    for p, k, path, start in asked:
        wanted[leaf_of[path[:-1]]].append((p, k, path, start))
    order = sorted(range(len(leaves)), key=lambda i: len(leaves[i]))
    size = max(1, batch_size or len(prompts))
    for at in range(0, len(order), size):
        some = order[at : at + size]
        ids, mask = padded([leaves[i] for i in some], pad_id, side)
        logits = np.asarray(model(ids, mask))
        for row, i in enumerate(some):
            skip = ids.shape[1] - len(leaves[i]) if side == "left" else 0
            begin = min(start for *_, start in wanted[i]) - 1
            rows = log_softmax(logits[row, skip + begin : skip + len(leaves[i])])
            for p, k, path, start in wanted[i]:
                places = np.arange(start - 1, len(path) - 1) - begin
                values[p][k] = float(rows[places, list(path[start:])].sum())
    return values


def score_prompts(model: Model, tokenizer, prompts: Sequence[str], scores: Sequence[str], method: str = FAST) -> Scores:
    """Log-probabilities of the scores after each prompt: of the prompts alone if each score is one token and the fast method is asked for, else of prompts and scores."""
    if not prompts:
        return Scores([], [], None)
    rows, candidates = tokenizer.encode(list(prompts)), tokenizer.encode(list(scores))
    lengths, pad_id, side = [len(r) for r in rows], getattr(tokenizer, "pad_token_id", None) or 0, getattr(tokenizer, "padding_side", "right")
    if method != FAST or any(len(c) != 1 for c in candidates):
        return Scores(continuation_logprobs(model, rows, candidates, pad_id, side), lengths, MULTI)
    if not all(lengths):
        raise ValueError("prompts must have a token at least")
    ids, mask = padded(rows, pad_id, side)
    last = np.asarray(model(ids, mask))[np.arange(len(rows)), last_places(mask)]
    return Scores(log_softmax(last)[:, [c[0] for c in candidates]].tolist(), lengths, SINGLE)


def classify_prompts(model: Model, tokenizer, prompts: Sequence[str], scores: Sequence[str]) -> Scores:
    """Class logits of each prompt; a model with another number of classes is refused."""
    if not prompts:
        return Scores([], [], CLASSIFIER)
    rows = tokenizer.encode(list(prompts))
    logits = np.asarray(model(*padded(rows, getattr(tokenizer, "pad_token_id", None) or 0, getattr(tokenizer, "padding_side", "right"))), np.float64)
    if logits.shape[-1] != len(scores):
        raise ValueError(f"the classifier has {logits.shape[-1]} classes, not {len(scores)}")
    return Scores(logits.tolist(), [len(r) for r in rows], CLASSIFIER)


def model_scorer(make_model: Callable[[], Model], tokenizer, scores: Sequence[str] = ("1", "2", "3", "4", "5"), method: str = FAST) -> Callable[[], Callable[[list[str]], Scores]]:
    """A scorer for ``predict``: the model is made once in each worker."""

    def make():
        model = make_model()
        if method == CLASSIFIER:
            return lambda prompts: classify_prompts(model, tokenizer, prompts, scores)
        return lambda prompts: score_prompts(model, tokenizer, prompts, scores, method)

    return make
