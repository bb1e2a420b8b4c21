"""Chat prompts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeweave.functions.scalar import clean_text

#: The message's headings and the plain template's parts.
HEADINGS = ("### QUESTION\n", "\n\n### REFERENCE ANSWER\n", "\n\n### MODEL RESPONSE\n", "\n\n### SCORE\n")
ROLE = "<|{}|>\n"


def user_message(question: Column, reference: Column, response: Column) -> Column:
    h = [F.lit(x) for x in HEADINGS]
    return F.concat(h[0], clean_text(question), h[1], clean_text(reference), h[2], clean_text(response, ""), h[3])


def messages(user: Column, system_prompt: str, target: Column | None = None) -> Column:
    """array<struct<role, content>>: system, user and, if there is one, the target."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    parts = [one("system", F.lit(system_prompt.strip())), one("user", user)]
    if target is not None:
        parts.append(one("assistant", target.cast("string")))
    return F.array(*parts)


def plain_template(chat: Column, add_generation_prompt: bool = True) -> Column:
    """Messages as text for tokenizers that bring no template."""
    shown = F.transform(chat, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"]))
    text = F.array_join(shown, "\n")
    return F.concat(text, F.lit("\n" + ROLE.format("assistant"))) if add_generation_prompt else text


def prompt(question: Column, reference: Column, response: Column, system_prompt: str) -> Column:
    """The prompt that is measured, trained on and scored, without an array in between."""
    head = ROLE.format("system") + system_prompt.strip() + "\n" + ROLE.format("user")
    return F.concat(F.lit(head), user_message(question, reference, response), F.lit("\n" + ROLE.format("assistant")))


def prompt_overhead(system_prompt: str) -> int:
    """Characters of a prompt beside the three texts."""
    return len(ROLE.format("system") + system_prompt.strip() + "\n" + ROLE.format("user") + "".join(HEADINGS) + "\n" + ROLE.format("assistant"))
