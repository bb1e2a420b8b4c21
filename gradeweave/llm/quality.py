"""Quality rules: a decision list learned from labelled statistics.

Statistics of each text are DataFrame expressions (no shuffle, no Python). The
list is learned by sequential covering: a rule is a conjunction of thresholds,
grown condition by condition for the best gain on two thirds of the labelled
statistics, then pruned on the last third; it stands if it is precise enough
there, the rows it covers leave, and the next rule follows. The finished list
is one ordered conditional expression, applied to every row in the scan.

Fitting uses at most ``sample_rows`` labelled documents (those with the lowest
hash of their key; of a repeated key the smallest text), so its broadcast and
its collected table have a fixed bound whatever the input; the statistics and the verdicts cover all rows.

Defined results: a null text has no words, fails the base rules and is not
kept; repeated rows get the same verdict; columns of other names stay, those
named as a statistic are replaced; without labels the list is empty and
the base rules alone decide; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.common import SPACES, words_col

SAMPLE_ROWS = 20_000
WINDOW = 5

#: What conditions are about: ratios of the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "chars_per_word": "word_chars / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct / n_words",
    "upper_share": "n_upper / word_chars",
    "marks_share": "n_marks / word_chars",
}


def _count(text: Column, chars: str) -> Column:
    """Characters of a text that are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics' columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper, n_marks.

    Windows of five words are compared by 64-bit hashes; their places are
    sorted only in texts where two windows agree.
    """
    own = "__"
    while any(c.lower().startswith(own) for c in df.columns):  # names for the steps that no column has
        own += "_"
    W, LINES, H, S, P, ALL = (f"{own}{x}" for x in ("words", "lines", "hashes", "sorted", "places", "all"))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    df = df.withColumns({W: words_col(F.col(text)), LINES: lines})
    n = F.size(W)
    df = df.withColumn(H, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(W), i, WINDOW)))))
    twice = F.size(F.array_distinct(H)) < F.size(H)
    df = df.withColumn(S, F.when(twice, F.sort_array(F.transform(H, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col(S)
    near = lambda k: (F.get(s, k)["h"].eqNullSafe(F.get(s, k - 1)["h"])) | (F.get(s, k)["h"].eqNullSafe(F.get(s, k + 1)["h"]))
    places = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(near(k), F.get(s, k)["i"])), lambda p: p.isNotNull())
    df = df.withColumn(P, F.when(s.isNotNull(), F.sort_array(places)))
    p = F.col(P)
    covers = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.least(F.lit(WINDOW), F.get(p, k + 1) - F.get(p, k)))
    covered = F.when(p.isNotNull(), F.aggregate(covers, F.lit(0), lambda a, x: a + x)).otherwise(0)
    stats = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(W, "")).cast("long"),
        "n_symbols": _count(t, "#*$%&|<>"),
        "n_dup_lines": (F.size(LINES) - F.size(F.array_distinct(LINES))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_lines": F.size(LINES).cast("long"),
        "n_distinct": F.size(F.array_distinct(W)).cast("long"),
        "n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long"),
        "n_marks": _count(t, ".,;:!?"),
    }
    # A generator of one row: filters on the statistics aren't pushed below it,
    # where they would repeat these expressions inside each other.
    once = F.explode(F.array(F.struct(*(e.alias(k) for k, e in stats.items()))))
    clash = {k.lower() for k in stats}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in clash and c not in (W, LINES, H, S, P)]
    return df.select(*kept, once.alias(ALL)).select(*kept, f"{ALL}.*")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        v = rows[self.feature]  # nan: unknown, and no condition on it holds
        return v >= self.cut if self.above else v < self.cut

    def column(self) -> Column:
        f = F.expr(FEATURES[self.feature].replace(" / ", " / nullif(") + ", 0)")
        return F.coalesce(f >= self.cut if self.above else f < self.cut, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covered(rows: dict[str, np.ndarray], rule: Sequence[Condition]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(rows) for c in rule]) if rule else np.ones(len(rows["bad"]), bool)


def _split(rows: dict[str, np.ndarray], rule: Sequence[Condition]) -> tuple[int, int]:
    """Bad and good rows that the rule covers."""
    bad = rows["bad"][_covered(rows, rule)]
    return int(bad.sum()), int(len(bad) - bad.sum())


def _only(rows: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[keep] for k, v in rows.items()}


def _grow(rows: dict[str, np.ndarray], cuts: dict[str, list[float]], most: int) -> Rule:
    rule: list[Condition] = []
    inside = rows
    while len(rule) < most:
        p0, n0 = _split(inside, ())
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for feature, values in cuts.items():
            for above in (True, False):
                for cut in values:
                    c = Condition(feature, above, cut)
                    p, n = _split(inside, [c])
                    if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                        best, gain = c, g
        if not best:
            break
        rule.append(best)
        inside = _only(inside, best.holds(inside))
    return tuple(rule)


def _worth(rows: dict[str, np.ndarray], rule: Sequence[Condition]) -> float:
    p, n = _split(rows, rule)
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: dict[str, np.ndarray], most_rules: int = 8, most_conditions: int = 3, precision: float = 0.95, cuts: int = 24, least: int = 3) -> list[Rule]:
    """Rules for bad rows, in order. Rows: the features, ``bad`` (0 or 1) and ``third`` (0, 1, 2)."""
    grow, prune = _only(rows, rows["third"] > 0), _only(rows, rows["third"] == 0)
    values = {}
    for f in FEATURES:
        seen = np.unique(grow[f][~np.isnan(grow[f])])
        between = (seen[1:] + seen[:-1]) / 2
        at = np.unique(np.concatenate((np.linspace(0, len(between) - 1, cuts), [0, 1])).astype(int)) if len(between) > 1 else range(len(between))
        values[f] = [float(between[i]) for i in at]
    found: list[Rule] = []
    while len(found) < most_rules:
        rule = _grow(grow, values, most_conditions)
        while len(rule) > 1 and _worth(prune, rule[:-1]) >= _worth(prune, rule):
            rule = rule[:-1]
        (p, n), (pp, pn) = _split(grow, rule), _split(prune, rule)
        if not rule or p + pp < least or (p + pp) < precision * (p + pp + n + pn) or pn > (1 - precision) * (pp + pn):
            break
        found.append(rule)
        grow, prune = (_only(part, ~_covered(part, rule)) for part in (grow, prune))
    return found


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality", **options) -> list[Rule]:
    """The decision list of the labelled documents (label 0: bad)."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__label"))
    # at most sample_rows rows of two numbers: the bound of this broadcast
    sample = one.orderBy(F.xxhash64("__key"), "__key").limit(sample_rows)
    chosen = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(sample), "__key")
    # one text a key, so that what is collected keeps the bound where keys repeat
    chosen = chosen.groupBy("__key", "__label").agg(F.min("__text").alias("__text"))
    ratios = [F.expr(e.replace(" / ", " / nullif(") + ", 0)").alias(n) for n, e in FEATURES.items()]
    stats = with_statistics(chosen, "__text").select(F.when(F.col("__label") == 0, 1).otherwise(0).alias("bad"), F.pmod(F.xxhash64(F.lit(1), "__key"), F.lit(3)).alias("third"), *ratios)
    got = stats.collect()
    rows = {c: np.array([math.nan if r[c] is None else r[c] for r in got], float) for c in stats.columns}
    return learn(rows, **options)


def verdict(rules: Sequence[Rule]) -> Column:
    """True where no rule of the list rejects: one ordered conditional."""
    out = F.lit(True)
    for rule in reversed(rules):
        all_ = rule[0].column()
        for c in rule[1:]:
            all_ = all_ & c.column()
        out = F.when(all_, F.lit(False)).otherwise(out)
    return out


def decide(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The rows with their statistics, ``base_failed`` and ``kept``."""
    out = with_statistics(df, text)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
