"""Ordinal, binary and calibration metrics for any grouping.

A first aggregate counts rows and sums confidences by group, cell (scores,
labels, calibration bin) and slot of the confidence, and is kept. All metrics
derive from it. For percentiles it also says which slots hold the wanted
places; only those slots' rows are read again, split further where they crowd.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.functions.scalar import CORRECT, INCORRECT, SCORES, ratio
from gradeweave.sources.tables import held

BINS = 10
#: Edges as numpy.linspace gives them: 0.3, 0.6 and 0.7 lie just below theirs.
EDGES = [i * 0.1 if i < BINS else 1.0 for i in range(BINS + 1)]
LABELS = (INCORRECT, CORRECT)
CELL = ("target_score", "pred_score", "target_binary", "pred_binary")


def prepared(df: DataFrame, threshold: int = 3) -> DataFrame:
    """Add confidence, bin and binary labels where they are missing."""
    more = {}
    for side in ("target", "pred"):
        if f"{side}_binary" not in df.columns:
            more[f"{side}_binary"] = F.when(F.col(f"{side}_score") >= threshold, CORRECT).otherwise(INCORRECT)
    probs = [f"prob_{s}" for s in SCORES if f"prob_{s}" in df.columns]
    if probs:
        more["confidence"] = F.greatest(*probs) if len(probs) > 1 else F.col(probs[0])
    df = df.withColumns(more) if more else df
    if probs:
        c, near = F.col("confidence"), F.col("__near")
        edge = lambda k: F.get(F.array(*map(F.lit, EDGES)), k)
        # the tenth, put right where its edges are not the decimal ones
        df = df.withColumn("__near", F.least(F.floor(c * BINS), F.lit(BINS - 1)).cast("int"))
        b = near - F.when(c < edge(near), 1).otherwise(0) + F.when((near < BINS - 1) & (c >= edge(near + 1)), 1).otherwise(0)
        df = df.withColumn("bin", F.when(c.between(0.0, 1.0), b)).drop("__near")
    return df


def _hit() -> Column:
    return F.col("target_score") == F.col("pred_score")


def cells(df: DataFrame, keys: Sequence[str], calibrated: bool = True) -> DataFrame:
    """Rows and sums by keys, cell and slot of the confidence: the only pass over all rows that the metrics need."""
    if not calibrated:
        return df.groupBy(*keys, *CELL).agg(F.count("*").alias("n"))
    sums = [f(c).alias(f"{name}_{c}") for c in _MEANS for name, f in (("sum", F.sum), ("of", F.count))]
    ends = [F.min("confidence").alias("__lo"), F.max("confidence").alias("__hi")]
    return df.withColumn("__slot", _slot(F.col("confidence"), SLOTS)).groupBy(*keys, *CELL, "bin", "__slot").agg(F.count("*").alias("n"), *sums, *ends)


_MEANS = ("confidence", "score_margin", "score_entropy")


def _sums(calibrated: bool) -> dict[str, Column]:
    """What one cell adds, by the name of the sum; the names hold the cell's own scores, labels and bin."""
    n, t, p = (F.col(c) for c in ("n", "target_score", "pred_score"))
    d = F.abs(t - p)
    named = {"'n'": n, "'hit'": F.when(_hit(), n), "'distance'": n * d, "'measured'": F.when(d.isNotNull(), n), "'near'": F.when(d <= 1, n), "'same'": F.when(F.col("target_binary") == F.col("pred_binary"), n)}
    named |= {"concat('c_', target_score, '_', pred_score)": n, "concat('b_', target_binary, '_', pred_binary)": n}
    if calibrated:
        named["concat('gap_', bin)"] = F.col("sum_confidence") - F.coalesce(_hit(), F.lit(False)).cast("double") * n
        named |= {f"'{x}_{c}'": F.col(f"{x}_{c}") for c in _MEANS for x in ("sum", "of")}
    return named


def summed(parts: DataFrame, keys: Sequence[str], calibrated: bool = True) -> DataFrame:
    """From cells to the sums that all metrics derive from, a row for each value of the keys.

    Cells give named sums, one aggregate adds them by name, and a pivot makes
    them columns: an aggregate with a condition for each would be too much code
    to compile.
    """
    parts = parts.groupBy(*keys, *CELL, *(["bin"] if calibrated else [])).agg(*(F.sum(c).alias(c) for c in ["n", *([f"{x}_{c}" for c in _MEANS for x in ("sum", "of")] if calibrated else [])]))
    adds = F.array(*(F.struct(F.expr(name).alias("__name"), value.cast("double").alias("__value")) for name, value in _sums(calibrated).items()))
    cellular = [f"c_{i}_{j}" for i in SCORES for j in SCORES] + [f"b_{i}_{j}" for i in LABELS for j in LABELS]
    names = ["n", "hit", "distance", "measured", "near", "same", *cellular]
    if calibrated:
        names += [*(f"gap_{k}" for k in range(BINS)), *(f"{x}_{c}" for c in _MEANS for x in ("sum", "of"))]
    long = parts.select(*keys, F.inline(adds))
    wide = long.groupBy(*keys).pivot("__name", names).agg(F.sum("__value"))
    total = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(0.0))
    share = lambda name, of="n": F.try_divide(total(name), total(of))
    out = [total("n").cast("long").alias("num_examples"), share("hit").alias("ordinal_accuracy"), share("distance", "measured").alias("ordinal_mae"), share("near").alias("within_1_accuracy"), share("same").alias("binary_accuracy")]
    out += [total(c).cast("long").alias(c) for c in cellular]
    if calibrated:
        out += [share(f"sum_{m}", f"of_{m}").alias(f"{m}_mean") for m in _MEANS] + [total(f"gap_{k}").alias(f"gap_{k}") for k in range(BINS)]
    return wide.select(*keys, *out)


#: Slots of a level of the percentiles' histogram, rows of one that are put in order rather than split again, and places that are broadcast.
SLOTS, MOST, BROADCAST_ROWS = 1024, 1 << 16, 100_000


def _slot(value: Column, slots: int) -> Column:
    """Of [0, 1]; values outside fall into the end slots, NaN into one of its own."""
    return F.when(~F.isnan(value), F.least(F.greatest(F.floor(value * slots), F.lit(0)), F.lit(slots - 1)).cast("int")).otherwise(F.when(value.isNotNull(), -1))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], slots: int = SLOTS, most: int = MOST) -> DataFrame:
    """Exact, interpolated percentiles of a column that mostly lies in [0, 1], a row for each value of the keys. Nulls and NaN don't count.

    Counts by slot say which slots hold the wanted places. A slot with one
    distinct value is done. One with more than ``most`` rows is split between
    its own least and greatest value, again and again, so values that crowd
    anywhere come apart; the others' distinct values are put in order, at most
    ``most`` in a task. Every pass is combined before its shuffle.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("__v"))
    counts = rows.groupBy(*keys, _slot(F.col("__v"), slots).alias("__slot")).agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    return _located(rows, counts.drop("__slot"), keys, wanted, slots, most)


def _located(rows: DataFrame, counts: DataFrame, keys: Sequence[str], wanted: dict[str, float], slots: int = SLOTS, most: int = MOST) -> DataFrame:
    """Percentiles of the rows' ``__v``, from their first counts (keys, __c, __lo, __hi)."""
    earlier = lambda *by: Window.partitionBy(*by).orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *by: F.coalesce(F.sum("__c").over(earlier(*by)), F.lit(0))
    place = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    ends = [f(place(p)) for p in wanted.values() for f in (F.floor, F.ceil)]
    holds = [(F.col("__before") <= e) & (e < F.col("__before") + F.col("__c")) for e in ends]
    needed = holds[0]
    for h in holds[1:]:
        needed = needed | h
    counts = counts.withColumns({"__n": F.sum("__c").over(Window.partitionBy(*keys)), "__before": before(*keys)})
    chosen = held(counts.where(needed).select(*keys, "__n", "__before", "__c", "__lo", "__hi"))
    wide = F.col("__lo") < F.col("__hi")
    crowded = wide & (F.col("__c") > most)
    while True:
        many, several = chosen.agg(F.count_if(crowded), F.count_if(wide)).first()
        if not many:
            break
        met = _met(rows, chosen.where(crowded), keys, many)
        part = F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * max(slots, 2)), F.lit(max(slots, 2) - 1))
        bin_ = [*keys, "__n", "__first", "__from"]
        parts = met.withColumnsRenamed({"__before": "__first"}).withColumns({"__part": part, "__from": F.col("__lo")})
        parts = parts.groupBy(*bin_, "__part").agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        parts = parts.withColumn("__before", F.col("__first") + before(*keys, "__from")).where(needed)
        chosen = held(chosen.where(~crowded).unionByName(parts.select(*chosen.columns)))
    values = chosen.where(~wide).select(*keys, "__n", "__before", "__c", F.col("__lo").alias("__v"))
    if several:
        each = _met(rows, chosen.where(wide), keys, several).withColumnsRenamed({"__before": "__first", "__lo": "__from"})
        each = each.groupBy(*keys, "__n", "__first", "__from", F.col("__v").alias("__lo")).agg(F.count("*").alias("__c"))
        each = each.withColumn("__before", F.col("__first") + before(*keys, "__from"))
        values = values.unionByName(each.select(*keys, "__n", "__before", "__c", F.col("__lo").alias("__v")))
    out = values.groupBy(*keys, "__n").agg(*(F.max(F.when(h, F.col("__v"))).alias(f"__e{i}") for i, h in enumerate(holds)))
    made = []
    for i, (name, p) in enumerate(wanted.items()):
        low, high, x = F.col(f"__e{2 * i}"), F.col(f"__e{2 * i + 1}"), place(p)
        made.append(F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name))
    return out.select(*keys, *made)


def _met(rows: DataFrame, bins: DataFrame, keys: Sequence[str], many: int) -> DataFrame:
    """Each row with the bin that its value lies in; rows of no bin leave. Few bins are broadcast, more meet by key."""
    bins = bins.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__n", "__before", "__lo", "__hi")
    on = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(F.broadcast(bins) if many <= BROADCAST_ROWS else bins, on).drop(*(f"__k{i}" for i in range(len(keys))))


def _slim(df: DataFrame, calibrated: bool, more: Sequence[Column] = ()) -> DataFrame:
    """What metrics need of prepared rows; with confidences, which are read twice, it is kept."""
    if not calibrated:
        return df.select(*CELL, *more)
    return held(df.select(*CELL, "bin", *_MEANS, *more))


def _metrics(df: DataFrame, keys: Sequence[str], calibrated: bool) -> DataFrame:
    """All metrics of slim rows, a row for each value of the keys."""
    parts = cells(df, keys, calibrated)
    if not calibrated:
        return derived(summed(parts, keys, False), False)
    parts = held(parts)  # feeds the sums and the percentiles
    counts = parts.where("__lo is not null").groupBy(*keys, "__slot").agg(F.sum("n").alias("__c"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    rows = df.where(F.col("confidence").isNotNull() & ~F.isnan("confidence")).select(*keys, F.col("confidence").alias("__v"))
    p = _located(rows, counts.where(~F.isnan("__hi")).drop("__slot"), keys, {"confidence_p50": 0.5, "confidence_p90": 0.9})
    p = p.select(*(F.col(k).alias(f"__p_{k}") for k in keys), "confidence_p50", "confidence_p90")
    on = [F.col(k).eqNullSafe(F.col(f"__p_{k}")) for k in keys] or F.lit(True)  # without keys both sides are one row
    return derived(summed(parts, keys).join(p, on, "left").drop(*(f"__p_{k}" for k in keys)))


def _ratios(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, ratio)


def derived(sums: DataFrame, calibrated: bool = True) -> DataFrame:
    """All metrics from the sums; the cells and gaps leave.

    Precision, recall and F1 are arrays by label until the end: each is
    computed once, whatever uses it.
    """
    plus = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    kinds = (("c", SCORES, lambda k: f"score_{k}"), ("b", LABELS, str.lower))
    counted, rated, last, columns = {}, {}, {}, {}
    for x, domain, name in kinds:
        counted |= {f"__hit_{x}": F.array(*(F.col(f"{x}_{k}_{k}") for k in domain)), f"__pred_{x}": F.array(*(plus([f"{x}_{i}_{k}" for i in domain]) for k in domain)), f"__target_{x}": F.array(*(plus([f"{x}_{k}_{j}" for j in domain]) for k in domain))}
        rated |= {f"__precision_{x}": _ratios(F.col(f"__hit_{x}"), F.col(f"__pred_{x}")), f"__recall_{x}": _ratios(F.col(f"__hit_{x}"), F.col(f"__target_{x}"))}
        last[f"__f1_{x}"] = F.zip_with(f"__precision_{x}", f"__recall_{x}", lambda p, r: ratio(2 * p * r, p + r))
        for kind in ("precision", "recall", "f1"):
            columns |= {f"{kind}_{name(k)}": F.col(f"__{kind}_{x}")[i] for i, k in enumerate(domain)}
        columns |= {f"support_{name(k)}": F.col(f"__target_{x}")[i] for i, k in enumerate(domain)}
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    last |= {"ordinal_macro_f1": mean(F.col("__f1_c")), "binary_macro_f1": mean(F.col("__f1_b"))}
    wrong = {"false_positive_rate_correct": (f"b_{INCORRECT}_{CORRECT}", 0), "false_negative_rate_correct": (f"b_{CORRECT}_{INCORRECT}", 1)}
    columns |= {c: ratio(F.col(cell), F.col("__target_b")[i]) for c, (cell, i) in wrong.items()}
    for side in ("target", "pred"):
        counts = F.map_from_arrays(F.array(*(F.lit(str(k)) for k in SCORES)), F.col(f"__{side}_c"))
        columns[f"{side}_score_counts"] = F.to_json(F.map_filter(counts, lambda _, n: n > 0))
    if calibrated:
        gaps = F.array(*(F.abs(F.col(f"gap_{k}")) for k in range(BINS)))
        columns["expected_calibration_error_10bin"] = ratio(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g), F.col("num_examples"))
    gone = {f"c_{i}_{j}" for i in SCORES for j in SCORES} | {f"b_{a}_{b}" for a in LABELS for b in LABELS} | {f"gap_{k}" for k in range(BINS)}
    kept = [F.col(c) for c in sums.columns if c not in gone]
    df = sums.withColumns(counted).withColumns(rated)
    df = df.withColumns({k: v for k, v in last.items() if k.startswith("__")})
    return df.select(*kept, *(v.alias(k) for k, v in (columns | {k: v for k, v in last.items() if not k.startswith("__")}).items()))


def _calibrated(df: DataFrame) -> bool:
    return {"confidence", "score_margin", "score_entropy"} <= set(df.columns)


def all_metrics(df: DataFrame, threshold: int = 3, calibrated: bool | None = None) -> DataFrame:
    """One row of metrics over all rows, also over none; without calibration where that isn't asked for or its columns are missing."""
    df = prepared(df, threshold)
    calibrated = _calibrated(df) if calibrated is None else calibrated
    return _metrics(_slim(df, calibrated), [], calibrated)


def grouped_metrics(df: DataFrame, column: str, threshold: int = 3) -> DataFrame:
    """One row of metrics per value of a column; a null group stays. A missing column gives no rows."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"{column} string, num_examples bigint")
    df = prepared(df, threshold)
    return _metrics(_slim(df, _calibrated(df), [F.col(column).alias(f"group_{column}")]), [f"group_{column}"], _calibrated(df))


def metrics_by(df: DataFrame, columns: Sequence[str], threshold: int = 3) -> DataFrame:
    """Metrics for several groupings at once: dimension, value, metrics. Rows are made slim before they are counted once for each grouping."""
    df = prepared(df, threshold)
    calibrated = _calibrated(df)
    slim = _slim(df, calibrated, [F.col(c).cast("string").alias(f"__g_{c}") for c in columns])
    kept = [c for c in slim.columns if not c.startswith("__g_")]
    long = slim.unpivot(kept, [f"__g_{c}" for c in columns], "dimension", "value").withColumn("dimension", F.substring("dimension", 5, 1 << 30))
    return _metrics(long, ["dimension", "value"], calibrated)


def confusion(df: DataFrame, target: str, pred: str, labels: Sequence) -> DataFrame:
    """target x pred counts over fixed labels, absent ones as zeros; others are ignored."""
    kind = df.schema[target].dataType
    counts = df.where(F.col(target).isin(*labels)).groupBy(target).pivot(pred, list(labels)).agg(F.count(F.lit(1)))
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{target} {kind.simpleString()}")
    return every.join(counts, target, "left").na.fill(0).select(F.col(target).alias("target"), *(F.col(f"`{x}`").cast("long").alias(f"pred_{x}") for x in labels))


def ece_bins(df: DataFrame, threshold: int = 3) -> DataFrame:
    """bin, n, mean_confidence, accuracy."""
    out = prepared(df, threshold).groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(_hit().cast("double")).alias("accuracy"), F.max("bin").alias("__has"))
    return out.where("__has is not null").drop("__has")  # on an aggregate, so that the bin's expression isn't repeated below it


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "value")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def majority(train: DataFrame, column: str, order: str = "example_id"):
    """The commonest value, ties to the one seen first; no rows is an error."""
    top = train.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(1).collect()
    if not top:
        raise ValueError("the training split is empty")
    return top[0][column]


def majority_binary(train: DataFrame, eval_: DataFrame, threshold: int = 3, order: str = "example_id") -> DataFrame:
    labelled = train.withColumn("__y", F.when(F.col("target_score") >= threshold, CORRECT).otherwise(INCORRECT))
    label = majority(labelled, "__y", order)
    rows = eval_.withColumns({"pred_binary": F.lit(label), "pred_score": F.col("target_score")})
    m = derived(summed(cells(prepared(rows, threshold), [], False), [], False), False)
    keep = ["binary_accuracy", "binary_macro_f1", "false_positive_rate_correct", "false_negative_rate_correct", *(f"{k}_{x.lower()}" for x in LABELS for k in ("precision", "recall", "f1"))]
    return m.select(F.lit(label).alias("majority_class"), F.lit(train.count()).cast("long").alias("num_train"), F.col("num_examples").alias("num_eval"), *keep)


def majority_ordinal(train: DataFrame, eval_: DataFrame, order: str = "example_id") -> DataFrame:
    score = majority(train, "target_score", order)
    rows = eval_.withColumns({"pred_score": F.lit(score), "pred_binary": F.col("target_binary")})
    m = derived(summed(cells(prepared(rows), [], False), [], False), False)
    keep = ["ordinal_accuracy", "ordinal_mae", "within_1_accuracy", "ordinal_macro_f1", *(f"{k}_score_{s}" for s in SCORES for k in ("precision", "recall", "f1", "support"))]
    return m.select(F.lit(score).alias("majority_score"), F.lit(train.count()).cast("long").alias("num_train"), F.col("num_examples").alias("num_eval"), *keep)
