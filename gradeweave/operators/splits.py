"""Splits by model, held-out folds, and samples of exact size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.functions.scalar import sample_rank
from gradeweave.sources.tables import held

SPLITS = ("train", "validation", "test")


def models_of(df: DataFrame) -> list[str]:
    """Sorted distinct models: as many rows as there are models."""
    return [r[0] for r in df.select("model_id").dropna().distinct().orderBy("model_id").collect()]


def validate_disjoint(**sets: Sequence[str]) -> None:
    names = list(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if both := set(sets[a]) & set(sets[b]):
                raise ValueError(f"{a} and {b} share models: {sorted(both)}")


def fixed_split(df: DataFrame, validation: Sequence[str], test: Sequence[str] = (), train: Sequence[str] | str = "auto_except_val_test", known: Sequence[str] | None = None) -> DataFrame:
    """Add ``split`` by model; rows of no split leave. One expression, no shuffle."""
    known = models_of(df) if known is None else known
    if not validation:
        raise ValueError("validation models must be given")
    if isinstance(train, str):
        train = [m for m in known if m not in {*validation, *test}]
    if unknown := {*train, *validation, *test} - set(known):
        raise ValueError(f"unknown models: {sorted(unknown)}")
    validate_disjoint(train=train, validation=validation, test=test)
    m = F.col("model_id")
    # none named: an empty list is false
    inside = lambda names: m.isin(list(names)) if names else F.lit(False)
    split = F.when(inside(validation), "validation").when(inside(test), "test").when(inside(train), "train")
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def validation_size(pool: int, fraction: float = 0.05, most: int | None = None) -> int:
    n = max(1, round(pool * fraction))
    n = n if most is None else min(n, most)
    return min(n, max(1, pool - 1))


def held_out_split(df: DataFrame, model: str, fraction: float = 0.05, most: int | None = None, seed: int = 42, key: str = "example_id") -> DataFrame:
    """Add ``split``: the model's rows are the test, a sample of exact size of the others validates. One expression, no join."""
    pool = ~F.col("model_id").eqNullSafe(F.lit(model))
    n = df.where(pool).count()
    if n == 0 or df.where(~pool).limit(1).count() == 0:
        raise ValueError(f"nothing to train on, or no rows of {model}")
    inside = _up_to(cut(df.where(pool), validation_size(n, fraction, most), seed, key), seed, key)
    return df.withColumn("split", F.when(~pool, "test").when(inside, "validation").otherwise("train"))


def fold_cuts(df: DataFrame, fraction: float = 0.05, most: int | None = None, seed: int = 42, key: str = "example_id") -> DataFrame:
    """For every model held out: model_id, test, pool, validation, and rank and key of the last row of its validation sample.

    What ``held_out_split`` finds for one model, for all in one plan: counts by
    model and prefix of the hash give, for each model, the rows of the others
    before a prefix; the prefix at which they reach the sample's size holds its
    last row, and only rows of such prefixes are put in order.
    """
    rank = sample_rank(F.col(key), seed)
    rows = df.select("model_id", rank.alias("rank"), F.col(key).alias("key")).withColumn("p", F.conv(F.substring("rank", 1, PREFIX), 16, 10).cast("int"))
    counts = held(rows.groupBy("model_id", "p").agg(F.count("*").alias("own")))
    sizes = all_folds_report(counts, fraction, most, F.sum("own")).where("pool > 0").select("model_id", "test", "pool", "validation")
    upto = lambda *by: Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = counts.groupBy("p").agg(F.sum("own").alias("all")).withColumn("upto_all", F.sum("all").over(upto()))  # 65,536 rows at most
    grid = sizes.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(16**PREFIX - 1)))).join(every.select("p", "all", "upto_all"), "p").join(counts, ["model_id", "p"], "left")
    grid = grid.withColumn("others", F.col("upto_all") - F.sum(F.coalesce("own", F.lit(0))).over(upto("model_id")))
    before = F.col("others") - (F.col("all") - F.coalesce("own", F.lit(0)))
    at = grid.where((F.col("others") >= F.col("validation")) & (before < F.col("validation"))).select(F.col("model_id").alias("fold"), "test", "pool", "validation", F.col("p").alias("q"), (F.col("validation") - before).alias("wanted"))
    met = rows.join(at, (F.col("p") == F.col("q")) & ~F.col("model_id").eqNullSafe(F.col("fold")))
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy("rank", "key")))
    return placed.where("place = wanted").select(F.col("fold").alias("model_id"), "test", "pool", "validation", "rank", "key")


def fold_of(df: DataFrame, model: str, last, seed: int = 42, key: str = "example_id") -> DataFrame:
    """Add ``split`` of one fold: an expression over rows that all folds share."""
    inside = _up_to(last, seed, key)
    return df.withColumn("split", F.when(F.col("model_id").eqNullSafe(F.lit(model)), "test").when(inside, "validation").otherwise("train"))


def fold_counts(df: DataFrame, cuts: Sequence, seed: int = 42, key: str = "example_id") -> DataFrame:
    """(fold, model_id, train, validation) rows of each other model in each fold of ``fold_cuts``; one pass.

    A row counts once, by its model and how many of the sorted cuts stand
    before it.
    """
    order = sorted(cuts, key=lambda c: (c.rank, c.key))
    kind = df.schema[key].dataType
    marks = F.array(*(F.struct(F.lit(c.rank).alias("r"), F.lit(c.key).cast(kind).alias("k")) for c in order))
    me = F.struct(sample_rank(F.col(key), seed).alias("r"), F.col(key).alias("k"))
    counts = df.select("model_id", F.size(F.filter(marks, lambda m: m < me)).alias("past")).groupBy("model_id", "past").agg(F.count("*").alias("n"))
    folds = F.array(*(F.struct(F.lit(c.model_id).alias("fold"), F.lit(i).alias("at")) for i, c in enumerate(order)))
    each = counts.select("model_id", "past", "n", F.inline(folds)).where(~F.col("model_id").eqNullSafe(F.col("fold")))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("fold", "model_id").agg(n(F.col("past") > F.col("at")).alias("train"), n(F.col("past") <= F.col("at")).alias("validation"))


#: Characters of the hash by which rows are counted before any is put in order.
PREFIX = 4


def cut(df: DataFrame, n: int, seed: int = 42, key: str = "example_id"):
    """(rank, key) of the n-th row in sampling order; none if there are fewer.

    Counts by the hash's first characters (65,536 at most) say where it lies;
    only the rows of that one prefix are put in order. Keys are unique.
    """
    rank = sample_rank(F.col(key), seed)
    rows = df.select(rank.alias("rank"), F.col(key).alias("key"))
    counts = rows.groupBy(F.substring("rank", 1, PREFIX).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    left = n
    for r in counts:
        if left <= r.n:
            return rows.where(F.col("rank").startswith(r.p)).orderBy("rank", "key").offset(left - 1).limit(1).first()
        left -= r.n
    return None


def _up_to(last, seed: int, key: str):
    """Whether a row stands at the cut or before it."""
    if last is None:
        return F.lit(True)
    rank = sample_rank(F.col(key), seed)
    return (rank < last.rank) | ((rank == last.rank) & (F.col(key) <= F.lit(last.key)))


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "example_id") -> DataFrame:
    """n rows, always the same: those up to a cut of the order by hash, which no task has to sort."""
    return df.limit(0) if n <= 0 else df.where(_up_to(cut(df, n, seed, key), seed, key))


def leakage(df: DataFrame) -> DataFrame:
    """Models in more than one split."""
    return df.groupBy("model_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def validate_no_leakage(df: DataFrame) -> None:
    found = [r.model_id for r in leakage(df).limit(20).collect()]
    if found:
        raise ValueError(f"models in several splits: {sorted(map(str, found))}")


def validate_held_out(df: DataFrame, model: str) -> None:
    is_ = F.col("model_id").eqNullSafe(F.lit(model))
    wrong = df.where(is_ != (F.col("split") == "test")).limit(1).count()
    if wrong:
        raise ValueError(f"{model} must be in the test and alone there")


def split_report(df: DataFrame, names: Sequence[str] = SPLITS) -> DataFrame:
    """split, examples, models (JSON), num_models; empty splits too."""
    have = df.groupBy("split").agg(F.count("*").alias("examples"), F.sort_array(F.collect_set("model_id")).alias("m"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "split string")
    out = every.join(have, "split", "left")
    m = F.coalesce("m", F.array().cast("array<string>"))
    return out.select("split", F.coalesce("examples", F.lit(0)).alias("examples"), F.to_json(m).alias("models"), F.size(m).alias("num_models"))


def finalist_union(df: DataFrame) -> DataFrame:
    """All splits' rows as training rows; none at all is an error."""
    out = df.where(F.col("split").isin(*SPLITS))
    if out.limit(1).count() == 0:
        raise ValueError("no rows in any split")
    return out


def all_folds_report(df: DataFrame, fraction: float = 0.05, most: int | None = None, count: Column | None = None) -> DataFrame:
    """Per held-out model, rows of each split of its fold: one aggregate for all folds. ``count`` sums rows that are counts themselves."""
    counts = df.groupBy("model_id").agg((F.count("*") if count is None else count).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row a model
    pool = F.col("all") - F.col("n")
    wanted = F.greatest(F.lit(1.0), F.bround(pool * F.lit(float(fraction)), 0))
    wanted = wanted if most is None else F.least(wanted, F.lit(float(most)))
    val = F.least(wanted, F.greatest(F.lit(1.0), (pool - 1).cast("double"))).cast("long")
    out = counts.withColumn("all", total).where("model_id is not null").select("model_id", pool.alias("pool"), val.alias("validation"), F.col("n").alias("test"))
    return out.withColumn("train", F.col("pool") - F.col("validation"))


def stratified_quotas(df: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """The strata with size and quota: floors of the ideal shares of ``k``, one at least, then repaired to ``k`` where that can be.

    Too few are mended by one more for the strata that stand furthest below
    their ideal: fewer than there are strata with a fraction. Too many, as
    small strata were raised to one, are mended by rounds of one less for all
    that have more than one; how many whole rounds fit is searched by sums over
    the strata, and in the last one those furthest above their ideal come
    first. Ties go by the columns, nulls last. Strata meet in one task for a
    rank, as a row each; none goes through the driver.
    """
    strata = held(df.groupBy(*columns).agg(F.count("*").alias("size")))
    total = strata.agg(F.sum("size")).first()[0] or 0
    if not total:
        return strata.withColumn("quota", F.lit(0).cast("long"))
    ideal = F.col("size") / F.lit(float(total)) * F.lit(float(k))
    strata = strata.withColumn("__ideal", ideal).withColumn("__draw", F.least("size", F.greatest(F.floor("__ideal"), F.lit(1))))
    drawn = strata.agg(F.sum("__draw")).first()[0]
    rounds, left = 0, k - drawn
    if drawn > k:
        rounds, left = _whole_rounds(strata, drawn - k)
    draw = F.greatest(F.lit(1), F.col("__draw") - rounds) if drawn > k else F.col("__draw")
    strata = strata.withColumn("__draw", draw)
    more = drawn <= k
    may = (F.col("__draw") < F.col("size")) if more else (F.col("__draw") > 1)
    gap = (F.col("__ideal") - F.col("__draw")) * (1 if more else -1)
    first = Window.partitionBy("__may").orderBy(F.desc("__gap"), *(F.col(c).asc_nulls_last() for c in columns))
    ranked = strata.withColumns({"__may": may, "__gap": gap}).withColumn("__at", F.row_number().over(first))
    step = F.when(F.col("__may") & (F.col("__at") <= left), 1 if more else -1).otherwise(0)
    return ranked.select(*columns, "size", (F.col("__draw") + step).cast("long").alias("quota"))


def _whole_rounds(strata: DataFrame, excess: int) -> tuple[int, int]:
    """Most rounds of one less for every stratum that has more than one, within ``excess``, and what is left of it; no rest where none can give more."""
    spare = F.col("__draw") - 1
    most, every = strata.agg(F.max(spare), F.sum(spare)).first()
    if every <= excess:
        return most, 0
    low, high, taken = 0, most, 0  # low rounds fit, high ones don't
    while high - low > 1:
        marks = sorted({low + (high - low) * i // 33 for i in range(1, 33)} - {low, high})
        sums = strata.agg(*(F.sum(F.least(spare, F.lit(m))) for m in marks)).first()
        fits = [(m, x) for m, x in zip(marks, sums) if x <= excess]
        low, taken = fits[-1] if fits else (low, taken)
        high = min([m for m, x in zip(marks, sums) if x > excess], default=high)
    return low, excess - taken


def stratified_subset(df: DataFrame, k: int, columns: Sequence[str], seed: int = 42, key: str = "example_id") -> DataFrame:
    """Rows by stratum quota, in a reproducible order; a null is a stratum like others."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return sample(df, k, seed, key)
    q = stratified_quotas(df, k, have).drop("size")
    for c in have:
        q = q.withColumnRenamed(c, f"__{c}")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in have]
    joined = df.join(q, on).withColumn("__rank", sample_rank(F.col(key), seed)).withColumn("__p", F.substring("__rank", 1, 3))
    # counts by stratum and prefix say which prefix holds the last row; only that one is put in order
    counts = joined.groupBy(*have, "quota", "__p").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*have).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).where(F.col("__before") < F.col("quota"))
    need = counts.select(*(F.col(c).alias(f"__s_{c}") for c in have), F.col("__p").alias("__s_p"), F.least("__c", F.col("quota") - F.col("__before")).alias("__need"), (F.col("__before") + F.col("__c") > F.col("quota")).alias("__edge"))
    on = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in have] + [F.col("__p") == F.col("__s_p")]
    found = joined.join(need, on)
    place = F.row_number().over(Window.partitionBy(*have, "__p").orderBy("__rank", key))
    edge = found.where("__edge").withColumn("__place", place).where(F.col("__place") <= F.col("__need"))
    return found.where("not __edge").select(*df.columns).unionByName(edge.select(*df.columns))


def eval_subset(df: DataFrame, k: int | None, strategy: str = "stratified", columns: Sequence[str] = ("model_id", "target_score"), seed: int = 42, key: str = "example_id") -> DataFrame:
    if not k or k <= 0 or k >= df.count():
        return df
    return stratified_subset(df, k, columns, seed, key) if strategy == "stratified" else sample(df, k, seed, key)
