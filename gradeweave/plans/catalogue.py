"""The queries and, for each, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.functions.scalar import IGNORED_LABEL, length_bucket
from gradeweave.operators import batches, filters, metrics, packs, scoring, splits, tokens, training
from gradeweave.operators.filters import DISTRIBUTION_COLUMNS
from gradeweave.plans import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- common parts of the SQL

_CLEAN = "case when {0} is null or {0} = '' or lower({0}) = 'nan' then '{1}' else {0} end"
_Q, _R, _M = (_CLEAN.format(c, fb) for c, fb in (("question", "N/A"), ("reference_answer", "N/A"), ("response", "")))
_RS = """
rs as (
  select d.doc_id as example_id, d.source as model_id, 'b' || (d.doc_id % 4) as benchmark, d.lang as task,
    q.text as question, r.text as reference_answer, d.text as response,
    cast(1 + (d.doc_id * 7 + d.n_chars) % 5 as double) as judge_1_score,
    cast(greatest(1, least(5, 1 + (d.doc_id * 7 + d.n_chars) % 5 + d.n_chars % 4 - 1)) as double) as judge_2_score
  from documents d join benchmark q on q.item_id = d.doc_id % 40 join benchmark r on r.item_id = (d.doc_id * 7 + 3) % 40
), t as (
  select *, abs(judge_1_score - judge_2_score) as disagreement, (judge_1_score + judge_2_score) / 2 as mean_score,
    cast(floor((judge_1_score + judge_2_score) / 2) as integer) as target_score,
    case when floor((judge_1_score + judge_2_score) / 2) >= 3 then 'CORRECT' else 'INCORRECT' end as target_binary
  from rs
), prompts as (
  select *, '<|system|>' || chr(10) || 'Return one score.' || chr(10) || '<|user|>' || chr(10) || '### QUESTION' || chr(10) || """ + _Q + """
    || chr(10) || chr(10) || '### REFERENCE ANSWER' || chr(10) || """ + _R + """ || chr(10) || chr(10) || '### MODEL RESPONSE' || chr(10) || """ + _M + """
    || chr(10) || chr(10) || '### SCORE' || chr(10) || chr(10) || '<|assistant|>' || chr(10) as prompt,
    cast(length(""" + _M + """) as bigint) as response_token_length
  from t
), m as (
  select *, cast(length(prompt) as bigint) as prompt_token_length, cast(1 as bigint) as target_token_length, cast(length(prompt) + 2 as bigint) as sequence_length,
    case when not disagreement <= 1 then 0 when not response_token_length <= 4096 then 1 when not length(prompt) + 2 <= 3072 then 2 else 3 end as stage
  from prompts
), k as (select * from m where stage = 3),
sp as (
  select *, case when model_id in ('src3', 'src7', 'src11') then 'validation' when model_id in ('src5', 'src13') then 'test' else 'train' end as split from k
)
"""  # noqa: E501
RS = "with recursive " + _RS
_LOGIT = ", ".join(f"cast((l_partkey * {k} + l_suppkey * {k + 3} + l_linenumber * 7) % 97 as double) / 10 as logit_{k}" for k in range(1, 6))
_TOP = "greatest(logit_1, logit_2, logit_3, logit_4, logit_5)"
_EXP = " + ".join(f"exp(logit_{k} - top)" for k in range(1, 6))
_ENT = " + ".join(f"prob_{k} * ln(least(greatest(prob_{k}, 1e-12), 1e0))" for k in range(1, 6))
_PRED = "case " + " ".join(f"when logit_{k} = top then {k}" for k in range(1, 6)) + " end"
PR = f"""with l as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, 'm' || (l_suppkey % 12) as model_id, l_returnflag as benchmark, l_linestatus || l_linenumber as task,
    cast(ceil(l_quantity / 10e0) as integer) as target_score, cast(floor(l_extendedprice) as bigint) % 5000 as response_token_length, {_LOGIT}
  from lineitem
), l1 as (select *, {_TOP} as top from l),
l2 as (select *, {_EXP} as z, {_PRED} as pred_score from l1),
l3 as (select *, {", ".join(f"exp(logit_{k} - top) / z as prob_{k}" for k in range(1, 6))} from l2),
p as (
  select *, case when target_score >= 3 then 'CORRECT' else 'INCORRECT' end as target_binary, case when pred_score >= 3 then 'CORRECT' else 'INCORRECT' end as pred_binary,
    list_sort([logit_1, logit_2, logit_3, logit_4, logit_5], 'DESC')[1] - list_sort([logit_1, logit_2, logit_3, logit_4, logit_5], 'DESC')[2] as score_margin,
    -({_ENT}) as score_entropy, greatest(prob_1, prob_2, prob_3, prob_4, prob_5) as confidence,
    case when response_token_length < 500 then '0-500' when response_token_length < 1000 then '500-1000' when response_token_length < 2000 then '1000-2000'
      when response_token_length < 4096 then '2000-4096' else 'nan' end as response_length_bucket
  from l3
)
"""
_EDGES = [repr(e) for e in metrics.EDGES]
_BIN = "case " + " ".join(f"when confidence >= {a}{'e0' if 'e' not in a else ''} and confidence {'<=' if i == 9 else '<'} {b}{'e0' if 'e' not in b else ''} then {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " end"
_DIV = "case when {1} = 0 then 0e0 else cast({0} as double) / ({1}) end"


def _n(cond: str) -> str:
    return f"count(*) filter (where {cond})"


def _prf_sql(target: str, pred: str, value: str) -> tuple[str, str, str, str]:
    hit, p, s = _n(f"{target} = {value} and {pred} = {value}"), _n(f"{pred} = {value} and {target} in ({_dom(target)})"), _n(f"{target} = {value}")
    prec, rec = _DIV.format(hit, p), _DIV.format(hit, s)
    return prec, rec, _DIV.format(f"2 * ({prec}) * ({rec})", f"({prec}) + ({rec})"), s


def _dom(target: str) -> str:
    return "1, 2, 3, 4, 5" if target == "target_score" else "'CORRECT', 'INCORRECT'"


ORDINAL = ["ordinal_accuracy", "ordinal_mae", "within_1_accuracy", "ordinal_macro_f1"]
BINARY = ["binary_accuracy", "binary_macro_f1", "false_positive_rate_correct", "false_negative_rate_correct", *(f"{k}_{x}" for x in ("incorrect", "correct") for k in ("precision", "recall", "f1", "support"))]
CALIBRATION = ["confidence_mean", "confidence_p50", "confidence_p90", "expected_calibration_error_10bin", "score_margin_mean", "score_entropy_mean"]
PER_SCORE = [f"{k}_score_{s}" for s in range(1, 6) for k in ("precision", "recall", "f1", "support")]
EVERY = ["num_examples", *ORDINAL, *BINARY, *CALIBRATION, *PER_SCORE]


def _metric_sql() -> dict[str, str]:
    score = {s: _prf_sql("target_score", "pred_score", str(s)) for s in range(1, 6)}
    label = {x: _prf_sql("target_binary", "pred_binary", f"'{x}'") for x in ("INCORRECT", "CORRECT")}
    fp, fn = _n("target_binary = 'INCORRECT' and pred_binary = 'CORRECT'"), _n("target_binary = 'CORRECT' and pred_binary = 'INCORRECT'")
    gap = "cast(sum({0}) filter (where " + _BIN + " = {1}) as double)"
    ece = " + ".join(f"abs(coalesce({gap.format('confidence', i)}, 0) - coalesce({gap.format('cast(target_score = pred_score as integer)', i)}, 0))" for i in range(10))
    out = {
        "num_examples": "count(*)", "ordinal_accuracy": "avg(cast(target_score = pred_score as integer))", "ordinal_mae": "avg(abs(target_score - pred_score))",
        "within_1_accuracy": "avg(cast(abs(target_score - pred_score) <= 1 as integer))", "ordinal_macro_f1": "(" + " + ".join(f"({v[2]})" for v in score.values()) + ") / 5",
        "binary_accuracy": "avg(cast(target_binary = pred_binary as integer))", "binary_macro_f1": "(" + " + ".join(f"({v[2]})" for v in label.values()) + ") / 2",
        "false_positive_rate_correct": _DIV.format(fp, label["INCORRECT"][3]), "false_negative_rate_correct": _DIV.format(fn, label["CORRECT"][3]),
        "confidence_mean": "avg(confidence)", "confidence_p50": "quantile_cont(confidence, 0.5)", "confidence_p90": "quantile_cont(confidence, 0.9)",
        "expected_calibration_error_10bin": f"({ece}) / count(*)", "score_margin_mean": "avg(score_margin)", "score_entropy_mean": "avg(score_entropy)",
    }
    for s, v in score.items():
        out |= {f"{k}_score_{s}": x for k, x in zip(("precision", "recall", "f1", "support"), v)}
    for x, v in label.items():
        out |= {f"{k}_{x.lower()}": e for k, e in zip(("precision", "recall", "f1", "support"), v)}
    return out


METRIC_SQL = _metric_sql()


def _counted(name: str) -> bool:
    return name == "num_examples" or name.startswith("support")


def _pick(names) -> str:
    return ", ".join(f"cast({METRIC_SQL[n]} as bigint) as {n}" if _counted(n) else f"round({METRIC_SQL[n]}, 9) as {n}" for n in names)


def _rounded(df: DataFrame, names, *keys) -> DataFrame:
    return df.select(*keys, *(F.col(n).cast("long").alias(n) if _counted(n) else F.round(n, 9).alias(n) for n in names))


# --- sources, targets, lengths, filters

_ID = "example_id"


@query(RS + "select example_id, model_id, benchmark, task, md5(question) as question_md5, md5(reference_answer) as reference_md5, md5(response) as response_md5, judge_1_score, judge_2_score, cast(null as varchar) as source from rs")
def canonical_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.operators.targets import canonicalise

    c = canonicalise(V.raw_scores(spark, sf_dir), V.COLUMNS)
    return c.select(_ID, "model_id", "benchmark", "task", F.md5("question").alias("question_md5"), F.md5("reference_answer").alias("reference_md5"), F.md5("response").alias("response_md5"), "judge_1_score", "judge_2_score", "source")


@query(RS + "select example_id, disagreement, mean_score, target_score, target_binary from t")
def targets(spark, sf_dir):
    return V.targeted(spark, sf_dir).select(_ID, "disagreement", "mean_score", "target_score", "target_binary")


@query(RS + "select cast(count(*) filter (where judge_1_score not between 1 and 5) as bigint) as judge_1_score, cast(count(*) filter (where judge_2_score not between 1 and 5) as bigint) as judge_2_score from rs")
def score_violations(spark, sf_dir):
    from gradeweave.operators.targets import score_violations as check

    found = check(V.targeted(spark, sf_dir))
    return spark.createDataFrame([(found["judge_1_score"], found["judge_2_score"])], "judge_1_score bigint, judge_2_score bigint")


@query(RS + "select example_id, model_id, disagreement, target_score from t where disagreement <= 1")
def disagreement_filter(spark, sf_dir):
    return filters.apply_filters(V.targeted(spark, sf_dir), 1, None).select(_ID, "model_id", "disagreement", "target_score")


@query(RS + "select example_id, response_token_length from m")
def response_length(spark, sf_dir):
    return tokens.with_response_lengths(V.targeted(spark, sf_dir)).select(_ID, "response_token_length")


@query(RS + "select example_id, response_token_length, target_score from m where stage >= 2")
def response_length_filter(spark, sf_dir):
    return filters.apply_filters(tokens.with_response_lengths(V.targeted(spark, sf_dir)), 1, 4096).select(_ID, "response_token_length", "target_score")


@query(RS + "select example_id, md5(prompt) as prompt_md5 from prompts")
def prompt_text_md5(spark, sf_dir):
    return V.targeted(spark, sf_dir).select(_ID, F.md5(tokens.prompt_col(V.SYSTEM_PROMPT)).alias("prompt_md5"))


@query(RS + "select example_id, prompt_token_length, target_token_length, sequence_length from m")
def sequence_lengths(spark, sf_dir):
    return V.measured(spark, sf_dir).select(_ID, "prompt_token_length", "target_token_length", "sequence_length")


@query(RS + "select example_id, sequence_length, target_score, model_id from k")
def sequence_filter(spark, sf_dir):
    return V.kept(spark, sf_dir).select(_ID, "sequence_length", "target_score", "model_id")


_STEPS = (("raw", "after_disagreement", "disagreement"), ("after_disagreement", "after_response_length", "response_length"), ("after_response_length", "after_sequence_length", "sequence_length"))


@query(RS + ", n as (select count(*) as raw, count(*) filter (where stage >= 1) as after_disagreement, count(*) filter (where stage >= 2) as after_response_length, count(*) filter (where stage >= 3) as after_sequence_length from m) select raw, after_disagreement, after_response_length, after_sequence_length, "
       + ", ".join(f"{b} - {a} as removed_by_{n}, round({_DIV.format(f'({b} - {a})', b)} * 100, 6) as removed_by_{n}_pct" for b, a, n in _STEPS) + " from n")
def filter_funnel(spark, sf_dir):
    return filters.funnel(V.measured(spark, sf_dir), 1, 4096, 3072)


def _long(source: str, extra: str = "") -> str:
    return " union all ".join(f"select {extra}'{c}' as \"column\", cast({c} as varchar) as value from {source}" for c in DISTRIBUTION_COLUMNS)


@query(RS + ", s(k, stage_name) as (values (0, 'raw'), (1, 'after_disagreement'), (2, 'after_response_length'), (3, 'after_sequence_length')), x as (" + _long("m", "stage as st, ") + ") select stage_name as stage, \"column\", value, count(*) as n from x join s on st >= k group by all")
def stage_distributions(spark, sf_dir):
    return filters.stage_distributions(V.measured(spark, sf_dir), 1, 4096, 3072)


@query(RS + ", x as (" + _long("k") + "), c as (select \"column\", value, count(*) as n from x group by all), r as (select *, row_number() over (partition by \"column\" order by n desc, value asc nulls first) as place, count(*) over (partition by \"column\") as kinds from c) select \"column\", value, n, kinds > 100 as truncated from r where place <= 100")
def distribution_summary(spark, sf_dir):
    return filters.distributions(V.kept(spark, sf_dir))


@query(RS + " union all ".join(
    f"select '{c}' as name, (select count(*) from k) as num_examples, min({c}) as min, max({c}) as max, round(avg({c}), 6) as mean, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) as p{round(p * 100)}" for p in filters.PERCENTILES) + " from k"
    for c in filters.LENGTH_COLUMNS))
def length_stats(spark, sf_dir):
    return filters.length_statistics(V.kept(spark, sf_dir))


@query(RS + "select case when response_token_length < 500 then '0-500' when response_token_length < 1000 then '500-1000' when response_token_length < 2000 then '1000-2000' when response_token_length < 4096 then '2000-4096' else 'nan' end as bucket, count(*) as n from m group by 1")
def length_buckets(spark, sf_dir):
    m = V.measured(spark, sf_dir)
    return m.groupBy(length_bucket(F.col("response_token_length"), V.BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


@query(RS + "select 'max_response_tokens 4096 is not below max_seq_length 3072' as warning, count(*) filter (where response_token_length between 3072 and 4096) as rows from m union all select 'prompt budget -1024 is below 1024 tokens', count(*) filter (where response_token_length <= 4096 and prompt_token_length - response_token_length > -1024) from m")
def length_warnings(spark, sf_dir):
    return filters.warned_rows(V.measured(spark, sf_dir), 3072, 4096)


# --- splits and samples

@query(RS + "select example_id, model_id, split from sp")
def split_fixed(spark, sf_dir):
    return splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST).select(_ID, "model_id", "split")


@query(RS + ", n(split) as (values ('train'), ('validation'), ('test')), g as (select split, count(*) as examples, '[' || string_agg(distinct '\"' || model_id || '\"', ',' order by '\"' || model_id || '\"') || ']' as models, cast(count(distinct model_id) as integer) as num_models from sp group by split) select n.split, coalesce(examples, 0) as examples, coalesce(models, '[]') as models, coalesce(num_models, 0) as num_models from n left join g on n.split = g.split")
def split_report(spark, sf_dir):
    return splits.split_report(splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST))


@query(RS + "select split, count(*) as examples from sp group by split")
def split_counts(spark, sf_dir):
    return splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST).groupBy("split").agg(F.count("*").alias("examples"))


@query(RS + "select model_id, count(distinct split) as splits from sp group by model_id having count(distinct split) > 1")
def split_leakage_check(spark, sf_dir):
    return splits.leakage(splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST))


@query(RS + "select distinct model_id from k where model_id is not null")
def lomo_models(spark, sf_dir):
    return V.kept(spark, sf_dir).select("model_id").dropna().distinct()


def _ranked(source: str, where: str, partition: str = "") -> str:
    return f"select *, row_number() over ({partition} order by md5('42:' || example_id), example_id) as place from {source} where {where}"


@query(RS + ", pool as (" + _ranked("k", "model_id is distinct from 'src3'") + "), v as (select greatest(1, cast(round_even(count(*) * 0.05, 0) as bigint)) as n from pool) select example_id, case when place <= v.n then 'validation' else 'train' end as split from pool, v union all select example_id, 'test' from k where model_id = 'src3'")
def lomo_split(spark, sf_dir):
    return splits.held_out_split(V.kept(spark, sf_dir), "src3").select(_ID, "split")


@query(RS + ", c as (select model_id, count(*) as n from k group by model_id), a as (select sum(n) as total from c), f as (select model_id, cast(total - n as bigint) as pool, n as test from c, a where model_id is not null), v as (select *, cast(least(greatest(1, round_even(pool * 0.05, 0)), greatest(1, pool - 1)) as bigint) as validation from f) select model_id, pool, validation, test, pool - validation as train from v")
def lomo_all_folds_report(spark, sf_dir):
    return splits.all_folds_report(V.kept(spark, sf_dir))


@query(RS + "select example_id from (" + _ranked("k", "true") + ") where place <= 100")
def random_eval_subset(spark, sf_dir):
    return splits.eval_subset(V.kept(spark, sf_dir), 100, "random").select(_ID)


_TRAIN = "(select * from sp where split = 'train')"


def _train(spark, sf_dir):
    return splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST).where("split = 'train'")


# Floors miss k by fewer rows than there are strata, so the repair touches each stratum once at most: a rank says which.
_QUOTA = """, st as (select model_id, target_score, count(*) as n from sp where split = 'train' group by all),
sq as (select *, n / sum(n) over () * 200 as ideal, row_number() over (order by model_id nulls last, target_score nulls last) as k from st),
sd as (select *, least(n, greatest(cast(floor(ideal) as bigint), 1)) as draw from sq),
so as (select *, sum(draw) over () - 200 as over, row_number() over (partition by draw > 1 order by draw - ideal desc, k) as down, row_number() over (partition by draw < n order by ideal - draw desc, k) as up from sd),
qt as (select model_id, target_score, n as size, cast(draw - case when over > 0 and draw > 1 and down <= over then 1 else 0 end + case when over < 0 and draw < n and up <= -over then 1 else 0 end as bigint) as quota from so)
"""


@query(RS + _QUOTA + "select * from qt")
def stratified_quota(spark, sf_dir):
    return splits.stratified_quotas(_train(spark, sf_dir), 200, ["model_id", "target_score"])


# As many rows asked for as there are: every floor is exact and every row is drawn.
@query(RS + "select example_id, model_id, target_score from sp where split = 'train'")
def stratified_all(spark, sf_dir):
    t = _train(spark, sf_dir)
    return splits.stratified_subset(t, t.count(), ["model_id", "target_score"]).select(_ID, "model_id", "target_score")


@query(RS + _QUOTA + """, rk as (select *, row_number() over (partition by model_id, target_score order by md5('42:' || example_id), example_id) as place from sp where split = 'train')
select r.example_id, r.model_id, r.target_score from rk r join qt q on r.model_id is not distinct from q.model_id and r.target_score is not distinct from q.target_score where r.place <= q.quota""")
def stratified_eval_subset(spark, sf_dir):
    return splits.eval_subset(_train(spark, sf_dir), 200).select(_ID, "model_id", "target_score")


@query(RS + "select example_id, split from sp")
def finalist_union(spark, sf_dir):
    return splits.finalist_union(splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST)).select(_ID, "split")


@query(RS + ", d(target_score) as (values (1), (2), (3), (4), (5)), c as (select target_score, count(*) as n from sp where split = 'train' group by target_score), a as (select sum(n) as total from c) select d.target_score, coalesce(c.n, 0) as n, round(case when coalesce(c.n, 0) = 0 then 0e0 else cast(total as double) / (5 * c.n) end, 6) as weight from d left join c on c.target_score = d.target_score, a")
def class_weights(spark, sf_dir):
    w = training.inverse_frequency_weights(_train(spark, sf_dir))
    return w.select("target_score", "n", F.round("weight", 6).alias("weight"))


# --- training rows

_IDS = "list_transform(regexp_extract_all(prompt, '(?s).'), lambda c: ord(c))"


@query(RS + f"select example_id, cast(sequence_length as integer) as length, cast(prompt_token_length as integer) as prompt_length, target_score, md5(array_to_string({_IDS}, ',') || ',' || (48 + target_score) || ',0') as ids_md5, cast(48 + target_score as bigint) as supervised from k")
def tokenized_rows(spark, sf_dir):
    rows = tokens.token_rows(V.kept(spark, sf_dir), V.SYSTEM_PROMPT)
    shown = F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ",")
    supervised = F.aggregate(F.filter("labels", lambda x: x != IGNORED_LABEL), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(_ID, "length", "prompt_length", "target_score", F.md5(shown).alias("ids_md5"), supervised.alias("supervised"))


@query(RS + "select example_id, cast(prompt_token_length as integer) as length, cast(target_score - 1 as integer) as labels from k")
def classification_rows(spark, sf_dir):
    return tokens.token_rows(V.kept(spark, sf_dir), V.SYSTEM_PROMPT, "sequence_classification").select(_ID, "length", "labels")


@query(RS + f", f as (select * from k order by example_id limit 5), e as (select example_id, unnest({_IDS} || [48 + target_score, 0]) as token_id, generate_subscripts({_IDS} || [48 + target_score, 0], 1) - 1 as position, target_score, prompt_token_length from f) select example_id, cast(position as integer) as position, cast(token_id as integer) as token_id, position = prompt_token_length as supervised, case when position = prompt_token_length then cast(token_id as integer) else -100 end as label_id from e")
def token_debug(spark, sf_dir):
    first = V.kept(spark, sf_dir).orderBy(_ID).limit(5)
    return tokens.token_debug(tokens.token_rows(first, V.SYSTEM_PROMPT))


_PACK = """, o as (select example_id, sequence_length as len, row_number() over (order by example_id) as rn from k),
pk(rn, pack_id, used) as (
  select rn, cast(0 as bigint), len from o where rn = 1
  union all
  select o.rn, case when pk.used + o.len > 3072 then pk.pack_id + 1 else pk.pack_id end, case when pk.used + o.len > 3072 then o.len else pk.used + o.len end
  from pk join o on o.rn = pk.rn + 1
)
"""


def _tokenised(spark, sf_dir):
    return tokens.token_rows(V.kept(spark, sf_dir), V.SYSTEM_PROMPT)


@query(RS + _PACK + "select o.example_id, pk.pack_id from pk join o on o.rn = pk.rn")
def pack_assignment(spark, sf_dir):
    rows = V.kept(spark, sf_dir).select(_ID, F.col("sequence_length").cast("int").alias("length"))
    return packs.pack_assignment(rows, 3072)


@query(RS + _PACK + "select pk.pack_id, cast(sum(o.len) as integer) as length, count(*) as supervised from pk join o on o.rn = pk.rn group by pk.pack_id")
def packed_rows(spark, sf_dir):
    p = packs.packed(_tokenised(spark, sf_dir), 3072)
    return p.select("pack_id", "length", F.size(F.filter("labels", lambda x: x != IGNORED_LABEL)).cast("long").alias("supervised"))


@query(RS + ", b as (select example_id, sequence_length as len, example_id // 64 as batch from k) select example_id, batch, cast(max(len) over (partition by batch) as integer) as width, cast(len as bigint) as mask_sum from b")
def padded_batch(spark, sf_dir):
    p = training.padded(_tokenised(spark, sf_dir), 64)
    return p.select(_ID, "batch", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"))


@query(RS + "select s.score, s.token_id, 1 as num_tokens, count(k.example_id) as rows, cast(0 as bigint) as astray from (values ('1', 49), ('2', 50), ('3', 51), ('4', 52), ('5', 53)) as s(score, token_id) left join k on cast(k.target_score as varchar) = s.score group by s.score, s.token_id")
def score_tokenization(spark, sf_dir):
    return tokens.score_token_use(_tokenised(spark, sf_dir), tokens.CodePoints(), require_single=True)


_GROUPED = """, o as (select example_id, sequence_length as length, row_number() over (order by md5('42:' || example_id), example_id) - 1 as spot from k),
g as (select example_id, length, row_number() over (order by spot // 800, length desc, spot) - 1 as place from o)
"""


@query(RS + _GROUPED + "select example_id, length, place, place // 16 as batch from g")
def length_grouped_batches(spark, sf_dir):
    return batches.length_grouped(V.kept(spark, sf_dir), 16, length="sequence_length")


@query(RS + _GROUPED + ", b as (select count(*) as n, sum(length) as tokens, max(length) * count(*) as held from g group by place // 16) select cast(sum(n) as bigint) as rows, count(*) as batches, cast(sum(tokens) as bigint) as tokens, round(1 - cast(sum(tokens) as double) / cast(sum(held) as double), 9) as padding from b")
def length_grouped_padding(spark, sf_dir):
    found = batches.padding_share(batches.length_grouped(V.kept(spark, sf_dir), 16, length="sequence_length"))
    return found.withColumn("padding", F.round("padding", 9))


class BracketTokenizer(tokens.CodePoints):
    """Code points with a chat template of its own: roles in brackets."""

    chat_template = "[{role}]{content}"
    name_or_path = "brackets"

    def apply_chat_template(self, messages, tokenize=False, add_generation_prompt=True):
        return "".join(f"[{m['role']}]{m['content']}" for m in messages) + ("[assistant]" if add_generation_prompt else "")


_BRACKETS = "replace(replace(replace(prompt, '<|system|>' || chr(10), '[system]'), chr(10) || '<|user|>' || chr(10), '[user]'), chr(10) || '<|assistant|>' || chr(10), '[assistant]')"


@query(RS + f"select example_id, md5({_BRACKETS}) as prompt_md5, cast(length({_BRACKETS}) as bigint) as prompt_token_length, cast(length({_BRACKETS}) + 2 as bigint) as sequence_length from prompts")
def template_prompts(spark, sf_dir):
    t = BracketTokenizer()
    m = tokens.with_sequence_lengths(V.targeted(spark, sf_dir), V.SYSTEM_PROMPT, tokenizer=t)
    return m.select(_ID, F.md5(tokens.prompt_col(V.SYSTEM_PROMPT, t)).alias("prompt_md5"), "prompt_token_length", "sequence_length")


@query(RS + f"select example_id, cast(length({_BRACKETS}) + 2 as integer) as length, md5({_BRACKETS}) as text_md5, cast(48 + target_score as integer) as supervised from prompts where length({_BRACKETS}) + 2 <= 3072")
def template_token_rows(spark, sf_dir):
    rows = tokens.token_rows(V.targeted(spark, sf_dir), V.SYSTEM_PROMPT, tokenizer=BracketTokenizer())
    text = F.array_join(F.transform(F.slice("input_ids", 1, F.col("prompt_length")), lambda i: F.decode(F.unhex(F.lpad(F.hex(i), 8, "0")), "UTF-32")), "")
    return rows.select(_ID, "length", F.md5(text).alias("text_md5"), F.filter("labels", lambda x: x != IGNORED_LABEL)[0].alias("supervised"))


# --- scoring

_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(PR + f"select {', '.join(_KEYS)}, pred_score, pred_binary, " + ", ".join(f"round(prob_{k}, 9) as prob_{k}" for k in range(1, 6)) + " from p")
def predictions_from_logits(spark, sf_dir):
    return V.predictions(spark, sf_dir).select(*_KEYS, "pred_score", "pred_binary", *(F.round(f"prob_{k}", 9).alias(f"prob_{k}") for k in range(1, 6)))


@query(PR + f"select {', '.join(_KEYS)}, round(score_margin, 9) as score_margin, round(score_entropy, 9) as score_entropy from p")
def score_margin_entropy(spark, sf_dir):
    return V.predictions(spark, sf_dir).select(*_KEYS, F.round("score_margin", 9).alias("score_margin"), F.round("score_entropy", 9).alias("score_entropy"))


@query(PR + f"select {', '.join(_KEYS)}, pred_score as score, pred_binary as label, round(confidence, 9) as confidence, round(score_margin, 9) as margin, round(score_entropy, 9) as entropy, round(logit_1 - top - ln(z), 9) as logprob_1 from p")
def hub_record_scoring(spark, sf_dir):
    out = scoring.score_records(V.logits(spark, sf_dir), F.array(*V.LOGITS))
    return out.select(*_KEYS, "score", "label", *(F.round(c, 9).alias(c) for c in ("confidence", "margin", "entropy")), F.round(F.col("logprobs")[0], 9).alias("logprob_1"))


# --- metrics

@query(PR + ", d(target) as (values (1), (2), (3), (4), (5)) select d.target, " + ", ".join(f"count(*) filter (where pred_score = {k}) as pred_{k}" for k in range(1, 6)) + " from d left join p on p.target_score = d.target group by d.target")
def confusion_ordinal(spark, sf_dir):
    return metrics.confusion(V.predictions(spark, sf_dir), "target_score", "pred_score", [1, 2, 3, 4, 5])


@query(PR + ", d(target) as (values ('INCORRECT'), ('CORRECT')) select d.target, " + ", ".join(f"count(*) filter (where pred_binary = '{k}') as \"pred_{k}\"" for k in ("INCORRECT", "CORRECT")) + " from d left join p on p.target_binary = d.target group by d.target")
def confusion_binary(spark, sf_dir):
    return metrics.confusion(V.predictions(spark, sf_dir), "target_binary", "pred_binary", ["INCORRECT", "CORRECT"])


def _overall(name: str, names) -> None:
    def run(spark, sf_dir):
        return _rounded(metrics.all_metrics(V.predictions(spark, sf_dir), calibrated=bool({*names} & {*CALIBRATION})), names)

    run.__name__ = name
    query(PR + f"select {_pick(names)} from p")(run)


_overall("ordinal_metrics", ["num_examples", *ORDINAL])
_overall("binary_metrics", BINARY)
_overall("per_score_prf", PER_SCORE)
_overall("calibration", CALIBRATION)
_overall("overall_metrics", EVERY)


@query(PR + f", b as (select *, {_BIN} as bin from p) select bin, count(*) as n, round(avg(confidence), 6) as mean_confidence, round(avg(cast(target_score = pred_score as integer)), 6) as accuracy from b where bin is not null group by bin")
def ece_bins(spark, sf_dir):
    return metrics.ece_bins(V.predictions(spark, sf_dir)).select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


_COUNTED = ["pred_score", "target_score", "pred_binary", "target_binary"]


@query(PR + " union all ".join(f"select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as n from p group by {c}" for c in _COUNTED))
def value_counts(spark, sf_dir):
    return metrics.value_counts(V.predictions(spark, sf_dir), _COUNTED)


_GROUPS = {"model": "model_id", "benchmark": "benchmark", "task": "task", "target_score": "target_score", "length_bucket": "response_length_bucket"}


def _per(name: str, column: str) -> None:
    def run(spark, sf_dir):
        return _rounded(metrics.grouped_metrics(V.predictions(spark, sf_dir), column), EVERY, F.col(f"group_{column}").alias("value"))

    run.__name__ = f"per_{name}_metrics"
    query(PR + f"select {column} as value, {_pick(EVERY)} from p group by {column}")(run)


for _name, _column in _GROUPS.items():
    _per(_name, _column)

_SOME = ["num_examples", *ORDINAL, *BINARY, *CALIBRATION]


@query(PR + " union all ".join(f"select '{c}' as dimension, cast({c} as varchar) as value, {_pick(_SOME)} from p group by {c}" for c in _GROUPS.values()))
def grouping_sets_metrics(spark, sf_dir):
    return _rounded(metrics.metrics_by(V.predictions(spark, sf_dir), list(_GROUPS.values())), _SOME, "dimension", "value")


_MB = ["binary_accuracy", "binary_macro_f1", "false_positive_rate_correct", "false_negative_rate_correct", *(f"{k}_{x}" for x in ("incorrect", "correct") for k in ("precision", "recall", "f1"))]
_MO = [*ORDINAL, *PER_SCORE]
_FIRST = ", tr as (select *, case when target_score >= 3 then 'CORRECT' else 'INCORRECT' end as y from sp where split = 'train'), mj as (select {0} as v from tr group by {0} order by count(*) desc, min(example_id) limit 1), ev as (select e.example_id, e.target_score, e.target_binary, {1} from sp e, mj where split = 'validation')"


@query(RS + _FIRST.format("y", "mj.v as pred_binary, e.target_score as pred_score") + f"select (select v from mj) as majority_class, (select count(*) from tr) as num_train, count(*) as num_eval, {_pick(_MB)} from ev")
def majority_binary_baseline(spark, sf_dir):
    s = splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST)
    m = metrics.majority_binary(s.where("split = 'train'"), s.where("split = 'validation'"))
    return _rounded(m, _MB, "majority_class", "num_train", "num_eval")


@query(RS + _FIRST.format("target_score", "mj.v as pred_score, e.target_binary as pred_binary") + f"select (select v from mj) as majority_score, (select count(*) from tr) as num_train, count(*) as num_eval, {_pick(_MO)} from ev")
def majority_ordinal_baseline(spark, sf_dir):
    s = splits.fixed_split(V.kept(spark, sf_dir), V.VALIDATION, V.TEST)
    m = metrics.majority_ordinal(s.where("split = 'train'"), s.where("split = 'validation'"))
    return _rounded(m, _MO, "majority_score", "num_train", "num_eval")


# --- evaluation passes

_IDS5 = (49, 50, 51, 52, 53)
_EVAL = ["num_examples", *ORDINAL]


def _eval_rows(spark, sf_dir) -> DataFrame:
    """Logits by place and token, and labels, as an evaluation pass gives them: the target's token is the second of three."""
    five = F.array(*(F.col(c) for c in V.LOGITS))
    place = F.concat(F.array_repeat(F.lit(0.0), _IDS5[0]), five)
    noise = F.array_repeat(F.lit(1.0), _IDS5[-1] + 1)
    label = F.when(F.col("l_linenumber") == 7, F.lit(IGNORED_LABEL)).otherwise(F.col("target_score") + 48)
    labels = F.array(F.lit(IGNORED_LABEL), label, F.lit(IGNORED_LABEL))
    return V.logits(spark, sf_dir).select(F.array(place, noise, noise).alias("logits"), labels.alias("labels"))


@query(PR + f"select {_pick(_EVAL)} from p where l_linenumber <> 7")
def eval_logit_metrics(spark, sf_dir):
    return _rounded(scoring.logit_metrics(_eval_rows(spark, sf_dir), token_ids=_IDS5), _EVAL)


@query(PR + f"select {_pick(_EVAL)} from p where l_linenumber <> 3")
def class_logit_metrics(spark, sf_dir):
    label = F.when(F.col("l_linenumber") == 3, F.lit(IGNORED_LABEL)).otherwise(F.col("target_score") - 1)
    rows = V.logits(spark, sf_dir).select(F.array(*(F.col(c) for c in V.LOGITS)).alias("logits"), label.alias("labels"))
    return _rounded(scoring.logit_metrics(rows), _EVAL)


# --- losses

_CE = "ln(z) + top - case target_score when 1 then logit_1 when 2 then logit_2 when 3 then logit_3 when 4 then logit_4 else logit_5 end"
_LOW, _HIGH = "ln(exp(logit_1) + exp(logit_2))", "ln(exp(logit_3) + exp(logit_4) + exp(logit_5))"
_BCE = f"ln(exp({_LOW}) + exp({_HIGH})) - case when target_score >= 3 then {_HIGH} else {_LOW} end"


@query(PR + f"select round(avg({_CE}), 6) as ce_loss from p")
def restricted_ce_loss(spark, sf_dir):
    return training.restricted_cross_entropy(V.logits(spark, sf_dir), V.LOGITS).select(F.round("ce_loss", 6).alias("ce_loss"))


@query(PR + f"select round(avg({_CE}), 6) as ce_loss, round(avg({_BCE}), 6) as binary_loss, round(avg({_CE}) + 0.5 * avg({_BCE}), 6) as loss from p")
def ce_plus_binary_loss(spark, sf_dir):
    return training.ce_with_binary(V.logits(spark, sf_dir), V.LOGITS).select(*(F.round(c, 6).alias(c) for c in ("ce_loss", "binary_loss", "loss")))

