import json
import math

import pytest
from pyspark.sql import functions as F

from gradeweave.functions.digests import stable_json_hash
from gradeweave.functions.scalar import class_id, clean_text, length_bucket, safe_name, score_of_class, score_of_metric_label
from gradeweave.functions.text import messages, plain_template, prompt, prompt_overhead, user_message
from gradeweave.operators import filters, metrics, packs, scoring, splits, targets, tokens, training

COLUMNS = {"question": "question", "reference_answer": "ground_truth", "response": "response", "judge_1_score": "score_a", "judge_2_score": "score_b", "model_id": "model_id", "benchmark": "benchmark", "task": "task", "example_id": "instance_id"}
RAW = [("q1", "a1", "r1", 5, 4, "m1", "b", "t1", "i1"), ("q2", "a2", "r2", 2, 2, "m2", "b", "t2", "i2"), ("q3", "a3", "r3", 3, 4, "m3", "c", "t3", "i3")]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, "question string, ground_truth string, response string, score_a int, score_b int, model_id string, benchmark string, task string, instance_id string")


@pytest.fixture(scope="module")
def rows(raw):
    return targets.load_targets(raw, COLUMNS)


def one(df):
    return df.first().asDict()


def col(df, name, order="example_id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_targets(rows):
    assert col(rows, "target_score") == [4, 2, 3]
    assert col(rows, "target_binary") == ["CORRECT", "INCORRECT", "CORRECT"]
    assert col(rows, "disagreement") == [1.0, 0.0, 1.0]
    assert one(rows)["source"] is None


def test_missing_columns_are_named(raw):
    with pytest.raises(ValueError, match="response -> nope"):
        targets.validate_columns(raw, COLUMNS | {"response": "nope"})


@pytest.mark.parametrize("bad", ["0", "5.5", "x", None, "NaN"])
def test_scores_outside_raise(spark, bad):
    df = spark.createDataFrame([(bad, "3")], "judge_1_score string, judge_2_score string")
    with pytest.raises(ValueError, match="judge_1_score: 1 rows"):
        targets.validate_scores(df)


def test_fractional_scores_floor(spark):
    df = targets.with_targets(spark.createDataFrame([(4.5, 4.0), (2.5, 3.0)], "judge_1_score double, judge_2_score double"))
    assert [r.target_score for r in df.collect()] == [4, 2]


def test_clean_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("NaN",), (" ",), ("x",)], "s string")
    assert [r[0] for r in df.select(clean_text(F.col("s"))).collect()] == ["N/A", "N/A", "N/A", " ", "x"]


def test_class_ids(spark):
    df = spark.createDataFrame([(1,), (5,)], "s int")
    assert [r[0] for r in df.select(class_id(F.col("s"))).collect()] == [0, 4]
    assert [r[0] for r in df.select(score_of_class(F.col("s") - 1)).collect()] == [1, 5]
    with pytest.raises(Exception, match="outside"):
        df.select(class_id(F.col("s") + 1)).collect()


def test_metric_labels(spark):
    df = spark.createDataFrame([(49,), (3,), (0,), (9,)], "x int")
    assert [r[0] for r in df.select(score_of_metric_label(F.col("x"), {49: 1})).collect()] == [1, 3, 1, None]


def test_buckets_at_edges(spark):
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (19,), (20,), (None,)], "n int")
    assert [r[0] for r in df.select(length_bucket(F.col("n"), [0, 10, 20])).collect()] == ["nan", "0-10", "0-10", "10-20", "10-20", "nan", "nan"]


def test_safe_name(spark):
    assert spark.range(1).select(safe_name(F.lit("a/b c"))).first()[0] == "a_b_c"


def test_prompt_has_no_metadata_and_known_length(rows):
    text = one(rows.orderBy("example_id").select(tokens.prompt_col("Return one score.").alias("p")))["p"]
    assert text == "<|system|>\nReturn one score.\n<|user|>\n### QUESTION\nq1\n\n### REFERENCE ANSWER\na1\n\n### MODEL RESPONSE\nr1\n\n### SCORE\n\n<|assistant|>\n"
    assert prompt_overhead("Return one score.") == 105 + 17
    assert "m1" not in text and "t1" not in text


def test_template_equals_prompt(rows):
    user = user_message(F.col("question"), F.col("reference_answer"), F.col("response"))
    got = rows.select((plain_template(messages(user, " S ")) == prompt(F.col("question"), F.col("reference_answer"), F.col("response"), " S ")).alias("x"))
    assert all(r.x for r in got.collect())


def test_sequence_lengths(rows):
    lm = one(tokens.with_sequence_lengths(rows, "Return one score."))
    assert lm["prompt_token_length"] == 128 and lm["sequence_length"] == 130
    assert one(tokens.with_sequence_lengths(rows, "Return one score.", "sequence_classification"))["sequence_length"] == 128


def test_real_tokenizer_gives_the_same(rows):
    class Same(tokens.Tokenizer):
        eos_token_id = 0

        def encode(self, texts):
            return [[ord(c) for c in t] for t in texts]

    assert one(tokens.with_sequence_lengths(rows, "S", tokenizer=Same())) == one(tokens.with_sequence_lengths(rows, "S"))


def test_token_lengths(spark):
    df = spark.createDataFrame([("a",), ("bc",), ("",), ("def",), ("😀",)], "response string")
    assert [r.response_token_length for r in tokens.with_response_lengths(df).collect()] == [1, 2, 0, 3, 1]
    assert [r[0] for r in df.select(tokens.code_points(F.col("response"))).collect()] == [[97], [98, 99], [], [100, 101, 102], [128512]]


def test_masks_one_supervised_token(rows):
    r = one(tokens.token_rows(rows, "S").orderBy("example_id"))
    assert [x for x in r["labels"] if x != -100] == [ord("4")] and r["input_ids"][-1] == 0 and r["labels"][-1] == -100
    c = one(tokens.token_rows(rows, "S", "sequence_classification").orderBy("example_id"))
    assert c["labels"] == 3 and len(c["input_ids"]) == c["prompt_length"]


def test_overflow(rows):
    assert tokens.token_rows(rows, "S", max_seq_length=5).count() == 0
    with pytest.raises(Exception, match="longer than max_seq_length"):
        tokens.token_rows(rows, "S", max_seq_length=5, on_overflow="error").collect()
    with pytest.raises(ValueError):
        tokens.token_rows(rows, "S", on_overflow="else")


def test_score_tokens():
    assert [r["num_tokens"] for r in tokens.validate_score_tokens(tokens.CodePoints(), list("12345"), True)] == [1] * 5
    with pytest.raises(ValueError):
        tokens.validate_score_tokens(tokens.CodePoints(), ["1", "2", "3", "4", "05"])


def test_thinking_arguments():
    class Knows:
        chat_template = "... enable_thinking ..."

        def apply_chat_template(self, m, enable_thinking=None):
            return ""

    class Not:
        chat_template = ""

    assert tokens.thinking_arguments(Knows(), False) == {"enable_thinking": False}
    assert tokens.thinking_arguments(Not(), False) == {} and tokens.thinking_arguments(Knows(), None) == {}


def test_filters(spark):
    df = spark.createDataFrame([(4096, 0.0), (4097, 0.0), (10, 2.0), (10, 1.0)], "response_token_length bigint, disagreement double").withColumn("sequence_length", F.lit(100))
    assert filters.apply_filters(df, 1, 4096).count() == 2
    f = one(filters.funnel(df, 1, 4096, 50))
    assert (f["raw"], f["after_disagreement"], f["after_response_length"], f["after_sequence_length"]) == (4, 3, 2, 0)
    assert f["removed_by_response_length_pct"] == pytest.approx(100 / 3, abs=1e-5)
    with pytest.raises(ValueError):
        filters.sequence_filter(df, 50, "error")
    assert one(filters.funnel(df.limit(0), 1, 4096, 50))["removed_by_disagreement_pct"] == 0.0


def test_warnings():
    assert len(filters.length_warnings(4096, 4096)) == 2 and filters.length_warnings(8192, 4096) == []


def test_length_statistics_empty(rows):
    r = one(filters.length_statistics(tokens.with_response_lengths(rows).limit(0)))
    assert r["num_examples"] == 0 and r["min"] is None and r["p50"] is None


def test_fixed_split(rows):
    s = splits.fixed_split(rows, ["m2"], ["m3"])
    assert {r.model_id: r.split for r in s.collect()} == {"m1": "train", "m2": "validation", "m3": "test"}
    s = splits.fixed_split(rows, ["m2"])
    assert {r.model_id: r.split for r in s.collect()}["m3"] == "train"
    assert {r.split: r.examples for r in splits.split_report(s).collect()} == {"train": 2, "validation": 1, "test": 0}
    with pytest.raises(ValueError, match="unknown"):
        splits.fixed_split(rows, ["m9"])
    with pytest.raises(ValueError, match="share"):
        splits.fixed_split(rows, ["m2"], ["m2"])
    with pytest.raises(ValueError):
        splits.fixed_split(rows, [])


def test_held_out_keeps_null_models(spark):
    df = spark.createDataFrame([(i, None if i == 0 else f"m{i % 3}") for i in range(30)], "example_id bigint, model_id string")
    s = splits.held_out_split(df, "m1", 0.2)
    splits.validate_held_out(s, "m1")
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"test": 10, "validation": 4, "train": 16}
    assert splits.validation_size(1) == 1 and splits.validation_size(50) == 2 and splits.validation_size(1000, most=30) == 30


def test_finalist_union(rows):
    assert splits.finalist_union(splits.fixed_split(rows, ["m2"], ["m3"])).count() == 3
    with pytest.raises(ValueError):
        splits.finalist_union(splits.fixed_split(rows, ["m2"]).limit(0))


def plain_quotas(sizes, k):
    """One row at a time, from the floors: to the stratum furthest below its ideal, or from the one furthest above that has two."""
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    ideal = {s: sizes[s] / total * k for s in order}
    have = {s: min(sizes[s], max(1, int(ideal[s]))) for s in order}
    while (off := k - sum(have.values())) != 0:
        able = [s for s in order if (have[s] < sizes[s] if off > 0 else have[s] > 1)]
        if not able:
            break
        s = max(able, key=lambda s: (ideal[s] - have[s]) * (1 if off > 0 else -1))
        have[s] += 1 if off > 0 else -1
    return have


def test_quotas_equal_repair_one_by_one(spark):
    import random

    rng = random.Random(8)
    cases = [({"a": 7, "b": 2, "c": 1}, 3), ({"a": 7, "b": 2, "c": 1}, 2), ({None: 7, "b": 6}, 5), ({f"s{i:03d}": 1 for i in range(120)} | {"big": 300, "mid": 40}, 130), ({f"s{i:03d}": 1 for i in range(90)} | {"big": 900, "big2": 880}, 150)]
    cases += [({f"g{i:02d}": rng.choice([1, 1, 2, 5, 30]) for i in range(rng.randint(1, 40))}, rng.randint(1, 60)) for _ in range(4)]
    for sizes, k in cases:
        df = spark.createDataFrame([(s,) for s, n in sizes.items() for _ in range(n)], "g string")
        got = {r.g: (r.size, r.quota) for r in splits.stratified_quotas(df, min(k, sum(sizes.values())), ["g"]).collect()}
        assert got == {s: (sizes[s], q) for s, q in plain_quotas(sizes, min(k, sum(sizes.values()))).items()}
    assert splits.stratified_quotas(df.limit(0), 3, ["g"]).count() == 0


def test_fold_cuts_are_those_of_single_folds(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(1000, "rare")]
    df = spark.createDataFrame(rows, "example_id bigint, model_id string")
    cuts = splits.fold_cuts(df, 0.1, 40, 3).collect()
    assert sorted(c.model_id for c in cuts) == ["a", "b", "c", "rare"]
    counts = {(r.fold, r.model_id): (r.train, r.validation) for r in splits.fold_counts(df, cuts, 3).collect()}
    for c in cuts:
        want = {r.example_id: r.split for r in splits.held_out_split(df, c.model_id, 0.1, 40, 3).collect()}
        got = {r.example_id: r.split for r in splits.fold_of(df, c.model_id, c, 3).collect()}
        assert got == want and c.validation == sum(s == "validation" for s in got.values()) and c.test == sum(s == "test" for s in got.values())
        for m in {m for _, m in rows} - {c.model_id}:
            assert counts[c.model_id, m] == tuple(sum(got[i] == s for i, x in rows if x == m) for s in ("train", "validation"))
    assert splits.fold_cuts(df.where("model_id = 'b'"), 0.1).collect() == []


def test_stratified_subset(spark):
    df = spark.createDataFrame([(m * 50 + s * 10 + i, f"m{m}", s) for m in range(2) for s in range(5) for i in range(10)], "example_id bigint, model_id string, target_score int")
    got = splits.eval_subset(df, 20)
    assert {r["count"] for r in got.groupBy("model_id", "target_score").count().collect()} == {2} and got.count() == 20
    assert {r.example_id for r in got.collect()} == {r.example_id for r in splits.eval_subset(df.repartition(7), 20).collect()}
    assert splits.eval_subset(df, None).count() == 100 and splits.eval_subset(df, 7, "random").count() == 7


PRED = [(1, 1, "INCORRECT", "INCORRECT"), (2, 3, "INCORRECT", "CORRECT"), (3, 3, "CORRECT", "CORRECT"), (5, 4, "CORRECT", "CORRECT")]


def predictions(spark):
    return spark.createDataFrame(PRED, "target_score int, pred_score int, target_binary string, pred_binary string")


def test_metrics(spark):
    m = one(metrics.all_metrics(predictions(spark)))
    assert (m["ordinal_accuracy"], m["within_1_accuracy"], m["binary_accuracy"]) == (0.5, 1.0, 0.75)
    assert json.loads(m["pred_score_counts"]) == {"1": 1, "3": 2, "4": 1}
    assert m["precision_score_3"] == 0.5 and m["f1_score_2"] == 0.0 and m["ordinal_macro_f1"] == pytest.approx((1 + 2 / 3) / 5)
    assert m["false_positive_rate_correct"] == 0.5 and m["false_negative_rate_correct"] == 0.0


def test_stored_binary_wins_over_threshold(spark):
    assert one(metrics.all_metrics(predictions(spark), 5))["binary_accuracy"] == 0.75
    assert one(metrics.all_metrics(predictions(spark).drop("target_binary", "pred_binary"), 5))["binary_accuracy"] == 0.75 - 0.0


def test_empty_metrics(spark):
    m = one(metrics.all_metrics(predictions(spark).limit(0)))
    assert m["num_examples"] == 0 and m["ordinal_accuracy"] is None and m["ordinal_macro_f1"] == 0.0


def test_null_group_stays(spark):
    df = predictions(spark).withColumn("g", F.when(F.col("target_score") > 2, "x"))
    assert {r.group_g: r.num_examples for r in metrics.grouped_metrics(df, "g").collect()} == {None: 2, "x": 2}
    assert {(r.dimension, r.value): r.num_examples for r in metrics.metrics_by(df, ["g", "target_score"]).collect()}["g", None] == 2
    assert metrics.grouped_metrics(df, "absent").count() == 0


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.3, 1, 1), (1.0, 1, 1), (0.65, 2, 1)], "prob_1 double, target_score int, pred_score int")
    b = {r.bin: r.n for r in metrics.ece_bins(df).collect()}
    assert b == {2: 1, 9: 1, 6: 1}
    df = df.withColumns({"score_margin": F.lit(0.0), "score_entropy": F.lit(0.0)})
    assert one(metrics.all_metrics(df))["expected_calibration_error_10bin"] == pytest.approx((0.7 + 0.0 + 0.65) / 3)


def test_confusion_ignores_unknown_labels(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (9, 1), (2, 3)], "t int, p int")
    c = {r.target: r for r in metrics.confusion(df, "t", "p", [1, 2, 3]).collect()}
    assert c[1].pred_1 == 1 and c[2].pred_3 == 1 and c[3].pred_1 == 0 and sum(sum(list(r)[1:]) for r in c.values()) == 2


def test_majority_ties_take_the_first(spark):
    train = spark.createDataFrame([(2, 4), (1, 2), (3, 4), (0, 2)], "example_id int, target_score int")
    assert metrics.majority(train, "target_score") == 2
    with pytest.raises(ValueError):
        metrics.majority(train.limit(0), "target_score")
    ev = spark.createDataFrame([(2, "INCORRECT"), (4, "CORRECT")], "target_score int, target_binary string")
    assert one(metrics.majority_ordinal(train, ev))["ordinal_accuracy"] == 0.5
    assert one(metrics.majority_binary(train, ev))["majority_class"] == "INCORRECT"


def test_scoring(spark):
    df = spark.createDataFrame([(3.0, 0.0, -1.0, -2.0, -3.0), (1.0, 1.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double, e double")
    r = scoring.normalised(df, list("abcde")).collect()
    assert [x.pred_score for x in r] == [1, 1] and r[0].score_margin == 3.0 and r[1].score_margin == 0.0
    assert sum(r[0][f"prob_{k}"] for k in range(1, 6)) == pytest.approx(1)
    assert r[0].score_entropy == pytest.approx(-sum(r[0][f"prob_{k}"] * math.log(r[0][f"prob_{k}"]) for k in range(1, 6)))
    assert scoring.sorted_scores(["5", "1", "3", "2", "4"]) == list("12345")
    assert set(scoring.empty_predictions(spark).columns) >= {"pred_score", "logprob_1", "prob_5"}


def make_scorer():
    return lambda prompts: [[1.0 if k == len(p) % 5 else 0.0 for k in range(5)] for p in prompts]


def test_external_scorer(rows):
    got = scoring.predict(rows, make_scorer, "Return one score.", batch_size=2).orderBy("example_id").collect()
    assert [r.pred_score for r in got] == [128 % 5 + 1] * 3 and got[0].prompt_token_length_inference == 128


def test_records(spark):
    df = spark.createDataFrame([("q", "r", None, "g"), (None, None, None, None)], "question string, model_response string, reference_answer string, ground_truth string")
    assert [r[0] for r in df.select(scoring.validate_record()).collect()] == [[], ["question", "model_response", "reference_answer or ground_truth"]]
    r = scoring.score_records(df.limit(1), F.array(*map(F.lit, (0.0, 0.0, 9.0, 0.0, 0.0)))).first()
    assert r.score == 3 and r.label == "CORRECT" and r.confidence > 0.99


def test_packing(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3], [1, 1, 1], [-100, -100, 3], 3), (1, [4, 5], [1, 1], [-100, 5], 2)], "example_id int, input_ids array<int>, attention_mask array<int>, labels array<int>, length int")
    p = packs.packed(rows, 10).collect()
    assert len(p) == 1 and p[0].input_ids == [1, 2, 3, 4, 5] and [x for x in p[0].labels if x != -100] == [3, 5]
    lens = spark.createDataFrame(list(enumerate([3, 2, 6, 5, 5, 9, 1])), "example_id int, length int")
    assert [r.pack_id for r in packs.pack_assignment(lens.repartition(3), 10).orderBy("example_id").collect()] == [0, 0, 1, 2, 2, 3, 3]
    assert packs.pack_assignment(lens, 4).count() == 3
    chunked = packs.pack_assignment(lens, 10, chunks=2).groupBy("pack_id").agg(F.count("*").alias("n"))
    assert chunked.agg(F.sum("n")).first()[0] == 7
    w = training.padded(rows, 2).orderBy("example_id").collect()
    assert w[1].input_ids == [4, 5, 0] and w[1].labels == [-100, 5, -100] and w[1].attention_mask == [1, 1, 0]


def test_weights_and_losses(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (9,)], "target_score int")
    assert [r.weight for r in training.inverse_frequency_weights(df).orderBy("target_score").collect()] == [0.3, 0.6, 0.0, 0.0, 0.0]
    assert training.class_weights(df, {"loss": {"class_weights": [1, 2, 3, 4, 5]}}) == [1, 2, 3, 4, 5]
    assert training.class_weights(df, {}) is None
    l = spark.createDataFrame([(3.0, 0.0, -1.0, -2.0, -3.0, 1), (-3.0, -2.0, 0.0, 1.0, 4.0, 5)], "a double, b double, c double, d double, e double, target_score int")
    r = one(training.ce_with_binary(l, list("abcde")))
    assert r["ce_loss"] == pytest.approx(0.071764623) and r["binary_loss"] == pytest.approx(0.014528996) and r["loss"] == pytest.approx(0.079029121)


def test_steps():
    assert training.optimisation_steps(101, 5, 3, 2, 2) == 8 and training.warmup_steps(8, 0.1) == 1 and training.warmup_steps(8, 0.1, 12) == 12
    assert training.global_batch(5, 3, 8) == 120


def test_stable_hash():
    assert stable_json_hash({"b": 1, "a": [1]}) == stable_json_hash({"a": [1], "b": 1})


# --- chat templates, models, evaluation logits


class Bracketed(tokens.CodePoints):
    """A tokenizer with a template of its own that knows a thinking mode."""

    chat_template = "[role]content, enable_thinking"

    def apply_chat_template(self, messages, tokenize=False, add_generation_prompt=True, enable_thinking=None):
        text = "".join(f"[{m['role']}]{m['content']}" for m in messages)
        return text + ("[assistant]" if add_generation_prompt else "") + ("<no_think>" if enable_thinking is False else "")


def test_templates_of_tokenizers(rows):
    chat = tokens.chat_tokenizer(Bracketed(), {"model": {"thinking_mode": {"enabled": False}}})
    assert chat.arguments == {"enable_thinking": False} and tokens.chat_tokenizer(None, {}) is None
    want = {}
    for q, a, r, *_, i in RAW:
        want[i] = f"[system]S[user]### QUESTION\n{q}\n\n### REFERENCE ANSWER\n{a}\n\n### MODEL RESPONSE\n{r}\n\n### SCORE\n[assistant]<no_think>"
    got = {r.example_id: r for r in tokens.with_sequence_lengths(rows.withColumn("p", tokens.prompt_col(" S ", chat)), " S ", tokenizer=chat).collect()}
    assert {k: r.p for k, r in got.items()} == want
    assert all(got[k].prompt_token_length == len(w) and got[k].sequence_length == len(w) + 2 for k, w in want.items())
    made = {r.example_id: r.input_ids for r in tokens.token_rows(rows, " S ", tokenizer=chat).collect()}
    assert all("".join(map(chr, made[k][:-2])) == w for k, w in want.items())
    assert tokens.render([{"role": "user", "content": "x"}]) == "<|user|>\nx\n<|assistant|>\n" and tokens.render([{"role": "user", "content": "x"}], add_generation_prompt=False) == "<|user|>\nx"
    assert tokens.render([{"role": "user", "content": "x"}], chat) == "[user]x[assistant]<no_think>"


def test_called_tokenizers():
    class Called:
        eos_token_id, name_or_path = 7, "Qwen3-x"

        def __call__(self, texts, add_special_tokens, truncation):
            assert not add_special_tokens and not truncation
            return {"input_ids": [[len(t)] for t in texts]}

        def apply_chat_template(self, messages, **more):
            return str(more)

    chat = tokens.ChatTokenizer(Called(), True)
    assert chat.encode(["ab", ""]) == [[2], [0]] and chat.eos_token_id == 7 and chat.arguments == {"enable_thinking": True}
    assert tokens.ChatTokenizer(Called(), True, False).arguments == {} and tokens.ChatTokenizer(tokens.CodePoints(), True).arguments == {}


class Toy:
    """Logits that depend on the last token and its place: vocabulary of 128."""

    def __call__(self, input_ids, attention_mask):
        import numpy as np

        places = np.cumsum(attention_mask, axis=1)
        return np.sin(input_ids[:, :, None] * 0.7 + places[:, :, None] + np.arange(128) * 1.3) * attention_mask[:, :, None]


def test_scoring_with_models():
    import numpy as np

    from gradeweave.operators import inference

    class Left(tokens.CodePoints):
        padding_side = "left"

    prompts, names = ["ab", "abcd", "x"], list("12345")
    right = inference.score_prompts(Toy(), tokens.CodePoints(), prompts, names)
    left = inference.score_prompts(Toy(), Left(), prompts, names)
    slow = inference.score_prompts(Toy(), tokens.CodePoints(), prompts, names, "restricted_continuation_logprobs")
    assert right.method == left.method == inference.SINGLE and slow.method == inference.MULTI and right.lengths == [2, 4, 1]
    assert np.allclose(right.values, left.values) and np.allclose(right.values, slow.values)
    assert inference.score_prompts(Toy(), tokens.CodePoints(), ["ab"], ["10", "2", "3", "4", "5"]).method == inference.MULTI
    ids = np.array([[97, 49, 48]])
    steps = inference.log_softmax(Toy()(ids, np.ones_like(ids))[0])
    assert inference.continuation_logprob(Toy(), [97], [49, 48]) == pytest.approx(steps[0, 49] + steps[1, 48])
    assert inference.continuation_logprob(Toy(), [97], []) == inference.continuation_logprob(Toy(), [], [49]) == float("-inf")
    assert inference.last_places(np.array([[1, 1, 0], [0, 1, 1]])).tolist() == [1, 2]
    with pytest.raises(ValueError):
        inference.score_prompts(Toy(), tokens.CodePoints(), [""], names)
    with pytest.raises(ValueError, match="3 classes"):
        inference.classify_prompts(lambda i, m: np.zeros((len(i), 3)), tokens.CodePoints(), ["a"], names)
    assert inference.classify_prompts(lambda i, m: np.arange(5.0)[None].repeat(len(i), 0), tokens.CodePoints(), ["a", "b"], names).values == [[0, 1, 2, 3, 4]] * 2


def test_continuations_share_forward_passes():
    import numpy as np

    from gradeweave.operators import inference

    class Sums:
        """Logits that depend on all tokens so far, and a count of the calls and of the tokens read."""

        calls = read = 0

        def __call__(self, input_ids, attention_mask):
            self.calls, self.read = self.calls + 1, self.read + int(attention_mask.sum())
            so_far = np.cumsum(input_ids * attention_mask * (1 + np.cumsum(attention_mask, axis=1)), axis=1)
            return np.sin(so_far[:, :, None] * 0.31 + np.arange(128) * 1.7)

    rng = np.random.default_rng(5)
    prompts = [rng.integers(1, 120, n).tolist() for n in (3, 9, 1, 0, 40, 5, 9)] + [[7, 8], [7, 8, 9], [7, 8]]
    for scores in ([[49], [50], [51], [52], [53]], [[49, 48], [50], [], [49, 48, 47], [52, 53]]):
        want = [[inference.continuation_logprob(Sums(), p, c) for c in scores] for p in prompts]
        for side in ("right", "left"):
            for size in (None, 1, 4):
                model = Sums()
                assert np.allclose(inference.continuation_logprobs(model, prompts, scores, 0, side, size), want)
        assert inference.continuation_logprobs(Sums(), [], scores) == []
    single = Sums()
    inference.continuation_logprobs(single, prompts, [[49], [50], [51], [52], [53]], batch_size=3)
    # nine prompts with tokens, of which one repeats and one begins another: seven to read instead of 45
    assert single.calls == 3 and single.read == 3 + 9 + 1 + 40 + 5 + 9 + 3
    two = Sums()
    inference.continuation_logprobs(two, [[1, 2], [3, 4, 5]], [[49, 48], [49, 47], [49, 46], [49, 45], [49, 44]], batch_size=2)
    assert two.calls == 1


def test_prompts_of_like_length_share_batches():
    seen = []

    def score(prompts):
        seen.append([len(p) for p in prompts])
        return [[float(len(p))] * 5 for p in prompts]

    texts = ["x" * n for n in (9, 1, 8, 2, 7, 3)]
    assert [v[0] for v, *_ in scoring._scored(score, texts, 2)] == [9, 1, 8, 2, 7, 3] and seen == [[1, 2], [3, 7], [8, 9]]


def test_predictions_of_models(rows):
    from gradeweave.operators import inference

    got = scoring.predict(rows, inference.model_scorer(Toy, tokens.CodePoints()), "S", batch_size=2, candidate_ids={"1": [49]}).collect()
    for r in got:
        text = "".join(["<|system|>\nS\n<|user|>\n", f"### QUESTION\n{r.question}\n\n### REFERENCE ANSWER\n{r.reference_answer}\n\n### MODEL RESPONSE\n{r.response}\n\n### SCORE\n\n<|assistant|>\n"])
        want = inference.score_prompts(Toy(), tokens.CodePoints(), [text], list("12345"))
        assert [r[f"logprob_{s}"] for s in range(1, 6)] == pytest.approx(want.values[0]) and r.prompt_token_length_inference == len(text)
        assert r.scoring_method == inference.SINGLE and r.pred_score == 1 + max(range(5), key=lambda i: want.values[0][i])


def test_ties_go_to_the_configured_order(spark):
    df = spark.createDataFrame([(1.0, 3.0, 0.0, 3.0, 3.0)], "a double, b double, c double, d double, e double")
    assert one(scoring.normalised(df, list("abcde")))["pred_score"] == 2 and one(scoring.normalised(df, list("abcde"), order=[5, 4, 3, 2, 1]))["pred_score"] == 5
    m = one(scoring.normalised(df, list("abcde")))
    assert m["score_margin"] == 0 and sum(m[f"prob_{s}"] for s in range(1, 6)) == pytest.approx(1)


def test_metrics_of_evaluation_logits(spark):
    ids = [3, 4, 5, 6, 7]
    place = lambda hot: [9.0 if t == hot else 0.0 for t in range(9)]
    rows = [([-100, -100, 5, 8], [place(0), place(5), place(3), place(0)]), ([-100, 7, -100], [place(3), place(0), place(0)]), ([-100, -100], [place(7), place(7)])]
    df = spark.createDataFrame(rows, "labels array<int>, logits array<array<double>>")
    got = one(scoring.logit_metrics(df, token_ids=ids))
    assert got["num_examples"] == 2 and got["ordinal_accuracy"] == 0.5 and got["support_score_5"] == 1
    flat = spark.createDataFrame([(4, [0.0, 5.0, 0.0, 0.0, 0.0]), (3, [0.0] * 3 + [4.0] + [0.0] * 5), (2, [1.0] * 5)], "labels int, logits array<double>")
    assert [r.target_score for r in scoring.labelled_scores(flat, ids).collect()] == [2, 1, 2]
    assert [[r[f"logit_{s}"] for s in range(1, 6)] for r in scoring.score_logits(flat, ids).collect()] == [[0.0, 5.0, 0.0, 0.0, 0.0], [4.0, 0.0, 0.0, 0.0, 0.0], [1.0] * 5]
    assert one(scoring.logit_metrics(flat, token_ids=ids))["ordinal_accuracy"] == pytest.approx(2 / 3)
    classes = spark.createDataFrame([(0, [3.0, 0.0, 0.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0, 0.0, 0.0]), (-100, [1.0] * 5), (5, [1.0] * 5)], "labels int, logits array<double>")
    got = one(scoring.logit_metrics(classes))
    assert got["num_examples"] == 2 and got["ordinal_accuracy"] == 0.5 and got["ordinal_mae"] == 2
    assert scoring.logit_metrics(classes.limit(0)).count() == 0


def test_records_end_to_end(spark):
    from gradeweave.operators import inference

    df = spark.createDataFrame([("q", None, "a", "m")], "question string, reference_answer string, ground_truth string, model_response string")
    settings = {"system_prompt": "S", "binary_threshold": 3}
    r = one(scoring.predict_records(df, inference.model_scorer(Toy, tokens.CodePoints()), settings))
    assert 1 <= r["score"] <= 5 and sum(r["probs"]) == pytest.approx(1) and r["label"] == ("CORRECT" if r["score"] >= 3 else "INCORRECT")
    with pytest.raises(Exception, match="without model_response"):
        scoring.predict_records(df.withColumn("model_response", F.lit(None).cast("string")), inference.model_scorer(Toy, tokens.CodePoints()), settings).collect()


def test_percentiles_are_exact(spark):
    import random

    import numpy as np

    rng = random.Random(4)
    values = [("a", rng.random()) for _ in range(500)] + [("b", 0.25)] * 40 + [("b", 1.0), (None, 0.5), (None, 0.75), ("c", None)]
    df = spark.createDataFrame(values, "g string, x double")
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for slots, most in ((1, 1000), (7, 1000), (7, 3), (2, 1), (1 << 16, 10)):
        got = {r.g: r for r in metrics.percentiles(df, ["g"], "x", wanted, slots, most).collect()}
        assert set(got) == {"a", "b", None}
        for g, r in got.items():
            x = [v for k, v in values if k == g and v is not None]
            for name, p in wanted.items():
                assert r[name] == pytest.approx(np.percentile(x, 100 * p), abs=1e-12)


@pytest.mark.parametrize("chunks", [1, 2, 7, 40])
def test_packs_of_ranges_are_those_of_one_fold(spark, chunks):
    import random

    rng = random.Random(chunks)
    rows = [(i, rng.randrange(1, 130)) for i in range(400)]
    want, pack, used = {}, -1, None
    for i, n in rows:
        if n <= 100:
            if used is None or used + n > 100:
                pack, used = pack + 1, 0
            used += n
            want[i] = pack
    for kind in ("bigint", "string"):
        given = spark.createDataFrame([(i if kind == "bigint" else f"{i:04d}", n) for i, n in rows], f"example_id {kind}, length int")
        got = {int(r.example_id): r.pack_id for r in packs.pack_assignment(given, 100, chunks=chunks).collect()}
        assert got == want
    assert packs.pack_assignment(given.limit(0), 100, chunks=chunks).count() == 0


def test_samples_are_the_first_by_hash(spark):
    import hashlib

    keys = list(range(2000))
    df = spark.createDataFrame([(k, k % 3) for k in keys], "example_id int, g int")
    first = sorted(keys, key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
    for n in (0, 1, 100, 2000, 3000):
        assert {r.example_id for r in splits.sample(df, n, 5).collect()} == set(first[:n])
    q = splits.stratified_quotas(df, 90, ["g"])
    got = [r.example_id for r in splits.stratified_subset(df, 90, ["g"], 5).collect()]
    want = [k for r in q.collect() for k in [x for x in first if x % 3 == r.g][: r.quota]]
    assert sorted(got) == sorted(want) and len(got) == 90


def test_percentiles_of_values_that_crowd(spark):
    import numpy as np

    # all in one slot, some equal, as confidences of a sure model are
    x = [1 - (i % 3000) * 2.0**-50 for i in range(9000)] + [1.0] * 4000 + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(4)
    wanted = {"p1": 0.01, "p50": 0.5, "p90": 0.9}
    tasks = []
    met = metrics._met
    metrics._met = lambda rows, bins, keys, many: (tasks.append(bins.agg(F.min("__c"), F.max("__c")).first()[:]), met(rows, bins, keys, many))[1]
    try:
        got = metrics.percentiles(df, [], "x", wanted, 64, 100).collect()
    finally:
        metrics._met = met
    assert len(got) == 1
    for name, p in wanted.items():
        assert got[0][name] == np.percentile([v for v in x if v is not None and v == v], 100 * p)
    most = [t[1] for t in tasks]
    assert most[0] == 13000 and len(most) > 1 and most == sorted(most, reverse=True) and most[-1] < 5000  # the crowded slot came apart; one value makes up the rest
    assert metrics.percentiles(df.limit(0), [], "x", wanted).count() == 0


def test_metrics_compile_and_read_rows_once(spark):
    rows = spark.range(500).selectExpr("cast(id % 5 + 1 as int) as target_score", "cast((id * 3) % 5 + 1 as int) as pred_score", "cast(id % 2 as string) as g", "0.5D as confidence", "id / 500D as score_margin", "0.1D as score_entropy", "0.5D as prob_1")
    plan = metrics.all_metrics(rows, calibrated=False)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Range (") == 1 and "count_if" not in physical
    assert {r.group_g: r.confidence_p50 for r in metrics.grouped_metrics(rows, "g").collect()} == {"0": 0.5, "1": 0.5}


def test_length_groups(spark):
    from gradeweave.operators import batches

    rows = spark.range(500).selectExpr("concat('k', id) as example_id", "cast(pmod(id * 7919, 1000) as int) as length")
    got = batches.length_grouped(rows, 8, mega=10)
    a = got.orderBy("place").collect()
    assert [r.place for r in a] == list(range(500)) and len({r.example_id for r in a}) == 500 and all(r.batch == r.place // 8 for r in a)
    for at in range(0, 500, 80):  # longest first within a mega-batch
        assert [r.length for r in a[at : at + 80]] == sorted((r.length for r in a[at : at + 80]), reverse=True)
    again = batches.length_grouped(rows.repartition(5), 8, mega=10).orderBy("place").collect()
    other = batches.length_grouped(rows, 8, epoch=1, mega=10).orderBy("place").collect()
    assert again == a and other != a and {r.example_id for r in other} == {r.example_id for r in a}
    plain = rows.selectExpr("example_id", "length", "monotonically_increasing_id() as place").coalesce(1)
    before = one(batches.padding_share(plain.withColumn("batch", F.expr("substring(example_id, 2) div 8"))))
    after = one(batches.padding_share(got))
    assert after["rows"] == 500 and after["batches"] == 63 and after["tokens"] == before["tokens"] and after["padding"] < before["padding"] / 3
    empty = batches.length_grouped(rows.limit(0), 8)
    assert empty.count() == 0 and one(batches.padding_share(empty))["padding"] == 0
    nulls = spark.createDataFrame([("a", None), ("b", 3)], "example_id string, length int")
    assert [r.example_id for r in batches.length_grouped(nulls, 1).orderBy("place").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        batches.length_grouped(rows, 0)


def test_warnings_and_score_tokens_of_rows(spark):
    df = spark.createDataFrame([(10, 15), (5, 30), (12, 90)], "response_token_length int, prompt_token_length int")
    got = {r.warning.split()[0]: r.rows for r in filters.warned_rows(df, 10, 10, 5).collect()}
    assert got == {"max_response_tokens": 1, "prompt": 2}
    assert filters.warned_rows(df, 9000, 10).count() == 0
    rows = spark.createDataFrame([(1, [-100, 49, -100]), (1, [-100, 50]), (2, [-100])], "target_score int, labels array<int>")
    got = {r.score: (r.token_id, r.rows, r.astray) for r in tokens.score_token_use(rows, tokens.CodePoints()).collect()}
    assert got == {"1": (49, 2, 1), "2": (50, 1, 1), "3": (51, 0, 0), "4": (52, 0, 0), "5": (53, 0, 0)}


def test_the_end_token_pads_where_there_is_no_other():
    class Inner(tokens.CodePoints):
        eos_token_id, pad_token_id, padding_side = 7, None, "left"

    chat = tokens.ChatTokenizer(Inner())
    assert chat.pad_token_id == 7 and chat.padding_side == "left"


def test_tokenizers_get_slices_of_a_batch(spark):
    class Counting(tokens.CodePoints):
        chat_template = "x"

        def apply_chat_template(self, messages, tokenize=False, add_generation_prompt=True):
            return messages[-1]["content"]

        def encode(self, texts):
            if len(texts) > 1 and sum(map(len, texts)) > 1 << 18:
                raise ValueError("too much at once")
            return super().encode(texts)

    t = Counting()
    df = spark.createDataFrame([(i, "q" * 900 * (i % 7) or None) for i in range(500)] + [(500, "z" * 300_000)], "k int, text string").coalesce(1)
    got = df.select("k", "text", tokens.encoded(tokens.rendered(F.col("text"), "", t), t).alias("ids"), tokens.token_count(F.col("text"), Wordy(t)).alias("n")).collect()
    assert len(got) == 501
    assert all(x.ids == [ord(c) for c in x.text or ""] and x.n == len(x.text or "") for x in got)


class Wordy:
    """A tokenizer of another kind than code points."""

    eos_token_id = 0

    def __init__(self, inner):
        self.inner_ = inner

    def encode(self, texts):
        return self.inner_.encode(texts)
