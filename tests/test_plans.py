import json
import os

import pytest
from pyspark.sql import functions as F

from gradeweave.plans import config as C
from gradeweave.plans import pipeline
from gradeweave.plans.cli import parser
from gradeweave.sources import documents, tables
from tests.test_operators import COLUMNS, RAW, make_scorer

SF = "/root/testdata/sf0.001"


def settings(tmp, path):
    return C.with_defaults(
        {
            "project": {"output_dir": f"{tmp}/run", "seed": 1},
            "data": {"path": path, "columns": COLUMNS, "filters": {"max_disagreement": 1, "max_response_tokens": 4096}},
            "model": {"model_name_or_path": "none"},
            "prompt": {"system_prompt": "Return one score."},
            "split": {"mode": "fixed_by_model", "validation_models": ["m2"], "test_models": ["m3"]},
            "training": {"max_seq_length": 8192},
            "evaluation": {"length_buckets": [0, 10, 20]},
        }
    )


@pytest.fixture(params=["parquet", "csv"])
def source(request, spark, tmp_path):
    df = spark.createDataFrame(RAW, "question string, ground_truth string, response string, score_a int, score_b int, model_id string, benchmark string, task string, instance_id string")
    path = f"{tmp_path}/source.{request.param}"
    getattr(df.write, request.param)(path, **({"header": True} if request.param == "csv" else {}))
    return tmp_path, path


def test_prepare_predict_evaluate(spark, source):
    tmp, path = source
    c = settings(tmp, path)
    C.validate(c)
    done = pipeline.prepare(spark, c)
    assert {r.model_id: r.split for r in done.collect()} == {"m1": "train", "m2": "validation", "m3": "test"}
    mark = os.path.getmtime(f"{tmp}/run/prepared_fingerprint.json")
    pipeline.prepare(spark, c)
    assert os.path.getmtime(f"{tmp}/run/prepared_fingerprint.json") == mark  # reused
    c["prompt"]["system_prompt"] = "Other."
    pipeline.prepare(spark, c)
    assert os.path.getmtime(f"{tmp}/run/prepared_fingerprint.json") > mark  # rebuilt
    assert pipeline.token_table(spark, c, "train").count() == 1
    pipeline.predict(spark, c, "validation", make_scorer)
    m = pipeline.evaluate(spark, c, "validation")
    assert m["num_examples"] == 1
    for f in ("validation_metrics.json", "confusion_matrix_ordinal_validation.csv", "per_model_metrics.csv", "majority_baseline_validation.json", "config.yaml", "split_report.json"):
        assert os.path.exists(f"{tmp}/run/{f}"), f
    assert pipeline.debug_tokens(spark, c, "train", 1)[0].startswith("00000")


def test_held_out_folds(spark, source):
    tmp, path = source
    folds = pipeline.held_out_folds(spark, settings(tmp, path))
    assert [f["model"] for f in folds] == ["m1", "m2", "m3"] and not any(f["error"] for f in folds)


def test_missing_and_unknown_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_source(spark, "x.json")
    with pytest.raises(FileNotFoundError):
        tables.read_source(spark, f"{tmp_path}/no.csv")
    with pytest.raises(FileNotFoundError):
        tables.read_split(spark, f"{tmp_path}/no", "train")


def test_overrides():
    c = C.apply_override({"a": 1}, "a.b.c=[1, 2]")
    assert c == {"a": {"b": {"c": [1, 2]}}}
    with pytest.raises(ValueError):
        C.apply_override({}, "nothing")


@pytest.mark.parametrize("change", ["training.objective=x", "training.warmup_ratio=2", "inference.allowed_scores=[1]", "split.mode=x", "model.attn_implementation=x", "training.loss.class_weights=[1]", "inference.batch_size=0", "split.lomo_validation_fraction=1", "data.filters.on_sequence_overflow=x"])
def test_validation(tmp_path, change):
    with pytest.raises(ValueError):
        C.validate(C.apply_override(settings(tmp_path, "x.csv"), change))


def test_objective_decides_the_method():
    assert C.with_defaults({"training": {"objective": "sequence_classification"}})["inference"]["method"] == "sequence_classification_logits"
    assert C.with_defaults({"training": {"group_by_length": True}})["training"]["train_sampling_strategy"] == "group_by_length"
    assert C.workers("auto") == C.workers(-1) == C.cpus() and C.workers(3) == 3 and C.workers(None) == 1
    assert C.precision("bf16") == "bfloat16"


def test_documents(tmp_path):
    documents.write_json(tmp_path / "x.json", {1: (2, {3, 1})})
    assert documents.read_json(tmp_path / "x.json") == {"1": [2, [1, 3]]}
    with documents.mirrored_output(tmp_path / "log"):
        print("hello")
    assert "hello" in (tmp_path / "log").read_text()


def test_command_line():
    a = parser().parse_args(["evaluate", "-c", "x", "-o", "a=1", "-o", "b=2", "-s", "test"])
    assert a.split == "test" and a.override == ["a=1", "b=2"]
    with pytest.raises(SystemExit):
        parser().parse_args(["evaluate", "-c", "x", "-s", "train"])


def test_shown_tables(spark):
    from gradeweave.plans.cli import shown_metrics, shown_splits

    shown = shown_splits(spark.createDataFrame([("train", "m")], "split string, model_id string")).split("\n")
    assert len(shown) == 4 and ["train", "1", "1"] in [x.split() for x in shown]
    assert shown_metrics({"b": 0.5, "a": 3}).split("\n")[0].split() == ["a", "3"]


def test_stream(spark, tmp_path):
    from gradeweave.streaming.scoring import scored_stream

    schema = "a double, b double, c double, d double, e double"
    spark.createDataFrame([(0.0, 0.0, 5.0, 0.0, 0.0)], schema).write.parquet(f"{tmp_path}/in")
    q = scored_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), list("abcde")).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert spark.table("scored").first().pred_score == 3


def test_plans_stay_native(spark):
    from gradeweave.plans.catalogue import QUERIES

    for name in ("sequence_filter", "grouping_sets_metrics", "predictions_from_logits", "filter_funnel"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from gradeweave.plans.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "lineitem"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ("filter_funnel", "split_report", "lomo_split", "overall_metrics", "grouping_sets_metrics", "packed_rows", "majority_ordinal_baseline", "length_stats"):
        a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
        c = sorted(a.columns)
        assert c == sorted(b.columns)
        rows = lambda d: json.loads(d[c].astype(str).sort_values(c).to_json(orient="values"))  # noqa: B023, E731
        assert rows(a) == rows(b), name


DOCUMENTED = """
project: {run_name: judge, output_dir: runs/judge, seed: 42}
data:
  path: data/scores.parquet
  prepared_dir: null
  columns: {question: question, reference_answer: ground_truth, response: response, judge_1_score: a, judge_2_score: b, model_id: model_id}
  filters: {max_disagreement: 1, max_response_tokens: 4096, on_sequence_overflow: skip}
  preprocessing_num_workers: auto
  tokenizers_parallelism: true
  token_length_batch_size: 2048
model: {model_name_or_path: some/model, attn_implementation: flash_attention_2, adapter_path: null, thinking_mode: {enabled: false, apply_if_supported: true}}
prompt: {system_prompt: "Rate."}
split: {mode: fixed_by_model, validation_models: [m2], train_models: auto_except_val_test, held_out_model: null, lomo_validation_fraction: 0.05, lomo_validation_max_examples: 30000, lomo_validation_seed: 7}
training:
  max_seq_length: 3072
  load_in_4bit: true
  dtype: bfloat16
  objective: restricted_score_ce
  loss: {type: ce_5way_plus_binary, lambda_binary: 0.25, class_weights: null}
  learning_rate: 1.0e-4
  num_train_epochs: 1
  per_device_train_batch_size: 5
  per_device_eval_batch_size: 4
  gradient_accumulation_steps: 3
  warmup_ratio: 0.03
  lr_scheduler_type: cosine
  weight_decay: 0.0
  optim: adamw_8bit
  logging_steps: 50
  eval_steps: 1000
  save_steps: 3000
  save_total_limit: 10
  eval_subset_size: 8192
  eval_subset_strategy: stratified
  eval_subset_stratify_columns: [model_id, target_score]
  seed: 9
distributed: {enabled: false, strategy: ddp, fsdp: {sharding_strategy: full_shard}, deepspeed: null}
inference: {allowed_scores: ["1", "2", "3", "4", "5"], binary_threshold: 3, method: restricted_continuation_logprobs_fast, batch_size: 64}
evaluation: {length_buckets: [0, 256, 512]}
hub: {repo_id: null, private: false}
"""


@pytest.fixture
def documented(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text(DOCUMENTED)
    return str(path)


def test_documented_names_are_taken(documented):
    c = C.load_config(documented)
    assert c["inference"]["method"] == "restricted_continuation_logprobs_fast" and c["training"]["loss"]["lambda_binary"] == 0.25
    assert c["split"]["lomo_validation_seed"] == 7 and c["training"]["eval_subset_seed"] == 9 and c["training"]["eval_subset_stratify_columns"] == ["model_id", "target_score"]
    assert c["distributed"]["deepspeed"]["zero_stage"] == 2 and c["hub"]["max_shard_size"] == "5GB" and c["distributed"]["fsdp"]["use_orig_params"] is True
    assert C.load_config(documented, ["training.objective=sequence_classification"])["inference"]["method"] == "sequence_classification_logits"
    assert C.load_config(documented, ["inference.method=sequence_classification_logits"])["inference"]["method"] == "restricted_continuation_logprobs_fast"
    assert C.load_config(documented, ["inference.method=restricted_continuation_logprobs"])["inference"]["method"] == "restricted_continuation_logprobs"
    bare = C.with_defaults({"project": {"seed": 3}, "model": {"name_or_path": "x"}, "training": {"loss": None}})
    assert bare["model"]["model_name_or_path"] == "x" and bare["training"]["warmup_ratio"] == 0.0 and bare["split"]["lomo_validation_seed"] == 3 and bare["training"]["loss"]["type"] == "ce_5way"


@pytest.mark.parametrize("change", [
    "training.loss.type=ce", "training.loss.lambda_binary=-1", "training.loss=3", "inference.method=single_forward_fast", "training.eval_subset_stratify_columns=[]", "data.preprocessing_num_workers=some", "model.thinking_mode.enabled=1.5",
    "distributed.backend=x", "distributed.fsdp.sharding_strategy=x", "distributed.deepspeed.zero_stage=4", "distributed.mixed_precision=fp16", "distributed.fsdp.transformer_layer_cls_to_wrap=[1]", "training.packing=true", "model.model_name_or_path=",
])
def test_documented_rules(documented, change):
    with pytest.raises(ValueError):
        C.load_config(documented, [change])


def test_distributed_rules(documented):
    on = ["distributed.enabled=true", "distributed.strategy=fsdp"]
    with pytest.raises(ValueError, match="4-bit"):
        C.load_config(documented, on)
    with pytest.raises(ValueError, match="not both"):
        C.load_config(documented, [*on, "training.load_in_4bit=false", "distributed.gradient_checkpointing=true"])
    assert C.load_config(documented, [*on, "training.load_in_4bit=false", "distributed.mixed_precision=bf16"])["distributed"]["enabled"]
    with pytest.raises(ValueError, match="missing sections"):
        C.validate({"project": {}})


def test_trainer_arguments(documented, monkeypatch):
    from gradeweave.plans import trainer

    c = C.load_config(documented)
    a = trainer.trainer_arguments(c, "out", 1000, 2)
    assert a["output_dir"] == "out/checkpoints" and a["bf16"] and not a["fp16"] and a["seed"] == 9 and a["eval_strategy"] == "steps" and a["eval_steps"] == 1000
    assert trainer.total_steps(1000, c, 2) == 34 and a["warmup_steps"] == 2 and trainer.warmup_metadata(c, 1000, 2)["total_optimization_steps"] == 34 and trainer.total_steps(0, c) == 0
    assert trainer.resolved_warmup(1000, C.load_config(documented, ["training.warmup_steps=0"])) == 0
    assert "eval_steps" not in trainer.trainer_arguments(c, "out", 10, evaluated=False)
    on = ["distributed.enabled=true", "training.load_in_4bit=false"]
    ddp = trainer.trainer_arguments(C.load_config(documented, on), "out", 10)
    assert ddp["ddp_backend"] == "nccl" and ddp["disable_tqdm"] is False
    fsdp = trainer.distributed_arguments(C.load_config(documented, [*on, "distributed.strategy=fsdp", "distributed.fsdp.transformer_layer_cls_to_wrap=Layer"]))
    assert fsdp["fsdp"] == "full_shard auto_wrap" and fsdp["fsdp_config"]["transformer_layer_cls_to_wrap"] == "Layer"
    deep = C.load_config(documented, [*on, "distributed.strategy=deepspeed", "distributed.deepspeed={zero_stage: 3, offload_param_device: cpu, config_overrides: {zero_optimization: {x: 1}}}"])
    z = trainer.deepspeed_settings(deep)["zero_optimization"]
    assert z == {"stage": 3, "offload_param": {"device": "cpu"}, "stage3_gather_16bit_weights_on_model_save": True, "x": 1}
    for name, _ in trainer.LAUNCHERS:
        monkeypatch.delenv(name, raising=False)
    monkeypatch.delenv("LOCAL_RANK", raising=False)
    assert trainer.launcher() == "single_process"
    monkeypatch.setenv("LOCAL_RANK", "0")
    assert trainer.launcher() == "distributed"
    monkeypatch.setenv("SLURM_JOB_ID", "1")
    assert trainer.launcher() == "slurm" and trainer.runtime_metadata(c, 8)["effective_global_batch_size"] == 120
    args = type("A", (), {})()
    trainer.set_warmup(args, {"warmup_steps": 5})
    assert args.warmup_steps == 5
    with pytest.raises(ValueError):
        trainer.total_steps(5, C.apply_override(c, "training.gradient_accumulation_steps=0"))


def test_runtime(monkeypatch):
    from gradeweave.plans import runtime

    for name, value in (("RANK", "2"), ("WORLD_SIZE", "4"), ("LOCAL_RANK", "x")):
        monkeypatch.setenv(name, value)
    assert (runtime.rank(), runtime.world_size(), runtime.local_rank(), runtime.is_distributed(), runtime.is_main_process()) == (2, 4, 0, True, False)
    assert runtime.package_versions()["pyspark"] and runtime.package_versions()["python"]
    assert runtime.git_commit("/") is None


def test_publishing_options(documented, tmp_path):
    from gradeweave.plans import hub

    c = C.load_config(documented, [f"project.output_dir={tmp_path}/run", "hub.commit_message=m"])
    with pytest.raises(ValueError, match="repo_id"):
        hub.hub_options(c)
    o = hub.hub_options(c, repo_id="a/b", private=True, no_push=True)
    assert (o.repo_id, o.private, o.commit_message, o.staging_dir, o.no_push) == ("a/b", True, "m", "hub_staging/judge", True)
    with pytest.raises(FileNotFoundError):
        hub.checkpoint_paths(o.run_dir)
    assert hub.adapter_path(c) is None
    with pytest.raises(FileNotFoundError):
        hub.adapter_path(C.apply_override(C.copy_config(c), "inference.require_adapter=true"))
    os.makedirs(f"{tmp_path}/run/adapter")
    assert hub.checkpoint_paths(o.run_dir)["tokenizer"] is None and hub.adapter_path(c) == f"{tmp_path}/run/adapter"
    documents.write_json(f"{tmp_path}/run/split_report.json", [1])
    r = hub.run_record(c, o)
    assert r["artifacts"] == {"split_report.json": [1]} and r["binary_threshold"] == 3 and r["base_model"] == "some/model"
    assert hub.document_or_default(str(tmp_path), None) == {}
    documents.write_json(f"{tmp_path}/{hub.DOCUMENT}", hub.inference_document(c))
    assert hub.document_or_default(None, str(tmp_path))["prompt"]["system_prompt"] == "Rate."
    assert C.record_settings(hub.load_document(str(tmp_path)))["allowed_scores"] == list("12345")


def test_documents_in_other_file_systems(spark, tmp_path):
    uri = f"file://{tmp_path}/deep/er/x.json"
    documents.write_json(uri, {"a": "é"})
    assert documents.exists(uri) and documents.read_json(uri) == {"a": "é"} and documents.read_json(f"{tmp_path}/deep/er/x.json") == {"a": "é"}
    assert not documents.exists(uri + "x")


def test_run_in_a_uri_folder_and_train_data(spark, source):
    tmp, path = source
    c = settings(f"file://{tmp}", path)
    c["training"] |= {"per_device_train_batch_size": 1, "per_device_eval_batch_size": 1, "gradient_accumulation_steps": 1, "num_train_epochs": 1}
    done = pipeline.prepare(spark, c)
    a = pipeline.train_data(spark, c, done)
    assert os.path.exists(f"{tmp}/run/run_metadata.json") and a["warmup_steps"] == 0
    assert pipeline.train_data(spark, c, done, finalist=True)["eval_strategy"] == "no"
    kept = pipeline.token_table(spark, c, "train")
    for f in kept.inputFiles():  # a damaged table is made anew
        open(f.removeprefix("file://").removeprefix("file:"), "wb").close()
    assert pipeline.token_table(spark, c, "train").count() == 1


def test_held_out_folds_predict_and_evaluate(spark, source):
    tmp, path = source
    folds = pipeline.held_out_folds(spark, settings(tmp, path), scorer=make_scorer)
    assert all(f["metrics"]["num_examples"] == 1 for f in folds)


def test_prepare_reads_its_source_once(spark, source):
    tmp, path = source
    c = settings(tmp, path)
    reads, read = [], tables.read_source
    tables.read_source = lambda *a: (reads.append(1), read(*a).withColumn("instance_id", F.udf(lambda x: (open(f"{tmp}/seen", "a").write("x"), x)[1])("instance_id")))[1]
    try:
        pipeline.prepare(spark, c)
    finally:
        tables.read_source = read
    assert len(open(f"{tmp}/seen").read()) == len(RAW) and reads == [1]  # each source row was computed once
    report = documents.read_json(f"{tmp}/run/dataset_filtering_report.json")
    assert report["raw"] == len(RAW) and report["after_sequence_length"] == 3 and not os.path.exists(f"{tmp}/run/kept")


def test_folds_share_rows_and_jobs(spark, tmp_path):
    schema = "question string, ground_truth string, response string, score_a int, score_b int, model_id string, benchmark string, task string, instance_id string"

    def jobs(models):
        rows = [("q", "t", "r", 3, 3, f"m{m}", "b", "t", f"{m}-{i}") for m in range(models) for i in range(20)]
        path = f"{tmp_path}/{models}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        c = settings(f"{tmp_path}/{models}", path)
        spark.sparkContext.setJobGroup(f"folds-{models}", "folds")
        folds = pipeline.held_out_folds(spark, c)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{models}"))
        spark.sparkContext.setJobGroup("rest", "rest")
        for f in folds:
            assert f["error"] is None
            report = {r["split"]: r for r in documents.read_json(f"{f['output_dir']}/split_report.json")}
            own = C.copy_config(c)
            own["project"]["output_dir"] = f["output_dir"]
            got = tables.read_prepared(spark, C.prepared_dir(own))
            assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {s: r["examples"] for s, r in report.items() if r["examples"]}
        return n

    assert jobs(6) <= jobs(3) + 1


def test_reports_are_published_whole_or_not_at_all(spark, tmp_path):
    from gradeweave.sources.reports import write_report

    a, b = f"{tmp_path}/x/a.csv", f"file://{tmp_path}/x/b.csv"
    df = spark.createDataFrame([(3, "c"), (1, 'a,"q"'), (2, None)], "n int, s string").repartition(3)
    write_report(df.orderBy("n"), a, b)
    want = 'n,s\n1,"a,""q"""\n2,\n3,c\n'
    assert open(a).read() == want == open(f"{tmp_path}/x/b.csv").read()
    broken = df.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        write_report(broken, a, b)
    assert open(a).read() == want and sorted(os.listdir(f"{tmp_path}/x")) == ["a.csv", "b.csv"]
    write_report(df.limit(0), a)
    assert open(a).read() == "n,s\n"


def test_gang_of_ranks(spark):
    from gradeweave.plans import gang

    rows = spark.range(103).selectExpr("id as example_id", "array(id) as input_ids")

    def trainer(rank, batches):
        seen = [x for b in batches for x in b.column("example_id").to_pylist()]
        rank.barrier()
        every = [json.loads(t) for t in rank.all_gather(json.dumps(seen))]
        env = rank.environment()
        return {"mine": seen == every[rank.rank], "all": sorted(x for s in every for x in s) == list(range(103)), "env": [env["RANK"], env["WORLD_SIZE"], env["LOCAL_RANK"], os.environ["RANK"]]}

    out = gang.run(rows, 3, trainer, 8).orderBy("rank").collect()
    assert [r.rank for r in out] == [0, 1, 2] and sum(r.rows for r in out) == 103
    assert {r.steps for r in out} == {-(-max(r.rows for r in out) // 8)}
    for r in out:
        found = json.loads(r.result)
        assert found["mine"] and found["all"] and found["env"] == [str(r.rank), "3", str(r.rank), str(r.rank)]


def test_rank_of_a_later_attempt():
    from gradeweave.plans import gang

    rank = gang.Rank(2, 4, ["a:1", "b:1", "a:2", "a:3"], 1, 5, "7")
    assert rank.local_rank == 1 and rank.environment()["MASTER_PORT"] == "29501" and rank.environment()["CUDA_VISIBLE_DEVICES"] == "7"


class Logging:
    """Code points that note how many prompts were encoded."""

    eos_token_id = pad_token_id = 0

    def __init__(self, path):
        self.path, self.name_or_path = path, "logging"

    def encode(self, texts):
        with open(self.path, "a") as f:
            f.writelines("prompt\n" for t in texts if "### QUESTION" in t and len(t) > 40)
        return [list(map(ord, t)) for t in texts]


@pytest.mark.parametrize("packing", [False, True])
def test_one_changed_file_is_encoded_again(spark, tmp_path, packing):
    names = "question string, ground_truth string, response string, score_a int, score_b int, model_id string, benchmark string, task string, instance_id string"
    folder, log = f"{tmp_path}/source.parquet", f"{tmp_path}/log"

    def file(name, rows):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/one")
        os.makedirs(folder, exist_ok=True)
        found = next(f for f in os.listdir(f"{tmp_path}/one") if f.endswith(".parquet"))
        os.replace(f"{tmp_path}/one/{found}", f"{folder}/{name}.parquet")

    def rows(file, answer, n=4):
        return [(f"q{file}", "r", f"{answer}{k}", 3, 3, "m1", "b", "t", f"{file}-{k}") for k in range(n)]

    def table(c):
        open(log, "w").close()
        pipeline.prepare(spark, c, Logging(log))
        open(log, "w").close()
        kept = pipeline.token_table(spark, c, "train", Logging(log)).collect()
        ids = [x for r in kept for x in r.input_ids]
        with open(log) as f:
            return kept, "".join(map(chr, ids)), sum(1 for _ in f)

    file("other", [("q", "r", "a", 3, 3, m, "b", "t", m) for m in ("m2", "m3")])
    for k in range(3):
        file(k, rows(k, "a"))
    c = settings(tmp_path, folder)
    c["training"]["packing"] = packing
    kept, text, encoded = table(c)
    assert encoded == 12 and (packing or len(kept) == 12)
    assert table(c)[1:] == (text, 0) or packing  # nothing is encoded twice
    file(1, rows(1, "changed"))
    kept, text, encoded = table(c)
    assert encoded == 4 and text.count("changed") == 4 and text.count("### QUESTION") == 12
    os.remove(f"{folder}/2.parquet")
    file(3, rows(3, "new", 2))
    kept, text, encoded = table(c)
    assert encoded == 2 and text.count("### QUESTION") == 10 and "q2" not in text and text.count("new") == 2
    under = [d for d, _, files in os.walk(f"{tmp_path}/run/tokenized") if "unit=" in d]
    assert len(under) == 3  # what is gone is removed
    c["training"]["cache_tokenized_datasets"] = False
    assert table(c)[2] == 10


def test_units_without_rows_and_without_files(spark, tmp_path):
    from gradeweave.sources import parts

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source_file string, x int")
    calls = []

    def make(df):
        calls.append(1)
        return df.where("x > 2").select("x", "unit")

    kept, now = parts.derived(rows, f"{tmp_path}/k", make)
    assert [r.x for r in kept.collect()] == [3] and len(now) == 2 and len(calls) == 1
    assert parts.derived(rows, f"{tmp_path}/k", make)[1] == now and len(calls) == 1  # a file without rows isn't asked again
    assert parts.derived(rows.where("x = 1"), f"{tmp_path}/k", make)[0].count() == 0
    assert parts.derived(rows.limit(0), f"{tmp_path}/e", make)[0].columns == ["x"]
    kept, now = parts.derived(rows.drop("source_file"), f"{tmp_path}/n", make)
    assert len(now) == 1 and kept.count() == 1


def test_ranks_read_batches_of_like_length(spark):
    from gradeweave.operators import batches
    from gradeweave.plans import gang

    rows = spark.range(101).selectExpr("id as example_id", "cast(pmod(id * 37, 64) + 1 as int) as length")
    placed = rows.join(batches.length_grouped(rows, 8, mega=4).select("example_id", "place"), "example_id")

    def trainer(rank, given):
        return {"batches": [[b.column("example_id").to_pylist(), b.schema.names] for b in given]}

    out = gang.run(placed, 2, trainer, 4, "place").orderBy("rank").collect()
    order = [r.example_id for r in placed.orderBy("place").collect()]
    for r in out:
        found = json.loads(r.result)["batches"]
        assert [ids for ids, _ in found] == [order[at : at + 4] for at in range(4 * r.rank, 101, 8)]
        assert all(names == ["example_id", "length"] for _, names in found)


def test_batches_cross_arrow_batches():
    import pyarrow as pa

    from gradeweave.plans import gang

    made = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 4), (4, 13), (13, 14))]
    assert [b.column("x").to_pylist() for b in gang.in_batches(iter(made), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13]]
    assert list(gang.in_batches(iter([]), 4)) == []


def test_csv_with_a_schema_is_read_in_parts(spark, tmp_path):
    with open(f"{tmp_path}/s.csv", "w") as f:
        f.write("a,b\n" + "1,x\n" * 5000)
    schema = "a int, b string"
    df = tables.read_source(spark, f"{tmp_path}/s.csv", schema, False)
    assert df.schema.simpleString() == "struct<a:int,b:string>" and df.count() == 5000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert tables.read_source(spark, f"{tmp_path}/s.csv", schema, False).rdd.getNumPartitions() > 1
        assert tables.read_source(spark, f"{tmp_path}/s.csv", schema, True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
