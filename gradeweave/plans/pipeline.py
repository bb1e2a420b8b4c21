"""Prepare, predict and evaluate: plans over whole tables, and their artefacts."""

from __future__ import annotations

import functools
import json
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradeweave.functions.digests import stable_json_hash
from gradeweave.functions.scalar import length_bucket
from gradeweave.operators import batches, filters, metrics, packs, scoring, splits, targets, tokens, training
from gradeweave.plans import config as C
from gradeweave.plans import gang, trainer
from gradeweave.plans.runtime import git_commit, package_versions, world_size
from gradeweave.sources import documents, parts, tables
from gradeweave.sources.reports import write_report
from gradeweave.sources.tables import held

GROUPS = {"model": "model_id", "benchmark": "benchmark", "task": "task", "target_score": "target_score", "response_length_bucket": "response_length_bucket"}


def tokenizer_identity(tokenizer) -> list:
    """What tells tokenizers apart: class, name, template and arguments, end token and a probe's ids."""
    t = tokenizer or tokens.CodePoints()
    inner = getattr(t, "inner", t)
    return [type(inner).__name__, str(getattr(inner, "name_or_path", "")), str(getattr(t, "chat_template", "") or ""), getattr(t, "arguments", {}), t.eos_token_id, [list(map(int, x)) for x in t.encode(["1 2 3 4 5", "### QUESTION\n"])]]


def fingerprint(spark: SparkSession, config: dict, tokenizer=None, files: list | None = None) -> dict:
    """What the prepared rows depend on: configuration, tokenizer and the source's files by path, size and time. Versions are noted, not hashed."""
    path = config["data"]["path"]
    files = tables.listing(spark, path) if files is None else files
    known = {
        "version": 3, "path": path, "files": files, "columns": config["data"]["columns"], "filters": config["data"]["filters"], "split": config["split"], "prompt": config["prompt"], "objective": config["training"]["objective"],
        "max_seq_length": config["training"]["max_seq_length"], "allowed_scores": scoring.sorted_scores(config["inference"]["allowed_scores"]), "binary_threshold": config["inference"]["binary_threshold"],
        "model": config["model"].get("model_name_or_path"), "tokenizer": tokenizer_identity(tokenizer),
    }
    return {"parts": known, "hash": stable_json_hash(known), "package_versions": package_versions()}


def measured(spark: SparkSession, config: dict, tokenizer=None) -> DataFrame:
    """Source to targets and lengths. Lengths of real tokenizers come after the cheap filter."""
    data = config["data"]
    source = tables.read_source(spark, data["path"], data.get("schema"), data.get("multi_line", True)).withColumn("__file", F.col("_metadata.file_path"))
    df = targets.load_targets(source, {**data["columns"], parts.SOURCE_FILE: "__file"}, config["inference"]["binary_threshold"])
    df = tokens.with_response_lengths(df, tokenizer)
    return tokens.with_sequence_lengths(df, config["prompt"]["system_prompt"], config["training"]["objective"], tokenizer)


def split(df: DataFrame, config: dict) -> DataFrame:
    s = config["split"]
    if s["mode"] == "fixed_by_model":
        return splits.fixed_split(df, s["validation_models"], s["test_models"], s["train_models"])
    if s["mode"] != "leave_one_model_out":
        raise ValueError(f"split.mode: {s['mode']}")
    if not s.get("held_out_model"):
        raise ValueError("split.held_out_model must be given")
    return splits.held_out_split(df, s["held_out_model"], s["lomo_validation_fraction"], s["lomo_validation_max_examples"], s["lomo_validation_seed"])


def prepare(spark: SparkSession, config: dict, tokenizer=None, force: bool = False) -> DataFrame:
    """The prepared rows with ``split``, from the folder if its fingerprint still holds.

    The source is read once: rows that pass the filters are written aside, and
    the funnel's counts are observed meanwhile. Splits, checks and reports read
    those.
    """
    out, run = C.prepared_dir(config), C.run_dir(config)
    tokenizer = tokens.chat_tokenizer(tokenizer, config)
    mark, now = os.path.join(run, "prepared_fingerprint.json"), fingerprint(spark, config, tokenizer)
    ready = tables.exists(spark, f"{out}/_SUCCESS") or tables.exists(spark, f"{out}/{tables.FOLD}")
    if not force and documents.exists(mark) and ready and documents.read_json(mark)["hash"] == now["hash"]:
        return tables.read_prepared(spark, out)
    _settings(config, tokenizer)
    aside = f"{run}/kept"
    report = _kept(spark, config, tokenizer).write_to(aside)
    kept = spark.read.parquet(aside).where("stage = 3").drop("stage")
    done = split(kept, config)
    splits.validate_no_leakage(done) if config["split"]["mode"] == "fixed_by_model" else splits.validate_held_out(done, config["split"]["held_out_model"])
    tables.write_splits(done, out)
    tables.remove(spark, f"{out}/{tables.FOLD}")
    tables.remove(spark, aside)
    stored = spark.read.parquet(out)
    documents.write_json(os.path.join(run, "dataset_filtering_report.json"), report)
    documents.write_json(os.path.join(run, "length_statistics.json"), [r.asDict() for r in filters.length_statistics(stored).collect()])
    documents.write_json(os.path.join(run, "split_report.json"), [r.asDict() for r in splits.split_report(stored).collect()])
    documents.write_json(mark, now)
    return stored


def _settings(config: dict, tokenizer) -> None:
    """The run's configuration and its scores' tokens, as documents."""
    run = C.run_dir(config)
    C.save_config(config, os.path.join(run, "config.yaml"))
    documents.write_json(os.path.join(run, "score_tokenization_report.json"), tokens.validate_score_tokens(tokenizer or tokens.CodePoints(), list(map(str, config["inference"]["allowed_scores"]))))


class _kept:
    """Measured rows with the stage they reach, and the funnel's report from the same pass."""

    def __init__(self, spark: SparkSession, config: dict, tokenizer, everything: bool = False):
        f, self.most = config["data"]["filters"], config["training"]["max_seq_length"]
        if f["on_sequence_overflow"] not in ("skip", "error"):
            raise ValueError(f"on_sequence_overflow: {f['on_sequence_overflow']}")
        self.config, self.filters, self.seen = config, f, Observation("funnel")
        rows = filters.observed(measured(spark, config, tokenizer), self.seen, f["max_disagreement"], f["max_response_tokens"], self.most)
        self.rows = rows if everything else rows.where("stage = 3")

    def write_to(self, path: str) -> dict:
        self.rows.write.mode("overwrite").partitionBy("stage").parquet(path)
        counts = self.seen.get
        if self.filters["on_sequence_overflow"] == "error" and counts["after_response_length"] > counts["after_sequence_length"]:
            tables.remove(self.rows.sparkSession, path)
            raise ValueError(f"sequences are over max_seq_length {self.most}")
        return filters.funnel_of(counts) | {"warnings": filters.length_warnings(self.most, self.filters["max_response_tokens"]), "sequence_overflow_reason": filters.overflow_reason(self.config["training"]["objective"])}


def eval_rows(spark: SparkSession, config: dict) -> DataFrame:
    """The validation rows that training watches."""
    tr = config["training"]
    return splits.eval_subset(tables.read_split(spark, C.prepared_dir(config), "validation"), tr["eval_subset_size"], tr["eval_subset_strategy"], tr["eval_subset_stratify_columns"], tr["eval_subset_seed"])


def token_table(spark: SparkSession, config: dict, name: str, tokenizer=None) -> DataFrame:
    """Token rows of a split, kept by source file: only rows of files whose kept rows changed are encoded again.

    Packs depend on all rows in order, so they are made from the kept token
    rows, anew if any file changed. A table that can't be read is made anew.
    """
    tokenizer = tokens.chat_tokenizer(tokenizer, config)
    rows = tables.read_split(spark, C.prepared_dir(config), name)
    tr, system = config["training"], config["prompt"]["system_prompt"]
    overflow = config["data"]["filters"]["on_sequence_overflow"]
    key = stable_json_hash([name, config["prompt"], tr["objective"], tr["max_seq_length"], overflow, tokenizer_identity(tokenizer)])[:16]
    path = f"{C.run_dir(config)}/tokenized/{name}_{key}"
    again = not tr["cache_tokenized_datasets"]
    encode = lambda part: tokens.token_rows(part, system, tr["objective"], tr["max_seq_length"], overflow, tokenizer, ["unit"])
    kept, now = parts.derived(rows, path, encode, again)
    if not tr["packing"]:
        return kept
    packed = f"{path}_packs_{stable_json_hash(now)[:16]}"
    if not again and tables.exists(spark, f"{packed}/_SUCCESS"):
        try:
            found = spark.read.parquet(packed)
            found.count()
            return found
        except Exception:  # a file is damaged or gone
            spark.catalog.refreshByPath(packed)
    packs.packed(kept, tr["max_seq_length"]).write.mode("overwrite").parquet(packed)
    return spark.read.parquet(packed)


def train_data(spark: SparkSession, config: dict, prepared: DataFrame, finalist: bool = False, tokenizer=None) -> dict:
    """The data half of training: token rows are written; arguments and record of the run come back and are kept."""
    tr, run = config["training"], C.run_dir(config)
    counts = {r["split"]: r["count"] for r in prepared.groupBy("split").count().collect()}
    names = [s for s in splits.SPLITS if counts.get(s)] if finalist else ["train"]
    if finalist:
        splits.finalist_union(prepared)
    examples = sum(token_table(spark, config, s, tokenizer).count() for s in names)
    world = world_size()
    report = tokens.validate_score_tokens(tokenizer or tokens.CodePoints(), scoring.sorted_scores(config["inference"]["allowed_scores"]), tr["objective"] == "restricted_score_ce")
    record = {
        "git_commit": git_commit(), "package_versions": package_versions(), "training_objective": tr["objective"], "training_loss": tr["loss"], "training_mode": "finalist" if finalist else "standard",
        "score_token_ids": [r["token_ids"][0] for r in report] if tr["objective"] == "restricted_score_ce" else None,
        "score_class_weights": training.class_weights(prepared.where(F.col("split").isin(names)), tr), "source_split_counts": counts, "training_examples": examples, "evaluation_enabled": not finalist,
        "validation_monitor_examples": 0 if finalist else eval_rows(spark, config).count(), "validation_full_examples": counts.get("validation", 0),
        "distributed": trainer.runtime_metadata(config, world), "warmup": trainer.warmup_metadata(config, examples, world),
    }
    documents.write_json(f"{run}/run_metadata.json", record)
    arguments = trainer.trainer_arguments(config, run, examples, world, not finalist)
    documents.write_json(f"{run}/resolved_training_args.json", arguments)
    return arguments


def train(spark: SparkSession, config: dict, prepared: DataFrame, trainer_function, ranks: int, finalist: bool = False, tokenizer=None, epoch: int = 0) -> list[dict]:
    """The data half, then the external trainer on ``ranks`` ranks of one barrier stage; each rank's result is kept with the run.

    With ``group_by_length`` ranks read rows of like length together, in an
    order that seed and ``epoch`` decide.
    """
    tr = config["training"]
    train_data(spark, config, prepared, finalist, tokenizer)
    names = [s for s in splits.SPLITS if finalist or s == "train"]
    have = {r["split"] for r in prepared.select("split").distinct().collect()}
    rows = functools.reduce(DataFrame.unionByName, [token_table(spark, config, s, tokenizer) for s in names if s in have])
    size, place = tr["per_device_train_batch_size"], None
    if tr["train_sampling_strategy"] == "group_by_length":
        rows, place = _by_length(rows, size * ranks, int(tr.get("seed", config["project"].get("seed", 42))), epoch), "place"
    out = gang.run(rows, ranks, trainer_function, size, place).orderBy("rank")
    found = [r.asDict() for r in out.collect()]  # a row a rank
    documents.write_json(f"{C.run_dir(config)}/rank_results.json", found)
    return found


def _by_length(rows: DataFrame, batch_size: int, seed: int, epoch: int) -> DataFrame:
    """Token rows or packs with ``place``; a step's batches on all ranks are one batch here."""
    key = "pack_id" if "pack_id" in rows.columns else "example_id"
    places = batches.length_grouped(rows, batch_size, seed, epoch, key)
    return rows.join(places.select(key, "place"), key)


def predict(spark: SparkSession, config: dict, name: str, scorer, tokenizer=None) -> DataFrame:
    rows = tables.read_split(spark, C.prepared_dir(config), name)
    inf = config["inference"]
    tokenizer = tokens.chat_tokenizer(tokenizer, config)
    ids = {r["score"]: r["token_ids"] for r in tokens.score_tokens(tokenizer or tokens.CodePoints(), scoring.sorted_scores(inf["allowed_scores"]))} if inf["method"] != C.CLASSIFIER else {}
    out = scoring.predict(rows, scorer, config["prompt"]["system_prompt"], inf["binary_threshold"], inf["batch_size"], inf["method"], ids, tokenizer, [int(s) for s in inf["allowed_scores"]])
    path = f"{C.run_dir(config)}/predictions_{name}.parquet"
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def evaluate(spark: SparkSession, config: dict, name: str, path: str | None = None) -> dict:
    """Metrics, confusions, groups and baselines of saved predictions; files as reports, one row or table each."""
    run, threshold = C.run_dir(config), config["inference"]["binary_threshold"]
    p = tables.read_predictions(spark, path or f"{run}/predictions_{name}.parquet")
    edges = config["evaluation"].get("length_buckets")
    if edges and "response_token_length" in p.columns:
        p = p.withColumn("response_length_bucket", length_bucket(F.col("response_token_length"), edges))
    overall = metrics.all_metrics(p, threshold).first().asDict()
    documents.write_json(f"{run}/{name}_metrics.json", overall)
    for kind, labels in (("ordinal", [1, 2, 3, 4, 5]), ("binary", ["INCORRECT", "CORRECT"])):
        target, pred = ("target_score", "pred_score") if kind == "ordinal" else ("target_binary", "pred_binary")
        write_report(metrics.confusion(p, target, pred, labels).orderBy("target"), f"{run}/confusion_matrix_{kind}_{name}.csv", f"{run}/confusion_matrix_{kind}.csv")
    have = [c for c in GROUPS.values() if c in p.columns]
    grouped = metrics.metrics_by(p, have, threshold).cache()
    for g, c in GROUPS.items():
        if c in have:
            write_report(grouped.where(F.col("dimension") == c).drop("dimension").orderBy(F.asc_nulls_last("value")), f"{run}/{name}_per_{g}_metrics.csv", f"{run}/per_{g}_metrics.csv")
    grouped.unpersist()
    train, rows = (tables.read_split(spark, C.prepared_dir(config), s) for s in ("train", name))
    documents.write_json(f"{run}/majority_baseline_{name}.json", metrics.majority_binary(train, rows, threshold).first().asDict())
    documents.write_json(f"{run}/majority_ordinal_baseline_{name}.json", metrics.majority_ordinal(train, rows).first().asDict())
    return overall


def held_out_folds(spark: SparkSession, config: dict, tokenizer=None, scorer=None) -> list[dict]:
    """Prepare every model's fold in a folder of its own and, with a scorer, predict and evaluate its test.

    All folds are views of one table of measured rows: their cuts and their
    splits' counts come from a fixed number of jobs, whatever the models, and
    no row is copied. A fold that can't be made, as its model's rows were
    filtered away, is reported with its error.
    """
    tokenizer = tokens.chat_tokenizer(tokenizer, config)
    shared, s = f"{C.run_dir(config)}/lomo/measured", config["split"]
    funnel = _kept(spark, config, tokenizer, everything=True).write_to(shared)
    files = tables.listing(spark, config["data"]["path"])
    rows = spark.read.parquet(shared)
    kept = held(rows.where("stage = 3").select("model_id", "example_id"))
    cuts = splits.fold_cuts(kept, s["lomo_validation_fraction"], s["lomo_validation_max_examples"], s["lomo_validation_seed"]).collect()  # a row a model
    each = {}
    for r in splits.fold_counts(kept, cuts, s["lomo_validation_seed"]).collect() if cuts else []:  # a row a pair of models, as the reports have
        each.setdefault(r.fold, []).append(r)
    lengths = [r.asDict() for r in filters.length_statistics(rows.where("stage = 3")).collect()]
    found, out = {c.model_id: c for c in cuts}, []
    for model in splits.models_of(rows):
        c = C.copy_config(config)
        c["split"] |= {"mode": "leave_one_model_out", "held_out_model": model}
        c["project"]["output_dir"] = f"{C.run_dir(config)}/lomo/{model.replace('/', '_').replace(' ', '_')}"
        c["data"]["prepared_dir"] = None
        run, cut = C.run_dir(c), found.get(model)
        fold = {"model": model, "output_dir": run, "error": None if cut else f"nothing to train on, or no rows of {model}"}
        out.append(fold)
        if not cut:
            continue
        _settings(c, tokenizer)
        tables.remove(spark, C.prepared_dir(c))
        documents.write_json(f"{C.prepared_dir(c)}/{tables.FOLD}", {"shared": shared, "model": model, "rank": cut.rank, "key": cut.key, "seed": s["lomo_validation_seed"]})
        report = {"test": (cut.test, [model]), **{name: (sum(p[name] for p in each[model]), sorted(p.model_id for p in each[model] if p[name] and p.model_id is not None)) for name in ("train", "validation")}}
        documents.write_json(f"{run}/split_report.json", [{"split": n, "examples": report[n][0], "models": json.dumps(report[n][1], separators=(",", ":")), "num_models": len(report[n][1])} for n in splits.SPLITS])
        documents.write_json(f"{run}/dataset_filtering_report.json", funnel)
        documents.write_json(f"{run}/length_statistics.json", lengths)
        documents.write_json(f"{run}/prepared_fingerprint.json", fingerprint(spark, c, tokenizer, files))
        if scorer is not None:
            predict(spark, c, "test", scorer, tokenizer)
            fold["metrics"] = evaluate(spark, c, "test")
    return out


def debug_tokens(spark: SparkSession, config: dict, name: str, n: int = 3, tokenizer=None) -> list[str]:
    """Lines for the first n rows' tokens: place, SUP where supervised, id, text; also written to the run's folder."""
    shown = tokens.chat_tokenizer(tokenizer, config) or tokens.CodePoints()
    rows = tables.read_split(spark, C.prepared_dir(config), name).orderBy("example_id").limit(n)
    made = tokens.token_rows(rows, config["prompt"]["system_prompt"], "causal_lm", config["training"]["max_seq_length"], "skip", shown)
    found = tokens.token_debug(made).orderBy("example_id", "position").collect()  # n rows' tokens
    decode = getattr(getattr(shown, "inner", shown), "decode", lambda ids: "")
    lines = [f"{r.position:05d} {'SUP' if r.supervised else '   '} {r.token_id:>8d} {decode([r.token_id])!r}" for r in found]
    documents.write_text(f"{C.run_dir(config)}/token_supervision_debug.txt", "\n".join(lines) + "\n")
    return lines
