"""Configuration: overrides, defaults, validation. Driver-side dictionaries."""

from __future__ import annotations

import copy
import os
from collections.abc import Callable, Sequence

import yaml

from gradeweave.sources import documents

#: Allowed names of the configuration.
SECTIONS = ("project", "data", "model", "prompt", "split", "training", "inference")
OBJECTIVES = ("causal_lm", "restricted_score_ce", "sequence_classification")
FAST, PLAIN, CLASSIFIER = "restricted_continuation_logprobs_fast", "restricted_continuation_logprobs", "sequence_classification_logits"
ATTENTION = ("eager", "sdpa", "flash_attention_2", "flash_attention_3")
SAMPLING = ("random", "sequential", "group_by_length")
LOSSES = ("ce_5way", "ce_5way_plus_binary")
BALANCES = ("balanced", "inverse_frequency")
PRECISIONS = {"bf16": "bfloat16", "bfloat16": "bfloat16", "fp16": "float16", "float16": "float16", "half": "float16", "fp32": "float32", "float32": "float32", "float": "float32"}
STRATEGIES = ("ddp", "fsdp", "deepspeed")
BACKENDS = ("nccl", "gloo", "mpi", "xccl", "hccl", "cncl", "mccl")
SHARDINGS = ("full_shard", "shard_grad_op", "hybrid_shard", "hybrid_shard_zero2", "no_shard")
OFFLOADS = ("none", "cpu", "nvme")
SCORE_NAMES = ("1", "2", "3", "4", "5")

#: Defaults of keys that are left out.
DEFAULTS = {
    "data": {
        "preprocessing_num_workers": "auto", "tokenizers_parallelism": True, "token_length_batch_size": 512, "prepared_dir": None,
        "filters": {"max_disagreement": None, "max_response_tokens": None, "on_sequence_overflow": "skip"},
    },
    "model": {"attn_implementation": None, "thinking_mode": {"enabled": False, "apply_if_supported": True}},
    "training": {
        "train_sampling_strategy": "random", "objective": "causal_lm", "packing": False, "max_seq_length": 3072, "class_weighting": None, "score_class_weights": None,
        "loss": {"type": "ce_5way", "lambda_binary": 0.5, "class_weights": None}, "cache_tokenized_datasets": True,
        "eval_subset_size": None, "eval_subset_strategy": "stratified", "eval_subset_stratify_columns": ["model_id", "target_score"], "max_grad_norm": 1.0, "resume_from_checkpoint": None,
    },
    "distributed": {
        "enabled": False, "strategy": "ddp", "backend": "nccl", "mixed_precision": None, "gradient_checkpointing": False, "find_unused_parameters": False,
        "fsdp": {"sharding_strategy": "full_shard", "transformer_layer_cls_to_wrap": None, "activation_checkpointing": True, "use_orig_params": True},
        "deepspeed": {"zero_stage": 2, "offload_optimizer_device": "none", "offload_param_device": "none", "stage3_gather_16bit_weights_on_model_save": True, "gradient_clipping": "auto", "config_overrides": {}},
    },
    "inference": {"allowed_scores": list(SCORE_NAMES), "binary_threshold": 3, "batch_size": 1, "require_adapter": False, "allow_base_model": True},
    "split": {"lomo_validation_fraction": 0.05, "lomo_validation_max_examples": None, "test_models": [], "train_models": "auto_except_val_test"},
    "evaluation": {},
    "hub": {"repo_id": None, "private": False, "commit_message": "Upload distilled judge", "local_checkpoint_dir": None, "output_staging_dir": None, "create_pr": False, "max_shard_size": "5GB"},
}


def load_config(path: str, overrides: Sequence[str] = ()) -> dict:
    config = yaml.safe_load(documents.read_text(path)) or {}
    for o in overrides:
        apply_override(config, o)
    given = set(config)
    config = with_defaults(config)
    if missing := [s for s in SECTIONS if s not in given]:
        raise ValueError(f"missing sections: {missing}")
    validate(config)
    return config


def save_config(config: dict, path: str) -> None:
    documents.write_text(path, yaml.safe_dump(config, sort_keys=False))


def apply_override(config: dict, override: str) -> dict:
    """``a.b.c=value`` with the value as YAML; nodes on the way are made, or replaced if they are no mappings."""
    path, sign, value = override.partition("=")
    if not sign or not path:
        raise ValueError(f"override must be key=value: {override}")
    *nodes, last = path.split(".")
    at = config
    for n in nodes:
        if not isinstance(at.get(n), dict):
            at[n] = {}
        at = at[n]
    at[last] = yaml.safe_load(value)
    return config


def copy_config(config: dict) -> dict:
    return copy.deepcopy(config)


def precision(name) -> str:
    if name is None:
        return "auto"
    if str(name).lower() not in PRECISIONS:
        raise ValueError(f"precision: {name}")
    return PRECISIONS[str(name).lower()]


def short_precision(name) -> str | None:
    """bf16, fp16, fp32, or what else was given; null stays null."""
    if name is None:
        return None
    full = PRECISIONS.get(str(name).lower())
    return {"bfloat16": "bf16", "float16": "fp16", "float32": "fp32", None: str(name).lower()}[full]


def recursive_merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = recursive_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_defaults(config: dict) -> dict:
    """A copy with defaults; the objective decides the inference method."""
    given = copy_config(config)
    for section, values in DEFAULTS.items():  # a mapping that is given as null is one without keys
        part = given.get(section)
        if part is None:
            given[section] = part = {}
        if isinstance(part, dict):
            for k, v in values.items():
                if isinstance(v, dict) and k in part and part[k] is None:
                    part[k] = {}
    c = recursive_merge(copy_config(DEFAULTS), given)
    model, tr, inf, split = (c[s] for s in ("model", "training", "inference", "split"))
    if "name_or_path" in model:
        model.setdefault("model_name_or_path", model["name_or_path"])
    if tr.get("group_by_length") is True and "train_sampling_strategy" not in given["training"]:
        tr["train_sampling_strategy"] = "group_by_length"
    if "warmup_steps" not in tr:
        tr.setdefault("warmup_ratio", 0.0)
    seed = (c.get("project") or {}).get("seed", 42)
    tr.setdefault("eval_subset_seed", tr.get("seed", seed))
    split.setdefault("lomo_validation_seed", seed)
    if tr["objective"] == "sequence_classification":
        inf["method"] = CLASSIFIER
    elif inf.get("method", CLASSIFIER) == CLASSIFIER:
        inf["method"] = FAST
    return c


def _at(config: dict, path: str):
    found = config
    for name in path.split("."):
        if not isinstance(found, dict):
            raise ValueError(f"{path}: not a mapping")
        found = found.get(name)
    return found


def _one_of(*names) -> Callable:
    return lambda v: v in names


def _mapping(v) -> bool:
    return isinstance(v, dict)


def _five(v) -> bool:
    return isinstance(v, (list, tuple)) and len(v) == len(SCORE_NAMES)


def _layers(v) -> bool:
    return v is None or isinstance(v, str) or isinstance(v, list) and all(isinstance(x, str) for x in v)


#: What each key may hold, mappings before their keys; and how to say so.
RULES: tuple[tuple[str, Callable, str], ...] = (
    ("model.model_name_or_path", bool, "must be given"),
    ("model.attn_implementation", _one_of(None, *ATTENTION), "null or one of " + ", ".join(ATTENTION)),
    ("model.thinking_mode", _mapping, "a mapping"),
    ("model.thinking_mode.enabled", lambda v: v is None or isinstance(v, bool), "true, false or null"),
    ("model.thinking_mode.apply_if_supported", lambda v: isinstance(v, bool), "true or false"),
    ("training.objective", _one_of(*OBJECTIVES), "one of " + ", ".join(OBJECTIVES)),
    ("training.loss", _mapping, "a mapping"),
    ("training.loss.type", _one_of(*LOSSES), "one of " + ", ".join(LOSSES)),
    ("training.loss.lambda_binary", lambda v: float(v) >= 0, "not negative"),
    ("training.loss.class_weights", lambda v: v is None or v in BALANCES if not isinstance(v, list) else _five(v), "null, five values, balanced or inverse_frequency"),
    ("training.class_weighting", _one_of(None, "inverse_frequency"), "null or inverse_frequency"),
    ("training.score_class_weights", lambda v: v is None or _five(v), "five values"),
    ("training.eval_subset_strategy", _one_of("random", "stratified"), "random or stratified"),
    ("training.eval_subset_stratify_columns", lambda v: isinstance(v, list) and bool(v), "a list with a column at least"),
    ("training.train_sampling_strategy", _one_of(*SAMPLING), "one of " + ", ".join(SAMPLING)),
    ("training.warmup_steps", lambda v: v is None or int(v) >= 0, "not negative"),
    ("training.warmup_ratio", lambda v: v is None or 0 <= float(v) <= 1, "in [0, 1]"),
    ("data.preprocessing_num_workers", lambda v: bool(workers(v)), "a number, 0, -1, auto or all"),
    ("data.filters.on_sequence_overflow", _one_of("skip", "error"), "skip or error"),
    ("inference.method", _one_of(FAST, PLAIN, CLASSIFIER), f"one of {FAST}, {PLAIN}, {CLASSIFIER}"),
    ("inference.batch_size", lambda v: int(v) >= 1, "1 or more"),
    ("inference.allowed_scores", lambda v: {str(x) for x in v} == set(SCORE_NAMES), "1 to 5, each"),
    ("split.mode", _one_of("fixed_by_model", "leave_one_model_out"), "fixed_by_model or leave_one_model_out"),
    ("split.lomo_validation_fraction", lambda v: 0 < float(v) < 1, "in (0, 1)"),
    ("distributed.strategy", _one_of(*STRATEGIES), "one of " + ", ".join(STRATEGIES)),
    ("distributed.backend", _one_of(*BACKENDS), "one of " + ", ".join(BACKENDS)),
    ("distributed.mixed_precision", lambda v: short_precision(v) in (None, "no", "bf16", "fp16"), "null, no, bf16 or fp16"),
    ("distributed.fsdp", _mapping, "a mapping"),
    ("distributed.fsdp.sharding_strategy", _one_of(*SHARDINGS), "one of " + ", ".join(SHARDINGS)),
    ("distributed.fsdp.transformer_layer_cls_to_wrap", _layers, "null, a name or names"),
    ("distributed.deepspeed", _mapping, "a mapping"),
    ("distributed.deepspeed.zero_stage", lambda v: int(v) in (1, 2, 3), "1, 2 or 3"),
    ("distributed.deepspeed.offload_optimizer_device", _one_of(*OFFLOADS), "none, cpu or nvme"),
    ("distributed.deepspeed.offload_param_device", _one_of(*OFFLOADS), "none, cpu or nvme"),
    ("distributed.deepspeed.config_overrides", _mapping, "a mapping"),
)


def validate(config: dict) -> None:
    if missing := [s for s in SECTIONS if s not in config]:
        raise ValueError(f"missing sections: {missing}")
    for path, holds, rule in RULES:
        value = _at(config, path)
        try:
            ok = holds(value)
        except (TypeError, ValueError):
            ok = False
        if not ok:
            raise ValueError(f"{path} must be {rule}: {value!r}")
    tr = config["training"]
    if tr["packing"] and tr["objective"] != "causal_lm":
        raise ValueError("training.packing is for causal_lm only")
    validate_distributed(config)


def validate_distributed(config: dict) -> None:
    """What distributed settings and the others must agree on."""
    d, tr = config["distributed"], config["training"]
    mixed = short_precision(d["mixed_precision"])
    if mixed not in (None, "no") and mixed != short_precision(tr.get("dtype")):
        raise ValueError("distributed.mixed_precision must be that of training.dtype")
    if not d["enabled"]:
        return
    if d["strategy"] == "fsdp" and d["gradient_checkpointing"] and d["fsdp"].get("activation_checkpointing", True):
        raise ValueError("either distributed.gradient_checkpointing or distributed.fsdp.activation_checkpointing, not both")
    if d["strategy"] != "ddp" and tr.get("load_in_4bit", True):
        raise ValueError("4-bit models train on one device or with ddp: set training.load_in_4bit to false")


def workers(value, default: int = 1) -> int:
    """A number of workers: auto, all, -1, 0 and below mean every CPU."""
    if value is None:
        return default
    if isinstance(value, str) and not value.strip().lstrip("-").isdigit():
        if value.strip().lower() not in ("auto", "all"):
            raise ValueError(f"workers: {value}")
        return cpus()
    return int(value) if int(value) >= 1 else cpus()


def cpus() -> int:
    return len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else os.cpu_count() or 1


def executor_environment() -> dict[str, str]:
    """Settings that keep native tokenizer threads off where Spark runs the tasks."""
    return {"spark.executorEnv.TOKENIZERS_PARALLELISM": "false", "spark.executorEnv.RAYON_NUM_THREADS": "1"}


def record_settings(config: dict) -> dict:
    """Settings of record scoring, with defaults."""
    inf, model = config.get("inference") or {}, config.get("model") or {}
    return {
        "system_prompt": (config.get("prompt") or {}).get("system_prompt", ""), "allowed_scores": sorted(map(str, inf.get("allowed_scores", SCORE_NAMES)), key=int),
        "binary_threshold": int(inf.get("binary_threshold", 3)), "thinking_mode": model.get("thinking_mode") or {"enabled": False, "apply_if_supported": True},
    }


def run_dir(config: dict) -> str:
    return config["project"]["output_dir"]


def prepared_dir(config: dict) -> str:
    return config["data"].get("prepared_dir") or os.path.join(run_dir(config), "prepared")
