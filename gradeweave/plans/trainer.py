"""What an external trainer is given: arguments, steps, metadata. Driver-side dictionaries."""

from __future__ import annotations

import importlib.util
import os

from gradeweave.operators.training import global_batch, optimisation_steps
from gradeweave.operators.training import warmup_steps as share_of_steps
from gradeweave.plans.config import recursive_merge, short_precision
from gradeweave.plans.runtime import is_main_process

#: Settings that go to the trainer under their own names, and how they are read.
PASSED = {
    "num_train_epochs": float, "per_device_train_batch_size": int, "per_device_eval_batch_size": int, "gradient_accumulation_steps": int, "learning_rate": float, "lr_scheduler_type": str,
    "weight_decay": float, "optim": str, "logging_steps": int, "save_steps": int, "save_total_limit": int, "max_grad_norm": float,
}
#: The environment by which a launcher is known, in this order.
LAUNCHERS = (("ACCELERATE_USE_FSDP", "accelerate"), ("ACCELERATE_USE_DEEPSPEED", "accelerate"), ("ACCELERATE_MIXED_PRECISION", "accelerate"), ("TORCHELASTIC_RUN_ID", "torchrun"), ("SLURM_JOB_ID", "slurm"))


def total_steps(examples: int, config: dict, world_size: int = 1) -> int:
    tr = config["training"]
    batch, accumulation = int(tr["per_device_train_batch_size"]), int(tr["gradient_accumulation_steps"])
    for name, value in (("per_device_train_batch_size", batch), ("gradient_accumulation_steps", accumulation)):
        if value < 1:
            raise ValueError(f"training.{name} must be 1 or more")
    return optimisation_steps(examples, batch, accumulation, float(tr["num_train_epochs"]), max(1, world_size)) if examples > 0 else 0


def resolved_warmup(examples: int, config: dict, world_size: int = 1) -> int:
    """Steps that are given, also 0; else the ratio of all steps, rounded up."""
    tr = config["training"]
    if "warmup_steps" in tr and tr["warmup_steps"] is not None:
        return int(tr["warmup_steps"])
    return share_of_steps(total_steps(examples, config, world_size), float(tr.get("warmup_ratio") or 0.0))


def warmup_metadata(config: dict, examples: int, world_size: int = 1) -> dict:
    return {"warmup_ratio": config["training"].get("warmup_ratio"), "warmup_steps": resolved_warmup(examples, config, world_size), "total_optimization_steps": total_steps(examples, config, world_size)}


def set_warmup(arguments, metadata: dict) -> None:
    """Write the steps into the trainer's arguments, an object or a mapping."""
    steps = int(metadata["warmup_steps"])
    if isinstance(arguments, dict):
        arguments["warmup_steps"] = steps
    else:
        arguments.warmup_steps = steps


def deepspeed_settings(config: dict) -> dict:
    d = config["distributed"]["deepspeed"]
    stage = int(d["zero_stage"])
    zero: dict = {"stage": stage}
    for part in ("optimizer", "param"):
        if (device := d[f"offload_{part}_device"]) != "none":
            zero[f"offload_{part}"] = {"device": device}
    if stage == 3:
        zero["stage3_gather_16bit_weights_on_model_save"] = bool(d["stage3_gather_16bit_weights_on_model_save"])
    auto = {k: "auto" for k in ("gradient_accumulation_steps", "train_micro_batch_size_per_gpu", "train_batch_size")}
    made = {"bf16": {"enabled": "auto"}, "fp16": {"enabled": "auto"}, "zero_optimization": zero, **auto, "gradient_clipping": d["gradient_clipping"]}
    return recursive_merge(made, d["config_overrides"])


def _fsdp_arguments(d: dict) -> dict:
    layers = d.get("transformer_layer_cls_to_wrap")
    settings = {k: bool(d[k]) for k in ("activation_checkpointing", "use_orig_params")}
    if layers:
        settings["transformer_layer_cls_to_wrap"] = layers
    return {"fsdp": d["sharding_strategy"] + (" auto_wrap" if layers else ""), "fsdp_config": settings}


def distributed_arguments(config: dict) -> dict:
    """The strategy's arguments; none where training isn't distributed."""
    d = config["distributed"]
    if not d["enabled"]:
        return {}
    out = {"gradient_checkpointing": True} if d["gradient_checkpointing"] else {}
    if d["strategy"] == "ddp":
        return out | {"ddp_backend": d["backend"], "ddp_find_unused_parameters": bool(d["find_unused_parameters"])}
    if d["strategy"] == "fsdp":
        return out | _fsdp_arguments(d["fsdp"])
    if importlib.util.find_spec("deepspeed") is None:
        raise ImportError("distributed.strategy is deepspeed, and deepspeed is not installed")
    return out | {"deepspeed": deepspeed_settings(config)}


def trainer_arguments(config: dict, output_dir: str, examples: int | None = None, world_size: int = 1, evaluated: bool = True) -> dict:
    """All arguments of an external trainer."""
    tr = config["training"]
    given = short_precision(tr.get("dtype"))
    out = {k: read(tr[k]) for k, read in PASSED.items() if k in tr}
    out |= {
        "output_dir": os.path.join(output_dir, "checkpoints"), "save_strategy": "steps", "eval_strategy": "steps" if evaluated else "no", "train_sampling_strategy": tr["train_sampling_strategy"],
        "length_column_name": tr.get("length_column_name", "length"), "remove_unused_columns": False, "report_to": [], "seed": int(tr.get("seed", config["project"].get("seed", 42))),
        "bf16": given == "bf16", "fp16": given == "fp16",
    }
    if evaluated and "eval_steps" in tr:
        out["eval_steps"] = int(tr["eval_steps"])
    explicit = tr.get("warmup_steps") is not None
    if not explicit and "warmup_ratio" in tr:
        out["warmup_ratio"] = float(tr["warmup_ratio"])
    if explicit or examples is not None:
        out["warmup_steps"] = resolved_warmup(examples or 0, config, world_size)
    if config["distributed"]["enabled"]:
        out |= {"disable_tqdm": not is_main_process(), "log_on_each_node": False}
    return out | distributed_arguments(config)


def launcher() -> str:
    """By whom this process was started."""
    for name, who in LAUNCHERS:
        if os.environ.get(name):
            return who
    return "distributed" if "LOCAL_RANK" in os.environ else "single_process"


def runtime_metadata(config: dict, world_size: int = 1) -> dict:
    """What a run's record says of its devices and batches."""
    d, tr = config["distributed"], config["training"]
    batch, accumulation = int(tr["per_device_train_batch_size"]), int(tr["gradient_accumulation_steps"])
    kept = ("enabled", "strategy", "backend", "mixed_precision", "gradient_checkpointing", "find_unused_parameters", "fsdp", "deepspeed")
    return {k: d.get(k) for k in kept} | {
        "world_size": world_size, "launcher": launcher(), "per_device_train_batch_size": batch, "gradient_accumulation_steps": accumulation, "effective_global_batch_size": global_batch(batch, accumulation, world_size),
    }
