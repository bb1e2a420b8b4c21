"""Command line: prepare, predict, evaluate, debug-tokenization, lomo, train (the data half)."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession

from gradeweave.operators import splits
from gradeweave.plans import config as C
from gradeweave.plans import pipeline
from gradeweave.sources import documents


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gradeweave")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *more):
        s = sub.add_parser(name)
        s.add_argument("-c", "--config", required=True)
        s.add_argument("-o", "--override", action="append", default=[])
        for flags, options in more:
            s.add_argument(*flags, **options)

    every, held = {"default": "validation", "choices": ["train", "validation", "test"]}, {"default": "validation", "choices": ["validation", "test"]}
    add("prepare")
    add("train", (["--force-prepare"], {"action": "store_true"}), (["--finalist"], {"action": "store_true"}))
    add("predict", (["-s", "--split"], every), (["--scorer"], {"required": True, "help": "module:function that makes a scorer"}))
    add("evaluate", (["-s", "--split"], held), (["-p", "--predictions"], {"default": None}))
    add("debug-tokenization", (["-s", "--split"], {**every, "default": "train"}), (["-n", "--num-examples"], {"type": int, "default": 3}))
    add("lomo", (["--prepare-only"], {"action": "store_true"}), (["--scorer"], {"default": None, "help": "module:function that makes a scorer"}))
    return p


def shown_splits(prepared) -> str:
    """Rows and models of each split, a line each."""
    rows = splits.split_report(prepared).collect()
    return "\n".join(["split       examples  models", *(f"{r.split:<11} {r.examples:>8}  {r.num_models:>6}" for r in rows)])


def shown_metrics(found: dict) -> str:
    """Metrics by name, a line each; numbers with six digits."""
    return "\n".join(f"{k:<36} {v:.6f}" if isinstance(v, float) else f"{k:<36} {v}" for k, v in sorted(found.items()))


def _named(spec: str):
    """module:name"""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    config = C.load_config(a.config, a.override)
    builder = SparkSession.builder.appName("gradeweave")
    for k, v in C.executor_environment().items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    print(f"{config['project'].get('run_name', 'run')}: {a.command} in {C.run_dir(config)}")
    if a.command == "prepare":
        print(shown_splits(pipeline.prepare(spark, config, force=True)))
    elif a.command == "train":
        done = pipeline.prepare(spark, config, force=a.force_prepare)
        print(json.dumps(pipeline.train_data(spark, config, done, a.finalist), indent=2))
    elif a.command == "predict":
        pipeline.predict(spark, config, a.split, _named(a.scorer))
    elif a.command == "evaluate":
        print(shown_metrics(documents.jsonable(pipeline.evaluate(spark, config, a.split, a.predictions))))
    elif a.command == "debug-tokenization":
        print("\n".join(pipeline.debug_tokens(spark, config, a.split, a.num_examples)))
    else:
        for fold in pipeline.held_out_folds(spark, config, scorer=_named(a.scorer) if a.scorer and not a.prepare_only else None):
            print(json.dumps(documents.jsonable(fold)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
