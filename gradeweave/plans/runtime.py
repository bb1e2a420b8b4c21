"""The process a driver function runs in: ranks, versions, seeds."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from importlib import metadata

#: Packages whose versions a run records.
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "tokenizers", "transformers", "torch", "datasets", "peft", "accelerate")


def env_int(name: str, default: int) -> int:
    """An integer of the environment; the default where it is unset, empty or no integer."""
    try:
        return int(os.environ.get(name, ""))
    except ValueError:
        return default


def rank() -> int:
    return env_int("RANK", 0)


def local_rank() -> int:
    return env_int("LOCAL_RANK", 0)


def world_size() -> int:
    return max(1, env_int("WORLD_SIZE", 1))


def is_distributed() -> bool:
    return world_size() > 1


def is_main_process() -> bool:
    return rank() == 0


def git_commit(folder: str | None = None) -> str | None:
    """The commit that is checked out; none outside a repository."""
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def package_versions() -> dict[str, str | None]:
    """Versions by package, null where one isn't installed; and Python's."""
    out: dict[str, str | None] = {"python": sys.version.split()[0]}
    for name in PACKAGES:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = None
    return out


def set_seed(seed: int) -> None:
    """Seed the driver's generators. Samples in Spark take their seed as an argument."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    os.environ["PYTHONHASHSEED"] = str(seed)
