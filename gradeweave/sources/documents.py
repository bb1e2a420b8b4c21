"""Small documents on the driver: JSON, fingerprints, logs."""

from __future__ import annotations

import contextlib
import json
import os
import sys
from pathlib import Path


def jsonable(data):
    """Values as JSON takes them: keys as strings, tuples as lists, sets sorted, paths as strings, numpy scalars as Python's."""
    if isinstance(data, dict):
        return {str(k): jsonable(v) for k, v in data.items()}
    if isinstance(data, (list, tuple)):
        return [jsonable(x) for x in data]
    if isinstance(data, (set, frozenset)):
        return sorted(jsonable(x) for x in data)
    if isinstance(data, Path):
        return str(data)
    if hasattr(data, "asDict"):
        return jsonable(data.asDict(recursive=True))
    return data.item() if hasattr(data, "item") else data


def _hadoop(path: str):
    """(file system, path) of Hadoop where the path is a URI; none for local paths."""
    if "://" not in path and not path.startswith("file:"):
        return None
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} needs a Spark session")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(path, text: str) -> None:
    """A small document, in any file system that Spark knows."""
    if found := _hadoop(str(path)):
        fs, p = found
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        return
    os.makedirs(os.path.dirname(str(path)) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def read_text(path) -> str:
    if found := _hadoop(str(path)):
        fs, p = found
        stream = fs.open(p)
        data = bytes(stream.readAllBytes())
        stream.close()
        return data.decode()
    with open(path, encoding="utf-8") as f:
        return f.read()


def exists(path) -> bool:
    found = _hadoop(str(path))
    return found[0].exists(found[1]) if found else os.path.exists(path)


def write_json(path, data) -> None:
    write_text(path, json.dumps(jsonable(data), indent=2, sort_keys=True))


def read_json(path):
    return json.loads(read_text(path))


class _Both:
    def __init__(self, *streams):
        self.streams = streams

    def write(self, text):
        for s in self.streams:
            s.write(text)
        return len(text)

    def flush(self):
        for s in self.streams:
            s.flush()


@contextlib.contextmanager
def mirrored_output(path, mode: str = "w"):
    """Standard output and error also go to a file."""
    os.makedirs(os.path.dirname(str(path)) or ".", exist_ok=True)
    with open(path, mode, encoding="utf-8") as f, contextlib.redirect_stdout(_Both(sys.stdout, f)), contextlib.redirect_stderr(_Both(sys.stderr, f)):
        yield
