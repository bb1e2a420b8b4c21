"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that part words, and the pattern of a word.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

#: Text bytes that a Python function holds at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (single-machine sessions only) one is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gradeweave-')}"
        sc.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that this driver has named, by application.
_made: dict[str, list[str]] = {}


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the tables and files that operators have written to the shared folder so far.

    To be called once their results are written elsewhere: DataFrames that
    operators returned read these files.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs only a reread) and gives the
    planner the true size of the table for its broadcast decisions.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to a Python worker, and the session's setting for it.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in small batches; workers give back the memory they freed when a task ends.

    Both the executor and its worker hold whole batches, so the session's
    limit is lowered to ``BATCH_BYTES``; a lower one stays.
    """
    conf = df.sparkSession.conf
    if _bytes(conf.get(_BATCH_SETTING)) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")

    names = df.columns
    odd = any("." in n or "`" in n for n in names)  # mapInArrow would look these up as fields

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run((b.rename_columns(names) for b in batches) if odd else batches)
        finally:
            give_back()

    return (df.toDF(*(f"_{i}" for i in range(len(names)))) if odd else df).mapInArrow(tidy, schema)


def _bytes(text: str) -> int:
    number = text.strip().lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(number[-1:], 1)
    return int(number.rstrip("kmg")) * unit


def give_back() -> None:
    """Return freed memory to the system: idle workers otherwise keep it for the application's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def open_fs(uri: str):
    """(pyarrow filesystem, path in it) for a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data) -> None:
    """Write one file; the name must be new for each task attempt."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def read_buffer(uri: str) -> memoryview:
    """The file's bytes: memory-mapped where the store is a mounted folder."""
    fs, path = open_fs(uri)
    if fs.type_name == "local":
        if os.path.getsize(path) == 0:
            return memoryview(b"")
        with pa.memory_map(path) as f:
            return memoryview(f.read_buffer())
    with fs.open_input_file(path) as f:
        return memoryview(f.read_buffer())


def attempt_name() -> str:
    """Unique for each attempt of each task, so retries never share a file."""
    return uuid.uuid4().hex


def rows_by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Slices of ``batch``, about even, with some ``limit`` bytes in ``column`` at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    end = np.cumsum(size)
    limit = -(-int(end[-1]) // max(1, -(-int(end[-1]) // limit))) if len(end) else limit
    at = 0
    while at < len(size):
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words_col(text):
    """Array of the words of a text column; null counts as no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACES}]+"), lambda w: w != "")


def n_words_col(text):
    """Number of words of a text column; null counts as 0."""
    return F.size(words_col(text)).cast("long")


def ascii_lower(c):
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
