"""Tables in and out: source files, prepared splits, token rows, predictions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gradeweave.sources import documents


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_source(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A Parquet or CSV source by its suffix.

    CSV is read twice to find its types unless ``schema`` gives them, and a
    file is one task as long as values may hold line breaks (``multi_line``).
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unsupported source: {path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None, multiLine=multi_line, escape='"')


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once, its partitions and their order kept in ``spark.checkpoint.dir``, which executors share.

    Where that is unset, a session on one machine gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='gradeweave-')}")
    return df.checkpoint()


def listing(spark: SparkSession, path: str) -> list[list]:
    """[path, bytes, time] of each file below a path: names alone, no content is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def write_splits(df: DataFrame, path: str) -> None:
    """Rows with ``split``, a folder each; Spark deals them, so a large split makes many files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


#: In a prepared folder without rows of its own: the shared rows it is a view of, and by which rule.
FOLD = "fold.json"


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared rows with ``split``: a folder's own, or a fold's view of rows that folds share."""
    if not exists(spark, f"{path}/{FOLD}"):
        return spark.read.parquet(path)
    from gradeweave.operators.splits import fold_of

    rule = documents.read_json(f"{path}/{FOLD}")
    shared = spark.read.parquet(rule["shared"]).where("stage = 3").drop("stage")
    return fold_of(shared, rule["model"], Row(rank=rule["rank"], key=rule["key"]), rule["seed"])


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split: only its folder is read. An empty split has none."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: run prepare first")
    return read_prepared(spark, path).where(F.col("split") == split)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: run predict first")
    return spark.read.parquet(path)
