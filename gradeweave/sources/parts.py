"""Rows derived from others and kept by source file: only files that changed are derived again.

A unit is a source file with the content that its rows have now: their number
and the sum of their hashes. Each generation writes the units that no earlier
one has, a folder each, and then its manifest; one without a manifest is of a
job that failed, and doesn't count. The driver holds a row a source file, as it
does to list the source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.sources import documents
from gradeweave.sources.tables import exists, listing, remove

#: The column of prepared rows that names the file they came from.
SOURCE_FILE = "source_file"


def units(rows: DataFrame) -> DataFrame:
    """source_file, unit: each file's rows as a digest that any order of rows gives; rows without a file are one unit."""
    content = [F.col(f"`{c}`") for c in sorted(rows.columns) if c != SOURCE_FILE]
    each = rows.groupBy(SOURCE_FILE).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*content).cast("decimal(38,0)")).alias("h"))
    return each.select(SOURCE_FILE, F.md5(F.concat_ws("|", F.coalesce(SOURCE_FILE, F.lit("")), F.col("n").cast("string"), F.col("h").cast("string"))).alias("unit"))


def derived(rows: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], again: bool = False) -> tuple[DataFrame, list[str]]:
    """``make(rows)`` from the folder, and the units it consists of.

    ``make`` gets rows of whole files with a column ``unit``, which its result
    must keep; it derives each row by itself. ``again`` derives all, as does a
    folder with files that can't be read. Folders of units that are gone are
    removed.
    """
    spark = rows.sparkSession
    if SOURCE_FILE not in rows.columns:
        rows = rows.withColumn(SOURCE_FILE, F.lit(None).cast("string"))
    if again:
        remove(spark, folder)
    now = {r.unit: r[SOURCE_FILE] for r in units(rows).collect()}  # a row a source file
    for last in (False, True):
        have = _manifests(spark, folder)
        missing = {u: f for u, f in now.items() if u not in have}
        if missing:
            have |= _generation(rows, missing, folder, make)
        paths = [f"{have[u]}/rows/unit={u}" for u in sorted(now) if have[u]]
        try:
            kept = spark.read.parquet(*paths) if paths else spark.createDataFrame([], make(rows.limit(0).withColumn("unit", F.lit(""))).drop("unit").schema)
            kept.count()  # reads every file's footer
            break
        except Exception:  # a file is damaged or gone
            if last:
                raise
            for path in paths:
                spark.catalog.refreshByPath(path)
            remove(spark, folder)
    for u, generation in have.items():
        if u not in now and generation:
            remove(spark, f"{generation}/rows/unit={u}")
    return kept, sorted(now)


def _manifests(spark: SparkSession, folder: str) -> dict[str, str | None]:
    """Each unit that generations have, with its generation's folder; none if the unit has no rows."""
    out: dict[str, str | None] = {}
    if not exists(spark, folder):
        return out
    files = [f for f, *_ in listing(spark, folder)]
    there = {tuple(f.split("/")[-4:-1]) for f in files if f.endswith(".parquet")}
    for f in files:
        if f.endswith("/units.json"):
            name = f.split("/")[-2]
            for unit, filled in documents.read_json(f"{folder}/{name}/units.json").items():
                if not filled:
                    out.setdefault(unit, None)
                elif (name, "rows", f"unit={unit}") in there:
                    out[unit] = f"{folder}/{name}"
    return out


def _generation(rows: DataFrame, missing: dict[str, str | None], folder: str, make: Callable[[DataFrame], DataFrame]) -> dict[str, str | None]:
    spark, path = rows.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    wanted = spark.createDataFrame([(f, u) for u, f in missing.items()], "__file string, unit string")
    mine = rows.join(wanted, F.col(SOURCE_FILE).eqNullSafe(F.col("__file"))).drop("__file")
    make(mine).write.partitionBy("unit").parquet(f"{path}/rows")
    filled = {f.split("/")[-2].removeprefix("unit=") for f, *_ in listing(spark, f"{path}/rows") if f.endswith(".parquet")}
    documents.write_json(f"{path}/units.json", {u: u in filled for u in missing})
    return {u: path if u in filled else None for u in missing}
