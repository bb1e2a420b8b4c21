"""Report tables as a sink that commits all or nothing.

Tasks write their rows as CSV parts under a name of their own attempt. On
commit the parts of the attempts that count are put together, in partition
order, next to each target and then renamed over it, so a reader finds the old
report or the new one. A job that fails leaves the old reports and removes its
parts. Several targets, such as a split's own name and the latest one, are
published together.
"""

from __future__ import annotations

import csv
import io
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "gradeweave_report"


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class ReportWriter(DataSourceWriter):
    def __init__(self, targets: list[str], columns: list[str]):
        self.targets, self.columns = targets, columns
        self.staging = f"{targets[0]}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        fs, folder = _fs(self.staging)
        fs.create_dir(folder, recursive=True)
        path = posixpath.join(folder, f"{partition}-{uuid.uuid4().hex}")
        with fs.open_output_stream(path) as out, io.TextIOWrapper(out, encoding="utf-8", newline="") as text:
            lines = csv.writer(text, lineterminator="\n")
            for row in iterator:
                lines.writerow(["" if v is None else v for v in row])
        return Part(partition, path)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(self.columns)
        ready = []
        for target in self.targets:
            fs, path = _fs(target)
            fs.create_dir(posixpath.dirname(path), recursive=True)
            made = f"{path}.{uuid.uuid4().hex}"
            with fs.open_output_stream(made) as out:
                out.write(head.getvalue().encode())
                for part in parts:
                    with fs.open_input_stream(part.path) as rows:
                        while block := rows.read(1 << 20):
                            out.write(block)
            ready.append((fs, made, path))
        for fs, made, path in ready:  # all are complete before any is published
            fs.move(made, path)
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, folder = _fs(self.staging)
        if fs.get_file_info(folder).type.name == "Directory":
            fs.delete_dir(folder)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(json.loads(self.options["targets"]), schema.fieldNames())


def write_report(df: DataFrame, *targets: str) -> None:
    """Publish ``df`` as one CSV at every target; sorted rows stay in order."""
    df.sparkSession.dataSource.register(ReportSource)
    df.write.format(NAME).mode("append").option("targets", json.dumps([str(t) for t in targets])).save()
