"""One named CSV file for a table: a Spark data source whose tasks write parts and whose commit joins them."""

from __future__ import annotations

import csv
import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 20
#: Rows that a task turns into text at once.
ROWS_AT_ONCE = 10_000


def opened(path: str) -> tuple:
    """The file system of a path or URI, by Arrow, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class NamedCsvWriter(DataSourceWriter):
    """Parts go to a folder beside the target, each task attempt's under a name of its own.

    The commit joins the parts that Spark accepted, in the order of their
    partitions, in chunks of a mebibyte, and moves the result to its name in
    one step; parts of failed or doubled attempts are never read. Commit and
    abort both remove the folder, so a failed job leaves the target as it was.
    Tasks never make the folder: one that still runs after an abort finds none.
    """

    def __init__(self, path: str, columns: list[str], quote_all: bool):
        self.target, self.columns, self.quote_all = path, columns, quote_all
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def _lines(self, rows: list[list], every: bool) -> bytes:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL if every else csv.QUOTE_MINIMAL, lineterminator="\n").writerows(rows)
        return out.getvalue().encode()

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyarrow import fs

        files, folder = opened(self.folder)
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            raise RuntimeError(f"the job that writes {self.target} has ended")
        partition, rows, waiting = TaskContext.get().partitionId(), 0, []
        path = posixpath.join(folder, f"{partition:06}-{uuid.uuid4().hex}")
        with files.open_output_stream(path) as out:
            for row in iterator:
                waiting.append(["" if v is None else v for v in row])
                if len(waiting) == ROWS_AT_ONCE:
                    out.write(self._lines(waiting, self.quote_all))
                    rows, waiting = rows + len(waiting), []
            out.write(self._lines(waiting, self.quote_all))
        return Part(partition, path, rows + len(waiting))

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = opened(self.folder)
        try:
            whole = posixpath.join(folder, "whole")
            with files.open_output_stream(whole) as out:
                out.write(self._lines([self.columns], False))
                for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                    with files.open_input_stream(part.path) as held:
                        while chunk := held.read(CHUNK):
                            out.write(chunk)
            files.move(whole, opened(self.target)[1])
        finally:
            files.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        files, folder = opened(self.folder)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class NamedCsv(DataSource):
    """``df.write.format("named_csv").option("path", "out/table.csv").mode("overwrite").save()``; option ``quote`` is ``minimal`` or ``all``."""

    @classmethod
    def name(cls) -> str:
        return "named_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a named file is written with mode overwrite")
        made = NamedCsvWriter(self.options["path"], schema.fieldNames(), self.options.get("quote", "minimal") == "all")
        files, folder = opened(made.folder)
        files.create_dir(folder, recursive=True)
        return made


def write_named(df: DataFrame, path: str, quote: str = "minimal") -> None:
    """``df`` as the one CSV file ``path``, in its order of rows, with a header; nulls are empty fields.

    The folder of ``path`` is one that driver and executors share. A file that
    has the name is replaced once the new one is whole.
    """
    df.sparkSession.dataSource.register(NamedCsv)
    df.write.format("named_csv").option("path", path).option("quote", quote).mode("overwrite").save()
