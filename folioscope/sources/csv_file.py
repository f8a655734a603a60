"""One CSV file, in the order of the rows, as spreadsheet programs read it: a byte order mark, CRLF, and quotes only where they are needed."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

MARK, END, CHUNK = b"\xef\xbb\xbf", "\r\n", 4 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _cell(value: str | None, separator: str) -> str:
    if value is None:
        return ""
    if any(c in value for c in (separator, '"', "\r", "\n")):
        return '"' + value.replace('"', '""') + '"'
    return value


@dataclass
class Written(WriterCommitMessage):
    """A task's part: its place in the order, and its file (none: no rows)."""

    place: int
    file: str | None


class CsvWriter(DataSourceWriter):
    """Each task writes a part of its own beside the target; the commit puts them together in the order of the partitions.

    Parts have names that no other attempt has, so a task that is run twice leaves one part that counts. The target appears by a rename when it is whole;
    an error removes all parts and leaves what was there before.
    """

    def __init__(self, path: str, columns: list[str], separator: str, header: bool, overwrite: bool):
        self.path, self.columns, self.separator, self.header, self.overwrite = path, columns, separator, header, overwrite
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        place, (store, folder) = TaskContext.get().partitionId(), _store(self.parts)
        first = next(iterator, None)
        if first is None:
            return Written(place, None)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/{place:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out:
            for row in (first, *()):
                out.write(self._line(row))
            for row in iterator:
                out.write(self._line(row))
        return Written(place, name)

    def _line(self, row) -> bytes:
        return (self.separator.join(_cell(v, self.separator) for v in row) + END).encode()

    def commit(self, messages: list[Written | None]) -> None:
        store, target = _store(self.path)
        if not self.overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        whole = f"{target}.whole-{uuid.uuid4().hex}"
        try:
            with store.open_output_stream(whole) as out:
                out.write(MARK)
                if self.header:
                    out.write(self._line(self.columns))
                for part in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.place):
                    with store.open_input_stream(part.file) as data:
                        while chunk := data.read(CHUNK):
                            out.write(chunk)
            store.move(whole, target)
        except BaseException:
            with contextlib.suppress(OSError):
                store.delete_file(whole)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.parts)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class OrderedCsv(DataSource):
    """Write-only: ``df.write.format("ordered_csv").mode(...).save(path)`` of string columns, as ``write_csv`` does."""

    @classmethod
    def name(cls) -> str:
        return "ordered_csv"

    def schema(self) -> StructType:
        raise NotImplementedError("ordered_csv is only written; read the file as csv")

    def writer(self, schema: StructType, overwrite: bool) -> CsvWriter:
        if not all(isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError("all columns have to be text")
        o = self.options
        return CsvWriter(o["path"], schema.names, o.get("separator", ";"), o.get("header", "true").lower() == "true", overwrite)


def write_csv(rows: DataFrame, path: str, order: list[Column | str], separator: str = ";", header: bool = True, overwrite: bool = False) -> None:
    """Writes rows, sorted by ``order``, as one file at ``path``, a path or URI that the driver and all tasks reach.

    Null is nothing, and other values are as Spark casts them to text. Ties in ``order`` stay in no order of their own, so end it in a unique
    column. Tasks write in parallel; the driver only copies their parts, a few megabytes at a time. Without ``overwrite`` an existing file is an error.
    """
    rows.sparkSession.dataSource.register(OrderedCsv)
    text = rows.orderBy(*order).select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    text.write.format("ordered_csv").option("separator", separator).option("header", str(header).lower()).mode("overwrite" if overwrite else "append").save(path)
