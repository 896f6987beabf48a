"""Spark data sources: core dumps read by ranges, one file for each report, and one SARIF document.

Paths are local ones or URIs of a file system that pyarrow knows; they must be shared by the driver and all executors. Writers work in two
phases: tasks write below a folder that readers pass over, and the driver's commit moves what is whole to its place; a failed write leaves nothing.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .elf import core_of

#: Files of one task, and bytes that are copied at a time.
FILES, CHUNK = 64, 8 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class CoreDumps(DataSource):
    """``spark.read.format("core_dumps").load(folder)``: (path, size, arch, endianness, width, cmdline, error) of each file below a folder.

    Options: ``glob``, an expression that names must match from the beginning, and ``files``, how many files a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "core_dumps"

    def schema(self) -> str:
        return "path string, size long, arch string, endianness string, width int, cmdline string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _CoreReader(self.options)


@dataclass
class _Files(InputPartition):
    paths: list[tuple[str, int]]


class _CoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.names, self.files = options["path"], options.get("glob", ""), int(options.get("files", FILES))

    def partitions(self) -> list[InputPartition]:
        """Files are listed by their names and sizes; none is opened here."""
        system, top = _at(self.path)
        found = [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and re.match(self.names, f.base_name)]
        return [_Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _at(self.path)
        for path, size in partition.paths:
            try:
                with system.open_input_file(path) as file:

                    def fetch(at: int, length: int) -> bytes:
                        return file.read_at(max(0, min(length, size - at)), at) if at < size else b""

                    yield (path, size, *core_of(fetch), None)
            except (OSError, ValueError, struct.error) as e:
                yield (path, size, None, None, None, None, str(e))


@dataclass
class _Piece(WriterCommitMessage):
    #: What a task has written, and the place of its first row in the whole.
    folder: str
    first: tuple | None
    rows: int


class _TwoPhases(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.options = options["path"].rstrip("/"), overwrite, options
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def piece(self) -> tuple[fs.FileSystem, str]:
        """A folder of its own for each attempt of a task."""
        system, top = _at(self.staging)
        folder = f"{top}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        return system, folder

    def abort(self, messages: list) -> None:
        system, top = _at(self.staging)
        if system.get_file_info(top).type == fs.FileType.Directory:
            system.delete_dir(top)


class ReportFiles(DataSource):
    """``df.write.format("report_files").save(folder)``: rows (name, report) as one file each, below a folder for each task.

    ``name`` is the file's name and ``report`` its text. Two rows of one name in a task, or names that aren't those of files, fail the write.
    """

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ReportWriter(self.options, overwrite)


class _ReportWriter(_TwoPhases):
    def write(self, rows: Iterator) -> _Piece:
        system, folder = self.piece()
        written = set()
        for row in rows:
            if not row.name or "/" in row.name or row.name in written or row.name.startswith((".", "_")):
                raise ValueError(f"not a name of a new file: {row.name!r}")
            written.add(row.name)
            with system.open_output_stream(f"{folder}/{row.name}") as out:
                out.write((row.report or "").encode())
        return _Piece(folder, None, len(written))

    def commit(self, messages: list) -> None:
        """One move for each task that has rows."""
        system, top = _at(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(top)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    system.delete_dir(old.path)
        for m in messages:
            if m is not None and m.rows:
                system.move(m.folder, f"{top}/part-{m.folder.rsplit('/', 1)[1]}")
        self.abort(messages)


class SarifFile(DataSource):
    """``lines.write.format("sarif_file").option("name", "report.sarif").save(folder)``: rows (part, nth, text) as one document.

    Rows must be sorted by ranges, as :func:`write_sarif` does it. Tasks write their pieces, and the commit joins them in order, a chunk at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "sarif_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SarifWriter(self.options, overwrite)


class _SarifWriter(_TwoPhases):
    def write(self, rows: Iterator) -> _Piece:
        system, folder = self.piece()
        first, n = None, 0
        with system.open_output_stream(f"{folder}/piece") as out:
            for row in rows:
                first = first or (row.part, row.nth)
                out.write(row.text.encode() + b"\n")
                n += 1
        return _Piece(folder, first, n)

    def commit(self, messages: list) -> None:
        system, top = _at(self.path)
        target = f"{top}/{self.options.get('name', 'report.sarif')}"
        if not self.overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(target)
        whole = f"{_at(self.staging)[1]}/whole"
        with system.open_output_stream(whole) as out:
            for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first):
                with system.open_input_stream(f"{m.folder}/piece") as piece:
                    while data := piece.read(CHUNK):
                        out.write(data)
        system.move(whole, target)
        self.abort(messages)


def register(spark: SparkSession) -> None:
    """The formats core_dumps, report_files and sarif_file."""
    for source in (CoreDumps, ReportFiles, SarifFile):
        spark.dataSource.register(source)


def read_cores(spark: SparkSession, path: str, names: str = "") -> DataFrame:
    """(path, size, arch, endianness, width, cmdline, error) of core dumps of any size: headers and notes are read, memory isn't."""
    register(spark)
    return spark.read.format("core_dumps").option("glob", names).load(path)


def write_report_files(reports: DataFrame, path: str, name: str = "file_name") -> None:
    """A file for each report below ``path``, named by its column ``name``, with the report's columns as JSON. ``reports`` has what a report's file holds, and the name."""
    register(reports.sparkSession)
    columns = [c for c in reports.columns if c != name]
    text = F.to_json(F.struct(*columns), {"pretty": "true"})
    reports.select(F.col(name).alias("name"), text.alias("report")).write.format("report_files").mode("append").save(path)


def write_sarif(lines: DataFrame, path: str, name: str = "report.sarif") -> None:
    """The lines of a document (part, nth, text) as the file ``name`` in ``path``; a document that isn't JSON can't come of whole lines."""
    register(lines.sparkSession)
    ordered = lines.repartitionByRange("part", "nth").sortWithinPartitions("part", "nth")
    ordered.write.format("sarif_file").option("name", name).mode("append").save(path)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, level, message, locations) of the results of SARIF documents."""
    place = "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long,startColumn:long>>>>"
    schema = f"runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:{place}>>>>"
    runs = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.sarif").json(path).select(F.explode("runs").alias("r"))
    return runs.select(F.explode("r.results").alias("x")).select(F.col("x.ruleId").alias("rule_id"), "x.level", F.col("x.message.text").alias("message"), "x.locations")
