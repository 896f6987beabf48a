"""ELF files as rows: machine and command line of core dumps, and the marks of sanitizers among a program's symbols.

Files come as bytes from the ``binaryFile`` source, a row each, and are read by small helpers in Arrow batches; core dumps of any size
come from the data source ``core_dumps`` of :mod:`.datasources`, which reads parts of files only. A file that
is no ELF file, or no core dump, keeps its row with ``error`` set.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: kinds of machines, core dumps, notes with a process's state, symbol tables.
MACHINES = {3: "i386", 40: "arm", 62: "amd64", 183: "arm64", 243: "riscv"}
CORE, NOTES, PROCESS, SYMBOLS = 4, 4, 3, 2
#: Where the command line begins in a process's note, by the width of addresses.
COMMAND = {4: 44, 8: 56}
#: What the symbols of instrumented programs contain.
MARKS = ["__asan", "__ubsan", "__tsan", "__msan", "__llvm_profile", "runtime.go"]


class Elf:
    """The header of a file and its tables of segments and sections as (type, link, offset, size).

    ``fetch(at, size)`` gives bytes of the file, fewer at its end, so only what is asked for is read: a core dump can be larger than memory.
    """

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        head = fetch(0, 64)
        if head[:4] != b"\x7fELF" or len(head) < 52 or head[4] not in (1, 2) or head[5] not in (1, 2):
            raise ValueError("not an ELF file")
        self.width, self.order = 4 * head[4], "<" if head[5] == 1 else ">"
        self.kind, self.machine = self.read("HH", 16)
        wide = self.width == 8
        segments, sections = self.read("QQ" if wide else "II", 32 if wide else 28)
        _, count, _, entries = self.read("HHHH", 54 if wide else 42)
        size, entry = (56, 64) if wide else (32, 40)
        segment = lambda at: (self.read("I", at)[0], 0, *self.read("Q16xQ" if wide else "I8xI", at + (8 if wide else 4)))
        section = lambda at: (self.read("I", at + 4)[0], self.read("I", at + (40 if wide else 24))[0], *self.read("QQ" if wide else "II", at + (24 if wide else 16)))
        self.segments = [segment(segments + size * i) for i in range(count)] if segments else []
        self.sections = [section(sections + entry * i) for i in range(entries)] if sections else []

    def read(self, form: str, at: int) -> tuple:
        form = self.order + form
        return struct.unpack(form, self.fetch(at, struct.calcsize(form)))

    def notes(self) -> Iterator[tuple[int, int, int]]:
        """Type, place and length of each note that is in the file."""
        for kind, _, at, size in self.segments:
            end = at + size if kind == NOTES else at
            while at + 12 <= end and len(self.fetch(at, 12)) == 12:
                name, length, what = self.read("III", at)
                begin = at + 12 + -(-name // 4) * 4
                yield what, begin, length
                at = begin + -(-length // 4) * 4

    def symbols(self) -> Iterator[bytes]:
        """Names in the symbol tables, which are read a table at a time."""
        for kind, link, at, size in self.sections:
            if kind == SYMBOLS and link < len(self.sections):
                _, _, begin, length = self.sections[link]
                texts, table = self.fetch(begin, length), self.fetch(at, size)
                step = 24 if self.width == 8 else 16
                for i in range(0, len(table) - step + 1, step):
                    name = struct.unpack_from(self.order + "I", table, i)[0]
                    yield texts[name : texts.find(b"\0", name)]


def core_of(fetch: Callable[[int, int], bytes]) -> tuple[str, str, int, str | None]:
    """Machine, endianness, width of addresses and command line of a core dump."""
    elf = Elf(fetch)
    if elf.kind != CORE:
        raise ValueError("not a core dump")
    if elf.machine not in MACHINES:
        raise ValueError(f"unknown machine {elf.machine}")
    begin, any_note, found = COMMAND[elf.width], False, None
    for kind, at, length in elf.notes():
        any_note = True
        if kind == PROCESS and length > begin and found is None:
            found = fetch(at, length)[begin:].split(b"\0")[0].decode("latin-1")
    if not any_note:
        raise ValueError("a core dump without notes")
    return MACHINES[elf.machine], "little" if elf.order == "<" else "big", elf.width, found


def marks_of(fetch: Callable[[int, int], bytes]) -> list[str]:
    """Which of MARKS the names of symbols contain; a name counts for the first that it contains."""
    found = {next((m for m in MARKS if m in name), None) for name in (s.decode("latin-1") for s in Elf(fetch).symbols())}
    return [m for m in MARKS if m in found]


def _view(data: pa.BinaryScalar) -> Callable[[int, int], bytes]:
    buffer = data.as_buffer() or pa.py_buffer(b"")
    return lambda at, size: buffer.slice(min(at, buffer.size), max(0, min(size, buffer.size - at))).to_pybytes()


def _each(files: DataFrame, helper, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows, errors = [], []
            for data in x.column(1):
                try:
                    # a view of the batch's memory: a file isn't copied
                    rows.append(helper(_view(data)))
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    rows.append((None,) * len(columns))
                    errors.append(str(e))
            parts = zip(*rows) if rows else ((),) * len(columns)
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(c, t) for c, t in zip(parts, columns.values())), pa.array(errors, pa.string())], ["path", *columns, "error"])

    # a dump is large: batches hold a few
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return files.select("path", "content").mapInArrow(run, f"path string, {schema}, error string")


def cores(files: DataFrame) -> DataFrame:
    """(path, arch, endianness, width, cmdline, error) of core dumps; ``files``: path, content."""
    return _each(files, core_of, {"arch": pa.string(), "endianness": pa.string(), "width": pa.int32(), "cmdline": pa.string()}, "arch string, endianness string, width int, cmdline string")


def symbols(files: DataFrame) -> DataFrame:
    """(path, symbols, error): which sanitizers and runtimes a program's symbols tell of; ``files``: path, content."""
    return _each(files, lambda fetch: (marks_of(fetch),), {"symbols": pa.list_(pa.string())}, "symbols array<string>")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), F.col("content"))
