"""FASTA files as a Spark data source, for batches and streams: spark.read.format("fasta") and spark.readStream.format("fasta").

A file is read in byte ranges. Pieces lie on a grid of bytes of the file, so which pieces there are doesn't depend on how the file is
dealt to tasks, and a task holds one block at a time. A range finds the header that governs its first byte by looking back from there.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "contig_id string, source string, file string, record bigint, ordinal bigint, seq string"
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes that are searched at a time for the header before a range.
BACK = 1 << 20


@dataclass
class Range(InputPartition):
    """Bytes begin to end of a file; end is None for a compressed file, which is read from its start to its end."""

    file: str
    begin: int
    end: int | None


def governing(data: pa.NativeFile, begin: int) -> int | None:
    """Where the last header that starts before begin starts."""
    end = begin
    while end > 0:
        start = max(0, end - BACK)
        data.seek(start)
        block = data.read(end - start)
        at = block.rfind(b"\n>")
        if at >= 0:
            return start + at + 1
        if start == 0:
            return 0 if block.startswith(b">") else None
        end = start + 1  # a break of line and its mark may lie on both sides
    return None


def first_word(header: bytes) -> str:
    words = header[1:].split(None, 1)
    return words[0].decode("utf-8", "replace") if words else ""


def pieces_of(data: pa.NativeFile, begin: int, end: int | None, piece: int) -> Iterator[tuple[str, int, int, str]]:
    """contig_id, record (where its header starts), ordinal and letters of the pieces of a range; begin lies on the grid of pieces.

    A record without letters is one empty piece, of the range that has its header, which reads on behind its end until that is known.
    """
    record, header, contig, fresh, bare = None, None, "", True, False  # header: what is read of an open header line; bare: the record's own range found no letter yet
    if begin:
        record = governing(data, begin)
        if record is not None:
            data.seek(record)
            header = b""
            while len(header) < begin - record and b"\n" not in header:
                header += data.read(min(BACK, begin - record - len(header)))
            if b"\n" in header:
                contig, header = first_word(header.split(b"\n", 1)[0]), None
        data.seek(begin - 1)
        fresh = data.read(1) == b"\n"
    at = begin
    while True:
        beyond = end is not None and at >= end
        if beyond and not bare:
            return
        block = data.read(piece)
        i, letters = 0, []
        while i < len(block):
            if header is not None:
                stop = block.find(b"\n", i)
                header += block[i : len(block) if stop < 0 else stop]
                if stop < 0:
                    break
                contig, header, fresh, i = first_word(header), None, True, stop + 1
                continue
            found = i if fresh and block[i] == 62 else block.find(b"\n>", i) + 1 or len(block)
            letters.append(block[i:found])
            i = found
            if found < len(block):  # a header opens here: what was before it is done
                seq = b"".join(letters).translate(None, WHITE)
                letters = []
                if record is not None and (bare if not seq else not beyond):
                    yield contig, record, 0 if not seq else at // piece - record // piece, seq.upper().decode("latin-1")
                if beyond:
                    return
                record, header, bare, fresh = at + found, b"", True, False
            else:
                fresh = block.endswith(b"\n")
        seq = b"".join(letters).translate(None, WHITE)
        if seq:
            if record is not None and not beyond:
                yield contig, record, at // piece - record // piece, seq.upper().decode("latin-1")
            bare = False
        if not block:
            if bare:
                yield (first_word(header) if header is not None else contig), record, 0, ""
            return
        at += len(block)


class Options:
    """The options of a load. path: a file or a folder (files below it, but hidden ones), with its scheme, as workers have no session that could resolve it.
    piece: letters of a piece at most. range: bytes that a task reads, taken up to a multiple of piece. source: a label of the sample, the
    contig's id where it is empty. log: for streams, a folder on a file system that outlives the driver, where the files of each batch are written down."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.source, self.log = options.get("path", ""), options.get("source", ""), options.get("log", "")
        self.piece = int(options.get("piece", 1 << 16))
        if self.piece < 1:
            raise ValueError("piece must be 1 or more")
        self.size = max(1, -(-int(options.get("range", 1 << 26)) // self.piece)) * self.piece
        for path in (self.path, self.log):
            if path and not re.match(r"^[A-Za-z][\w+.-]*:/", path):
                raise ValueError(f"{path!r} has no scheme: name it as file:///..., hdfs://... or s3://...")

    def opened(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))

    def found(self) -> dict[str, int]:
        """Sizes of the files by name."""
        files, base = self.opened(self.path)
        one = files.get_file_info(base)
        if one.type == fs.FileType.File:
            return {base: one.size}
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = files.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda p: any(part.startswith((".", "_")) for part in p[len(base) :].split("/"))
        return {x.path: x.size for x in listed if x.type == fs.FileType.File and not hidden(x.path)}

    def ranges(self, sizes: dict[str, int]) -> list[Range]:
        out = []
        for file, size in sorted(sizes.items()):
            if file.endswith((".gz", ".bz2")):
                out.append(Range(file, 0, None))
            else:
                out += [Range(file, at, min(at + self.size, size)) for at in range(0, size, self.size)]
        return out

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The pieces of a range, a few megabytes of them a batch."""
        files = self.opened(self.path)[0]
        with files.open_input_stream(part.file) if part.end is None else files.open_input_file(part.file) as data:
            rows, size = [], 0
            for row in pieces_of(data, part.begin, part.end, self.piece):
                rows.append(row)
                size += len(row[3])
                if size >= 1 << 22 or len(rows) >= 1 << 14:
                    yield self.table(part.file, rows)
                    rows, size = [], 0
            if rows:
                yield self.table(part.file, rows)

    def table(self, file: str, rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        contig, record, ordinal, seq = (list(x) for x in zip(*rows, strict=True))
        source = [self.source] * len(rows) if self.source else contig
        columns = [pa.array(contig, pa.string()), pa.array(source, pa.string()), pa.array([file] * len(rows), pa.string()), pa.array(record, pa.int64()), pa.array(ordinal, pa.int64()), pa.array(seq, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["contig_id", "source", "file", "record", "ordinal", "seq"])


class FastaReader(DataSourceReader):
    def __init__(self, options: Options) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        return self.options.ranges(self.options.found()) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition) if partition.file else iter(())


class FastaStream(DataSourceStreamReader):
    """Files as they arrive, each once. An offset is the number of batches of files written down in the log, as a row a file of name and size; a log entry is written
    before Spark knows its offset, so a query that starts again reads the same files in the same batches. A file is to appear when it is whole."""

    def __init__(self, options: Options) -> None:
        if not options.log:
            raise ValueError("a stream needs the option log")
        self.options = options

    def entries(self) -> dict[int, str]:
        files, base = self.options.opened(self.options.log)
        listed = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return {int(m[1]): x.path for x in listed if (m := re.fullmatch(r"(\d+)\.json", posixpath.basename(x.path)))}

    def taken(self, first: int, last: int) -> dict[str, int]:
        files, _ = self.options.opened(self.options.log)
        out: dict[str, int] = {}
        for number, path in sorted(self.entries().items()):
            if first < number <= last:
                with files.open_input_stream(path) as data:
                    out |= json.loads(data.read())
        return out

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        last = max(self.entries(), default=0)
        seen = self.taken(0, last)
        fresh = {k: v for k, v in self.options.found().items() if k not in seen}
        if fresh:
            last += 1
            files, base = self.options.opened(self.options.log)
            files.create_dir(base, recursive=True)
            with files.open_output_stream(f"{base}/.{last}.draft") as out:
                out.write(json.dumps(fresh).encode())
            files.move(f"{base}/.{last}.draft", f"{base}/{last}.json")
        return {"batch": last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.options.ranges(self.taken(start["batch"], end["batch"])) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition) if partition.file else iter(())


class FastaSource(DataSource):
    """contig_id (the header's first word), source, file, record, ordinal, seq: the records of FASTA files in pieces of upper-case letters.

    record is the byte of the file where the record's header starts, ordinal counts pieces of the grid from there: they follow the order of the file, with gaps, and
    (file, record) tells records apart that share an id. Letters before any header are left out; white space is; a record without letters is one empty piece; an
    empty file has no rows. Lines end with a line feed, or a carriage return and one. Compressed files (gz, bz2) are read by one task each, block by block.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FastaReader:
        return FastaReader(Options(self.options))

    def streamReader(self, schema: object) -> FastaStream:
        return FastaStream(Options(self.options))


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority that Spark's own readers would give it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def fasta(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The pieces of a file or folder, path resolved as Spark does."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").options(**options).load(qualified(spark, path))


def fasta_stream(spark: SparkSession, path: str, log: str, **options: object) -> DataFrame:
    """The pieces of files as they arrive in a folder; log: see Options."""
    spark.dataSource.register(FastaSource)
    return spark.readStream.format("fasta").options(log=qualified(spark, log), **options).load(qualified(spark, path))
