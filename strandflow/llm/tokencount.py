"""Token counts of documents in flat token files that have no index: separator scans and a prefix scan.

A file is a stream of fixed-width token ids in which an end-of-document id closes each document. It is read in ranges, as
blocks of bytes with their places; a block's separators are found in one vectorised search, and what a document
has in earlier blocks is stitched on by a prefix scan over one small row a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm import bpe
from strandflow.llm.shared import on_disk, slices, written

BLOCK_TOKENS = 1 << 18
#: Blocks of a file that one window of the prefix scan covers; windows are stitched by a second scan.
SPAN = 1024
BLOCK_SCHEMA = "file string, block_no bigint, first_token bigint, tokens binary"


def full_uri(path: str) -> str:
    """Hadoop's file:/x as pyarrow wants it."""
    return re.sub("^file:/+", "file:///", path)


def separator_of(vocabulary: str) -> int:
    """The end-of-document id: the first that the vocabulary leaves free."""
    return bpe.loaded(vocabulary).size


def write_token_files(docs: DataFrame, doc_id: str, text: str, vocabulary: str, folder: str, dtype: str = "<u2") -> DataFrame:
    """Write the documents' token ids as flat files under a folder that all workers share, one a partition, a separator behind each document;
    file, doc_no, doc_id tell which document comes where. Files come to be as these rows do: write the rows once.

    The folder is qualified as Spark resolves it, so a path without a scheme means the same file system here and where it is read. It is to be new or
    empty: files of an earlier run with more partitions would stay. A file appears under its name when it is whole, so a task that runs again replaces it. Null and empty texts are
    documents of no tokens; repeated rows are documents of their own; an empty df gives no rows. Other columns are ignored.
    """
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    path, hadoop = on_disk(docs.sparkSession, folder)
    uri = full_uri(hadoop.makeQualified(path).toString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, at = bpe.loaded(vocabulary), TaskContext.get(), 0
        if own.size > np.iinfo(dtype).max:
            raise ValueError(f"{own.size} ids don't fit {dtype}")
        files, base = pa.fs.FileSystem.from_uri(uri)
        files.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}.bin"
        draft = f"{base}/.{name}-{task.taskAttemptId()}"
        with files.open_output_stream(draft) as out:
            for part in slices(batches, "text"):
                ids, offsets = own.encode(part.column("text").to_pylist())
                # a separator behind every document
                flat = np.insert(ids.astype(dtype), offsets[1:], own.size)
                out.write(flat.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.string()), pa.array(np.arange(at, at + part.num_rows)), part.column("doc_id")], ["file", "doc_no", "doc_id"])
                at += part.num_rows
        files.move(draft, f"{base}/{name}")

    return named.mapInArrow(run, "file string, doc_no bigint, doc_id bigint")


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, range_blocks: int = 64) -> DataFrame:
    """Blocks of the flat files under a path. Spark lists the files and deals out ranges of range_blocks blocks; tasks read their ranges through
    pyarrow's file systems (local or mounted folders, HDFS, S3, GCS), a block at a time, so a file may be of any length."""
    width = np.dtype(dtype).itemsize
    step = block_tokens * width * range_blocks
    listed = spark.read.format("binaryFile").load(path).select("path", "length")  # no content is read
    ranges = listed.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for file, length, first in zip(*(part.column(c).to_pylist() for c in ("path", "length", "first")), strict=True):
                if length % width:
                    raise ValueError(f"{file} is not a whole number of {width}-byte tokens")
                files, at = pa.fs.FileSystem.from_uri(full_uri(file))
                with files.open_input_file(at) as source:
                    source.seek(first)
                    for k in range(first, min(first + step, length), block_tokens * width):
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k // width // block_tokens]), pa.array([k // width]), pa.array([source.read(min(block_tokens * width, length - k))], pa.binary())], ["file", "block_no", "first_token", "tokens"])

    return ranges.repartition("path", "first").mapInArrow(run, BLOCK_SCHEMA)


def separators(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """file, block_no, n_ends, last_end and ends of each block: ends are the places in the file of its separators. Null or empty blocks have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ends = [np.flatnonzero(np.frombuffer(t.as_buffer(), dtype) == eod) + first if t.is_valid and len(t.as_buffer()) else np.zeros(0, np.int64) for t, first in zip(part.column("tokens"), part.column("first_token").to_pylist(), strict=True)]
            offsets = np.r_[0, np.cumsum([len(e) for e in ends])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *ends])))
            yield pa.RecordBatch.from_arrays([part.column("file"), part.column("block_no"), pa.array(np.diff(offsets).astype(np.int64)), pa.array([int(e[-1]) if len(e) else None for e in ends], pa.int64()), lists], ["file", "block_no", "n_ends", "last_end", "ends"])

    return blocks.select("file", "block_no", "first_token", "tokens").mapInArrow(run, "file string, block_no bigint, n_ends bigint, last_end bigint, ends array<bigint>")


def document_lengths(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """file, doc_no (from 0 in its file), first_token, n_tokens (without the separator) of every document.

    Tokens after a file's last separator are an unfinished document and give no row; two separators in a row close a
    document of 0 tokens; no blocks give no rows. Blocks carry their places, so their order and partitioning don't matter, and
    other columns of theirs are ignored. A document may be longer than any block.
    """
    found = written(separators(blocks, eod, dtype), "separators").withColumn("span", F.floor(F.col("block_no") / SPAN))
    spans = found.groupBy("file", "span").agg(F.sum("n_ends").alias("n"), F.max("last_end").alias("last"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("file", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before"))
    inner = Window.partitionBy("file", "span").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    small = found.select("file", "span", "block_no", F.coalesce(F.sum("n_ends").over(inner), F.lit(0)).alias("n_inner"), F.max("last_end").over(inner).alias("end_inner"), "ends")
    stitched = small.join(spans, ["file", "span"]).where(F.size("ends") > 0)
    opened = F.concat(F.array(F.greatest("end_inner", "end_before")), F.col("ends"))
    each = stitched.select("file", (F.col("n_before") + F.col("n_inner")).alias("n"), opened.alias("opened"), F.posexplode("ends").alias("i", "end"))
    start = F.get("opened", F.col("i")) + 1
    return each.select("file", (F.col("n") + F.col("i")).alias("doc_no"), start.alias("first_token"), (F.col("end") - start).alias("n_tokens"))
