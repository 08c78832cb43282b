"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds at once, besides a single longer text.
SLICE_BYTES = 4 << 20
#: Byte by byte: A-Z in lower case, digits, a-z and all beyond ASCII as they are, a space for the rest. Offsets don't move.
FOLDED = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share, in the one that spark.checkpoint.dir names or, where that is
    unset, in the warehouse. It is deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    folder = f"{base.rstrip('/')}/strandflow-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        path, files = on_disk(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


_folders: set[str] = set()


def on_disk(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and file system of a path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def folded_words(text: bytes | None) -> list[bytes]:
    """The runs of ASCII letters (in lower case), digits and characters beyond ASCII of UTF-8 text; none of null."""
    return text.translate(FOLDED).split() if text else []


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """df as a table written in the shared folder: cuts the lineage and outlives lost executors. scratch takes note of its path, for deleted()."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that nothing reads any longer."""
    while scratch:
        path, files = on_disk(spark, scratch.pop())
        files.delete(path, True)


def mapped(df: DataFrame, run: Callable, new: str | T.StructType, without: str | None = None) -> DataFrame:
    """df.mapInArrow with its own columns (but for one) and new ones behind. Columns of any name and nested types of any field names pass
    through: those that mapInArrow can't name travel under another name."""
    new = T.StructType.fromDDL(new) if isinstance(new, str) else new
    plain = [c if re.fullmatch(r"\w+", c) else f"_column_{i}" for i, c in enumerate(df.columns)]
    kept = [i for i, c in enumerate(df.columns) if c != without]
    own = [T.StructField(plain[i], df.schema[i].dataType, True, df.schema[i].metadata) for i in kept]
    out = df.toDF(*plain).mapInArrow(run, T.StructType([*own, *new.fields]))
    return out.toDF(*[df.columns[i] for i in kept], *new.names)


def hashed_uniform(*parts: Column) -> Column:
    """A double in (0, 1) from 52 bits of the md5 of the parts joined by colons; nulls count as the word null."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def named(column: str) -> Column:
    """The column of that name, whatever letters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that equal one of the names under Spark's case-insensitive rule."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select([named(c) for c in kept])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's strings or binaries in the column have at most limit bytes, or one row."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def listed(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """As slices, of a column of lists, by their values."""
    for batch in batches:
        lengths = pa.compute.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def numbered_copies(df: DataFrame, count: str, number: str, spread: list[str] | None = None) -> DataFrame:
    """df's rows repeated count times, with the number of each copy from 0, in levels of at most 1,024 so that no row holds a long list.

    spread: columns by whose values the rows are dealt out again between levels; None leaves them in their task.
    """
    n = named(count).cast("bigint")
    upto = lambda x: F.sequence(F.lit(0).cast("bigint"), x.cast("bigint"))
    rows = df.where(n > 0).withColumn("_high", F.explode(upto(F.floor((n - 1) / (1 << 20)))))
    if spread is not None:
        rows = rows.repartition(*spread, "_high")
    rows = rows.withColumn("_middle", F.explode(upto(F.least(F.lit(1023), F.floor((n - 1 - F.col("_high") * (1 << 20)) / 1024)))))
    if spread is not None:
        rows = rows.repartition(*spread, "_high", "_middle")
    first = F.col("_high") * (1 << 20) + F.col("_middle") * 1024
    rows = rows.withColumn("_low", F.explode(upto(F.least(F.lit(1023), n - 1 - first))))
    return rows.withColumn(number, first + F.col("_low")).drop("_high", "_middle", "_low")
