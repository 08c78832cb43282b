"""Scans of sequence files as they arrive: scoring of a contig needs the baseline alone, so a stream needs no state across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from strandflow.operators import scan
from strandflow.operators.pieces import windows, with_starts
from strandflow.plans.session import settled
from strandflow.sources.fasta import fasta_stream


def scan_stream(spark: SparkSession, incoming: str, profile: DataFrame, stats: DataFrame, out: str, checkpoint: str, window: int = 2000, step: int = 500) -> StreamingQuery:
    """Write the suppressed, scored windows of every FASTA file that arrives in a folder to Parquet, one batch a trigger, with file and record.

    Records come in pieces, so none is one string, and those that share an id, in one file or several, stay apart.
    profile and stats are one row each and are broadcast to every batch. A batch that is run again after a failure
    overwrites its own folder, so results are exactly once.
    """
    records = fasta_stream(spark, incoming, f"{checkpoint}/files")

    def batch(rows: DataFrame, number: int) -> None:
        # one record is one contig: its key holds where it comes from
        contigs = with_starts(settled(rows.select(F.struct("file", "record", "contig_id").alias("contig_id"), "ordinal", "seq")))
        found = scan.signals(windows(contigs, window, step).where(F.col("end") - F.col("start") == window), profile)
        scored = scan.suppressed(scan.composite(scan.z_scores(found, stats)))
        scored.select("contig_id.*", *[c for c in scored.columns if c != "contig_id"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
