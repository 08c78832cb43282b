"""Candidate reports: text, JSON and TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_lines(found: DataFrame, *keys: str) -> DataFrame:
    """rank, line (and the keys before): a readable line of each candidate, with five pieces of evidence at most."""
    evidence = F.array_join(F.slice("evidence", 1, 5), ", ")
    line = F.format_string("#%3d  %s:%d-%d (%d bp)  confidence: %.2f  evidence: %s", "rank", "contig_id", "start", "end", F.col("end") - F.col("start"), F.round("confidence", 2), evidence)
    return found.select(*keys, "rank", line.alias("line"))


def json_lines(found: DataFrame, *keys: str) -> DataFrame:
    """rank, line (and the keys before): a JSON object of each candidate, with all evidence."""
    region = F.struct("contig_id", "start", "end", F.lit("+").alias("strand"), F.lit("unknown").alias("kind"))
    return found.select(*keys, "rank", F.to_json(F.struct(region.alias("region"), "evidence", F.lit("novel").alias("novelty"), F.round("confidence", 3).alias("confidence"))).alias("line"))


def tsv_columns(found: DataFrame, *keys: str) -> DataFrame:
    """The ten columns of the TSV report (and the keys before)."""
    return found.select(
        *keys, "rank", F.col("contig_id").alias("contig"), "start", "end", (F.col("end") - F.col("start")).alias("length"), F.lit("+").alias("strand"), F.format_string("%.3f", F.round("confidence", 3)).alias("confidence"),
        F.lit("novel").alias("novelty"), F.lit("").alias("nearest_known"), F.array_join(F.slice("evidence", 1, 5), "; ").alias("evidence"),
    )


def write_report(found: DataFrame, path: str, form: str = "text", by: str | None = None) -> None:
    """Write the candidates, in order, under path; form: text, json or tsv. by: a folder <by>=<value> for each value of that column."""
    keys = [by] if by else []
    shown = {"text": text_lines, "json": json_lines, "tsv": tsv_columns}[form](found, *keys)
    ordered = shown.repartition(by).sortWithinPartitions(by, "rank") if by else shown.orderBy("rank")
    if form == "tsv":
        ordered.write.partitionBy(*keys).csv(path, sep="\t", header=True)
    else:
        ordered.select(*keys, "line").write.partitionBy(*keys).text(path)
