"""Sequences out of the document tables: contigs are sources, genes and isolates are documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.sequence import only_acgt
from strandflow.operators.pieces import running_sums, with_starts
from strandflow.plans.session import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, seq: the ACGT letters of each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", only_acgt(F.coalesce("text", F.lit(""))).alias("seq"))


def contig_pieces(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Pieces of the contigs: one contig a source (or a set of values of the named columns, joined by -), its documents in the order of doc_id.
    The letters are taken out of the texts once; starts, lengths and windows read them from there."""
    docs = document_sequences(spark, sf_dir)
    contig = F.concat_ws("-", *by) if by else F.col("source")
    return with_starts(settled(docs.select(contig.alias("contig_id"), F.col("doc_id").alias("ordinal"), "seq")))


def host_pieces(pieces: DataFrame, name: str = "host", by: str | None = None) -> DataFrame:
    """All contigs one after the other, by contig_id, as the pieces of one; by: as the pieces of one contig a value of that column, named by it."""
    keys = [by] if by else []
    lengths = pieces.groupBy(*keys, "contig_id").agg(F.sum(F.length("seq").cast("bigint")).alias("contig_length"))
    offsets = running_sums(lengths, keys, ["contig_id"], "contig_length").select("contig_id", F.col("before_contig_length").alias("_offset"))
    host = F.col(by).cast("string") if by else F.lit(name)
    return pieces.join(offsets, "contig_id").select(host.alias("contig_id"), "ordinal", "seq", (F.col("start") + F.col("_offset")).alias("start"))


def genes(spark: SparkSession, sf_dir: str, least: int = 150, pieces: DataFrame | None = None) -> DataFrame:
    """contig_id, gene_id, start, end, is_pos of documents of least letters or more; positives are the toxic ones. pieces: the contigs', where the caller has them."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"), "toxic")
    rows = (contig_pieces(spark, sf_dir) if pieces is None else pieces).join(labels, "ordinal", "left").where(F.length("seq") >= least)
    return rows.select("contig_id", F.col("ordinal").alias("gene_id"), "start", (F.col("start") + F.length("seq")).alias("end"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_pos"))


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """genome_id, label (R or S), lineage, seq of the labelled documents."""
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "R").otherwise("S").alias("label"))
    return document_sequences(spark, sf_dir).join(labels, "doc_id").select(F.col("doc_id").alias("genome_id"), "label", F.col("lang").alias("lineage"), "seq")


def event_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, event_id, sym: the events' types, numbered in their order of names (0 for none)."""
    events = table(spark, sf_dir, "events")
    names = events.select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("names"))  # a few event types
    sym = F.coalesce(F.array_position("names", F.col("event_type")) - 1, F.lit(0)).cast("int")
    return events.crossJoin(F.broadcast(names)).select("user_id", "ts", "event_id", sym.alias("sym"))
