"""Command line: scan one sample's FASTA, scan clusters of a metagenome, or associate k-mers over a cohort."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandflow.operators import cluster, cohort, fusion, scan
from strandflow.operators.pieces import contig_lengths, with_starts
from strandflow.plans.session import ship_package
from strandflow.sources.documents import host_pieces
from strandflow.sources.genomic import read_fasta
from strandflow.sources.reports import write_report


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandflow")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="windows of a sample that stand out against a baseline")
    one.add_argument("fasta")
    one.add_argument("--host", help="FASTA of the baseline; the sample itself without it")
    one.add_argument("--two-channel", action="store_true", help="rank windows by soft fusion with the compression channel")
    many = commands.add_parser("metagenome", help="clusters of contigs, each scanned against itself")
    many.add_argument("fasta")
    many.add_argument("--clusters", type=int)
    many.add_argument("--min-len", type=int, default=2000)
    for p in (one, many):
        p.add_argument("--window", type=int, default=2000)
        p.add_argument("--step", type=int, default=500)
        p.add_argument("--top", type=int, default=20)
        p.add_argument("--format", choices=("text", "json", "tsv"), default="text")
        p.add_argument("--out", required=True)
    group = commands.add_parser("cohort", help="k-mers associated with a phenotype")
    group.add_argument("genomes", help="Parquet of genome_id, label (R or S), seq")
    group.add_argument("-k", type=int, default=31)
    group.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("strandflow").getOrCreate()
    ship_package(spark)
    if args.command == "cohort":
        cohort.association(spark.read.parquet(args.genomes), args.k).write.parquet(args.out)
        return
    pieces = with_starts(read_fasta(spark, args.fasta).select("contig_id", "ordinal", "seq"))
    if args.command == "scan":
        host = with_starts(read_fasta(spark, args.host).select("contig_id", "ordinal", "seq")) if args.host else pieces
        found = scan.scan(pieces, host_pieces(host), args.window, args.step)
        if args.two_channel:
            fused = fusion.two_channels(found, pieces, args.window, args.step)
            found = found.join(fused.select("contig_id", "start", "fused"), ["contig_id", "start"]).withColumn("composite", F.col("fused")).drop("fused")
        write_report(scan.candidates(scan.with_context(found), args.top), args.out, args.format)
        return
    long = contig_lengths(pieces).where(F.col("contig_length") >= args.min_len)
    pieces = pieces.join(long.select("contig_id"), "contig_id")
    z = cluster.standardised(cluster.contig_features(pieces))
    labels = cluster.hierarchical(z, args.clusters or cluster.automatic_k(long.count())).select("contig_id", "cluster")
    write_report(scan.scan_clusters(pieces, labels, args.window, args.step, args.top), args.out, args.format, by="cluster")


if __name__ == "__main__":
    main()
