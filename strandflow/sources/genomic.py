"""Sequence files as DataFrames: FASTA, FASTQ and feature tables of GenBank files, by Spark's text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.plans.session import settled


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value: the lines of text files; block is where the part of the file begins that a task reads, line numbers a block's lines.
    Spark reads a file in ranges, so its lines are ordered by block and line and no task has a whole file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    return settled(rows).withColumn("line", F.row_number().over(Window.partitionBy("file", "block").orderBy("_id")) - 1).drop("_id")


def read_fasta(spark: SparkSession, path: str, source: str = "", piece: int = 1 << 16) -> DataFrame:
    """contig_id, source, record, ordinal, seq: records in pieces of at most piece letters, upper case; id is the header's first word.

    source: a label of the sample, the id where it is empty. record and ordinal follow the order of the file, with gaps. A record of many lines is never one
    string: a line belongs to the last header before it, which for the lines that open a block is that of an earlier block, one row a block. A line is
    a string, and long ones are cut in one pass. A record without letters is one empty piece.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    here = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("value").startswith(">"), F.struct(F.col("line").alias("at"), F.split(F.trim(F.substring("value", 2, 1 << 30)), r"\s+")[0].alias("id")))
    rows = rows.withColumn("_own", F.last(header, ignorenulls=True).over(here))
    lasts = rows.groupBy("file", "block").agg(F.max(F.struct("line", "_own"))["_own"].alias("_last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("file", "block", F.last(F.when(F.col("_last").isNotNull(), F.struct("block", "_last")), ignorenulls=True).over(earlier).alias("_before"))
    rows = rows.join(carried, ["file", "block"])
    owner = F.when(F.col("_own").isNotNull(), F.struct("block", F.col("_own").alias("_last"))).otherwise(F.col("_before"))
    rows = rows.withColumn("_owner", owner).where(F.col("_owner").isNotNull())
    # lines, cut where they are long, are put together to pieces by the letters before them in their block: runs in the order of the file
    half = max(1, piece // 2)
    cut = F.regexp_extract_all(F.upper(F.regexp_replace("value", r"\s+", "")), F.lit(f".{{1,{half}}}"), 0)
    own = rows.withColumn("_cut", F.when(F.col("value").startswith(">"), F.array(F.lit(""))).otherwise(cut))  # a header is a part without letters
    each = own.select("file", "block", "_owner", F.posexplode("_cut").alias("part", "seq"), "line").withColumn("at", F.struct("line", "part"))
    before = Window.partitionBy("file", "block", "_owner").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("run", F.floor(F.coalesce(F.sum(F.length("seq")).over(before), F.lit(0)) / half))
    seqs = each.groupBy("file", "_owner", "block", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    contig = F.col("_owner._last.id")
    record = F.col("_owner.block") + F.col("_owner._last.at")
    wide = seqs.select(contig.alias("contig_id"), (F.lit(source) if source else contig).alias("source"), "file", record.alias("record"), F.struct("block", "run").alias("_place"), "seq")
    # ordinals: the pieces of a record counted in order, whatever the ranges
    return wide.withColumn("ordinal", F.row_number().over(Window.partitionBy("file", "record", "contig_id").orderBy("_place")).cast("bigint") - 1).select("contig_id", "source", "record", "ordinal", "seq")


def read_fastq(spark: SparkSession, path: str, source: str = "") -> DataFrame:
    """contig_id, source, seq, quality (array of Phred scores, null if empty) of records of four lines. Lines are numbered by block, and blocks stitched by their counts, so no task has a whole file."""
    lines = numbered_lines(spark, path)
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.join(counts.select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first")), ["file", "block"]).withColumn("n", F.col("_first") + F.col("line"))
    parts = rows.groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("value"))).alias(f"l{i}") for i in (0, 1, 3)])
    phred = F.when(F.length("l3") > 0, F.transform(F.filter(F.split("l3", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33))
    name = F.split(F.regexp_replace("l0", "^@", ""), r"\s+")[0]
    return parts.where("l1 is not null").select(name.alias("contig_id"), (F.lit(source) if source else name).alias("source"), F.upper("l1").alias("seq"), phred.alias("quality"))


def _qualifier(block: Column, name: str) -> Column:
    value = F.regexp_extract(block, rf'(?s)/{name}="([^"]*)"', 1)
    return F.when(value != "", F.regexp_replace(value, r"\s+", " "))


#: Kinds of features that are kept, and the names they get.
KINDS = {"CDS": "orf", "rRNA": "rRNA", "tRNA": "tRNA", "mobile_element": "mobile_element"}


def read_genbank_features(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """contig_id, start, end, strand, kind, gene, product of the features of GenBank files: half-open, from 0; compound locations span their outer ends."""
    kinds = kinds or KINDS
    rows = spark.read.option("lineSep", "\n//").text(path).where(F.contains("value", F.lit("FEATURES")))
    contig = F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1)
    table = F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(\nORIGIN|\nCONTIG|\z)", 1)
    # a feature opens with a key in column 6
    blocks = F.split(F.concat(F.lit("\n"), table), r"\n {5}(?=\S)")
    each = rows.select(contig.alias("contig_id"), F.explode(blocks).alias("block")).where("trim(block) != ''")
    kind = F.regexp_extract("block", r"^(\S+)", 1)
    location = F.regexp_replace(F.regexp_extract("block", r"(?s)^\S+\s+(.*?)(\n\s+/|\z)", 1), r"\s+", "")
    ends = F.transform(F.regexp_extract_all(location, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))
    named = each.select("contig_id", kind.alias("kind"), ends.alias("ends"), F.when(F.contains(location, F.lit("complement")), "-").otherwise("+").alias("strand"), _qualifier(F.col("block"), "gene").alias("gene"), _qualifier(F.col("block"), "product").alias("product"))
    to_name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return named.where(F.col("kind").isin(*kinds) & (F.size("ends") > 0)).select("contig_id", (F.array_min("ends") - 1).alias("start"), F.array_max("ends").alias("end"), "strand", F.try_element_at(to_name, F.col("kind")).alias("kind"), "gene", "product")


def labelled_genes(features: DataFrame, pattern: str, least: int = 150) -> DataFrame:
    """Features of least letters or more with label ("gene product") and is_pos, whether the pattern is found in it, ignoring case."""
    label = F.trim(F.concat_ws(" ", "gene", "product"))
    rows = features.where((F.col("kind") == "orf") & (F.col("end") - F.col("start") >= least)).withColumn("label", label)
    return rows.withColumn("is_pos", F.col("label").rlike(f"(?i){pattern}"))


def fragments(pieces: DataFrame, least: int = 2000, most: int = 10_000) -> DataFrame:
    """contig_id, fragment, start, end: contiguous fragments of hashed lengths between least and most, as of a mock metagenome.

    Every stretch of most letters is cut once, at a place from its hash, so fragments need no running state.
    """
    from strandflow.operators.pieces import contig_lengths

    lengths = contig_lengths(pieces)
    cut = lambda i: F.least(i * most + least + F.pmod(F.xxhash64("contig_id", i), F.lit(most - 2 * least + 1)), F.col("contig_length"))
    rows = lengths.select("contig_id", "contig_length", F.explode(F.sequence(F.lit(0), F.floor(F.col("contig_length") / most))).alias("fragment"))
    start = F.when(F.col("fragment") == 0, 0).otherwise(cut(F.col("fragment") - 1))
    return rows.select("contig_id", "fragment", start.alias("start"), cut(F.col("fragment")).alias("end")).where(F.col("end") - F.col("start") >= least)
