"""k-mer association with a binary phenotype over a cohort of genomes, localisation, structure and residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.functions.sequence import let
from strandflow.operators.measures import CODES, packed_kmers
from strandflow.operators.pieces import islands
from strandflow.plans.session import settled

#: Bytes that are letters of a sequence.
LETTER = np.zeros(256, bool)
LETTER[[ord(c) for c in "ACGTacgt"]] = True


def row_kmers(rows: DataFrame, k: int, seq: str, keep: list[str], both_strands: bool, places: bool, canonical: bool = False) -> DataFrame:
    """keep, kmer (and pos): the packed k-mers of each row's runs of ACGT, distinct in the row or (places) each with its place; in Arrow batches.
    canonical: the smaller one of each k-mer and its reverse complement stands for both."""
    slim = rows.select(*keep, F.col(seq).alias("_seq"))
    new = [T.StructField("pos", T.IntegerType())] if places else []
    shape = T.StructType([*(slim.schema[c] for c in keep), *new, T.StructField("kmer", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, found, spots = batch.slice(at, 64), [], []
                for text in part.column("_seq").to_pylist():
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    s = CODES[raw]
                    bad = np.r_[0, np.cumsum(~LETTER[raw])]
                    whole = np.flatnonzero(bad[k:] == bad[: len(bad) - k]) if len(s) >= k else np.zeros(0, np.int64)
                    kmers = packed_kmers(s, k)[whole]
                    if both_strands:
                        back = packed_kmers((3 - s)[::-1], k)[::-1][whole]
                        kmers = np.minimum(kmers, back) if canonical else np.r_[kmers, back]
                    found.append(kmers if places else np.unique(kmers))
                    spots.append(whole)
                owner = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                columns = [*(part.column(c).take(owner) for c in keep), *([pa.array(np.concatenate(spots).astype(np.int32))] if places else []), pa.array(np.concatenate(found), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, shape.names)

    return slim.mapInArrow(run, shape)


def genome_kmers(genomes: DataFrame, k: int, seq: str = "seq", both_strands: bool = True, keep: list[str] | None = None, canonical: bool = False) -> DataFrame:
    """genome_id (and the kept columns), kmer: the distinct packed k-mers of each genome. Runs are split at letters outside ACGT.

    A genome may be several rows (pieces that overlap by k - 1 letters, or contigs). Copies within a row go before the shuffle, and where no genome has two rows, which
    a count of the ids tells, there are no others and no shuffle is made; k is at most 31, so that a k-mer fits a bigint.
    """
    rows = row_kmers(genomes, k, seq, ["genome_id", *(keep or [])], both_strands, False, canonical)
    several = genomes.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows if several.isEmpty() else rows.distinct()


#: The bits that stay when groups of 2, 4, 8, 16 and 32 bits of a long change places with their neighbours.
HALVES = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def other_strand(kmer: Column, k: int) -> Column:
    """The reverse complement of a packed k-mer (bigint)."""
    x = F.bitwise_not(kmer)
    for width, mask in HALVES:
        x = let(x, lambda v: F.shiftrightunsigned(v, width).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(mask)), width)))  # noqa: B023
    return F.shiftrightunsigned(x, 64 - 2 * k)


#: k-mers that are broadcast at most, about 64 bytes each in the workers' tables; more are joined by a shuffle.
BROADCAST_KMERS = 1_000_000


def wanted_side(wanted: DataFrame) -> DataFrame:
    """The distinct kmer values of wanted as the side of a join: written once, counted, and broadcast if there are at most BROADCAST_KMERS."""
    table = settled(wanted.select("kmer").distinct())
    return F.broadcast(table) if table.count() <= BROADCAST_KMERS else table


def association(genomes: DataFrame, k: int, informative: bool = True) -> DataFrame:
    """kmer, cnt_r, cnt_s, score = share of R genomes less share of S genomes that carry it.

    informative: only k-mers in at least 3 and at most all but one genomes. Genomes have genome_id, label (R or S), seq. A k-mer and its reverse complement have the same
    genomes, so one of them is shuffled and counted, and both come out.
    """
    counts = genome_kmers(genomes, k, keep=["label"], canonical=True).groupBy("kmer").agg(F.count_if(F.col("label") == "R").alias("cnt_r"), F.count_if(F.col("label") == "S").alias("cnt_s"))
    size = genomes.agg(F.count_if(F.col("label") == "R").alias("n_r"), F.count_if(F.col("label") == "S").alias("n_s"))
    rows = counts.crossJoin(F.broadcast(size))
    if informative:
        rows = rows.where((F.col("cnt_r") + F.col("cnt_s")).between(3, F.col("n_r") + F.col("n_s") - 1))
    share = lambda a, n: F.coalesce(F.col(a) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    both = F.explode(F.array_distinct(F.array(F.col("kmer"), other_strand(F.col("kmer"), k)))).alias("kmer")
    return rows.select(both, "cnt_r", "cnt_s", (share("cnt_r", "n_r") - share("cnt_s", "n_s")).alias("score"))


def strong(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.round("score", 9) >= threshold)


def hits(genomes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """genome_id, pos, kmer: places on the forward strand of the wanted k-mers."""
    places = row_kmers(genomes, k, "seq", ["genome_id"], False, True)
    return places.join(wanted_side(wanted), "kmer", "left_semi").select("genome_id", "pos", "kmer")


def loci(found: DataFrame, k: int, gap: int = 500) -> DataFrame:
    """genome_id, start, end, n: runs of hits whose neighbours are at most gap apart."""
    rows = islands(found.select("genome_id", "pos"), ["genome_id"], "pos", gap)
    return rows.groupBy("genome_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def gene_carriage(genes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """gene_id, n_kmers, n_wanted, share: distinct k-mers (both strands) of each gene (gene_id, seq) and how many are wanted."""
    own = genome_kmers(genes.select(F.col("gene_id").alias("genome_id"), "seq"), k)
    side = wanted_side(wanted)
    marked = own.join(side.select("kmer", F.lit(1).alias("_w")), "kmer", "left")
    counts = marked.groupBy(F.col("genome_id").alias("gene_id")).agg(F.count(F.lit(1)).alias("n_kmers"), F.count("_w").alias("n_wanted"))
    return counts.withColumn("share", F.col("n_wanted") / F.col("n_kmers"))


def residual(wanted: DataFrame, genes: DataFrame, k: int) -> DataFrame:
    """The wanted k-mers that no gene holds."""
    held = genome_kmers(genes.select(F.col("gene_id").alias("genome_id"), "seq"), k).select("kmer").distinct()
    return wanted.join(held, "kmer", "left_anti")


def sketches(genomes: DataFrame, k: int, size: int = 3000, hashed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """genome_id, rank, kmer: the size least k-mers of each genome, as they are or (hashed) by xxhash64."""
    if not hashed and not keep:
        return sketch_lists(genomes, k, size).select("genome_id", F.posexplode("kmers").alias("rank", "kmer")).withColumn("rank", F.col("rank") + 1)
    value = F.xxhash64("kmer") if hashed else F.col("kmer")
    rows = genome_kmers(genomes, k, keep=keep).withColumn("kmer", value).distinct()
    rank = F.row_number().over(Window.partitionBy("genome_id").orderBy("kmer"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= size)


#: Genomes of a block; a task compares two blocks of sketches.
BLOCK_GENOMES = 64


def sketch_similarity(sketch: DataFrame, size: int = 3000, zero: bool = True) -> DataFrame:
    """a, b, jaccard of genomes that share a sketched k-mer: share of the size least k-mers of the union that both have; a pair without any has no row.
    zero: keep pairs whose shared k-mers all lie beyond those size least, at 0.

    Genomes are dealt to blocks, and a task holds two blocks' sketches (128 x size k-mers at most in the mean), so no k-mer's genomes are paired as rows, however
    many have it. The rank in the union of a k-mer that both have is its rank in a plus its rank in b less the number of shared ones up to it.
    """
    kind = sketch.schema["genome_id"].dataType
    held = settled(sketch.groupBy("genome_id").agg(F.array_sort(F.collect_list("kmer")).alias("kmers")))  # size k-mers at most
    blocks = max(1, -(-held.count() // BLOCK_GENOMES))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("genome_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("genome_id", "kmers", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    shape = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("jaccard", T.DoubleType())])

    def compared(group: pa.Table) -> pa.Table:
        group = group.sort_by("genome_id").combine_chunks()
        ids, lists = group.column("genome_id").combine_chunks(), group.column("kmers").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        lengths, block = np.diff(ends), group.column("block").to_numpy()
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        out: tuple[list, list, list] = ([], [], [])
        for x in np.flatnonzero(block == p):
            others = np.flatnonzero(block == q)
            others = others[others > x] if p == q else others
            others = others[lengths[others] > 0]
            own = flat[ends[x] : ends[x + 1]]
            if not len(others) or not len(own):
                continue
            n = lengths[others]
            begin = np.r_[0, np.cumsum(n)[:-1]]
            theirs = np.concatenate([flat[ends[y] : ends[y + 1]] for y in others])
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            hit = own[at] == theirs
            upto = np.cumsum(hit)
            shared = np.add.reduceat(hit.astype(np.int64), begin)
            upto -= np.repeat(upto[begin] - hit[begin], n)
            rank = np.arange(len(theirs)) - np.repeat(begin, n) + 1
            kept = np.add.reduceat((hit & (at + 1 + rank - upto <= size)).astype(np.int64), begin)
            some = np.flatnonzero(shared if zero else kept)
            out[0].append(np.minimum(x, others[some]))
            out[1].append(np.maximum(x, others[some]))
            out[2].append(kept[some] / np.minimum(size, len(own) + n[some] - shared[some]))
        a, b, value = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.Table.from_arrays([ids.take(pa.array(a.astype(np.int64))), ids.take(pa.array(b.astype(np.int64))), pa.array(value.astype(np.float64))], ["a", "b", "jaccard"])

    return dealt.groupBy("p", "q").applyInArrow(compared, shape)


#: Least k-mers that a task holds of its genomes together before they leave it, and letters that it codes at a time (a longer row by itself).
HELD_KMERS, LETTERS_AT_A_TIME = 1 << 20, 1 << 18
#: Parts that the lists of a genome of several rows are put together by, before they are put together.
MERGE_PARTS = 16


def sketch_lists(genomes: DataFrame, k: int, size: int = 3000, seq: str = "seq") -> DataFrame:
    """genome_id, kmers: the size least k-mers of each genome (either strand), ascending; genomes of one row, where none has two, leave their tasks with no shuffle.

    A task keeps the size least k-mers of each genome over all its rows, so of a genome of any length a list a task is shuffled and never its k-mers.
    """
    shape = T.StructType([genomes.schema["genome_id"], *T.StructType.fromDDL("kmers array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind, top = None, np.iinfo(np.int64).max

        def out() -> pa.RecordBatch:
            ends = np.r_[0, np.cumsum([len(x) for x in held.values()])].astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *held.values()])
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], shape.names)

        for batch in batches:
            kind = batch.schema.field("genome_id").type
            texts = [(t or "").encode() for t in batch.column("_seq").to_pylist()]
            ids, at = batch.column("genome_id").to_pylist(), 0
            while at < len(texts):
                until, letters = at, 0
                while until < len(texts) and (until == at or letters + len(texts[until]) <= LETTERS_AT_A_TIME):
                    letters += len(texts[until]) + 1
                    until += 1
                raw = np.frombuffer(b"\n".join(texts[at:until]), np.uint8)  # no k-mer lies across a line feed
                names = {g: i for i, g in enumerate(dict.fromkeys(ids[at:until]))}
                genome = np.repeat([names[g] for g in ids[at:until]], [len(t) + 1 for t in texts[at:until]])
                s, bad = CODES[raw], np.r_[0, np.cumsum(~LETTER[raw])]
                whole = np.flatnonzero(bad[k:] == bad[: len(bad) - k]) if len(s) >= k else np.zeros(0, np.int64)
                kmers = np.r_[packed_kmers(s, k)[whole], packed_kmers((3 - s)[::-1], k)[::-1][whole]]
                owner = np.r_[genome[whole], genome[whole]]
                most = np.array([held[g][-1] if len(held.get(g, ())) >= size else top for g in names])
                some = kmers < most[owner]
                kmers, owner = kmers[some], owner[some]
                order = np.argsort(owner, kind="stable")
                kmers, ends = kmers[order], np.searchsorted(owner[order], np.arange(len(names) + 1))
                for g, i in names.items():
                    if ends[i] < ends[i + 1]:
                        held[g] = np.unique(np.r_[held.get(g, np.zeros(0, np.int64)), kmers[ends[i] : ends[i + 1]]])[:size]
                at = until
                if sum(map(len, held.values())) > HELD_KMERS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = genomes.select("genome_id", F.col(seq).alias("_seq")).mapInArrow(run, shape)
    several = genomes.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if several.isEmpty():
        return rows
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kmers")))), 1, size).alias("kmers")
    return rows.groupBy("genome_id", (F.spark_partition_id() % MERGE_PARTS).alias("_part")).agg(least).groupBy("genome_id").agg(least)


#: Rows of a bucket of k-mers that a task puts in order.
BUCKET_ROWS = 400_000


def posting_lists(reps: DataFrame) -> DataFrame:
    """kmer, members (rep, n, rank; by rep) of the k-mers that two of the sketches (rep, n, kmers) or more hold. k-mers are dealt to buckets by a hash; few are
    held twice, so a bucket is sorted as arrays and the others end there."""
    kind = reps.schema["rep"].dataType
    buckets = max(1, int((reps.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS))
    posted = reps.select("rep", "n", F.posexplode("kmers").alias("rank", "kmer")).withColumn("bucket", F.pmod(F.xxhash64("kmer"), F.lit(buckets)).cast("int"))
    member = T.StructType([T.StructField("rep", kind), *T.StructType.fromDDL("n int, rank int").fields])

    def ordered(group: pa.Table) -> pa.Table:
        kmer = group.column("kmer").to_numpy()
        order = np.argsort(kmer, kind="stable")
        new = np.r_[True, np.diff(kmer[order]) != 0]
        many = np.diff(np.r_[np.flatnonzero(new), len(order)])
        order = order[np.repeat(many > 1, many)]
        part = group.take(pa.array(order)).sort_by([("kmer", "ascending"), ("rep", "ascending")]).combine_chunks()
        ends = np.r_[0, np.cumsum(many[many > 1])].astype(np.int32)
        flat = [part.column(c).combine_chunks() if part.num_rows else pa.array([], group.schema.field(c).type) for c in ("kmer", "rep", "n", "rank")]
        rank = pa.array(flat[3].to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(1), pa.int32())
        members = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([flat[1], flat[2], rank], ["rep", "n", "rank"]))
        return pa.Table.from_arrays([flat[0].take(pa.array(ends[:-1])), members], ["kmer", "members"])

    return posted.groupBy("bucket").applyInArrow(ordered, T.StructType([T.StructField("kmer", T.LongType()), T.StructField("members", T.ArrayType(member))]))


#: Sketches of a posting list that a task pairs with as many others.
CHUNK = 256


def paired(lists: DataFrame, wanted: Column, *values: str) -> DataFrame:
    """a, b (structs of a list's members, in their order) and the values, of all pairs of members that the condition on x and y holds for. Long lists are dealt
    by pairs of chunks, so no task pairs the whole of one."""
    chunks = F.ceil(F.size("members") / CHUNK).cast("int")
    cut = lambda i: F.slice("members", i * CHUNK + 1, F.lit(CHUNK))
    one = lists.withColumn("_i", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("_j", F.explode(F.sequence(F.col("_i"), chunks - 1)))
    one = one.select(*values, "_i", "_j", F.when(F.size("members") > CHUNK, cut(F.col("_i"))).otherwise(F.col("members")).alias("_x"), F.when(F.size("members") > CHUNK, cut(F.col("_j"))).otherwise(F.col("members")).alias("_y"))
    several = one.where("_j > 0").repartition("_i", "_j", F.xxhash64(F.get("_x", F.lit(0))))
    pairs = one.where("_j = 0").unionByName(several)
    pairs = pairs.select(*values, "_i", "_j", F.posexplode("_x").alias("_p", "x"), "_y")
    after = F.when(F.col("_i") == F.col("_j"), F.slice("_y", F.col("_p") + 2, F.greatest(F.size("_y") - F.col("_p") - 1, F.lit(0)))).otherwise(F.col("_y"))
    return pairs.select(*values, "x", F.explode(after).alias("y")).where(wanted)


def nearest_sketches(held: DataFrame, size: int = 3000, top: int = 5) -> DataFrame:
    """genome_id, place, other, jaccard: the top nearest genomes of every genome by sketches (genome_id, kmers), of those that share a k-mer; ties by other, at nine places.

    Genomes of equal sketches are one until the end. k-mers that the same sketches hold are one posting list with a weight, so a passage that many genomes share
    pairs them once and not once a k-mer. Two sketches of at most size k-mers together have the Jaccard index of whole sets; for others the shared k-mers
    are put in order, and one counts if its rank in the union (its ranks in both less the shared ones up to it) is at most size.
    """
    held = settled(held.select("genome_id", "kmers", F.xxhash64("kmers").alias("h"), F.xxhash64(F.lit(1), "kmers").alias("h2"), F.size("kmers").alias("n")))
    groups = held.groupBy("h", "h2", "n").agg(F.min("genome_id").alias("rep"))
    of = settled(held.select("genome_id", "h", "h2", "n").join(groups, ["h", "h2", "n"]).select("genome_id", "rep"))
    reps = held.join(of.where("genome_id = rep").select("genome_id"), "genome_id")
    lists = settled(posting_lists(reps.select(F.col("genome_id").alias("rep"), "n", "kmers")))
    whole = F.col("x.n") + F.col("y.n") <= size
    plain = lists.select(F.transform("members", lambda m: F.struct(m["rep"].alias("rep"), m["n"].alias("n"))).alias("members"))
    plain = settled(plain.groupBy(F.xxhash64("members").alias("h"), F.xxhash64(F.lit(1), "members").alias("h2")).agg(F.first("members").alias("members"), F.count(F.lit(1)).alias("m")))
    short = paired(plain, whole, "m").groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.sum("m").alias("s"), F.first(F.col("x.n") + F.col("y.n")).alias("n"))
    short = short.select("a", "b", (F.col("s") / (F.col("n") - F.col("s"))).alias("jaccard"))
    # of sketches that may reach beyond the size least of their union
    long = paired(lists, ~whole, "kmer").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), "kmer", (F.col("x.rank") + F.col("y.rank")).alias("r"), (F.col("x.n") + F.col("y.n")).alias("n"))
    long = long.groupBy("a", "b").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("kmer", "r"))).alias("shared"))
    kept = F.size(F.filter("shared", lambda s, i: s["r"] - i - 1 <= size))
    long = long.select("a", "b", (kept / F.least(F.lit(size), F.col("n") - F.size("shared"))).alias("jaccard"))
    found = settled(short.unionByName(long))
    both = found.select(F.col("a").alias("rep"), F.col("b").alias("with"), "jaccard").union(found.select("b", "a", "jaccard"))
    order = [F.round("jaccard", 9).desc(), "with"]
    both = both.withColumn("_p", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).where(F.col("_p") <= top).drop("_p")
    # the first genomes of each equal sketch, of which one may be the genome itself; a group of equals is numbered where it is larger than that
    first = settled(of.withColumn("_p", F.row_number().over(Window.partitionBy("rep").orderBy("genome_id"))).where(F.col("_p") <= top + 1).drop("_p").withColumnRenamed("genome_id", "other"))
    near = both.join(first.withColumnRenamed("rep", "with"), "with").select("rep", "other", "jaccard")
    copies = first.select("rep", "other", F.lit(1.0).alias("jaccard"))
    best = near.withColumn("_p", F.row_number().over(Window.partitionBy("rep").orderBy(F.round("jaccard", 9).desc(), "other"))).where(F.col("_p") <= top).drop("_p")
    best = best.union(copies).groupBy("rep").agg(F.collect_list(F.struct((-F.round("jaccard", 9)).alias("far"), "other", "jaccard")).alias("near"))  # 2 x top + 1 at most
    own = F.slice(F.array_sort(F.filter("near", lambda x: x["other"] != F.col("genome_id"))), 1, top)
    placed = of.join(best, "rep").select("genome_id", F.posexplode(own).alias("place", "x"))
    return placed.select("genome_id", (F.col("place") + 1).alias("place"), F.col("x.other").alias("other"), F.col("x.jaccard").alias("jaccard"))


def within_lineages(genomes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """lineage, n_r, n_s, mean_r, mean_s, separates: mean wanted k-mers carried by R and S genomes of each lineage; separates: R over 1.5 S + 1."""
    own = genome_kmers(genomes, k).join(wanted_side(wanted), "kmer", "left_semi").groupBy("genome_id").agg(F.count(F.lit(1)).alias("n"))
    rows = genomes.select("genome_id", "label", "lineage").join(own, "genome_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    r, s = (F.avg(F.when(F.col("label") == x, F.col("n"))) for x in "RS")
    out = rows.groupBy("lineage").agg(F.count_if(F.col("label") == "R").alias("n_r"), F.count_if(F.col("label") == "S").alias("n_s"), r.alias("mean_r"), s.alias("mean_s"))
    return out.withColumn("separates", F.col("mean_r") > F.col("mean_s") * 1.5 + 1)


def gene_presence(genes: DataFrame, genomes: DataFrame, scores: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """gene_id, n_r, n_s (genomes with any k-mer of the gene), n_strong, carrier_r, carrier_s: mean shares of R and S genomes that carry the gene's wanted k-mers.

    Tells presence of a gene, which all may have, from an allele that one class has. scores: association() of all k-mers.
    """
    own = genome_kmers(genes.select(F.col("gene_id").alias("genome_id"), "seq"), k).withColumnRenamed("genome_id", "gene_id")
    held = genome_kmers(genomes, k, keep=["label"]).join(own, "kmer").select("gene_id", "genome_id", "label").distinct()
    counts = held.groupBy("gene_id").agg(F.count_if(F.col("label") == "R").alias("n_r"), F.count_if(F.col("label") == "S").alias("n_s"))
    size = genomes.agg(F.count_if(F.col("label") == "R").alias("_r"), F.count_if(F.col("label") == "S").alias("_s"))
    carried = own.join(wanted.select("kmer"), "kmer", "left_semi").join(scores, "kmer").crossJoin(F.broadcast(size))
    carried = carried.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_strong"), F.avg(F.col("cnt_r") / F.col("_r")).alias("carrier_r"), F.avg(F.col("cnt_s") / F.col("_s")).alias("carrier_s"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return genes.select("gene_id").join(counts, "gene_id", "left").join(carried, "gene_id", "left").select("gene_id", zero("n_r"), zero("n_s"), zero("n_strong"), "carrier_r", "carrier_s")


def explained(wanted: DataFrame, genes: DataFrame, k: int) -> DataFrame:
    """One row: n wanted k-mers, summed (k-mers of each gene, double where genes share them) and distinct ones that genes explain, and both as shares of n."""
    own = genome_kmers(genes.select(F.col("gene_id").alias("genome_id"), "seq"), k).groupBy("kmer").agg(F.count(F.lit(1)).alias("genes"))
    sums = wanted.select("kmer").join(own, "kmer", "left").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("genes"), F.lit(0)).alias("summed"), F.count("genes").alias("distinct_kmers"))
    n = F.nullif(F.col("n"), F.lit(0))
    return sums.withColumns({"summed_share": F.col("summed") / n, "distinct_share": F.col("distinct_kmers") / n})


def class_distances(similar: DataFrame, units: DataFrame) -> DataFrame:
    """kind (within, between), n, mean: mean of 1 - jaccard over all pairs of units (unit, class) in the same and in different classes.

    similar (a, b, jaccard) has the pairs that share anything; the others, at distance 1, are counted and never formed."""
    a, b = (units.select(F.col("unit").alias(x), F.col("class").alias(f"class_{x}")) for x in "ab")
    kind = F.when(F.col("class_a") == F.col("class_b"), "within").otherwise("between")
    met = similar.join(a, "a").join(b, "b").groupBy(kind.alias("kind")).agg(F.sum("jaccard").alias("s"))
    sizes = units.groupBy("class").agg(F.count(F.lit(1)).alias("c"))
    whole = sizes.agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("w"))
    rows = whole.select(F.inline(F.array(F.struct(F.lit("within").alias("kind"), F.col("w").alias("n")), F.struct(F.lit("between").alias("kind"), (F.col("n") * (F.col("n") - 1) / 2 - F.col("w")).alias("n")))))
    return rows.join(met, "kind", "left").select("kind", F.col("n").cast("bigint").alias("n"), (1 - F.coalesce("s", F.lit(0.0)) / F.nullif(F.col("n"), F.lit(0.0))).alias("mean"))


def densest(found: DataFrame, genomes: DataFrame, first: int = 5) -> DataFrame:
    """genome_id, n: of the first genomes by id, the one with most hits, the earliest of equal ones."""
    some = genomes.select("genome_id").distinct().orderBy("genome_id").limit(first)
    counts = some.join(found, "genome_id", "left").groupBy("genome_id").agg(F.count("pos").alias("n"))
    return counts.orderBy(F.desc("n"), "genome_id").limit(1)
