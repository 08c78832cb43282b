"""A second, structural channel of window scores and its fusion with composition; keyword verdicts on search hits."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandflow.functions import sequence as S
from strandflow.operators import evaluate
from strandflow.operators.cohort import gene_carriage
from strandflow.operators.evaluate import percentile_rank
from strandflow.operators.measures import CODES, measured, plain_entropy
from strandflow.operators.pieces import contig_lengths, running_sums, windows
from strandflow.plans.session import settled

#: Median and scale of the reference distribution of heterogeneity.
HETEROGENEITY_MEDIAN, HETEROGENEITY_SCALE = 0.00844, 0.00445


def heterogeneity(found: DataFrame, pieces: DataFrame, window: int = 2000) -> DataFrame:
    """contig_id, heterogeneity: population deviation of h3 over a contig's windows, but for one that ends with the contig;
    the reference median for contigs without any. found: contig_id, start, h3."""
    lengths = contig_lengths(pieces)
    spread = found.join(lengths, "contig_id").where(F.col("start") < F.col("contig_length") - window).groupBy("contig_id").agg(F.stddev_pop("h3").alias("h"))
    return lengths.join(spread, "contig_id", "left").select("contig_id", F.coalesce("h", F.lit(HETEROGENEITY_MEDIAN)).alias("heterogeneity"))


def fusion_weight(value: Column) -> Column:
    """Weight of the structural channel, a logistic of the standardised heterogeneity."""
    return 1.0 / (1.0 + F.exp(-(value - HETEROGENEITY_MEDIAN) / HETEROGENEITY_SCALE))


def soft_fusion(rows: DataFrame, order: str = "start") -> DataFrame:
    """rows (contig_id, composite, structural, weight) with fused = 3 x ((1 - weight) x percentile of composite + weight x percentile of structural), contig by contig."""
    pct = lambda c: percentile_rank(["contig_id"], c, order)
    return rows.withColumn("fused", ((1.0 - F.col("weight")) * pct("composite") + F.col("weight") * pct("structural")) * 3.0)


def orders(s: np.ndarray) -> np.ndarray:
    """How each three neighbours of an array of codes lie: 4 if the first is over the second, plus 2 if that is over the third, plus 1 if the first is."""
    return (s[:-2] > s[1:-1]) * 4 + (s[1:-1] > s[2:]) * 2 + (s[:-2] > s[2:])


def structural_distance(rows: DataFrame, level: int = 6) -> DataFrame:
    """rows with structural in the place of seq: how much worse than its contig's mean a window compresses, plus the same of its permutation entropy.

    An own default of the structural channel, not comparable with that of other tools; any column named structural can take its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [s.encode() for s in batch.column("seq").to_pylist()]
            ratio = [len(zlib.compress(s, level)) / max(1, len(s)) for s in texts]
            perm = [plain_entropy(np.bincount(orders(CODES[np.frombuffer(s, np.uint8)]))) for s in texts]
            columns = [*batch.select(kept).columns, pa.array(ratio, pa.float64()), pa.array(perm, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "_ratio", "_perm"])

    kept = [c for c in rows.columns if c != "seq"]
    rows = rows.mapInArrow(run, T.StructType([*rows.drop("seq").schema.fields, T.StructField("_ratio", T.DoubleType()), T.StructField("_perm", T.DoubleType())]))
    mean = lambda c: F.avg(c).over(Window.partitionBy("contig_id"))
    return rows.withColumn("structural", F.abs(F.col("_ratio") - mean("_ratio")) + F.abs(F.col("_perm") - mean("_perm"))).drop("_ratio", "_perm")


def two_channels(found: DataFrame, pieces: DataFrame, window: int = 2000, step: int = 500) -> DataFrame:
    """found (contig_id, start, end, composite; scanned windows of the pieces) with structural, weight and fused: soft fusion of the scan with the
    structural channel, weighed by each contig's heterogeneity."""
    cut = settled(windows(pieces, window, step))
    rows = structural_distance(found.join(cut.select("contig_id", "start", "seq"), ["contig_id", "start"])).withColumn("composite", F.col("composite").cast("double"))
    h3 = measured(cut, wanted=("k3",)).select("contig_id", "start", (S.entropy(F.col("k3")) / 6).alias("h3"))
    weight = heterogeneity(h3, pieces, window).select("contig_id", fusion_weight(F.col("heterogeneity")).alias("weight"))
    return soft_fusion(rows.join(weight, "contig_id"))


def triplet_profile(sequences: DataFrame) -> DataFrame:
    """genome, profile (64 counts): the 3-mers of each genome's sequences (genome, seq). Counts are added up in tasks, so 64 rows a genome leave one; genomes without a 3-mer have no row."""
    each = measured(sequences.select("genome", "seq"), wanted=("k3",)).select("genome", F.posexplode("k3").alias("i", "n"))
    sums = each.groupBy("genome", "i").agg(F.sum("n").alias("n")).where("n > 0")
    return sums.groupBy("genome").agg(S.dense(F.collect_list(F.struct(F.col("i").alias("value"), "n")), 64).alias("profile"))


def jensen_shannon(a: Column, b: Column) -> Column:
    """The Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two arrays of counts of one length; null where one has none."""
    share = lambda c: S.let(S.total(c, 0), lambda n: F.transform(c, lambda x: x / F.nullif(n, F.lit(0))))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).when(p == 0, 0.0)
    bits = S.total(F.zip_with(share(a), share(b), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2)), 0.0) / 2
    return S.let(bits, lambda x: F.when(x > 0, F.sqrt(x)).when(x <= 0, 0.0))


#: Shares of strong k-mers and structural distances beyond which a gene bears evidence.
PHENOTYPE, STRUCTURE = 0.1, 0.3
#: Profiles that are broadcast at most, about half a kilobyte each; more are joined by a shuffle.
BROADCAST_GENOMES = 10_000


def profile_distances(genes: DataFrame, profiles: DataFrame) -> DataFrame:
    """gene_id, genome, structural: how far the 3-mers of each gene (gene_id, genome, seq) are from the profile of its genome; null without a profile."""
    table = settled(profiles)
    few = table.count() <= BROADCAST_GENOMES
    counted = measured(genes.select("gene_id", "genome", "seq"), wanted=("k3",)).select("gene_id", "genome", "k3")
    return counted.join(F.broadcast(table) if few else table, "genome", "left").select("gene_id", "genome", jensen_shannon(F.col("k3"), F.col("profile")).alias("structural"))


def panel(genes: DataFrame, profiles: DataFrame, strong: DataFrame, k: int = 31) -> DataFrame:
    """gene_id, genome, phenotype, structural, evidence of the genes (gene_id, unique; genome; seq) of k letters or more.

    phenotype: the share of a gene's distinct k-mers (both strands) that are strong. structural: how far its 3-mers are from the profile of its genome, an own default of
    the structural channel. DUAL: both are raised (acquired and causal), PHENOTYPE: the first alone (native), STRUCTURE: the second alone. Genes without a profile have a
    null distance and no evidence of structure; shorter genes and null sequences have no row.
    """
    long = genes.where(F.length("seq") >= k)
    placed = profile_distances(long, profiles)
    held = gene_carriage(long.select("gene_id", "seq"), strong, k).select("gene_id", F.col("share").alias("phenotype"))
    causal, foreign = F.round("phenotype", 9) > PHENOTYPE, F.round("structural", 9) > STRUCTURE
    evidence = F.when(causal & foreign, "DUAL").when(causal, "PHENOTYPE").when(foreign, "STRUCTURE").otherwise("NONE")
    return placed.join(held, "gene_id").select("gene_id", "genome", "phenotype", "structural", evidence.alias("evidence"))


def contig_regimes(found: DataFrame) -> DataFrame:
    """contig_id, gc_std, h3_std (thousandths), gc_tail, h3_tail of windows (contig_id, gc, h3): the spread of both over a contig, and how far its most deviant window
    lies from the median in median deviations. Values are taken to six digits, so that a contig's percentiles hold a million different ones at most."""
    rows = settled(found.select("contig_id", *[F.round(c, 6).alias(c) for c in ("gc", "h3")]))
    middle = lambda c: F.percentile(c, F.lit(0.5))
    mid = rows.groupBy("contig_id").agg(*[middle(c).alias(f"_{c}") for c in ("gc", "h3")], *[F.round(F.stddev_pop(c) * 1000, 6).alias(f"{c}_std") for c in ("gc", "h3")])
    away = rows.join(mid, "contig_id").select("contig_id", *[F.round(F.abs(F.col(c) - F.col(f"_{c}")), 6).alias(c) for c in ("gc", "h3")])
    tails = away.groupBy("contig_id").agg(*[F.round(F.max(c) / (middle(c) + 1e-9), 3).alias(f"{c}_tail") for c in ("gc", "h3")])
    return mid.drop("_gc", "_h3").join(tails, "contig_id")


def regime_fusion(genes: DataFrame, regimes: DataFrame, features: list[str]) -> DataFrame:
    """contig_id, n_pos, n_neg, feature, heterogeneity, own, other, mean, selected, soft, best: areas under the curve of two channels of gene scores and of their fusions, contig by contig.

    genes: contig_id, gene_id (unique), is_pos, own, other (no nulls); regimes: contig_id and the features, 0 for contigs without a row. Of the features that which tells best which
    channel wins is taken (largest rank correlation with own - other over all contigs, the first of equal ones), and its sign says whether high values speak for own. mean:
    of both percentiles; selected: the channel that the feature's Otsu cut chooses for the contig; soft: percentiles weighed by the contig's rank by the feature among all contigs;
    best: the better channel. Contigs without an id or without both classes have no row. Genes and contigs are ranked by ranges, so neither a contig nor the set is one task.
    """
    areas = lambda rows, names: evaluate.auc(rows, ["contig_id", "channel"], "v", "is_pos").where("auc is not null").groupBy("contig_id").agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), *[F.max(F.when(F.col("channel") == c, F.col("auc"))).alias(c) for c in names])
    each = lambda **values: F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.round(v, 9).alias("v")) for c, v in values.items()]))
    one = F.lit(1).alias("one")
    long = settled(genes.select("contig_id", "gene_id", "is_pos", each(own=F.col("own"), other=F.col("other")), one))
    single = settled(areas(long, ["own", "other"]))

    known = single.join(regimes, "contig_id", "left").withColumn("won", F.round(F.col("own") - F.col("other"), 9))
    cells = settled(known.select("contig_id", "won", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("x")) for i, c in enumerate(features)])), one))
    ranked = cells
    for c in ("x", "won"):
        levels = cells.groupBy("i", c).agg(F.count(F.lit(1)).alias("n"))
        ranked = ranked.join(evaluate.mid_ranks(levels, ["i"], c, "n").select("i", c, F.col("_rank").alias(f"rank_{c}")), ["i", c])
    told = ranked.groupBy("i").agg(F.round(F.coalesce(F.nanvl(F.corr("rank_x", "rank_won"), F.lit(0.0)), F.lit(0.0)), 9).alias("r"))
    winner = told.orderBy(F.abs("r").desc(), "i").limit(1).select("i", (F.col("r") >= 0).alias("high"))  # of a row a feature

    chosen = settled(cells.join(F.broadcast(winner), "i"))
    cut = evaluate.otsu(chosen, [], "x").select("threshold").crossJoin(chosen.agg(F.count(F.lit(1)).alias("contigs")))
    place = running_sums(chosen, [], ["x", "contig_id"], "one").crossJoin(F.broadcast(cut))
    rank = F.when(F.col("contigs") > 1, F.col("before_one") / F.nullif(F.col("contigs") - 1, F.lit(0))).otherwise(0.0)
    weighed = settled(place.select("contig_id", "feature", F.col("x").alias("heterogeneity"), F.when(F.col("high"), 1.0 - rank).otherwise(rank).alias("weight"), ((F.round("x", 9) >= F.round("threshold", 9)) == F.col("high")).alias("trusts_own")))

    size = genes.groupBy("contig_id").agg(F.count(F.lit(1)).alias("n"))
    share = running_sums(long, ["contig_id", "channel"], ["v", "gene_id"], "one").join(size, "contig_id")
    share = share.withColumn("p", F.when(F.col("n") > 1, F.col("before_one") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(0.0))
    both = share.groupBy("contig_id", "gene_id", "is_pos").agg(*[F.max(F.when(F.col("channel") == c, F.col("p"))).alias(c) for c in ("own", "other")]).join(weighed.select("contig_id", "weight"), "contig_id")
    fused = both.select("contig_id", "is_pos", each(mean=(F.col("own") + F.col("other")) / 2, soft=(1.0 - F.col("weight")) * F.col("own") + F.col("weight") * F.col("other")))
    rows = single.join(areas(settled(fused), ["mean", "soft"]).drop("n_pos", "n_neg"), "contig_id").join(weighed, "contig_id")
    return rows.select("contig_id", "n_pos", "n_neg", "feature", "heterogeneity", "own", "other", "mean", F.when(F.col("trusts_own"), F.col("own")).otherwise(F.col("other")).alias("selected"), "soft", F.greatest("own", "other").alias("best"))


def has_keyword(text: Column, keywords: list[str]) -> Column:
    lowered = F.lower(text)
    return F.coalesce(F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(lowered, k)), F.lit(False))


def classify_hits(hits: DataFrame, keys: list[str], order: str, description: str, wanted: list[str], unwanted: list[str], top: int = 10) -> DataFrame:
    """keys, n, wanted_share, unwanted_share, differential, first_wanted, verdict of each target's top hits by order.

    A hit may count on both sides. Verdict: LIKELY over 0.1, UNLIKELY under -0.1, POSSIBLE with a wanted hit, else UNKNOWN.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, description))
    best = hits.withColumn("_place", place).where(F.col("_place") <= top)
    best = best.withColumns({"_w": has_keyword(F.col(description), wanted), "_u": has_keyword(F.col(description), unwanted)})
    rows = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_w").cast("int")).alias("wanted_share"), F.avg(F.col("_u").cast("int")).alias("unwanted_share"), F.min_by(F.when(F.col("_w"), F.col(description)), F.when(F.col("_w"), F.col("_place"))).alias("first_wanted"))
    rows = rows.withColumn("differential", F.round(F.col("wanted_share") - F.col("unwanted_share"), 9))
    verdict = F.when(F.col("differential") > 0.1, "LIKELY").when(F.col("differential") < -0.1, "UNLIKELY").when(F.col("first_wanted").isNotNull(), "POSSIBLE").otherwise("UNKNOWN")
    return rows.withColumn("verdict", verdict)


def structural_verdict(failed: Column, confidence: Column, hits: Column, differential: Column, wanted: Column) -> Column:
    """The verdict of a fold: failed, disordered (confidence under 0.5), without hits, then by its hits as classify_hits."""
    d = F.round(differential, 9)
    by_hits = F.when(d > 0.1, "LIKELY").when(d < -0.1, "UNLIKELY").when(wanted, "POSSIBLE").otherwise("UNKNOWN")
    return F.when(failed, "FAILED").when(confidence < 0.5, "DISORDERED").when(F.coalesce(hits, F.lit(0)) == 0, "NO_MATCHES").otherwise(by_hits)


def verified(regions: DataFrame, provider: Callable[[list[str]], list[tuple[str | None, list[dict]]]] | None = None, seq: str = "seq") -> DataFrame:
    """regions with pdb and hits (array of description, evalue) from a provider of folds and searches, which gets a batch of sequences in a worker; without one both are null.
    folding_confidence, classify_hits and structural_verdict judge them."""
    new = T.StructType.fromDDL("pdb string, hits array<struct<description:string,evalue:double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(new)
        for batch in batches:
            told = provider(batch.column(seq).to_pylist()) if provider else [(None, None)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([t[i] for t in told], kinds.field(i).type) for i in range(2))], [*batch.schema.names, *new.names])

    return regions.mapInArrow(run, T.StructType([*regions.schema.fields, *new.fields]))


def selected_fusion(rows: DataFrame, cut: DataFrame, order: str = "start") -> DataFrame:
    """rows (contig_id, composite, structural, heterogeneity) with mean (of both percentiles), selected (composite's in contigs whose heterogeneity reaches the
    cut, one row of threshold, else structural's) and best (the larger, which an oracle would choose)."""
    pct = lambda c: percentile_rank(["contig_id"], c, order)
    ranked = rows.withColumns({"_c": pct("composite"), "_s": pct("structural")}).crossJoin(F.broadcast(cut))
    chosen = F.when(F.round("heterogeneity", 9) >= F.round("threshold", 9), F.col("_c")).otherwise(F.col("_s"))
    return ranked.withColumns({"mean": (F.col("_c") + F.col("_s")) / 2.0, "selected": chosen, "best": F.greatest("_c", "_s")}).drop("_c", "_s", "threshold")


def folding_confidence(pdb: Column) -> Column:
    """Mean of columns 61 to 66 over the alpha-carbon ATOM lines of a structure file; null without any."""
    lines = F.filter(F.split(pdb, "\n"), lambda x: x.startswith("ATOM") & (F.trim(F.substring(x, 13, 4)) == "CA"))
    values = F.transform(lines, lambda x: F.trim(F.substring(x, 61, 6)).cast("double"))
    return F.when(F.size(values) > 0, S.total(values) / F.size(values))
