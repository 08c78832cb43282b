"""Every query of the sequence engine by name, and SQL of the same rows. All read whole tables; doubles are rounded to six places in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions import sequence as S
from strandflow.operators import cluster, cohort, evaluate, fusion, lloyd, merge, pieces, resonance, scan
from strandflow.operators.measures import measured
from strandflow.plans import oracle as O
from strandflow.plans.session import settled
from strandflow.sources import documents as D
from strandflow.sources import reports

W, STEP = O.W, O.STEP
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with DuckDB SQL of its rows where that can express them."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(column) -> object:
    return F.round(column, 6)


def contig_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.windows(D.contig_pieces(spark, sf_dir), W, STEP)


def window_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, start, end, gc: the GC content of the windows, by counts of tiles."""
    found = settled(pieces.window_letters(D.contig_pieces(spark, sf_dir), W, STEP, {"gc": "CG"}))  # small rows that are read twice
    return found.select("contig_id", "start", "end", (F.col("gc") / (F.col("end") - F.col("start"))).alias("gc"))


def measured_windows(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """The windows with the wanted counts and measures."""
    return measured(contig_windows(spark, sf_dir), wanted=wanted)


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.letters()},
z AS (SELECT w.contig_id, w.start, w."end", c + g AS gc, abs(c + g - avg(c + g) OVER ()) / greatest(stddev_pop(c + g) OVER (), 1e-6) AS z FROM wins w JOIN letters_wins USING (contig_id, window_no)),
r AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY round(z, 9) DESC, start) AS place FROM z)
SELECT contig_id, CAST(place AS INT) AS place, start, "end", round(gc, 6) AS gc, round(z, 6) AS z FROM r WHERE place <= 5"""
)
def window_gc_topk(spark, sf_dir):
    """The five windows of each contig whose GC content is farthest from that of all windows."""
    gc = window_gc(spark, sf_dir)
    stats = gc.agg(F.avg("gc").alias("m"), F.greatest(F.stddev_pop("gc"), F.lit(1e-6)).alias("s"))
    z = gc.crossJoin(F.broadcast(stats)).withColumn("z", F.abs(F.col("gc") - F.col("m")) / F.col("s"))
    place = F.row_number().over(Window.partitionBy("contig_id").orderBy(F.round("z", 9).desc(), "start"))
    return z.withColumn("place", place).where("place <= 5").select("contig_id", "place", "start", "end", r6("gc").alias("gc"), r6("z").alias("z"))


@query(
    f"""WITH {O.DOCS}, d AS (SELECT doc_id AS contig_id, 0 AS window_no, seq FROM doc_seq), e AS (SELECT contig_id, {O.ENTROPY} AS h FROM {O.grams(1, 'd')} GROUP BY contig_id)
SELECT d.contig_id AS doc_id, CAST(length(d.seq) AS INT) AS n, round(coalesce(e.h, 0), 6) AS entropy FROM d LEFT JOIN e USING (contig_id)"""
)
def symbol_entropy(spark, sf_dir):
    docs = D.document_sequences(spark, sf_dir)
    return docs.select("doc_id", F.length("seq").alias("n"), r6(S.entropy(S.counts(S.codes(F.col("seq"))))).alias("entropy"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.entropies('h3', 3)}, {O.entropies('h4', 4)}
SELECT contig_id, start, round(h3.h / 6, 6) AS h3, round(h4.h / 8, 6) AS h4 FROM wins JOIN h3 USING (contig_id, window_no) JOIN h4 USING (contig_id, window_no)"""
)
def kmer_entropy(spark, sf_dir):
    m = measured_windows(spark, sf_dir, "k3", "k4")
    return m.select("contig_id", "start", r6(S.entropy(F.col("k3")) / 6).alias("h3"), r6(S.entropy(F.col("k4")) / 8).alias("h4"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.entropies('a', 1)}, {O.entropies('b', 2)}
SELECT contig_id, start, round(greatest(2 * a.h - b.h, 0), 6) AS mi1 FROM wins JOIN a USING (contig_id, window_no) JOIN b USING (contig_id, window_no)"""
)
def mi_lag1(spark, sf_dir):
    return measured_windows(spark, sf_dir, "k1", "k2").select("contig_id", "start", r6(S.information(F.col("k1"), F.col("k2"))).alias("mi1"))


@query(f"WITH {O.CONTIGS}, {O.windows()}, {O.SPINE2}, {O.rho('r')} SELECT contig_id, window_no * {STEP} AS start, g AS pair, round(rho, 6) AS rho FROM r")
def rho_vector(spark, sf_dir):
    m = measured_windows(spark, sf_dir, "k1", "k2").select("contig_id", "start", F.posexplode(S.rho_from_counts(F.col("k1"), F.col("k2"))).alias("i", "rho"))
    pair = F.concat(F.substring(F.lit("ACGT"), F.floor(F.col("i") / 4).cast("int") + 1, F.lit(1)), F.substring(F.lit("ACGT"), F.col("i") % 4 + 1, F.lit(1)))
    return m.select("contig_id", "start", pair.alias("pair"), r6("rho").alias("rho"))


@query(f"WITH {O.CONTIGS}, {O.windows()}, {O.letters()} SELECT contig_id, start, round(abs(a - t) + abs(c - g), 6) AS c2 FROM wins JOIN letters_wins USING (contig_id, window_no)")
def chargaff(spark, sf_dir):
    return contig_windows(spark, sf_dir).select("contig_id", "start", r6(S.chargaff_deviation(F.col("seq"))).alias("c2"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows('tiles', window=1000, step=1000)}, {O.letters('tiles')},
s AS (SELECT contig_id, window_no, coalesce((g - c) / nullif(g + c, 0), 0) AS skew FROM tiles JOIN letters_tiles USING (contig_id, window_no) WHERE length(seq) = 1000)
SELECT contig_id, CAST(window_no * 1000 + 500 AS BIGINT) AS position, round(skew, 6) AS skew, round(sum(skew) OVER (PARTITION BY contig_id ORDER BY window_no), 6) AS cumulative FROM s"""
)
def gc_skew_cumulative(spark, sf_dir):
    """(G - C) / (G + C) of whole tiles of 1000 letters, and its running sum, whose extremes mark origin and terminus."""
    tiles = pieces.windows(D.contig_pieces(spark, sf_dir), 1000, 1000).where(F.length("seq") == 1000)
    n = lambda c: F.length(F.regexp_replace("seq", f"[^{c}]", ""))
    skew = tiles.select("contig_id", (F.col("start") + 500).alias("position"), F.coalesce((n("G") - n("C")) / F.nullif(n("G") + n("C"), F.lit(0)), F.lit(0.0)).alias("skew"))
    run = F.sum("skew").over(Window.partitionBy("contig_id").orderBy("position"))
    return skew.select("contig_id", "position", r6("skew").alias("skew"), r6(run).alias("cumulative"))


@query(f"WITH {O.DOCS} SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp_md5 FROM doc_seq")
def revcomp(spark, sf_dir):
    return D.document_sequences(spark, sf_dir).select("doc_id", F.md5(S.reverse_complement(F.col("seq")).cast("binary")).alias("revcomp_md5"))


def codon_name(number: str) -> Column:
    """The three letters of a codon's number."""
    letter = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    return F.concat(letter(F.floor(F.col(number) / 16)), letter(F.floor(F.col(number) / 4)), letter(F.col(number)))


@query(f"WITH {O.DOCS}, d AS (SELECT lang AS contig_id, 0 AS window_no, seq FROM doc_seq) SELECT contig_id AS lang, g AS codon, CAST(sum(n) AS BIGINT) AS n FROM {O.grams(3, 'd', every=3)} GROUP BY contig_id, g")
def codon_counts(spark, sf_dir):
    docs = D.document_sequences(spark, sf_dir).withColumn("s", S.codes(F.col("seq")))
    each = docs.select("lang", F.inline(S.histogram(S.codons(F.col("s")))))
    return each.groupBy("lang", codon_name("value").alias("codon")).agg(F.sum("n").alias("n"))


@query(f"WITH {O.CONTIGS}, {O.windows()}, {O.hurst()} SELECT contig_id, window_no * {STEP} AS start, round(h, 6) AS hurst FROM hurst")
def hurst(spark, sf_dir):
    return measured_windows(spark, sf_dir, "hurst").select("contig_id", "start", r6("hurst").alias("hurst"))


@query(f"WITH {O.CONTIGS}, {O.windows()}, {O.period3()} SELECT contig_id, window_no * {STEP} AS start, round(h, 6) AS ac3 FROM ac")
def autocorr_period3(spark, sf_dir):
    return measured_windows(spark, sf_dir, "autocorrelation").select("contig_id", "start", r6(S.period3_share(F.col("autocorrelation"))).alias("ac3"))


@query(f"WITH {O.CONTIGS}, {O.windows()}, {O.SPINE3}, {O.rscu('r')} SELECT contig_id, window_no * {STEP} AS start, g AS codon, round(rscu, 6) AS rscu FROM r")
def rscu(spark, sf_dir):
    m = measured_windows(spark, sf_dir, "codon").select("contig_id", "start", F.posexplode(S.rscu_from_counts(F.col("codon"))).alias("i", "rscu"))
    return m.select("contig_id", "start", codon_name("i").alias("codon"), r6("rscu").alias("rscu"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.entropies('a', 3, 3)}, {O.entropies('b', 6, 3)}
SELECT contig_id, start, round(greatest(2 * a.h - b.h, 0), 6) AS codon_mi FROM wins JOIN a USING (contig_id, window_no) JOIN b USING (contig_id, window_no)"""
)
def codon_mi(spark, sf_dir):
    return measured_windows(spark, sf_dir, "codon", "pair_n").select("contig_id", "start", r6(S.information(F.col("codon"), F.col("pair_n"))).alias("codon_mi"))


NO_WINDOW = ", ".join(f"round({s}, 6) AS {s}" for s in O.NAMES)


@query(f"WITH {O.CONTIGS}, {O.SPINE2}, {O.SPINE3}, {O.profile()}, {O.windows()}, {O.signals('sig', 'wins')} SELECT contig_id, start, {NO_WINDOW} FROM sig")
def window_signals(spark, sf_dir):
    """The ten signals of every window, distances against the profile of all contigs."""
    p = settled(D.contig_pieces(spark, sf_dir))
    found = scan.signals(pieces.windows(p, W, STEP), scan.host_profile(D.host_pieces(p)))
    return found.select("contig_id", "start", *[r6(s).alias(s) for s in O.NAMES])


@query(f"{O.SCAN} SELECT {', '.join(f'round({s}_{x}, 6) AS {s}_{x}' for s in O.NAMES for x in ('mean', 'std'))} FROM stats")
def baseline_stats(spark, sf_dir):
    stats = scan.baseline_stats(D.host_pieces(D.contig_pieces(spark, sf_dir)), W, W)
    return stats.select(*[r6(c).alias(c) for c in stats.columns])


def zscored(spark: SparkSession, sf_dir: str, p: DataFrame | None = None, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signals of the whole windows, and their z-scores. p: the contigs' pieces, settled, where the caller has them. kept: the signals are taken once and
    settled, for callers that read them besides the z-scores."""
    p = settled(D.contig_pieces(spark, sf_dir)) if p is None else p  # read by the profile, the baseline and the windows
    host = D.host_pieces(p)
    profile = settled(scan.host_profile(host))
    stats = scan.baseline_stats(host, W, W, profile=profile)
    found = scan.signals(pieces.windows(p, W, STEP).where(F.col("end") - F.col("start") == W), profile)
    found = settled(found) if kept else found
    return found, scan.z_scores(found, stats)


def scored(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    return scan.composite(zscored(spark, sf_dir, p)[1])


@query(f"{O.SCAN} SELECT contig_id, start, {', '.join(f'round({s}, 6) AS {s}' for s in scan.FUSED)} FROM z")
def scan_zscores(spark, sf_dir):
    return scored(spark, sf_dir).select("contig_id", "start", *[r6(s).alias(s) for s in scan.FUSED])


@query(f"{O.SCAN} SELECT contig_id, start, round(geomean, 6) AS geomean, round(rankfusion, 6) AS rankfusion, track, round(composite, 6) AS composite FROM scored")
def scan_composite(spark, sf_dir):
    return scored(spark, sf_dir).select("contig_id", "start", r6("geomean").alias("geomean"), r6("rankfusion").alias("rankfusion"), "track", r6("composite").alias("composite"))


@query(f'{O.SCAN}, {O.SUPPRESSED} SELECT contig_id, start, "end", round(composite, 6) AS composite FROM kept')
def scan_dedup(spark, sf_dir):
    return scan.suppressed(scored(spark, sf_dir)).select("contig_id", "start", "end", r6("composite").alias("composite"))


@query(f"{O.SCAN}, {O.SUPPRESSED}, {O.CONTEXT} SELECT contig_id, start, context_class, round(context_boost, 6) AS context_boost, round(boosted, 6) AS boosted FROM boosted")
def context_boost(spark, sf_dir):
    rows = scan.with_context(scan.suppressed(scored(spark, sf_dir)))
    return rows.select("contig_id", "start", "context_class", r6("context_boost").alias("context_boost"), r6("boosted").alias("boosted"))


@query(
    f"""{O.SCAN}, {O.SUPPRESSED}, {O.CONTEXT},
moves AS (SELECT context_class AS from_state, lead(context_class) OVER (PARTITION BY contig_id ORDER BY start) AS to_state FROM context)
SELECT from_state, to_state, count(*) AS n FROM moves WHERE to_state IS NOT NULL GROUP BY ALL"""
)
def region_transitions(spark, sf_dir):
    return scan.transitions(scan.with_context(scan.suppressed(scored(spark, sf_dir))), ["contig_id"], "start", "context_class")


EVIDENCE = "[" + ", ".join(f"{{'z': round({s}, 9), 'i': {i}, 'name': '{s}'}}" for i, s in enumerate(scan.FUSED)) + "]"


@query(
    f"""{O.SCAN}, {O.SUPPRESSED}, {O.CONTEXT},
placed AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY boosted DESC, start) AS place FROM boosted),
ev AS (SELECT contig_id, place, start, "end", least(boosted / 3.0::DOUBLE, 1.0::DOUBLE) AS confidence, unnest({EVIDENCE}) AS e FROM placed WHERE place <= 20),
txt AS (SELECT contig_id, place, start, "end", confidence, coalesce(string_agg(e.name || ': z=' || printf('%.1f', round(e.z, 1)), '; ' ORDER BY e.z DESC, e.i) FILTER (WHERE e.z > 1.5), '') AS evidence FROM ev GROUP BY ALL),
best AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, contig_id, place) AS rank FROM txt)
SELECT CAST(rank AS INT) AS rank, contig_id, start, "end", round(confidence, 6) AS confidence, evidence FROM best WHERE rank <= 20"""
)
def candidates(spark, sf_dir):
    """The top 20 candidate regions (a top-k report)."""
    top = scan.candidates(scan.with_context(scan.suppressed(scored(spark, sf_dir))), 20)
    return top.select("rank", "contig_id", "start", "end", r6("confidence").alias("confidence"), F.array_join("evidence", "; ").alias("evidence"))


@query(
    """WITH v AS (SELECT event_type, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
s AS (SELECT event_type, v, row_number() OVER w AS i, sum(v) OVER (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING) AS s0, count(*) OVER (PARTITION BY event_type) AS n, sum(v) OVER (PARTITION BY event_type) AS s, lead(v) OVER w AS after FROM v WINDOW w AS (PARTITION BY event_type ORDER BY v)),
b AS (SELECT *, CASE WHEN after IS NULL OR after = v THEN 0 ELSE round(i * (n - i) / (CAST(n AS DOUBLE) * n) * (s0 / i - (s - s0) / (n - i)) ** 2, 9) END AS between_ FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY between_ DESC, v) AS o FROM b)
SELECT event_type, round((v + coalesce(after, v)) / 2, 6) AS threshold, round(between_, 4) AS between_variance FROM r WHERE o = 1"""
)
def otsu_threshold(spark, sf_dir):
    found = evaluate.otsu(D.table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", r6("threshold").alias("threshold"), F.round("between", 4).alias("between_variance"))


def scored_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with the largest GC deviation (from the contig's mean window) among the windows that overlap them, 0 without one."""
    gc = window_gc(spark, sf_dir)
    mean = gc.groupBy("contig_id").agg(F.avg("gc").alias("m"))
    dev = gc.join(mean, "contig_id").select("contig_id", "start", "end", F.round(F.abs(F.col("gc") - F.col("m")), 9).alias("dev"))
    hit = pieces.overlaps(D.genes(spark, sf_dir), dev, W, ["contig_id"], "left")
    return hit.groupBy("contig_id", "gene_id", "start", "end", "is_pos").agg(F.coalesce(F.max("dev"), F.lit(0.0)).alias("score"))


@query(f'WITH {O.GENE_SCORES} SELECT contig_id, gene_id, start, "end", is_pos, round(score, 6) AS score FROM gene_scores')
def gene_scores(spark, sf_dir):
    return scored_genes(spark, sf_dir).withColumn("score", r6("score"))


AUC_SQL = "count(*) FILTER (WHERE is_pos) AS n_pos, count(*) FILTER (WHERE NOT is_pos) AS n_neg"
RANKS = "rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS rk"


@query(
    f"""WITH {O.GENE_SCORES}, r AS (SELECT contig_id, is_pos, {RANKS.format(k='contig_id')} FROM gene_scores), c AS (SELECT contig_id, {AUC_SQL}, sum(rk) FILTER (WHERE is_pos) AS s FROM r GROUP BY contig_id)
SELECT contig_id, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) AS auc FROM c WHERE n_pos >= 1 AND n_neg >= 3"""
)
def auc_per_contig(spark, sf_dir):
    """AUC of the contigs with a positive and three negatives at least."""
    found = evaluate.auc(scored_genes(spark, sf_dir), ["contig_id"], "score", "is_pos").where("n_pos >= 1 and n_neg >= 3")
    return found.withColumn("auc", r6("auc"))


@query(
    f"""WITH {O.GENE_SCORES}, r AS (SELECT is_pos, {RANKS.format(k='1')} FROM gene_scores), c AS (SELECT {AUC_SQL}, sum(rk) FILTER (WHERE is_pos) AS s FROM r)
SELECT n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) AS auc FROM c"""
)
def auc_pooled(spark, sf_dir):
    return evaluate.auc(scored_genes(spark, sf_dir), [], "score", "is_pos").withColumn("auc", r6("auc"))


@query(
    f"""WITH {O.GENE_SCORES}, p AS (SELECT contig_id, is_pos, row_number() OVER (PARTITION BY contig_id ORDER BY score DESC, start) AS place FROM gene_scores),
b AS (SELECT contig_id, min(place) AS best FROM p WHERE is_pos GROUP BY contig_id)
SELECT CAST(k AS INT) AS k, round(avg((best <= k)::INT), 6) AS recall FROM b, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k"""
)
def recall_at_k(spark, sf_dir):
    return evaluate.recall_at(scored_genes(spark, sf_dir), ["contig_id"], "score", "start", "is_pos").withColumn("recall", r6("recall"))


@query(
    f"""WITH {O.GENE_SCORES}, x AS (SELECT "end" - start AS len, score FROM gene_scores),
r AS (SELECT rank() OVER (ORDER BY len) + (count(*) OVER (PARTITION BY len) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM x)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"""
)
def spearman(spark, sf_dir):
    rows = scored_genes(spark, sf_dir).select((F.col("end") - F.col("start")).alias("len"), "score")
    return evaluate.spearman(rows, "len", "score").withColumn("rho", r6("rho"))


@query(
    f"""WITH {O.GENE_SCORES}, r AS (SELECT contig_id, is_pos, {RANKS.format(k='contig_id')} FROM gene_scores),
t AS (SELECT contig_id, sum(c ** 3 - c) AS t FROM (SELECT contig_id, score, count(*) AS c FROM gene_scores GROUP BY ALL) GROUP BY contig_id),
c AS (SELECT contig_id, {AUC_SQL}, coalesce(sum(rk) FILTER (WHERE is_pos), 0) AS s FROM r GROUP BY contig_id), u AS (SELECT *, s - n_pos * (n_pos + 1) / 2.0 AS u, n_pos + n_neg AS n FROM c JOIN t USING (contig_id))
SELECT contig_id, round(u, 6) AS u, round((u - n_pos * n_neg / 2.0) / nullif(sqrt(n_pos * n_neg / 12.0 * (n + 1 - t / nullif(n * (n - 1), 0))), 0), 6) AS z FROM u"""
)
def rank_test(spark, sf_dir):
    """Mann-Whitney test of positive against other genes, contig by contig."""
    found = evaluate.rank_test(scored_genes(spark, sf_dir), ["contig_id"], "score", "is_pos")
    return found.select("contig_id", r6("u").alias("u"), r6("z").alias("z"))


@query(f"WITH {O.ISOLATES} SELECT kmer, cnt_r, cnt_s, round(score, 6) AS score FROM assoc")
def kmer_gwas(spark, sf_dir):
    return cohort.association(D.isolates(spark, sf_dir), O.K).withColumn("score", r6("score"))


def strong_kmers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.strong(cohort.association(D.isolates(spark, sf_dir), O.K), 0.35)


@query(f"WITH {O.ISOLATES} SELECT kmer, round(score, 6) AS score FROM assoc WHERE round(score, 9) >= 0.35")
def strong_kmers(spark, sf_dir):
    return strong_kmers_of(spark, sf_dir).select("kmer", r6("score").alias("score"))


@query(
    f"""WITH {O.ISOLATES}, m AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY genome_id ORDER BY pos) > 100)::INT, 1) AS fresh FROM doc_hits),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY genome_id ORDER BY pos) AS island FROM m)
SELECT genome_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) + {O.K} AS INT) AS "end", count(*) AS n FROM g GROUP BY genome_id, island"""
)
def localize_loci(spark, sf_dir):
    found = cohort.hits(D.isolates(spark, sf_dir), strong_kmers_of(spark, sf_dir), O.K)
    return cohort.loci(found, O.K, 100)


@query(
    f"""WITH {O.ISOLATES}, own AS (SELECT DISTINCT genome_id, kmer FROM gkmers)
SELECT genome_id AS gene_id, count(*) AS n_kmers, count(*) FILTER (WHERE kmer IN (SELECT kmer FROM strong)) AS n_wanted, round(avg((kmer IN (SELECT kmer FROM strong))::INT), 6) AS share FROM own GROUP BY genome_id"""
)
def gene_overlap(spark, sf_dir):
    genes = D.isolates(spark, sf_dir).select(F.col("genome_id").alias("gene_id"), "seq")
    return cohort.gene_carriage(genes, strong_kmers_of(spark, sf_dir), O.K).withColumn("share", r6("share"))


@query(f"WITH {O.ISOLATES} SELECT kmer FROM assoc WHERE kmer NOT IN (SELECT kmer FROM gkmers WHERE lineage = 'en')")
def explained_residual(spark, sf_dir):
    """Informative k-mers that no English genome holds."""
    genomes = D.isolates(spark, sf_dir)
    return cohort.residual(cohort.association(genomes, O.K), genomes.where("lineage = 'en'").select(F.col("genome_id").alias("gene_id"), "seq"), O.K).select("kmer")


@query(
    f"""WITH {O.ISOLATES}, lk AS (SELECT DISTINCT lineage || '-' || label AS g, kmer FROM gkmers),
sk AS (SELECT g, kmer FROM (SELECT g, kmer, row_number() OVER (PARTITION BY g ORDER BY kmer) AS r FROM lk) WHERE r <= 200),
u AS (SELECT a.g AS a, b.g AS b, x.kmer, count(*) AS c FROM (SELECT DISTINCT g FROM sk) a JOIN (SELECT DISTINCT g FROM sk) b ON a.g < b.g JOIN sk x ON x.g IN (a.g, b.g) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY kmer) AS r FROM u)
SELECT a, b, round(avg((c = 2)::INT), 6) AS jaccard FROM o WHERE r <= 200 GROUP BY a, b HAVING sum((c = 2)::INT) > 0"""
)
def minhash_jaccard(spark, sf_dir):
    """Similarity of the bottom-200 sketches of lineage and phenotype groups."""
    rows = D.isolates(spark, sf_dir).select(F.concat_ws("-", "lineage", "label").alias("genome_id"), "seq")
    return cohort.sketch_similarity(cohort.sketches(rows, O.K, 200), 200, zero=False).withColumn("jaccard", r6("jaccard"))


@query(
    f"""WITH {O.ISOLATES}, c AS (SELECT i.genome_id, i.label, i.lineage, count(g.kmer) AS n FROM isolates i LEFT JOIN (SELECT DISTINCT genome_id, kmer FROM gkmers WHERE kmer IN (SELECT kmer FROM strong)) g USING (genome_id) GROUP BY ALL),
m AS (SELECT lineage, count(*) FILTER (WHERE label = 'R') AS n_r, count(*) FILTER (WHERE label = 'S') AS n_s, avg(n) FILTER (WHERE label = 'R') AS mean_r, avg(n) FILTER (WHERE label = 'S') AS mean_s FROM c GROUP BY lineage)
SELECT lineage, n_r, n_s, round(mean_r, 6) AS mean_r, round(mean_s, 6) AS mean_s, mean_r > 1.5 * mean_s + 1 AS separates FROM m"""
)
def within_lineage(spark, sf_dir):
    found = cohort.within_lineages(D.isolates(spark, sf_dir), strong_kmers_of(spark, sf_dir), O.K)
    return found.withColumns({"mean_r": r6("mean_r"), "mean_s": r6("mean_s")})


@query(
    """WITH c AS (SELECT label AS t, CAST(floor((embedding[1] + 1) * 5) AS INT) AS f, CAST(count(*) AS DOUBLE) AS c FROM embeddings GROUP BY ALL),
a AS (SELECT t, sum(c) AS a FROM c GROUP BY t), b AS (SELECT f, sum(c) AS b FROM c GROUP BY f), n AS (SELECT sum(c) AS n FROM c),
s AS (SELECT (SELECT n FROM n) AS n, (SELECT sum(c * (c - 1) / 2) FROM c) AS cc, (SELECT sum(a * (a - 1) / 2) FROM a) AS aa, (SELECT sum(b * (b - 1) / 2) FROM b) AS bb,
  (SELECT sum(c / n * ln(c * n / (a * b))) FROM c JOIN a USING (t) JOIN b USING (f), n) AS mi, (SELECT -sum(a / n * ln(a / n)) FROM a, n) AS ha, (SELECT -sum(b / n * ln(b / n)) FROM b, n) AS hb,
  (SELECT sum(m) FROM (SELECT max(c) AS m FROM c GROUP BY f)) AS best)
SELECT CAST(n AS BIGINT) AS n, round((cc - aa * bb / (n * (n - 1) / 2)) / ((aa + bb) / 2 - aa * bb / (n * (n - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(best / n, 6) AS purity FROM s"""
)
def label_agreement(spark, sf_dir):
    """ARI, NMI and purity of the embeddings' labels and bins of their first component."""
    rows = D.table(spark, sf_dir, "embeddings").select("label", F.floor((F.get("embedding", F.lit(0)) + F.lit(1).cast("float")) * F.lit(5).cast("float")).cast("int").alias("bin"))
    found = evaluate.agreement(rows, "label", "bin")
    return found.select("n", r6("ari").alias("ari"), r6("nmi").alias("nmi"), r6("purity").alias("purity"))


FRAGMENT = 5000


FRAGMENTS = f"""wins AS MATERIALIZED (SELECT contig_id, k AS window_no, k * {FRAGMENT} AS start, substr(seq, k * {FRAGMENT} + 1, {FRAGMENT}) AS seq
  FROM (SELECT contig_id, seq, unnest(range(0, (length(seq) + {FRAGMENT - 1}) // {FRAGMENT})) AS k FROM contigs WHERE length(seq) > 0)), {O.features('f', 'wins')}"""
FRAGMENT_Z = f"WITH RECURSIVE {O.CONTIGS}, {O.SPINE2}, {FRAGMENTS}, {O.vectors('v', 'f')}"
NAME_OF = "[" + ", ".join(f"'{x}'" for x in cluster.FEATURES) + "][i + 1]"


@query(f"WITH {O.CONTIGS}, {O.SPINE2}, {FRAGMENTS} SELECT contig_id, window_no, {NAME_OF} AS feature, round(value, 6) AS value FROM f")
def features22(spark, sf_dir):
    """The 22 features of fragments of 5000 letters; a contig's last one is as long as what is left."""
    found = cluster.features(fragments5000(spark, sf_dir)).select("contig_id", "window_no", F.posexplode("features").alias("i", "value"))
    name = F.get(F.array(*[F.lit(x) for x in cluster.FEATURES]), F.col("i"))
    return found.select("contig_id", "window_no", name.alias("feature"), r6("value").alias("value"))


def fragments5000(spark, sf_dir):
    return pieces.windows(D.contig_pieces(spark, sf_dir), FRAGMENT, FRAGMENT, tail=True)


def fragment_z(spark, sf_dir):
    return cluster.standardised(cluster.features(fragments5000(spark, sf_dir)))


def fragment_confusions(spark, sf_dir, models: list[lloyd.Model], starts: int) -> DataFrame:
    return lloyd.confusions(settled(fragment_z(spark, sf_dir)), models, starts, 10, F.concat_ws(":", "contig_id", "window_no"), "contig_id")


@query(
    f"""{FRAGMENT_Z}, {O.k_means("SELECT 'all' AS model, 4 AS k, NULL::INT AS without, NULL::VARCHAR AS x, NULL::VARCHAR AS y", 20, 10)},
nmi AS (SELECT sum(n / s * ln(n * s / (a * b))) AS mi, sum(-n / s * ln(a / s)) AS ha, sum(-n / s * ln(b / s)) AS hb FROM (SELECT n, sum(n) OVER () AS s, sum(n) OVER (PARTITION BY label) AS a, sum(n) OVER (PARTITION BY cluster) AS b FROM confusion))
SELECT CAST(n AS BIGINT) AS n, round(ari, 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round((SELECT sum(m) FROM (SELECT max(n) AS m FROM confusion GROUP BY cluster)) / n, 6) AS purity FROM agreed, nmi"""
)
def kmeans_fragments(spark, sf_dir):
    """Agreement of k-means clusters of the fragments (the best of 20 starts) with their contigs."""
    found = evaluate.agreement(fragment_confusions(spark, sf_dir, [lloyd.Model("all", 4)], 20), "label", "cluster", count="n")
    return found.select("n", r6("ari").alias("ari"), r6("nmi").alias("nmi"), r6("purity").alias("purity"))


WITHOUT = ", ".join(f"{{'f': '{x}', 'i': {i}}}" for i, x in enumerate(cluster.FEATURES, 1))


@query(
    f"""{FRAGMENT_Z}, {O.k_means(f"SELECT m.f AS model, (SELECT count(DISTINCT contig_id) FROM v) AS k, m.i AS without, NULL::VARCHAR AS x, NULL::VARCHAR AS y FROM (SELECT unnest([{{'f': 'all', 'i': NULL}}, {WITHOUT}]) AS m)", 10, 10)}
SELECT model AS feature, round(ari, 6) AS ari, round((SELECT ari FROM agreed WHERE model = 'all') - ari, 6) AS ari_drop FROM agreed"""
)
def leave_one_feature_out(spark, sf_dir):
    """ARI of k-means (as many clusters as contigs, the best of 10 starts) with their contigs without each feature, and what is lost against all features."""
    rows = fragment_z(spark, sf_dir)
    k = rows.select("contig_id").distinct().count()
    models = [lloyd.Model("all", k), *(lloyd.Model(x, k, without=i) for i, x in enumerate(cluster.FEATURES))]
    found = settled(evaluate.agreement(fragment_confusions(spark, sf_dir, models, 10), "label", "cluster", ["model"], "n").select("model", "ari"))
    whole = found.where("model = 'all'").select(F.col("ari").alias("_all"))  # one row
    return found.crossJoin(F.broadcast(whole)).select(F.col("model").alias("feature"), r6("ari").alias("ari"), r6(F.col("_all") - F.col("ari")).alias("ari_drop"))


PAIRS = "SELECT a.contig_id || ' ' || b.contig_id AS model, 2 AS k, NULL::INT AS without, a.contig_id AS x, b.contig_id AS y FROM sizes a JOIN sizes b ON a.contig_id < b.contig_id AND a.n + b.n >= 10"


@query(
    f"""{FRAGMENT_Z}, sizes AS (SELECT contig_id, count(*) AS n FROM v GROUP BY contig_id), {O.k_means(PAIRS, 10, 10)}
SELECT split_part(model, ' ', 1) AS a, split_part(model, ' ', 2) AS b, round(ari, 6) AS ari, ari < 0.5 AS hard FROM agreed"""
)
def pairwise_separability(spark, sf_dir):
    """ARI of two clusters (the best of 10 starts) of the fragments of each two contigs that have 10 or more; hard: under 0.5."""
    sizes = fragment_z(spark, sf_dir).groupBy("contig_id").agg(F.count(F.lit(1)).alias("n")).orderBy("contig_id").collect()  # a row a source
    models = [lloyd.Model(f"{a.contig_id} {b.contig_id}", 2, labels=(a.contig_id, b.contig_id)) for i, a in enumerate(sizes) for b in sizes[i + 1 :] if a.n + b.n >= 10]
    found = evaluate.agreement(fragment_confusions(spark, sf_dir, models, 10), "label", "cluster", ["model"], "n")
    of = lambda i: F.split("model", " ")[i]
    return found.select(of(0).alias("a"), of(1).alias("b"), r6("ari").alias("ari"), (F.col("ari") < 0.5).alias("hard"))


@query(f"{FRAGMENT_Z}, {O.linkage('w', 'v', '4', 'ward')} SELECT contig_id, window_no, cluster FROM w")
def ward_fragments(spark, sf_dir):
    """Cluster of each fragment by Ward linkage."""
    return cluster.hierarchical(fragment_z(spark, sf_dir), 4).select("contig_id", "window_no", "cluster")


@query(f"{FRAGMENT_Z}, {O.linkage('w', 'v', '6', 'average')} SELECT contig_id, window_no, cluster FROM w")
def average_linkage_fragments(spark, sf_dir):
    return cluster.hierarchical(fragment_z(spark, sf_dir), 6, "average").select("contig_id", "window_no", "cluster")


#: Contigs of 2,000 letters or more, a source and language each; a cluster's contigs one after the other are its host.
MAGS = f"""{O.DOCS}, contigs AS MATERIALIZED (SELECT * FROM (SELECT concat_ws('-', source, lang) AS contig_id, string_agg(seq, '' ORDER BY doc_id) AS seq FROM doc_seq GROUP BY 1) WHERE length(seq) >= {W})"""
MAG_K = "(SELECT CASE WHEN count(*) < 4 THEN 2 ELSE greatest(2, least(10, floor(sqrt(count(*) / 10.0)))) END FROM contigs)"
CLUSTER_HOST = """host AS (SELECT CAST(cluster AS VARCHAR) AS contig_id, string_agg(seq, '' ORDER BY c.contig_id) AS seq FROM contigs c JOIN mags USING (contig_id) GROUP BY cluster),
host_of AS (SELECT contig_id, CAST(cluster AS VARCHAR) AS host FROM mags UNION ALL SELECT contig_id, contig_id FROM host)"""
MAG_SCAN = f"""WITH RECURSIVE {MAGS}, {O.SPINE2}, {O.SPINE3}, whole AS MATERIALIZED (SELECT contig_id, 0 AS window_no, seq FROM contigs), {O.features('f', 'whole')}, {O.vectors('v', 'f')}, {O.linkage('mags', 'v', MAG_K, 'ward')},
{O.profile(CLUSTER_HOST)}, {O.baseline()}, {O.scan()}, {O.SUPPRESSED}, {O.CONTEXT}"""


def clustered_contigs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pieces of the contigs of 2,000 letters or more, and their clusters (contig_id, cluster) by the features of whole contigs."""
    p = D.contig_pieces(spark, sf_dir, "source", "lang")
    long = settled(pieces.contig_lengths(p).where(F.col("contig_length") >= W).select("contig_id"))
    p = settled(p.join(long, "contig_id"))
    z = cluster.standardised(cluster.contig_features(p))
    return p, settled(cluster.hierarchical(z, cluster.automatic_k(long.count())).select("contig_id", "cluster"))


@query(
    f"""{MAG_SCAN},
placed AS (SELECT b.*, cluster, row_number() OVER (PARTITION BY contig_id ORDER BY boosted DESC, start) AS place FROM boosted b JOIN mags USING (contig_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY least(boosted / 3.0::DOUBLE, 1.0::DOUBLE) DESC, contig_id, place) AS rank FROM placed WHERE place <= 10)
SELECT cluster, CAST(rank AS INT) AS rank, contig_id, start, "end", round(least(boosted / 3.0::DOUBLE, 1.0::DOUBLE), 6) AS confidence, round(boosted, 6) AS composite FROM best WHERE rank <= 10"""
)
def metagenome_candidates(spark, sf_dir):
    """The top 10 windows of each cluster of contigs against the cluster's own profile and baseline (a top-k report)."""
    p, labels = clustered_contigs(spark, sf_dir)
    found = scan.scan_clusters(p, labels, W, STEP, 10)
    return found.select("cluster", "rank", "contig_id", "start", "end", r6("confidence").alias("confidence"), r6("composite").alias("composite"))


@query(f"{MAG_SCAN} SELECT contig_id, cluster FROM mags")
def metagenome_clusters(spark, sf_dir):
    return clustered_contigs(spark, sf_dir)[1]


STABLE = "CASE WHEN sum(n) <= 1 THEN 0.0 WHEN count(*) < 2 THEN 1.0 ELSE 1.0 - (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) END"


TILE = 300


def resonance_sql(rows: str, each: str, last_k: int, least: int, names: str) -> str:
    """Resonance of the symbols of rows (q: a string of letters or a list of symbols; each unnests one); names: the columns b1 and b2 of the result."""
    return f"""WITH {O.DOCS}, m AS MATERIALIZED ({rows}),
f AS (SELECT v, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS f FROM (SELECT {each} AS v FROM m) GROUP BY v),
occ AS MATERIALIZED (SELECT k, c, length(q) AS w, q[c + 1] AS b1, q[c + k + 1] AS b2, q[c] AS l, q[c + 2] AS g1, q[c + 3] AS g2, q[c + 4] AS g3 FROM (SELECT q, k, unnest(range(0, length(q) - k)) AS c FROM (SELECT q, unnest(range(1, {last_k + 1})) AS k FROM m))),
p AS (SELECT k, b1, b2, 'p' AS kind, CAST(c AS VARCHAR) AS v FROM occ UNION ALL SELECT k, b1, b2, 'l', l FROM occ WHERE c > 0 UNION ALL SELECT k, b1, b2, 'r', b2 FROM occ WHERE c + k + 1 < w
  UNION ALL SELECT k, b1, b2, 'g', g1 FROM occ WHERE k > 1 UNION ALL SELECT k, b1, b2, 'g', g2 FROM occ WHERE k > 2 UNION ALL SELECT k, b1, b2, 'g', g3 FROM occ WHERE k > 3),
h AS (SELECT k, b1, b2, kind, v, count(*) AS n FROM p GROUP BY ALL), st AS (SELECT k, b1, b2, kind, {STABLE} AS s FROM h GROUP BY k, b1, b2, kind),
t AS (SELECT k, b1, b2, count(*) AS n FROM occ GROUP BY ALL), z AS (SELECT k, CAST(sum(n) AS DOUBLE) AS places FROM t GROUP BY k), w AS (SELECT k, b1, b2, max(s) FILTER (WHERE kind = 'p') AS p, max(s) FILTER (WHERE kind = 'l') AS l, max(s) FILTER (WHERE kind = 'r') AS r, max(s) FILTER (WHERE kind = 'g') AS g FROM st GROUP BY ALL),
v AS (SELECT t.b1, t.b2, t.k, t.n, least(1, ln(1 + 10.0 * t.n) / ln(1 + z.places)) AS a, abs(t.n - coalesce(u.n, 0)) / (t.n + coalesce(u.n, 0)) AS d,
  1 - exp(-greatest(log2(t.n / z.places / (f1.f * f2.f)), 0) / 4) AS mi, w.p, (coalesce(w.l, 0) + coalesce(w.r, 0)) / 2 AS x, CASE WHEN t.k > 1 THEN coalesce(w.g, 0) ELSE 1.0 END AS g
  FROM t JOIN z USING (k) LEFT JOIN t u ON u.k = t.k AND u.b1 = t.b2 AND u.b2 = t.b1 JOIN w ON w.k = t.k AND w.b1 = t.b1 AND w.b2 = t.b2 JOIN f f1 ON f1.v = t.b1 JOIN f f2 ON f2.v = t.b2 WHERE t.n >= {least})
SELECT {names}, CAST(k AS INT) AS k, n, round(a, 6) AS a, round(d, 6) AS d, round(mi, 6) AS mi, round(p, 6) AS p, round(x, 6) AS x, round(g, 6) AS g,
  round(CASE WHEN least(a, d, mi, p, x, g) > 0 THEN exp((ln(a) + ln(d) + ln(mi) + ln(p) + ln(x) + ln(g)) / 6) ELSE 0 END, 6) AS r FROM v"""


@query(resonance_sql(f"SELECT substr(seq, t * {TILE} + 1, {TILE}) AS q FROM (SELECT seq, unnest(range(0, (length(seq) + {TILE - 1}) // {TILE})) AS t FROM doc_seq)", "unnest(string_split(q, ''))", 6, 5, "CAST(instr('ACGT', b1) - 1 AS INT) AS b1, CAST(instr('ACGT', b2) - 1 AS INT) AS b2"))
def resonance_tiles(spark, sf_dir):
    """Pair resonance over all letters of all documents: each is cut into rows of 300 letters (the reference's width), the last one as long as what is left."""
    found = resonance.tiled_resonance(D.document_sequences(spark, sf_dir), TILE)
    return found.select("b1", "b2", "k", "n", *[r6(c).alias(c) for c in ("a", "d", "mi", "p", "x", "g", "r")])


@query(
    resonance_sql(
        f"SELECT list_transform(range(0, length(t) // 3), lambda i: substr(t, i * 3 + 1, 3)) AS q FROM (SELECT substr(seq, t * {TILE} + 1, {TILE}) AS t FROM (SELECT seq, unnest(range(0, (length(seq) + {TILE - 1}) // {TILE})) AS t FROM doc_seq))",
        "unnest(q)", 8, 20, "b1, b2",
    )
)
def codon_resonance(spark, sf_dir):
    """Pair resonance of codons at distances up to 8 over all documents, in rows of 100 codons from each document's first letter; pairs that occur 20 times."""
    found = resonance.tiled_resonance(D.document_sequences(spark, sf_dir), TILE // 3, 8, 20, codons=True)
    return found.select(codon_name("b1").alias("b1"), codon_name("b2").alias("b2"), "k", "n", *[r6(c).alias(c) for c in ("a", "d", "mi", "p", "x", "g", "r")])


@query(
    f"""WITH {O.DOCS}, d AS (SELECT doc_id, seq FROM doc_seq WHERE length(seq) >= 12),
x AS (SELECT doc_id, length(seq) AS n, i - 1 AS pos, substr(seq, i, 1) AS c, CASE WHEN i > 5 THEN substr(seq, i - 5, 5) END AS pre, CASE WHEN i + 5 <= length(seq) THEN substr(seq, i + 1, 5) END AS post FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM d)),
hb AS (SELECT doc_id, pre, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT doc_id, pre, c, count(*) AS n FROM x WHERE pre IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ha AS (SELECT doc_id, post, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT doc_id, post, c, count(*) AS n FROM x WHERE post IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT x.doc_id, count(*) AS n, round(avg(abs(hb.h - ha.h)), 6) AS mean_abs FROM x JOIN hb ON hb.doc_id = x.doc_id AND hb.pre = x.pre JOIN ha ON ha.doc_id = x.doc_id AND ha.post = x.post WHERE x.pos >= 5 AND x.pos < x.n - 5 GROUP BY x.doc_id"""
)
def delta_h(spark, sf_dir):
    """Mean absolute contrast of forward and backward conditional entropies of each document."""
    found = resonance.entropy_contrasts(D.document_sequences(spark, sf_dir).select("doc_id", "seq"))
    size = F.aggregate("delta_h", F.lit(0.0), lambda a, x: a + F.abs(x))
    return found.select("doc_id", F.size("delta_h").cast("bigint").alias("n"), r6(size / F.size("delta_h")).alias("mean_abs"))


@query(
    f"""WITH {O.CONTIGS}, w AS (SELECT contig_id, length(seq) AS len, k AS window_no, seq, k * 1000 AS s, least(k * 1000 + 5000, length(seq) - 7) AS e FROM (SELECT contig_id, seq, unnest(range(0, greatest(0, (length(seq) - 5000) // 1000) + 1)) AS k FROM contigs WHERE length(seq) >= 8)),
f AS (SELECT DISTINCT contig_id, window_no, substr(seq, i + 1, 8) AS g FROM (SELECT *, unnest(range(s, e)) AS i FROM w)),
b AS (SELECT DISTINCT contig_id, window_no, reverse(translate(substr(seq, i + 1, 8), 'ACGT', 'TGCA')) AS g FROM (SELECT *, unnest(range(s, least(e + 500, len - 7))) AS i FROM w))
SELECT w.contig_id, CAST(w.window_no AS BIGINT) AS window_no, CAST(count(b.g) AS INT) AS n FROM w LEFT JOIN f USING (contig_id, window_no) LEFT JOIN b ON b.contig_id = f.contig_id AND b.window_no = f.window_no AND b.g = f.g GROUP BY ALL"""
)
def inverted_repeats(spark, sf_dir):
    found = pieces.windows(D.contig_pieces(spark, sf_dir), 5000, 1000, extra=507)
    return resonance.inverted_repeats(found)


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.entropies('one', 1)},
g AS (SELECT contig_id, window_no, lag, a, b, count(*) AS n FROM (SELECT contig_id, window_no, lag, substr(seq, i, 1) AS a, substr(seq, i + lag, 1) AS b FROM (SELECT *, unnest(range(1, length(seq) - lag + 1)) AS i FROM (SELECT *, unnest(range(1, 13)) AS lag FROM wins))) GROUP BY ALL),
h AS (SELECT contig_id, window_no, lag, greatest(2 * o.h - e, 0) AS mi FROM (SELECT contig_id, window_no, lag, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM g GROUP BY ALL) JOIN one o USING (contig_id, window_no)),
s AS (SELECT contig_id, window_no, regr_slope(ln(mi), lag) AS slope FROM h WHERE mi > 1e-12 GROUP BY ALL)
SELECT contig_id, window_no * {STEP} AS start, round(slope, 6) AS slope, round(CASE WHEN slope < -1e-6 THEN -ln(2) / slope END, 4) AS half_life FROM s"""
)
def mi_half_life(spark, sf_dir):
    rows = contig_windows(spark, sf_dir).withColumn("unit", F.struct("contig_id", "start"))
    found = resonance.information_half_life(rows, "unit")
    return found.select("unit.contig_id", "unit.start", r6("slope").alias("slope"), F.round("half_life", 4).alias("half_life"))


@query(
    f"""WITH RECURSIVE {O.CONTIGS}, {O.windows()}, c AS {O.grams(4)}, t AS (SELECT contig_id, window_no, sum(n) AS n, list(n) AS c FROM c GROUP BY ALL),
b AS (SELECT contig_id, window_no, n, c, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM t
  UNION ALL SELECT contig_id, window_no, n, c, i + 1, CASE WHEN heavy THEN mid ELSE lo END, CASE WHEN heavy THEN hi ELSE mid END FROM (SELECT *, (lo + hi) / 2 AS mid, coalesce(list_sum(list_filter(c, lambda x: x / n > (lo + hi) / 2)), 0) / n > 0.5 AS heavy FROM b WHERE i < 50))
SELECT contig_id, window_no * {STEP} AS start, round(len(list_filter(c, lambda x: x / n > (lo + hi) / 2)) / len(c), 6) AS share FROM b WHERE i = 50"""
)
def sdr(spark, sf_dir):
    """Share of each window's distinct 4-mers that hold half of its mass."""
    return measured_windows(spark, sf_dir, "k4").select("contig_id", "start", r6(S.structural_share(F.filter("k4", lambda n: n > 0))).alias("share"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.entropies('h3', 3)},
h AS (SELECT c.contig_id, coalesce(stddev_pop(h3.h / 6) FILTER (WHERE w.start < length(c.seq) - {W}), 0.00844) AS het FROM contigs c LEFT JOIN wins w USING (contig_id) LEFT JOIN h3 USING (contig_id, window_no) WHERE length(c.seq) > 0 GROUP BY c.contig_id)
SELECT contig_id, round(het, 6) AS heterogeneity, round(1 / (1 + exp(-(het - 0.00844) / 0.00445)), 6) AS weight FROM h"""
)
def heterogeneity(spark, sf_dir):
    h3 = measured_windows(spark, sf_dir, "k3").select("contig_id", "start", (S.entropy(F.col("k3")) / 6).alias("h3"))
    found = fusion.heterogeneity(h3, D.contig_pieces(spark, sf_dir), W)
    return found.select("contig_id", r6("heterogeneity").alias("heterogeneity"), r6(fusion.fusion_weight(F.col("heterogeneity"))).alias("weight"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.letters()}, {O.entropies('h3', 3)},
x AS (SELECT contig_id, start, round(c + g, 9) AS composite, round(h3.h, 9) AS structural, row_number() OVER (PARTITION BY contig_id ORDER BY round(c + g, 9), start) - 1 AS a, row_number() OVER (PARTITION BY contig_id ORDER BY round(h3.h, 9), start) - 1 AS b, count(*) OVER (PARTITION BY contig_id) - 1 AS n FROM wins JOIN letters_wins USING (contig_id, window_no) JOIN h3 USING (contig_id, window_no))
SELECT contig_id, start, round(coalesce(0.6::DOUBLE * a / nullif(n, 0) + 0.4::DOUBLE * b / nullif(n, 0), 0) * 3, 6) AS fused FROM x"""
)
def soft_fusion(spark, sf_dir):
    """Soft fusion of two window channels, GC and 3-mer entropy, at weight 0.4."""
    m = measured_windows(spark, sf_dir, "k3").select("contig_id", "start", F.round(S.gc_content(F.col("seq")), 9).alias("composite"), F.round(S.entropy(F.col("k3")), 9).alias("structural"), F.lit(0.4).alias("weight"))
    return fusion.soft_fusion(m).select("contig_id", "start", r6("fused").alias("fused"))


@query()
def two_channel_scan(spark, sf_dir):
    """The scan's windows re-ranked by soft fusion with the compression channel."""
    p = settled(D.contig_pieces(spark, sf_dir))
    found = scan.suppressed(scored(spark, sf_dir, p))
    return fusion.two_channels(found, p, W, STEP).select("contig_id", "start", "end", r6("fused").alias("fused"))


KEYWORDS, OTHERS = ["tion", "ment", "lich"], ["the", "que", "ein"]


def keyword_sql(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(description), '{w}')" for w in words)


@query(
    f"""WITH h AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS description FROM pages),
t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, description) AS place FROM h), f AS (SELECT host, place, description, {keyword_sql(KEYWORDS)} AS w, {keyword_sql(OTHERS)} AS u FROM t WHERE place <= 10),
g AS (SELECT host, count(*) AS n, avg(w::INT) AS ws, avg(u::INT) AS us, arg_min(description, place) FILTER (WHERE w) AS first_wanted FROM f GROUP BY host)
SELECT host, n, round(ws, 6) AS wanted_share, round(us, 6) AS unwanted_share, first_wanted, CASE WHEN round(ws - us, 9) > 0.1 THEN 'LIKELY' WHEN round(ws - us, 9) < -0.1 THEN 'UNLIKELY' WHEN first_wanted IS NOT NULL THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS verdict FROM g"""
)
def hit_classification(spark, sf_dir):
    """Keyword verdicts on each host's first ten page titles (top ten hits)."""
    pages = D.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("description"))
    found = fusion.classify_hits(pages, ["host"], "page_id", "description", KEYWORDS, OTHERS)
    return found.select("host", "n", r6("wanted_share").alias("wanted_share"), r6("unwanted_share").alias("unwanted_share"), "first_wanted", "verdict")


@query(
    f"""WITH r AS (SELECT unnest(range(1, 3001)) AS round), h0 AS (SELECT round, value AS v, (event_id % {evaluate.PRIME} * 48271 + round * 69621) % {evaluate.PRIME} AS h FROM events, r WHERE value IS NOT NULL),
h1 AS (SELECT round, v, (h * 39373 + (h >> 9)) % {evaluate.PRIME} AS h FROM h0), h2 AS (SELECT round, v, (h * 16807 + (h >> 9)) % {evaluate.PRIME} AS h FROM h1), h3 AS (SELECT round, v, (h * 40692 + (h >> 9)) % {evaluate.PRIME} / {evaluate.PRIME}::DOUBLE AS u FROM h2),
w AS (SELECT round, v, {' + '.join(f'(u >= {c}::DOUBLE)::INT' for c in evaluate.POISSON_ONE)} AS w FROM h3), m AS (SELECT round, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY round)
SELECT (SELECT round(avg(value), 6) FROM events) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""
)
def bootstrap_ci(spark, sf_dir):
    """Bootstrap interval of the mean event value, 3,000 rounds."""
    found = evaluate.bootstrap_means(D.table(spark, sf_dir, "events"), "value", "event_id", 3000)
    return found.select(r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


@query(
    f"""WITH RECURSIVE {O.DOCS}, b AS (SELECT 0 AS level, doc_id, translate(seq, 'ACGT', chr(57345) || chr(57346) || chr(57347) || chr(57348)) AS s, ['A', 'C', 'G', 'T'] AS names FROM doc_seq
  UNION ALL SELECT level + 1, doc_id, merged, more FROM (
    SELECT level, doc_id, replace(s, pair, chr((57344 + list_position(more, name))::INT)) AS merged, more FROM (
      SELECT b.*, pair, names[unicode(pair[1]) - 57344] || names[unicode(pair[2]) - 57344] AS name, CASE WHEN list_contains(names, name) THEN names ELSE list_append(names, name) END AS more FROM b, (
        SELECT pair FROM (SELECT doc_id, i, x || y AS pair FROM (SELECT doc_id, unnest(c[:-2]) AS x, unnest(c[2:]) AS y, unnest(range(1, len(c))) AS i FROM (SELECT doc_id, string_split(s, '') AS c FROM b WHERE length(s) >= 2))) GROUP BY pair HAVING count(*) >= 5 ORDER BY count(*) DESC, min(doc_id::HUGEINT * 10000000000 + i) LIMIT 1)
      WHERE level < 300)))
SELECT CAST(length(names[unicode(x) - 57344]) AS INT) AS length, count(*) AS n FROM (SELECT names, unnest(string_split(nullif(s, ''), '')) AS x FROM b WHERE level = (SELECT max(level) FROM b)) GROUP BY 1"""
)
def byte_pairs(spark, sf_dir):
    """Symbols by length after 300 byte-pair merges of the documents' letters, or as many as a pair is met 5 times."""
    return merge.lengths(merge.byte_pair_merges(D.document_sequences(spark, sf_dir).withColumnRenamed("doc_id", "seq_id"))[0])


@query()
def byte_pair_batches(spark, sf_dir):
    """Symbols by length after 20 rounds of up to 50 merges of pairs of disjoint symbols each, counted once a round."""
    return merge.lengths(merge.byte_pair_merges(D.document_sequences(spark, sf_dir).withColumnRenamed("doc_id", "seq_id"), rounds=20, width=50)[0])


@query(
    f"""WITH s AS (SELECT user_id, list(c ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, (SELECT count(DISTINCT event_type) FROM events x WHERE x.event_type < e.event_type) AS c FROM events e) GROUP BY user_id),
k AS (SELECT user_id, a * 5 + b AS g, count(*) AS n FROM (SELECT user_id, s[i] AS a, s[i + 1] AS b FROM (SELECT *, unnest(range(1, len(s))) AS i FROM s)) GROUP BY ALL),
h AS (SELECT user_id, {O.ENTROPY} AS h FROM k GROUP BY user_id)
SELECT s.user_id, CAST(len(s) AS INT) AS n, round(CASE WHEN len(s) < 2 THEN 0 ELSE coalesce(h.h, 0) / log2(25) END, 6) AS h2 FROM s LEFT JOIN h USING (user_id)"""
)
def event_pair_entropy(spark, sf_dir):
    """The same functions on another alphabet: entropy of each user's consecutive event types."""
    steps = pieces.with_next(D.event_symbols(spark, sf_dir), ["user_id"], ["ts", "event_id"], "sym")
    counts = steps.groupBy("user_id", "sym", "next").agg(F.count(F.lit(1)).alias("n"))
    users = counts.groupBy("user_id").agg(F.sum("n").cast("int").alias("n"), F.collect_list(F.when(F.col("next").isNotNull(), F.col("n"))).alias("pairs"))  # 25 pairs at most
    return users.select("user_id", "n", r6(S.entropy(F.col("pairs")) / F.log2(F.lit(25.0))).alias("h2"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.letters()}, q AS (SELECT contig_id, quantile_cont(c + g, 0.5) AS med, quantile_cont(c + g, 0.25) AS lo, quantile_cont(c + g, 0.75) AS hi, max(c + g) AS top FROM letters_wins GROUP BY contig_id)
SELECT contig_id, round((top - med) / (hi - lo + 1e-9), 4) AS contrast FROM q WHERE hi > lo"""
)
def tail_contrast(spark, sf_dir):
    """Contigs whose windows' GC content varies between its quartiles."""
    gc = contig_windows(spark, sf_dir).select("contig_id", S.gc_content(F.col("seq")).alias("gc"))
    varied = gc.groupBy("contig_id").agg((F.percentile("gc", F.lit(0.75)) > F.percentile("gc", F.lit(0.25))).alias("v")).where("v").select("contig_id")
    return resonance.tail_contrast(gc.join(varied, "contig_id"), ["contig_id"], "gc").select("contig_id", F.round("contrast", 4).alias("contrast"))


@query(f'WITH {O.GENES}, n AS (SELECT contig_id, "end" AS s, lead(start) OVER (PARTITION BY contig_id ORDER BY start, "end") AS e FROM genes) SELECT contig_id, s AS start, e AS "end" FROM n WHERE e - s >= 20')
def gene_gaps(spark, sf_dir):
    """Stretches of 20 letters or more between a gene and the next."""
    return pieces.complement(D.genes(spark, sf_dir), ["contig_id"], 20)


@query(
    f"""{O.SCAN}, {O.SUPPRESSED}, {O.CONTEXT},
placed AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY boosted DESC, start) AS place FROM boosted),
best AS (SELECT *, least(boosted / 3.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM placed WHERE place <= 20), top AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, contig_id, place) AS rank FROM best),
ev AS (SELECT rank, contig_id, start, "end", confidence, unnest({EVIDENCE}) AS e FROM top WHERE rank <= 20),
five AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY (e.z > 1.5) DESC, e.z DESC, e.i) AS o FROM ev)
SELECT CAST(rank AS INT) AS rank, contig_id AS contig, start, "end", "end" - start AS length, '+' AS strand, printf('%.3f', round(confidence, 3)) AS confidence, 'novel' AS novelty, '' AS nearest_known,
  coalesce(string_agg(e.name || ': z=' || printf('%.1f', round(e.z, 1)), '; ' ORDER BY o) FILTER (WHERE e.z > 1.5 AND o <= 5), '') AS evidence FROM five GROUP BY ALL"""
)
def report_tsv(spark, sf_dir):
    """The TSV report of the top 20 candidates (a top-k report)."""
    return reports.tsv_columns(scan.candidates(scan.with_context(scan.suppressed(scored(spark, sf_dir))), 20))


def queries() -> dict:
    from strandflow.plans import studies  # noqa: F401  registers its queries beside these

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
