"""Further queries of the sequence engine: regimes, proximity, ranks of targets, association at full k, distances between classes, fusions. Registered beside the catalog's, with SQL of the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import sequence as S
from strandflow.operators import cluster, cohort, evaluate, fusion, pieces, resonance, scan
from strandflow.operators.measures import informations, measured
from strandflow.plans import oracle as O
from strandflow.plans.catalog import AUC_SQL, RANKS, SQL, STEP, TILE, W, contig_windows, measured_windows, query, r6, scored, scored_genes, zscored
from strandflow.plans.session import settled
from strandflow.sources import documents as D

WINDOW_GC = f"{O.CONTIGS}, {O.windows()}, {O.letters()}, {O.entropies('h3', 3)}"
JOINED = "wins w JOIN letters_wins l USING (contig_id, window_no) JOIN h3 USING (contig_id, window_no)"


@query(f"WITH {O.CONTIGS}, {O.windows()}, {O.entropies('h3', 3)} SELECT contig_id, start, CASE WHEN round(h / 6, 9) < 0.5 THEN 'SPARSE' WHEN round(h / 6, 9) < 0.85 THEN 'BIASED' WHEN round(h / 6, 9) < 0.95 THEN 'CODING' ELSE 'BALANCED' END AS regime FROM wins JOIN h3 USING (contig_id, window_no)")
def regimes(spark, sf_dir):
    return measured_windows(spark, sf_dir, "k3").select("contig_id", "start", S.regime(S.entropy(F.col("k3")) / 6).alias("regime"))


@query(
    f"""WITH {O.DOCS}, d AS (SELECT doc_id AS contig_id, 0 AS window_no, seq FROM doc_seq), e AS (SELECT contig_id, {O.ENTROPY} AS h FROM {O.grams(1, 'd')} GROUP BY contig_id)
SELECT d.contig_id AS doc_id, round(coalesce(e.h, 0) / 2, 6) AS ratio, CASE WHEN round(coalesce(e.h, 0) / 2, 9) < 0.25 THEN 'SPARSE' WHEN round(coalesce(e.h, 0) / 2, 9) < 0.6 THEN 'BIASED' WHEN round(coalesce(e.h, 0) / 2, 9) < 0.85 THEN 'CODING' ELSE 'BALANCED' END AS regime
FROM d LEFT JOIN e USING (contig_id)"""
)
def document_regimes(spark, sf_dir):
    """The older regimes, by the symbol entropy over its maximum."""
    docs = measured(D.document_sequences(spark, sf_dir).select("doc_id", "seq"), wanted=("k1",)).withColumn("ratio", S.entropy(F.col("k1")) / 2)
    return docs.select("doc_id", r6("ratio").alias("ratio"), S.regime_by_symbols(F.col("ratio")).alias("regime"))


@query(f"WITH {WINDOW_GC} SELECT CASE WHEN round(h / 6, 9) < 0.5 THEN 'SPARSE' WHEN round(h / 6, 9) < 0.85 THEN 'BIASED' WHEN round(h / 6, 9) < 0.95 THEN 'CODING' ELSE 'BALANCED' END AS regime, count(*) AS n, round(avg(c + g), 6) AS gc, round(avg(h / 6), 6) AS h3 FROM {JOINED} GROUP BY 1")
def class_means(spark, sf_dir):
    """Means of the windows' signals by regime."""
    m = measured_windows(spark, sf_dir, "k3").select(S.gc_content(F.col("seq")).alias("gc"), (S.entropy(F.col("k3")) / 6).alias("h3")).withColumn("regime", S.regime(F.col("h3")))
    return m.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gc")).alias("gc"), r6(F.avg("h3")).alias("h3"))


@query(
    f"""{O.SCAN}, {O.SUPPRESSED}, {O.CONTEXT}, moves AS (SELECT context_class AS a, lead(context_class) OVER (PARTITION BY contig_id ORDER BY start) AS b FROM context)
SELECT 'class' AS kind, context_class AS name, count(*) AS n FROM context GROUP BY ALL UNION ALL SELECT 'move', a || ' > ' || b, count(*) FROM moves WHERE b IS NOT NULL GROUP BY a, b
UNION ALL SELECT 'boosted', context_class, count(*) FROM context WHERE context_class IN ('ANOMALOUS', 'NORMAL') AND context_boost > 1.0 GROUP BY context_class"""
)
def state_summary(spark, sf_dir):
    return scan.state_summary(settled(scan.with_context(scan.suppressed(scored(spark, sf_dir)))))


@query(f"{O.SCAN} SELECT z.contig_id, z.start, z.\"end\", round(exp(({' + '.join(f'ln(greatest(z.{s}, 0.01))' for s in scan.EARLIER)} + ln(greatest(s.rho, 0.01))) / 7), 6) AS composite FROM z JOIN sig s USING (contig_id, window_no)")
def earlier_scan(spark, sf_dir):
    """The scan as it was before: seven signals, geometric mean alone, no suppression."""
    found, z = zscored(spark, sf_dir, kept=True)
    return scan.earlier_scan(z, found).select("contig_id", "start", "end", r6("composite").alias("composite"))


@query(f"WITH {O.CONTIGS}, {O.SPINE2}, {O.SPINE3}, {O.profile()}, {O.windows('w3', window=3000)}, {O.rscu('wr', 'w3')} SELECT r.contig_id, r.window_no * {STEP} AS start, round(sqrt(sum((r.rscu - h.rscu) ** 2)), 6) AS distance FROM wr r JOIN host_rscu h USING (g) GROUP BY r.contig_id, r.window_no")
def codon_bias_profile(spark, sf_dir):
    """Distance of the codon usage of windows of 3,000 letters from the host's."""
    p = settled(D.contig_pieces(spark, sf_dir))
    m = measured(pieces.windows(p, 3000, STEP), wanted=("codon",), letters=False).crossJoin(F.broadcast(scan.host_profile(D.host_pieces(p))))
    return m.select("contig_id", "start", r6(S.euclidean(S.rscu_from_counts(F.col("codon")), F.col("host_rscu"))).alias("distance"))


@query(f"WITH {O.CONTIGS}, {O.windows()}, {O.letters()}, g AS (SELECT contig_id, c + g AS gc FROM letters_wins), s AS (SELECT avg(gc) AS m, stddev_pop(gc) AS s FROM g) SELECT contig_id, count(*) AS n, count(*) FILTER (WHERE round(abs(gc - m) - 2 * s, 9) > 0) AS outside FROM g, s GROUP BY contig_id")
def outlier_windows(spark, sf_dir):
    """Windows whose GC content is more than two deviations from the mean of all."""
    gc = contig_windows(spark, sf_dir).select("contig_id", S.gc_content(F.col("seq")).alias("gc"))
    stats = gc.agg(F.avg("gc").alias("m"), F.stddev_pop("gc").alias("s"))
    return gc.crossJoin(F.broadcast(stats)).groupBy("contig_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round(F.abs(F.col("gc") - F.col("m")) - F.col("s") * 2, 9) > 0).alias("outside"))


#: Words looked up in page titles, in the order in which they count.
TAXA = ("tion", "the", "ein", "que", "lich")


@query(f"WITH t AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS d FROM pages) SELECT page_id, CASE {' '.join(f'''WHEN contains(d, '{x}') THEN '{x}' ''' for x in TAXA)} END AS taxon FROM t")
def taxon_lookup(spark, sf_dir):
    """The first of a list of names that a description contains."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    chain = reduce(lambda c, x: c.when(F.contains(title, F.lit(x)), x), TAXA[1:], F.when(F.contains(title, F.lit(TAXA[0])), TAXA[0]))
    return D.table(spark, sf_dir, "pages").select("page_id", chain.alias("taxon"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def seeded_sample(spark, sf_dir):
    """200 documents without replacement, the same at every run (a sampling operator)."""
    return D.table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(200)


@query(
    f"""WITH {O.GENES}, contigs AS (SELECT source AS contig_id, string_agg(seq, '' ORDER BY doc_id) AS seq FROM doc_seq GROUP BY source), {O.windows()}, {O.letters()}, {O.entropies('h3', 3)},
d AS (SELECT contig_id, start, abs(lead(c + g) OVER w - c - g) AS a, abs(lead(h) OVER w - h) / 6 AS b FROM {JOINED} WINDOW w AS (PARTITION BY contig_id ORDER BY start)),
g AS (SELECT contig_id, start, round(a / (max(a) OVER (PARTITION BY contig_id) + 1e-10) + b / (max(b) OVER (PARTITION BY contig_id) + 1e-10), 9) AS grad FROM d WHERE a IS NOT NULL),
t AS (SELECT contig_id, quantile_cont(grad, 0.9) AS cut FROM g GROUP BY contig_id), hot AS (SELECT contig_id, start AS at FROM g JOIN t USING (contig_id) WHERE round(grad - cut, 9) > 0)
SELECT contig_id, gene_id, EXISTS (SELECT 1 FROM hot h WHERE h.contig_id = genes.contig_id AND (abs(h.at - genes.start) < 3000 OR abs(h.at - genes."end") < 3000)) AS detected FROM genes WHERE is_pos"""
)
def region_recall(spark, sf_dir):
    """Positive genes with a steep change of composition (over the contig's 90th percentile) less than 3,000 letters from either end."""
    m = measured_windows(spark, sf_dir, "k3").select("contig_id", "start", S.gc_content(F.col("seq")).alias("gc"), (S.entropy(F.col("k3")) / 6).alias("h3"))
    w, everything = Window.partitionBy("contig_id").orderBy("start"), Window.partitionBy("contig_id")
    d = m.select("contig_id", "start", *[F.abs(F.lead(c).over(w) - F.col(c)).alias(c) for c in ("gc", "h3")]).where("gc is not null")
    g = d.withColumn("grad", F.round(sum(F.col(c) / (F.max(c).over(everything) + 1e-10) for c in ("gc", "h3")), 9))
    cut = g.groupBy("contig_id").agg(F.percentile("grad", F.lit(0.9)).alias("cut"))
    hot = g.join(cut, "contig_id").where(F.round(F.col("grad") - F.col("cut"), 9) > 0).select("contig_id", F.col("start").alias("at"))
    found = pieces.near(D.genes(spark, sf_dir).where("is_pos"), hot, ["contig_id"], "gene_id", 3000)
    return found.select("contig_id", "gene_id", F.col("near").alias("detected"))


@query(
    f"""WITH {O.GENE_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY dev DESC, start) AS place FROM dev), n AS (SELECT unnest([5, 10, 20]) AS n),
hit AS (SELECT DISTINCT n.n, g.contig_id, gene_id, is_pos FROM genes g JOIN r ON r.contig_id = g.contig_id AND r.start <= g."end" + 500 AND r."end" >= g.start - 500 JOIN n ON r.place <= n.n), t AS (SELECT is_pos, count(*) AS total FROM genes GROUP BY is_pos)
SELECT CAST(n.n AS INT) AS n, t.is_pos, count(h.gene_id) AS found, any_value(total) AS total, round(count(h.gene_id) / any_value(total), 6) AS recall FROM n CROSS JOIN t LEFT JOIN hit h ON h.n = n.n AND h.is_pos = t.is_pos GROUP BY n.n, t.is_pos"""
)
def top_window_recall(spark, sf_dir):
    """Genes, by class, within 500 letters of a contig's first 5, 10 and 20 windows by GC deviation (bounds count)."""
    gc = contig_windows(spark, sf_dir).select("contig_id", "start", "end", S.gc_content(F.col("seq")).alias("gc"))
    dev = gc.join(gc.groupBy("contig_id").agg(F.avg("gc").alias("m")), "contig_id").withColumn("dev", F.round(F.abs(F.col("gc") - F.col("m")), 9))
    place = F.row_number().over(Window.partitionBy("contig_id").orderBy(F.desc("dev"), "start"))
    top = dev.withColumn("place", place).where("place <= 20").select("contig_id", "start", "end", "place")
    best = pieces.overlaps(D.genes(spark, sf_dir), top, W, ["contig_id"], "left", pad=501).groupBy("contig_id", "gene_id", "is_pos").agg(F.min("place").alias("best"))
    counts = best.groupBy("is_pos").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("best") <= n).alias(f"f{n}") for n in (5, 10, 20)])
    each = counts.select("is_pos", "total", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"f{n}").alias("found")) for n in (5, 10, 20)])))
    return each.select("n", "is_pos", "found", "total", r6(F.col("found") / F.col("total")).alias("recall"))


@query(
    f"""WITH {O.GENES}, contigs AS (SELECT source AS contig_id, string_agg(seq, '' ORDER BY doc_id) AS seq FROM doc_seq GROUP BY source), {O.windows()}, {O.letters()}, {O.entropies('h3', 3)},
v AS (SELECT contig_id, start, "end", unnest([{{'s': 'gc', 'v': c + g}}, {{'s': 'h3', 'v': h / 6}}, {{'s': 'c2', 'v': abs(a - t) + abs(c - g)}}]) AS x FROM {JOINED}),
d AS (SELECT contig_id, start, "end", x.s AS signal, round(abs(x.v - avg(x.v) OVER (PARTITION BY contig_id, x.s)), 9) AS d FROM v),
o AS (SELECT * FROM d UNION ALL SELECT contig_id, start, "end", 'overall', round(sum(d), 9) FROM d GROUP BY contig_id, start, "end"),
r AS (SELECT *, row_number() OVER (PARTITION BY contig_id, signal ORDER BY d DESC, start) AS place FROM o), t AS (SELECT contig_id, min(start) AS s, arg_min("end", start) AS e FROM genes WHERE is_pos GROUP BY contig_id)
SELECT contig_id, signal, CAST(min(place) FILTER (WHERE r.start <= e + 1000 AND r."end" >= s - 1000) AS INT) AS rank FROM r JOIN t USING (contig_id) GROUP BY contig_id, signal"""
)
def target_ranks(spark, sf_dir):
    """First rank, by each signal and by all, of a window within 1,000 letters of the contig's first positive gene."""
    m = measured_windows(spark, sf_dir, "k3")
    values = {"gc": S.gc_content(F.col("seq")), "h3": S.entropy(F.col("k3")) / 6, "c2": S.chargaff_deviation(F.col("seq"))}
    each = m.select("contig_id", "start", "end", F.inline(F.array(*[F.struct(F.lit(n).alias("signal"), v.alias("v")) for n, v in values.items()])))
    d = each.withColumn("d", F.round(F.abs(F.col("v") - F.avg("v").over(Window.partitionBy("contig_id", "signal"))), 9)).drop("v")
    whole = d.groupBy("contig_id", "start", "end").agg(F.round(F.sum("d"), 9).alias("d")).select("contig_id", "start", "end", F.lit("overall").alias("signal"), "d")
    placed = d.select(*whole.columns).union(whole).withColumn("place", F.row_number().over(Window.partitionBy("contig_id", "signal").orderBy(F.desc("d"), "start")))
    target = D.genes(spark, sf_dir).where("is_pos").groupBy("contig_id").agg(F.min(F.struct("start", "end")).alias("t"))
    hit = (F.col("start") <= F.col("t.end") + 1000) & (F.col("end") >= F.col("t.start") - 1000)
    return placed.join(target, "contig_id").groupBy("contig_id", "signal").agg(F.min(F.when(hit, F.col("place"))).alias("rank"))


@query(
    f"""WITH {O.GENE_SCORES}, r AS (SELECT contig_id, is_pos, rank() OVER (PARTITION BY contig_id ORDER BY score) + (count(*) OVER (PARTITION BY contig_id, score) - 1) / 2.0 AS rk, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rall FROM gene_scores),
c AS (SELECT contig_id, count(*) FILTER (WHERE is_pos) AS p, count(*) FILTER (WHERE NOT is_pos) AS n, sum(rk) FILTER (WHERE is_pos) AS s FROM r GROUP BY contig_id), a AS (SELECT (s - p * (p + 1) / 2.0) / (p * n) AS auc FROM c WHERE p >= 1 AND n >= 3),
o AS (SELECT count(*) FILTER (WHERE is_pos) AS p, count(*) FILTER (WHERE NOT is_pos) AS n, sum(rall) FILTER (WHERE is_pos) AS s FROM r)
SELECT count(*) AS contigs, round(avg(auc), 6) AS mean, round(median(auc), 6) AS median, (SELECT round((s - p * (p + 1) / 2.0) / nullif(p * n, 0), 6) FROM o) AS pooled FROM a"""
)
def auc_summary(spark, sf_dir):
    """Mean and median of the contigs' AUC, and that of all genes together."""
    genes = settled(scored_genes(spark, sf_dir))
    each = evaluate.auc(genes, ["contig_id"], "score", "is_pos").where("n_pos >= 1 and n_neg >= 3")
    whole = each.agg(F.count(F.lit(1)).alias("contigs"), r6(F.avg("auc")).alias("mean"), r6(F.percentile("auc", F.lit(0.5))).alias("median"))
    return whole.crossJoin(F.broadcast(evaluate.auc(genes, [], "score", "is_pos").select(r6("auc").alias("pooled"))))


@query(
    f"""WITH {O.GENE_SCORES}, x AS (SELECT count(*) AS n, corr("end" - start, score) AS r FROM gene_scores) SELECT n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM x"""
)
def pearson(spark, sf_dir):
    """Correlation of genes' lengths and scores, and its t statistic."""
    rows = scored_genes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.corr((F.col("end") - F.col("start")).cast("double"), F.col("score")).alias("r"))
    return rows.select("n", r6("r").alias("r"), F.round(F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))), 4).alias("t"))


SIX = ("gc", "h3", "h4", "mi1", "c2", "codon_mi")


@query(
    f"""WITH {WINDOW_GC}, {O.entropies('h4', 4)}, {O.entropies('k1', 1)}, {O.entropies('k2', 2)}, {O.entropies('co', 3, 3)}, {O.entropies('cp', 6, 3)},
x AS (SELECT c + g AS gc, h3.h / 6 AS h3, h4.h / 8 AS h4, greatest(2 * k1.h - k2.h, 0) AS mi1, abs(a - t) + abs(c - g) AS c2, greatest(2 * co.h - cp.h, 0) AS codon_mi FROM {JOINED} JOIN h4 USING (contig_id, window_no) JOIN k1 USING (contig_id, window_no) JOIN k2 USING (contig_id, window_no) JOIN co USING (contig_id, window_no) JOIN cp USING (contig_id, window_no))
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM x" for i, a in enumerate(SIX) for b in SIX[i + 1:])}"""
)
def correlation_matrix(spark, sf_dir):
    """Correlations of six signals over all windows."""
    m = measured_windows(spark, sf_dir, "k1", "k2", "k3", "k4", "codon", "pair_n")
    values = [S.gc_content(F.col("seq")), S.entropy(F.col("k3")) / 6, S.entropy(F.col("k4")) / 8, S.information(F.col("k1"), F.col("k2")), S.chargaff_deviation(F.col("seq")), S.information(F.col("codon"), F.col("pair_n"))]
    x = m.select(*[v.alias(n) for n, v in zip(SIX, values, strict=True)])
    pairs = [(a, b) for i, a in enumerate(SIX) for b in SIX[i + 1 :]]
    wide = x.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(f"{a}_{b}").alias("r")) for a, b in pairs])))


SEPARATIONS = f"""{O.GENES}, {O.SPINE2}, cs AS (SELECT source AS contig_id, 0 AS window_no, string_agg(seq, '' ORDER BY doc_id) AS seq FROM doc_seq GROUP BY source), gs AS (SELECT g.contig_id, gene_id AS window_no, is_pos, seq FROM genes g JOIN doc_seq d ON d.doc_id = g.gene_id),
{O.letters('cs')}, {O.letters('gs')}, {O.rho('crho', 'cs')}, {O.rho('grho', 'gs')},
rd AS (SELECT g.contig_id, g.window_no, sqrt(sum((g.rho - c.rho) ** 2)) AS rho FROM grho g JOIN crho c ON c.contig_id = g.contig_id AND c.g = g.g GROUP BY g.contig_id, g.window_no),
gd AS (SELECT gs.contig_id, gs.window_no, is_pos, abs(l.c + l.g - c.c - c.g) AS gc, rd.rho FROM gs JOIN letters_gs l ON l.contig_id = gs.contig_id AND l.window_no = gs.window_no JOIN letters_cs c ON c.contig_id = gs.contig_id JOIN rd ON rd.contig_id = gs.contig_id AND rd.window_no = gs.window_no),
sep AS (SELECT contig_id, avg(gc) FILTER (WHERE is_pos) - avg(gc) FILTER (WHERE NOT is_pos) AS gc, avg(rho) FILTER (WHERE is_pos) - avg(rho) FILTER (WHERE NOT is_pos) AS rho FROM gd GROUP BY contig_id HAVING count(*) FILTER (WHERE is_pos) >= 1 AND count(*) FILTER (WHERE NOT is_pos) >= 3)"""


def separations_of(spark, sf_dir) -> DataFrame:
    """contig_id, gc, rho: mean distance from the contig of positive genes less that of the others, for contigs with a positive and three others."""
    own = cluster.contig_features(D.contig_pieces(spark, sf_dir)).select("contig_id", F.get("features", F.lit(0)).alias("own_gc"), F.slice("features", 7, 16).alias("own_rho"))
    seqs = D.document_sequences(spark, sf_dir).select(F.col("doc_id").alias("gene_id"), "seq")
    genes = D.genes(spark, sf_dir).select("contig_id", "gene_id", "is_pos").join(seqs, "gene_id")
    m = measured(genes, wanted=("k1", "k2")).join(own, "contig_id")
    far = m.select("contig_id", "is_pos", F.abs(S.gc_content(F.col("seq")) - F.col("own_gc")).alias("gc"), S.euclidean(S.rho_from_counts(F.col("k1"), F.col("k2")), F.col("own_rho")).alias("rho"))
    apart = lambda c: F.avg(F.when(F.col("is_pos"), F.col(c))) - F.avg(F.when(~F.col("is_pos"), F.col(c)))
    found = far.groupBy("contig_id").agg(F.count_if("is_pos").alias("p"), F.count(F.lit(1)).alias("n"), apart("gc").alias("gc"), apart("rho").alias("rho"))
    return found.where("p >= 1 and n - p >= 3").select("contig_id", "gc", "rho")


@query(f"WITH {SEPARATIONS} SELECT contig_id, round(gc, 6) AS gc, round(rho, 6) AS rho FROM sep")
def gene_separations(spark, sf_dir):
    return separations_of(spark, sf_dir).select("contig_id", r6("gc").alias("gc"), r6("rho").alias("rho"))


@query(
    f"""WITH {O.GENE_SCORES}, {SEPARATIONS.split(O.GENES + ', ')[1]}, r AS (SELECT contig_id, is_pos, rank() OVER (PARTITION BY contig_id ORDER BY score) + (count(*) OVER (PARTITION BY contig_id, score) - 1) / 2.0 AS rk FROM gene_scores),
c AS (SELECT contig_id, count(*) FILTER (WHERE is_pos) AS p, count(*) FILTER (WHERE NOT is_pos) AS n, sum(rk) FILTER (WHERE is_pos) AS s FROM r GROUP BY contig_id), a AS (SELECT contig_id, (s - p * (p + 1) / 2.0) / (p * n) AS auc FROM c WHERE p >= 1 AND n >= 3),
x AS (SELECT round(rho, 9) AS rho, auc FROM sep JOIN a USING (contig_id)) SELECT round(rho - (SELECT median(rho) FROM x), 9) >= 0 AS high, count(*) AS n, round(avg(auc), 6) AS mean_auc FROM x GROUP BY 1"""
)
def regime_gate(spark, sf_dir):
    """Mean AUC of the contigs whose rho separation is at or above the median, and of the others."""
    aucs = evaluate.auc(scored_genes(spark, sf_dir), ["contig_id"], "score", "is_pos").select("contig_id", "auc")
    x = settled(separations_of(spark, sf_dir).join(aucs, "contig_id").select(F.round("rho", 9).alias("rho"), "auc"))
    cut = x.agg(F.percentile("rho", F.lit(0.5)).alias("cut"))
    sides = x.crossJoin(F.broadcast(cut)).withColumn("high", F.round(F.col("rho") - F.col("cut"), 9) >= 0)
    return sides.groupBy("high").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("auc")).alias("mean_auc"))


K11, K31 = O.isolates(11, 0.12), O.isolates(31, 0.01)
GENE_KMERS = f"""items AS (SELECT item_id AS gene_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark),
ik AS (SELECT DISTINCT gene_id, {O.packed('g', 11)} AS kmer FROM (SELECT gene_id, substr(seq, i, 11) AS g FROM (SELECT *, unnest(range(1, length(seq) - 9)) AS i FROM (SELECT * FROM items UNION ALL SELECT gene_id, reverse(translate(seq, 'ACGT', 'TGCA')) FROM items))))"""


def benchmark_genes(spark, sf_dir) -> DataFrame:
    return D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gene_id"), S.only_acgt(F.coalesce("text", F.lit(""))).alias("seq"))


@query(
    f"""WITH {K11}, {GENE_KMERS}, held AS (SELECT DISTINCT gene_id, genome_id, label FROM gkmers JOIN ik USING (kmer)), h AS (SELECT gene_id, count(*) FILTER (WHERE label = 'R') AS n_r, count(*) FILTER (WHERE label = 'S') AS n_s FROM held GROUP BY gene_id),
c AS (SELECT gene_id, count(*) AS n_strong, avg(cnt_r / sizes.n_r) AS cr, avg(cnt_s / sizes.n_s) AS cs FROM ik JOIN assoc USING (kmer), sizes WHERE kmer IN (SELECT kmer FROM strong) GROUP BY gene_id)
SELECT gene_id, coalesce(n_r, 0) AS n_r, coalesce(n_s, 0) AS n_s, coalesce(n_strong, 0) AS n_strong, round(cr, 6) AS carrier_r, round(cs, 6) AS carrier_s,
  CASE WHEN n_strong > 0 AND round(cr - 1.5 * cs, 9) > 0 THEN 'ALLELE' WHEN n_strong > 0 THEN 'SHARED' WHEN n_r > 0 OR n_s > 0 THEN 'PRESENT' ELSE 'ABSENT' END AS verdict FROM items LEFT JOIN h USING (gene_id) LEFT JOIN c USING (gene_id)"""
)
def gene_presence(spark, sf_dir):
    """Benchmark passages as genes: genomes with any of their 11-mers, and carriers of the strong ones; verdict: what tells the classes apart."""
    genomes = D.isolates(spark, sf_dir)
    scores = settled(cohort.association(genomes, 11))
    found = cohort.gene_presence(benchmark_genes(spark, sf_dir), genomes, scores, cohort.strong(scores, 0.12), 11)
    strong = F.col("n_strong") > 0
    verdict = F.when(strong & (F.round(F.col("carrier_r") - F.col("carrier_s") * 1.5, 9) > 0), "ALLELE").when(strong, "SHARED").when((F.col("n_r") > 0) | (F.col("n_s") > 0), "PRESENT").otherwise("ABSENT")
    return found.select("gene_id", "n_r", "n_s", "n_strong", r6("carrier_r").alias("carrier_r"), r6("carrier_s").alias("carrier_s"), verdict.alias("verdict"))


@query(
    f"""WITH {K11}, {GENE_KMERS}, g AS (SELECT kmer, count(*) AS genes FROM ik GROUP BY kmer), x AS (SELECT count(*) AS n, coalesce(CAST(sum(genes) AS BIGINT), 0) AS summed, count(genes) AS distinct_kmers FROM strong LEFT JOIN g USING (kmer))
SELECT n, summed, distinct_kmers, round(summed / nullif(n, 0), 6) AS summed_share, round(distinct_kmers / nullif(n, 0), 6) AS distinct_share FROM x"""
)
def explained_fractions(spark, sf_dir):
    """Strong 11-mers that benchmark passages hold, once with and once without double counting."""
    strong = cohort.strong(cohort.association(D.isolates(spark, sf_dir), 11), 0.12)
    found = cohort.explained(strong, benchmark_genes(spark, sf_dir), 11)
    return found.select("n", "summed", "distinct_kmers", r6("summed_share").alias("summed_share"), r6("distinct_share").alias("distinct_share"))


def sketched(k: int, size: int, keys: str) -> str:
    return f"""lk AS (SELECT DISTINCT {keys} AS g, kmer FROM gkmers), sk AS (SELECT g, kmer FROM (SELECT g, kmer, row_number() OVER (PARTITION BY g ORDER BY kmer) AS r FROM lk) WHERE r <= {size}),
gg AS (SELECT DISTINCT {keys} AS g FROM isolates), u AS (SELECT a.g AS a, b.g AS b, x.kmer, count(*) AS c FROM gg a JOIN gg b ON a.g < b.g JOIN sk x ON x.g IN (a.g, b.g) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY kmer) AS r FROM u), jac AS (SELECT a, b, avg((c = 2)::INT) AS jaccard FROM o WHERE r <= {size} GROUP BY a, b HAVING sum((c = 2)::INT) > 0)"""


@query(f"WITH {K31}, {sketched(31, 3000, chr(39).join(['lineage || ', '-', ' || label']))} SELECT a, b, round(jaccard, 6) AS jaccard FROM jac")
def minhash_jaccard31(spark, sf_dir):
    """Similarity of bottom-3000 sketches of 31-mers of the lineage and phenotype groups."""
    rows = D.isolates(spark, sf_dir).select(F.concat_ws("-", "lineage", "label").alias("genome_id"), "seq")
    return cohort.sketch_similarity(cohort.sketches(rows, 31, 3000), 3000, zero=False).withColumn("jaccard", r6("jaccard"))


@query(
    f"""WITH {K11}, {sketched(11, 3000, chr(39).join(['lineage || ', '-', ' || label']))}, p AS (SELECT a.g AS a, b.g AS b, CASE WHEN right(a.g, 1) = right(b.g, 1) THEN 'within' ELSE 'between' END AS kind FROM gg a JOIN gg b ON a.g < b.g)
SELECT k.kind, count(p.a) AS n, round(CASE WHEN count(p.a) > 0 THEN 1 - coalesce(sum(jaccard), 0) / count(p.a) END, 6) AS mean FROM (SELECT unnest(['within', 'between']) AS kind) k LEFT JOIN p USING (kind) LEFT JOIN jac ON jac.a = p.a AND jac.b = p.b GROUP BY k.kind"""
)
def class_distances(spark, sf_dir):
    """Mean sketch distance within and between phenotypes, over lineage and phenotype groups."""
    genomes = D.isolates(spark, sf_dir).withColumn("unit", F.concat_ws("-", "lineage", "label"))
    similar = cohort.sketch_similarity(cohort.sketches(genomes.select(F.col("unit").alias("genome_id"), "seq"), 11, 3000), 3000)
    found = cohort.class_distances(similar, genomes.select("unit", F.col("label").alias("class")).distinct())
    return found.withColumn("mean", r6("mean"))


def strong31(spark, sf_dir) -> DataFrame:
    return cohort.strong(cohort.association(D.isolates(spark, sf_dir), 31), 0.01)


@query(f"WITH {K31} SELECT kmer, cnt_r, cnt_s, round(score, 6) AS score FROM assoc")
def kmer_gwas31(spark, sf_dir):
    """Association at the full k of 31."""
    return cohort.association(D.isolates(spark, sf_dir), 31).withColumn("score", r6("score"))


@query(
    f"""WITH {K31}, m AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY genome_id ORDER BY pos) > 500)::INT, 1) AS fresh FROM doc_hits), g AS (SELECT *, sum(fresh) OVER (PARTITION BY genome_id ORDER BY pos) AS island FROM m)
SELECT genome_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 31 AS INT) AS "end", count(*) AS n FROM g GROUP BY genome_id, island"""
)
def localize_loci31(spark, sf_dir):
    return cohort.loci(cohort.hits(D.isolates(spark, sf_dir), strong31(spark, sf_dir), 31), 31, 500)


@query(
    f"""WITH {K31}, own AS (SELECT DISTINCT genome_id, kmer FROM gkmers)
SELECT genome_id AS gene_id, count(*) AS n_kmers, count(*) FILTER (WHERE kmer IN (SELECT kmer FROM strong)) AS n_wanted, round(avg((kmer IN (SELECT kmer FROM strong))::INT), 6) AS share FROM own GROUP BY genome_id"""
)
def gene_overlap31(spark, sf_dir):
    genes = D.isolates(spark, sf_dir).select(F.col("genome_id").alias("gene_id"), "seq")
    return cohort.gene_carriage(genes, strong31(spark, sf_dir), 31).withColumn("share", r6("share"))


@query(
    f"""WITH {K31}, c AS (SELECT i.genome_id, i.label, i.lineage, count(g.kmer) AS n FROM isolates i LEFT JOIN (SELECT DISTINCT genome_id, kmer FROM gkmers WHERE kmer IN (SELECT kmer FROM strong)) g USING (genome_id) GROUP BY ALL),
m AS (SELECT lineage, count(*) FILTER (WHERE label = 'R') AS n_r, count(*) FILTER (WHERE label = 'S') AS n_s, avg(n) FILTER (WHERE label = 'R') AS mean_r, avg(n) FILTER (WHERE label = 'S') AS mean_s FROM c GROUP BY lineage)
SELECT lineage, n_r, n_s, round(mean_r, 6) AS mean_r, round(mean_s, 6) AS mean_s, mean_r > 1.5 * mean_s + 1 AS separates FROM m"""
)
def within_lineage31(spark, sf_dir):
    found = cohort.within_lineages(D.isolates(spark, sf_dir), strong31(spark, sf_dir), 31)
    return found.withColumns({"mean_r": r6("mean_r"), "mean_s": r6("mean_s")})


@query(f"WITH {O.ISOLATES} SELECT kmer, round(score, 6) AS score FROM assoc ORDER BY round(score, 9) DESC, kmer LIMIT 15")
def top_kmers(spark, sf_dir):
    """The 15 best scores (a top-k report)."""
    return cohort.association(D.isolates(spark, sf_dir), O.K).orderBy(F.round("score", 9).desc(), "kmer").limit(15).select("kmer", r6("score").alias("score"))


@query(f'WITH l AS ({SQL["localize_loci"]}) SELECT genome_id, start, "end", n FROM l ORDER BY n DESC, genome_id DESC, start DESC, "end" DESC LIMIT 8')
def loci_by_count(spark, sf_dir):
    """The eight loci of most hits (a top-k report)."""
    found = cohort.loci(cohort.hits(D.isolates(spark, sf_dir), cohort.strong(cohort.association(D.isolates(spark, sf_dir), O.K), 0.35), O.K), O.K, 100)
    return found.orderBy(F.desc("n"), F.desc("genome_id"), F.desc("start"), F.desc("end")).limit(8).select("genome_id", "start", "end", "n")


@query(f"WITH {O.ISOLATES}, five AS (SELECT DISTINCT genome_id FROM isolates ORDER BY genome_id LIMIT 5) SELECT genome_id, count(pos) AS n FROM five LEFT JOIN doc_hits USING (genome_id) GROUP BY genome_id ORDER BY n DESC, genome_id LIMIT 1")
def densest_genome(spark, sf_dir):
    """Of the first five genomes, the one of most hits."""
    genomes = D.isolates(spark, sf_dir)
    return cohort.densest(cohort.hits(genomes, cohort.strong(cohort.association(genomes, O.K), 0.35), O.K), genomes)


@query(
    f"""WITH l AS ({SQL["localize_loci"]}), g AS (SELECT * FROM (WITH {O.GENES} SELECT contig_id, gene_id, start, "end" FROM genes)), p AS (SELECT * FROM (WITH {O.DOCS} SELECT doc_id, source AS contig_id, sum(length(seq)) OVER (PARTITION BY source ORDER BY doc_id) - length(seq) AS place FROM doc_seq)),
x AS (SELECT p.contig_id, place + l.start AS start, place + l."end" AS "end" FROM l JOIN p ON p.doc_id = l.genome_id) SELECT g.contig_id, g.gene_id, count(*) AS n FROM g JOIN x ON x.contig_id = g.contig_id AND x."end" > g.start AND x.start < g."end" GROUP BY g.contig_id, g.gene_id"""
)
def loci_in_genes(spark, sf_dir):
    """Loci, in the coordinates of their contigs, that overlap each gene."""
    genomes = D.isolates(spark, sf_dir)
    found = cohort.loci(cohort.hits(genomes, cohort.strong(cohort.association(genomes, O.K), 0.35), O.K), O.K, 100)
    at = D.contig_pieces(spark, sf_dir).select("contig_id", F.col("ordinal").alias("genome_id"), F.col("start").alias("at"))
    placed = found.join(at, "genome_id").select("contig_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    return pieces.overlaps(D.genes(spark, sf_dir), placed, W, ["contig_id"]).groupBy("contig_id", "gene_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH res AS ({SQL['resonance_tiles']}) SELECT b1, b2, k, r, row_number() OVER (ORDER BY r DESC, k, b1, b2) AS place FROM res")
def resonance_ranked(spark, sf_dir):
    found = resonance.tiled_resonance(D.document_sequences(spark, sf_dir), TILE).select("b1", "b2", "k", r6("r").alias("r"))
    return resonance.ranked_pairs(found).withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH res AS ({SQL['resonance_tiles']}), b AS (SELECT b1, b2, k, r, row_number() OVER (PARTITION BY b1, b2 ORDER BY r DESC, k) AS o FROM res) SELECT b1, b2, k, r, count(*) OVER (PARTITION BY k) AS pairs_at_k FROM b WHERE o = 1")
def best_distance(spark, sf_dir):
    """The distance at which each pair resonates most, and how many pairs do at that distance."""
    found = resonance.tiled_resonance(D.document_sequences(spark, sf_dir), TILE).select("b1", "b2", "k", r6("r").alias("r"))
    return resonance.best_distances(found).withColumn("pairs_at_k", F.count(F.lit(1)).over(Window.partitionBy("k")))


LAGS = """g AS (SELECT contig_id, window_no, lag, a, b, count(*) AS n FROM (SELECT contig_id, window_no, lag, substr(seq, i, 1) AS a, substr(seq, i + lag, 1) AS b FROM (SELECT *, unnest(range(1, length(seq) - lag + 1)) AS i FROM (SELECT *, unnest(range(1, 13)) AS lag FROM wins))) GROUP BY ALL),
h AS (SELECT contig_id, window_no, lag, greatest(2 * o.h - e, 0) AS mi FROM (SELECT contig_id, window_no, lag, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM g GROUP BY ALL) JOIN one o USING (contig_id, window_no))"""


@query(
    f"""WITH {O.CONTIGS}, {O.windows('wins', step=W)}, {O.entropies('one', 1)}, {LAGS}
SELECT contig_id, window_no * {W} AS start, round(avg(mi) FILTER (WHERE lag % 3 = 0) / nullif(avg(mi) FILTER (WHERE lag % 3 <> 0), 0), 4) AS score, round(max(mi) FILTER (WHERE lag = 3) / nullif(avg(mi) FILTER (WHERE lag IN (1, 2, 4, 5)), 0), 4) AS lag3 FROM h GROUP BY contig_id, window_no"""
)
def information_period(spark, sf_dir):
    """Information at multiples of 3 over that at other lags, and at lag 3 over its neighbours."""
    m = informations(pieces.windows(D.contig_pieces(spark, sf_dir), W, W), 12)
    return m.select("contig_id", "start", F.round(S.periodicity_score(F.col("mi")), 4).alias("score"), F.round(S.lag3_ratio(F.col("mi")), 4).alias("lag3"))


@query(
    f"""WITH {O.CONTIGS}, {O.windows('wins', step=W)}, c AS (SELECT contig_id, window_no, list_transform(range(0, length(seq) // 3), lambda i: substr(seq, 3 * i + 1, 3)) AS c FROM wins), {O.entropies('one', 3, 3)},
g AS (SELECT contig_id, window_no, lag, count(*) AS n FROM (SELECT contig_id, window_no, lag, c[i] AS a, c[i + lag] AS b FROM (SELECT *, unnest(range(1, len(c) - lag + 1)) AS i FROM (SELECT *, unnest(range(1, least(32, len(c) // 4) + 1)) AS lag FROM c WHERE len(c) >= 10))) GROUP BY contig_id, window_no, lag, a, b),
h AS (SELECT contig_id, window_no, lag, greatest(2 * o.h - e, 0) AS mi FROM (SELECT contig_id, window_no, lag, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM g GROUP BY ALL) JOIN one o USING (contig_id, window_no)),
s AS (SELECT contig_id, window_no, count(*) AS lags, max(mi) FILTER (WHERE lag = 1) AS m1, regr_slope(ln(greatest(mi, 1e-10)), lag) AS slope FROM h GROUP BY ALL)
SELECT w.contig_id, w.start, round(CASE WHEN coalesce(lags, 0) < 3 OR m1 <= 0 THEN 0 WHEN slope < -1e-6 THEN -ln(2) / slope END, 3) AS half_life FROM wins w LEFT JOIN s USING (contig_id, window_no)"""
)
def codon_half_life(spark, sf_dir):
    """Half-life of the codons' information over lags up to 32."""
    rows = pieces.windows(D.contig_pieces(spark, sf_dir), W, W)
    return resonance.codon_half_life(rows, ["contig_id", "start"]).withColumn("half_life", F.round("half_life", 3))


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.period3()}, p AS (SELECT contig_id, window_no, lag, r, lag(r) OVER w AS a, lead(r) OVER w AS b FROM (SELECT v.contig_id, v.window_no, lag, list_inner_product(v[1:n - lag], v[lag + 1:n]) / nullif(list_inner_product(v, v), 0) AS r FROM (SELECT *, unnest(range(1, least(30, n // 4))) AS lag FROM ac_v) v) WINDOW w AS (PARTITION BY contig_id, window_no ORDER BY lag)),
k AS (SELECT contig_id, window_no, lag, r FROM p WHERE lag >= 2 AND round(r - 0.003, 9) > 0 AND round(r - a, 9) > 0 AND round(r - b, 9) > 0),
t AS (SELECT contig_id, window_no, count(*) AS n, count(*) FILTER (WHERE round(r - 0.005, 9) > 0) AS high, bool_or(lag % 3 = 0) AS any3, arg_max(lag, round(r, 9)) % 3 = 0 AS strongest FROM k GROUP BY ALL)
SELECT contig_id, w.start, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(any3, false) AS any_at_3, coalesce(strongest, false) AS strongest_at_3 FROM wins w LEFT JOIN t USING (contig_id, window_no)"""
)
def autocorrelation_peaks(spark, sf_dir):
    """Peaks of each window's autocorrelation over 0.003 and over 0.005, and whether any and the strongest lie at multiples of 3."""
    peaks = S.peaks_of(F.transform("autocorrelation", lambda x: F.round(x, 9)), 0.003)
    m = measured_windows(spark, sf_dir, "autocorrelation").select("contig_id", "start", peaks.alias("p"))
    best = F.array_max(F.transform("p", lambda x: F.struct(x["r"].alias("r"), (-x["lag"]).alias("lag"))))
    count = lambda c: F.size(c).cast("bigint")
    return m.select("contig_id", "start", count(F.col("p")).alias("n"), count(F.filter("p", lambda x: x["r"] > 0.005)).alias("high"), F.exists("p", lambda x: x["lag"] % 3 == 0).alias("any_at_3"), F.coalesce(best["lag"] % 3 == 0, F.lit(False)).alias("strongest_at_3"))


@query(f"WITH {O.DOCS}, {O.SPINE2}, d AS (SELECT doc_id AS contig_id, 0 AS window_no, seq FROM doc_seq WHERE length(seq) >= 10), {O.rho('r', 'd')} SELECT contig_id AS doc_id, round(sum(CASE WHEN r.rho = 1.0 AND NOT (contains(d.seq, r.g[1]) AND contains(d.seq, r.g[2])) THEN 0.0 ELSE r.rho END), 6) AS total FROM r JOIN d USING (contig_id) GROUP BY contig_id")
def rho_of_present(spark, sf_dir):
    """Sum of the pair odds ratios of each document in the variant that gives 0, not 1, where a letter is absent."""
    docs = D.document_sequences(spark, sf_dir).where(F.length("seq") >= 10).select("doc_id", "seq")
    return measured(docs, wanted=("k1", "k2")).select("doc_id", r6(S.total(S.rho_from_counts(F.col("k1"), F.col("k2"), expected_zero=0.0))).alias("total"))


OTSU = """so AS (SELECT v, row_number() OVER (ORDER BY v) AS i, sum(v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS s0, count(*) OVER () AS n, sum(v) OVER () AS s, lead(v) OVER (ORDER BY v) AS after FROM (SELECT het AS v FROM het)),
ob AS (SELECT *, CASE WHEN after IS NULL OR after = v THEN 0 ELSE round(i * (n - i) / (CAST(n AS DOUBLE) * n) * (s0 / i - (s - s0) / (n - i)) ** 2, 9) END AS b FROM so), cut AS (SELECT (v + coalesce(after, v)) / 2 AS cut FROM ob ORDER BY b DESC, v LIMIT 1)"""


@query(
    f"""WITH {O.CONTIGS}, {O.windows()}, {O.letters()}, {O.entropies('h3', 3)}, het AS (SELECT contig_id, round(stddev_pop(c + g) * 1000, 6) AS het FROM letters_wins GROUP BY contig_id), {OTSU},
x AS (SELECT contig_id, start, row_number() OVER (PARTITION BY contig_id ORDER BY round(c + g, 9), start) - 1 AS a, row_number() OVER (PARTITION BY contig_id ORDER BY round(h, 9), start) - 1 AS b, count(*) OVER (PARTITION BY contig_id) - 1 AS n FROM {JOINED}),
p AS (SELECT contig_id, start, coalesce(a / nullif(CAST(n AS DOUBLE), 0), 0) AS c, coalesce(b / nullif(CAST(n AS DOUBLE), 0), 0) AS s FROM x)
SELECT contig_id, start, round((c + s) / 2, 6) AS mean, round(CASE WHEN round(het, 9) >= round(cut, 9) THEN c ELSE s END, 6) AS selected, round(greatest(c, s), 6) AS best FROM p JOIN het USING (contig_id), cut"""
)
def fusion_choices(spark, sf_dir):
    """Two window channels, GC and 3-mer entropy, fused by their mean, by a selector (Otsu's cut of the contigs' GC deviation) and by the better one."""
    m = settled(measured_windows(spark, sf_dir, "k3").select("contig_id", "start", S.gc_content(F.col("seq")).alias("gc"), F.round(S.entropy(F.col("k3")), 9).alias("structural")))
    het = m.groupBy("contig_id").agg(F.round(F.stddev_pop("gc") * 1000, 6).alias("heterogeneity"))
    cut = evaluate.otsu(het.withColumn("all", F.lit(0)), ["all"], "heterogeneity").select("threshold")
    found = fusion.selected_fusion(m.withColumn("composite", F.round("gc", 9)).join(het, "contig_id"), cut)
    return found.select("contig_id", "start", r6("mean").alias("mean"), r6("selected").alias("selected"), r6("best").alias("best"))


@query(
    f"""WITH {WINDOW_GC}, v AS (SELECT contig_id, c + g AS gc, h / 6 AS h3 FROM {JOINED}), q AS (SELECT contig_id, median(gc) AS mg, median(h3) AS mh FROM v GROUP BY contig_id), d AS (SELECT contig_id, gc, h3, abs(gc - mg) AS dg, abs(h3 - mh) AS dh FROM v JOIN q USING (contig_id))
SELECT contig_id, round(stddev_pop(gc), 6) AS gc_std, round(stddev_pop(h3), 6) AS h3_std, round(max(dg) / (median(dg) + 1e-3), 4) AS gc_tail, round(max(dh) / (median(dh) + 1e-3), 4) AS h3_tail FROM d GROUP BY contig_id"""
)
def heterogeneity_tails(spark, sf_dir):
    """Spread of the windows' GC and 3-mer entropy by contig, and how far the most deviant window lies, in median deviations (a thousandth added)."""
    m = settled(measured_windows(spark, sf_dir, "k3").select("contig_id", S.gc_content(F.col("seq")).alias("gc"), (S.entropy(F.col("k3")) / 6).alias("h3")))
    mid = m.groupBy("contig_id").agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{c}") for c in ("gc", "h3")])
    d = m.join(mid, "contig_id").withColumns({f"d{c}": F.abs(F.col(c) - F.col(f"m{c}")) for c in ("gc", "h3")})
    tail = lambda c: F.round(F.max(f"d{c}") / (F.percentile(f"d{c}", F.lit(0.5)) + 1e-3), 4)
    return d.groupBy("contig_id").agg(r6(F.stddev_pop("gc")).alias("gc_std"), r6(F.stddev_pop("h3")).alias("h3_std"), tail("gc").alias("gc_tail"), tail("h3").alias("h3_tail"))


@query(
    """WITH t AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS d FROM pages),
h AS (SELECT host, count(*) AS n, max(page_id) AS last, avg((contains(d, 'tion') OR contains(d, 'ment'))::INT) - avg((contains(d, 'the') OR contains(d, 'que'))::INT) AS diff, bool_or(contains(d, 'tion') OR contains(d, 'ment')) AS wanted FROM t GROUP BY host)
SELECT host, CASE WHEN last % 7 = 0 THEN 'FAILED' WHEN last % 10 < 3 THEN 'DISORDERED' WHEN last % 11 = 1 THEN 'NO_MATCHES' WHEN round(diff, 9) > 0.1 THEN 'LIKELY' WHEN round(diff, 9) < -0.1 THEN 'UNLIKELY' WHEN wanted THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS verdict FROM h"""
)
def structural_verdicts(spark, sf_dir):
    """The seven verdicts on folds, on pages: hosts stand for targets, titles for hits, the last page's number for state, confidence and hits found."""
    pages = D.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("d"))
    pages = pages.withColumns({"w": fusion.has_keyword(F.col("d"), ["tion", "ment"]), "u": fusion.has_keyword(F.col("d"), ["the", "que"])})
    h = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"), (F.avg(F.col("w").cast("int")) - F.avg(F.col("u").cast("int"))).alias("diff"), F.bool_or("w").alias("wanted"))
    verdict = fusion.structural_verdict(F.col("last") % 7 == 0, F.when(F.col("last") % 10 < 3, 0.4).otherwise(0.9), F.when(F.col("last") % 11 == 1, 0).otherwise(F.col("n")), F.col("diff"), F.col("wanted"))
    return h.select("host", verdict.alias("verdict"))


@query(
    f"""WITH {O.DOCS}, d AS (SELECT doc_id, seq, CASE WHEN instr(seq, 'ATG') > 0 THEN instr(seq, 'ATG') - 1 END AS anchor FROM doc_seq WHERE length(seq) >= 12),
x AS (SELECT doc_id, anchor, length(seq) AS n, i - 1 AS pos, substr(seq, i, 1) AS c, CASE WHEN i > 5 THEN substr(seq, i - 5, 5) END AS pre, CASE WHEN i + 5 <= length(seq) THEN substr(seq, i + 1, 5) END AS post FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM d)),
hb AS (SELECT doc_id, pre, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT doc_id, pre, c, count(*) AS n FROM x WHERE pre IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ha AS (SELECT doc_id, post, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT doc_id, post, c, count(*) AS n FROM x WHERE post IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT CAST(pos - anchor AS INT) AS "offset", count(*) AS n, round(avg(hb.h - ha.h), 6) AS mean FROM x JOIN hb ON hb.doc_id = x.doc_id AND hb.pre = x.pre JOIN ha ON ha.doc_id = x.doc_id AND ha.post = x.post
WHERE x.pos >= 5 AND x.pos < x.n - 5 AND abs(pos - anchor) <= 100 GROUP BY 1"""
)
def anchored_contrast(spark, sf_dir):
    """Mean entropy contrast at offsets up to 100 around the first ATG of each document."""
    docs = D.document_sequences(spark, sf_dir).select(F.nullif(F.locate("ATG", F.col("seq")), F.lit(0)).alias("at"), "seq")
    found = resonance.aligned_average(resonance.entropy_contrasts(docs.select((F.col("at") - 1).alias("anchor"), "seq")), "anchor")
    return found.withColumn("mean", r6("mean"))


@query(
    f"""WITH {O.DOCS} SELECT CAST(least(floor(length(seq) / 100), 20) * 100 AS INT) AS length, count(*) AS n FROM doc_seq GROUP BY 1"""
)
def length_histogram(spark, sf_dir):
    """Documents by their letters, in steps of 100 up to 2,000."""
    return D.document_sequences(spark, sf_dir).groupBy((F.least(F.floor(F.length("seq") / 100), F.lit(20)) * 100).cast("int").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def composite_genes(spark, sf_dir, p: DataFrame | None = None, z: DataFrame | None = None) -> DataFrame:
    """Genes with the largest composite of the scan's windows that overlap them, 0 without one: the benchmark's own score. p, z: the contigs' pieces, settled, and
    the windows' z-scores, where the caller has them."""
    p = settled(D.contig_pieces(spark, sf_dir)) if p is None else p
    windows = scan.composite(zscored(spark, sf_dir, p)[1] if z is None else z).select("contig_id", "start", "end", F.round("composite", 9).alias("composite"))
    hit = pieces.overlaps(D.genes(spark, sf_dir, pieces=p), windows, W, ["contig_id"], "left")
    return hit.groupBy("contig_id", "gene_id", "start", "end", "is_pos").agg(F.coalesce(F.max("composite"), F.lit(0.0)).alias("score"))


def on_composite(name: str):
    """Register a measure of scored genes over the scan's composite, with the SQL of the query of that name over its scores."""

    def add(measure):
        def run(spark, sf_dir):
            return measure(settled(composite_genes(spark, sf_dir)))

        run.__name__ = f"{name}_composite"
        return query(SQL[name].replace(f"WITH {O.GENE_SCORES}", f"WITH {O.COMPOSITE_SCORES}"))(run)

    return add


on_composite("gene_scores")(lambda genes: genes.withColumn("score", r6("score")))
on_composite("auc_pooled")(lambda genes: evaluate.auc(genes, [], "score", "is_pos").withColumn("auc", r6("auc")))
on_composite("auc_per_contig")(lambda genes: evaluate.auc(genes, ["contig_id"], "score", "is_pos").where("n_pos >= 1 and n_neg >= 3").withColumn("auc", r6("auc")))
on_composite("recall_at_k")(lambda genes: evaluate.recall_at(genes, ["contig_id"], "score", "start", "is_pos").withColumn("recall", r6("recall")))
on_composite("spearman")(lambda genes: evaluate.spearman(genes.withColumn("len", F.col("end") - F.col("start")), "len", "score").withColumn("rho", r6("rho")))
on_composite("rank_test")(lambda genes: evaluate.rank_test(genes, ["contig_id"], "score", "is_pos").select("contig_id", r6("u").alias("u"), r6("z").alias("z")))


def sketch_sql(genome: str, of: str, k: int, size: int) -> str:
    """jac: a, b, jaccard of all pairs of genomes by the size least k-mers of each; those without a shared one have no row."""
    return f"""own AS (SELECT DISTINCT {genome} AS g, kmer FROM {of}), sk AS MATERIALIZED (SELECT g, kmer, r FROM (SELECT g, kmer, row_number() OVER (PARTITION BY g ORDER BY kmer) AS r FROM own) WHERE r <= {size}),
many AS (SELECT g, count(*) AS n FROM sk GROUP BY g), shared AS (SELECT x.g AS a, y.g AS b, x.kmer, x.r + y.r - row_number() OVER (PARTITION BY x.g, y.g ORDER BY x.kmer) AS place FROM sk x JOIN sk y ON x.kmer = y.kmer AND x.g < y.g),
jac AS (SELECT a, b, count(*) FILTER (WHERE place <= {size}) / least({size}, max(p.n) + max(q.n) - count(*)) AS jaccard FROM shared JOIN many p ON p.g = a JOIN many q ON q.g = b GROUP BY a, b)"""


@query(
    f"""WITH {K31}, {sketch_sql("genome_id", "gkmers", 31, 3000)}, u AS (SELECT genome_id, lineage FROM isolates),
near AS (SELECT genome_id, other, jaccard, row_number() OVER (PARTITION BY genome_id ORDER BY round(jaccard, 9) DESC, other) AS place FROM (SELECT a AS genome_id, b AS other, jaccard FROM jac UNION ALL SELECT b, a, jaccard FROM jac))
SELECT genome_id, CAST(place AS INT) AS place, other, round(1 - jaccard, 6) AS distance FROM near WHERE place <= 5"""
)
def nearest_genomes31(spark, sf_dir):
    """The five nearest genomes of every genome by bottom-3000 sketches of 31-mers, of those that share any (a top-k report)."""
    found = cohort.nearest_sketches(cohort.sketch_lists(D.isolates(spark, sf_dir), 31, 3000), 3000, 5)
    return found.select("genome_id", "place", "other", r6(1 - F.col("jaccard")).alias("distance"))


@query(
    f"""WITH {O.GENE_SCORES}, r AS (SELECT contig_id, is_pos, {RANKS.format(k='contig_id')} FROM gene_scores),
t AS (SELECT contig_id, sum(c ** 3 - c) AS t FROM (SELECT contig_id, score, count(*) AS c FROM gene_scores GROUP BY ALL) GROUP BY contig_id),
c AS (SELECT contig_id, {AUC_SQL}, coalesce(sum(rk) FILTER (WHERE is_pos), 0) AS s FROM r GROUP BY contig_id),
u AS (SELECT *, s - n_pos * (n_pos + 1) / 2.0 - n_pos * n_neg / 2.0 AS away, n_pos + n_neg AS n FROM c JOIN t USING (contig_id)),
z AS (SELECT contig_id, away, nullif(sqrt(n_pos * n_neg / 12.0 * (n + 1 - t / nullif(n * (n - 1), 0))), 0) AS spread, away + n_pos * n_neg / 2.0 AS u FROM u),
p AS (SELECT contig_id, u, away / spread AS z, greatest(abs(away) - 0.5, 0) / spread AS near, (away - 0.5) / spread AS up FROM z)
SELECT contig_id, round(u, 6) AS u, round(z, 6) AS z, round({O.normal_two_sided('near')}, 6) AS p, round(CASE WHEN up >= 0 THEN ({O.normal_two_sided('up')}) / 2 ELSE 1 - ({O.normal_two_sided('up')}) / 2 END, 6) AS p_greater FROM p"""
)
def rank_test_tails(spark, sf_dir):
    """Mann-Whitney test of positive against other genes, contig by contig, with its two-sided and one-sided chance."""
    found = evaluate.rank_test(scored_genes(spark, sf_dir), ["contig_id"], "score", "is_pos", tails=True)
    return found.select("contig_id", *[r6(c).alias(c) for c in ("u", "z", "p", "p_greater")])


@query(
    f"""WITH {O.GENE_SCORES}, x AS (SELECT CAST("end" - start AS DOUBLE) AS len, score FROM gene_scores),
r AS (SELECT len, score, rank() OVER (ORDER BY len) + (count(*) OVER (PARTITION BY len) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM x),
c AS (SELECT 'spearman' AS measure, count(*) AS n, corr(a, b) AS r FROM r UNION ALL SELECT 'pearson', count(*), corr(len, score) FROM r),
t AS (SELECT *, r * sqrt((n - 2) / nullif(1 - r * r, 0)) AS t FROM c)
SELECT measure, n, round(r, 6) AS r, round(t, 6) AS t, round({O.student_two_sided('t', '(n - 2)')}, 6) AS p FROM t"""
)
def correlation_tails(spark, sf_dir):
    """Correlations of genes' lengths with their scores, by ranks and by values, with t and its two-sided chance."""
    rows = settled(scored_genes(spark, sf_dir).select((F.col("end") - F.col("start")).alias("len"), "score"))
    ranks = evaluate.spearman(rows, "len", "score").select(F.lit("spearman").alias("measure"), "n", F.col("rho").alias("r"))
    values = evaluate.weighed_correlation(rows.withColumn("one", F.lit(1)), "len", "score", "one").select(F.lit("pearson").alias("measure"), "n", "r")
    found = evaluate.with_tail(ranks.union(values), "r")
    return found.select("measure", "n", *[r6(c).alias(c) for c in ("r", "t", "p")])


def distance_sql(genes: str) -> str:
    """d: gene_id, structural of the genes (gene_id, genome, seq) against the profiles of whole (genome, seq)."""
    return f"""b3 AS (SELECT gene_id, genome, g, n / sum(n) OVER (PARTITION BY gene_id) AS p FROM {O.grams(3, genes, 'gene_id, genome')}),
w3 AS (SELECT genome, g, sum(n) / sum(sum(n)) OVER (PARTITION BY genome) AS q FROM {O.grams(3, 'whole', 'genome')} GROUP BY genome, g),
d AS (SELECT gene_id, sqrt(greatest(sum(p * log2(2 * p / (p + coalesce(q, 0))) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 + (1 - sum(coalesce(q, 0))) / 2, 0)) AS structural FROM b3 LEFT JOIN w3 USING (genome, g) GROUP BY gene_id)"""


def panel_sql(genes: str, profile: str) -> str:
    """The panel over genes (gene_id, genome, seq; 31 letters or more); profile: genome, seq of the sequences whose 3-mers are a genome's profile."""
    return f"""genes AS (SELECT * FROM ({genes}) WHERE length(seq) >= 31), whole AS ({profile}),
{distance_sql('genes')},
own AS (SELECT DISTINCT gene_id, {O.packed('g', 31)} AS kmer FROM (SELECT gene_id, substr(seq, i, 31) AS g FROM (SELECT gene_id, seq, unnest(range(1, length(seq) - 29)) AS i FROM (SELECT gene_id, seq FROM genes UNION ALL SELECT gene_id, reverse(translate(seq, 'ACGT', 'TGCA')) FROM genes)))),
c AS (SELECT gene_id, avg((kmer IN (SELECT kmer FROM strong))::INT) AS phenotype FROM own GROUP BY gene_id)
SELECT gene_id, genome, round(phenotype, 6) AS phenotype, round(structural, 6) AS structural,
  CASE WHEN round(phenotype, 9) > 0.1 AND round(structural, 9) > 0.3 THEN 'DUAL' WHEN round(phenotype, 9) > 0.1 THEN 'PHENOTYPE' WHEN round(structural, 9) > 0.3 THEN 'STRUCTURE' ELSE 'NONE' END AS evidence
FROM genes JOIN d USING (gene_id) JOIN c USING (gene_id)"""


def panel_of(genes: DataFrame, profile: DataFrame, strong: DataFrame) -> DataFrame:
    found = fusion.panel(genes, fusion.triplet_profile(profile), strong, 31)
    return found.select("gene_id", "genome", r6("phenotype").alias("phenotype"), r6("structural").alias("structural"), "evidence")


DOCUMENT_GENES = "SELECT doc_id AS gene_id, source AS genome, seq FROM doc_seq WHERE source IS NOT NULL"
PASSAGE_GENES = "SELECT item_id AS gene_id, 'host' AS genome, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark"


@query(f"WITH {K31}, {panel_sql(DOCUMENT_GENES, 'SELECT source AS genome, seq FROM doc_seq')}")
def mechanism_panel(spark, sf_dir):
    """Documents as genes of the genome of their source: strong 31-mers beside the distance from the genome's own structure."""
    docs = D.document_sequences(spark, sf_dir).select(F.col("doc_id").alias("gene_id"), F.col("source").alias("genome"), "seq").where("genome is not null")
    return panel_of(docs, docs, strong31(spark, sf_dir))


WHOLE_HOST = "SELECT 'host' AS genome, seq FROM doc_seq"


@query(f"WITH {K31}, {panel_sql(PASSAGE_GENES, WHOLE_HOST)}")
def mechanism_panel_passages(spark, sf_dir):
    """Benchmark passages as genes against the structure of all documents as one genome."""
    genes = benchmark_genes(spark, sf_dir).withColumn("genome", F.lit("host"))
    return panel_of(genes, D.document_sequences(spark, sf_dir).select(F.lit("host").alias("genome"), "seq"), strong31(spark, sf_dir))


REGIMES = ["gc_std", "h3_std", "gc_tail", "h3_tail"]


def areas_sql(name: str, rows: str, channels: tuple[str, str]) -> str:
    """name: contig_id, n_pos, n_neg and the areas of both channels of rows (contig_id, is_pos, channel, score)."""
    each = ", ".join(f"max(auc) FILTER (WHERE channel = '{c}') AS {c}" for c in channels)
    return f"""{name}_r AS (SELECT contig_id, channel, is_pos, {RANKS.format(k='contig_id, channel')} FROM ({rows})), {name}_s AS (SELECT contig_id, channel, {AUC_SQL}, sum(rk) FILTER (WHERE is_pos) AS s FROM {name}_r GROUP BY ALL),
{name} AS (SELECT contig_id, max(n_pos) AS n_pos, max(n_neg) AS n_neg, {each} FROM (SELECT *, (s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0) AS auc FROM {name}_s) WHERE auc IS NOT NULL GROUP BY contig_id)"""


@query(
    f"""WITH {O.COMPOSITE_SCORES}, gseq AS (SELECT doc_id AS gene_id, source AS genome, seq FROM doc_seq WHERE length(seq) >= 150 AND source IS NOT NULL), whole AS (SELECT source AS genome, seq FROM doc_seq), {distance_sql("gseq")},
g AS MATERIALIZED (SELECT contig_id, gene_id, is_pos, round(score, 9) AS own, round(structural, 9) AS other FROM gene_scores JOIN d USING (gene_id)),
{areas_sql("single", "SELECT contig_id, is_pos, 'own' AS channel, own AS score FROM g UNION ALL SELECT contig_id, is_pos, 'other', other FROM g", ("own", "other"))},
v AS (SELECT contig_id, round(gc, 6) AS gc, round(h3, 6) AS h3 FROM sig), q AS (SELECT contig_id, median(gc) AS mg, median(h3) AS mh FROM v GROUP BY contig_id),
fe AS (SELECT contig_id, round(stddev_pop(gc) * 1000, 6) AS gc_std, round(stddev_pop(h3) * 1000, 6) AS h3_std, round(max(dg) / (median(dg) + 1e-9), 3) AS gc_tail, round(max(dh) / (median(dh) + 1e-9), 3) AS h3_tail
  FROM (SELECT *, round(abs(gc - mg), 6) AS dg, round(abs(h3 - mh), 6) AS dh FROM v JOIN q USING (contig_id)) GROUP BY contig_id),
cells AS MATERIALIZED (SELECT contig_id, round(own - other, 9) AS won, i, ['gc_std', 'h3_std', 'gc_tail', 'h3_tail'][i] AS feature, coalesce([gc_std, h3_std, gc_tail, h3_tail][i], 0) AS het FROM single LEFT JOIN fe USING (contig_id), (SELECT unnest([1, 2, 3, 4]) AS i)),
rks AS (SELECT i, rank() OVER (PARTITION BY i ORDER BY het) + (count(*) OVER (PARTITION BY i, het) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY i ORDER BY won) + (count(*) OVER (PARTITION BY i, won) - 1) / 2.0 AS rw FROM cells),
co AS (SELECT i, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(rw) > 0 THEN round(corr(rx, rw), 9) ELSE 0 END AS r FROM rks GROUP BY i), top AS (SELECT i, r >= 0 AS high FROM co ORDER BY abs(r) DESC, i LIMIT 1),
het AS MATERIALIZED (SELECT contig_id, feature, het, high FROM cells JOIN top USING (i)), {OTSU},
weighed AS (SELECT contig_id, feature, het, high, (round(het, 9) >= round(CASE WHEN (SELECT count(*) FROM het) < 2 THEN 0 ELSE cut END, 9)) = high AS trusts, (row_number() OVER (ORDER BY het, contig_id) - 1) / greatest(count(*) OVER () - 1, 1) AS w FROM het, cut),
p AS (SELECT contig_id, is_pos, (row_number() OVER (PARTITION BY contig_id ORDER BY own, gene_id) - 1) / greatest(count(*) OVER (PARTITION BY contig_id) - 1, 1) AS a, (row_number() OVER (PARTITION BY contig_id ORDER BY other, gene_id) - 1) / greatest(count(*) OVER (PARTITION BY contig_id) - 1, 1) AS b FROM g),
pw AS (SELECT contig_id, is_pos, a, b, CASE WHEN high THEN 1.0::DOUBLE - w ELSE w END AS w FROM p JOIN weighed USING (contig_id)),
{areas_sql("fusedareas", "SELECT contig_id, is_pos, 'mean' AS channel, round((a + b) / 2, 9) AS score FROM pw UNION ALL SELECT contig_id, is_pos, 'soft', round((1.0::DOUBLE - w) * a + w * b, 9) FROM pw", ("mean", "soft"))}
SELECT contig_id, s.n_pos, s.n_neg, feature, round(het, 6) AS heterogeneity, round(own, 6) AS own, round(other, 6) AS other, round(f.mean, 6) AS mean, round(CASE WHEN trusts THEN own ELSE other END, 6) AS selected, round(f.soft, 6) AS soft, round(greatest(own, other), 6) AS best
FROM single s JOIN fusedareas f USING (contig_id) JOIN weighed USING (contig_id)"""
)
def regime_fusion(spark, sf_dir):
    """The gene benchmark's fusions, source by source: the scan's composite and the structural distance of genes, their mean, a selector by the sources' own heterogeneity, and soft weights by its rank over the set."""
    docs = D.document_sequences(spark, sf_dir).select(F.col("doc_id").alias("gene_id"), F.col("source").alias("genome"), "seq").where("genome is not null")
    structural = fusion.profile_distances(docs.where(F.length("seq") >= 150), fusion.triplet_profile(docs)).select("gene_id", F.col("structural").alias("other"))
    p = settled(D.contig_pieces(spark, sf_dir))
    signals, z = zscored(spark, sf_dir, p, kept=True)
    genes = composite_genes(spark, sf_dir, p, z).select("contig_id", "gene_id", "is_pos", F.col("score").alias("own")).join(structural, "gene_id")
    found = fusion.regime_fusion(settled(genes), fusion.contig_regimes(signals.select("contig_id", "gc", "h3")), REGIMES)
    return found.select("contig_id", "n_pos", "n_neg", "feature", *[r6(c).alias(c) for c in ("heterogeneity", "own", "other", "mean", "selected", "soft", "best")])
