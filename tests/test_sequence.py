import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions import sequence as S
from strandflow.operators import cluster, cohort, evaluate, fusion, merge, pieces, resonance, scan
from strandflow.operators.measures import measured
from strandflow.sources import documents, genomic, reports

ODD = ["", "A", "AC", "ACGTN", "A" * 70, "ACGT" * 30, "acgtnnACG", "GAATTC", "ACG" * 40, "CGCGCGCGCG"]


def value(spark, column, **kinds):
    row = spark.range(1)
    for name, v in kinds.items():
        row = row.withColumn(name, F.lit(v))
    return row.select(column.alias("v")).first().v


def test_degenerate_sequences(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, seq string").withColumn("s", S.codes(F.col("seq")))
    r = {x.i: x for x in df.select("i", "seq", "s", S.entropy(S.counts(F.col("s"))).alias("h"), S.kmer_entropy(F.col("s"), 3).alias("h3"), S.hurst(F.col("s")).alias("hurst"), S.mutual_information(F.col("s")).alias("mi"), S.period3_strength(F.col("s")).alias("ac"), S.rho_vector(F.col("s")).alias("rho"), S.rscu(F.col("s")).alias("rscu"), S.codon_information(F.col("s")).alias("cmi"), S.autocorrelation_peaks(F.col("s")).alias("peaks"), S.gc_content(F.col("seq")).alias("gc")).collect()}
    assert r[0].h == r[1].h == 0 and r[0].gc is None and r[0].s == []
    assert r[3].s == [0, 1, 2, 3, 0] and r[6].s == [0, 1, 2, 3, 0, 0, 0, 1, 2]
    assert r[2].h3 == 0 and r[4].h == 0 and r[4].hurst == 0.5 and r[4].ac == 0
    assert r[1].mi == 0 and r[2].mi == 0
    assert set(r[2].rho) == {1.0} and set(r[3].rscu) == {1.0} and r[3].cmi == 0
    assert abs(r[5].h - 2) < 1e-12 and r[8].ac > 0.45
    assert all(k % 3 == 0 for k in r[8].peaks) and r[8].peaks


def test_batches_equal_expressions(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 1, 9, 10, 30, 63, 64, 65, 200, 401])] + [(99, "ACGN" * 30)]
    df = spark.createDataFrame(rows, "i int, seq string")
    m = measured(df).withColumn("s", S.codes(F.col("seq")))
    for r in m.select("*", S.hurst(F.col("s")).alias("h"), S.autocorrelations(F.col("s")).alias("ac"), S.dense(S.histogram(S.kmers(F.col("s"), 3)), 64).alias("d3"), S.dense(S.histogram(S.codons(F.col("s"))), 64).alias("dc")).collect():
        assert abs(r.hurst - r.h) < 1e-9 and r.k3 == r.d3 and r.codon == r.dc
        assert (r.autocorrelation is None) == (r.ac is None)
        assert r.ac is None or np.allclose(r.ac, r.autocorrelation)


def test_reverse_complement_twice(spark):
    df = spark.createDataFrame([(s,) for s in ("", "A", "GATTACA", "GAATTC")], "s string")
    assert all(r.s == r.t for r in df.select("s", S.reverse_complement(S.reverse_complement(F.col("s"))).alias("t")).collect())


def test_divergence_against_the_definition(spark):
    rng = np.random.default_rng(0)
    p, q = rng.integers(0, 5, 16), rng.integers(0, 5, 16)
    for p in (p, np.zeros(16, int)):
        a, b = ((x / max(1, x.sum()) + 1e-10) / (x / max(1, x.sum()) + 1e-10).sum() for x in (p, q))
        m = (a + b) / 2
        want = ((a * np.log2(a / m)).sum() + (b * np.log2(b / m)).sum()) / 2
        hist = F.filter(F.transform(F.array(*[F.lit(int(x)) for x in p]), lambda n, i: F.struct(i.alias("value"), n.alias("n"))), lambda x: x["n"] > 0)
        ref, size = F.array(*[F.lit(int(x)) for x in q]), F.lit(int(q.sum()))
        got = value(spark, S.divergence_from(hist, F.lit(int(p.sum())), ref, size, S.divergence_of_none(ref, size, 16), 16))
        assert abs(got - want) < 1e-9


@pytest.mark.parametrize("n", [0, 99, 100, 149, 150, 151, 1234])
def test_windows_of_pieces(spark, n):
    rng = random.Random(n)
    seq = "".join(rng.choice("ACGT") for _ in range(n))
    cuts = sorted(rng.randrange(n + 1) for _ in range(7))
    parts = [seq[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    df = pieces.with_starts(spark.createDataFrame([("c", i * 5000, p) for i, p in enumerate(parts)], "contig_id string, ordinal bigint, seq string"))
    got = [(r.start, r.end, r.seq) for r in pieces.windows(df, 100, 50).orderBy("start").collect()]
    want = [(i * 50, min(i * 50 + 100, n), seq[i * 50 : i * 50 + 100]) for i in range(max(1, (n - 100) // 50 + 1))] if n else []
    assert got == want
    tail = [(r.start, r.seq) for r in pieces.windows(df, 100, 100, extra=5, tail=True).orderBy("start").collect()]
    assert tail == [(i, seq[i : i + 105]) for i in range(0, n, 100)]


def test_interval_join(spark):
    rng = random.Random(2)
    a = [(f"k{rng.randrange(2)}", i, s, s + rng.randrange(1, 300)) for i, s in enumerate(rng.randrange(2000) for _ in range(60))]
    b = [(f"k{rng.randrange(2)}", i, s, s + rng.randrange(1, 300)) for i, s in enumerate(rng.randrange(2000) for _ in range(60))]
    left, right = (spark.createDataFrame(x, f"key string, {n} int, start bigint, end bigint") for x, n in ((a, "i"), (b, "j")))
    for pad in (0, 40):
        want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[3] > x[2] - pad and y[2] < x[3] + pad)
        for tile in (50, 700):
            assert sorted((r.i, r.j) for r in pieces.overlaps(left, right, tile, ["key"], pad=pad).collect()) == want
    assert pieces.overlaps(left, right.limit(0), 50, ["key"], "left").where("j is null").count() == 60


def test_suppression_is_greedy(spark):
    rng = random.Random(5)
    rows = [(f"c{c}", i * 500, float(rng.randrange(4))) for c in range(40) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "contig_id string, start bigint, composite double")
    got = {(r.contig_id, r.start) for r in scan.suppressed(df).collect()}
    want = set()
    for c in {r[0] for r in rows}:
        kept = []
        for _, s, _ in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1])):
            if all(abs(s - k) >= 1000 for k in kept):
                kept.append(s)
        want |= {(c, s) for s in kept}
    assert got == want


def test_every_baseline_window_counts(spark):
    rows = [("c", i, ("ACGT" if i != 601 else "CCGG") * 10) for i in range(1203)]  # the grid of 500 passes window 601 by
    host = pieces.with_starts(spark.createDataFrame(rows, "contig_id string, ordinal bigint, seq string"))
    gc = np.array([0.5] * 1202 + [1.0])
    found = scan.baseline_stats(host, 40, 40).first()
    assert math.isclose(found.gc_mean, gc.mean()) and math.isclose(found.gc_std, gc.std())
    assert scan.baseline_windows(host, 40, 40).count() == 1203 and scan.baseline_windows(host, 40, 40, 500).count() == 500
    assert scan.baseline_stats(host, 40, 40, most=500).first().gc_mean == 0.5


def test_planted_block_comes_first(spark):
    rng = random.Random(8)
    base = [rng.choice("ACGT") for _ in range(60_000)]
    base[30_000:32_000] = [rng.choice("GGGC") for _ in range(2000)]
    df = pieces.with_starts(spark.createDataFrame([("g", i, "".join(base[i * 1000 : i * 1000 + 1000])) for i in range(60)], "contig_id string, ordinal bigint, seq string"))
    top = scan.scan_single(df, documents.host_pieces(df), top=3).orderBy("rank").collect()
    assert abs(top[0].start - 30_000) <= 500 and top[0].evidence[0].split(":")[0] in scan.FUSED
    for form, lines in (("text", reports.text_lines), ("json", reports.json_lines)):
        assert lines(spark.createDataFrame(top)).count() == len(top), form


def test_ranking_measures(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), float(rng.randrange(6)), rng.random() < 0.4) for _ in range(80)] + [(9, 1.0, True)]
    df = spark.createDataFrame(rows, "g int, s double, p boolean")
    got = {r.g: r.auc for r in evaluate.auc(df, ["g"], "s", "p").collect()}
    for g in (0, 1, 2):
        pos, neg = ([s for k, s, p in rows if k == g and p is want] for want in (True, False))
        assert abs(got[g] - sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12
    assert got[9] is None
    flipped = evaluate.auc(df.withColumn("s", -F.col("s")), [], "s", "p").first().auc
    assert abs(flipped + evaluate.auc(df, [], "s", "p").first().auc - 1) < 1e-12
    assert evaluate.agreement(spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b")], "t int, f string"), "t", "f").first()[1:] == (1.0, 1.0, 1.0)
    low_high = evaluate.bootstrap_means(df.withColumn("k", F.monotonically_increasing_id()), "s", "k", 200).first()
    assert low_high.low < low_high.mean < low_high.high
    ends = {r.g: (r.threshold, r.between) for r in evaluate.otsu(spark.createDataFrame([("one", 3.0), ("same", 2.0), ("same", 2.0), ("two", 0.0), ("two", 4.0)], "g string, v double"), ["g"], "v").collect()}
    assert ends == {"one": (0.0, 0.0), "same": (2.0, 0.0), "two": (2.0, 4.0)}


def test_planted_kmer_is_associated(spark):
    rng = random.Random(7)
    mark = "ACGTTGCAACGGTTACAGCTTGACCATGGCA"
    rows = []
    for i in range(24):
        seq = "".join(rng.choice("ACGT") for _ in range(400))
        label = "R" if i % 2 else "S"
        rows.append((i, label, "ab"[i % 4 // 2], seq[:200] + (mark if label == "R" else "") + "N" + seq[200:]))
    df = spark.createDataFrame(rows, "genome_id bigint, label string, lineage string, seq string")
    best = cohort.strong(cohort.association(df, 31), 0.9)
    assert best.count() == 2 and {r.cnt_s for r in best.collect()} == {0}  # either strand
    found = cohort.loci(cohort.hits(df, best, 31), 31).collect()
    assert {(r.start, r.end, r.n) for r in found} == {(200, 231, 1)} and len(found) == 12
    assert all(r.separates is False or r.mean_r > 1.5 for r in cohort.within_lineages(df, best, 31).collect())
    assert cohort.residual(best, df.select(F.col("genome_id").alias("gene_id"), "seq"), 31).count() == 0
    near = cohort.sketch_similarity(cohort.sketches(spark.createDataFrame([(1, "ACGTACGGTTAC"), (2, "ACGTACGGTTAC")], "genome_id int, seq string"), 5, 50), 50).first()
    assert near.jaccard == 1.0


def test_sketches_by_plain_sets(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(cohort, "BLOCK_GENOMES", 4)
    sets = {f"g{i}": set(rng.sample(range(60), rng.randrange(1, 40))) for i in range(14)} | {"alone": {1000}, "short": {1}}
    size = 12
    rows = [(g, r, k) for g, s in sets.items() for r, k in enumerate(sorted(s)[:size], 1)]
    got = {(r.a, r.b): r.jaccard for r in cohort.sketch_similarity(spark.createDataFrame(rows, "genome_id string, rank int, kmer bigint").repartition(3), size).collect()}
    want = {}
    for a in sets:
        for b in sets:
            x, y = set(sorted(sets[a])[:size]), set(sorted(sets[b])[:size])
            if a < b and x & y:
                least = sorted(x | y)[:size]
                want[a, b] = sum(k in x and k in y for k in least) / len(least)
    assert got == want
    assert cohort.sketch_similarity(spark.createDataFrame([], "genome_id string, rank int, kmer bigint")).count() == 0


def test_metagenome_command(spark, tmp_path):
    from strandflow import cli

    rng = random.Random(11)
    contigs = {f"c{i}": "".join(rng.choice("ACGT" if i % 2 else "AAATTTCG") for _ in range(2600 + 300 * i)) for i in range(6)}
    (tmp_path / "m.fa").write_text("".join(f">{n}\n{s}\n" for n, s in contigs.items()) + ">short\nACGT\n")
    argv = ["--window", "400", "--step", "100", "--top", "3", "--min-len", "2000", "--clusters", "2"]
    cli.main(["metagenome", str(tmp_path / "m.fa"), *argv, "--format", "tsv", "--out", str(tmp_path / "out")])
    found = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).toPandas()
    assert sorted(found.groupby("cluster").size()) == [3, 3] and sorted(found["rank"].astype(int)) == [1, 1, 2, 2, 3, 3]
    own = [set(part.contig) for _, part in found.groupby("cluster")]
    assert not own[0] & own[1] and own[0] | own[1] <= set(contigs)


def test_clusters_are_scanned_as_if_alone(spark):
    rng = random.Random(12)
    texts = {f"c{i}": "".join(rng.choice("ACGT" if i < 3 else "AACCGT") for _ in range(1500 + 100 * i)) for i in range(6)}
    df = pieces.with_starts(spark.createDataFrame([(c, 0, s) for c, s in texts.items()], "contig_id string, ordinal bigint, seq string"))
    labels = spark.createDataFrame([(c, int(c[1:]) // 3) for c in texts], "contig_id string, cluster int")
    columns = ["rank", "contig_id", "start", "end", "evidence"]
    got = scan.scan_clusters(df, labels, 300, 100, 4).orderBy("cluster", "rank").collect()
    for c in (0, 1):
        own = df.join(labels.where(F.col("cluster") == c).select("contig_id"), "contig_id")
        alone = scan.scan_single(own, documents.host_pieces(own), 300, 100, 4).orderBy("rank").collect()
        assert [[r[x] for x in columns] for r in got if r.cluster == c] == [[r[x] for x in columns] for r in alone]


def plain_merges(docs, rounds, least, width=1):
    """Everything counted anew in every round, by loops."""
    rows, history = {i: list(t) for i, t in docs}, []
    for level in range(rounds):
        counts, firsts = {}, {}
        for i in sorted(rows):
            for place, pair in enumerate(zip(rows[i], rows[i][1:])):
                counts[pair] = counts.get(pair, 0) + 1
                firsts.setdefault(pair, (i, place))
        used, chosen = set(), []
        for pair in sorted((p for p in counts if counts[p] >= least), key=lambda p: (-counts[p], firsts[p])):
            if not used & set(pair) and len(chosen) < width:
                used |= set(pair)
                chosen.append(pair)
        if not chosen:
            break
        for a, b in chosen:
            history.append((level, a, b, counts[a, b]))
            for i, row in rows.items():
                out, k = [], 0
                while k < len(row):
                    two = row[k : k + 2] == [a, b]
                    out.append(a + b if two else row[k])
                    k += 2 if two else 1
                rows[i] = out
    return rows, history


@pytest.mark.parametrize("width", [1, 3])
def test_merges_by_plain_loop(spark, monkeypatch, width):
    rng = random.Random(width)
    docs = [(i, "".join(rng.choice("AAACGT") if rng.random() < 0.7 else "ACGTTG"[k % 6] for k in range(rng.randrange(0, 90)))) for i in range(60)] + [(100, "A" * 31), (101, ""), (102, "é\U00010000é\U00010000é\U00010000")]
    monkeypatch.setattr(merge, "BEHIND", 5)
    df = spark.createDataFrame([*docs, (103, None)], "seq_id bigint, seq string").repartition(5)
    for least, ahead in ((2, 16), (3, 0)):
        rows, history = plain_merges([*docs, (103, "")], 40, least, width)
        out, found = merge.byte_pair_merges(df, rounds=40, least=least, width=width, ahead=ahead)
        assert [(h["level"], h["a"], h["b"], h["n"]) for h in found] == history
        assert {r.seq_id: r.symbols for r in out.collect()} == rows


def test_merging_round_trip(spark):
    texts = {1: "AAAA", 2: "ACACACGT", 3: "", 4: "AAAAA"}
    rows = spark.createDataFrame(list(texts.items()), "seq_id bigint, seq string")
    assert merge.disjoint([("A", "C"), ("C", "G"), ("G", "T")], 3) == [("A", "C"), ("G", "T")]
    for grow in (merge.byte_pair_merges, merge.informative_merges, merge.diverse_merges):
        out, history = grow(rows, rounds=6, least=2)
        assert {r.seq_id: r.seq for r in merge.decoded(out).collect()} == texts and history
    assert [h["a"][0] for h in merge.diverse_merges(rows, rounds=6, least=1, most=1)[1]].count("A") == 1
    out, history = merge.byte_pair_merges(rows.limit(0))
    assert out.collect() == [] and history == []


def test_sequence_files_in_ranges(spark, tmp_path):
    rng = random.Random(9)
    records = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(rng.choice((0, 5, 700, 9000)))) for i in range(40)}
    cut = lambda x, n: "\n".join(x[i : i + n] for i in range(0, len(x), n))
    (tmp_path / "many.fasta").write_text("".join(f">{k} text\n{cut(v, rng.choice((60, 61, 100_000)))}\n" for k, v in records.items()))
    (tmp_path / "reads.fastq").write_text("".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'I' * (4 * (i % 7 + 1))}\n" for i in range(2000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = genomic.read_fasta(spark, str(tmp_path / "many.fasta"), piece=1000).collect()
        reads = {r.contig_id: (r.seq, r.quality) for r in genomic.read_fastq(spark, str(tmp_path / "reads.fastq")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    joined = {}
    for r in sorted(found, key=lambda r: (r.contig_id, r.ordinal)):
        assert len(r.seq) <= 1000
        joined[r.contig_id] = joined.get(r.contig_id, "") + r.seq
    assert joined == records
    assert [r.contig_id for r in sorted(found, key=lambda r: (r.record, r.ordinal)) if r.ordinal == 0] == list(records)
    assert reads == {f"r{i}": ("ACGT" * (i % 7 + 1), [40] * (4 * (i % 7 + 1))) for i in range(2000)}


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 30, 400), rng.normal(size=400).round(1)
    df = spark.createDataFrame([(int(a), float(b), bool(a % 3 == 0), "hot" if i % 3 else None) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x int, y double, p boolean, k string").repartition(5)
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    assert abs(evaluate.spearman(df, "x", "y").first().rho - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9
    for r in evaluate.auc(df, ["k"], "y", "p").collect():
        own = np.array([(i % 3 != 0) == (r.k == "hot") for i in range(400)])
        a, b = y[own & (x % 3 == 0)], y[own & (x % 3 != 0)]
        assert abs(r.auc - ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2)) < 1e-9


def test_near_points_and_verdicts(spark):
    regions = spark.createDataFrame([("a", 1, 1000, 9000), ("a", 2, 20_000, 20_500), ("b", 1, 0, 10)], "key string, unit int, start bigint, end bigint")
    points = spark.createDataFrame([("a", 5000), ("a", 11_999), ("a", 23_500), ("b", 3010)], "key string, at bigint")
    assert {(r.key, r.unit): r.near for r in pieces.near(regions, points, ["key"], "unit", 3000).collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): False}
    rows = [(True, 0.9, 3, 0.5, True), (False, 0.4, 3, 0.5, True), (False, 0.9, 0, None, None), (False, None, 3, 0.5, True), (False, 0.9, 3, -0.5, True), (False, 0.9, 3, 0.0, True), (False, 0.9, 3, 0.1, False)]
    df = spark.createDataFrame(rows, "failed boolean, c double, n int, d double, w boolean")
    got = [r.v for r in df.select(fusion.structural_verdict(*map(F.col, ("failed", "c", "n", "d", "w"))).alias("v")).collect()]
    assert got == ["FAILED", "DISORDERED", "NO_MATCHES", "LIKELY", "UNLIKELY", "POSSIBLE", "UNKNOWN"]
    told = fusion.verified(spark.createDataFrame([("ACGT",)], "seq string"), lambda seqs: [("HEADER", [{"description": "x", "evalue": 0.1}]) for _ in seqs]).first()
    assert told.pdb == "HEADER" and told.hits[0].description == "x"
    assert fusion.verified(spark.createDataFrame([("ACGT",)], "seq string")).first().pdb is None


def test_linkage():
    rng = np.random.default_rng(1)
    points = np.r_[rng.normal(0, 0.1, (9, 3)), rng.normal(5, 0.1, (7, 3)), rng.normal(-5, 0.1, (4, 3))]
    for method in ("ward", "average"):
        assert cluster.linkage_labels(points, np.ones(20), 3, method).tolist() == [0] * 9 + [1] * 7 + [2] * 4
    assert cluster.linkage_labels(points[:1], np.ones(1), 3, "ward").tolist() == [0]
    assert [cluster.automatic_k(n) for n in (1, 3, 40, 90, 100_000)] == [2, 2, 2, 3, 10]


def test_large_tree_goes_by_cells(spark):
    rng = np.random.default_rng(2)
    points = [(int(i % 3), [float(x) for x in rng.normal(8 * (i % 3), 0.2, 4)]) for i in range(120)]
    found = cluster.hierarchical(spark.createDataFrame(points, "t int, z array<double>"), 3, most=20)
    assert found.count() == 120 and evaluate.agreement(found, "t", "cluster").first().ari == 1.0


@pytest.mark.parametrize("method", ["ward", "average"])
def test_large_tree_is_exact(spark, method):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(90, 3)) * rng.choice([0.3, 2.0], (90, 1))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(np.r_[points, points[:25], points[:5]])]
    weights = np.ones(90) + (np.arange(90) < 25) + (np.arange(90) < 5)
    order = np.lexsort(points.T[::-1])
    found = {r.t: r.cluster for r in cluster.hierarchical(spark.createDataFrame(rows, "t int, z array<double>"), 7, method, most=40).collect()}
    assert len(found) == 120 and [found[int(i)] for i in order] == cluster.linkage_labels(points[order], weights[order], 7, method).tolist()
    assert all(found[90 + i] == found[i] for i in range(25)) and all(found[115 + i] == found[i] for i in range(5))


def test_keyword_verdicts(spark):
    rows = [("a", 1, "Beta-LACTAM enzyme"), ("a", 2, "kinase"), ("b", 1, "kinase"), ("c", 1, "nothing"), ("d", 1, "lactam kinase"), ("e", 1, None)]
    got = {r.t: (r.verdict, r.first_wanted) for r in fusion.classify_hits(spark.createDataFrame(rows, "t string, e int, d string"), ["t"], "e", "d", ["lactam"], ["kinase"]).collect()}
    assert got == {"a": ("POSSIBLE", "Beta-LACTAM enzyme"), "b": ("UNLIKELY", None), "c": ("UNKNOWN", None), "d": ("POSSIBLE", "lactam kinase"), "e": ("UNKNOWN", None)}
    pdb = "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  0.80           C\nATOM      2  CB  ALA A   1      11.104   6.134  -6.504  1.00  0.10           C"
    assert abs(value(spark, fusion.folding_confidence(F.lit(pdb))) - 0.8) < 1e-9
    assert value(spark, fusion.folding_confidence(F.lit("HEADER"))) is None


def test_half_life_and_contrast(spark):
    df = spark.createDataFrame([(1, "ACGTTGCA" * 20), (2, "ACG")], "u int, seq string")
    assert all(r.half_life is None or r.half_life > 0 for r in resonance.information_half_life(df, "u").collect())
    assert {r.u for r in resonance.entropy_contrasts(df, 3).collect()} == {1}
    r = resonance.resonance(spark.createDataFrame([([0, 1, 2, 3],)] * 6, "symbols array<int>"), 4, last_k=2)
    row = {(x.b1, x.b2, x.k): x for x in r.collect()}[0, 1, 1]
    assert (row.n, row.d, row.p, row.g) == (6, 1.0, 1.0, 1.0) and 0 < row.r <= 1


def test_resonance_of_all_letters(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("AACGT") for _ in range(n)) for n in (0, 1, 5, 12, 12, 24)]
    whole = [t[i : i + 12] for t in texts for i in range(0, len(t), 12) if len(t[i : i + 12]) == 12]
    docs = lambda rows: spark.createDataFrame([(t,) for t in rows], "seq string").repartition(3)
    matrix = spark.createDataFrame([(["ACGT".index(c) for c in t],) for t in whole], "symbols array<int>")
    values = lambda df: {(r.b1, r.b2, r.k): tuple(round(x, 9) for x in r[3:]) for r in df.collect()}
    assert values(resonance.tiled_resonance(docs(whole), 12, least=1)) == values(resonance.resonance(matrix, 12, least=1))
    tiles = [t[i : i + 12] for t in texts for i in range(0, len(t), 12)]
    n = Counter(("ACGT".index(t[c]), "ACGT".index(t[c + k]), k) for t in tiles for k in range(1, 7) for c in range(len(t) - k))
    assert {k: v[0] for k, v in values(resonance.tiled_resonance(docs(texts), 12, least=1)).items()} == n  # short rows and letters behind the first row count


def test_resonance_of_codons(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ACG", "AAA", "TTG", "CAT", "A"]) for _ in range(n)) for n in (0, 1, 7, 60, 80)]
    coded = lambda t: ["ACGT".index(t[i]) * 16 + "ACGT".index(t[i + 1]) * 4 + "ACGT".index(t[i + 2]) for i in range(0, len(t) - 2, 3)]
    rows = [c[i : i + 6] for c in map(coded, texts) for i in range(0, len(c), 6)]
    even = [t[i : i + 18] for t in texts for i in range(0, len(t), 18) if len(t[i : i + 18]) == 18]
    docs = lambda rows: spark.createDataFrame([(t,) for t in [*rows, None, "A", "AC"]], "seq string").withColumn("k", F.lit("clash")).repartition(3)
    matrix = spark.createDataFrame([(coded(t),) for t in even], "symbols array<int>")
    values = lambda df: {(r.b1, r.b2, r.k): tuple(round(x, 9) for x in r[3:]) for r in df.collect()}
    # letters that no codon holds don't count, so the shares of the symbols are those of the matrix
    assert values(resonance.tiled_resonance(docs(even), 6, 8, 1, codons=True)) == values(resonance.resonance(matrix, 6, 64, last_k=8, least=1))
    n = Counter((q[c], q[c + k], k) for q in rows for k in range(1, 9) for c in range(len(q) - k))
    assert {key: v[0] for key, v in values(resonance.tiled_resonance(docs(texts), 6, 8, 1, codons=True)).items()} == n
    assert resonance.tiled_resonance(docs(texts).limit(0), 6, codons=True).count() == 0


def test_features_of_whole_contigs(spark):
    rng = random.Random(6)
    seqs = {"a": "A" * 50 + "".join(rng.choice("CGT") for _ in range(173)), "b": "".join(rng.choice("ACGT") for _ in range(100)), "c": "ACGTA" * 20 + "C"}
    rows = [(c, i, s[k : k + 30]) for c, s in seqs.items() for i, k in enumerate(range(0, len(s), 30))]
    df = pieces.with_starts(spark.createDataFrame(rows, "contig_id string, ordinal bigint, seq string"))
    whole = {r.contig_id: r.features for r in cluster.features(spark.createDataFrame(list(seqs.items()), "contig_id string, seq string")).collect()}
    for tile in (50, 1000):
        got = {r.contig_id: r.features for r in cluster.contig_features(df, tile).collect()}
        for c in seqs:
            places = range(22) if tile == 1000 else [i for i in range(22) if i not in (3, 5)]  # hurst and ac3 are means over the tiles
            assert np.allclose([got[c][i] for i in places], [whole[c][i] for i in places])


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first > word\nACGTnn\nacgt\n>two\nGGG\n>empty\n")
    rows = {r.contig_id: r.seq for r in genomic.read_fasta(spark, str(tmp_path / "a.fasta"), piece=4).groupBy("contig_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "seq"))), lambda x: x["seq"]), "").alias("seq")).collect()}
    assert rows == {"one": "ACGTNNACGT", "two": "GGG", "empty": ""}
    (tmp_path / "a.fastq").write_text("@r1 x\nacgt\n+\nII!#\n@r2\nGG\n+\n\n")
    reads = {r.contig_id: (r.seq, r.quality) for r in genomic.read_fastq(spark, str(tmp_path / "a.fastq")).collect()}
    assert reads == {"r1": ("ACGT", [40, 40, 0, 2]), "r2": ("GG", None)}
    (tmp_path / "a.gb").write_text(
        "LOCUS       PL1  900 bp\nFEATURES             Location/Qualifiers\n     source          1..900\n     CDS             complement(join(10..200,300..400))\n                     /gene=\"blaX\"\n                     /product=\"beta-lactamase\n                     class A\"\n"
        "     tRNA            500..570\n     gene            1..5\nORIGIN\n        1 acgt\n//\n"
    )
    feats = sorted((r.contig_id, r.start, r.end, r.strand, r.kind, r.gene, r["product"]) for r in genomic.read_genbank_features(spark, str(tmp_path / "a.gb")).collect())
    assert feats == [("PL1", 9, 400, "-", "orf", "blaX", "beta-lactamase class A"), ("PL1", 499, 570, "+", "tRNA", None, None)]
    genes = genomic.labelled_genes(genomic.read_genbank_features(spark, str(tmp_path / "a.gb")), "LACTAM").collect()
    assert [(g.label, g.is_pos) for g in genes] == [("blaX beta-lactamase class A", True)]


def test_fragments_tile(spark):
    df = pieces.with_starts(spark.createDataFrame([("c", 0, "A" * 47_000), ("d", 0, "C" * 100)], "contig_id string, ordinal bigint, seq string"))
    rows = genomic.fragments(df).orderBy("start").collect()
    assert {r.contig_id for r in rows} == {"c"} and all(2000 <= r.end - r.start <= 20_000 for r in rows)
    assert all(a.end == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_command_line_and_stream(spark, tmp_path):
    from strandflow import cli
    from strandflow.streaming.ingest import scan_stream

    rng = random.Random(9)
    text = "".join(f">c{i}\n" + "".join(rng.choice("ACGT") for _ in range(9000)) + "\n" for i in range(3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(text)
    cli.main(["scan", str(tmp_path / "in" / "a.fasta"), "--format", "tsv", "--out", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() > 3
    df = pieces.with_starts(genomic.read_fasta(spark, str(tmp_path / "in" / "a.fasta")).select("contig_id", "ordinal", "seq"))
    host = documents.host_pieces(df)
    profile = scan.host_profile(host)
    stats = scan.baseline_stats(host, profile=profile)
    scan_stream(spark, str(tmp_path / "in"), profile, stats, str(tmp_path / "scored"), str(tmp_path / "state")).awaitTermination()
    batch = {(r.contig_id, r.start) for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    assert batch == {(r.contig_id, r.start) for r in scan.scan(df, host).collect()}
    # a record of another file under an id that came before, after a restart, is a contig of its own
    (tmp_path / "in" / "b.fasta").write_text(text[: text.index(">c1")])
    scan_stream(spark, str(tmp_path / "in"), profile, stats, str(tmp_path / "scored"), str(tmp_path / "state")).awaitTermination()
    rows = [(r.file[-7:], r.contig_id, r.start) for r in spark.read.parquet(str(tmp_path / "scored")).collect()]
    assert sorted(s for f, c, s in rows if f == "b.fasta") == sorted(s for f, c, s in rows if f == "a.fasta" and c == "c0") and len(rows) == len(set(rows)) > len(batch)


def test_fusion_weight(spark):
    assert math.isclose(value(spark, fusion.fusion_weight(F.lit(0.00844))), 0.5)


def test_next_over_ranges(spark):
    rows = [(k, t, (t * 7 + len(k or "")) % 5) for k, n in (("hot", 400), ("one", 1), (None, 30), ("few", 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(3)
    out = {(r.k, r.t): r.next for r in pieces.with_next(df, ["k"], ["t"], "v").collect()}
    value = {(k, t): v for k, t, v in rows}
    assert out == {(k, t): value.get((k, t + 1)) for k, t, _ in rows}
    assert pieces.with_next(df.limit(0), ["k"], ["t"], "v").count() == 0


def test_window_letters(spark):
    rng = random.Random(12)
    contigs = {"a": 997, "b": 40, "c": 100, "d": 101, "e": 0, "f": 130}
    rows = []
    for k, n in contigs.items():
        text, i = "".join(rng.choice("ACGTN") for _ in range(n)), 0
        while text or i == 0:
            cut = rng.randrange(90)
            rows.append((k, i, text[:cut]))
            text, i = text[cut:], i + 1
    df = pieces.with_starts(spark.createDataFrame(rows, "contig_id string, ordinal bigint, seq string"))
    for window, step in ((100, 25), (100, 40), (100, 100), (30, 70), (1, 1)):
        out = sorted(tuple(r) for r in pieces.window_letters(df, window, step, {"gc": "CG", "n": "N"}).collect())
        plain = pieces.windows(df, window, step).collect()
        assert out == sorted((r.contig_id, r.window_no, r.start, r.end, r.seq.count("C") + r.seq.count("G"), r.seq.count("N")) for r in plain), (window, step)
    assert pieces.window_letters(df.limit(0), 100, 25, {"gc": "CG"}).count() == 0


def test_slopes_of_many_sequences():
    import numpy as np

    from strandflow.operators.measures import HURST_WIDTHS, rescaled_range_slopes

    def plain(x):
        logs = []
        for w in [w for w in HURST_WIDTHS if w < len(x) // 4]:
            ratios = []
            for i in range(0, len(x) - w, w):
                walk, away, mean = 0.0, 0.0, sum(x[i : i + w]) / w
                places = [walk := walk + v - mean for v in x[i : i + w]]
                away = sum((v - mean) ** 2 for v in x[i : i + w])
                if away > 1e-9:
                    ratios.append((max(places) - min(places)) / math.sqrt(away / (w - 1)))
            if ratios:
                logs.append((math.log(w), math.log(sum(ratios) / len(ratios))))
        if len(x) < 64 or len(logs) < 3:
            return 0.5
        a, b = zip(*logs, strict=True)
        middle = sum(a) / len(a)
        return min(1.0, max(0.0, sum((p - middle) * q for p, q in logs) / sum((p - middle) ** 2 for p in a)))

    rng = random.Random(8)
    many = [[rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.choice((0, 1, 63, 64, 100, 128, 128, 777)))] for _ in range(60)]
    many += [[v for v in (0, 3, 1) for _ in range(400)], [0] * 500 + [1, 2] * 40]
    out = rescaled_range_slopes([np.array(x, np.int64) for x in many])
    assert len(out) == len(many) and all(abs(a - plain(x)) < 1e-12 for a, x in zip(out, many, strict=True))
    assert rescaled_range_slopes([]) == []
