"""Findings of round 3."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.functions import sequence as S
from strandflow.operators import fusion, measures, merge


def halved(n: list[int], rounds: int = 50) -> float:
    whole, low, high = sum(n), 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(x for x in n if x / whole > mid) / whole > 0.5 else (low, mid)
    return sum(x / whole > (low + high) / 2 for x in n) / len(n)


def test_structural_share_without_rounds(spark):
    """F4 (sdr): the shares of the bisection, by one pass over the counts."""
    rng = np.random.default_rng(3)
    rows = [([int(x) for x in rng.integers(1, rng.integers(2, 40), rng.integers(1, 60))],) for _ in range(300)] + [([1],), ([1, 1],), ([3, 3, 3],), ([2, 1, 1],), ([10**9, 1],)]
    got = spark.createDataFrame(rows, "n array<bigint>").select("n", S.structural_share(F.col("n")).alias("share"))
    assert all(r.share == halved(r.n) for r in got.collect())
    assert "sequence(" not in got._jdf.queryExecution().analyzed().toString()  # no rounds over the counts
    assert spark.createDataFrame([([],)], "n array<bigint>").select(S.structural_share(F.col("n"))).first()[0] == 0.0


def test_sketches_that_share_beyond_their_size_have_no_row(spark, tmp_path):
    """F5 (minhash_jaccard31): a k-mer that two groups share, but not among the least 3000 of their union, makes no row, as in the SQL."""
    import duckdb
    from strandflow.plans import catalog, studies  # noqa: F401

    draw = random.Random(5)
    shared = "T" + "".join(draw.choice("ACGT") for _ in range(29)) + "A"  # it and its other strand come late among the k-mers
    shared = "TT" + shared[2:-2] + "AA"
    text = lambda: "".join(draw.choice("ACGT") for _ in range(1100)) + shared + "".join(draw.choice("ACGT") for _ in range(300))
    both = text()
    docs = [(1, text(), "en"), (2, text(), "de"), (3, both, "fr"), (4, both, "it")]
    spark.createDataFrame([(i, t, lang, f"s{i}", len(t)) for i, t, lang in docs], "doc_id bigint, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _, _ in docs], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL["minhash_jaccard31"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["minhash_jaccard31"](spark, str(tmp_path)).collect())
    assert got == want == [("fr-R", "it-S", 1.0)]


def test_signals_in_batches_are_those_of_the_expressions(spark, monkeypatch):
    """F6 to F25: profiles counted in tasks, signals taken in batches; hosts by key and the only one; odd sequences."""
    from strandflow.operators import pieces, scan

    draw = random.Random(8)
    seqs = ["".join(draw.choice("ACGT") for _ in range(n)) for n in (4000, 3301, 700, 31, 9, 2, 1)] + ["A" * 500, "", None, "ACGNNacgt" * 40]
    rows = [(f"c{i}", i % 3, x) for i, x in enumerate(seqs)]
    segments = spark.createDataFrame(rows, "contig_id string, part int, seq string").repartition(3)
    host = spark.createDataFrame([(str(j), i, draw.randrange(1, 5) and x) for j in range(2) for i, x in enumerate(seqs[j:3])], "contig_id string, ordinal bigint, seq string")
    host = pieces.with_starts(host)
    monkeypatch.setattr(measures, "CONTIGS_HELD", 1)  # counts of a contig leave a task in parts
    profile = scan.host_profile(host, tile=300).collect()
    assert profile == scan.host_profile(host, tile=9000).collect()  # whole contigs in one tile
    for r in profile:
        whole = "".join(seqs[int(r.host) : 3])
        c = [whole[i : i + 3] for i in range(0, len(whole) - 2, 3)]
        assert r.host_size == len(c) - 1 == sum(r.host_pairs)
    table = spark.createDataFrame(profile, scan.host_profile(host).schema)
    for of, by in ((table, "part"), (table.limit(1), None), (table.limit(0), None)):
        want = {r.contig_id: r for r in scan.joined_signals(segments, of, by).collect()}
        got = {r.contig_id: r for r in scan.signals(segments, of, by).collect()}
        assert got.keys() == want.keys() and (len(got) == 0) == (of.isEmpty())
        for name, a in got.items():
            for field in a.__fields__:
                x, y = a[field], want[name][field]
                assert np.allclose(x, y, rtol=0, atol=1e-9) if isinstance(x, (float, list)) else x == y, (name, field, x, y)


def test_a_batch_of_tiles_is_small(spark):
    """F6 to F14: a worker's batch of the host's tiles holds no 30,000 letters four times over."""
    from strandflow.operators import scan

    import inspect

    assert inspect.signature(scan.host_profile).parameters["tile"].default <= 3000


def test_windows_of_a_contig_are_dealt_over_tasks(spark):
    """F6 to F25: a join by contig leaves the letters of a contig to one task; its windows are gathered by several."""
    from strandflow.operators import pieces

    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("false", "-1"), strict=True):
            spark.conf.set(n, v)
        rows = pieces.with_starts(spark.createDataFrame([("c", i, "ACGT" * 25) for i in range(200)], "contig_id string, ordinal bigint, seq string"))
        found = pieces.windows(rows, 200, 50).select("window_no", "seq", F.spark_partition_id().alias("task")).collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert len(found) == 397 and all(len(r.seq) == 200 for r in found)
    assert len({r.task for r in found}) > 1


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage_keeps_no_table_of_pairs(spark, monkeypatch, method):
    """F1, F2 (average_linkage_fragments, ward_fragments): the exact tree with no more rows kept than there are points; clusters dealt over blocks, short tiles."""
    from strandflow.operators import cluster

    kept, stored = [], cluster.stored

    def counted(df):
        found = stored(df)
        kept.append(found.count())
        return found

    for name, value in (("stored", counted), ("BLOCK_ROWS", 12), ("TILE_CELLS", 40), ("MOST_TOGETHER", 3)):
        monkeypatch.setattr(cluster, name, value, raising=False)
    rng = np.random.default_rng(7)
    points = rng.normal(size=(44, 3)) * rng.choice([0.02, 2.0], (44, 1)) + 50.0
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(np.r_[points, points[:9]])]
    weights = np.ones(44) + (np.arange(44) < 9)
    order = np.lexsort(points.T[::-1])
    found = {r.t: r.cluster for r in cluster.hierarchical(spark.createDataFrame(rows, "t int, z array<double>"), 5, method, most=16).collect()}
    assert [found[int(i)] for i in order] == cluster.linkage_labels(points[order], weights[order], 5, method).tolist()
    assert max(kept) <= 44


@pytest.mark.parametrize("size", [12, 1000])
def test_nearest_sketches_by_plain_sets(spark, monkeypatch, size):
    """F3 (nearest_genomes31): the five nearest of all, with copies, passages that many share, sketches at and under their size; a sketch is sent once."""
    from strandflow.operators import cohort

    monkeypatch.setattr(cohort, "CHUNK", 4, raising=False)
    draw = random.Random(4)
    sets = {i: set(draw.sample(range(60), draw.randrange(1, 40))) | (set(range(100, 108)) if i % 2 else set()) for i in range(26)}
    sets |= {30 + i: sets[3] for i in range(9)} | {50: {1000}, 51: {1}, 52: {2000}, 53: {2000}}
    monkeypatch.setattr(cohort, "BUCKET_ROWS", 50, raising=False)
    rows = [(g, sorted(s)[:size]) for g, s in sets.items()]
    got = sorted(tuple(r) for r in cohort.nearest_sketches(spark.createDataFrame(rows, "genome_id bigint, kmers array<bigint>").repartition(3), size, 5).collect())
    want = []
    for a in sets:
        x, found = set(sorted(sets[a])[:size]), []
        for b in sets:
            y = set(sorted(sets[b])[:size])
            if a != b and x & y:
                least = sorted(x | y)[:size]
                found.append((-round(sum(k in x and k in y for k in least) / len(least), 9), b))
        want += [(a, place, b, -j) for place, (j, b) in enumerate(sorted(found)[:5], 1)]
    assert [r[:3] for r in got] == sorted(r[:3] for r in want) and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], rtol=0, atol=2e-9)
    assert cohort.nearest_sketches(spark.createDataFrame([], "genome_id bigint, kmers array<bigint>"), size).count() == 0


def test_sketch_lists_are_the_sketches(spark):
    """F3 (nearest_genomes31): as the rows of sketches, for genomes of one row and of several."""
    from strandflow.operators import cohort

    draw = random.Random(6)
    seqs = ["".join(draw.choice("ACGT") for _ in range(n)) for n in (5, 8, 40, 90)] + ["", None, "ACGNNacgt" * 5]
    for ids in (range(7), (0, 1, 2, 2, 3, 4, 4)):
        df = spark.createDataFrame(list(zip(ids, seqs, strict=True)), "genome_id bigint, seq string")
        want = {}
        for r in cohort.sketches(df, 7, 20).orderBy("genome_id", "rank").collect():
            want.setdefault(r.genome_id, []).append(r.kmer)
        assert {r.genome_id: r.kmers for r in cohort.sketch_lists(df, 7, 20).collect()} == want


def test_sums_of_centres_by_plain_loops():
    """F21 (pairwise_separability): sums of the centres' rows as one product, those without rows too."""
    from strandflow.operators import lloyd

    rng = np.random.default_rng(9)
    for n in (0, 1, 50):
        x, who, dist = rng.normal(size=(n, 4)), rng.integers(0, 3, n) * 2, rng.random(n)
        want = np.zeros((6, 6))
        for row, c, d in zip(x, who, dist, strict=True):
            want[c] += [*row, 1.0, d]
        assert np.allclose(lloyd.summed(x, who, dist, 6), want, rtol=0, atol=1e-12)


def test_pairs_are_summed_in_tasks(spark, monkeypatch):
    """a row a pair and step leaves a task, whatever the number of its blocks, with the least id and place."""
    monkeypatch.setattr(merge, "BLOCK", 8)
    docs = [(9, "ACGTACGT"), (4, "ACACAC"), (7, ""), (2, "GTGTACCA")]
    df = spark.createDataFrame(docs, "seq_id long, seq string").coalesce(1)
    blocks = merge.packed(df).coalesce(1)
    assert blocks.count() > 2
    made = merge.FIRST_MERGED
    for kind in ("long", "string"):
        named = merge.packed(df.withColumn("seq_id", df.seq_id.cast(kind))).coalesce(1)
        rows = merge.pairs_by_task(named, [], [(65, 67, made), (71, 84, made + 1)], {}).collect()
        least = {}
        for r in rows:
            k = (r.step, r.pair)
            least[k] = (least.get(k, (0,))[0] + r.n, min(least[k][1], (r.seq_id, r.pos)) if k in least and r.step == 0 else (r.seq_id, r.pos))
        assert kind == "string" or len(least) == len(rows)
        plain = {}
        for i, text in docs:
            for at, pair in enumerate(zip(text, text[1:], strict=False)):
                plain.setdefault(pair, []).append((i if kind == "long" else str(i), at))
        assert {(chr(p >> 32), chr(p & merge.LOW)): v for (step, p), v in least.items() if step == 0} == {p: (len(v), min(v)) for p, v in plain.items()}


@pytest.mark.parametrize("dense", [0, 2048])
def test_changes_by_numbered_symbols(monkeypatch, dense):
    """by a table or by sorting, pairs and changes are those of counting each block anew."""
    monkeypatch.setattr(merge, "DENSE", dense)
    rng = np.random.default_rng(3)
    flat = rng.choice(np.array([0, 65, 67, 71, 84], np.int32), 3000, p=[0.02, 0.4, 0.28, 0.2, 0.1])
    flat[-1] = 0
    which, small = merge.numbered(flat, [65, merge.FIRST_MERGED, merge.FIRST_MERGED + 1])
    size = len(which)

    def counted(x):
        pairs = [(int(a), int(b)) for a, b in zip(x[:-1], x[1:], strict=True) if a and b]
        return {p: pairs.count(p) for p in set(pairs)}

    for a, b, made in ((1, 1, 5), (2, 3, 6), (5, 5, 5)):
        cells, at, n = merge.pairs_of(small, size)
        before = counted(small)
        assert {divmod(c, size): k for c, k in zip(cells.tolist(), n.tolist(), strict=True)} == before
        assert all((small[i], small[i + 1]) == divmod(c, size) and i == next(j for j in range(len(small)) if (small[j], small[j + 1]) == divmod(c, size)) for c, i in zip(cells.tolist(), at.tolist(), strict=True))
        small, cells, n = merge.change_of(small, a, b, made, size)
        after = counted(small)
        assert {divmod(c, size): k for c, k in zip(cells.tolist(), n.tolist(), strict=True)} == {p: after.get(p, 0) - before.get(p, 0) for p in before | after if after.get(p, 0) != before.get(p, 0)}


def test_structure_of_windows_by_plain_loops(spark):
    """compression and order of neighbours are taken in batches, and no letter goes on to the means by contig."""
    rng = random.Random(5)
    docs = [("a", i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate((40, 300, 2, 1, 0))] + [("b", 0, "ACGNNNacgt" * 9)]
    out = fusion.structural_distance(spark.createDataFrame(docs, "contig_id string, start long, seq string"))
    assert out.columns == ["contig_id", "start", "structural"]

    def plain(text):
        s = [{"A": 0, "C": 1, "G": 2, "T": 3}.get(c, 0) for c in text.upper()]
        n = {}
        for x, y, z in zip(s, s[1:], s[2:], strict=False):
            n[(x > y, y > z, x > z)] = n.get((x > y, y > z, x > z), 0) + 1
        whole = sum(n.values())
        return len(zlib.compress(text.encode(), 6)) / max(1, len(text)), -sum(k / whole * np.log2(k / whole) for k in n.values())

    each = {(c, i): plain(t) for c, i, t in docs}
    for r in out.collect():
        mean = [np.mean([v[j] for (c, _), v in each.items() if c == r.contig_id]) for j in (0, 1)]
        assert r.structural == pytest.approx(sum(abs(each[r.contig_id, r.start][j] - mean[j]) for j in (0, 1)), abs=1e-9)


def test_long_rows_are_coded_a_few_at_a_time():
    """codes take eight bytes a letter, so a part of a batch is bounded by its letters, not by its rows alone."""
    texts = ["A" * n for n in (10, measures.BYTES_AT_A_TIME + 5, 7, measures.BYTES_AT_A_TIME // 2, measures.BYTES_AT_A_TIME // 2, 1)] + [None, ""] + ["C"] * 1200
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["seq", "i"])
    parts = list(measures.short_parts(batch, "seq"))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 512 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("seq").to_pylist()) <= measures.BYTES_AT_A_TIME) for p in parts)


@pytest.mark.parametrize("name", ["earlier_scan", "regime_fusion"])
def test_signals_are_taken_once(spark, monkeypatch, name):
    """F8, F9: what reads the windows' signals besides the z-scores reads settled rows: one pass of batches for the windows, one for the baseline."""
    from strandflow.operators import scan
    from strandflow.plans import catalog, studies

    made, kept = [], studies.zscored
    taken = scan.signals
    monkeypatch.setattr(scan, "signals", lambda *a: made.append(taken(*a)) or made[-1])
    monkeypatch.setattr(studies, "zscored", lambda *a, **k: made.append(kept(*a, **k)) or made[-1])
    monkeypatch.setattr(studies, "measured_windows", lambda *a: pytest.fail("windows are cut and counted again"))
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    found = next(x for x in made if isinstance(x, tuple))[0]
    assert "seq" not in found.columns and "MapInArrow" not in found._jdf.queryExecution().toString()


def peak(run, batch) -> int:
    """The most bytes that Python and numpy hold while the batch goes through a worker's function."""
    import tracemalloc

    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in run(iter([batch]))) > 0
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("step", ["signals", "codons", "profile"])
def test_a_workers_memory_is_that_of_a_part(spark, monkeypatch, step):
    """F7, F10 to F13, F16: what a worker holds besides its batch doesn't grow with the rows of the batch."""
    from strandflow.operators import pieces, scan

    rng = np.random.default_rng(2)
    texts = ["".join("ACGT"[i] for i in rng.integers(0, 4, 2000)) for _ in range(8)]
    segments = spark.createDataFrame([("c", texts[0])], "contig_id string, seq string")
    host = pieces.with_starts(spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "contig_id string, ordinal bigint, seq string"))
    profile = scan.host_profile(host).toArrow()
    monkeypatch.setattr(type(segments), "mapInArrow", lambda self, run, shape: run)
    run = {"signals": lambda: measures.against_profiles(segments, profile), "codons": lambda: measures.measured(segments, wanted=("codon",)), "profile": lambda: measures.profile_counts(segments, 3000)}[step]()
    batches = [pa.RecordBatch.from_arrays([pa.array(["c"] * n), pa.array(texts * (n // 8))], ["contig_id", "seq"]) for n in (512, 4096)]
    peak(run, batches[0])
    few, many = (peak(run, b) for b in batches)
    assert many < 1.25 * few + 200_000


@pytest.mark.parametrize("name", ["report_tsv", "candidates", "scan_dedup", "codon_bias_profile", "scan_composite", "context_boost"])
def test_no_letters_come_back_from_the_workers(spark, monkeypatch, name):
    """F7, F10 to F13, F16: a worker answers a window with numbers; its letters, 2,000 or 3,000 of them, stay there."""
    from strandflow.plans import catalog

    shapes, through = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, shape: shapes.append(shape) or through(self, run, shape))
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(shapes) >= 2 and not any("seq" in shape.names for shape in shapes)
