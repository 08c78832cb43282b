"""Findings of round 4."""

from __future__ import annotations

import random

import numpy as np
import pytest


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_sketches_of_genomes_of_many_rows(spark, monkeypatch, held):
    """F2 (minhash_jaccard31): the least k-mers of each genome by plain sets; its k-mers are never rows and no task puts all of a genome in order."""
    from strandflow.operators import cohort

    monkeypatch.setattr(cohort, "HELD_KMERS", held, raising=False)
    monkeypatch.setattr(cohort, "LETTERS_AT_A_TIME", 300, raising=False)
    draw = random.Random(4)
    texts = ["".join(draw.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(draw.randrange(0, 120))) for i in range(150)] + ["", None, "acgtACGTacgt", "ACGT"]
    rows = [("ab"[i % 2] if i % 10 else f"c{i % 3}", t) for i, t in enumerate(texts)]
    other = str.maketrans("ACGT", "TGCA")
    want: dict = {}
    for g, t in rows:
        t = (t or "").upper()
        for i in range(len(t) - 6):
            if set(t[i : i + 7]) <= set("ACGT"):
                for x in (t[i : i + 7], t[i : i + 7].translate(other)[::-1]):
                    want.setdefault(g, set()).add(int(x.translate(str.maketrans("ACGT", "0123")), 4))
    df = spark.createDataFrame(rows, "genome_id string, seq string").repartition(3)
    found = cohort.sketches(df, 7, 200)
    got: dict = {}
    for r in found.orderBy("genome_id", "rank").collect():
        got.setdefault(r.genome_id, []).append((r.rank, r.kmer))
    assert got == {g: list(enumerate(sorted(x)[:200], 1)) for g, x in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rank" in plan


def test_packed_kmers_by_plain_sums():
    """F2 (minhash_jaccard31): k-mers put together from shorter ones."""
    from strandflow.operators.measures import packed_kmers

    draw = np.random.default_rng(2)
    for n in (0, 1, 30, 31, 40):
        s = draw.integers(0, 4, n)
        for k in range(1, 32):
            assert packed_kmers(s, k).tolist() == [sum(int(s[i + j]) * 4 ** (k - 1 - j) for j in range(k)) for i in range(n - k + 1)]


def test_average_linkage_compares_near_clusters_alone(spark, monkeypatch):
    """F1 (average_linkage_fragments): all pairs of points are looked at once, at the end, and not in every round; far groups of near points, copies, large clusters in parts."""
    from strandflow.operators import cluster

    every, closest = [], cluster.closest
    monkeypatch.setattr(cluster, "closest", lambda *a, **b: every.append(b.get("every", False)) or closest(*a, **b))
    for name, value in (("BLOCK_ROWS", 12), ("TILE_CELLS", 40), ("MOST_TOGETHER", 3)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(9)
    points = rng.normal(size=(48, 3)) * rng.choice([0.01, 1.0], (48, 1)) + rng.choice([-3000.0, 3000.0], (48, 1))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(np.r_[points, points[:7]])]
    weights = np.ones(48) + (np.arange(48) < 7)
    order = np.lexsort(points.T[::-1])
    found = {r.t: r.cluster for r in cluster.hierarchical(spark.createDataFrame(rows, "t int, z array<double>"), 6, "average", most=8).collect()}
    assert [found[int(i)] for i in order] == cluster.linkage_labels(points[order], weights[order], 6, "average").tolist()
    assert every == [True]


def test_candidates_hold_the_nearest(spark, monkeypatch):
    """F1 (average_linkage_fragments): each asking cluster's nearest is among its candidates, their mean distances are those of plain loops, and they are few."""
    from strandflow.operators import cluster

    for name, value in (("BLOCK_ROWS", 8), ("TILE_CELLS", 50), ("MOST_TOGETHER", 4)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 4)) * 5
    groups = [centre[i] + rng.normal(size=(int(rng.integers(1, 9)), 4)) * rng.choice([0.1, 2.0]) for i in range(30)]
    weights = [rng.integers(1, 4, len(g)).astype(float) for g in groups]
    points = [(c, float(v), [float(x) for x in p]) for c, (g, w) in enumerate(zip(groups, weights, strict=True)) for p, v in zip(g, w, strict=True)]
    rows = [(c, float(w.sum()), len(g), (g * w[:, None]).sum(axis=0).tolist(), float((w * (g * g).sum(axis=1)).sum()), None if c % 3 else (9.0, c, 99)) for c, (g, w) in enumerate(zip(groups, weights, strict=True))]
    of = spark.createDataFrame(points, "c bigint, w double, x array<double>")
    clusters = spark.createDataFrame(rows, "c bigint, w double, size bigint, s array<double>, q double, near struct<h: double, a: bigint, b: bigint>")
    mean = lambda a, b: float((np.linalg.norm(groups[a][:, None] - groups[b][None], axis=2) * weights[a][:, None] * weights[b][None]).sum() / weights[a].sum() / weights[b].sum())
    found = {(r.a, r.b): r.h for r in cluster.mean_distances(of, clusters, cluster.candidates(clusters, 30), len(points)).collect()}
    assert all(abs(h - mean(a, b)) < 1e-8 and a < b for (a, b), h in found.items())
    for a in range(30):
        if a % 3:
            b = min((x for x in range(30) if x != a), key=lambda x: mean(a, x))
            assert (min(a, b), max(a, b)) in found
    assert len(found) < 30 * 29 / 4
    assert cluster.mean_distances(of, clusters, cluster.candidates(clusters.where("c = 1"), 1), len(points)).count() == 0


def test_first_places_of_no_pairs():
    from strandflow.operators import merge

    none = np.zeros(0, np.int64)
    assert [x.tolist() for x in merge.earliest(none, none, none, none)] == [[], [], [], []]
    found = merge.earliest(np.array([5, 3, 5]), np.array([2, 1, 1]), np.array([0, 4, 7]), np.array([1, 2, 3]))
    assert [x.tolist() for x in found] == [[3, 5], [1, 1], [4, 7], [2, 4]]


def test_agglomeration_of_a_matrix_that_rounding_left_uneven():
    """F1 (average_linkage_fragments): the merges are those of looking at the whole matrix each time, also where d[i, j] and d[j, i] differ in the last place."""
    from strandflow.operators import cluster

    rng = np.random.default_rng(1)
    points = rng.normal(size=(150, 6))
    norms = (points * points).sum(axis=1)
    d = np.sqrt(np.maximum((points @ points.T * -2 + norms[:, None]) + norms[None], 0))
    d = d * (1 + rng.choice([0.0, 2.2e-16], d.shape))
    size, left, want = np.ones(150), d.copy(), []
    np.fill_diagonal(left, np.inf)
    for _ in range(144):
        i, j = sorted(divmod(int(np.argmin(left)), 150))
        want.append((i, j))
        left[i] = left[:, i] = (size[i] * left[i] + size[j] * left[j]) / (size[i] + size[j])
        left[i, i], left[j], left[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
    assert [(i, j) for i, j, _ in cluster.agglomerated(d, np.ones(150), "average", 6)] == want
