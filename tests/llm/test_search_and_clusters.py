"""Ranked search, centroid clustering and decontamination against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import centroids, decontaminate, lexical
from strandflow.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(ASCII_LOWER) for w in WORD.findall(text or "")]


@pytest.mark.parametrize("name", ["op11_term_pipeline_search", "op12_sorted_mean_centroids", "op13_automaton_decontamination"])
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours, theirs = queries()[name](spark, sf_dir).toPandas(), duck.sql(oracle_sql()[name]).df()
    c = sorted(ours.columns)
    assert c == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    a, b = (x[c].sort_values(c).reset_index(drop=True).astype(str) for x in (ours, theirs))
    assert a.equals(b)


def plain_ranks(docs, items, k=20):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    texts = {}
    for i, t in set(items):
        texts.setdefault(i, []).extend(words(t))
    out = {}
    for item, terms in texts.items():
        scored = []
        for doc, c, length in held:
            m = 75 + (25 * length * n) // total
            score = 0
            for t in terms:
                if t in c:
                    df = sum(t in x[1] for x in held)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out[item] = [(None if null else d, -s) for s, null, d in sorted(scored)[:k]]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize("options", [{}, {"block_docs": 7, "bundle_items": 2, "owners": 3, "pass_items": 5}, {"block_docs": 1, "pass_terms": 11, "owners": 9}])
def test_ranks_by_plain_loop(spark, options):
    rng = random.Random(5)
    pool = ["ab", "Cd", "é", "Éa", "x1", "the", "the", "of", "rare", "zu"]
    docs = [(rng.randrange(90), " ".join(rng.choices(pool, k=rng.randrange(0, 30)))) for _ in range(120)]
    docs += [(None, "rare the of"), (None, None), (7, ""), (3, "..."), (500, "the\x00rare_ab-CD " * 4000), (501, "x1"), (501, "x1"), (502, "x1")]
    items = [(i, " ".join(rng.choices([*pool, "unknown"], k=6))) for i in range(14)] + [(3, "ab ab ab"), (3, "ab ab ab"), (None, "x1 zu"), (90, None), (91, "!"), (92, "nowhere")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, SCORE int").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int").repartition(2)
    got = {}
    for r in lexical.ranked(d, q, **options).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    assert got == plain_ranks(docs, items)


def test_ranks_of_nothing(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d, q.withColumn("text", F.lit(None).cast("string"))), (d.withColumn("text", F.lit(" ")), q)):
        assert lexical.ranked(docs, items).collect() == []


def test_ties_beyond_a_block(spark):
    d = spark.createDataFrame([(i, "same words") for i in range(300)], "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame([(1, "words same")], "item_id bigint, text string")
    d = d.union(spark.createDataFrame([(1000, "other")], d.schema))
    assert [r.doc_id for r in lexical.ranked(d, q, block_docs=16).orderBy("rank").collect()] == list(range(20))


def plain_clusters(rows, k, rounds):
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        given = [min((square(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if r < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, g) in zip(kept, given, strict=True) if g == j]
                if own:
                    cents[j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    totals = Counter()
    for dist, j in given:
        totals[j] += dist
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), j, dist, totals[j], sum(totals.values()), digest[j]) for (i, _), (dist, j) in zip(kept, given, strict=True))


@pytest.mark.parametrize("kind", ["spread", "equal", "few", "one sum"])
def test_clusters_by_plain_loop(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 64)) * np.exp(rng.normal(size=(200, 1)))
    if kind == "equal":
        x = x[:3][np.arange(200) % 3]
    elif kind == "few":
        x = x[:6]
    elif kind == "one sum":  # means never tell centroids apart
        x = np.round(x * 8)
        x[:, 63] = -x[:, :63].sum(axis=1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (2, x[2].tolist()), (2, x[1].tolist())]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [math.nan] * 64), (906, [math.inf] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<double>, CLUSTER int").repartition(4)
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clustered(df).collect())
    assert got == plain_clusters(rows, 40, 5)


def test_search_among_centroids():
    rng = np.random.default_rng(1)
    for scale in (3, 200, centroids.LARGEST - 1):
        x, c = rng.integers(-scale, scale + 1, (500, 64)), rng.integers(-scale, scale + 1, (40, 64))
        c[5], c[9] = c[30], x[7]
        who, best = centroids.Centroids(c).nearest(x)
        dist = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (best == dist.min(axis=1)).all() and (who == dist.argmin(axis=1)).all()


def test_cluster_edges(spark):
    big = [1e30] + [0.0] * 63
    df = spark.createDataFrame([(1, big), (2, [0.5] * 64)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in centroids.clustered(df).collect()}
    assert (got[1].cluster, got[1].distance, got[1].centroid_sha256) == (None, None, None) and (got[2].cluster, got[2].inertia) == (0, 0)
    assert centroids.clustered(df.limit(0)).collect() == []
    assert [r.vec_id for r in centroids.clustered(df.where("vec_id = 1")).collect()] == [1]


def plain_hits(docs, items, width=10):
    windows = set()
    for i, t in items:
        w = words(t)
        windows |= {(tuple(w[j : j + width]), i) for j in range(max(1, len(w) - width + 1)) if w}
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for j in range(len(w)):
            for window, i in windows:
                if tuple(w[j : j + len(window)]) == window:
                    hit.update(range(j, j + len(window)))
                    named.add(i)
        out.append((str(d), len(w), len(hit), sorted(str(i) for i in named if i is not None)))
    return sorted(out)


@pytest.mark.parametrize("most_pairs", [200_000, 9])
def test_hits_by_plain_loop(spark, most_pairs):
    rng = random.Random(9)
    pool = ["a", "B", "é", "c3", "d"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", " _ "]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 14))) for i in range(12)] + [(3, text(4)), (20, ""), (21, None), (22, "?!"), (None, "d d d d"), (4, "a B"), (5, "A b")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)] + [(50, items[0][1].upper()), (51, f"xx {items[1][1]} yy"), (52, None), (53, ""), (54, "..."), (None, items[2][1]), (50, items[0][1].upper())]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, N_HIT int, `a b` int").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, items int")
    rows = decontaminate.contaminated(d, q, most_pairs=most_pairs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in rows) == plain_hits(docs, items)
    for r in rows:
        assert r["a b"] == 2 and sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
        for s in r.spans:  # whole words of the original
            assert WORD.match(r.text[s.start]) and WORD.match(r.text[s.end - 1])
            assert all(not 0 <= k < len(r.text) or not WORD.match(r.text[k]) for k in (s.start - 1, s.end))


def test_hit_edges(spark):
    d = spark.createDataFrame([(1, "one two three " * 20000)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "two three one")], "item_id bigint, text string")
    r = decontaminate.contaminated(d, q, keep_text=False).collect()[0]
    assert (r.n_words, r.n_hit, len(r.spans)) == (60000, 59997, 1) and "text" not in r.asDict()
    assert decontaminate.contaminated(d, q.limit(0)).select("n_hit").collect() == [(0,)]
    assert decontaminate.contaminated(d.limit(0), q).collect() == []
