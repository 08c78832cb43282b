"""Tails against closed forms, rank tests with tails, and the panel of phenotype and structure."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions import tails
from strandflow.operators import cohort, evaluate, fusion


def student(t: float, n: int) -> float:
    """The finite sums of Student's distribution for whole degrees of freedom."""
    a = math.atan2(abs(t), math.sqrt(n))
    c, s = math.cos(a), math.sin(a)
    if n == 1:
        return 1 - 2 * a / math.pi
    if n % 2:
        term, out = c, c
        for k in range(3, n - 1, 2):
            term *= c * c * (k - 1) / k
            out += term
        return 1 - 2 / math.pi * (a + s * out)
    term = out = 1.0
    for k in range(2, n - 1, 2):
        term *= c * c * (k - 1) / k
        out += term
    return 1 - s * out


def test_normal_tail(spark):
    zs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.96, 2.1, 2.2, 3.0, 5.0, 8.0, 20.0, 37.0]
    df = spark.createDataFrame([(z * sign,) for z in zs for sign in (1, -1)], "z double")
    for r in df.select("z", tails.normal_two_sided(F.col("z")).alias("p"), tails.normal_greater(F.col("z")).alias("g")).collect():
        assert math.isclose(r.p, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=1e-12)
        assert math.isclose(r.g, math.erfc(r.z / math.sqrt(2)) / 2, rel_tol=1e-12)
    odd = spark.createDataFrame([(None,), (float("inf"),)], "z double").select(tails.normal_two_sided(F.col("z")).alias("p")).collect()
    assert odd[0].p is None and odd[1].p == 0


def test_student_tail(spark):
    rows = [(t, n) for t in (0.0, 0.01, 0.7, -1.5, 3.0, 12.0, 60.0) for n in (1, 2, 3, 4, 7, 10, 31, 200, 5001)]
    for r in spark.createDataFrame(rows, "t double, n int").select("t", "n", tails.student_two_sided(F.col("t"), F.col("n")).alias("p")).collect():
        assert abs(r.p - student(r.t, r.n)) < 1e-10, r
    wide = spark.createDataFrame([(1.3, 10**9), (1.3, 0), (float("inf"), 5)], "t double, n int").select(tails.student_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    assert abs(wide[0].p - math.erfc(1.3 / math.sqrt(2))) < 1e-6 and wide[1].p is None and wide[2].p == 0
    t = spark.createDataFrame([(1.0, 5), (0.5, 5), (0.5, 2), (None, 9)], "r double, n bigint")
    out = evaluate.with_tail(t, "r").collect()
    assert out[0].p == 0 and math.isclose(out[1].t, 0.5 * math.sqrt(3 / 0.75)) and out[2].p is None and out[3].p is None


def test_rank_test_tails(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(9) + (i % 3 == 0), i % 3 == 0) for k in ("x", "y") for i in range(40)] + [("one class", 1, True), ("equal", 1, True), ("equal", 1, False)]
    out = {r.k: r for r in evaluate.rank_test(spark.createDataFrame(rows, "k string, v int, f boolean"), ["k"], "v", "f", tails=True).collect()}
    for k in ("x", "y"):
        a, b = ([v for q, v, f in rows if q == k and f is w] for w in (True, False))
        u = sum((x > y) + (x == y) / 2 for x in a for y in b)
        both, n = a + b, len(a) + len(b)
        spread = math.sqrt(len(a) * len(b) / 12 * (n + 1 - sum(both.count(v) ** 3 - both.count(v) for v in set(both)) / (n * (n - 1))))
        away = u - len(a) * len(b) / 2
        assert out[k].u == u and math.isclose(out[k].p, math.erfc(max(abs(away) - 0.5, 0) / spread / math.sqrt(2)))
        assert math.isclose(out[k].p_greater, math.erfc((away - 0.5) / spread / math.sqrt(2)) / 2)
    assert out["one class"].p is None and out["equal"].p is None and out["equal"].p_greater is None


def test_panel(spark, monkeypatch):
    rng = random.Random(6)
    host = "".join(rng.choice("ACGT") for _ in range(4000))
    strange = "".join(rng.choice("AT") for _ in range(300))
    genes = [("native", "g", host[:300]), ("causal", "g", host[1000:1300]), ("acquired", "g", strange), ("dual", "g", strange[::-1]), ("short", "g", "ACGT"), ("null", "g", None), ("lost", "h", host[:300])]
    marked = [host[1000:1300], strange[::-1]]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    number = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
    strong = spark.createDataFrame(sorted({(number(s[i : i + 21]),) for m in marked for s in (m, flip(m)) for i in range(len(m) - 20)}), "kmer bigint")
    profiles = fusion.triplet_profile(spark.createDataFrame([("g", host[:1500]), ("g", host[1500:]), ("bare", "A"), (None, "ACGTA")], "genome string, seq string"))
    assert {r.genome: sum(r.profile) for r in profiles.collect()} == {"g": 3996, None: 3}
    df = spark.createDataFrame(genes, "gene_id string, genome string, seq string").withColumn("n", F.lit("clash"))
    for most in (10, 0):
        monkeypatch.setattr(fusion, "BROADCAST_GENOMES", most)
        out = {r.gene_id: r for r in fusion.panel(df, profiles, strong, 21).collect()}
        assert {k: r.evidence for k, r in out.items()} == {"native": "NONE", "causal": "PHENOTYPE", "acquired": "STRUCTURE", "dual": "DUAL", "lost": "NONE"}
        assert out["lost"].structural is None and out["dual"].phenotype == pytest.approx(1.0)
        triplets = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
        p, q = ([sum(s.startswith(g, i) for i in range(len(s) - 2)) for g in triplets] for s in (strange, host))
        q = [x - sum(host[1498:1502].startswith(g, i) for i in range(2)) for x, g in zip(q, triplets, strict=True)]
        p, q = ([x / sum(v) for x in v] for v in (p, q))
        plain = sum(x * math.log2(2 * x / (x + y)) if x else 0 for v, w in ((p, q), (q, p)) for x, y in zip(v, w, strict=True)) / 2
        assert math.isclose(out["acquired"].structural, math.sqrt(plain), rel_tol=1e-9)
    assert fusion.panel(df.limit(0), profiles, strong, 21).count() == 0


def test_both_strands_of_a_kmer_count_alike(spark, monkeypatch):
    rng = random.Random(9)
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    number = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
    texts = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(5)]
    rows = [(g, "RS"[g % 2], texts[(g + i) % 5] + "N" + texts[g % 3][:20]) for g in range(6) for i in range(1 + (g == 2))] + [(8, "R", None), (9, "S", "")]
    for several in (True, False):
        some = rows if several else [r for i, r in enumerate(rows) if r[0] not in {q[0] for q in rows[:i]}]
        df = spark.createDataFrame(some, "genome_id bigint, label string, seq string").withColumn("kmer", F.lit("clash"))
        for k in (4, 31, 5):
            held: dict[int, set] = {}
            for g, _, s in some:
                for part in (s or "").split("N"):
                    for w in (part, flip(part)):
                        for i in range(len(w) - k + 1):
                            held.setdefault(number(w[i : i + k]), set()).add(g)
            label = {g: c for g, c, _ in some}
            plain = {x: tuple(sum(label[g] == c for g in gs) for c in "RS") for x, gs in held.items()}
            assert {r.kmer: (r.cnt_r, r.cnt_s) for r in cohort.association(df, k, informative=False).collect()} == plain
            every = cohort.association(df, k, informative=False)
            wanted = every.where("cnt_r > cnt_s")
            for most in (10**6, 0):
                monkeypatch.setattr(cohort, "BROADCAST_KMERS", most)
                out = {r.gene_id: (r.n_kmers, r.n_wanted) for r in cohort.gene_carriage(df.withColumnRenamed("genome_id", "gene_id"), wanted, k).collect()}
                strong = {x for x, (r, s) in plain.items() if r > s}
                mine = {g: {x for x, gs in held.items() if g in gs} for g in label}
                assert out == {g: (len(v), len(v & strong)) for g, v in mine.items() if v}
    assert cohort.association(df.limit(0), 5).count() == 0


def test_regime_fusion(spark):
    rng = random.Random(12)
    genes, regimes = [], []
    for c in range(9):
        lively = rng.random()
        regimes.append((f"c{c}", round(lively, 3), rng.choice([1.0, 2.0])))
        for i in range(20 if c else 1):
            pos = i % 4 == 0
            genes.append((f"c{c}", c * 100 + i, pos, rng.randrange(6) + pos * lively * 4, rng.randrange(6) + pos * (1 - lively) * 4))
    genes += [("late", 2000 + i, i == 1, float(i), 1.0) for i in range(3)]  # a contig without a regime; c0 has one class alone
    df = spark.createDataFrame(genes, "contig_id string, gene_id int, is_pos boolean, own double, other double").withColumn("channel", F.lit("clash")).repartition(4)
    table = spark.createDataFrame(regimes, "contig_id string, lively double, idle double")
    out = {r.contig_id: r for r in fusion.regime_fusion(df, table, ["idle", "lively"]).collect()}

    def area(rows):
        pos, neg = ([v for p, v in rows if p is w] for w in (True, False))
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))

    def ranks(values):
        return [sum(y < x for y in values) + (values.count(x) + 1) / 2 for x in values]

    def corr(a, b):
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        s = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
        return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / s if s else 0

    of = {c: [g for g in genes if g[0] == c] for c in dict.fromkeys(g[0] for g in genes)}
    of.pop("c0")
    names = sorted(of)
    assert sorted(out) == names
    own, other = ({c: area([(g[2], round(g[i], 9)) for g in of[c]]) for c in names} for i in (3, 4))
    value = {f: {c: next((r[1 + j] for r in regimes if r[0] == c), 0.0) for c in names} for j, f in enumerate(("lively", "idle"))}
    won = [round(own[c] - other[c], 9) for c in names]
    told = {f: corr(ranks([value[f][c] for c in names]), ranks(won)) for f in ("idle", "lively")}
    feature = max(("idle", "lively"), key=lambda f: abs(round(told[f], 9)))
    high, x = told[feature] >= 0, value[feature]
    cuts = sorted(set(x.values()))
    spread = lambda cut: (lambda a, b: len(a) * len(b) / len(names) ** 2 * (sum(a) / len(a) - sum(b) / len(b)) ** 2)([v for v in x.values() if v <= cut], [v for v in x.values() if v > cut])
    at = max(range(len(cuts) - 1), key=lambda i: round(spread(cuts[i]), 9))
    cut = (cuts[at] + cuts[at + 1]) / 2
    order = sorted(names, key=lambda c: (x[c], c))
    for c in names:
        place = {i: {g[1]: j / (len(of[c]) - 1) for j, g in enumerate(sorted(of[c], key=lambda g: (round(g[i], 9), g[1])))} for i in (3, 4)}
        w = order.index(c) / (len(names) - 1)
        w = 1 - w if high else w
        r = out[c]
        assert (r.feature, r.heterogeneity) == (feature, x[c])
        assert math.isclose(r.own, own[c]) and math.isclose(r.other, other[c]) and r.best == max(r.own, r.other)
        assert math.isclose(r.mean, area([(g[2], round((place[3][g[1]] + place[4][g[1]]) / 2, 9)) for g in of[c]]))
        assert math.isclose(r.soft, area([(g[2], round((1 - w) * place[3][g[1]] + w * place[4][g[1]], 9)) for g in of[c]]))
        assert r.selected == (r.own if (x[c] >= cut) == high else r.other)
    assert fusion.regime_fusion(df.limit(0), table, ["idle", "lively"]).count() == 0
