"""Clustering of sequences by their signal vectors."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import sequence as S
from strandflow.operators.measures import measured
from strandflow.operators.pieces import windows
from strandflow.plans.session import settled, stored

#: Names of the 22 features, in order.
FEATURES = ("gc", "h3", "h4", "hurst", "mi1", "ac3", *[f"rho_{i:02d}" for i in range(16)])


def features(segments: DataFrame) -> DataFrame:
    """segments (.., seq) with features, the 22 values of FEATURES. Work of a row alone."""
    n = F.length("seq")
    plain = [
        F.coalesce(S.gc_content(F.col("seq")), F.lit(0.0)),
        F.when(n < 3, 0.0).otherwise(S.entropy(F.col("k3")) / 6),
        F.when(n < 4, 0.0).otherwise(S.entropy(F.col("k4")) / 8),
        F.col("hurst"),
        F.when(n <= 2, 0.0).otherwise(S.information(F.col("k1"), F.col("k2"))),
        S.period3_share(F.col("autocorrelation")),
    ]
    vector = F.concat(F.array(*plain), S.rho_from_counts(F.col("k1"), F.col("k2")))
    return measured(segments).select(*segments.columns, vector.alias("features"))


def contig_features(pieces: DataFrame, tile: int = 1_000_000) -> DataFrame:
    """contig_id, features of whole contigs of any length (contig_id, ordinal, start, seq).

    k-mers are counted over tiles and across their borders, and summed, so these features are those of the whole
    contig. Hurst exponents and the shares of period 3 don't add up: a contig's is the mean of its tiles', weighed by their letters.
    """
    tiles = windows(pieces, tile, tile, extra=3, tail=True)
    own = F.least(F.length("seq"), F.lit(tile))
    # the tile itself; for each k the letters around its end that only k-mers across the end lie in
    border = lambda k: F.when(own == tile, F.substring(F.col("seq"), F.lit(tile - k + 2), F.lit(2 * (k - 1)))).otherwise("")
    parts = F.array(F.struct(F.lit(1).alias("kind"), F.substring("seq", 1, tile).alias("part")), *[F.struct(F.lit(k).alias("kind"), border(k).alias("part")) for k in (2, 3, 4)])
    m = measured(tiles.select("contig_id", own.cast("bigint").alias("own"), F.inline(parts)).select("contig_id", "own", "kind", F.col("part").alias("seq")), wanted=("k1", "k2", "k3", "k4", "hurst", "autocorrelation"))
    whole = F.col("kind") == 1
    weighed = lambda c: F.sum(F.when(whole, c * F.col("own"))) / F.sum(F.when(whole, F.col("own")))
    summed = lambda k: F.array(*[F.coalesce(F.sum(F.when(whole | (F.col("kind") == k), F.get(f"k{k}", F.lit(i)))), F.lit(0)) for i in range(4**k)])
    rows = m.groupBy("contig_id").agg(F.sum(F.when(whole, F.col("own"))).alias("n"), weighed(F.col("hurst")).alias("hurst"), weighed(S.period3_share(F.col("autocorrelation"))).alias("ac3"), *[summed(k).alias(f"k{k}") for k in (1, 2, 3, 4)])
    n = F.col("n")
    plain = [
        (F.get("k1", F.lit(1)) + F.get("k1", F.lit(2))) / n,
        F.when(n < 3, 0.0).otherwise(S.entropy(F.col("k3")) / 6),
        F.when(n < 4, 0.0).otherwise(S.entropy(F.col("k4")) / 8),
        F.col("hurst"),
        F.when(n <= 2, 0.0).otherwise(S.information(F.col("k1"), F.col("k2"))),
        F.col("ac3"),
    ]
    return rows.select("contig_id", F.concat(F.array(*plain), S.rho_from_counts(F.col("k1"), F.col("k2"))).alias("features"))


def standardised(rows: DataFrame, size: int = len(FEATURES), column: str = "features") -> DataFrame:
    """rows with the vectors as z-scores by population deviations; a constant feature stays at 0."""
    rows = settled(rows)  # read twice
    stats = rows.agg(*[f(F.get(column, F.lit(i))).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [(F.get(column, F.lit(i)) - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i in range(size)]
    return rows.crossJoin(F.broadcast(stats)).withColumn("z", F.array(*z)).drop(*stats.columns)


def automatic_k(n: int) -> int:
    """sqrt(n / 10), from 2 to 10; 2 for fewer than 4."""
    return 2 if n < 4 else max(2, min(10, int((n / 10) ** 0.5)))


def agglomerated(d: np.ndarray, weights: np.ndarray, method: str, k: int = 1) -> list[tuple[int, int, float]]:
    """Merges (i, j, height; i < j, i stays) down to k clusters by Lance-Williams updates of the clusters' distances, in d itself."""
    n = len(d)
    d, size = d.astype(np.float64, copy=False), weights.astype(np.float64)
    np.fill_diagonal(d, np.inf)
    out, low, near = [], d.min(axis=1, initial=np.inf), d.argmin(axis=1) if n else []  # the least of each row and its place, taken anew where it was of a merged one
    for _ in range(n - max(1, min(k, n))):
        i = int(np.argmin(low))
        i, j = sorted((i, int(np.argmin(d[i]))))
        a, b, dij = size[i], size[j], d[i, j]
        out.append((i, j, float(dij)))
        if method == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * dij) / (a + b + size)
        else:
            new = (a * d[i] + b * d[j]) / (a + b)
        gone = np.isinf(d[i]) & (np.arange(n) != i)
        stale = ((near == i) | (near == j)) & ~gone
        d[i] = d[:, i] = np.where(gone, np.inf, new)
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        stale[[i, j]] = True
        near = np.where(d[i] < low, i, near)
        low = np.minimum(low, d[i])
        low[stale], near[stale] = d[stale].min(axis=1), d[stale].argmin(axis=1)
        size[i] = a + b
    return out


def linkage_labels(points: np.ndarray, weights: np.ndarray, k: int, method: str) -> np.ndarray:
    """Labels 0.. in order of first members, of the k clusters of agglomeration. method: ward or average; a point counts weights rows."""
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    w = weights.astype(np.float64)
    d = d * 2 * w[:, None] * w[None] / (w[:, None] + w[None]) if method == "ward" else np.sqrt(d)
    label = np.arange(len(points))
    for i, j, _ in agglomerated(d, weights, method, k):
        label[label == j] = i
    first = {x: r for r, x in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([first[x] for x in label.tolist()])


#: Rows of a block at most in the mean, and cells of a tile of distances.
BLOCK_ROWS, TILE_CELLS = 1 << 14, 1 << 21
#: Rows of a cluster that go to one block; those of a larger one are dealt over all.
MOST_TOGETHER = 1 << 13


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By norms and products; those so near that little of the norms would be left, by differences."""
    norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    d = norms - 2 * (x @ y.T)
    i, j = np.nonzero(d < norms * 1e-3)
    for k in range(0, len(i), 1 << 16):
        some = slice(k, k + (1 << 16))
        d[i[some], j[some]] = ((x[i[some]] - y[j[some]]) ** 2).sum(axis=1)
    return d


def closest(members: DataFrame, n: int, method: str, every: bool = False) -> DataFrame:
    """a, b, h (a < b): linkage distances of clusters, among them the least of each one, or (every) all.

    members: c, w, x, total (the cluster's weight) and size (its rows); for ward a cluster is one row, its centre. n: their number. Rows meet by pairs of
    blocks, and a task takes distances tile by tile, so no table of pairs is made. Sums of a cluster that is dealt over blocks leave tasks in parts.
    """
    blocks, most, cells = max(1, min(8, n // 512), -(-n // BLOCK_ROWS)), MOST_TOGETHER, TILE_CELLS
    block = F.when(F.col("size") > most, F.xxhash64("c", "x")).otherwise(F.xxhash64("c"))
    dealt = members.withColumn("block", F.pmod(block, F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("c", "w", "x", "total", "size", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def compared(group: pa.Table) -> pa.Table:
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        c, w, total, size, at = (group.column(k).to_numpy() for k in ("c", "w", "total", "size", "block"))
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        x = x - x.mean(axis=0)
        order = np.argsort(c, kind="stable")
        rows, columns = order[at[order] == p], order[at[order] == q]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(rows) or not len(columns):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "h": pa.array([], pa.float64())})
        firsts = np.flatnonzero(np.r_[True, np.diff(c[columns]) != 0])
        of = columns[firsts]  # a row of each cluster of the columns
        least, held, carry = np.full(len(of), np.inf), [], None

        def kept(mine: np.ndarray, i: np.ndarray, j: np.ndarray, h: np.ndarray) -> None:
            a, b = c[mine[i]], c[of[j]]
            if method == "ward" and len(i):
                u, v = w[mine[i]], w[of[j]]
                h = ((x[mine[i]] - x[of[j]]) ** 2).sum(axis=1) * 2 * u * v / (u + v)
            out.append((np.minimum(a, b), np.maximum(a, b), h))

        step = max(1, cells // len(columns))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            starts = np.flatnonzero(np.r_[True, np.diff(c[part]) != 0])
            mine = part[starts]
            h = squared_distances(x[part], x[columns])
            if method == "ward":
                u, v = w[part][:, None], w[columns][None]
                slack = 2e-9 + 1e-12 * float((x * x).sum(axis=1).max() * w.max())
                h *= 2 * u * v / (u + v)
            else:
                slack = 2e-9
                h = np.sqrt(h) * w[columns][None]
                h = (np.add.reduceat(h, firsts, axis=1) if len(of) < len(columns) else h) * w[part][:, None]
                h = np.add.reduceat(h, starts, axis=0) if len(starts) < len(part) else h
                if carry is not None:
                    h[0] += carry
                carry = None
                if k + step < len(rows) and c[rows[k + step]] == c[part[-1]]:  # the next tile goes on with this cluster
                    carry, h, mine = h[-1].copy(), h[:-1], mine[:-1]
                h /= total[mine][:, None] * total[of][None]
            h[c[mine][:, None] >= c[of][None] if p == q else c[mine][:, None] == c[of][None]] = np.inf
            if not len(mine):
                continue
            dealt_over = (size[mine] > most)[:, None] | (size[of] > most)[None]
            if every or dealt_over.any():
                i, j = np.nonzero(np.isfinite(h) & (dealt_over | every))
                kept(mine, i, j, h[i, j])
                h[i, j] = np.inf
            i, j = np.nonzero((h <= h.min(axis=1)[:, None] + slack) & np.isfinite(h))
            kept(mine, i, j, h[i, j])
            low = h.min(axis=0)
            least = np.minimum(least, low)
            some = np.flatnonzero(np.isfinite(low) & (low <= least + slack))
            i, j = np.nonzero(h[:, some] <= least[some][None] + slack)
            held.append((mine[i], some[j], h[i, some[j]], slack))
        for i, j, h, slack in held:
            some = h <= least[j] + slack
            kept(i[some], np.arange(int(some.sum())), j[some], h[some])
        a, b, h = (np.concatenate(o) for o in zip(*out, strict=True))
        one = np.unique(np.stack([a, b]), axis=1, return_index=True)[1] if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a[one], pa.int64()), "b": pa.array(b[one], pa.int64()), "h": pa.array(h[one], pa.float64())})

    found = dealt.groupBy("p", "q").applyInArrow(compared, "a bigint, b bigint, h double")
    if method != "ward":  # whole ones are alone, parts are summed
        found = found.groupBy("a", "b").agg(F.sum("h").alias("h"))
    return found.select("a", "b", F.round("h", 9).alias("h"))


def in_rows(pairs: DataFrame) -> DataFrame:
    """a, b, h of pairs (a, b, h) with all b and h of an a as the bytes of arrays."""

    def packed(group: pa.Table) -> pa.Table:
        b, h = (group.column(k).to_numpy().tobytes() for k in "bh")
        return pa.table({"a": group.column("a")[:1], "b": pa.array([b], pa.binary()), "h": pa.array([h], pa.binary())})

    return pairs.groupBy("a").applyInArrow(packed, "a bigint, b binary, h binary")


def as_members(state: DataFrame, method: str) -> DataFrame:
    """The rows that closest compares: of ward (c, w, s: summed vectors) a centre a cluster, of average linkage (c, w, x) all points."""
    if method == "ward":
        return state.select("c", "w", F.transform("s", lambda v: v / F.col("w")).alias("x"), F.col("w").alias("total"), F.lit(1).cast("bigint").alias("size"))
    totals = state.groupBy("c").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("size"))
    return state.join(totals, "c").select("c", "w", "x", "total", "size")


def merged_round(state: DataFrame, rows: int, width: int, method: str) -> tuple[DataFrame, DataFrame]:
    """The merges (a, b, h) of all pairs that are each other's nearest, ties by a and b, and the state after them."""
    near = closest(as_members(state, method), rows, method)
    best = near.select(F.struct("h", "a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min("pair").alias("pair"))
    merges = stored(best.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair.a", "pair.b", "pair.h"))
    moved = state.join(merges.select(F.col("b").alias("c"), "a"), "c", "left").withColumn("c", F.coalesce("a", "c")).drop("a")
    if method == "ward":
        moved = moved.groupBy("c").agg(F.sum("w").alias("w"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))
    return merges, stored(moved)


def candidates(clusters: DataFrame, m: int) -> DataFrame:
    """big, small, n (rows of big), scale (product of their weights): pairs, among them each asking cluster (near is null) with its nearest by average linkage.

    clusters: c, w, size (rows), s (summed vectors), q (summed squares), near. m: their number. A mean distance is at least that of the centres, as a norm is convex, and at
    most the root of the mean square, that of the centres and both spreads. So the nearest is among those whose centres are no farther than the least
    such root, a few. Single precision finds them, with room for its errors; double precision bounds what is left.
    """
    blocks, cells = max(1, min(8, m // 4096), -(-m // (2 * BLOCK_ROWS))), TILE_CELLS
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)
    flat = clusters.withColumn("x", F.transform("s", lambda v: v / F.col("w")))
    spread = F.greatest(F.col("q") / F.col("w") - square(F.col("x")), F.lit(0.0)) + F.col("q") / F.col("w") * 1e-11
    flat = flat.select("c", "w", "size", "x", F.when(F.col("size") > 1, spread).otherwise(0.0).alias("spread"), F.col("near").isNull().alias("asks"), F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("block"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = flat.where("asks").withColumn("q", each).withColumnRenamed("block", "p")
    dealt = asking.unionByName(flat.withColumn("asks", F.lit(False)).withColumn("p", each).withColumnRenamed("block", "q"))

    def compared(group: pa.Table) -> pa.Table:
        group = group.sort_by("c").combine_chunks()
        c, w, size, spread, asks = (group.column(k).to_numpy() for k in ("c", "w", "size", "spread", "asks"))
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        x = x - x.mean(axis=0)
        norm, room = (x * x).sum(axis=1), 1e-5
        rows, columns = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        if len(rows) and len(columns):
            one, least = np.ones((len(c), 1)), (norm * (1 - room))[:, None]
            left, right = np.hstack([-2 * x[rows], least[rows], one[rows]]).astype(np.float32), np.hstack([x, one, least])[columns].astype(np.float32).T
            wide = (spread + 2 * room * norm).astype(np.float32)
            own = np.minimum(np.searchsorted(c[columns], c[rows]), len(columns) - 1)
            itself = c[columns][own] == c[rows]
            step = max(1, cells // len(columns))
            for k in range(0, len(rows), step):
                part, low = rows[k : k + step], left[k : k + step] @ right
                mine = np.flatnonzero(itself[k : k + step])
                low[mine, own[k : k + step][mine]] = np.inf
                most = ((low + wide[columns]).min(axis=1) + wide[part]) * np.float32(1 + 1e-6)
                i, j = np.divmod(np.flatnonzero(low <= most[:, None]), len(columns))
                i, j = part[i], columns[j]
                i, j = i[c[i] != c[j]], j[c[i] != c[j]]
                if not len(i):
                    continue
                squared = np.concatenate([((x[i[z : z + 65536]] - x[j[z : z + 65536]]) ** 2).sum(axis=1) for z in range(0, len(i), 65536)])
                l, u = np.sqrt(squared), np.sqrt(squared + spread[i] + spread[j])
                starts = np.flatnonzero(np.r_[True, np.diff(i) != 0])
                some = l <= np.repeat(np.minimum.reduceat(u, starts), np.diff(np.r_[starts, len(i)])) + 2e-9
                out.append((i[some], j[some], l[some], u[some]))
        i, j, l, u = (np.concatenate(o) for o in zip(*out, strict=True))
        first = (size[i] > size[j]) | ((size[i] == size[j]) & (c[i] < c[j]))
        big, small = np.where(first, i, j), np.where(first, j, i)
        return pa.table({"c": c[i], "l": l, "u": u, "big": c[big], "small": c[small], "n": size[big], "scale": w[i] * w[j]})

    found = dealt.groupBy("p", "q").applyInArrow(compared, "c bigint, l double, u double, big bigint, small bigint, n bigint, scale double")
    found = found.withColumn("_u", F.min("u").over(Window.partitionBy("c"))).where(F.col("l") <= F.col("_u") + 2e-9)
    return found.repartition("small").groupBy("big", "small").agg(F.first("n").alias("n"), F.first("scale").alias("scale"))  # by small, as the join with its points


def mean_distances(points: DataFrame, clusters: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """a, b, h (a < b): the mean distances of pairs of clusters as of candidates, from all their points (c, w, x).

    The points of the smaller cluster go to those of the larger one; of this there are several parts if it has more than MOST_TOGETHER rows. n: the number of points.
    """
    buckets, most, cells = max(1, min(32, n // 512), -(-n // BLOCK_ROWS)), MOST_TOGETHER, TILE_CELLS
    parts = lambda size: F.ceil(size / most).cast("int")
    large = clusters.where(F.col("size") > most).select(F.col("c").alias("big"), parts(F.col("size")).alias("parts"))  # n / most at most
    part = F.coalesce(F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"), F.lit(0))
    mine = points.select(F.col("c").alias("big"), F.col("w").alias("w"), F.col("x").alias("x")).join(F.broadcast(large), "big", "left").select("big", part.alias("part"), "w", "x")
    theirs = pairs.select("big", "small", "scale", F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)).alias("part")).join(points.select(F.col("c").alias("small"), F.col("w").alias("v"), F.col("x").alias("y")), "small").select("big", "part", "small", "scale", "v", "y")
    bucket = F.pmod(F.xxhash64("big", "part"), F.lit(buckets)).cast("int").alias("bucket")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by([("big", "ascending"), ("part", "ascending")]).combine_chunks(), right.sort_by([("big", "ascending"), ("part", "ascending"), ("small", "ascending")]).combine_chunks()
        width = 0
        if left.num_rows and right.num_rows:
            width = len(left.column("x")[0])
        x, y = (t.column(k).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if width else np.zeros((0, 1)) for t, k in ((left, "x"), (right, "y")))
        big, part, w = (left.column(k).to_numpy() for k in ("big", "part", "w"))
        of, at, small, scale, v = (right.column(k).to_numpy() for k in ("big", "part", "small", "scale", "v"))
        new = np.flatnonzero(np.r_[True, (np.diff(big) != 0) | (np.diff(part) != 0)]) if len(big) else np.zeros(0, np.int64)
        ends = [*new[1:].tolist(), len(big)]
        place = {key: z for z, key in enumerate(zip(big[new].tolist(), part[new].tolist(), strict=True))}
        runs = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(at) != 0)]) if len(of) else np.zeros(0, np.int64)
        total = np.zeros(len(of))
        for b, e in zip(runs.tolist(), [*runs[1:].tolist(), len(of)], strict=False):  # none of an empty bucket
            z = place.get((int(of[b]), int(at[b])))
            if z is None:  # a part without points
                continue
            xs, ws = x[new[z] : ends[z]], w[new[z] : ends[z]]
            centre = xs.mean(axis=0)
            step = max(1, cells // len(xs))
            for k in range(b, e, step):
                to = min(e, k + step)
                total[k:to] = np.sqrt(squared_distances(y[k:to] - centre, xs - centre)) @ ws
        total *= v
        each = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(at) != 0) | (np.diff(small) != 0)]) if len(of) else np.zeros(0, np.int64)
        h = np.add.reduceat(total, each) / scale[each] if len(each) else np.zeros(0)
        return pa.table({"a": np.minimum(of[each], small[each]), "b": np.maximum(of[each], small[each]), "h": h})

    found = mine.withColumn("bucket", bucket).groupBy("bucket").cogroup(theirs.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(summed, "a bigint, b bigint, h double")
    return found.groupBy("a", "b").agg(F.round(F.sum("h"), 9).alias("h"))


def average_round(points: DataFrame, clusters: DataFrame, n: int, m: int, width: int) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    """As merged_round, by average linkage: the merges, their number, and the points and clusters after them. A cluster keeps its nearest (near) until one of both is
    merged: a merged cluster is no nearer than the nearer one of its two. So only the others look anew."""
    found = mean_distances(points, clusters, candidates(clusters, m), n)
    near = found.select(F.struct("h", "a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("c")).unionByName(clusters.where("near is not null").select(F.col("near").alias("pair"), "c"))
    best = stored(near.groupBy("c").agg(F.min("pair").alias("pair")))
    merges = stored(best.groupBy("pair.a", "pair.b").agg(F.count(F.lit(1)).alias("n"), F.min("pair.h").alias("h")).where("n = 2").select("a", "b", "h"))
    into = merges.select(F.col("b").alias("c"), F.col("a").alias("_to"))
    touched = merges.select(F.explode(F.array("a", "b")).alias("_other"), F.lit(True).alias("_gone"))
    other = F.when(F.col("pair.a") == F.col("c"), F.col("pair.b")).otherwise(F.col("pair.a")).alias("_other")
    kept = best.select("c", "pair", other).join(touched, "_other", "left").select("c", F.when(F.col("_gone").isNull(), F.col("pair")).alias("near"))
    moved = clusters.drop("near").join(kept, "c").join(into, "c", "left").withColumn("c", F.coalesce("_to", "c"))
    total = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s")
    moved = moved.groupBy("c").agg(F.sum("w").alias("w"), F.sum("size").alias("size"), total, F.sum("q").alias("q"), F.max("near").alias("near"))
    placed = points.join(into, "c", "left").select(F.coalesce("_to", "c").alias("c"), "w", "x")
    with ThreadPoolExecutor(3) as pool:  # three short jobs at a time
        after, others, merged = pool.submit(stored, placed), pool.submit(stored, moved), pool.submit(merges.count)
        return merges, merged.result(), after.result(), others.result()


def hierarchical(rows: DataFrame, k: int, method: str = "ward", most: int = 512, column: str = "z", label: str = "cluster") -> DataFrame:
    """rows with the cluster of a hierarchical clustering, labels in the order of the clusters' least vectors.

    The tree is that of exact linkage at any size. Distinct vectors are points weighed by their rows. While there are more than `most`
    clusters, a round merges all pairs that are each other's nearest (for ward and average linkage these are merges of the greedy tree
    too); the last `most` (by average linkage up to eight times as many, half of the points) are merged by the driver. Then the k - 1 highest merges are undone.
    Exact linkage looks at pairs of centres in every round, average linkage at those of the few nearest clusters' points too and once at all: distances are
    taken in tiles and none is kept, so memory and shuffles don't grow with their square.
    """
    rows = settled(rows)  # vectors are join keys below, so they must not be computed again
    distinct = rows.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    found = distinct.limit(most + 1).collect()
    spark = rows.sparkSession
    if len(found) <= most:
        found = sorted(found, key=lambda r: r[column])
        if not found:
            return rows.withColumn(label, F.lit(0))
        labels = linkage_labels(np.array([r[column] for r in found]), np.array([r["_w"] for r in found]), k, method)
        map_rows = spark.createDataFrame([(r[column], int(x)) for r, x in zip(found, labels, strict=True)], f"{column} array<double>, {label} int")
        return rows.join(F.broadcast(map_rows), column)  # at most `most` rows
    points = stored(distinct.orderBy(column).withColumn("_id", F.monotonically_increasing_id()))
    n = left_over = points.count()
    width = len(found[0][column])
    vector = F.transform(column, lambda v: v * F.col("_w")).alias("s") if method == "ward" else F.col(column).alias("x")
    state = stored(points.select(F.col("_id").alias("c"), F.col("_w").alias("w"), vector))
    last_ones = most if method == "ward" else max(most, min(8 * most, n // 2))
    if method != "ward":
        square = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)
        clusters = state.select("c", "w", F.lit(1).cast("bigint").alias("size"), F.transform("x", lambda v: v * F.col("w")).alias("s"), (F.col("w") * square).alias("q"), F.lit(None).cast("struct<h: double, a: bigint, b: bigint>").alias("near"))
    merges, level = [], 0
    while left_over > last_ones:
        if method == "ward":
            done, state = merged_round(state, left_over, width, method)
            merged = done.count()
        else:
            done, merged, state, clusters = average_round(state, clusters, n, left_over, width)
        merges.append(done.withColumn("level", F.lit(level)))
        if not merged:  # distances of two rounds that differ in the last place can keep a tie from being mutual; taken at once they can't
            clusters = clusters.withColumn("near", F.lit(None).cast("struct<h: double, a: bigint, b: bigint>"))
        left_over -= merged
        level += 1
    left = state.groupBy("c").agg(F.sum("w").alias("w")).orderBy("c").collect()  # `last_ones` clusters
    ids = np.array([r.c for r in left], np.int64)
    d = np.full((len(left), len(left)), np.inf)
    pairs = closest(as_members(state, method), left_over if method == "ward" else n, method, every=True)  # pairs of `last_ones` clusters
    for r in in_rows(pairs).toLocalIterator():
        i, j = (np.searchsorted(ids, x) for x in (r.a, np.frombuffer(r.b, np.int64)))
        d[i, j] = d[j, i] = np.frombuffer(r.h, np.float64)
    last = [(left[i].c, left[j].c, h, level + x) for x, (i, j, h) in enumerate(agglomerated(d, np.array([r.w for r in left]), method))]
    tree = reduce(DataFrame.unionByName, merges, spark.createDataFrame(last, "a bigint, b bigint, h double, level int"))
    undone = tree.orderBy(F.round("h", 9).desc(), F.desc("level"), F.desc("a"), F.desc("b")).limit(max(k, 1) - 1).select("b")
    kept = tree.join(F.broadcast(undone), "b", "left_anti").select(F.col("b").alias("_id"), F.col("a").alias("_up"))
    up = stored(points.select("_id").join(kept, "_id", "left").select("_id", F.coalesce("_up", "_id").alias("_up")))
    while True:  # each round halves the way to the root
        over = up.select(F.col("_id").alias("_up"), F.col("_up").alias("_top"))
        further = stored(up.join(over, "_up").select("_id", "_up", "_top"))
        up = further.select("_id", F.col("_top").alias("_up"))
        if further.where("_up <> _top").isEmpty():
            break
    roots = [r[0] for r in up.select("_up").distinct().orderBy("_up").collect()]  # k
    numbered = spark.createDataFrame([(x, i) for i, x in enumerate(roots)], f"_up bigint, {label} int")
    of = points.join(up, "_id").join(F.broadcast(numbered), "_up").select(column, label)
    return rows.join(of, column)
