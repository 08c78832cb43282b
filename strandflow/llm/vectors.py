"""Approximate nearest neighbours by inner product on robust-pruned directed graphs, one a shard.

The graphs follow DiskANN (Subramanya et al., 2019): greedy searches propose neighbours, and pruning keeps a
neighbour only if no kept one is closer to it by the factor alpha, which leaves long edges. Searches and pruning run for
many points at once. Inner products become distances by one more coordinate that gives all vectors of a graph equal norm.
That coordinate misleads a search where norms are far apart, and queries have none of it, so a graph holds vectors of
nearly equal norm.

Equal vectors are one point that stands for its least ids, so copies neither fill a shard nor each other's lists. Points
are dealt to shards by norm and, among those alike, by the hash of their vector; every query searches every shard with a beam,
and the shards' bests are merged per query; scores are then exact inner products of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandflow.llm.shared import written

#: Points of one graph differ in their norms by this factor at most.
NORM_RATIO = 1.1
#: Bytes of vectors of a shard at most, or 256 points.
SHARD_BYTES = 64 << 20
INDEX = "shard int, size int, bin int, lifted binary, raw binary, graph binary, entry binary, ids array<array<bigint>>"
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def pruned(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for many points of norm 1: candidates (rows of ids, -1 for none) to at most degree diverse neighbours each."""
    rows = np.arange(len(own))
    spread = points[candidates]
    near = 2 - 2 * np.matmul(spread, points[own][:, :, None])[:, :, 0]
    near[(candidates < 0) | (candidates == own[:, None])] = np.inf
    out = np.full((len(own), degree), -1, np.int32)
    for k in range(degree):
        at = np.argmin(near, axis=1)
        live = np.isfinite(near[rows, at])
        if not live.any():
            break
        out[live, k] = candidates[rows, at][live]
        gap = 2 - 2 * np.matmul(spread, spread[rows, at][:, :, None])[:, :, 0]
        # what is closer to the chosen one by the factor goes; so do the chosen one and further mentions of it
        near[(alpha * alpha * gap <= near) & live[:, None]] = np.inf
        near[rows[live], at[live]] = np.inf
    return out


def searched(points: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search for many queries: each one's beam of ids and squared distances, nearest first, and the ids it expanded.

    A round expands the expand nearest unexpanded members of every unfinished beam.
    """
    n, m = len(queries), len(points)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    start = entry[:beam]
    ids[:, : len(start)] = start
    dist[:, : len(start)] = 2 - 2 * queries @ points[start].T
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    seen = np.zeros((n, m), bool)
    seen[:, start] = True
    open_ = ids >= 0
    active = np.arange(n)
    visited: list[np.ndarray] = []
    while len(active):
        mask = open_[active]
        turn = np.cumsum(mask, axis=1)
        pick = mask & (turn <= expand)
        row, col = np.nonzero(pick)
        open_[active[row], col] = False
        picked = np.full((len(active), expand), -1, np.int32)
        picked[row, turn[row, col] - 1] = ids[active[row], col]
        trail = np.full((n, expand), -1, np.int32)
        trail[active] = picked
        visited.append(trail)
        found = np.where(picked[:, :, None] >= 0, graph[picked], -1).reshape(len(active), -1)
        fresh = (found >= 0) & ~seen[active[:, None], found]
        r, c = np.nonzero(fresh)
        new = found[r, c]
        # one id from two expanded members in a round counts once
        key = r.astype(np.int64) * m + new
        _, first = np.unique(key, return_index=True)
        r, new = r[first], new[first]
        seen[active[r], new] = True
        d = 2 - 2 * np.einsum("ij,ij->i", queries[active[r]], points[new])
        per = np.bincount(r, minlength=len(active))
        place = np.arange(len(r)) - np.repeat(np.cumsum(per) - per, per)
        width = int(per.max()) if len(per) else 0
        more_i, more_d = np.full((len(active), width), -1, np.int32), np.full((len(active), width), np.inf, np.float32)
        more_i[r, place], more_d[r, place] = new, d
        all_i, all_d = np.c_[ids[active], more_i], np.c_[dist[active], more_d]
        all_o = np.c_[open_[active], more_i >= 0]
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[active], dist[active], open_[active] = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_o))
        active = active[open_[active].any(axis=1)]
    return ids, dist, np.concatenate(visited, axis=1) if visited else np.zeros((n, 0), np.int32)


def graph_of(points: np.ndarray, degree: int, beam: int, alpha: float, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The directed graph (rows of neighbours, -1 for none) and its entry points. Two passes, alpha 1 and then the relaxed one.

    Rows have half as many spare places as neighbours, which take edges back until a full row is pruned again.
    """
    n, width = len(points), degree + degree // 2
    rng = np.random.Generator(np.random.PCG64(7))
    graph = np.full((n, width), -1, np.int32)
    if n > 1:
        graph[:, :degree] = rng.integers(0, n, (n, degree))
    middle = int(np.argmax(points @ points.mean(axis=0)))
    entry = np.unique(np.r_[middle, rng.integers(0, n, 7)]).astype(np.int32)
    for factor in (1.0, alpha):
        order = rng.permutation(n).astype(np.int32)
        for k in range(0, n, batch):
            own = order[k : k + batch]
            near, _, trail = searched(points, graph, entry, points[own], beam)
            graph[own] = -1
            graph[own, :degree] = pruned(points, own, np.c_[near, trail[:, : 2 * beam]], degree, factor)
            to, source = graph[own, :degree].ravel(), np.repeat(own, degree)
            by = np.argsort(to[to >= 0], kind="stable")
            to, source = to[to >= 0][by], source[to >= 0][by]
            targets, first, counts = np.unique(to, return_index=True, return_counts=True)
            held = (graph[targets] >= 0).sum(axis=1)
            room = held + counts <= width
            place = np.arange(len(to)) - np.repeat(first, counts) + np.repeat(held, counts)
            fits = np.repeat(room, counts)
            graph[to[fits], place[fits]] = source[fits]
            full = targets[~room].astype(np.int32)
            added = np.full((len(full), int(counts[~room].max()) if len(full) else 0), -1, np.int32)
            which = np.repeat(np.cumsum(~room) - 1, counts)[~fits]
            added[which, (place - np.repeat(held, counts))[~fits]] = source[~fits]
            for j in range(0, len(full), batch):
                t = full[j : j + batch]
                kept = pruned(points, t, np.c_[graph[t], added[j : j + batch]], degree, factor)
                graph[t] = -1
                graph[t, :degree] = kept
    return graph, entry


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: not null, not zero, all components finite; a null id takes no part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def norm_bin(v: Column, ratio: float = NORM_RATIO) -> Column:
    """The number of the vector's norm on a scale of steps of the ratio; borders lie half a step beside norm 1. The largest component
    is divided out first, so that no square overflows or vanishes."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / top) * (x / top))
    return F.floor((F.log(top) + F.log(squares) / 2) / math.log(ratio) + 0.5).cast("int")


def shard_table(points: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """size, bin, first_shard, parts: the shards of each norm bin, about shard_rows points each, and their number. Bins follow each other
    along the shards, so small ones share one and a large one has several. One row a bin: at most some 15,000 a vector length."""
    bins = points.groupBy("size", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("size", "bin"))  # one row a bin
    first, last = F.floor((F.col("upto") - F.col("n")) / shard_rows), F.floor((F.col("upto") - 1) / shard_rows)
    bins = bins.withColumn("upto", upto).select("size", "bin", first.cast("int").alias("first_shard"), (last - first + 1).cast("int").alias("parts"))
    return bins, -(-points.count() // shard_rows)


def shard_index(points: np.ndarray, degree: int, beam: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of one norm bin lifted to equal norm, as float32 of their own scale, with graph and entry points."""
    top = np.abs(points).max()
    scaled = points / top
    squares = (scaled * scaled).sum(axis=1)
    lifted = np.c_[scaled, np.sqrt(np.maximum(squares.max() - squares, 0))]
    lifted = (lifted / np.sqrt(squares.max())).astype(np.float32)
    return (lifted, *graph_of(lifted, min(degree, max(1, len(points) - 1)), beam, alpha))


def nearest(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    shard_rows: int = 6000,
    degree: int = 32,
    build_beam: int = 64,
    beam: int = 120,
    alpha: float = 1.2,
    query_block: int = 1 << 16,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, the rows whose id is divisible by every, among all other rows.

    score is the inner product in doubles; ties go to the lesser vec_id. Vectors of another length than the query's are
    no candidates. Rows that repeat an id are candidates each by its own vector, but never of a query with that id. Fewer than k rows
    come where there are fewer candidates; no usable vectors give no rows. Products that overflow are infinite, as they are
    when computed plainly, and those that are no number come last.

    Points are dealt to shards by norm, so those of one graph differ by a tenth in it at most, however norms are
    spread. A shard has about shard_rows points (fewer of long vectors), so their number grows with the rows and a task's
    memory doesn't. A query block (query_block rows) meets a shard's index in one task that reads the index once and the queries as a stream.
    """
    spark = df.sparkSession
    rows = written(usable_vectors(df, key, vector), "vectors")
    # a point stands for its k + 1 least ids: with the query itself among them, k are left, and no other can be in a result
    ids = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("_n", F.row_number().over(ids)).where(F.col("_n") <= k + 1)
    points = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = written(points.select("v", "ids", F.size("v").alias("size"), norm_bin(F.col("v")).alias("bin")), "points")
    longest = points.agg(F.max("size")).first()[0]
    if longest is None:
        return spark.createDataFrame([], RESULT)
    bins, shards = shard_table(points, max(256, min(shard_rows, SHARD_BYTES // (12 * longest))))
    dealt = points.join(F.broadcast(bins), ["size", "bin"]).select((F.col("first_shard") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("shard"), "size", "bin", "v", "ids")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), points_schema)  # a shard
        keys = np.c_[[table.column(c).to_numpy() for c in ("shard", "size", "bin")]].T
        for shard, size, bin_ in np.unique(keys, axis=0):
            part = table.filter(pa.array((keys == (shard, size, bin_)).all(axis=1))).combine_chunks()
            raw = flat_values(part.column("v")).reshape(-1, size)
            order = np.lexsort(raw.T[::-1])  # the graph doesn't depend on the order in which rows come
            raw, own = raw[order], part.column("ids").take(pa.array(order))
            lifted, graph, entry = shard_index(raw, degree, build_beam, alpha)
            yield pa.RecordBatch.from_pylist([{"shard": int(shard), "size": int(size), "bin": int(bin_), "lifted": lifted.tobytes(), "raw": raw.tobytes(), "graph": graph.tobytes(), "entry": entry.tobytes(), "ids": own.to_pylist()}], index_schema)

    points_schema, index_schema = to_arrow_schema(dealt.schema), to_arrow_schema(T.StructType.fromDDL(INDEX))
    # one shard a task, and a task for each: the deal is by number
    index = written(dealt.repartitionById(shards, F.col("shard")).mapInArrow(build, INDEX), "graphs")
    queries = rows.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "v")
    blocks = max(1, -(-queries.count() // query_block))
    spread = lambda x, name, to: x.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
    asked = spread(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "shard", shards)
    both = spread(index, "block", blocks).withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("place", F.col("shard") * blocks + F.col("block"))
    met = both.repartitionById(shards * blocks, F.col("place")).sortWithinPartitions("place", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts = None, []
        for batch in batches:
            places, kinds = batch.column("place").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if places[a] != place:
                    place, parts = places[a], []
                if kinds[a] == 0:
                    parts += [Part(part, row, beam) for row in range(part.num_rows)]
                    continue
                query_ids, sizes = part.column("query_id").to_numpy(), pa.compute.list_value_length(part.column("v")).to_numpy()
                for own in parts:
                    some = np.flatnonzero(sizes == own.size)
                    for j in range(0, len(some), 512):
                        at = some[j : j + 512]
                        q = flat_values(part.column("v").take(pa.array(at))).reshape(len(at), own.size)
                        yield own.best(query_ids[at], q, beam, k)

    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    # NaN, which Spark takes for the largest double, goes last
    best = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def flat_values(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy() if isinstance(lists, pa.ChunkedArray) else lists.flatten().to_numpy()


class Part:
    """The index of one norm bin in one shard, out of a row."""

    def __init__(self, batch: pa.RecordBatch, row: int, beam: int):
        one = lambda name: batch.column(name)[row]
        self.size = one("size").as_py()
        array = lambda name, kind: np.frombuffer(one(name).as_buffer(), kind)
        self.lifted = array("lifted", np.float32).reshape(-1, self.size + 1)
        self.raw = array("raw", np.float64).reshape(-1, self.size)
        self.graph = array("graph", np.int32).reshape(len(self.raw), -1)
        self.entry = array("entry", np.int32)
        if len(self.raw) <= beam:  # a beam holds them all
            self.entry = np.arange(len(self.raw), dtype=np.int32)
        members = one("ids").values
        self.starts, self.ids = members.offsets.to_numpy(), members.values.to_numpy()

    def best(self, query_ids: np.ndarray, q: np.ndarray, beam: int, k: int) -> pa.RecordBatch:
        """The k best of each query among the points that a beam search finds."""
        scaled = q / np.abs(q).max(axis=1, keepdims=True)
        unit = np.c_[scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), np.zeros(len(q))].astype(np.float32)
        found, _, _ = searched(self.lifted, self.graph, self.entry, unit, beam)
        r, c = np.nonzero(found >= 0)
        point = found[r, c]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (q[r] * self.raw[point]).sum(axis=1)
        counts = self.starts[point + 1] - self.starts[point]
        spread = np.repeat(self.starts[point], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        who, vec, score = np.repeat(query_ids[r], counts), self.ids[spread], np.repeat(exact, counts)
        other = who != vec
        who, vec, score = who[other], vec[other], score[other]
        order = np.lexsort((vec, -score, np.isnan(score), who))
        who, vec, score = who[order], vec[order], score[order]
        begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
        top = np.arange(len(who)) - np.repeat(begin, np.diff(np.r_[begin, len(who)])) < k
        return pa.RecordBatch.from_arrays([pa.array(who[top], pa.int64()), pa.array(vec[top], pa.int64()), pa.array(score[top], pa.float64())], ["query_id", "vec_id", "score"])
