"""Centroid clustering of integer vectors by equal-average equal-variance nearest neighbour search.

For vectors of d components with sums S and d-fold squared deviations W = d * sum(x^2) - S^2, a centroid's squared distance times d is at least
(S_x - S_c)^2 + (sqrt(W_x) - sqrt(W_c))^2 (Lee and Chen, "Fast closest codeword search algorithms for vector quantisation", 1994). Centroids
are sorted by their mean; a search goes outward from the vector's own mean, ends on a side at the first centroid whose
mean alone is too far, passes over those whose deviation is, and computes the rest exactly in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.shared import written

#: Scaled components below this keep all sums of squares of 64 of them within 64 bits.
LARGEST = 1 << 24
#: Vectors that a worker clusters at once.
BATCH = 1 << 15
BIAS = 1 << 31


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes that sort as the rows do."""
    return [r.tobytes() for r in (x + BIAS).astype(">u4")]


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, size).astype(np.int64) - BIAS


def integer_vectors(df: DataFrame, key: str, vector: str, size: int, scale: float) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors with size finite components, packed; v is null where a component reaches LARGEST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(batch.column("v")), size), False)
            part = batch.filter(right)
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls come as NaN
            part, x = part.filter(pa.array(np.isfinite(x).all(axis=1))), x[np.isfinite(x).all(axis=1)]
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            fits = (np.abs(x) < LARGEST).all(axis=1)
            rows = iter(packed(x[fits].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([next(rows) if f else None for f in fits], pa.binary())], ["vec_id", "v"])

    return df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id bigint, v binary")


class Centroids:
    """Centroids (rows of int64) with what the search needs of them."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.sums = rows, rows.sum(axis=1)
        self.order = np.argsort(self.sums, kind="stable")
        self.spread = np.sqrt(self.deviation(rows, self.sums))

    @staticmethod
    def deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return (x.shape[1] * np.einsum("ij,ij->i", x, x) - sums * sums).astype(np.float64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; the smaller number of equally near ones."""
        d, n = x.shape[1], len(x)
        sums = x.sum(axis=1)
        squares = self.deviation(x, sums)
        spread = np.sqrt(squares)
        sorted_sums = self.sums[self.order]
        who, best = np.full(n, len(self.rows), np.int64), np.full(n, 2 * d * LARGEST * 2 * LARGEST + 1, np.int64)
        start = np.searchsorted(sorted_sums, sums)
        for p in np.unique(start):
            own = np.flatnonzero(start == p)  # vectors that scan from one place
            sides = [(range(p, len(self.rows)), own), (range(p - 1, -1, -1), own)]
            for step in range(max(len(sides[0][0]), len(sides[1][0]))):
                for side, (places, live) in enumerate(sides):
                    if step >= len(places) or not len(live):
                        continue
                    c = self.order[places[step]]
                    gap = sums[live] - self.sums[c]
                    near = gap * gap <= d * best[live]  # beyond the first failure the side's means only go further away
                    live, gap = live[near], gap[near]
                    sides[side] = (places, live)
                    apart = spread[live] - self.spread[c]
                    slack = 1e-12 * (squares[live] + self.spread[c] ** 2) + 1  # more than doubles round off
                    some = live[gap.astype(np.float64) ** 2 + apart * apart - slack <= d * best[live].astype(np.float64)]
                    off = x[some] - self.rows[c]
                    dist = np.einsum("ij,ij->i", off, off)
                    better = (dist < best[some]) | ((dist == best[some]) & (c < who[some]))
                    who[some[better]], best[some[better]] = c, dist[better]
        return who, best


def joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in tables of about BATCH rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def moved(vectors: DataFrame, centroids: Centroids) -> np.ndarray:
    """The centroids of the next round: exact floors of their vectors' means. One row a centroid leaves a task, and one comes to the driver."""
    k, size = centroids.rows.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for part in joined_batches(batches):
            x = unpacked(part.column("v").combine_chunks(), size)
            who, _ = centroids.nearest(x)
            order = np.argsort(who, kind="stable")
            present, first = np.unique(who[order], return_index=True)
            sums[present] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(who, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), *(pa.array(sums[own, i]) for i in range(size))], ["cluster", "n", *(f"s{i}" for i in range(size))])

    columns = ["n", *(f"s{i}" for i in range(size))]
    parts = vectors.select("v").mapInArrow(run, "cluster bigint, " + ", ".join(f"{c} bigint" for c in columns))
    rows = centroids.rows.copy()
    for r in parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns]).collect():
        rows[r.cluster] = [int(r[c]) // int(r.n) for c in columns[1:]]
    return rows


def clustered(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, centroids: int = 40, rounds: int = 5, scale: float = 256.0, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the final centroid's components as decimals joined by commas).

    Vectors with exactly size components, none null or non-finite, take part as integers floor(scale * x). The first centroids are the vectors
    of the least lowercase-hex sha256 of `<seed>:<vec_id>`, in that order. A round gives every vector to its nearest centroid (ties: smaller number) and
    moves every centroid that has vectors to the floor of their mean; after the last round vectors are given out once more.

    Repeated rows count each. Among rows of one vec_id the least vector comes first; rows without one come last, after all hashes. Fewer vectors
    than centroids make as many centroids as vectors; no vectors give no rows. A vector with a scaled component of 2^24 or more, whose squared
    distances could leave 64 bits, comes back with nulls and moves nothing; an inertia beyond 64 bits is null. Other columns are ignored.

    The integers are written once, 4 bytes a component. A pass has no shuffle but of one row a task and centroid; the driver holds the centroids alone.
    """
    spark = df.sparkSession
    every = written(integer_vectors(df, key, vector, size, scale), "integers")
    vectors = every.where("v is not null")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(centroids).collect()
    rows = np.array([np.frombuffer(r.v, ">u4").astype(np.int64) - BIAS for r in first]).reshape(-1, size)
    for _ in range(rounds if len(rows) else 0):
        rows = moved(vectors, Centroids(rows))
    last = Centroids(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined_batches(batches):
            who, dist = last.nearest(unpacked(part.column("v").combine_chunks(), size))
            yield pa.RecordBatch.from_arrays([part.column("vec_id").combine_chunks(), pa.array(who.astype(np.int32)), pa.array(dist)], ["vec_id", "cluster", "distance"])

    given = written(vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), "given")
    whole = {r.cluster: int(r.total) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fitting = lambda n: n if n < 1 << 63 else None
    of_cluster = [(c, fitting(n), hashlib.sha256(",".join(map(str, rows[c].tolist())).encode()).hexdigest()) for c, n in whole.items()]
    told = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia bigint, centroid_sha256 string")  # at most a row a centroid
    beyond = every.where("v is null").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
    inertia = F.lit(fitting(sum(whole.values()))).cast("bigint")
    result = given.unionByName(beyond).join(F.broadcast(told), "cluster", "left")
    return result.select("vec_id", "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256")
