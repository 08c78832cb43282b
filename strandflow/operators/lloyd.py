"""k-means of many models at once: subsets of features, subsets of rows and starts are keys of one iteration over one table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """A k-means to fit: without one feature (an index), or to the rows of some labels alone."""

    name: str
    k: int
    without: int | None = None
    labels: tuple[str, ...] | None = None


def first_centres(rows: DataFrame, models: list[Model], starts: int, key: Column, label: str, column: str) -> list[np.ndarray]:
    """starts x k x features of each model: the vectors of the k rows of least md5(start:key) among the model's. Of each label and start the least rows
    alone come to the driver."""
    most = max(m.k for m in models)
    hashed = rows.select(F.col(label).alias("label"), F.col(column).alias("z"), key.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    hashed = hashed.select("start", "label", "z", F.md5(F.concat_ws(":", "start", "key").cast("binary")).alias("h"))
    split = any(m.labels for m in models)
    place = F.row_number().over(Window.partitionBy("start", *["label"] if split else []).orderBy("h"))
    found = hashed.withColumn("_n", place).where(F.col("_n") <= most).orderBy("start", "h").collect()
    out = []
    for m in models:
        own = [[r.z for r in found if r.start == s and (m.labels is None or r.label in m.labels)][: m.k] for s in range(starts)]
        centres = np.array(own, np.float64)
        if m.without is not None and centres.size:
            centres[:, :, m.without] = 0.0
        out.append(centres)
    return out


class Fit:
    """The centres of all models, and what a task does with them."""

    def __init__(self, models: list[Model], centres: list[np.ndarray]):
        self.models, self.centres = models, centres

    def given(self, m: int, x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The model's rows (with its features) and their labels, and their nearest centres (a column a start) at what squared distances."""
        model, centres = self.models[m], self.centres[m]
        if model.labels is not None:
            some = np.logical_or.reduce([labels == x for x in model.labels])
            x, labels = x[some], labels[some]
        if model.without is not None:
            x = x.copy()
            x[:, model.without] = 0.0
        who, dist = np.zeros((len(x), len(centres)), np.int64), np.zeros((len(x), len(centres)))
        for s, c in enumerate(centres):
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            who[:, s] = d.argmin(axis=1)
            dist[:, s] = d[np.arange(len(x)), who[:, s]]
        return x, labels, who, dist


def slabs(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield np.array(part.column("z").to_pylist(), np.float64).reshape(part.num_rows, -1), np.array(part.column("label").to_pylist(), object)


def summed(x: np.ndarray, who: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Of each of k centres the sum of its rows, their number and the sum of their distances, as one product."""
    of = (who == np.arange(k)[:, None]).astype(np.float64)
    return np.c_[of @ x, of.sum(axis=1), of @ dist]


def moved(data: DataFrame, fit: Fit) -> tuple[list[np.ndarray], np.ndarray]:
    """The means of the centres' rows, and the models' costs by start under the centres as they were. A row a model, start and centre leaves a task, and one comes to the driver."""
    size = next(c.shape[2] for c in fit.centres if c.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((*c.shape[:2], size + 2)) for c in fit.centres]
        for x, labels in slabs(batches):
            for m in range(len(fit.models)):
                own, _, who, dist = fit.given(m, x, labels)
                for s in range(who.shape[1]):
                    sums[m][s] += summed(own, who[:, s], dist[:, s], sums[m].shape[1])
        for m, part in enumerate(sums):
            s, c = np.nonzero(part[:, :, size])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), m, np.int32)), pa.array(s.astype(np.int32)), pa.array(c.astype(np.int32)), *(pa.array(part[s, c, i]) for i in range(size + 2))], ["model", "start", "centre", *(f"v{i}" for i in range(size + 2))])

    values = [f"v{i}" for i in range(size + 2)]
    parts = data.mapInArrow(run, "model int, start int, centre int, " + ", ".join(f"{v} double" for v in values))
    centres = [c.copy() for c in fit.centres]
    costs = np.zeros((len(centres), max(len(c) for c in centres)))
    for r in parts.groupBy("model", "start", "centre").agg(*[F.sum(v).alias(v) for v in values]).collect():
        v = np.array([r[x] for x in values])
        centres[r.model][r.start, r.centre] = v[:size] / v[size]
        costs[r.model, r.start] += v[size + 1]
    return centres, costs


def confusions(rows: DataFrame, models: list[Model], starts: int, rounds: int, key: Column, label: str, column: str = "z") -> DataFrame:
    """model, label, cluster, n: how the rows' labels fall into the clusters of each model's best start, by its summed squared distances (six places; ties: first).

    All models and starts go through one iteration, so the table is read rounds + 3 times whatever their number; iterations end early when no centre
    moves. A centre without rows stays. Models with fewer rows than k have as many centres as rows; those with none give no rows.
    """
    data = rows.select(F.col(column).alias("z"), F.col(label).alias("label"))
    fit = Fit(models, first_centres(rows, models, starts, key, label, column) if models else [])
    if not any(c.size for c in fit.centres):
        return rows.sparkSession.createDataFrame([], "model string, label string, cluster int, n bigint")
    for _ in range(rounds):
        centres, _ = moved(data, fit)
        still = all(np.array_equal(a, b) for a, b in zip(centres, fit.centres, strict=True))
        fit = Fit(models, centres)
        if still:
            break
    best = np.round(moved(data, fit)[1], 6).argmin(axis=1)
    fit = Fit(models, [c[b : b + 1] for c, b in zip(fit.centres, best.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, labels in slabs(batches):
            for m, model in enumerate(models):
                _, own, who, _ = fit.given(m, x, labels)
                if who.size:
                    pairs = {}
                    for pair in zip(own.tolist(), who[:, 0].tolist(), strict=True):
                        pairs[pair] = pairs.get(pair, 0) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([model.name] * len(pairs)), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32()), pa.array(list(pairs.values()), pa.int64())], ["model", "label", "cluster", "n"])

    return data.mapInArrow(run, "model string, label string, cluster int, n bigint").groupBy("model", "label", "cluster").agg(F.sum("n").alias("n"))
