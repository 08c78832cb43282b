"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model on the non-negative unbiased risk (Kiryo et al.,
"Positive-unlabeled learning with non-negative risk estimator", 2017):

    prior x R(positives, +) + max(0, R(unlabelled, -) - prior x R(positives, -))

The class prior comes from the same texts: the least ratio, over score cuts, of the unlabelled share above the cut to
the positive share above it (Garg et al., "Mixture proportion estimation and PU learning", 2021), measured on a
fold that the model in question has not seen. Negative labels are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.shared import drop_columns, hashed_uniform, mapped, slices

#: Rows of each kind that a model is fitted on at most.
TRAINING_ROWS = 6000
#: Byte-pair buckets, besides the named shape features.
PAIRS = 256
SHAPE = 27

#: Byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space but newline, 5 newline, 6 sentence marks, 7 other ASCII marks, 8 beyond ASCII
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 7
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[9, 11, 12, 13, 32]], CLASS[10] = 4, 5
CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6
CLASS[128:] = 8


def text_features(text: str | None) -> np.ndarray:
    """What the model sees of a whole text: shares of byte classes and of their successions, sizes of words and lines, repetition, hashed byte pairs."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(SHAPE + PAIRS, np.float32)
    n = len(raw)
    out[0] = 1.0 if n else 0.0
    if not n:
        return out
    kind = CLASS[raw]
    out[1:10] = np.bincount(kind, minlength=9) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    unique = len(set(words))
    out[10] = np.log1p(len(words)) / 10
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out[11], out[12] = sizes.mean() / 10, sizes.std() / 10
        out[13] = unique / len(words) ** 0.9
        out[14] = (sizes == 1).mean()
        out[15] = (sizes > 15).mean()
        out[26] = sum(map(eq, words, words[1:])) / len(words)
    if lines:
        out[16] = 1 - len(set(lines)) / len(lines)
        out[17] = np.log1p(n / len(lines)) / 10
        out[18] = np.log1p(len(lines)) / 10
    if n > 1:
        after = np.bincount(kind[:-1].astype(np.int64) * 9 + kind[1:], minlength=81) / (n - 1)
        for k, (a, b) in enumerate(((1, 7), (7, 4), (2, 2), (1, 6), (6, 4), (7, 7))):
            out[19 + k] = after[a * 9 + b]
        pair = (raw[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + raw[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(24)
        out[SHAPE:] = np.sqrt(np.bincount(pair, minlength=PAIRS) / (n - 1))
    out[25] = 1.0 if n < 60 else 0.0
    return out


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float


def minimise(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.03, decay: float = 1e-3) -> np.ndarray:
    """Weights of least non-negative risk with the sigmoid loss, by full-batch Adam; while the negative part is below 0 its gradient is reversed, as published."""
    pos, unl = np.c_[pos, np.ones(len(pos))], np.c_[unl, np.ones(len(unl))]
    w, m, v = np.zeros(pos.shape[1]), np.zeros(pos.shape[1]), np.zeros(pos.shape[1])
    for t in range(1, rounds + 1):
        p, u = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (pos, unl))
        dp, du = p * (1 - p), u * (1 - u)
        pull = pos.T @ dp / len(pos)
        negative = u.mean() - prior * p.mean()
        push = unl.T @ du / len(unl) - prior * pull
        g = -prior * pull + push if negative >= 0 else -push
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def separating(pos: np.ndarray, unl: np.ndarray, rounds: int = 300, decay: float = 3e-3) -> np.ndarray:
    """Logistic weights of positives against unlabelled, for the class prior."""
    x = np.c_[np.r_[pos, unl], np.ones(len(pos) + len(unl))]
    y = np.r_[np.ones(len(pos)), np.zeros(len(unl))]
    share = np.where(y > 0, 0.5 / len(pos), 0.5 / len(unl))
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        g = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y))
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of rows outside the fit: the least upper bound, over cuts, of a ratio of tail shares."""
    cuts = np.quantile(pos, np.linspace(0.02, 0.98, 97))
    p, u = ((x[None, :] >= cuts[:, None]).mean(axis=1) for x in (pos, unl))
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    best = np.argmin((u + slack * (1 + u / np.maximum(p, 1e-9))) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray) -> Model:
    """Model of two feature matrices. Without positives or unlabelled rows every score is the neutral 0.5."""
    width = SHAPE + PAIRS
    if not len(pos) or not len(unl):
        return Model(np.zeros(width + 1), np.zeros(width), np.ones(width), 0.5)
    both = np.r_[pos, unl].astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    # few rows can't tell the byte pairs' chance differences from real ones: they weigh less there
    scale[SHAPE:] /= min(1.0, len(pos) / TRAINING_ROWS)
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    if len(pos) < 4 or len(unl) < 4:
        prior = 0.5
    else:
        w = separating(pos[::2], unl[::2])
        prior = class_prior(pos[1::2] @ w[:-1], unl[1::2] @ w[:-1])
    return Model(minimise(pos, unl, prior), mean, scale, prior)


def place(*key: Column) -> Column:
    """A row's place in the order in which samples take rows, 0 to 1."""
    return hashed_uniform(F.lit("train"), *key)


def sampled_features(rows: DataFrame, most_rows: int) -> np.ndarray:
    """Features of most_rows rows (place, text) at most, those of least place; the driver receives the bounded matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = [text_features(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("place"), pa.array(x, pa.binary())], ["place", "x"])

    # rows that repeat an id and its text are one, so none fills the sample
    found = rows.dropDuplicates(["place"]).mapInArrow(run, "place double, x binary").orderBy("place", "x").limit(most_rows).toPandas()["x"]
    return np.frombuffer(b"".join(found), np.float32).reshape(-1, SHAPE + PAIRS).astype(np.float64)


def train(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", most_rows: int = TRAINING_ROWS) -> Model:
    """Model of docs' texts; trusted has the keys of positives. Of positives and of all docs, most_rows each at most are
    fitted on (a documented bound of the fit alone; every row is scored): those of least hash of key and text, whatever the order
    of tasks. Of positives, 1.3 times as many keys, those of least hash, are looked up; they are broadcast. Null keys are no
    positives, and among docs a key like others. Null texts count as empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("place", place(F.col("key"), F.xxhash64("text")))
    share = lambda n: F.lit(1.3 * most_rows / max(1, n))
    ids = trusted.select(F.col(key).alias("key")).where("key is not null").distinct()
    picked = ids.where(place(F.col("key")) < share(ids.count()))
    positives = rows.join(F.broadcast(picked), "key", "left_semi").select("place", "text")
    unlabelled = rows.where(F.col("place") < share(rows.count())).select("place", "text")
    return fit(*(sampled_features(x, most_rows) for x in (positives, unlabelled)))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from the threshold on) of every whole text.

    Null and empty texts share one score, that of a text without bytes. Rows are independent: repeats score alike, an empty
    df gives no rows, columns named score or predicted are replaced.
    """
    df = drop_columns(df, "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            x = np.stack([text_features(t) for t in part.column(text).to_pylist()])
            z = np.clip((x - model.mean) / model.scale, -8, 8)
            # summed row by row, so that equal texts score alike in any batch
            logit = (z * model.weights[:-1]).sum(axis=1) + model.weights[-1]
            s = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return mapped(df, run, "score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """The fold that no fit sees: crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
