"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.shared import drop_columns, hashed_uniform, named, numbered_copies, written

#: A Poisson draw of a larger mean is the sum of equal draws of at most this mean, so that exp(-mean) stays normal.
LARGEST_STEP = 32.0
#: The largest mean that is inverted exactly.
LARGEST_SUM = 2048.0


def poisson_inverse(uniform: Column, mean: Column) -> Column:
    """The least k with Poisson(mean) cdf(k) >= uniform, for means up to LARGEST_STEP.

    The sum stops at k = mean + 14 sqrt(mean) + 40, beyond which lies less than one step of a double below 1.
    """
    mean = mean.cast("double")
    steps = F.sequence(F.lit(1), F.ceil(mean + F.sqrt(mean) * 14.0 + 40.0).cast("int"))
    state = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k.cast("double")
        return F.when(s["cdf"] >= uniform, s).otherwise(F.struct(k.alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

    return F.aggregate(steps, state, step)["k"]


def poisson_count(mean: Column, seed: int, *key: Column) -> Column:
    """A Poisson(mean) count, bigint, that the seed and the key decide.

    Up to LARGEST_SUM it is inverted exactly, as a sum of equal draws. Beyond, it is the quantile at a hashed normal score z by the Cornish-Fisher
    expansion of a lattice law: the least k with cdf(k) >= Phi(z) but for about one draw in 20,000 at a mean of 2,049, where it is one off, and fewer
    at larger means; so a count costs no more however large its mean.
    """
    mean = mean.cast("double")
    parts = F.greatest(F.ceil(F.least(mean, F.lit(LARGEST_SUM)) / LARGEST_STEP).cast("int"), F.lit(1))
    draw = lambda i: poisson_inverse(hashed_uniform(F.lit(seed), i, *key), mean / parts)
    exact = F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0).cast("bigint"), lambda a, b: a + b)
    u, v = (hashed_uniform(F.lit(seed), F.lit(name), *key) for name in ("radius", "angle"))
    z = F.sqrt(F.log(u) * -2.0) * F.cos(v * (2.0 * math.pi))
    return F.when(mean > LARGEST_SUM, large_quantile(mean, z)).otherwise(exact)


def large_quantile(mean: Column, z: Column) -> Column:
    """The Poisson quantile, bigint, at the normal score z, for means over LARGEST_SUM."""
    root = F.sqrt(mean)
    return F.floor(mean + root * z + z * z / 6.0 + 1.0 / 3.0 - (z / 36.0 + z * z * z / 72.0) / root).cast("bigint")


def repetition_rates(df: DataFrame, source: str, size: Column, weights: dict[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """source, rate: how often a document of the source is to be seen, target size over present size.

    One row a source; sizes are summed before the shuffle, so a hot source costs no more than another. weights: target
    share of each source, sources without one get none; None: equal shares. total: target size; None: the present one.
    """
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    everything = sizes.agg(F.sum("size").alias("all_sizes"), F.count(F.lit(1)).alias("n_sources"))
    sizes = sizes.crossJoin(F.broadcast(everything))  # one row
    if weights is None:
        share = 1.0 / F.col("n_sources")
    else:
        whole = sum(weights.values())
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), weight / whole).otherwise(share)
    target = F.col("all_sizes") if total is None else F.lit(float(total))
    return sizes.select("source", F.when(F.col("size") > 0, share * target / F.col("size")).otherwise(0.0).alias("rate"))


def replicate(
    df: DataFrame,
    doc_id: str,
    source: str,
    size: Column,
    weights: dict[str | None, float] | None = None,
    total: float | None = None,
    seed: int = 17,
    most_sources: int = 100_000,
) -> DataFrame:
    """df's rows repeated by a Poisson count whose mean is the source's rate, with copy_no (from 0) and shuffle_key.

    The seed and doc_id decide a count, so a rerun after a lost executor gives the same rows. Rows that repeat a doc_id get
    equal counts; rows without one are told apart by all that they hold. A null source is a source of its own; a source of size 0 or
    without weight has rate 0; an empty df gives no rows. A rare source can have any rate: its copies are made in levels and
    dealt out again between them, so neither a row nor a task holds them all. Columns named copy_no (bigint) or shuffle_key are
    replaced. The rates are broadcast while they are at most most_sources rows, else joined by shuffle.
    """
    df = drop_columns(df, "copy_no", "shuffle_key", "_rate", "_source", "_count", "_key", "_high", "_middle", "_low")
    rates = written(repetition_rates(df, source, size, weights, total).withColumnsRenamed({"source": "_source", "rate": "_rate"}), "rates")
    # one pass over a row a source
    n, high = rates.agg(F.count(F.lit(1)), F.max("_rate")).first()
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), F.xxhash64(*[named(c) for c in df.columns]).cast("string")))
    joined = df.withColumn("_key", own).join(F.broadcast(rates) if n <= most_sources else rates, F.col(source).eqNullSafe(F.col("_source")))
    kept = joined.withColumn("_count", poisson_count(F.col("_rate"), seed, F.col("_key"))).drop("_source", "_rate")
    copies = numbered_copies(kept, "_count", "copy_no", ["_key"] if (high or 0) > 512 else None)
    return copies.withColumn("shuffle_key", hashed_uniform(F.lit(seed), F.lit("order"), F.col("_key"), F.col("copy_no"))).drop("_count", "_key")


def mixed(df: DataFrame, doc_id: str, **options) -> DataFrame:
    """replicate(), shuffled globally: rows dealt by the hash of shuffle_key and ordered by it within each partition.

    The key is uniform and differs between copies, so partitions are even whatever the sources; ties go by doc_id and copy_no.
    """
    return replicate(df, doc_id, **options).repartition("shuffle_key").sortWithinPartitions("shuffle_key", doc_id, "copy_no")
