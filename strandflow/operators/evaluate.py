"""Ranking and clustering measures: AUC, recall at k, rank correlations, rank tests, ARI, NMI, purity, thresholds, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.tails import correlation_t, normal_greater, normal_two_sided, student_two_sided
from strandflow.operators.pieces import running_sums, with_next
from strandflow.plans.session import settled


def mid_ranks(levels: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """levels (keys, value, count; values differ) with _rank: the rank from 1 that rows of the value share, the mean of their places. No key is one task."""
    ranked = running_sums(levels, keys, [value], count)
    return ranked.withColumn("_rank", F.col(f"before_{count}") + (F.col(count) + 1) / 2.0).drop(f"before_{count}")


def auc(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """keys, n_pos, n_neg, auc (Mann-Whitney with mid-ranks; null where a class is empty)."""
    # equal scores are counted first, so that distinct scores alone are ordered
    levels = rows.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    sums = mid_ranks(levels, keys, score, "_n").groupBy(*keys).agg(F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg"), F.sum(F.col("_rank") * F.col("_p")).alias("_s"))
    value = (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    return sums.select(*keys, "n_pos", "n_neg", value.alias("auc"))


def recall_at(rows: DataFrame, keys: list[str], score: str, order: str, positive: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """k, recall: share of the keys whose best positive is among the first k by score (ties by order)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), order))
    best = rows.withColumn("_place", place).where(F.col(positive)).groupBy(*keys).agg(F.min("_place").alias("_best"))
    wide = best.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_best") <= k).alias(f"_{k}") for k in ks])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"_{k}") / F.nullif(F.col("_n"), F.lit(0))).alias("recall")) for k in ks])))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho: correlation of mid-ranks."""
    # one row a pair of values from here on
    cells = settled(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n")))
    for v in ("_x", "_y"):
        levels = cells.groupBy(v).agg(F.sum("_n").alias("_m"))
        cells = cells.join(mid_ranks(levels, [], v, "_m").select(v, F.col("_rank").alias(f"_r{v}")), v)
    return weighed_correlation(cells, "_r_x", "_r_y", "_n").select("n", F.col("r").alias("rho"))


def weighed_correlation(cells: DataFrame, x: str, y: str, n: str) -> DataFrame:
    """n, r: Pearson correlation of x and y over cells that stand for n rows each."""
    x, y, n = F.col(x).cast("double"), F.col(y).cast("double"), F.col(n).cast("double")
    sums = cells.agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"))
    spread = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    return sums.select(F.coalesce("n", F.lit(0.0)).cast("bigint").alias("n"), ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(spread, F.lit(0.0))).alias("r"))


def rank_test(rows: DataFrame, keys: list[str], value: str, first: str, tails: bool = False) -> DataFrame:
    """keys, u, z: Mann-Whitney statistic of the rows where first holds, and its normal score with tie correction.

    tails: also p and p_greater, the two-sided chance and that of larger values in the first rows, by the normal score moved half a step to the middle
    (no exact small-sample distribution); null where a class is empty or all values are equal.
    """
    levels = rows.groupBy(*keys, value).agg(F.count_if(F.col(first)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    ranked = mid_ranks(levels, keys, value, "_n")
    cubes = F.sum(F.pow(F.col("_n").cast("double"), 3) - F.col("_n"))
    s = ranked.groupBy(*keys).agg(F.sum("_p").cast("double").alias("a"), (F.sum("_n") - F.sum("_p")).cast("double").alias("b"), F.sum(F.col("_rank") * F.col("_p")).alias("r"), cubes.alias("t"))
    u = F.col("r") - F.col("a") * (F.col("a") + 1) / 2
    n = F.col("a") + F.col("b")
    spread = F.nullif(F.sqrt(F.col("a") * F.col("b") / 12 * (n + 1 - F.col("t") / F.nullif(n * (n - 1), F.lit(0.0)))), F.lit(0.0))
    away = u - F.col("a") * F.col("b") / 2
    found = s.select(*keys, u.alias("u"), (away / spread).alias("z"), away.alias("_away"), spread.alias("_spread"))
    if tails:
        found = found.withColumn("p", normal_two_sided(F.greatest(F.abs("_away") - 0.5, F.lit(0.0)) / F.col("_spread"))).withColumn("p_greater", normal_greater((F.col("_away") - 0.5) / F.col("_spread")))
    return found.drop("_away", "_spread")


def with_tail(found: DataFrame, r: str, n: str = "n") -> DataFrame:
    """found (a row a correlation over n rows) with t and p, the two-sided chance by Student's distribution of n - 2 degrees of freedom; null below three rows."""
    return found.withColumn("t", correlation_t(F.col(r), F.col(n))).withColumn("p", student_two_sided(F.col("t"), F.col(n) - 2))


def agreement(rows: DataFrame, truth: str, found: str, keys: list[str] | None = None, count: str | None = None) -> DataFrame:
    """keys, n, ari, nmi (arithmetic mean), purity of two labelings; count: how many each row stands for. Without keys one row."""
    keys = keys or []
    size = F.sum(count) if count else F.count(F.lit(1))
    cells = rows.groupBy(*keys, F.col(truth).alias("t"), F.col(found).alias("f")).agg(size.cast("double").alias("c"))
    # one row a pair of labels from here on
    cells = cells.withColumns({"a": F.sum("c").over(Window.partitionBy(*keys, "t")), "b": F.sum("c").over(Window.partitionBy(*keys, "f")), "n": F.sum("c").over(Window.partitionBy(*keys or [F.lit(0)]))})
    two = lambda x: x * (x - 1) / 2
    c, a, b, n = (F.col(x) for x in "cabn")
    top = F.row_number().over(Window.partitionBy(*keys, "f").orderBy(F.desc("c"), "t"))
    cells = cells.withColumn("top", top)
    s = cells.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(two(c)).alias("cc"),
        F.sum(two(a) * c / a).alias("aa"),
        F.sum(two(b) * c / b).alias("bb"),
        F.sum(c / n * F.log(c * n / (a * b))).alias("mi"),
        F.sum(-(c / n) * F.log(a / n)).alias("ha"),
        F.sum(-(c / n) * F.log(b / n)).alias("hb"),
        F.sum(F.when(F.col("top") == 1, c).otherwise(0.0)).alias("best"),
    )
    expected = F.col("aa") * F.col("bb") / F.nullif(two(F.col("n")), F.lit(0.0))
    half = (F.col("aa") + F.col("bb")) / 2
    ari = F.when(half == expected, 1.0).otherwise((F.col("cc") - expected) / F.nullif(half - expected, F.lit(0.0)))
    mean = (F.col("ha") + F.col("hb")) / 2
    nmi = F.when(mean == 0, 1.0).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0)))
    return s.select(*keys, F.col("n").cast("bigint").alias("n"), ari.alias("ari"), nmi.alias("nmi"), (F.col("best") / F.col("n")).alias("purity"))


def otsu(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, threshold, between: midpoint of the sorted values at the largest between-class variance, the first of equal ones.
    Fewer than 2 values: (0, 0); all equal: (the value, 0). Values are ordered by ranges, so no key is one task."""
    levels = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    levels = levels.withColumns({"m": F.col("c") * F.col("v"), "x": F.col("v")})
    levels = with_next(running_sums(levels, keys, ["v"], "c", "m"), keys, ["v"], "x", "after")
    whole = levels.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("c").alias("n"), F.sum("m").alias("s"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    levels = (levels.join(whole, same) if keys else levels.crossJoin(F.broadcast(whole))).withColumns({"n0": F.col("before_c") + F.col("c"), "s0": F.col("before_m") + F.col("m")})
    n1 = F.col("n") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / F.nullif(n1, F.lit(0.0))
    variance = F.when(F.col("after").isNull(), 0.0).otherwise(F.round(F.col("n0") * n1 / (F.col("n") * F.col("n")) * apart * apart, 9))
    levels = levels.withColumn("between", variance)
    best = levels.groupBy(*keys).agg(F.max("n").alias("n"), F.min(F.struct((-F.col("between")).alias("b"), F.col("v"), F.coalesce("after", "v").alias("after"))).alias("m"))
    few = F.col("n") < 2
    return best.select(*keys, F.when(few, 0.0).otherwise((F.col("m.v") + F.col("m.after")) / 2).alias("threshold"), F.when(few, 0.0).otherwise(-F.col("m.b")).alias("between"))


#: Modulus of the bootstrap's hash, and the distribution function of Poisson(1) at 0 to 7: fixed values.
PRIME = (1 << 31) - 1
POISSON_ONE = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def bootstrap_means(rows: DataFrame, value: str, key: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """mean, low, high: the mean and the 2.5 and 97.5 percentiles of the means of Poisson bootstraps.

    Each round weighs each row by a Poisson(1) count that a hash of its key (bigint) and the round decides, so no resampled table is formed; a task
    sends one partial sum a round.
    """
    slim = rows.where(F.col(value).isNotNull()).select(F.pmod(F.col(key), F.lit(PRIME)).cast("bigint").alias("key"), F.col(value).cast("double").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, sums, sizes = np.arange(1, rounds + 1, dtype=np.int64), np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                key, v = (batch.column(c).slice(k, 256).to_numpy() for c in ("key", "v"))
                h = (key[:, None] * 48271 + each * 69621 + seed) % PRIME
                for a in (39373, 16807, 40692):
                    h = (h * a + (h >> 9)) % PRIME
                w = np.searchsorted(POISSON_ONE, h / float(PRIME), side="right")
                sums, sizes = sums + v @ w, sizes + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(sums), pa.array(sizes)], ["round", "s", "w"])

    means = slim.mapInArrow(run, "round bigint, s double, w double").groupBy("round").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    whole = rows.agg(F.avg(value).alias("mean"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).crossJoin(F.broadcast(whole)).select("mean", "low", "high")


def percentile_rank(keys: list[str], value: str, order: str) -> Column:
    """(place - 1) / (n - 1) by value, ties by order; 0 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when(n > 1, (F.row_number().over(Window.partitionBy(*keys).orderBy(value, order)) - 1) / F.nullif(n - 1, F.lit(0))).otherwise(0.0)
