"""Pair resonance on aligned symbol matrices, and signals along positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.functions import sequence as S
from strandflow.operators.measures import CODES, informations, packed_kmers
from strandflow.plans.session import settled


def stability(n: Column) -> Column:
    """1 - entropy over its maximum for an array of counts; 0 for a total of 1 or less, 1 for a single value."""
    return S.let(F.filter(n, lambda x: x > 0), lambda c: F.when(S.total(c, 0) <= 1, 0.0).when(F.size(c) < 2, 1.0).otherwise(1.0 - S.entropy(c) / F.log2(F.size(c).cast("double"))))


def resonance(matrix: DataFrame, columns: int, alphabet: int = 4, first_k: int = 1, last_k: int = 6, least: int = 5, right_beyond: bool = False) -> DataFrame:
    """b1, b2, k, n, a, d, mi, p, x, g, r of the symbol pairs at distance k that occur least times.

    matrix has symbols, arrays of `columns` symbols. r is the geometric mean of the six signals, 0 if one is 0. right_beyond:
    the right context is the symbol behind the second one; otherwise, as published, the second symbol itself.
    """
    s = F.col("symbols")
    spread = matrix.select(s, F.explode(F.sequence(F.lit(first_k), F.lit(min(last_k, columns - 1)))).alias("k"))
    pairs = spread.select("symbols", "k", F.explode(S.steps(0, F.lit(columns) - F.col("k"))).alias("c"))
    at = lambda i: F.get(s, i)
    c, k = F.col("c"), F.col("k")
    right = F.when(c + k + 1 < columns, at(c + k + (1 if right_beyond else 0)))
    gaps = F.transform(F.when(k > 1, F.sequence(F.lit(1), F.least(k, F.lit(4)) - 1)).otherwise(F.array().cast("array<int>")), lambda g: F.struct(F.lit("g").alias("kind"), at(c + g).alias("value")))
    each = F.concat(F.array(F.struct(F.lit("p").alias("kind"), c.alias("value")), F.struct(F.lit("l").alias("kind"), F.when(c > 0, at(c - 1)).alias("value")), F.struct(F.lit("r").alias("kind"), right.alias("value"))), gaps)
    tagged = pairs.select("k", at(c).alias("b1"), at(c + k).alias("b2"), F.inline(each)).where("value is not null")
    counts = tagged.groupBy("k", "b1", "b2", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    symbols = matrix.select(F.explode("symbols").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("m"))
    size = matrix.agg(F.count(F.lit(1)).alias("rows"))
    share = symbols.crossJoin(F.broadcast(size)).select("v", (F.col("m") / (F.col("rows") * columns)).alias("f"))
    places = size.select(F.explode(F.sequence(F.lit(first_k), F.lit(min(last_k, columns - 1)))).alias("k"), "rows").select("k", (F.col("rows") * (columns - F.col("k"))).cast("double").alias("positions"))
    return scored_pairs(counts, share, places, least)


def tiled_resonance(docs: DataFrame, columns: int, last_k: int = 6, least: int = 5, codons: bool = False) -> DataFrame:
    """As resonance, over every letter of docs (seq of ACGT): a sequence is cut into consecutive rows of `columns` letters, and its
    last row, or a sequence shorter than a row, is a row of the letters that there are. Pairs lie within rows.
    codons: the symbols are the codons 0 to 63 in frame 0 instead, a row has `columns` of them, and one or two letters behind the last codon take no part.

    Rows of different lengths make a ragged matrix: a pair counts in each row that reaches to its second symbol, and the
    possible places of a distance and the shares of the symbols are counted, not computed from columns. Null and empty sequences have no rows.
    A task holds alphabet^2 x (columns + 3 x alphabet) counts a distance (10 MB for codons in rows of 100), however many letters it reads.
    """
    size = 64 if codons else 4
    cells = size * size

    def symbols(text: str) -> np.ndarray:
        x = CODES[np.frombuffer(text.encode(), np.uint8)]
        if codons:
            x = x[: len(x) // 3 * 3].reshape(-1, 3) @ np.array([16, 4, 1])
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = {"s": 1, "p": columns, "l": size, "r": size, "g": size}
        sums = {(kind, k): np.zeros((cells, w), np.int64) for k in range(1, last_k + 1) for kind, w in widths.items() if kind != "s"} | {("s", 0): np.zeros((cells, 1), np.int64)}
        for batch in batches:
            texts = [t for t in batch.column("seq").to_pylist() if t]
            some, held = [], 0
            for i, t in enumerate(texts):
                some.append(symbols(t))
                held += len(t)
                if held > 1 << 20 or i == len(texts) - 1:
                    x, n = np.concatenate(some), np.array([len(v) for v in some])
                    at = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                    c = at % columns
                    width = np.minimum(columns, np.repeat(n, n) - (at - c))
                    sums["s", 0] += np.bincount(x, minlength=cells)[:, None]
                    for k in range(1, last_k + 1):
                        p = np.flatnonzero(c + k < width)
                        pair = x[p] * size + x[p + k]
                        add = lambda kind, on, value: sums[kind, k].__iadd__(np.bincount(pair[on] * widths[kind] + value, minlength=cells * widths[kind]).reshape(cells, -1))  # noqa: B023, E731
                        add("p", slice(None), c[p])
                        inner = np.flatnonzero(c[p] > 0)
                        add("l", inner, x[p[inner] - 1])
                        inner = np.flatnonzero(c[p] + k + 1 < width[p])
                        add("r", inner, x[p[inner] + k])
                        for g in range(1, min(k, 4)):
                            add("g", slice(None), x[p + g])
                    some, held = [], 0
        for (kind, k), n in sums.items():
            pair, value = np.nonzero(n)
            whole = lambda v, of: pa.array(np.full(len(pair), v), of)  # noqa: B023, E731
            tag = pa.DictionaryArray.from_arrays(whole(0, pa.int32()), pa.array([kind])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([whole(k, pa.int32()), pa.array(pair // size, pa.int32()), pa.array(pair % size, pa.int32()), tag, pa.array(value, pa.int32()), pa.array(n[pair, value], pa.int64())], ["k", "b1", "b2", "kind", "value", "n"])

    # a task has at most a row for each cell of the histograms, so this table is small; the texts are read once
    found = docs.select("seq").mapInArrow(run, "k int, b1 int, b2 int, kind string, value int, n bigint").groupBy("k", "b1", "b2", "kind", "value").agg(F.sum("n").alias("n"))
    found = settled(found)
    letters = found.where("kind = 's'").select(F.col("b2").alias("v"), "n")
    share = letters.crossJoin(F.broadcast(letters.agg(F.sum("n").alias("all")))).select("v", (F.col("n") / F.col("all")).alias("f"))
    places = found.where("kind = 'p'").groupBy("k").agg(F.sum("n").cast("double").alias("positions"))
    return scored_pairs(found.where("kind != 's'"), share, places, least)


def scored_pairs(counts: DataFrame, share: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """The signals of the pairs from counts (k, b1, b2, kind, value, n), shares of the symbols (v, f) and possible places by distance (k, positions)."""
    hist = counts.groupBy("k", "b1", "b2").agg(*[F.collect_list(F.when(F.col("kind") == x, F.col("n"))).alias(x) for x in "plrg"])  # at most one count a column or symbol
    hist = hist.withColumn("n", S.total(F.col("p"), 0))
    reverse = hist.select("k", F.col("b1").alias("b2"), F.col("b2").alias("b1"), F.col("n").alias("back"))
    rows = hist.join(reverse, ["k", "b1", "b2"], "left").where(F.col("n") >= least)
    rows = rows.join(F.broadcast(share.withColumnsRenamed({"v": "b1", "f": "f1"})), "b1").join(F.broadcast(share.withColumnsRenamed({"v": "b2", "f": "f2"})), "b2").join(F.broadcast(places), "k")  # a row a symbol or distance
    positions = F.col("positions")
    cut = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    pmi = F.log2(F.col("n") / positions / (F.col("f1") * F.col("f2")))
    back = F.coalesce("back", F.lit(0))
    rows = rows.withColumns(
        {
            "a": cut(F.log1p(F.col("n") * 10.0) / F.log1p(positions)),
            "d": F.abs(F.col("n") - back) / (F.col("n") + back),
            "mi": cut(1.0 - F.exp(-F.greatest(pmi, F.lit(0.0)) / 4.0)),
            "p": stability(F.col("p")),
            "x": (stability(F.col("l")) + stability(F.col("r"))) / 2.0,
            "g": F.when(F.col("k") > 1, stability(F.col("g"))).otherwise(1.0),
        }
    )
    six = [F.col(v) for v in ("a", "d", "mi", "p", "x", "g")]
    r = F.when(F.least(*six) > 0, F.exp(sum(F.log(F.greatest(v, F.lit(1e-300))) for v in six) / 6)).otherwise(0.0)
    return rows.withColumn("r", r).select("b1", "b2", "k", "n", "a", "d", "mi", "p", "x", "g", "r")


def context_entropies(context: np.ndarray, symbol: np.ndarray, contexts: int) -> np.ndarray:
    """Entropy of the symbol given each context that occurs, by context."""
    n = np.bincount(context * 4 + symbol, minlength=contexts * 4).reshape(-1, 4).astype(np.float64)
    whole = n.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole > 0, np.log2(whole) - np.where(n > 0, n * np.log2(n), 0).sum(axis=1) / whole, 0.0)


def entropy_contrasts(rows: DataFrame, k: int = 5, seq: str = "seq") -> DataFrame:
    """rows, but for seq, with delta_h: at the inner positions k .. n - k - 1 of each sequence, entropy of a symbol given the k before it
    less that given the k after it, both estimated from the sequence itself. Sequences under 2 k + 2 have no row. Work of a row alone."""
    kept = [f for f in rows.schema.fields if f.name != seq]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(seq).to_pylist():
                s = CODES[np.frombuffer((text or "").encode(), np.uint8)]
                if len(s) < 2 * k + 2:
                    out.append(None)
                    continue
                grams = packed_kmers(s, k)
                before, after = context_entropies(grams[:-1], s[k:], 4**k), context_entropies(grams[1:], s[: len(s) - k], 4**k)
                inner = np.arange(k, len(s) - k)
                out.append(before[grams[inner - k]] - after[grams[inner + 1]])
            whole = pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.list_(pa.float64()))], [*(f.name for f in kept), "delta_h"])
            yield whole.filter(whole.column("delta_h").is_valid())

    return rows.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL("delta_h array<double>").fields]))


def inverted_repeats(windows: DataFrame, k: int = 8, gap: int = 500) -> DataFrame:
    """contig_id, window_no, n: distinct k-mers that start in a window and whose reverse complement starts there or up to gap letters behind.

    windows were made with extra = gap + k - 1 letters, of which seq holds as many as there are; end - start is the window's own size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("seq").to_pylist(), batch.column("own").to_pylist(), strict=True):
                s = CODES[np.frombuffer(text.encode(), np.uint8)]
                last = len(s) - k + 1
                if last <= 0:
                    out.append(0)
                    continue
                forward = packed_kmers(s, k)
                back = packed_kmers((3 - s)[::-1], k)[::-1]  # back[i]: reverse complement of the k-mer at i
                here = min(own, last)
                seen = np.zeros(4**k, bool)
                seen[forward[:here]] = True
                out.append(int(seen[np.unique(back[: min(here + gap, last)])].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("contig_id"), batch.column("window_no"), pa.array(out, pa.int32())], ["contig_id", "window_no", "n"])

    rows = windows.select("contig_id", "window_no", (F.col("end") - F.col("start")).cast("int").alias("own"), "seq")
    return rows.mapInArrow(run, T.StructType([rows.schema["contig_id"], rows.schema["window_no"], T.StructField("n", T.IntegerType())]))


def information_half_life(rows: DataFrame, unit: str, most_lag: int = 12) -> DataFrame:
    """unit, slope, half_life: least squares of ln MI on the lag over lags of positive MI; half-life ln 2 / -slope, null for slopes of -1e-6 or more."""
    each = informations(rows, most_lag).select(unit, F.posexplode("mi").alias("lag", "mi")).withColumn("lag", F.col("lag") + 1.0)
    fit = each.where("mi > 1e-12").groupBy(unit).agg(F.regr_slope(F.log("mi"), F.col("lag")).alias("slope"))
    return fit.withColumn("half_life", F.when(F.col("slope") < -1e-6, -F.log(F.lit(2.0)) / F.col("slope")))


def tail_contrast(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, contrast: (max - median) / (inter-quartile range + 1e-9), by linear percentiles."""
    q = lambda x: F.percentile(value, F.lit(x))
    return rows.groupBy(*keys).agg(((F.max(value) - q(0.5)) / (q(0.75) - q(0.25) + 1e-9)).alias("contrast"))


def codon_half_life(rows: DataFrame, unit: list[str], most_lag: int = 32) -> DataFrame:
    """unit, half_life: as information_half_life, of codons, over all lags with information cut at 1e-10; 0 with fewer than 3 lags or none at lag 1, null for slopes of -1e-6 or more."""
    each = informations(rows, most_lag, codons=True).select(*unit, "mi", F.posexplode_outer("mi").alias("lag", "x"))
    fit = each.groupBy(*unit).agg(F.regr_slope(F.log(F.greatest("x", F.lit(1e-10))), F.col("lag") + 1.0).alias("slope"), F.first("mi").alias("mi"))
    few = (F.size("mi") < 3) | (F.coalesce(F.get("mi", F.lit(0)), F.lit(0.0)) <= 0)
    return fit.select(*unit, F.when(few, 0.0).when(F.col("slope") < -1e-6, -F.log(F.lit(2.0)) / F.col("slope")).alias("half_life"))


def ranked_pairs(found: DataFrame) -> DataFrame:
    """found with place: by r, then distance and symbols. The pairs of an alphabet are few."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("r"), "k", "b1", "b2")))


def best_distances(found: DataFrame) -> DataFrame:
    """b1, b2, k, r: the distance of the largest r of each pair, the least of equal ones."""
    best = found.groupBy("b1", "b2").agg(F.min(F.struct((-F.col("r")).alias("r"), "k")).alias("m"))
    return best.select("b1", "b2", F.col("m.k").alias("k"), (-F.col("m.r")).alias("r"))


def aligned_average(contrasts: DataFrame, anchor: str, reach: int = 100, first: int = 5) -> DataFrame:
    """offset, n, mean: mean delta_h (arrays from position first on) at each offset up to reach around the anchor's position; rows without an anchor take no part."""
    each = contrasts.where(F.col(anchor).isNotNull()).select(anchor, F.posexplode("delta_h").alias("i", "d"))
    offset = F.col("i") + first - F.col(anchor)
    return each.select(offset.cast("int").alias("offset"), "d").where(F.abs("offset") <= reach).groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"))
