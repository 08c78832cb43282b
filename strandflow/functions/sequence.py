"""Column functions on symbol sequences: each is one expression over a row, so a table of sequences needs no shuffle.

A sequence is a string over ACGT; other letters count as A where codes are taken. codes are 0 to 3 in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of the standard genetic code for codons in the order AAA, AAC, AAG, AAT, ACA, ... TTT; * is stop.
GENETIC_CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
#: Codon indices by amino acid.
SYNONYMS = {aa: [i for i, x in enumerate(GENETIC_CODE) if x == aa] for aa in sorted(set(GENETIC_CODE))}
#: Widths at which the Hurst exponent is measured: from 8 on by half as much again.
HURST_WIDTHS = [8]
while HURST_WIDTHS[-1] < 1 << 28:
    HURST_WIDTHS.append(int(HURST_WIDTHS[-1] * 1.5))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body and its lambdas mention it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column, start: float | int = 0.0) -> Column:
    """The sum of an array, as double or, with start 0, as bigint."""
    kind = "double" if isinstance(start, float) else "bigint"
    return F.aggregate(values, F.lit(start).cast(kind), lambda a, x: a + x.cast(kind))


def steps(first: int | Column, end: int | Column) -> Column:
    """first to end - 1, empty where there is none."""
    first, end = (F.lit(x) if isinstance(x, int) else x for x in (first, end))
    return F.when(end > first, F.sequence(first.cast("int"), (end - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def only_acgt(text: Column) -> Column:
    """The ACGT letters of a text, in upper case; everything else is taken out first."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


def codes(seq: Column) -> Column:
    """array<int> of 0 to 3."""
    return F.filter(F.split(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "0123"), ""), lambda c: c != "").cast("array<int>")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def gc_content(seq: Column) -> Column:
    """Share of C and G; null for an empty sequence."""
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^CG]", "")) / F.length(seq))


def kmers(symbols: Column, k: int, alphabet: int = 4) -> Column:
    """The overlapping k-mers of a symbol array, packed base alphabet into bigints."""

    def packed(s: Column) -> Column:
        return F.transform(steps(0, F.size(s) - (k - 1)), lambda i: sum(F.get(s, i + j).cast("bigint") * alphabet ** (k - 1 - j) for j in range(k)))

    return let(symbols, packed)


def codons(symbols: Column) -> Column:
    """Codons 0 to 63 in frame 0."""
    return let(symbols, lambda s: F.transform(steps(0, F.floor(F.size(s) / 3)), lambda i: F.get(s, i * 3) * 16 + F.get(s, i * 3 + 1) * 4 + F.get(s, i * 3 + 2)))


def pairs(values: Column, width: int, lag: int = 1) -> Column:
    """Pairs of values lag apart, packed."""
    return let(values, lambda s: F.transform(steps(0, F.size(s) - lag), lambda i: F.get(s, i) * width + F.get(s, i + lag)))


def histogram(values: Column) -> Column:
    """array<struct<value, n>> of the distinct values in order."""

    def of(s: Column) -> Column:
        ends = F.filter(steps(0, F.size(s)), lambda i: (i == F.size(s) - 1) | (F.get(s, i) != F.get(s, i + 1)))
        return let(ends, lambda e: F.transform(e, lambda i, j: F.struct(F.get(s, i).alias("value"), (i - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("n"))))

    return let(F.sort_array(values), of)


def counts(values: Column) -> Column:
    return F.transform(histogram(values), lambda x: x["n"])


def entropy(n: Column) -> Column:
    """Bits of an array of counts; 0 where they sum to 1 or less."""
    n = F.filter(n, lambda x: x > 0)
    return let(n, lambda c: F.when(total(c, 0) <= 1, 0.0).otherwise(F.log2(total(c, 0).cast("double")) - total(F.transform(c, lambda x: x * F.log2(x.cast("double")))) / total(c, 0)))


def information(one: Column, two: Column) -> Column:
    """2 H(one) - H(two), at least 0, of arrays of counts."""
    return F.greatest(2 * entropy(one) - entropy(two), F.lit(0.0))


def kmer_entropy(symbols: Column, k: int, alphabet: int = 4) -> Column:
    """Entropy of the overlapping k-mers over that of all alike; 0 for sequences shorter than k."""
    return F.when(F.size(symbols) < k, 0.0).otherwise(entropy(counts(kmers(symbols, k, alphabet))) / F.log2(F.lit(float(alphabet**k))))


def mutual_information(symbols: Column, lag: int = 1, width: int = 4, least: Column | None = None) -> Column:
    """2 H(symbol) - H(pair lag apart), at least 0; 0 for sequences of lag + 1 or fewer symbols."""
    short = F.size(symbols) <= lag + 1 if least is None else least
    return F.when(short, 0.0).otherwise(F.greatest(2 * entropy(counts(symbols)) - entropy(counts(pairs(symbols, width, lag))), F.lit(0.0)))


def codon_information(symbols: Column) -> Column:
    """Mutual information of neighbouring codons; 0 with fewer than 10."""
    return let(codons(symbols), lambda c: mutual_information(c, 1, 64, F.size(c) < 10))


def autocorrelations(symbols: Column, most_lag: int = 30) -> Column:
    """r(1), r(2), ... below min(most_lag, n // 4); null where the symbols don't vary."""

    def lags(c: Column) -> Column:
        n = F.size(c)
        each = lambda lag: F.aggregate(steps(0, n - lag), F.lit(0.0), lambda a, i: a + F.get(c, i) * F.get(c, i + lag))
        norm = total(F.transform(c, lambda x: x * x))
        return let(norm, lambda v: F.when(v > 1e-9, F.transform(steps(1, F.least(F.lit(most_lag), F.floor(n / 4))), lambda lag: each(lag) / v)))

    centred = lambda s: let(total(s) / F.nullif(F.size(s), F.lit(0)), lambda mean: F.transform(s, lambda x: x - mean))
    return let(symbols, lambda s: let(centred(s), lags))


def period3_share(r: Column) -> Column:
    """Share of the absolute autocorrelations at lags that are multiples of 3; 0 for fewer than 5 lags, null ones or no correlation."""
    size = F.transform(r, lambda x: F.abs(x))
    third = F.filter(size, lambda _, i: (i + 1) % 3 == 0)
    return F.when((F.size(r) >= 5) & (total(size) > 0), total(third) / total(size)).otherwise(0.0)


def period3_strength(symbols: Column, most_lag: int = 30) -> Column:
    return let(autocorrelations(symbols, most_lag), period3_share)


def autocorrelation_peaks(symbols: Column, most_lag: int = 30, threshold: float = 0.005) -> Column:
    """Lags of peaks_of the symbols' autocorrelations; fewer than 4 lags have none."""
    return let(autocorrelations(symbols, most_lag), lambda r: F.transform(peaks_of(r, threshold), lambda x: x["lag"]))


def hurst(symbols: Column) -> Column:
    """Slope of ln(mean R/S) on ln(width) over the widths below n // 4, cut to 0..1; 0.5 for fewer than 64 symbols or 3 widths."""

    def rescaled(seg: Column) -> Column:
        mean = total(seg, 0).cast("double") / F.size(seg)

        def walk(m: Column) -> Column:
            start = F.struct(F.lit(0.0).alias("at"), F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"), F.lit(0.0).alias("squares"))

            def step(a: Column, x: Column) -> Column:
                d = x - m
                at = a["at"] + d
                return F.struct(at.alias("at"), F.least(a["low"], at).alias("low"), F.greatest(a["high"], at).alias("high"), (a["squares"] + d * d).alias("squares"))

            return let(F.aggregate(seg, start, step), lambda a: F.when(a["squares"] > 1e-9, (a["high"] - a["low"]) / F.sqrt(a["squares"] / (F.size(seg) - 1))))

        return let(mean, walk)

    def of(s: Column) -> Column:
        n = F.size(s)
        widths = F.filter(F.array(*[F.lit(w) for w in HURST_WIDTHS]), lambda w: w < F.floor(n / 4))
        blocks = lambda w: F.transform(F.sequence(F.lit(0), n - w - 1, w), lambda at: let(F.slice(s, at + 1, w), rescaled))
        mean = lambda v: F.when(F.size(v) > 0, total(v) / F.size(v))
        points = F.transform(widths, lambda w: F.struct(F.log(w.cast("double")).alias("x"), F.log(let(F.filter(blocks(w), lambda v: v.isNotNull()), mean)).alias("y")))

        def slope(p: Column) -> Column:
            k = F.size(p).cast("double")
            x, y = total(F.transform(p, lambda v: v["x"])), total(F.transform(p, lambda v: v["y"]))
            xy, xx = total(F.transform(p, lambda v: v["x"] * v["y"])), total(F.transform(p, lambda v: v["x"] * v["x"]))
            return F.when(F.size(p) < 3, 0.5).otherwise(F.least(F.greatest((k * xy - x * y) / (k * xx - x * x), F.lit(0.0)), F.lit(1.0)))

        return let(F.filter(points, lambda v: v["y"].isNotNull()), slope)

    return F.when(F.size(symbols) < 64, 0.5).otherwise(let(symbols, of))


def dense(hist: Column, size: int) -> Column:
    """array<bigint> of the counts of values 0 to size - 1."""
    return let(F.map_from_entries(F.transform(hist, lambda x: F.struct(x["value"].cast("int"), x["n"].cast("bigint")))), lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0).cast("bigint"))))


def rho_from_counts(one: Column, two: Column, expected_zero: float = 1.0) -> Column:
    """16 odds ratios f(xy) / (f(x) f(y)) from dense symbol and pair counts; 1 (or expected_zero) where a symbol is absent, all 1 under 10 symbols."""

    def of(n: Column) -> Column:
        expected = lambda i: (F.get(one, F.floor(i / 4).cast("int")) * F.get(one, i % 4)).cast("double") / n / n
        ratio = lambda i: let(expected(i), lambda e: F.when(e > 0, F.get(two, i).cast("double") / (n - 1) / e).otherwise(expected_zero))
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(n < 10, 1.0).otherwise(ratio(i)))

    return let(total(one, 0), of)


def rho_vector(symbols: Column, expected_zero: float = 1.0) -> Column:
    return let(symbols, lambda s: let(dense(histogram(s), 4), lambda one: let(dense(histogram(pairs(s, 4)), 16), lambda two: rho_from_counts(one, two, expected_zero))))


def rscu_from_counts(n: Column) -> Column:
    """64 relative synonymous codon usages from dense counts: count over the mean of its group; 1 for empty groups and for fewer than 10 codons."""
    groups = list(SYNONYMS)
    group = F.array(*[F.lit(groups.index(aa)) for aa in GENETIC_CODE])

    def of(c: Column) -> Column:
        means = F.array(*[sum(F.get(c, F.lit(x)) for x in SYNONYMS[aa]) / float(len(SYNONYMS[aa])) for aa in groups])
        usage = lambda i, m: F.when(F.get(m, F.get(group, i)) > 0, F.get(c, i) / F.get(m, F.get(group, i))).otherwise(1.0)
        each = lambda m: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: usage(i, m))
        return F.when(total(c, 0) < 10, F.array_repeat(F.lit(1.0), 64)).otherwise(let(means, each))

    return let(n, of)


def rscu(symbols: Column) -> Column:
    return let(dense(histogram(codons(symbols)), 64), rscu_from_counts)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def chargaff_deviation(seq: Column) -> Column:
    """|f(A) - f(T)| + |f(C) - f(G)|; null for an empty sequence."""
    n = lambda c: F.length(F.regexp_replace(seq, f"[^{c}]", ""))
    return F.when(F.length(seq) > 0, (F.abs(n("A") - n("T")) + F.abs(n("C") - n("G"))) / F.length(seq))


def structural_share(n: Column, rounds: int = 50) -> Column:
    """Share of distinct values (of an array of counts) whose frequency is above the cut at which they hold half of the mass, found by bisection of 0 to 1.

    What so many rounds come to is told at once: they close in on the frequency f at which the mass of the values from the largest on passes half, and end in the step
    of 2^-rounds whose end is f or the next place above it; values at f itself are above the cut if f lies in the upper half of that step.
    """

    def of(c: Column) -> Column:
        whole = total(c, 0)
        # the first count, from the largest on, with which half of the mass is passed
        start = F.struct(F.lit(0).cast("bigint").alias("mass"), F.lit(0).alias("at"))
        half = lambda w: F.aggregate(c, start, lambda a, x: F.when(a["mass"] * 2 > w, a).otherwise(F.struct((a["mass"] + x).alias("mass"), x.alias("at"))))["at"]
        scaled = lambda f: f * float(2**rounds)
        upper = lambda f: scaled(f) > F.ceil(scaled(f)) - 0.5
        least = lambda w: let(half(w), lambda at: at + F.when(upper(at / w), 0).otherwise(1))
        return let(let(whole, least), lambda m: F.size(F.filter(c, lambda x: x >= m)) / F.size(c))

    return let(F.sort_array(F.transform(n, lambda x: x.cast("int")), asc=False), lambda c: F.when(F.size(c) > 0, of(c)).otherwise(0.0))


def divergence_part(p: Column, q: Column) -> Column:
    """What one bin adds to a Jensen-Shannon divergence in bits."""
    return let((p + q) / 2, lambda m: (p * F.log2(p / m) + q * F.log2(q / m)) / 2)


def smoothed_share(n: Column, size: Column, bins: int = 4096, tiny: float = 1e-10) -> Column:
    """n / size after tiny is added to every bin; uniform where nothing was counted."""
    return F.when(size > 0, (n / F.nullif(size, F.lit(0)) + tiny) / (1 + bins * tiny)).otherwise(1.0 / bins)


def divergence_of_none(reference: Column, reference_size: Column, bins: int = 4096) -> Column:
    """The sum of divergence_part over the reference's bins, for a histogram that has none of them."""
    none = smoothed_share(F.lit(0.0), F.lit(1), bins)
    # sizes are often sums themselves: let keeps them from being summed anew for each bin
    return let(reference_size, lambda size: total(F.transform(reference, lambda n: F.when(n > 0, divergence_part(none, smoothed_share(n, size, bins))).otherwise(0.0))))


def divergence_from(hist: Column, size: Column, reference: Column, reference_size: Column, of_none: Column, bins: int = 4096) -> Column:
    """Jensen-Shannon divergence of a histogram (array<struct<value, n>>) and dense reference counts, both smoothed.

    Bins that both lack are equal and add nothing; of_none, computed once a reference, stands for the reference's
    bins, and the histogram's own bins correct it. A histogram without counts is uniform: it takes the plain sum.
    """
    none = smoothed_share(F.lit(0.0), F.lit(1), bins)

    def of(sizes: Column) -> Column:
        own, other = sizes["own"], sizes["other"]

        def corrected(x: Column) -> Column:
            n = F.get(reference, x["value"].cast("int"))
            return let(smoothed_share(n, other, bins), lambda q: divergence_part(smoothed_share(x["n"], own, bins), q) - F.when(n > 0, divergence_part(none, q)).otherwise(0.0))

        plain = total(F.transform(reference, lambda n: divergence_part(F.lit(1.0 / bins), smoothed_share(n, other, bins))))
        return F.when(own > 0, of_none + total(F.transform(hist, corrected))).otherwise(plain)

    return let(F.struct(size.alias("own"), reference_size.alias("other")), of)


def regime(h3: Column) -> Column:
    """SPARSE, BIASED, CODING or BALANCED by the 3-mer entropy (of 1); fixed cuts."""
    h = F.round(h3, 9)
    return F.when(h < 0.5, "SPARSE").when(h < 0.85, "BIASED").when(h < 0.95, "CODING").otherwise("BALANCED")


def regime_by_symbols(ratio: Column) -> Column:
    """The same names by the symbol entropy over its maximum; the older, lower cuts."""
    h = F.round(ratio, 9)
    return F.when(h < 0.25, "SPARSE").when(h < 0.60, "BIASED").when(h < 0.85, "CODING").otherwise("BALANCED")


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def periodicity_score(mi: Column, period: int = 3) -> Column:
    """Mean information at the first four multiples of the period over that at the other lags up to there; null where the latter is 0, 0 without any."""
    first = F.slice(mi, 1, 4 * period)
    at = mean_of(F.filter(first, lambda _, i: (i + 1) % period == 0))
    beside = mean_of(F.filter(first, lambda _, i: (i + 1) % period != 0))
    return F.when(F.coalesce(F.array_max(first), F.lit(0.0)) <= 0, 0.0).otherwise(at / F.nullif(beside, F.lit(0.0)))


def lag3_ratio(mi: Column) -> Column:
    """Information at lag 3 over the mean of that at 1, 2, 4 and 5; null where the latter is 0, 0 with fewer than 6 lags."""
    beside = (F.get(mi, F.lit(0)) + F.get(mi, F.lit(1)) + F.get(mi, F.lit(3)) + F.get(mi, F.lit(4))) / 4.0
    return F.when(F.size(mi) < 6, 0.0).otherwise(F.get(mi, F.lit(2)) / F.nullif(beside, F.lit(0.0)))


def peaks_of(r: Column, threshold: float = 0.005) -> Column:
    """array<struct<lag, r>> of the strict local maxima above the threshold among autocorrelations r(1), r(2), ..., at lags from 2 on that have a lag behind them."""
    at = lambda lag: F.get(r, (lag - 1).cast("int"))
    lags = F.filter(steps(2, F.size(r)), lambda k: (at(k) > threshold) & (at(k) > at(k - 1)) & (at(k) > at(k + 1)))
    return F.coalesce(F.transform(lags, lambda k: F.struct(k.alias("lag"), at(k).alias("r"))), F.array().cast("array<struct<lag:int,r:double>>"))
