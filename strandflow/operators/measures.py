"""Counts and series measures of many sequences at once, in Arrow batches.

The statistics on top of them (entropies, odds ratios, usages, divergences) are Spark expressions over the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.functions.sequence import HURST_WIDTHS, SYNONYMS

#: Codes by byte: A, C, G, T in either case are 0 to 3, all else is 0.
CODES = np.zeros(256, np.int64)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    CODES[[ord(c) for c in _letters]] = _code

FIELDS = "k1 array<bigint>, k2 array<bigint>, k3 array<bigint>, k4 array<bigint>, codon array<bigint>, pair_value array<bigint>, pair_n array<bigint>, hurst double, autocorrelation array<double>"
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


#: Symbols of equally long sequences whose rescaled ranges are taken at a time.
AT_A_TIME = 1 << 16


def rescaled_range_slopes(sequences: list[np.ndarray]) -> list[float]:
    """The Hurst exponents of arrays of codes by rescaled ranges; 0.5 for fewer than 64 symbols or 3 usable widths. Equally long ones are taken together.

    All but the last division is of whole numbers: with C the running sum of a block of w symbols and S its sum, the walk away from the mean is (w C - k S) / w
    at its k-th symbol, and the squared deviations sum up to (w Q - S^2) / w, Q being the sum of squares.
    """
    out = [0.5] * len(sequences)
    lengths = np.array([len(s) for s in sequences])
    for n in np.unique(lengths[lengths >= 64]):
        same = np.flatnonzero(lengths == n)
        size = max(1, AT_A_TIME // int(n))
        for i in range(0, len(same), size):
            slopes = _slopes(np.stack([sequences[j] for j in same[i : i + size]]))
            for j, slope in zip(same[i : i + size], slopes, strict=True):
                out[j] = slope
    return out


def _slopes(x: np.ndarray) -> list[float]:
    rows, n = x.shape
    sums, squares = np.cumsum(x, axis=1, dtype=np.int64), np.cumsum(x * x, axis=1, dtype=np.int64)
    logs = []
    for w in HURST_WIDTHS:
        if w >= n // 4:
            break
        blocks = -(-(n - w) // w)
        ends = slice(w - 1, blocks * w, w)
        before, q = (np.concatenate([np.zeros((rows, 1), np.int64), c[:, ends]], axis=1) for c in (sums, squares))
        whole, q = np.diff(before), np.diff(q)
        kind = np.int32 if 8 * w * w < 1 << 31 else np.int64  # what a walk can come to, codes being under 4
        # places in a block come first in memory, so blocks are compared side by side
        walk = np.subtract(sums[:, : blocks * w].reshape(rows, blocks, w).transpose(2, 0, 1), before[:, :-1], order="C", dtype=kind, casting="unsafe")
        walk *= kind(w)
        walk -= np.arange(1, w + 1, dtype=kind)[:, None, None] * whole.astype(kind)
        away = w * q - whole * whole
        moving = away > 0
        ratio = (walk.max(axis=0) - walk.min(axis=0)) / np.where(moving, w * np.sqrt(away / (w * (w - 1.0))), np.inf)
        many = moving.sum(axis=1)
        logs.append(np.where(many > 0, np.log(np.maximum(ratio.sum(axis=1), 1e-300) / np.maximum(many, 1)), np.nan))
    if len(logs) < 3:
        return [0.5] * rows
    found, widths, out = np.array(logs).T, np.log(HURST_WIDTHS[: len(logs)]), []
    for b in found:
        usable = ~np.isnan(b)
        a = widths[usable]
        if len(a) < 3:
            out.append(0.5)
            continue
        a = a - a.mean()
        out.append(float(np.clip((a * b[usable]).sum() / (a * a).sum(), 0.0, 1.0)))
    return out


def lagged_products(x: np.ndarray, most_lag: int = 30) -> np.ndarray | None:
    """r(1), r(2), ... below min(most_lag, n // 4); None where nothing varies."""
    away = x - x.mean() if len(x) else x
    norm = float(away @ away)
    if norm <= 1e-9:
        return None
    return np.array([away[:-lag] @ away[lag:] / norm for lag in range(1, min(most_lag, len(x) // 4))])


def packed_kmers(s: np.ndarray, k: int) -> np.ndarray:
    """The overlapping k-mers of an array of codes, base 4, for k up to 31."""
    n, half = len(s) - k + 1, k // 2
    if n <= 0 or k == 1:
        return s[: max(0, n)].astype(np.int64)
    short = packed_kmers(s, half)
    out = short[:n] * 4**half + short[half : half + n]
    return out * 4 + s[k - 1 :] if k % 2 else out


#: Rows and bytes of text of a batch that are coded at a time, a longer row by itself.
ROWS_AT_A_TIME, BYTES_AT_A_TIME = 512, 1 << 21


def short_parts(batch: pa.RecordBatch, seq: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows and bytes of seq at most, as codes take eight bytes a letter."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(seq)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        most = (ends[at - 1] if at else 0) + BYTES_AT_A_TIME
        to = min(max(int(np.searchsorted(ends, most, "right")), at + 1), at + ROWS_AT_A_TIME, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def measured(segments: DataFrame, seq: str = "seq", wanted: tuple[str, ...] = tuple(NAMES), letters: bool = True) -> DataFrame:
    """segments with the wanted ones of: dense counts of 1- to 4-mers and codons (frame 0), sparse counts of neighbouring codons, the Hurst
    exponent and autocorrelations. A null sequence is empty. Without letters, the sequences don't come back from the workers."""
    fields = [f for f, n in zip(FIELDS.split(", "), NAMES, strict=True) if n in wanted]
    wanted = tuple(n for n in NAMES if n in wanted)
    kept = [f for f in segments.schema.fields if letters or f.name != seq]
    names = [f.name for f in kept]

    def taken(part: pa.RecordBatch) -> pa.RecordBatch:  # its codes go with it, before the next part is coded
        out: dict[str, list] = {n: [] for n in wanted}
        coded = [CODES[np.frombuffer((text or "").encode(), np.uint8)] for text in part.column(seq).to_pylist()]
        if "hurst" in out:
            out["hurst"] = rescaled_range_slopes(coded)
        for s in coded:
            n = len(s)
            for size in (1, 2, 3, 4):
                if f"k{size}" in out:
                    out[f"k{size}"].append(np.bincount(packed_kmers(s, size), minlength=4**size))
            if "codon" in out or "pair_n" in out:
                c = s[: n // 3 * 3].reshape(-1, 3) @ np.array([16, 4, 1])
                if "codon" in out:
                    out["codon"].append(np.bincount(c, minlength=64))
                if "pair_n" in out:
                    values, counts = np.unique(c[:-1] * 64 + c[1:], return_counts=True)
                    out["pair_n"].append(counts)
                    if "pair_value" in out:
                        out["pair_value"].append(values)
            if "autocorrelation" in out:
                out["autocorrelation"].append(lagged_products(s.astype(np.float64)))
        types = [pa.float64() if n == "hurst" else pa.list_(pa.float64() if n == "autocorrelation" else pa.int64()) for n in wanted]
        return pa.RecordBatch.from_arrays([*part.select(names).columns, *(pa.array(out[n], t) for n, t in zip(wanted, types, strict=True))], [*names, *wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(taken, short_parts(batch, seq))

    return segments.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(", ".join(fields)).fields]))


#: Contigs whose counts a task holds before it passes them on.
CONTIGS_HELD = 256
#: Places of the counts of symbols, pairs, codons and codon pairs in one array.
PLACES = np.cumsum([0, 4, 16, 64, 4096])


def profile_counts(tiles: DataFrame, tile: int) -> DataFrame:
    """contig_id, kind, value, n: counts of the symbols (kind 0), pairs (1), codons (2) and codon pairs (3) that start in the tiles (contig_id, seq, with 5 letters
    beyond the tile where there are any), summed within a task; rows of a value come from several tasks. tile is a multiple of 3."""
    kind, value = np.concatenate([np.full(n, i, np.int32) for i, n in enumerate(np.diff(PLACES))]), np.concatenate([np.arange(n, dtype=np.int32) for n in np.diff(PLACES)])
    shape = T.StructType([tiles.schema["contig_id"], *T.StructType.fromDDL("kind int, value int, n bigint").fields])

    def emptied(held: dict[str, np.ndarray], named: pa.DataType) -> Iterator[pa.RecordBatch]:
        for contig, n in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([contig] * len(some), named), pa.array(kind[some]), pa.array(value[some]), pa.array(n[some])], shape.names)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        named = pa.string()
        for batch in batches:
            named = batch.schema.field("contig_id").type
            for contig, text in zip(batch.column("contig_id"), batch.column("seq"), strict=True):
                contig = contig.as_py()
                if contig not in held:
                    if len(held) == CONTIGS_HELD:
                        yield from emptied(held, named)
                    held[contig] = np.zeros(PLACES[-1], np.int64)
                s, n = CODES[np.frombuffer((text.as_py() or "").encode(), np.uint8)], held[contig]
                c = s[: min(len(s), tile + 3) // 3 * 3].reshape(-1, 3) @ CODON
                for i, part in enumerate((s[:tile], s[:tile][: len(s) - 1] * 4 + s[1 : tile + 1], c[: tile // 3], c[:-1] * 64 + c[1:])):
                    n[PLACES[i] : PLACES[i + 1]] += np.bincount(part, minlength=PLACES[i + 1] - PLACES[i])
        yield from emptied(held, named)

    return tiles.select("contig_id", "seq").mapInArrow(run, shape)


def entropies(n: np.ndarray) -> np.ndarray:
    """Bits of each row of counts; 0 where they sum to 1 or less."""
    whole = n.sum(axis=1)
    logs = (n * np.log2(np.maximum(n, 1))).sum(axis=1)
    return np.where(whole > 1, np.log2(np.maximum(whole, 1)) - logs / np.maximum(whole, 1), 0.0)


def odds_ratios(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """As rho_from_counts, of rows of symbol and pair counts."""
    n = one.sum(axis=1, keepdims=True).astype(np.float64)
    expected = (one[:, :, None] * one[:, None, :]).reshape(-1, 16) / np.maximum(n, 1) / np.maximum(n, 1)
    ratio = two / np.maximum(n - 1, 1) / np.where(expected > 0, expected, 1.0)
    return np.where((n >= 10) & (expected > 0), ratio, 1.0)


def codon_usages(n: np.ndarray) -> np.ndarray:
    """As rscu_from_counts, of rows of codon counts."""
    out = np.ones(n.shape)
    for places in SYNONYMS.values():
        mean = n[:, places].sum(axis=1, keepdims=True) / len(places)
        out[:, places] = np.where(mean > 0, n[:, places] / np.where(mean > 0, mean, 1.0), 1.0)
    return np.where(n.sum(axis=1, keepdims=True) >= 10, out, 1.0)


class Profile:
    """A host's profile as the workers hold it: odds ratios, codon usages and smoothed shares of codon pairs."""

    def __init__(self, rho: list[float], usage: list[float], pairs: np.ndarray, size: int, none: float, tiny: float = 1e-10) -> None:
        self.rho, self.usage, self.none_sum, self.tiny, self.bins = np.array(rho), np.array(usage), none, tiny, len(pairs)
        self.share = self.smoothed(pairs, size)
        absent = self.smoothed(np.zeros(1), 1)
        self.correction = np.where(pairs > 0, self.part(absent, self.share), 0.0)

    def smoothed(self, n: np.ndarray, size: int) -> np.ndarray:
        return (n / size + self.tiny) / (1 + self.bins * self.tiny) if size > 0 else np.full(len(n), 1.0 / self.bins)

    @staticmethod
    def part(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        m = (p + q) / 2
        return (p * np.log2(p / m) + q * np.log2(q / m)) / 2

    def divergence(self, values: np.ndarray, counts: np.ndarray) -> float:
        """As divergence_from, of the codon pairs of a sequence."""
        own = counts.sum()
        if not own:
            return float(self.part(np.full(self.bins, 1.0 / self.bins), self.share).sum())
        return float(self.none_sum + (self.part(self.smoothed(counts, own), self.share[values]) - self.correction[values]).sum())


SIGNALS = "gc double, h3 double, h4 double, hurst double, ac3 double, mi1 double, c2 double, rho_vector array<double>, rho double, cpd double, rscu_d double, codon_mi double"
CODON = np.array([16, 4, 1])


def third_share(r: np.ndarray | None) -> float:
    """As period3_share."""
    if r is None or len(r) < 5:
        return 0.0
    size = np.abs(r)
    return float(size[2::3].sum() / size.sum()) if size.sum() > 0 else 0.0


def against_profiles(segments: DataFrame, hosts: pa.Table, by: str | None = None, seq: str = "seq") -> DataFrame:
    """segments, without their letters, with the signals of SIGNALS against the profile (a row of hosts) that the column by names, or the only one, in Arrow batches.
    Rows without a profile go."""
    rows = zip(*[hosts.column(c) for c in ("host", "host_rho", "host_rscu", "host_pairs", "host_size", "host_none")], strict=True)
    found = {h.as_py(): (r.as_py(), u.as_py(), np.array(p.values), n.as_py(), e.as_py()) for h, r, u, p, n, e in rows}
    sent = segments.sparkSession.sparkContext.broadcast(found)  # a few hosts' counts, 33 KB each
    shape = T.StructType([*(f for f in segments.schema.fields if f.name != seq), *T.StructType.fromDDL(SIGNALS).fields])
    kept, names = shape.names[:-12], shape.names[-12:]

    def taken(part: pa.RecordBatch, profiles: list[Profile]) -> pa.RecordBatch:
        texts = [text or "" for text in part.column(seq).to_pylist()]
        raws = [np.frombuffer(text.encode(), np.uint8) for text in texts]
        coded = [CODES[raw] for raw in raws]
        length = np.array([len(text) for text in texts])
        k = [np.zeros((len(texts), 4**size), np.int64) for size in (1, 2, 3, 4)]
        codon, letters = np.zeros((len(texts), 64), np.int64), np.zeros((len(texts), 4), np.int64)
        of_pairs, cpd, ac3 = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for i, (s, raw, profile) in enumerate(zip(coded, raws, profiles, strict=True)):
            letters[i] = np.bincount(raw, minlength=256)[[65, 67, 71, 84]]
            packed = s
            for size in range(4):
                packed = packed if size == 0 else packed[: max(0, len(s) - size)] * 4 + s[size:]
                k[size][i] = np.bincount(packed, minlength=4 ** (size + 1))
            c = s[: len(s) // 3 * 3].reshape(-1, 3) @ CODON
            codon[i] = np.bincount(c, minlength=64)
            of_each = np.bincount(c[:-1] * 64 + c[1:], minlength=4096)
            values = np.flatnonzero(of_each)
            counts = of_each[values]
            of_pairs[i] = plain_entropy(counts)
            cpd[i] = profile.divergence(values, counts)
            ac3[i] = third_share(lagged_products(s.astype(np.float64)))
        one, two = entropies(k[0]), entropies(k[1])
        ratios = odds_ratios(k[0], k[1])
        a, c, g, t = letters.T
        some = np.maximum(length, 1)
        empty = length == 0
        values = [
            pa.array((c + g) / some, mask=empty),
            pa.array(np.where(length < 3, 0.0, entropies(k[2]) / 6)),
            pa.array(np.where(length < 4, 0.0, entropies(k[3]) / 8)),
            pa.array(rescaled_range_slopes(coded), pa.float64()),
            pa.array(ac3),
            pa.array(np.where(length <= 2, 0.0, np.maximum(2 * one - two, 0.0))),
            pa.array((np.abs(a - t) + np.abs(c - g)) / some, mask=empty),
            pa.array(list(ratios), pa.list_(pa.float64())),
            pa.array(np.sqrt(((ratios - np.stack([p.rho for p in profiles])) ** 2).sum(axis=1))),
            pa.array(cpd),
            pa.array(np.sqrt(((codon_usages(codon) - np.stack([p.usage for p in profiles])) ** 2).sum(axis=1))),
            pa.array(np.where(codon.sum(axis=1) < 10, 0.0, np.maximum(2 * entropies(codon) - of_pairs, 0.0))),
        ]
        return pa.RecordBatch.from_arrays([*part.select(kept).columns, *values], [*kept, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Profile] = {}
        for batch in batches:
            for part in short_parts(batch, seq):
                keys = part.column("_host").to_pylist() if by else list(sent.value)[:1] * part.num_rows
                known = [i for i, x in enumerate(keys) if x in sent.value]
                if len(known) < part.num_rows:
                    part, keys = part.take(pa.array(known, pa.int64())), [keys[i] for i in known]
                for x in set(keys) - set(ready):
                    ready[x] = Profile(*sent.value[x])
                if keys:
                    yield taken(part, [ready[x] for x in keys])

    rows = segments.withColumn("_host", F.col(by).cast("string")) if by else segments
    return (rows if found else rows.limit(0)).mapInArrow(run, shape)


def plain_entropy(n: np.ndarray) -> float:
    n = n[n > 0].astype(np.float64)
    whole = n.sum()
    return float(np.log2(whole) - (n * np.log2(n)).sum() / whole) if whole > 1 else 0.0


def informations(segments: DataFrame, most_lag: int, codons: bool = False, seq: str = "seq") -> DataFrame:
    """segments with mi: mutual information of symbols (or frame-0 codons, at lags up to a quarter of their number) at lags 1, 2, ... most_lag;
    0 where a sequence has lag + 1 symbols or fewer, and no lags under 10 codons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(seq).to_pylist():
                s = CODES[np.frombuffer((text or "").encode(), np.uint8)]
                width, last = 4, most_lag
                if codons:
                    s = s[: len(s) // 3 * 3].reshape(-1, 3) @ np.array([16, 4, 1])
                    width, last = 64, min(most_lag, len(s) // 4) if len(s) >= 10 else 0
                one = plain_entropy(np.bincount(s, minlength=width))
                out.append([max(2 * one - plain_entropy(np.bincount(s[:-lag] * width + s[lag:])), 0.0) if len(s) > lag + 1 else 0.0 for lag in range(1, last + 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "mi"])

    return segments.mapInArrow(run, T.StructType([*segments.schema.fields, *T.StructType.fromDDL("mi array<double>").fields]))
