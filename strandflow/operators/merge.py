"""Pair merging over symbol sequences: byte-pair steps, batches of disjoint merges, informative and diverse merges, decoding.

Sequences are packed into blocks of symbol numbers. A pass over the blocks counts all pairs once and then, for a plan of merges that the driver
expects next, what each of them changes around its places; so a pass that counts 300 x 300 pairs settles several rounds. The driver holds the pair
counts alone (symbols x symbols at most), takes a planned merge only if the exact counts say that it is the next one, and
otherwise takes the one that is and makes a new plan. The merges are those of counting everything in every round.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.plans.session import stored

#: Symbols of a block, or those of one longer sequence.
BLOCK = 1 << 18
#: Numbers of merged symbols begin behind the code points; 0 stands behind each sequence.
FIRST_MERGED = 0x110000
#: Merges that blocks are behind before they are written anew.
BEHIND = 16


def packed(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """ids (of a block's sequences, ascending) and flat (their symbols, 0 behind each sequence). Null and empty sequences have no symbols."""
    kind = sequences.schema["seq_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for i, text in zip(batch.column("seq_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                held.append((i, np.frombuffer((text or "").encode("utf-32-le"), np.int32)))
                n += len(held[-1][1]) + 1
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    def block(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda h: (h[0] is not None, h[0]))
        flat = np.concatenate([x for h in held for x in (h[1], np.zeros(1, np.int32))])
        return pa.RecordBatch.from_arrays([pa.array([[h[0] for h in held]]), pa.array([flat.tobytes()], pa.binary())], ["ids", "flat"])

    return sequences.select("seq_id", F.col(seq).alias("seq")).mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("flat", T.BinaryType())]))


def places_of(flat: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where a merge of a and b takes place, from the left: of a run of one symbol every second place."""
    at = np.flatnonzero(flat[:-1] == a)
    at = at[flat[at + 1] == b]
    if a == b and len(at):
        run = np.r_[0, np.flatnonzero(np.diff(at) != 1) + 1]
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
    return at


def merged(flat: np.ndarray, a: int, b: int, made: int) -> tuple[np.ndarray, np.ndarray]:
    """flat with the pair merged, and where the new symbols stand."""
    return merged_at(flat, places_of(flat, a, b), made)


def merged_at(flat: np.ndarray, at: np.ndarray, made: int) -> tuple[np.ndarray, np.ndarray]:
    """As merged, at the places that are known already."""
    if not len(at):
        return flat, at
    kept = np.ones(len(flat), bool)
    kept[at + 1] = False
    out, stands = flat[kept], at - np.arange(len(at))
    out[stands] = made
    return out, stands


#: Symbols in use up to which pairs are counted in a table of symbols by symbols, and places of a merge from which on it pays.
DENSE, MANY = 2048, 64


def numbered(flat: np.ndarray, more: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols in use and more, ascending from 0, and flat by their numbers among them."""
    seen = np.zeros(max(int(flat.max(initial=0)), *more, 0) + 1, bool)
    seen[flat] = seen[more] = seen[0] = True
    which = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.uint16 if len(which) < 1 << 16 else np.int32)
    place[which] = np.arange(len(which))
    return which, place[flat]


def cells_of(flat: np.ndarray, size: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Neighbours at the places as one number, symbols being numbers below size."""
    cells = flat[:-1][at].astype(np.int64)
    cells *= size
    cells += flat[1:][at]
    return cells


def between(cells: np.ndarray, size: int) -> np.ndarray:
    """Whether a cell is a pair of symbols, neither of them the end of a sequence."""
    return (cells >= size) & (cells % size > 0)


def pairs_of(flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of the pairs of neighbours, ascending, with their first places and how often they are met."""
    cells = cells_of(flat, size)
    if size <= DENSE:
        n, first = np.bincount(cells, minlength=size * size), np.zeros(size * size, np.int64)
        first[cells[::-1]] = np.arange(len(cells))[::-1]  # of a cell that is met again the last assignment stays, which is its first place
        cells = np.flatnonzero(n)
        at, n = first[cells], n[cells]
    else:
        cells, at, n = np.unique(cells, return_index=True, return_counts=True)
    some = between(cells, size)
    return cells[some], at[some], n[some]


def change_of(flat: np.ndarray, a: int, b: int, made: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """flat after the merge, and the cells whose counts it changes, with by how much: only pairs at its places are looked at."""
    at = places_of(flat, a, b)
    if not len(at):
        return flat, at, at
    new, stands = merged_at(flat, at, made)
    table = size <= DENSE and len(at) >= MANY

    def beside(x: np.ndarray, width: tuple[int, ...], n: int) -> np.ndarray:
        if not table:
            return np.unique(np.clip(np.concatenate([x + w for w in width]), 0, n - 2))
        near = np.zeros(n + 2, bool)
        for w in width:
            near[x + w + 1] = True
        return np.flatnonzero(near[1:n])

    old_cells = cells_of(flat, size, beside(at, (-1, 0, 1), len(flat)))
    new_cells = cells_of(new, size, beside(stands, (-1, 0), len(new))) if len(new) > 1 else at[:0]
    if table:
        n = np.bincount(new_cells, minlength=size * size) - np.bincount(old_cells, minlength=size * size)
        cells = np.flatnonzero(n)
        n = n[cells]
    else:
        cells, where = np.unique(np.r_[old_cells, new_cells], return_inverse=True)
        n = np.bincount(where[len(old_cells) :], minlength=len(cells)) - np.bincount(where[: len(old_cells)], minlength=len(cells))
    some = between(cells, size) & (n != 0)
    return new, cells[some], n[some]


class Counts:
    """Pairs (their numbers joined) and how often each is met; for those of a pass the row of its first places too."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.n = codes[order], n[order].astype(np.float64)

    def changed(self, codes: np.ndarray, n: np.ndarray) -> Counts:
        every, at = np.unique(np.r_[self.codes, codes], return_inverse=True)
        return Counts(every, np.maximum(np.bincount(at, np.r_[self.n, n], len(every)), 0.0))

    def of(self, code: int) -> int:
        at = np.searchsorted(self.codes, code)
        return int(self.n[at]) if at < len(self.codes) and self.codes[at] == code else 0

    def expected(self, code: int, made: int) -> Counts:
        """The counts after a merge as they would be if what stands before and behind a pair were independent: only guides the plan."""
        a, b, n = code >> 32, code & LOW, max(self.of(code), 1)
        left, right = self.codes >> 32, self.codes & LOW
        codes, changes = [np.array([code])], [np.array([-float(n)])]
        for side, make in ((right == a, lambda c: (c >> 32 << 32) | made), (left == b, lambda c: (made << 32) | (c & LOW))):
            moved = n * self.n[side] / max(self.n[side].sum(), float(n))
            codes += [self.codes[side], make(self.codes[side])]
            changes += [-moved, moved]
        return self.changed(np.concatenate(codes), np.concatenate(changes))

    def best(self, score: Score) -> np.ndarray:
        """The pairs of the largest score, if that is over 0."""
        if not len(self.codes):
            return self.codes
        values = score(self.codes >> 32, self.codes & LOW, self.n)
        return self.codes[values == values.max()] if values.max() > 0 else self.codes[:0]


def earliest(codes: np.ndarray, ids: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, ascending, with its least (id, place) and the sum of n."""
    order = np.lexsort((pos, ids, codes))
    codes = codes[order]
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])  # none of a task whose blocks have no pairs
    return codes[begin], ids[order][begin], pos[order][begin], np.add.reduceat(n[order], begin)


#: Rows of pairs that a task holds before it sums them up.
PAIRS_HELD = 1 << 18


def pairs_by_task(blocks: DataFrame, pending: list[tuple[int, int, int]], plan: list[tuple[int, int, int]], sizes: dict[int, int]) -> DataFrame:
    """step, pair, n, seq_id, pos: counts and first places of the pairs after the pending merges (step 0), and the changes of counts by each merge of the plan (1, 2, ...).
    A task sums up its blocks, so a row a pair (and step) leaves it; only where ids are no whole numbers, or some are null, does a block's first places leave by themselves."""
    kind = blocks.schema["ids"].dataType.elementType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    shape = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("pair", T.LongType()), T.StructField("n", T.LongType()), T.StructField("seq_id", kind), T.StructField("pos", T.LongType())])

    known = sorted({x for m in (*pending, *plan) for x in m})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        moved: dict[int, list[tuple]] = defaultdict(list)
        rows = more = 0
        named = pa.int64()

        def row(step: int, codes: np.ndarray, n: np.ndarray, ids: pa.Array | None = None, pos: np.ndarray | None = None) -> pa.RecordBatch:
            size = len(codes)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, step, np.int32)), pa.array(codes), pa.array(n), pa.nulls(size, named) if ids is None else ids, pa.nulls(size, pa.int64()) if pos is None else pa.array(pos)], shape.names)

        def summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("flat"), strict=True):
                which, flat = numbered(np.frombuffer(raw.as_buffer(), np.int32), known)
                size, named = len(which), ids.values.type
                steps = [tuple(m) for m in np.searchsorted(which, np.array([*pending, *plan], np.int64).reshape(-1, 3)).tolist()]
                coded = lambda cells: (which[cells // size] << 32) | which[cells % size]  # noqa: B023, E731
                for m in steps[: len(pending)]:
                    flat, _ = merged(flat, *m)
                cells, spot, n = pairs_of(flat, size)
                codes = coded(cells)
                letters = np.r_[0, np.cumsum(np.array([0 if x == 0 else sizes.get(x, 1) for x in which.tolist()], np.int64)[flat])]
                ends = np.flatnonzero(flat == 0)
                of = np.searchsorted(ends, spot)
                begin = np.r_[0, ends + 1][of]
                pos = letters[spot] - letters[begin]
                if whole and not ids.values.null_count:
                    held.append((codes, ids.values.to_numpy().astype(np.int64)[of], pos, n))
                    rows += len(codes)
                    if rows > PAIRS_HELD and len(held) > 1:
                        held = [earliest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                        rows = 0  # what is summed up already counts anew, so the work stays linear
                else:
                    yield row(0, codes, n, ids.values.take(pa.array(of)), pos)
                for step, m in enumerate(steps[len(pending) :], 1):
                    flat, cells, n = change_of(flat, *m, size)
                    if len(cells):
                        moved[step].append((coded(cells), n))
                        more += len(cells)
                if more > PAIRS_HELD:
                    moved = defaultdict(list, {step: [summed(parts)] for step, parts in moved.items()})
                    more = 0
        if held:
            codes, ids, pos, n = earliest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield row(0, codes, n, pa.array(ids).cast(named), pos)
        for step, parts in moved.items():
            yield row(step, *summed(parts))

    return blocks.mapInArrow(run, shape)


def pass_over(blocks: DataFrame, pending: list[tuple[int, int, int]], plan: list[tuple[int, int, int]], sizes: dict[int, int]) -> tuple[Counts, dict, list[tuple]]:
    """Counts and first places (sequence, letter) of all pairs after the pending merges, and the changes of counts by each merge of the plan after these."""
    first = F.min(F.when(F.col("pos").isNotNull(), F.struct("seq_id", "pos")))
    found = pairs_by_task(blocks, pending, plan, sizes).groupBy("step", "pair").agg(F.sum("n").alias("n"), first.alias("first")).where("n <> 0").toArrow().combine_chunks()
    step, pair, n = (found.column(c).to_numpy() for c in ("step", "pair", "n"))
    base = np.flatnonzero(step == 0)
    at = dict(zip(pair[base].tolist(), base.tolist(), strict=True))
    firsts = found.column("first")
    return Counts(pair[base], n[base]), lambda code: tuple(firsts[at[code]].as_py().values()), [(pair[step == k], n[step == k]) for k in range(1, len(plan) + 1)]


Score = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
LOW = 0xFFFFFFFF


def disjoint(ordered: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The first pairs, in their order, of which no two share a symbol."""
    used: set[int] = set()
    out = []
    for pair in ordered:
        if not set(pair) & used:
            used |= set(pair)
            out.append(pair)
            if len(out) == most:
                break
    return out


class Merging:
    """The state of a run: blocks, the merges that they are behind, and the names of symbols."""

    def __init__(self, sequences: DataFrame, ahead: int):
        self.blocks, self.ahead = stored(packed(sequences)), ahead
        self.pending: list[tuple[int, int, int]] = []
        self.history: list[dict] = []
        self.names: dict[int, str] = {}
        self.made = FIRST_MERGED

    def name(self, symbol: int) -> str:
        return self.names[symbol] if symbol >= FIRST_MERGED else chr(symbol)

    def take(self, code: int, n: int, level: int) -> tuple[int, int, int]:
        a, b = code >> 32, code & LOW
        self.names[self.made] = self.name(a) + self.name(b)
        self.history.append({"step": len(self.history), "level": level, "a": self.name(a), "b": self.name(b), "n": int(n)})
        merge = (a, b, self.made)
        self.pending.append(merge)
        self.made += 1
        return merge

    def caught_up(self) -> None:
        """Write the blocks with the pending merges done."""
        pending = list(self.pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for raw in batch.column("flat"):
                    flat = np.frombuffer(raw.as_buffer(), np.int32)
                    for m in pending:
                        flat, _ = merged(flat, *m)
                    out.append(flat.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("ids"), pa.array(out, pa.binary())], ["ids", "flat"])

        self.blocks, self.pending = stored(self.blocks.mapInArrow(run, self.blocks.schema)), []

    def counted(self, plan: list[tuple[int, int, int]]) -> tuple:
        if len(self.pending) >= BEHIND:
            self.caught_up()
        return pass_over(self.blocks, self.pending, plan, {s: len(n) for s, n in self.names.items()})

    def run(self, rounds: int, score: Callable[[Merging], Score]) -> None:
        guess = Counts(np.zeros(0, np.int64), np.zeros(0))
        while len(self.history) < rounds:
            plan, made = [], self.made
            for _ in range(min(self.ahead, rounds - len(self.history))):
                top = guess.best(score(self)).tolist()
                if not top:
                    break
                plan.append((top[0] >> 32, top[0] & LOW, made))
                guess = guess.expected(top[0], made)
                made += 1
            counts, first_of, changes = self.counted(plan)
            touched: set = set()
            for k in range(len(plan) + 1):
                tied = counts.best(score(self)).tolist()
                if len(self.history) == rounds or not tied:
                    return
                if len(tied) > 1 and touched & set(tied):
                    break  # their first places are to be found anew
                code = tied[0] if len(tied) == 1 else min(tied, key=first_of)
                merge = self.take(code, counts.of(code), len(self.history))
                if k == len(plan) or plan[k] != merge:
                    counts = counts.expected(code, merge[2])
                    break
                counts = counts.changed(*changes[k])
                touched |= set(changes[k][0].tolist())
            guess = counts

    def run_levels(self, rounds: int, score: Callable[[Merging], Score], width: int) -> None:
        for level in range(rounds):
            counts, first_of, _ = self.counted([])
            values = score(self)(counts.codes >> 32, counts.codes & LOW, counts.n) if len(counts.codes) else counts.n
            ordered = sorted(((-v, first_of(c), c) for v, c in zip(values.tolist(), counts.codes.tolist(), strict=True) if v > 0), key=lambda x: x[:2])
            chosen = disjoint([(c >> 32, c & LOW) for _, _, c in ordered], width)
            if not chosen:
                return
            for a, b in chosen:
                self.take(a << 32 | b, counts.of(a << 32 | b), level)

    def rows(self) -> DataFrame:
        """seq_id, symbols of every sequence after the merges."""
        pending, names = list(self.pending), dict(self.names)
        kind = self.blocks.schema["ids"].dataType.elementType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, raw in zip(batch.column("ids"), batch.column("flat"), strict=True):
                    flat = np.frombuffer(raw.as_buffer(), np.int32)
                    for m in pending:
                        flat, _ = merged(flat, *m)
                    ends = np.flatnonzero(flat == 0)
                    which, at = np.unique(flat[flat > 0], return_inverse=True)
                    words = pa.array([names[x] if x >= FIRST_MERGED else chr(x) for x in which.tolist()], pa.string()).take(pa.array(at))
                    offsets = np.r_[0, ends - np.arange(len(ends))].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(pa.array(offsets), words)], ["seq_id", "symbols"])

        return self.blocks.mapInArrow(run, T.StructType([T.StructField("seq_id", kind), T.StructField("symbols", T.ArrayType(T.StringType()))]))


def byte_pair_merges(sequences: DataFrame, rounds: int = 300, least: int = 5, width: int = 1, ahead: int = 16) -> tuple[DataFrame, list[dict]]:
    """The sequences (seq_id, seq) as rows (seq_id, symbols) after up to rounds rounds, and the merges (step, level, a, b, n).

    A round merges the most frequent pair of neighbours (overlapping ones count), ties by the least seq_id and place, while it is met at least
    `least` times; width over 1 merges that many pairs of disjoint symbols a round, counted once. ahead: merges a pass tries to
    foresee; it changes no result. Null and empty sequences have no symbols; an empty table gives no rows and no merges.
    """
    state = Merging(sequences, ahead)
    frequent = lambda _: lambda a, b, n: np.where(n >= least, n, 0.0)
    state.run(rounds, frequent) if width == 1 else state.run_levels(rounds, frequent, width)
    return state.rows(), state.history


def informative_merges(sequences: DataFrame, rounds: int = 300, least: int = 5, ahead: int = 16) -> tuple[DataFrame, list[dict]]:
    """As byte_pair_merges, by positive pointwise information times log2(1 + n) instead of the count; ends when no pair has any."""

    def score(_: Merging) -> Score:
        def value(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
            sums = [np.bincount(at, n)[at] for at in (np.unique(side, return_inverse=True)[1] for side in (a, b))]
            beside = sums[0] * sums[1]
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.round(np.maximum(np.log2(n * n.sum() / beside), 0) * np.log2(n + 1), 9)
            return np.where(n >= least, found, 0.0)

        return value

    state = Merging(sequences, ahead)
    state.run(rounds, score)
    return state.rows(), state.history


def diverse_merges(sequences: DataFrame, rounds: int = 300, least: int = 5, most: int = 50, ahead: int = 16) -> tuple[DataFrame, list[dict]]:
    """As byte_pair_merges, with at most `most` merges whose piece begins with the same letter."""

    def score(state: Merging) -> Score:
        begun: dict[str, int] = defaultdict(int)
        for h in state.history:
            begun[h["a"][0]] += 1

        def value(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
            # a symbol that is only planned has no name yet: any letter will do for a plan
            kept = np.array([begun[state.names.get(x, " ")[0] if x >= FIRST_MERGED else chr(x)] < most for x in a.tolist()], bool)
            return np.where((n >= least) & kept, n, 0.0)

        return value

    state = Merging(sequences, ahead)
    state.run(rounds, score)
    return state.rows(), state.history


def decoded(rows: DataFrame) -> DataFrame:
    """seq_id, seq: the letters again."""
    return rows.select("seq_id", F.array_join("symbols", "").alias("seq"))


def lengths(rows: DataFrame) -> DataFrame:
    """length, n: symbols in use by their number of letters."""
    return rows.select(F.explode("symbols").alias("x")).groupBy(F.length("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
