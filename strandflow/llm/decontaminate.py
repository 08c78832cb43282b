"""Benchmark decontamination: passages of test items found in documents by one Aho-Corasick automaton over word numbers.

Items become windows of consecutive normalised words; the automaton's symbols are the numbers of the windows' words, so
a document is scanned once, a word a step, whatever the number of windows. Normalising replaces byte by byte, so a word's
place is its place in the original, and hits come back as spans of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.llm.shared import FOLDED, drop_columns, folded_words, mapped, named, slices, written

#: Rows of item_windows' output batches.
BATCH = 1 << 16
NEW = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>, _runs array<int>"


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """window, item: the distinct windows of width consecutive words of each item, words joined by one space; an item of fewer words is one window, one of none has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for item, raw in zip(part.column("item").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = folded_words(raw)
                ends = range(width, len(words) + 1) if len(words) > width else [len(words)] if words else []
                for k in range(0, len(ends), BATCH):
                    found = [b" ".join(words[max(0, e - width) : e]) for e in ends[k : k + BATCH]]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array([item] * len(found), pa.string())], ["window", "item"])

    return items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(run, "window string, item string").distinct()


class Matcher:
    """The automaton of (window, item) pairs."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        self.numbers: dict[bytes, int] = {}
        windows: dict[bytes, list[str]] = {}
        for window, item in pairs:
            own = windows.setdefault(window.encode(), [])
            if item is not None:
                own.append(item)
        self.items, self.lengths = list(windows.values()), np.zeros(len(windows), np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, window in enumerate(windows):
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.split())
            self.lengths[k] = len(key)
            self.automaton.add_word(key, k)
        if windows:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last word of each occurring window, and the windows. Words that no window holds are 0."""
        if not words or not self.items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = list(self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))))
        return np.array(found, np.int64).reshape(-1, 2).T


_matchers: dict[str, Matcher] = {}


def matcher_of(name: str, pairs: list[tuple[str, str | None]]) -> Matcher:
    """A worker builds an automaton once and keeps the last one for its further tasks."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(pairs)
    return _matchers[name]


def spans_of(raw: bytes, runs: np.ndarray) -> list[dict[str, int]]:
    """Character offsets in the text (from 0, end exclusive) of runs of words (rows of first place and place behind the last)."""
    codes = np.frombuffer(raw, np.uint8)
    inside = np.r_[False, np.frombuffer(raw.translate(FOLDED), np.uint8) != 32, False]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    before = np.r_[0, np.cumsum((codes & 0xC0) != 0x80)]  # characters before each byte
    return [{"start": int(before[starts[a]]), "end": int(before[ends[b - 1]])} for a, b in runs]


def scanned(rows: DataFrame, text: str, pairs: list[tuple[str, str | None]], keep_text: bool) -> DataFrame:
    """rows with NEW; where rows have these already, with the hits of these pairs added to them."""
    before = "_runs" in rows.columns
    rows = rows.withColumnsRenamed({"items": "_items_before", "_runs": "_runs_before"}).drop("n_words", "n_hit", "spans") if before else rows
    plain = rows.columns.index(text)
    name, schema = uuid.uuid4().hex, T.StructType.fromDDL(NEW)
    held = [i for i in range(len(rows.columns)) if keep_text or i != plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher_of(name, pairs)
        for part in slices(batches, plain):
            out: dict[str, list] = {f.name: [] for f in schema}
            earlier = zip(*(part.column(c).to_pylist() for c in ("_items_before", "_runs_before")), strict=True) if before else repeat(((), ()))
            for raw, (old_items, old_runs) in zip(part.column(plain).cast(pa.binary()).to_pylist(), earlier):
                words = folded_words(raw)
                ends, which = own.matches(words)
                runs, items = np.reshape(np.array(old_runs, np.int64), (-1, 2)), set(old_items)
                if len(ends):
                    # places where windows open and close; a word is hit where more have opened than closed
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.r_[ends + 1 - own.lengths[which], runs[:, 0]], 1)
                    np.add.at(change, np.r_[ends + 1, runs[:, 1]], -1)
                    hit = np.r_[False, np.cumsum(change[:-1]) > 0, False]
                    runs = np.c_[np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])]
                    items.update(*(own.items[w] for w in set(which.tolist())))
                row = (len(words), int((runs[:, 1] - runs[:, 0]).sum()), sorted(items), spans_of(raw, runs) if len(runs) else [], runs.ravel().tolist())
                for k, value in zip(out, row, strict=True):
                    out[k].append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int32())]
            names = part.schema.names
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in held), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], [*(names[i] for i in held), *out])

    found = mapped(rows, run, schema, without=None if keep_text else text)
    return found.drop("_items_before", "_runs_before") if before else found


def contaminated(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, keep_text: bool = True, most_pairs: int = 200_000) -> DataFrame:
    """df (without its text if keep_text is False) with n_words, n_hit, items (sorted ids, as strings, of the items that occur) and spans
    (character offsets of the hit stretches in the original text).

    Words are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is width consecutive words of
    an item, or all words of a shorter one; every word inside an occurrence of a window is hit. Overlapping windows count a word once.

    The automaton goes to the workers, so it is bounded: beyond most_pairs windows of items, they are dealt by hash to several automata, and the
    rows pass them one after another in the same tasks (written between every four), each adding to what the earlier found. Nothing of df is shuffled.

    Null and empty texts have no words. Repeated rows get equal values. An item whose id is null hits words but is not named; texts
    that repeat an item_id are one item's. Without items nothing is hit; an empty df gives no rows. Columns of df named like the new ones are replaced.
    """
    df = drop_columns(df, "n_words", "n_hit", "items", "spans", "_runs", "_items_before", "_runs_before")
    pairs = written(item_windows(items, item_id, item_text, width), "windows")
    parts = max(1, -(-pairs.count() // most_pairs))
    rows = df
    for p in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == p).collect()  # about most_pairs rows
        rows = scanned(rows, text, [(r.window, r.item) for r in own], keep_text or p < parts - 1)
        if p % 4 == 3 and p < parts - 1:
            rows = written(rows, "scanned")
    return rows.select(*[named(c) for c in rows.columns if c != "_runs"])
