"""BPE encoding and decoding in batched numpy merge rounds, for tokenizers-library files with word-end pieces."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.shared import SLICE_BYTES, drop_columns, listed, mapped, slices

#: Words whose pieces a Python worker remembers; the memory is emptied beyond that, which changes no result.
REMEMBERED_WORDS = 400_000

#: Unicode's White_Space, which the file's pattern names \s.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.pieces = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = piece
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.pieces[i] = text
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.size = len(self.pieces)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.size + right)[order], order, made[order]
        born = np.full(self.size, -1)
        born[made] = np.arange(len(made))
        #: Whether each piece has one merge, after its parts': then no merge opens a lower-ranked pair than itself,
        #: and all places of a word's lowest pair can be merged in one round.
        self.whole_rounds = len(np.unique(made)) == len(made) and bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.held = 0

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in one flat array, and each word's number of ids."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        while len(ids):
            paired = np.flatnonzero(owner[:-1] == owner[1:])
            key = ids[paired] * self.size + ids[paired + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            paired, at = paired[hit], at[hit]
            rank, own = self.ranks[at], owner[paired]
            live = np.zeros(len(words), bool)
            live[own] = True
            over = ~live[owner]
            if over.any():  # words without a pair are done
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                moved = np.cumsum(~over) - 1
                ids, owner, paired = ids[~over], owner[~over], moved[paired]
            if not len(paired):
                continue
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(own)]))
            chosen = rank == lowest
            place, piece, own = paired[chosen], self.made[at[chosen]], own[chosen]
            if self.whole_rounds:  # overlapping places, as in aaa, go from the left: every second of a run
                breaks = np.r_[True, np.diff(place) != 1]
                run = np.flatnonzero(breaks)
                take = (np.arange(len(place)) - run[np.cumsum(breaks) - 1]) % 2 == 0
            else:
                take = np.r_[True, own[1:] != own[:-1]]
            place = place[take]
            ids[place] = piece[take]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            ids, owner = ids[keep], owner[keep]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def words(self, text: str) -> list[str]:
        """The text's words and special strings, in order."""
        parts = self.split.split(text) if self.split else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part:
                plain = unicodedata.normalize("NFC", part) if not part.isascii() else part
                # letter by letter as the file's normaliser: no final form of sigma
                out += WORD.findall(plain.replace("Σ", "σ").lower())
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each, as a list array has them. A null text is empty."""
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        known, new, places, counts = self.known, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            found = self.words(text)
            for w in set(found).difference(known):
                known[w] = len(known)
                new.append(w)
            places.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            counts[i] = len(found)
        if new:
            plain = [w for w in new if w not in self.special]
            ids, lengths = self.merge_words(plain)
            if len(plain) < len(new):
                each, parts, k = np.split(ids, np.cumsum(lengths)[:-1]) if plain else [], [], 0
                for w in new:
                    if w in self.special:
                        parts.append(np.array([self.special[w]], np.int32))
                    else:
                        parts.append(each[k])
                        k += 1
                ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
            self.flat.append(ids)
            self.starts.append(self.held + np.cumsum(lengths) - lengths)
            self.held += len(ids)
            self.flat, self.starts = [np.concatenate(self.flat)], [np.concatenate(self.starts)]
        words = np.concatenate(places) if places else np.zeros(0, np.int64)
        bounds = np.r_[self.starts[0], self.held]
        lengths = np.diff(bounds)[words]
        total = np.r_[0, np.cumsum(lengths)]
        spread = np.arange(total[-1]) + np.repeat(self.starts[0][words] - total[:-1], lengths)
        return self.flat[0][spread], total[np.r_[0, np.cumsum(counts)]]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode of a file without decoder: the pieces, special ones too, joined by a space."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df with ids array<int> and n_tokens bigint of the whole texts.

    vocabulary: path of the file on every worker. Null and empty texts have no ids. Rows are independent, so repeats,
    ties and empty tables need no care; columns named ids or n_tokens are replaced. Texts are taken in slices of some
    megabytes; a longer one is a slice of its own and takes some 40 times its bytes while it is merged.
    """
    df = drop_columns(df, "ids", "n_tokens")
    if text not in df.columns:
        raise ValueError(f"no column {text}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for part in slices(batches, text, SLICE_BYTES):
            ids, offsets = bpe.encode(part.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(offsets))], [*part.schema.names, "ids", "n_tokens"])

    return mapped(df, run, "ids array<int>, n_tokens bigint")


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", slice_ids: int = 1 << 18) -> DataFrame:
    """df with decoded, the text of the ids. Null and empty ids give an empty text; a null within ids or an id that the file lacks is an error.

    A slice of slice_ids ids or one row is decoded at once; a column of df named decoded is replaced; an empty df gives no rows.
    """
    df = drop_columns(df, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for part in listed(batches, ids, slice_ids):
            values = part.column(ids).flatten()
            if values.null_count or (len(values) and not 0 <= pa.compute.min(values).as_py() <= pa.compute.max(values).as_py() < bpe.size):
                raise ValueError(f"{ids} holds a null or an id beyond the vocabulary")
            texts = [bpe.decode(x.values.to_numpy()) if x.is_valid else "" for x in part.column(ids)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return mapped(df, run, "decoded string")


def ids_digest(ids: str = "ids"):
    """sha256, in hex, of the decimal ids joined by a space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256)
