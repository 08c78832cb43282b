"""Ranked lexical search by pipelined term partitioning.

Query evaluation follows Moffat, Webber, Zobel and Baeza-Yates, "A pipelined architecture for distributed text query
evaluation" (2007): terms have owners, each holding the postings of its terms, and a bundle of queries visits the owners one
after another with its accumulators, to which an owner adds what its terms contribute. Here an owner's postings are cut by blocks of documents
too, so a bundle is some items against one block: all that meets in a task is bounded, and every owner works at every stage, as bundles
start at different owners. Contributions are 64-bit integers, so their order doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.shared import folded_words, slices, written

POSTED = "block bigint, owner int, n_docs bigint, n_terms bigint, n_ids int, doc_ids binary, lengths binary, terms array<int>, dfs array<int>, docs binary, tfs binary"
BUNDLE = "block bigint, bundle int, owner int, n_ids int, doc_ids binary, places binary, scores binary"
#: Stages between two written tables, so that a lost executor costs few of them.
STAGES_A_WRITE = 8


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, term, times: the terms of each item over its distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for item, raw in zip(part.column("item_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = folded_words(raw)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(words), pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], ["item_id", "term"])

    once = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).distinct()
    return once.mapInArrow(run, "item_id bigint, term string").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def posted(docs: DataFrame, doc_id: str, text: str, terms: dict[bytes, int], owners: int, block_docs: int) -> DataFrame:
    """The postings of the terms in whole documents, a row an owner and block of up to block_docs documents: n_docs and n_terms are what the block adds to
    N and L (in owner 0's row); doc_ids (nulls last: the first n_ids hold), and lengths of the documents with any of the terms; terms with dfs, and docs (places
    in the block) with tfs, by term."""

    def flushed(block: int, held: list[tuple], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda h: (h[0] is None, h[0] or 0))  # so that places go by doc_id
        ids = np.array([h[0] for h in held if h[0] is not None], np.int64)
        lengths = np.array([h[1] for h in held], np.int64)
        doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        term, tf = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in held)]) for i in (2, 3))
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        for owner in range(owners):
            own = term % owners == owner
            u, dfs = np.unique(term[own], return_counts=True)
            columns = [[block], [owner], [n_docs if owner == 0 else 0], [n_terms if owner == 0 else 0], [len(ids)], [ids.tobytes()], [lengths.tobytes()], [u.astype(np.int32)], [dfs.astype(np.int32)], [doc[own].astype(np.int32).tobytes()], [tf[own].astype(np.int64).tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in POSTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n_docs, n_terms = TaskContext.get().partitionId() << 32, [], 0, 0
        for part in slices(batches, "text"):
            for own_id, raw in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = folded_words(raw)
                n_docs, n_terms = n_docs + (len(words) > 0), n_terms + len(words)
                known = np.array([t for t in map(terms.get, words) if t is not None], np.int64)
                if len(known):
                    held.append((own_id, len(words), *np.unique(known, return_counts=True)))
                if len(held) == block_docs:
                    yield from flushed(block, held, n_docs, n_terms)
                    block, held, n_docs, n_terms = block + 1, [], 0, 0
        if n_docs:
            yield from flushed(block, held, n_docs, n_terms)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, POSTED)


class Question:
    """What a bundle asks of an owner: terms (sorted), and for each the items (places in the bundle) and their factors, times * weight."""

    def __init__(self, asked: list[tuple[int, int, int]]):
        by_term: dict[int, list[tuple[int, int]]] = {}
        for term, item, factor in asked:
            by_term.setdefault(term, []).append((item, factor))
        self.terms = np.array(sorted(by_term), np.int64)
        self.items = [by_term[t] for t in self.terms.tolist()]


def searched(postings: DataFrame, questions: dict[tuple[int, int], Question], bundles: int, bundle_items: int, owners: int, block_docs: int, n: int, total: int) -> DataFrame:
    """BUNDLE rows after all stages: places (item in the bundle * block_docs + document in the block) with scores above 0."""

    def stage(left: pa.Table, right: pa.Table) -> pa.Table:
        # one row of an owner and block on the right, the bundles that are at this owner with this block on the left
        post = right.to_pylist()[0]
        terms, dfs = np.array(post["terms"], np.int64), np.array(post["dfs"], np.int64)
        first = np.r_[0, np.cumsum(dfs)]
        docs, tf = np.frombuffer(post["docs"], np.int32), np.frombuffer(post["tfs"], np.int64)
        lengths = np.frombuffer(post["lengths"], np.int64)
        m = 75 + np.array([(25 * k * n) // total for k in lengths.tolist()], np.int64)
        value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
        places, scores = [], []
        for row in left.select(["bundle", "places", "scores"]).to_pylist():
            held = np.zeros((bundle_items, block_docs), np.int64)
            held.reshape(-1)[np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["scores"], np.int64)
            question = questions.get((row["bundle"], post["owner"]))
            if question and len(terms):
                at = np.minimum(np.searchsorted(terms, question.terms), len(terms) - 1)
                for k in np.flatnonzero(terms[at] == question.terms):
                    some = slice(first[at[k]], first[at[k] + 1])
                    for item, factor in question.items[k]:
                        held[item, docs[some]] += factor * value[some]
            flat = np.flatnonzero(held)
            places.append(flat.astype(np.int32).tobytes())
            scores.append(held.reshape(-1)[flat].tobytes())
        return pa.Table.from_arrays([left.column("block"), left.column("bundle"), pa.array([(o + 1) % owners for o in left.column("owner").to_pylist()], pa.int32()), left.column("n_ids"), left.column("doc_ids"), pa.array(places, pa.binary()), pa.array(scores, pa.binary())], left.schema.names)

    blocks = postings.where("owner = 0").withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    state = blocks.select("block", "bundle", (F.col("bundle") % owners).cast("int").alias("owner"), "n_ids", "doc_ids", F.lit(b"").alias("places"), F.lit(b"").alias("scores"))
    owned = postings.select("block", "owner", "lengths", "terms", "dfs", "docs", "tfs").groupBy("block", "owner")
    for k in range(owners):
        state = state.groupBy("block", "owner").cogroup(owned).applyInArrow(stage_of(stage, BUNDLE), BUNDLE)
        if k % STAGES_A_WRITE == STAGES_A_WRITE - 1 and k < owners - 1:
            state = written(state, "bundles")
    return state


def stage_of(stage, schema: str):
    """stage, for groups that have both sides; an owner that no bundle is at gives no rows."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    empty = pa.schema([pa.field(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return stage(left.select(names), right) if left.num_rows else empty

    return run


def best_of_blocks(state: DataFrame, items: list[list[int | None]], block_docs: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best documents of each item in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places, scores = np.frombuffer(row["places"], np.int32), np.frombuffer(row["scores"], np.int64)
                item, doc = places // block_docs, places % block_docs
                order = np.lexsort((doc, -scores, item))  # documents stand by doc_id
                item, doc, scores = item[order], doc[order], scores[order]
                begin = np.searchsorted(item, item)
                top = np.arange(len(item)) - begin < k
                ids = np.frombuffer(row["doc_ids"], np.int64)
                named = [int(ids[d]) if d < row["n_ids"] else None for d in doc[top]]
                own = items[row["bundle"]]
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in item[top]], pa.int64()), pa.array(named, pa.int64()), pa.array(scores[top])], ["item_id", "doc_id", "score"])

    return state.select("bundle", "n_ids", "doc_ids", "places", "scores").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 20,
    owners: int = 4,
    bundle_items: int = 64,
    block_docs: int = 4096,
    pass_items: int = 1024,
    pass_terms: int = 1 << 18,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII in whole texts, A-Z lower-cased. With N documents that have a term, L terms in
    all and df documents with a term, its weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms has m = 75 + (25 * n * N) div L and
    scores weight * ((10^9 * tf) div (1000 * tf + 12 * m)) for each of the item's terms, repeats included. Equal scores go by ascending doc_id.

    A task holds a block of block_docs documents' postings of one owner and bundles of bundle_items items against it. Items' terms go to
    the workers, so they are bounded: beyond pass_items items or pass_terms terms, items are dealt by hash to several passes over the documents.

    Null and empty texts have no terms and are not counted. Repeated rows are documents each; a null doc_id comes last among ties. Equal rows of items count
    once, different texts of one item_id are one item's; a null item_id is an item. Items without terms, or that no document shares one with,
    give no rows; so do empty tables. Other columns are ignored.
    """
    asked = written(item_terms(items, item_id, item_text), "item_terms")
    n_items, n_pairs = asked.agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), F.count(F.lit(1))).first()
    passes = max(1, -(-n_items // pass_items), -(-n_pairs // pass_terms))
    found = None
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()  # about pass_terms rows, or pass_items items
        if own:
            part = one_pass(docs, own, doc_id, text, k, owners, bundle_items, block_docs)
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def one_pass(docs: DataFrame, asked: list, doc_id: str, text: str, k: int, owners: int, bundle_items: int, block_docs: int) -> DataFrame:
    numbers = {t: i for i, t in enumerate(sorted({r.term for r in asked}))}
    postings = written(posted(docs, doc_id, text, {t.encode(): i for t, i in numbers.items()}, owners, block_docs), "postings")
    n, total = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = postings.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
    dfs = {r.terms: r.df for r in held.collect()}  # a row a term of the items
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in dfs.items()}
    ids = sorted({r.item_id for r in asked}, key=lambda i: (i is None, i or 0))
    place = {i: divmod(j, bundle_items) for j, i in enumerate(ids)}
    questions: dict[tuple[int, int], list] = {}
    for r in asked:
        term = numbers[r.term]
        if term in weights:
            bundle, item = place[r.item_id]
            questions.setdefault((bundle, term % owners), []).append((term, item, r.times * weights[term]))
    bundles = -(-len(ids) // bundle_items)
    state = searched(postings, {key: Question(q) for key, q in questions.items()}, bundles, bundle_items, owners, block_docs, n, total)
    return best_of_blocks(state, [ids[b * bundle_items : (b + 1) * bundle_items] for b in range(bundles)], block_docs, k)
