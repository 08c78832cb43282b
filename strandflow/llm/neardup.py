"""Near-duplicate groups by MinHash bands, sequential Bayesian pruning and exact verification.

1. A text's words (ASCII lower case) become the set of its distinct k-word shingles, a 128-bit digest of that set and
   a MinHash signature. Texts with equal sets are one class, whose least doc_id stands for it from here on; so copies,
   however many, meet only in a count of their class.
2. Signatures are cut into bands; a bucket is a band's value that at least two classes share. Buckets are gathered by
   leader, the member that most others share buckets with, so a cluster whose members meet in many bands is one group,
   in which every candidate pair of those buckets lies. Large groups are dealt into blocks of bounded size.
3. In a group the leader meets every member, and members that it is not linked with meet the others, but for those
   that links have joined with them already. No pair is ever a row: only links leave a task, and as few as connect.
   Candidates meet the signatures batch by batch (Satuluri and Parthasarathy, "Bayesian locality sensitive hashing
   for fast similarity search", 2012): with m agreements in n, the posterior of the similarity is Beta(m+1, n-m+1),
   and a pair goes as soon as the threshold's posterior tail falls below the miss probability.
4. Survivors are verified on the full shingle sets, and components of the links are found by alternating large and
   small stars.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.shared import deleted, mapped, slices, written

#: Words whose hashes a Python worker remembers; emptied beyond that, which changes no result.
REMEMBERED_WORDS = 500_000
#: Shares into which a large group's rows are dealt where they meet its size.
SALTS = 64

#: The multipliers of splitmix64.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets and signatures of texts."""

    def __init__(self, words: int, hashes: int):
        self.words = words
        rng = np.random.Generator(np.random.PCG64(20150117))
        self.a = rng.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, hashes, np.uint64)
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted 64-bit hashes of the distinct shingles. bytes.split cuts at just the six ASCII white spaces."""
        found = (text or "").encode().lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mixed(out + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    def signature(self, sets: np.ndarray) -> np.ndarray:
        """The low 16 bits of the least of each hash over the set; blocks bound the memory."""
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for k in range(0, len(sets), 2048):
            x = sets[None, k : k + 2048] * self.a[:, None] + self.b[:, None]
            np.minimum(low, (x >> np.uint64(32)).astype(np.uint32).min(axis=1), out=low)
        # 16 bits are kept: unequal ones that look equal (1 in 65,536) can only keep a pair for the exact check
        return low.astype(np.uint16)


@functools.lru_cache(maxsize=4)
def shingler(words: int, hashes: int) -> Shingler:
    return Shingler(words, hashes)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A merge join at every size: both sides grow with the corpus, so neither is ever broadcast, and the plan that small inputs
    show is the plan of large ones."""
    return left.join(right.hint("merge"), on, how)


def text_keys(text: str) -> dict[str, Column]:
    """Two 64-bit hashes by which a text is found again without being carried along."""
    return {"text_a": F.xxhash64(F.col(text)), "text_b": F.xxhash64(F.lit(1), F.col(text))}


def features(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """doc_id, text_a, text_b, n_shingles, digest_a, digest_b, signature of each row (doc_id, text, text_a, text_b); sets without shingles have no digest and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(words, hashes)
        for part in slices(batches, "text"):
            sizes, digests, signatures = [], [], []
            for t in part.column("text").to_pylist():
                s = own.shingles(t)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None)
                signatures.append(own.signature(s).tobytes() if len(s) else None)
            half = lambda d, k: None if d is None else ((d >> k) & (2**64 - 1)) - (1 << 63)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "text_a", "text_b")), pa.array(sizes, pa.int64()), pa.array([half(d, 64) for d in digests], pa.int64()), pa.array([half(d, 0) for d in digests], pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "text_a", "text_b", "n_shingles", "digest_a", "digest_b", "signature"],
            )

    return docs.mapInArrow(run, "doc_id bigint, text_a bigint, text_b bigint, n_shingles bigint, digest_a bigint, digest_b bigint, signature binary")


def with_shingles(rows: DataFrame, words: int, hashes: int) -> DataFrame:
    """rows with shingles, the sorted hashes of the set, in the place of text."""
    kept = [f.name for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(words, hashes)
        for part in slices(batches, "text"):
            sets = [own.shingles(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sets, pa.binary())], [*kept, "shingles"])

    return mapped(rows, run, "shingles binary", without="text")


def least_agreements(hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n compared hashes a pair with fewer than m agreements goes, as Pr(similarity >= threshold | it) < miss.

    With a uniform prior that tail is the chance of at most m successes in n + 1 draws of probability threshold.
    """
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        tail = m = 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return out


class Verifier:
    """Links among the texts of a group."""

    def __init__(self, hashes: int, batch: int, percent: int, miss: float):
        self.hashes, self.percent = hashes, percent
        self.bounds = least_agreements(hashes, batch, percent / 100, miss)

    def survivors(self, one: int, others: np.ndarray, signatures: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Those of others that neither their size nor a batch of signatures rules out, most agreements first."""
        low, high = np.minimum(sizes[one], sizes[others]), np.maximum(sizes[one], sizes[others])
        others = others[100 * low >= self.percent * high]
        agree, done = np.zeros(len(others), np.int64), 0
        for n, m in self.bounds:
            agree = agree + (signatures[others, done:n] == signatures[one, done:n]).sum(axis=1)
            kept = agree >= m
            others, agree, done = others[kept], agree[kept], n
            if not len(others):
                break
        return others[np.argsort(-agree, kind="stable")]

    def linked(self, one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Whether each full set is similar enough to the first."""
        flat, lengths = np.concatenate(others), np.array([len(s) for s in others])
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        shared = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]])
        return 100 * shared >= self.percent * (len(one) + lengths - shared)

    def links(self, sets: list[np.ndarray], signatures: np.ndarray, first: np.ndarray, others: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect all that similarity connects between first and others, places in sets; side, the
        component of each place so far, is brought up to date, and pairs of one component are passed over."""
        sizes, found = np.array([len(s) for s in sets]), []
        for x in first:
            alive = self.survivors(x, others[side[others] != side[x]], signatures, sizes)
            while len(alive):
                some, alive = alive[:32], alive[32:]
                good = some[self.linked(sets[x], [sets[y] for y in some])]
                for y in good:
                    if side[y] != side[x]:
                        found.append((int(x), int(y)))
                        side[side == side[y]] = side[x]
                alive = alive[side[alive] != side[x]]
        return found


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Groups of a stream that is sorted by the bigint keys, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.r_[0, 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def unpacked(group: pa.Table, hashes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, signatures and sets of a group's rows."""
    signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(-1, hashes)
    return group.column("node").to_numpy(), signatures, [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]


LINK_SCHEMA = "leader bigint, block bigint, a bigint, b bigint"


def links_in_groups(profiles: DataFrame, check: Verifier) -> DataFrame:
    """leader, block, a, b: links within each block, of which the leader is a row. Stray members, those that the leader
    is not linked with, come as links (a, null) too where a group has several blocks, for links_across_blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ("leader", "block")):
            leader, block, blocks = (group.column(c)[0].as_py() for c in ("leader", "block", "blocks"))
            ids, signatures, sets = unpacked(group, check.hashes)
            side, everyone = np.arange(len(ids)), np.arange(len(ids))
            head = np.flatnonzero(ids == leader)[:1]
            found = check.links(sets, signatures, head, everyone, side)
            strays = everyone[side != side[head[0]]]
            found += check.links(sets, signatures, strays, everyone, side)
            a, b = [int(ids[x]) for x, _ in found], [int(ids[y]) for _, y in found]
            if blocks > 1:
                a += ids[strays].tolist()
                b += [None] * len(strays)
            yield pa.RecordBatch.from_arrays([pa.array([leader] * len(a), pa.int64()), pa.array([block] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["leader", "block", "a", "b"])

    return profiles.repartition("leader", "block").sortWithinPartitions("leader", "block", "node").mapInArrow(run, LINK_SCHEMA)


def links_across_blocks(profiles: DataFrame, strays: DataFrame, check: Verifier) -> DataFrame:
    """leader, block, a, b: links of strays (leader, stray_block, node) with the members of all other blocks of their group, a block of each a task."""
    marked = met(profiles, strays.select("leader", "node", F.lit(1).alias("stray")), ["leader", "node"], "left")
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: k != F.col("block"))
    asked = marked.where("stray = 1").select("leader", F.explode(others).alias("block"), F.col("block").alias("stray_block"), F.lit(0).alias("kind"), "node", "signature", "shingles")
    sought = strays.select("leader", F.col("block").alias("stray_block")).distinct()
    members = met(profiles, sought, "leader").where("block != stray_block").select("leader", "block", "stray_block", F.lit(1).alias("kind"), "node", "signature", "shingles")
    rows = asked.union(members).repartition("leader", "block", "stray_block").sortWithinPartitions("leader", "block", "stray_block", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ("leader", "block", "stray_block")):
            ids, signatures, sets = unpacked(group, check.hashes)
            kind = group.column("kind").to_numpy()
            found = check.links(sets, signatures, np.flatnonzero(kind == 0), np.flatnonzero(kind == 1), np.arange(len(ids)))
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([group.column(c)[0].as_py()] * n, pa.int64()) for c in ("leader", "block")] + [pa.array([int(ids[x[k]]) for x in found], pa.int64()) for k in (0, 1)], ["leader", "block", "a", "b"])

    return rows.mapInArrow(run, LINK_SCHEMA)


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of the links (a, b): alternating large and small stars
    (Kiveris et al., "Connected components in MapReduce and beyond", 2014). Edges stay distributed; each round is a
    written table, the one before is deleted, and the rounds, a logarithm of the longest path, end when a round changes no edge."""
    spark, old, seen = links.sparkSession, [], None
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", old)
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = state
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = met(near, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = met(large, low, "u")
        small = both.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new: list[str] = []
        edges = written(small, "edges", new)
        deleted(spark, old)
        old = new


def judged(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    batch: int = 20,
    miss: float = 1e-7,
    block_shingles: int = 2_000_000,
    block_members: int = 1024,
) -> DataFrame:
    """As near_duplicates, with text_a and text_b (text_keys) and is_head besides: of the rows of a component those of one doc_id and text that stand
    for it, the least doc_id's. Repeated rows stand together; rows without shingles each for themselves."""
    hashes = bands * rows
    check = Verifier(hashes, batch, percent, miss)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *[c.alias(k) for k, c in text_keys(text).items()])
    scratch: list[str] = []
    base = written(features(docs, words, hashes), "features", scratch)
    usable = base.where("n_shingles > 0")
    # a node is a class: one doc_id can have texts of several. A row of its least doc_id stands for it, of these that of the least text keys
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")
    classes = usable.groupBy("digest_a", "digest_b").agg(F.min(own).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # numbers are fixed by writing them
    signatures = written(classes.select(F.monotonically_increasing_id().alias("node"), "own", "digest_a", "digest_b", "n_shingles", "signature"), "signatures", scratch)

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * (2 * rows) + 1, F.lit(2 * rows)))))
    placed = signatures.select("node", "n_shingles", band.alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = written(met(placed, shared, "bucket"), "buckets", scratch)
    reach = members.groupBy("node").agg(F.sum("members").alias("reach"))
    # the most reaching member leads; equal reach: the least node
    ranked = met(members, reach, "node").select("bucket", "node", F.struct(-F.col("reach"), F.col("node")).alias("rank"))
    leaders = ranked.groupBy("bucket").agg(F.min("rank")["node"].alias("leader"))
    led = written(met(members, leaders, "bucket").groupBy("leader", "node").agg(F.max("n_shingles").alias("n_shingles")), "led", scratch)

    sizes = led.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("n"))
    sizes = sizes.select("leader", F.greatest(F.ceil(F.col("m") / block_members), F.ceil(F.col("n") / block_shingles)).cast("bigint").alias("blocks"))
    # few groups have several blocks, and one may be a third of all rows: they are met by leader and salt
    salted = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = met(led.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), salted, ["leader", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    # the leader is a row of every block of its group
    block = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    dealt = sized.select("leader", "blocks", "node", F.explode(block).alias("block"))
    wanted = met(dealt, signatures.select("node", "own.text_a", "own.text_b", "signature"), "node")
    # copies fall together before the join, so a class meets one text
    once = docs.select("text", "text_a", "text_b").dropDuplicates(["text_a", "text_b"])
    profiles = met(once, wanted, ["text_a", "text_b"]).select("leader", "blocks", "block", "node", "signature", "text")
    profiles = written(with_shingles(profiles, words, hashes), "profiles", scratch)
    found = written(links_in_groups(profiles, check), "links", scratch)
    links = found.where("b is not null").select("a", "b")
    strays = found.where("b is null").select("leader", "block", F.col("a").alias("node"))
    if not strays.isEmpty():
        links = links.union(links_across_blocks(profiles.where("blocks > 1"), strays, check).select("a", "b"))

    linked = met(components(links), signatures.select("node", "own"), "node")
    heads = linked.groupBy("component").agg(F.min("own").alias("head"))
    linked = met(linked, heads, "component").select("node", "head")
    stands = met(signatures.select("node", "own", "digest_a", "digest_b"), linked, "node", "left").select("digest_a", "digest_b", F.coalesce("head", "own").alias("head"))
    mine = base.drop("signature")
    found = met(mine.where("n_shingles > 0"), stands, ["digest_a", "digest_b"]).withColumn("is_head", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b").eqNullSafe(F.col("head")))
    found = found.select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), "is_head", "text_a", "text_b")
    # what has no shingles stands alone, and isn't joined: its digests are null
    alone = mine.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("is_head"), "text_a", "text_b")
    done = written(found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "judged")
    deleted(df.sparkSession, scratch)
    return done


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are [^ \\t-\\r]+ after ASCII lower-casing; a text with fewer words than a shingle has its whole sequence as
    one. Texts are linked from percent on. component_id is the least doc_id that links reach; kept marks the row
    that has it. Chance of missing a pair at the threshold: (1 - 0.8^rows)^bands, 3e-6 as set, besides miss. options: those of judged.

    Null, empty and blank texts have 0 shingles and no links. Rows without a doc_id are linked as others are, but name no component: one of
    them alone has a null component_id. kept is doc_id = component_id, null equalling null. Repeated rows fall in one class and are all
    marked alike; texts under one doc_id are judged each by its own set, so several of them can be kept (judged tells which row stands for a component).
    An empty table gives no rows. Other columns are ignored.
    """
    return judged(df, doc_id, text, words, percent, **options).select("doc_id", "n_shingles", "component_id", "kept")
