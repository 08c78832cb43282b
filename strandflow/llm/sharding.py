"""Sharding by jump consistent hashing, with DataFrame functions only.

The hash follows Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014): a linear
congruential generator seeded by the key draws the shard counts at which the key jumps; the last jump below the
wanted count is the key's shard. There is no ring table, and appending a shard moves 1/(n+1) of the keys, all to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.shared import drop_columns, named, numbered_copies

#: Fixed values of the published generator.
MULTIPLIER, MODULUS = 2862933555777941757, 1 << 64

#: Jumps that are drawn for every key; keys that need more (very rare) go on to the exact bound, one jump a shard.
FIRST_JUMPS = 24


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a bigint key. A null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    wide = "decimal(38,0)"
    state = "struct<key:decimal(38,0),b:bigint,j:bigint>"

    def start() -> Column:
        signed = F.coalesce(key.cast("bigint"), F.lit(0)).cast(wide)
        return F.struct(F.when(signed < 0, signed + F.lit(str(MODULUS)).cast(wide)).otherwise(signed).cast(wide).alias("key"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j")).cast(state)

    def jump(s: Column, _: Column) -> Column:
        drawn = ((s["key"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast(wide)
        # what is divided is a multiple of the divisor: decimal division would round
        low = drawn % F.lit(1 << 33).cast("decimal(20,0)")
        high = ((drawn - low) / F.lit(1 << 33).cast("decimal(20,0)")).cast("bigint").cast("double") + 1.0
        moved = F.struct(drawn.alias("key"), s["j"].alias("b"), F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / high)).cast("bigint").alias("j"))
        return F.when(s["j"] < shards, moved.cast(state)).otherwise(s)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_JUMPS))), start(), jump)
    if shards > FIRST_JUMPS:
        more = F.when(first["j"] < shards, F.sequence(F.lit(1), F.lit(shards - FIRST_JUMPS))).otherwise(F.array().cast("array<int>"))
        first = F.aggregate(more, first, jump)
    return first["b"].cast("int")


def shard_by_key(df: DataFrame, key: str, shards: int, slot_buckets: int = 4096, order_by: tuple[str, ...] = (), hot_rows: int = 100_000) -> DataFrame:
    """df with law, shard, slot and grown_shard.

    shard depends on the key and the number of shards alone; grown_shard is the shard after one more is appended.
    slot numbers a shard's rows from 0 without gaps. It is found without sorting a whole shard: rows are counted by
    shard and bucket (slot_buckets x shards small counts, so their broadcast is bounded), running
    sums of the counts give each bucket's first slot, and rows are numbered within their bucket, by key and then by
    the order_by columns. A bucket comes from the md5 of the key; rows of a hot key (more than hot_rows) are dealt to buckets by the
    rest of the row as well, so no key is one task, and rows that are equal in all columns are counted before they are shuffled.

    Integer keys are hashed as they are, others by xxhash64. Null keys are one key, that of 0. Repeated rows get a slot each.
    Input columns with the names of the new ones are replaced; an empty df gives no rows. Columns of map type can't be compared, so they aren't taken.
    """
    df = drop_columns(df, "law", "shard", "slot", "grown_shard", "_bucket", "_first", "_place", "_n", "_copy", "_hot", "_high", "_middle", "_low")
    own = [named(c) for c in df.columns]
    integral = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(key) if integral else F.xxhash64(F.col(key))
    distinct = df.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    # keys that more than hot_rows rows hold: fewer than rows / hot_rows of them, found from partial counts
    hot = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > hot_rows).select("_hot")
    if hot.isEmpty():
        marked = distinct.withColumn("_hot", F.lit(False))
    else:
        marked = distinct.join(hot.withColumnRenamed("_hot", "_key").withColumn("_hot", F.lit(True)), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("0")).cast("binary"))
    bucket = F.when(F.col("_hot"), F.pmod(F.xxhash64(*own), F.lit(slot_buckets))).otherwise(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % slot_buckets)
    dealt = marked.withColumns({"shard": jump_hash(number, shards), "grown_shard": jump_hash(number, shards + 1), "_bucket": bucket})
    counts = dealt.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_bucket", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col(key), *[F.col(c) for c in order_by], F.xxhash64(*own)).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_place", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(firsts), ["shard", "_bucket"])
    copies = numbered_copies(placed, "_n", "_copy")
    return copies.withColumns({"law": F.lit("key"), "slot": F.col("_first") + F.col("_place") + F.col("_copy")}).select(*own, "law", "shard", "slot", "grown_shard")
