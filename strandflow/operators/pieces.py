"""Long sequences as pieces, and windows over them.

A contig is never one string: it is pieces (contig_id, ordinal, start, seq), in order, of which start is the place of the
first letter. Windows gather only the parts of pieces that they cover, so a contig may be of any length.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.plans.session import settled

#: Ordinals that one window of the running sums covers; windows are stitched by a second sum over one row each.
SPAN = 8192


def with_starts(pieces: DataFrame) -> DataFrame:
    """pieces (contig_id, ordinal, seq) with start, the total length of the contig's earlier pieces.

    A two-level running sum: within spans of ordinals, then over spans, so that a contig of very many pieces isn't ordered by one task.
    """
    rows = pieces.withColumn("_span", F.floor(F.col("ordinal") / SPAN)).withColumn("_len", F.length("seq").cast("bigint"))
    spans = rows.groupBy("contig_id", "_span").agg(F.sum("_len").alias("_sum"))
    over = Window.partitionBy("contig_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("contig_id", "_span", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    within = Window.partitionBy("contig_id", "_span").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("_len").over(within), F.lit(0)))
    return rows.join(spans, ["contig_id", "_span"]).withColumn("start", F.col("_before") + F.col("_inner")).drop("_span", "_len", "_before", "_inner")


def running_sums(rows: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """rows with before_<value>: the sum of the value over the key's earlier rows (order must be unique within a key). Rows are dealt by ranges of
    key and order; each range is summed by itself and ranges are stitched by sums of one row a key and range, so no key is one task."""
    dealt = settled(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))  # ranges stay as they are drawn
    sums = dealt.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    over = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    earlier = sums.select(*named, F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{v}").over(over), F.lit(0)).alias(f"_earlier_{v}") for v in values])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumns({f"_inner_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    on = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return inner.join(earlier, on).select(*rows.columns, *[(F.col(f"_inner_{v}") + F.col(f"_earlier_{v}")).alias(f"before_{v}") for v in values])


def with_next(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "next") -> DataFrame:
    """rows with the value of the key's next row (order must be unique within a key, values not null); null for a key's last row. Rows are dealt by
    ranges of key and order, as for running sums: each range is looked at by itself and the last of one meets the first of the key's next range."""
    dealt = settled(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))  # ranges stay as they are drawn
    firsts = dealt.groupBy(*keys, "_range").agg(F.min(F.struct(*order, value)).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range"))[value]
    later = firsts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), after.alias("_after"))
    inner = dealt.withColumn("_inner", F.lead(value).over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    on = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return inner.join(later, on).select(*rows.columns, F.coalesce("_inner", "_after").alias(name))


def contig_lengths(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("contig_id").agg(F.sum(F.length("seq").cast("bigint")).alias("contig_length"))


def windows(pieces: DataFrame, window: int, step: int, extra: int = 0, tail: bool = False) -> DataFrame:
    """contig_id, window_no, start, end, seq of the windows of window letters every step.

    An incomplete last window is dropped, but a contig shorter than a window is one short window; empty contigs have none.
    tail: keep windows to the end, cut short. extra: letters beyond the window that seq holds besides, as far as there are.
    """
    lengths = contig_lengths(pieces).where("contig_length > 0")
    last = F.ceil(F.col("contig_length") / step) - 1 if tail else F.greatest(F.lit(0), F.floor((F.col("contig_length") - window) / step))
    rows = pieces.where("seq != ''").join(lengths, "contig_id").withColumn("_last", last.cast("bigint"))
    first_no = F.greatest(F.lit(0), F.floor((F.col("start") - (window + extra)) / step) + 1)
    last_no = F.least(F.floor((F.col("start") + F.length("seq") - 1) / step), F.col("_last"))
    rows = rows.withColumns({"_a": first_no.cast("bigint"), "_b": last_no.cast("bigint")}).where("_a <= _b")
    rows = rows.withColumn("window_no", F.explode(F.sequence("_a", "_b")))
    at = F.greatest(F.col("window_no") * step, F.col("start"))
    end = F.least(F.col("window_no") * step + window + extra, F.col("start") + F.length("seq"), F.col("contig_length"))
    parts = rows.select("contig_id", "window_no", "contig_length", at.alias("_at"), F.substring(F.col("seq"), (at - F.col("start") + 1).cast("int"), (end - at).cast("int")).alias("_part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]), "")
    parts = parts.repartition("contig_id", "window_no")  # the join may have dealt by contig alone, which would leave a contig's windows to one task
    found = parts.groupBy("contig_id", "window_no").agg(text.alias("seq"), F.max("contig_length").alias("_n"))
    begin = F.col("window_no") * step
    return found.select("contig_id", "window_no", begin.alias("start"), F.least(begin + window, F.col("_n")).alias("end"), "seq")


def window_letters(pieces: DataFrame, window: int, step: int, sets: dict[str, str]) -> DataFrame:
    """contig_id, window_no, start, end and, by name, how many letters of each set the window has; the windows are those of `windows`.

    Letters are counted where the pieces lie, in tiles that windows are whole numbers of, and windows add up tiles: a row of counts a tile is
    shuffled, no letter, and no window's letters are counted once for every window that they lie in.
    """
    tile = gcd(window, step)
    wide, hop = window // tile, step // tile
    lengths = contig_lengths(pieces).where("contig_length > 0")
    rows = pieces.where("seq != ''").withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("start") + F.length("seq") - 1) / tile))))
    at = F.greatest(F.col("_tile") * tile, F.col("start"))
    rows = rows.select("contig_id", "_tile", F.substring(F.col("seq"), (at - F.col("start") + 1).cast("int"), ((F.col("_tile") + 1) * tile - at).cast("int")).alias("_part"))
    n = lambda letters: F.length("_part") - F.length(F.translate(F.col("_part"), letters, ""))
    tiles = rows.groupBy("contig_id", "_tile").agg(*[F.sum(n(letters).cast("bigint")).alias(name) for name, letters in sets.items()])
    last = F.greatest(F.lit(0), F.floor((F.col("contig_length") - window) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("_tile") + 1 - wide) / hop))
    tiles = tiles.join(lengths, "contig_id").withColumns({"_a": first.cast("bigint"), "_b": F.least(F.floor(F.col("_tile") / hop), last).cast("bigint")}).where("_a <= _b")
    found = tiles.withColumn("window_no", F.explode(F.sequence("_a", "_b"))).groupBy("contig_id", "window_no").agg(F.max("contig_length").alias("_n"), *[F.sum(name).alias(name) for name in sets])
    begin = F.col("window_no") * step
    return found.select("contig_id", "window_no", begin.alias("start"), F.least(begin + window, F.col("_n")).alias("end"), *sets)


def overlaps(left: DataFrame, right: DataFrame, tile: int, keys: list[str], how: str = "inner", pad: int = 0) -> DataFrame:
    """Interval join of left and right (start, end, half open) that share the keys, at a distance of at most pad.

    Both sides are dealt to the tiles that they touch and joined on tiles; a pair is made in the first tile that both
    touch alone. left's columns keep their names, right's start and end become r_start and r_end. how: inner or left.
    """
    # both branches must see the same ids: they are fixed by a checkpoint
    named = settled(left.withColumn("_id", F.monotonically_increasing_id())) if how == "left" else left
    tiles = lambda a, b: F.explode(F.sequence(F.floor(a / tile), F.floor((F.greatest(b, a + 1) - 1) / tile)))
    x = named.withColumn("_tile", tiles(F.col("start") - pad, F.col("end") + pad))
    y = right.withColumnsRenamed({"start": "r_start", "end": "r_end"}).withColumn("_tile", tiles(F.col("r_start"), F.col("r_end")))
    shared = F.greatest(F.floor((F.col("start") - pad) / tile), F.floor(F.col("r_start") / tile))
    hit = (F.col("r_end") > F.col("start") - pad) & (F.col("r_start") < F.col("end") + pad) & (F.col("_tile") == shared)
    found = x.join(y, [*keys, "_tile"]).where(hit).drop("_tile")
    if how == "inner":
        return found
    rest = [c for c in y.columns if c not in (*keys, "_tile")]
    return named.join(found.select("_id", *rest), "_id", "left").drop("_id")


def islands(rows: DataFrame, keys: list[str], place: str, gap: int) -> DataFrame:
    """rows with island: numbers of runs of places in which neighbours are at most gap apart."""
    w = Window.partitionBy(*keys).orderBy(place)
    new = F.coalesce((F.col(place) - F.lag(place).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def complement(rows: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """The gaps (keys, start, end) of least letters or more between a feature and the next by start."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return rows.withColumn("_next", F.lead("start").over(w)).where(F.col("_next") - F.col("end") >= least).select(*keys, F.col("end").alias("start"), F.col("_next").alias("end"))


def near(regions: DataFrame, points: DataFrame, keys: list[str], unit: str, distance: int) -> DataFrame:
    """regions (start, end, and unit, their key) with near: whether a point (at) of the same keys lies less than distance from either end.
    Ends are dealt to tiles of that size, so a region meets the points around its ends alone."""
    ends = regions.select(*keys, unit, F.explode(F.array(F.col("start"), F.col("end"))).alias("_end"))
    tile = lambda x: F.floor(x / distance)
    ends = ends.withColumn("_tile", F.explode(F.sequence(tile(F.col("_end") - distance), tile(F.col("_end") + distance))))
    hit = ends.join(points.select(*keys, "at", tile(F.col("at")).alias("_tile")), [*keys, "_tile"]).where(F.abs(F.col("at") - F.col("_end")) < distance)
    found = hit.select(*keys, unit).distinct().withColumn("near", F.lit(True))
    return regions.join(found, [*keys, unit], "left").withColumn("near", F.coalesce("near", F.lit(False)))
