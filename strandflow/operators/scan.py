"""Window scans of sequences against a baseline: signals, z-scores, two-track ranking, overlap suppression, context, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import sequence as S
from strandflow.operators.measures import against_profiles, measured, profile_counts
from strandflow.operators.pieces import contig_lengths, windows
from strandflow.plans.session import settled
from strandflow.sources.documents import host_pieces

#: Signals of a window that need no reference.
PLAIN = ("gc", "h3", "hurst", "ac3", "mi1", "c2")
#: Signals whose value is a distance from the host's profile, and codon information.
PROFILE = ("rho", "cpd", "rscu_d", "codon_mi")
#: All that are fused, in their fixed order.
FUSED = ("gc", "h3", "hurst", "ac3", "mi1", "c2", "rho", "gradient", "cpd", "rscu_d", "codon_mi")


def host_profile(host: DataFrame, tile: int = 3_000) -> DataFrame:
    """A row of each host's profile, hosts being the contigs of the pieces: host, rho, rscu, codon-pair counts. Tiles are counted apart and
    overlap by the letters that a pair reaches over, so frames and neighbours are those of the whole. Tiles are short, as a worker holds a batch of them."""
    counted = profile_counts(windows(host, tile, tile, extra=5, tail=True), tile)
    bins = {0: 4, 1: 16, 2: 64, 3: 4096}
    # every bin once with nothing, so that the sorted counts are dense
    none = lambda k: lambda i: F.struct(F.lit(k).alias("kind"), i.alias("value"), F.lit(0).cast("bigint").alias("n"))
    spine = host.select("contig_id").distinct().select("contig_id", F.inline(F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), F.lit(b - 1)), none(k)) for k, b in bins.items()]))))
    counted = counted.union(spine).groupBy("contig_id", "kind", "value").agg(F.sum("n").alias("n"))
    dense = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("value", "n")))), lambda x: x["n"])
    row = counted.groupBy(F.col("contig_id").alias("host")).agg(*[dense(k).alias(f"d{k}") for k in bins])  # 4,180 counts a host
    size = S.total(F.col("d3"), 0)
    row = row.select("*", S.rho_from_counts(F.col("d0"), F.col("d1")).alias("host_rho"), S.rscu_from_counts(F.col("d2")).alias("host_rscu"), size.alias("host_size"))
    return row.select("host", "host_rho", "host_rscu", F.col("d3").alias("host_pairs"), "host_size", S.divergence_of_none(F.col("d3"), F.col("host_size")).alias("host_none"))


#: Rows of profiles or baselines (33 KB a profile) that are broadcast; more are met by a shuffle.
MOST_HOSTS = 1000


def with_host(rows: DataFrame, table: DataFrame, by: str | None) -> DataFrame:
    """rows with the columns of table (a row a host) of the host that the column by names; by None: of the only one."""
    if by is None:
        return rows.crossJoin(F.broadcast(table.drop("host")))  # one row
    hosts = settled(table).withColumnRenamed("host", "_host")
    hosts = F.broadcast(hosts) if hosts.count() <= MOST_HOSTS else hosts
    return rows.join(hosts, F.col(by).cast("string") == F.col("_host")).drop("_host")


def signals(segments: DataFrame, profile: DataFrame, by: str | None = None) -> DataFrame:
    """segments (.., seq) with the ten signals in the letters' place, against the profile of the host that by names, or the only one. Work of a row alone: no shuffle.
    Up to MOST_HOSTS profiles go to the workers, which take the signals in batches; more are met by a shuffle."""
    hosts = profile.limit(MOST_HOSTS + 1).toArrow()
    return against_profiles(segments, hosts, by) if hosts.num_rows <= MOST_HOSTS else joined_signals(segments, profile, by)


def joined_signals(segments: DataFrame, profile: DataFrame, by: str | None = None) -> DataFrame:
    """The signals by a join with the profiles and expressions over counts, for any number of hosts."""
    rows = with_host(measured(segments), profile, by).withColumn("_codons", S.total(F.col("codon"), 0)).withColumn("_pairs", S.total(F.col("pair_n"), 0))
    n = F.length("seq")
    pairs = F.zip_with("pair_value", "pair_n", lambda v, n: F.struct(v.alias("value"), n.alias("n")))
    values = {
        "gc": S.gc_content(F.col("seq")),
        "h3": F.when(n < 3, 0.0).otherwise(S.entropy(F.col("k3")) / 6),
        "h4": F.when(n < 4, 0.0).otherwise(S.entropy(F.col("k4")) / 8),
        "hurst": F.col("hurst"),
        "ac3": S.period3_share(F.col("autocorrelation")),
        "mi1": F.when(n <= 2, 0.0).otherwise(S.information(F.col("k1"), F.col("k2"))),
        "c2": S.chargaff_deviation(F.col("seq")),
        "rho_vector": S.rho_from_counts(F.col("k1"), F.col("k2")),
        "rho": S.euclidean(S.rho_from_counts(F.col("k1"), F.col("k2")), F.col("host_rho")),
        "cpd": S.divergence_from(pairs, F.col("_pairs"), F.col("host_pairs"), F.col("host_size"), F.col("host_none")),
        "rscu_d": S.euclidean(S.rscu_from_counts(F.col("codon")), F.col("host_rscu")),
        "codon_mi": F.when(F.col("_codons") < 10, 0.0).otherwise(S.information(F.col("codon"), F.col("pair_n"))),
    }
    return rows.select(*[c for c in segments.columns if c != "seq"], *[v.alias(k) for k, v in values.items()])


def baseline_windows(host: DataFrame, window: int, step: int, most: int | None = None) -> DataFrame:
    """The host's whole windows: all of them, or with most up to so many, evenly spread over its length by integer parts of an even grid."""
    if most is None:
        return windows(host, window, step).where(F.col("end") - F.col("start") == window)
    n = contig_lengths(host).select(F.greatest(F.floor((F.col("contig_length") - window) / step) + 1, F.lit(0)).alias("_n"))
    found = windows(host, window, step).crossJoin(F.broadcast(n)).where("_n > 0 and end - start = %d" % window)
    grid = F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.col("_n")) - 1), lambda i: F.when(i == F.least(F.lit(most), F.col("_n")) - 1, F.col("_n") - 1).otherwise(F.floor(i * ((F.col("_n") - 1) / F.greatest(F.least(F.lit(most), F.col("_n")) - 1, F.lit(1)).cast("double")))))
    picked = n.where("_n > 0").select(F.explode(grid).alias("window_no"))
    return found.drop("_n").join(F.broadcast(picked), "window_no")  # at most `most` numbers


def baseline_stats(host: DataFrame, window: int = 2000, step: int = 2000, most: int | None = None, profile: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """One row: mean and population deviation (at least 1e-6) of each signal over all windows of the host, or a grid of most (the reference's 500). A host shorter than a window gives nulls.
    keyed: a row a host, hosts being the contigs; those shorter than a window have none."""
    found = signals(baseline_windows(host, window, step, most), host_profile(host) if profile is None else profile, "contig_id" if keyed else None)
    columns = []
    for name in (*PLAIN, *PROFILE):
        columns += [F.avg(name).alias(f"{name}_mean"), F.greatest(F.stddev_pop(name), F.lit(1e-6)).alias(f"{name}_std")]
    return found.groupBy(*[F.col("contig_id").alias("host")] if keyed else []).agg(*columns)


def z_scores(found: DataFrame, stats: DataFrame, by: str | None = None) -> DataFrame:
    """The windows' signals as absolute z-scores against the baseline of the host that by names (or the only one), and gradient: what gc and h3 moved since the window before, 0 for the first."""
    rows = with_host(found, stats, by)
    z = {name: F.abs(F.col(name) - F.col(f"{name}_mean")) / F.col(f"{name}_std") for name in (*PLAIN, *PROFILE)}
    rows = rows.select(*[by] if by else [], "contig_id", "window_no", "start", "end", *[c.alias(k) for k, c in z.items()])
    w = Window.partitionBy("contig_id").orderBy("start")
    moved = F.abs(F.col("gc") - F.lag("gc").over(w)) + F.abs(F.col("h3") - F.lag("h3").over(w))
    return rows.withColumn("gradient", F.coalesce(moved, F.lit(0.0)))


def composite(z: DataFrame, digits: int = 9) -> DataFrame:
    """z with geomean, rankfusion, track and composite, contig by contig.

    composite = n / the better of the ranks by the geometric mean of all signals (each at least 0.01) and by n over the mean
    of the best three ranks. Scores are compared at digits places; ties go by start.
    """
    geo = F.exp(sum(F.log(F.greatest(F.col(s), F.lit(0.01))) for s in FUSED) / len(FUSED))
    rows = z.withColumn("geomean", F.round(geo, digits)).withColumn("n_windows", F.count(F.lit(1)).over(Window.partitionBy("contig_id")))
    rank = lambda c: F.row_number().over(Window.partitionBy("contig_id").orderBy(c.desc(), F.col("start")))
    rows = rows.withColumns({f"_{s}": rank(F.round(s, digits)) for s in FUSED} | {"_geo": rank(F.col("geomean"))})
    top = F.slice(F.array_sort(F.array(*[f"_{s}" for s in FUSED])), 1, 3)
    rows = rows.withColumn("rankfusion", F.round(F.col("n_windows") * 3.0 / S.total(top, 0), digits))
    rows = rows.withColumn("_fused", rank(F.col("rankfusion")))
    rows = rows.withColumn("composite", F.col("n_windows") / F.least("_geo", "_fused")).withColumn("track", F.when(F.col("_geo") <= F.col("_fused"), "geometric").otherwise("rankfusion"))
    return rows.drop(*[f"_{s}" for s in FUSED], "_geo", "_fused", "n_windows")


def suppressed(scored: DataFrame) -> DataFrame:
    """The windows that greedy suppression of neighbours keeps, best composite first and ties by start.

    Centres are a step apart and neighbours closer than two steps exclude each other, so a window competes with the one
    before and the one after alone. On such a path the greedy choice has a closed form: a window stays if the
    strictly better runs that end beside it, to the left and to the right, both have an even number of windows.
    """
    w = Window.partitionBy("contig_id").orderBy("start")
    rows = scored.withColumns({"_before": F.lag("composite").over(w), "_after": F.lead("composite").over(w)})
    # left: the window before is better (or equal: it starts earlier); right: the one after is strictly better
    rows = rows.withColumns({"_left": F.coalesce((F.col("_before") >= F.col("composite")).cast("int"), F.lit(0)), "_right": F.coalesce((F.col("_after") > F.col("composite")).cast("int"), F.lit(0))})
    rows = rows.withColumns({"_run_left": F.sum(1 - F.col("_left")).over(w), "_run_right": F.sum(1 - F.col("_right")).over(Window.partitionBy("contig_id").orderBy(F.desc("start")))})
    left = F.row_number().over(Window.partitionBy("contig_id", "_run_left").orderBy("start")) - 1
    right = F.row_number().over(Window.partitionBy("contig_id", "_run_right").orderBy(F.desc("start"))) - 1
    rows = rows.withColumns({"_l": left, "_r": right}).where("_l % 2 = 0 and _r % 2 = 0")
    return rows.drop("_before", "_after", "_left", "_right", "_run_left", "_run_right", "_l", "_r")


def window_class() -> Column:
    """MOBILE_LIKE, STRUCTURAL, ANOMALOUS or NORMAL of a row of z-scores, the first that holds."""
    raised = sum((F.col(s) > 1.5).cast("int") for s in ("gc", "h3", "hurst", "c2", "ac3"))
    mobile = (F.col("gradient") > 2.0) & ((F.col("c2") > 1.5) | (F.col("ac3") > 1.5))
    return F.when(mobile, "MOBILE_LIKE").when(F.col("hurst") > 2.5, "STRUCTURAL").when(raised >= 2, "ANOMALOUS").otherwise("NORMAL")


def with_context(kept: DataFrame, proximity: int = 3) -> DataFrame:
    """kept with context_class, context_boost and boosted: windows that aren't mobile or structural gain by raised neighbours, twice as much if both sides have some."""
    rows = kept.withColumn("context_class", window_class())
    w = Window.partitionBy("contig_id").orderBy("start")
    raised = (F.col("context_class") != "NORMAL").cast("int")
    rows = rows.withColumns({"_l": F.coalesce(F.sum(raised).over(w.rowsBetween(-proximity, -1)), F.lit(0)), "_r": F.coalesce(F.sum(raised).over(w.rowsBetween(1, proximity)), F.lit(0))})
    both = (F.col("_l") > 0) & (F.col("_r") > 0)
    boost = F.when(F.col("context_class").isin("MOBILE_LIKE", "STRUCTURAL"), 1.0).otherwise(1.0 + F.when(both, 0.04).otherwise(0.02) * (F.col("_l") + F.col("_r")))
    return rows.withColumn("context_boost", boost).withColumn("boosted", F.col("composite") * F.col("context_boost")).drop("_l", "_r")


def transitions(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """from_state, to_state, n of consecutive states."""
    w = Window.partitionBy(*keys).orderBy(order)
    moved = rows.select(F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state")).where("to_state is not null")
    return moved.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def state_summary(rows: DataFrame) -> DataFrame:
    """kind, name, n: windows by class, moves between classes, and windows by class that neighbours raise though they aren't mobile or structural."""
    classes = rows.groupBy(F.col("context_class").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("class").alias("kind"), "name", "n")
    moves = transitions(rows, ["contig_id"], "start", "context_class").select(F.lit("move").alias("kind"), F.concat_ws(" > ", "from_state", "to_state").alias("name"), "n")
    raised = rows.where(F.col("context_class").isin("ANOMALOUS", "NORMAL") & (F.col("context_boost") > 1.0)).groupBy(F.col("context_class").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return classes.union(moves).union(raised.select(F.lit("boosted").alias("kind"), "name", "n"))


#: Signals of the earlier scan, whose rho is the distance itself.
EARLIER = ("gc", "h3", "hurst", "ac3", "mi1", "gradient")


def earlier_scan(z: DataFrame, found: DataFrame) -> DataFrame:
    """contig_id, start, end, composite of the scan before ranks were fused: the geometric mean of seven signals of every window, each at least 0.01; nothing is suppressed."""
    rows = z.select("contig_id", "window_no", "start", "end", *EARLIER).join(found.select("contig_id", "window_no", F.col("rho").alias("raw")), ["contig_id", "window_no"])
    logs = sum(F.log(F.greatest(F.col(s), F.lit(0.01))) for s in (*EARLIER, "raw"))
    return rows.select("contig_id", "start", "end", F.exp(logs / (len(EARLIER) + 1)).alias("composite"))


def candidates(rows: DataFrame, top: int = 20, least_z: float = 1.5, order: str = "confidence", by: str | None = None) -> DataFrame:
    """The top windows of each contig, then of all: rank, contig_id, start, end, confidence, evidence, composite. by: the top of each value of that column, which comes first.

    confidence = composite / 3, at most 1. evidence: signals over least_z, largest first, as "name: z=0.0". order:
    confidence (ties by contig_id and rank in the contig, so it saturates in the first contigs) or composite.
    """
    place = F.row_number().over(Window.partitionBy("contig_id").orderBy(F.desc("boosted"), "start"))
    found = F.filter(F.array(*[F.struct((-F.round(F.col(s), 9)).alias("z"), F.lit(i).alias("i"), F.lit(s).alias("name")) for i, s in enumerate(FUSED)]), lambda x: -x["z"] > least_z)
    evidence = F.transform(F.array_sort(found), lambda x: F.format_string("%s: z=%.1f", x["name"], F.round(-x["z"], 1)))
    keys = [by] if by else []
    rows = rows.withColumn("place", place).where(F.col("place") <= top)
    rows = rows.select(*keys, "contig_id", "place", "start", "end", F.least(F.col("boosted") / 3.0, F.lit(1.0)).alias("confidence"), F.col("boosted").alias("composite"), evidence.alias("evidence"))
    best = [F.desc("confidence" if order == "confidence" else "composite"), "contig_id", "place"]
    rank = F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(*best))  # a key's top windows alone leave their tasks
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select(*keys, "rank", "contig_id", "start", "end", "confidence", "composite", "evidence")


def scan(target: DataFrame, host: DataFrame, window: int = 2000, step: int = 500) -> DataFrame:
    """The suppressed windows of target's contigs of a window's length or more, scored against the host's baseline."""
    profile = host_profile(host)
    stats = baseline_stats(host, window, window, profile=profile)
    found = signals(windows(target, window, step).where(F.col("end") - F.col("start") == window), profile)
    return suppressed(composite(z_scores(found, stats)))


def scan_single(target: DataFrame, host: DataFrame, window: int = 2000, step: int = 500, top: int = 20) -> DataFrame:
    """Candidates of a single isolate: scan, context and top windows."""
    return candidates(with_context(scan(target, host, window, step)), top)


def scan_clusters(pieces: DataFrame, labels: DataFrame, window: int = 2000, step: int = 500, top: int = 10, cluster: str = "cluster") -> DataFrame:
    """The candidates of each cluster: cluster and the columns of candidates. Contigs are scored against profile and baseline of their own cluster.

    labels: contig_id, cluster. One plan for all clusters: profiles and baselines are tables of a row a cluster, so the number of jobs doesn't depend on
    how many there are. Clusters without a window's letters in one piece after the other have no baseline and no candidates.
    """
    own = settled(pieces.join(labels.select("contig_id", cluster), "contig_id"))  # read by the profiles, the baselines and the windows
    host = host_pieces(own, by=cluster)
    profile = settled(host_profile(host))
    stats = baseline_stats(host, window, window, profile=profile, keyed=True)
    whole = windows(own, window, step).where(F.col("end") - F.col("start") == window).join(labels.select("contig_id", cluster), "contig_id")
    z = z_scores(signals(whole, profile, cluster), stats, cluster)
    return candidates(with_context(suppressed(composite(z))), top, by=cluster)
