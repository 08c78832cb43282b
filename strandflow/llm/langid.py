"""Language identification by Bayesian fusion of text likelihoods, declared language, address suffix and host priors.

posterior(lang) ~ prior(lang | host) x P(text | lang)^temper x P(declared | lang) x P(suffix | lang)

The text model is naive Bayes over hashed letter n-grams, trained on a bounded sample of each language's rows. The host
priors come from grouped aggregation over all rows: each row's text posterior is summed by host, domain and overall,
and every level is smoothed towards the one above, so a host of few pages leans on its domain. The likelihoods of a
declared language and of an address suffix are counted the same way from the text posteriors.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.shared import drop_columns, hashed_uniform, mapped, named, slices, written

#: Hash space of the letter n-grams, a power of two.
BUCKETS = 1 << 14
#: Rows of each language that the text model is trained on, as expected of the sample.
TRAINING_ROWS = 4000
#: Letters of a text at least, below which it counts as without language.
LEAST_LETTERS = 4


def grams(text: str) -> np.ndarray:
    """Hashed byte 2-, 3- and 4-grams of the letters; all else counts as one space."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    keep = letter | np.r_[True, letter[:-1]]
    x = np.where(letter, raw, 32)[keep].astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.int64)
    h = x[:-1] * np.uint32(0x9E3779B1) + x[1:]
    out = [h]
    for k in (2, 3):
        h = h[:-1] * np.uint32(0x85EBCA6B) + x[k:]
        out.append(h)
    joined = np.concatenate(out)
    return ((joined ^ (joined >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(18)).astype(np.int64)


def train(labelled: DataFrame, text: str, lang: str, key: str, most_rows: int = TRAINING_ROWS, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The languages and their log likelihood table (languages x BUCKETS): all languages that label a row, each from a sample of
    most_rows expected rows of its own, all where it has no more, that hashed keys and texts decide.

    The sample is a documented bound; its n-gram counts are summed on the executors and the driver receives the table alone.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(hashed_uniform(F.lit("train"), F.col(key), F.xxhash64(F.col(text))).alias("u"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    own = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("u").alias("least"))
    # the least hash is always in, so no language is without a row; one row a language is broadcast, as in the table below
    sample = rows.join(F.broadcast(own), "lang").where((F.col("u") * F.col("rows") < most_rows) | (F.col("u") == F.col("least"))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            for t, lg in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                tables.setdefault(lg, np.zeros(BUCKETS, np.int64))
                tables[lg] += np.bincount(grams(t), minlength=BUCKETS)
        for lg, counts in tables.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lg] * len(full)), pa.array(full), pa.array(counts[full])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), smooth)
    for i, lg in enumerate(langs):
        own = rows[rows["lang"] == lg]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(df: DataFrame, text: str, langs: list[str], table: np.ndarray, temper: float, as_name: str = "text_log", drop_text: bool = False) -> DataFrame:
    """df (without the text, if wished) with the tempered log likelihoods of the text, by language, less the largest; texts of few letters have none (null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.ascontiguousarray(table.T)
        for part in slices(batches, text):
            out = []
            for t in part.column(text).to_pylist():
                g = grams(t) if t else ()
                if len(g) < 3 * LEAST_LETTERS:
                    out.append(None)
                    continue
                log = sum(flat[g[k : k + 65536]].sum(axis=0) for k in range(0, len(g), 65536)) * (temper / max(1.0, len(g) / 300.0))
                out.append((log - log.max()).tolist())
            kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if not (drop_text and n == text)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(out, pa.list_(pa.float64()))], [*(n for n, _ in kept), as_name])

    return mapped(df, run, f"{as_name} array<double>", text if drop_text else None)


def softmax(log: Column) -> Column:
    power = F.transform(log, lambda x: F.exp(x))
    return F.transform(power, lambda x: x / F.aggregate(power, F.lit(0.0), lambda a, b: a + b))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def summed_posteriors(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The sums of the text posteriors by the keys, as mass; partial sums form before the shuffle, so a hot key is one row a task."""
    return df.groupBy(*keys).agg(*[F.sum(F.round(F.get("_soft", F.lit(i)), 9)).alias(f"m{i}") for i in range(n)]).select(*keys, F.array(*[f"m{i}" for i in range(n)]).alias("mass"))


def smoothed(mass: Column, above: Column, strength: float) -> Column:
    """Shares of the mass, as if strength rows with the shares above had been seen besides."""
    total = F.aggregate(mass, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(mass, above, lambda x, y: (x + y * strength) / (total + strength))


def identify(
    df: DataFrame,
    langs: list[str],
    table: np.ndarray,
    text: str = "text",
    host: Column | None = None,
    domain: Column | None = None,
    declared: Column | None = None,
    suffix: Column | None = None,
    temper: float = 0.2,
    strength: float = 20.0,
    floor: float = 0.05,
    threshold: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """df (of its columns those in keep; None: all) with lang_found, lang_posterior and lang_rejected.

    host, domain, declared, suffix: string expressions, null where a row lacks them, or None. A missing piece of evidence says nothing:
    a null host leans on its domain, a null domain on all rows, and a null declared language or suffix has
    likelihood 1. A text that is null, empty or has few letters has no text evidence. Rejected are rows without text
    evidence and rows whose best posterior is below the threshold; ties go to the language first in order.
    Repeated rows get equal results; an empty df gives no rows; columns of df with the new names are replaced, of other names kept
    whatever they are. Texts are scored once: the scored rows are a written table that the priors and the fusion both read.
    """
    k = len(langs)
    new = ("lang_found", "lang_posterior", "lang_rejected")
    columns = [c for c in df.columns if c.lower() not in new and (keep is None or c in keep)]
    own = {f"_own_{i}": c for i, c in enumerate(columns)}
    if not langs:  # nothing to learn from: no language is found
        return df.select(*map(named, columns), F.lit(None).cast("string").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(True).alias(new[2]))
    given = {"_host": host, "_domain": domain, "_declared": declared, "_suffix": suffix}
    evidence = [(F.lit(None) if c is None else c).cast("string").alias(name) for name, c in given.items()]
    carried = next((o for o, c in own.items() if c == text), None)
    rows = df.select(*[named(c).alias(o) for o, c in own.items()], *evidence, *([] if carried else [F.col(text).alias("_text")]))
    rows = written(text_evidence(rows, carried or "_text", langs, table, temper, "_log", drop_text=not carried), "scored")
    soft = rows.where("_log is not null").select(*given, softmax(F.col("_log")).alias("_soft"))
    # what the priors are summed from: one row a combination of evidence
    counts = written(summed_posteriors(soft, list(given), k), "evidence")
    regrouped = lambda *keys: counts.groupBy(*keys).agg(*[F.sum(F.get("mass", F.lit(i))).alias(f"m{i}") for i in range(k)]).select(*keys, F.array(*[F.coalesce(f"m{i}", F.lit(0.0)) for i in range(k)]).alias("mass"))
    even = F.array(*[F.lit(1.0 / k)] * k)
    everything = regrouped().select(smoothed(F.col("mass"), even, 1.0).alias("_all_prior"))
    domains = regrouped("_domain").where("_domain is not null").crossJoin(F.broadcast(everything)).select("_domain", smoothed(F.col("mass"), F.col("_all_prior"), strength).alias("_domain_prior"))
    hosts = regrouped("_host", "_domain").where("_host is not null").join(domains, "_domain", "left").crossJoin(F.broadcast(everything))
    hosts = hosts.select("_host", F.col("_domain").alias("_of"), smoothed(F.col("mass"), F.coalesce("_domain_prior", "_all_prior"), strength).alias("_host_prior"))

    out = rows.crossJoin(F.broadcast(everything))
    likely = {name: value_likelihoods(regrouped(name), name, k, floor) for name in ("_declared", "_suffix")}
    for side, key in ((domains, "_domain"), (hosts, "_host"), (likely["_declared"], "_declared"), (likely["_suffix"], "_suffix")):
        if given[key] is None:
            out = out.withColumn({"_domain": "_domain_prior", "_host": "_host_prior"}.get(key, f"{key}_log"), F.lit(None).cast("array<double>"))
        elif key == "_host":
            out = out.join(side.withColumnRenamed("_host", "_at"), (F.col("_host") == F.col("_at")) & F.col("_domain").eqNullSafe(F.col("_of")), "left").drop("_at", "_of")
        else:
            out = out.join(side, key, "left")
    nothing = F.array(*[F.lit(0.0)] * k)
    prior = F.transform(F.coalesce("_host_prior", "_domain_prior", "_all_prior"), lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    log = added(added(added(prior, F.coalesce("_log", nothing)), F.coalesce("_declared_log", nothing)), F.coalesce("_suffix_log", nothing))
    top = F.array_max(log)
    out = out.withColumn("_soft", softmax(F.transform(log, lambda x: x - top)))
    best = F.array_max("_soft")
    found = F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("_soft", best) - 1).cast("int"))
    return out.select(*[F.col(o).alias(c) for o, c in own.items()], found.alias(new[0]), best.alias(new[1]), (F.col("_log").isNull() | (best < threshold)).alias(new[2]))


def value_likelihoods(values: DataFrame, name: str, k: int, floor: float) -> DataFrame:
    """name, name_log: log P(value | lang) by value (name, mass). Posterior mass of the value, with floor rows more of every value, over
    that of all, and a share of floor dealt evenly, which keeps one lie from deciding; so each language's sum to 1."""
    values = values.where(f"{name} is not null")
    whole = values.agg(F.count(F.lit(1)).alias("_values"), F.array(*[F.sum(F.get("mass", F.lit(i))) for i in range(k)]).alias("_all"))
    n = F.col("_values")
    ratio = F.zip_with("mass", "_all", lambda m, a: F.log((m + floor) / (a + n * floor) * (1 - floor) + F.lit(floor) / n))
    return values.crossJoin(F.broadcast(whole)).select(name, ratio.alias(f"{name}_log"))


HIDDEN = re.compile(r"<!--|<(script|style|nav|head)\b", re.I)
CLOSING = re.compile(r"</(script|style|nav|head)\s*>", re.I)
ENTITY = re.compile(r"&[a-zA-Z]{1,10};|&#[0-9xXa-fA-F]{1,8};")


def visible_text(page: str) -> str:
    """A page without scripts, styles, navigation, head, comments, tags and entities, in time linear in its length: where hidden parts end is
    listed beforehand, so a part that never ends costs no search of the rest. Such a part loses its tag alone."""
    starts: dict[str, list[int]] = {"-->": [m.start() for m in re.finditer("-->", page)]}
    ends: dict[str, list[int]] = {"-->": [at + 3 for at in starts["-->"]]}
    for m in CLOSING.finditer(page):
        name = m[1].lower()
        starts.setdefault(name, []).append(m.start())
        ends.setdefault(name, []).append(m.end())
    out, seen, at = [], 0, 0
    while m := HIDDEN.search(page, at):
        name = m[1].lower() if m[1] else "-->"
        i = bisect.bisect_left(starts.get(name, ()), m.end())
        at = m.end()
        if i < len(starts.get(name, ())):
            out += [page[seen : m.start()], " "]
            seen = at = ends[name][i]
    bare = "".join([*out, page[seen:]])
    last = bare.rfind(">") + 1  # behind it no tag ends
    return ENTITY.sub(" ", re.sub("<[^>]*>", " ", bare[:last]) + bare[last:])


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text (visible_text), declared (the html tag's lang, its first part), host, domain (the host's last two labels) and suffix; each null where a page lacks it."""
    pages = drop_columns(pages, "text", "declared", "host", "domain", "suffix")
    declared = F.lower(F.regexp_extract(F.col(html), r"(?i)<html[^>]{0,400}?\blang\s{0,9}=\s{0,9}[\"']?([a-zA-Z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    blank = lambda c: F.when(c != "", c)
    told = pages.withColumns({"declared": blank(declared), "host": blank(host), "domain": blank(F.substring_index(host, ".", -2)), "suffix": blank(F.substring_index(host, ".", -1))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html):
            texts = [None if p is None else visible_text(p) for p in part.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return mapped(told, run, "text string")


