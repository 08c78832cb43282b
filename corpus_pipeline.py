"""A corpus from raw documents to token ids, stage by stage: each takes all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import bpe, langid, mixing, neardup, quality
from strandflow.llm.queries import quality_model, vocabulary
from strandflow.llm.shared import table, written
from strandflow.plans.session import ship_package

#: Posterior of a document's language below which the first stage drops it.
LEAST_POSTERIOR = 0.8


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with the columns of these names under others, and what selects its columns as they were."""
    taken = {n.lower() for n in names}
    new = {c: f"_own_{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed({c: n for c, n in new.items() if c != n}), [F.col(f"`{n}`").alias(c) for c, n in new.items()]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the text, the declared language and the source's prior settle, with the found one as their lang; those without
    letters or with a posterior under LEAST_POSTERIOR go."""
    ship_package(spark)
    langs, model = langid.train(docs, "text", "lang", "doc_id")
    rows, own = set_aside(docs, "lang_found", "lang_posterior", "lang_rejected")
    found = langid.identify(rows, langs, model, "text", host=F.col("source"), declared=F.col("lang"), threshold=LEAST_POSTERIOR)
    return found.where(~F.col("lang_rejected")).withColumn("lang", F.col("lang_found")).select(*own)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores 0.3 or more."""
    ship_package(spark)
    model = quality_model(spark, docs, table(spark, sf_dir, "labels"))
    rows, own = set_aside(docs, "score", "predicted")
    return quality.score(rows, model).where("predicted = 1").select(*own)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more, that of the least doc_id; texts without
    a doc_id are grouped as others are. Repeated rows stay once, but for rows without doc_id and without words, which all stay."""
    ship_package(spark)
    heads = neardup.judged(docs, words=5, percent=80).where("is_head")
    keys = [F.col(c).alias(f"kept_{c[-1]}" if c != "doc_id" else "kept_id") for c in ("doc_id", "text_a", "text_b")]
    single = (F.col("doc_id").isNotNull() | (F.col("n_shingles") > 0)).alias("single")
    ids = written(heads.groupBy(*keys, single).agg(F.count(F.lit(1)).alias("times")), "kept")
    rows, own = set_aside(docs, "_text_a", "_text_b", "kept_id", "kept_a", "kept_b", "times", "single")
    keyed = rows.withColumns({f"_{k}": c for k, c in neardup.text_keys("text").items()})
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("_text_a") == F.col("kept_a")) & (F.col("_text_b") == F.col("kept_b"))
    stay = neardup.met(keyed, ids, same)
    if ids.where("times > 1 and single").isEmpty():
        return stay.select(*own)
    stay = written(stay, "stay")
    once = stay.where("single").dropDuplicates(["doc_id", "_text_a", "_text_b"])
    return once.union(stay.where("not single")).select(*own)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by hashed Poisson counts so that every source has an equal share of the characters, shuffled globally."""
    ship_package(spark)
    rows, own = set_aside(docs, "copy_no", "shuffle_key", "_rate", "_source", "_count", "_key", "_high", "_middle", "_low")
    return mixing.mixed(rows, "doc_id", source="source", size=F.length("text")).select(*own)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of every row."""
    ship_package(spark)
    return bpe.encode(docs, vocabulary()).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("mix", mixed_sources),
    ("tokens", token_ids),
]

#: The trained and hashed stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
