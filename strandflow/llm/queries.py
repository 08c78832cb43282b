"""The corpus operators as queries over the test tables, and SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import audio, bpe, centroids, chat, decontaminate, langid, lexical, mixing, neardup, quality, sharding, tokencount, vectors
from strandflow.llm.shared import fresh_path, table, written


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Trusted positives: documents labelled 1 outside the held-out fold. Unlabelled: all documents outside it."""
    seen = docs.select("doc_id", "text").where(~quality.held_out(F.col("doc_id")))
    trusted = labels.where((F.col("quality") == 1) & ~quality.held_out(F.col("doc_id")))
    return quality.train(seen, trusted)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored by a model of positives and unlabelled text."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model(spark, docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded and decoded; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, vocabulary()).select("doc_id", "n_tokens", "ids")
    back = bpe.decode(ids, vocabulary())
    return back.select("doc_id", "n_tokens", bpe.ids_digest().alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in groups of texts whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS first_id FROM sets WHERE len(s) > 0),
heads AS (SELECT doc_id, n, s FROM classes WHERE doc_id = first_id),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM heads),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM heads UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.seen),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON c.doc_id = s.doc_id LEFT JOIN roots r ON r.node = c.first_id
"""


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents repeated so that every source has an equal share of the characters, shuffled; the digest of each copy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mix = mixing.mixed(docs, "doc_id", source="source", size=F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5")
    return mix.select("doc_id", "source", "copy_no", F.floor(F.col("shuffle_key") * (1 << 40)).cast("bigint").alias("shuffle_place"), digest)


OP4_SQL = """
WITH RECURSIVE sized AS (SELECT doc_id, source, length(coalesce(text, '')) AS size FROM documents),
digests AS (SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents),
sources AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM sized GROUP BY source),
rates AS (SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM sources) * (SELECT sum(size) FROM sources) / size ELSE 0.0 END AS rate FROM sources),
parts AS (
  SELECT d.doc_id, d.source, r.rate, greatest(CAST(ceil(r.rate / 32.0::DOUBLE) AS INT), 1) AS parts
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
draws AS (
  SELECT doc_id, source, i, rate / parts AS mean,
    (CAST(('0x' || substr(md5('17:' || i || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, unnest(range(1, parts + 1)) AS i FROM parts)),
steps AS (
  SELECT doc_id, source, i, mean, u, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM draws
  UNION ALL
  SELECT doc_id, source, i, mean, u, k + 1, p * mean / (k + 1)::DOUBLE, cdf + p * mean / (k + 1)::DOUBLE FROM steps
  WHERE cdf < u AND k < ceil(mean + sqrt(mean) * 14.0 + 40.0)),
counts AS (SELECT doc_id, source, CAST(sum(k) AS BIGINT) AS n FROM (SELECT doc_id, source, i, max(k) AS k FROM steps GROUP BY doc_id, source, i) GROUP BY doc_id, source),
copies AS (SELECT doc_id, source, unnest(range(0, n)) AS copy_no FROM counts)
SELECT doc_id, source, CAST(copy_no AS BIGINT) AS copy_no, text_md5,
  CAST(floor((CAST(('0x' || substr(md5('17:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy_no), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE * 1099511627776) AS BIGINT) AS shuffle_place
FROM copies JOIN digests USING (doc_id)
"""


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its visible text, its declared language, its address suffix and its host."""
    langs, model = langid.train(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    pages = langid.page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = langid.identify(pages, langs, model, "text", F.col("host"), F.col("domain"), F.col("declared"), F.col("suffix"), keep=["page_id"])
    return found.select("page_id", "lang_found", F.round("lang_posterior", 6).alias("lang_posterior"), "lang_rejected")


#: The polynomial of CRC-32 and the multiplier of the jump hash are fixed values; the byte table is made by the polynomial's rule. Jumps are rows of a
#: recursion, slots the order of a shard's rows by md5 bucket, doc_id, size and checksum.
OP8_SQL = """WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
docs AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
measured AS (SELECT doc_id, octet_length(raw) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM docs, crc_table),
jumps AS (SELECT DISTINCT doc_id, n, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES (8), (9)) s(n)
  UNION ALL SELECT doc_id, n, drawn, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (drawn // 8589934592 + 1)::DOUBLE))::BIGINT FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS drawn FROM jumps WHERE j < n)),
landed AS (SELECT doc_id, max(b) FILTER (WHERE n = 8) AS shard, max(b) FILTER (WHERE n = 9) AS grown_shard FROM jumps WHERE j >= n GROUP BY doc_id)
SELECT m.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || left(md5(coalesce(m.doc_id, 0)::VARCHAR), 8))::BIGINT % 4096, m.doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM measured m JOIN landed l ON l.doc_id IS NOT DISTINCT FROM m.doc_id"""


def op8_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in shards 0 to 7 by jump consistent hashing of doc_id; texts are measured before any row moves."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard_by_key(docs, "doc_id", 8, order_by=("size", "text_crc32")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th embedding among all others."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired and rendered. rendered_digest: the sum, over the parts of its text, of the first 15 hex digits of their md5; conversations of less than 512 turns are one part."""
    parts = chat.format_chats(table(spark, sf_dir, "conversations"))
    text = F.col("rendered").cast("binary")
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(c).alias(c) for c in ("n_messages", "n_turns", "n_merged", "n_relabelled", "n_inserted")]
    return parts.groupBy("conv_id").agg(*sums, F.max("cost").alias("cost"), F.sum(F.octet_length(text).cast("bigint")).alias("n_bytes"), F.sum(digest).cast("string").alias("rendered_digest"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files of their token ids: the files hold ids and separators alone and are scanned by ranges;
    which document comes where is another table, joined to the counts by place."""
    folder = fresh_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = written(tokencount.write_token_files(docs, "doc_id", "text", vocabulary(), folder), "order")
    counts = tokencount.document_lengths(tokencount.read_token_files(spark, folder), tokencount.separator_of(vocabulary()))
    found = order.join(counts.select(F.substring_index("file", "/", -1).alias("file"), "doc_no", "n_tokens"), ["file", "doc_no"], "left")
    lost = F.raise_error(F.concat(F.lit("no count of a document in "), F.col("file"))).cast("bigint")
    return found.select("doc_id", F.coalesce("n_tokens", lost).alias("n_tokens"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a recording of 8-bit samples: what was stored, read back and computed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    stored = audio.store_samples(docs, "raw").select("doc_id", F.octet_length("raw").cast("bigint").alias("n_bytes"), "media")
    heard = audio.audio_features(stored)
    active = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"])
    level = F.aggregate("tensors", F.lit(0.0), lambda a, t: a + F.aggregate(t["log_mel"], F.lit(0.0), lambda b, x: b + x.cast("double")))
    feature = F.format_string("frames=%d tensors=%d segments=%d active_s=%.3f mel=%.2f", "n_frames", F.size("tensors"), F.size("segments"), active, level / (F.col("n_frames") * 24))
    return heard.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op11_term_pipeline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH doc_words AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS MATERIALIZED (SELECT place, doc_id, len(w)::BIGINT AS n, w FROM doc_words WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM held),
item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS MATERIALIZED (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(w) AS term FROM item_words) GROUP BY item_id, term),
postings AS MATERIALIZED (SELECT place, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT place, doc_id, n, unnest(w) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY place, doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), whole),
scored AS (
  SELECT item_id, place, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), whole GROUP BY item_id, place, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20
"""


def op12_sorted_mean_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings in 40 clusters after 5 rounds, in integers."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Five rounds written out. Products of integers below 2^53 are exact in doubles."""
    given = """
given{r} AS MATERIALIZED (
  SELECT v.rid, v.v, min((v.square + c.square - 2 * list_inner_product(v.v, c.v))::HUGEINT * 64 + c.c) AS code FROM kept v, cents{r} c GROUP BY v.rid, v.v),"""
    moved = """
sums{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT code % 64 AS c, unnest(range(1, 65)) AS i, unnest(v)::HUGEINT AS x FROM given{p}) GROUP BY c, i),
means{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM sums{r} GROUP BY c),
cents{r} AS MATERIALIZED (SELECT c, v, list_inner_product(v, v) AS square FROM (SELECT o.c, coalesce(m.v, o.v) AS v FROM cents{p} o LEFT JOIN means{r} m USING (c))),"""
    start = """WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, v, list_inner_product(v, v) AS square FROM usable),
cents0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v, square FROM kept QUALIFY c < 40),"""
    end = """
told AS (SELECT vec_id, (code % 64)::INT AS cluster, (code // 64)::BIGINT AS distance FROM given5 JOIN kept USING (rid))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM told JOIN cents5 c ON c.c = cluster"""
    return start + given.format(r=0) + "".join(moved.format(r=r, p=r - 1) + given.format(r=r) for r in range(1, 6)) + end


def op13_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the benchmark items of which a window of 10 words occurs in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS place, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS passage FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (SELECT place, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, widths WHERE len(w) >= width),
found AS MATERIALIZED (SELECT place, i, p.width, item_id FROM places p JOIN windows x ON x.width = p.width AND x.passage = array_to_string(w[i : i + p.width - 1], ' ')),
hits AS (SELECT place, count(DISTINCT word_place) AS n_hit FROM (SELECT place, unnest(range(i, i + width)) AS word_place FROM found) GROUP BY place),
named AS (SELECT place, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT place, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY place)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (place) LEFT JOIN named USING (place)
"""


def queries() -> dict:
    found = (
        op1_pu_quality,
        op2_bpe_round_trip,
        op3_minhash_near_duplicates,
        op4_poisson_mix,
        op5_language_evidence,
        op6_pruned_graph_neighbours,
        op7_role_repair,
        op8_jump_hash_shards,
        op9_separator_scan,
        op10_audio_features,
        op11_term_pipeline_search,
        op12_sorted_mean_centroids,
        op13_automaton_decontamination,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_duplicates": OP3_SQL, "op4_poisson_mix": OP4_SQL, "op8_jump_hash_shards": OP8_SQL, "op11_term_pipeline_search": OP11_SQL, "op12_sorted_mean_centroids": _op12_sql(), "op13_automaton_decontamination": OP13_SQL}
