"""Registered corpus queries: thin views of the operators, in the columns their contracts name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, decontaminate, fingerprints, hard_negatives, line_dedup, pieces, quality, sharding, simhash, spelling, substring_dedup, token_counts, warc
from ._tables import NULL_ID

N_SHARDS = 40
OVER_LIMIT_TOKENS = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: near-equal shards; no row moves for a grown shard, so that column is null."""
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), N_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT_TOKENS)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.LineIndex(spark).insert(docs).keep_first(docs)
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edit_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(_table(spark, sf_dir, "pages"))
    return warc.payload_table(warc.read_packages(packages)).drop("record_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), quality.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    null_id = F.lit(NULL_ID)
    return rows.select(F.nullif("id", null_id).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component_id", null_id).alias("component_id"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all: labels of every seventh are shifted by one, components are 256ths."""
    vecs = _table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    vecs = vecs.where(F.coalesce(finite, F.lit(False))).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return hard_negatives.mine(vecs, F.col("vec_id") % 100 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(_table(spark, sf_dir, "documents"), spelling.drop_letter(199)))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


Q = {f.__name__: f for f in (op1_sharding, op2_token_counts, op3_bpe, op4_line_dedup, op5_substring_dedup, op6_document_fingerprints, op7_warc, op8_decontamination, op9_quality_classifier, op10_simhash_near_dedup,
                             op11_hard_negatives, op12_spelling_variants, op13_sentencepiece)} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op4_line_dedup"] = f"""
WITH lines AS (
    SELECT doc_id, i, l, translate(regexp_replace(regexp_replace(l, '^[ \\t-\\r]+', ''), '[ \\t-\\r]+$', ''), '{UPPER}', '{LOWER}') AS k
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
shared AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT l.*, coalesce(s.keeper < l.doc_id, false) AS drop FROM lines l LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT drop), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

SQL["op5_substring_dedup"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
wins AS (SELECT doc_id, i, word, CASE WHEN lead(word, 12) OVER o IS NOT NULL THEN concat_ws(' ', word, """ + ", ".join(f"lead(word, {j}) OVER o" for j in range(1, 13)) + r""") END AS win
         FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM wins WHERE win IS NOT NULL GROUP BY win),
hits AS (SELECT wins.*, coalesce(first_doc < doc_id, false) AS hit FROM wins LEFT JOIN firsts USING (win)),
judged AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hits),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN sums USING (doc_id)"""

#: Base 32 of a SHA-1: each five bytes are eight five-bit digits.
SQL["op7_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (SELECT p.*, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1) for k in range(32)], 'string_agg', '') AS payload_digest FROM p),
newest AS (SELECT h, payload_bytes, max(page_id) AS newest FROM p GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM coded JOIN newest USING (h, payload_bytes)"""

SQL["op8_decontamination"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
hits AS (SELECT doc_id, i, d.m, item_id FROM (SELECT doc_id, i, s.m, array_to_string(w[i:i + s.m - 1], ' ') AS win FROM starts, (SELECT DISTINCT m FROM wins) s WHERE i + s.m - 1 <= len(w)) d JOIN wins USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN met USING (doc_id)"""

SQL["op11_hard_negatives"] = """
WITH vecs AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
              FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
           FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def _crc_of_nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


#: CRC-32 over the hex digits of "id:run", the low digit of each byte first.
SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
    SELECT id, run, count(*) AS c
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL),
tab AS (SELECT {[_crc_of_nibble(n) for n in range(16)]}::BIGINT[] AS t),
hashed AS (
    SELECT run, c, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(hex(id || ':' || run)) + 1), lambda i:
        (strpos('0123456789ABCDEF', substr(hex(id || ':' || run), (i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)::INT, 1)) - 1)::BIGINT),
        lambda h, x: xor(h >> 4, t[(xor(h, x) & 15) + 1]))) AS h
    FROM runs, tab),
words AS (
    SELECT word, sum(c)::BIGINT AS n
    FROM (SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
shorter AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN words b ON a.cut = b.word),
near AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT * FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
          FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM words UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM forms f JOIN chain c USING (word) JOIN forms last ON last.word = c.root WHERE last.form IS NULL"""
