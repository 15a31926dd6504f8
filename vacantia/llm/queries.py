"""Registered queries of the corpus operators."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from vacantia.llm import (decontaminate, jaccard, language, packing, personal, ranked, resampling, secrets, sentences,
                          sharding, token_counts, vectors, warc)
from vacantia.llm.common import table
from vacantia.session import shared_folder

QUERIES, ORACLES = {}, {}

SHARDS = 16


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# CRC-32 of the bytes of a column ``code`` of hex digits, in DuckDB; ``crc`` is its table, from CRC_TABLE.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"""
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(length(code) // 2),
    lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(crc[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"""


@query("op3_rendezvous_shards", f"""
    WITH table_of AS ({CRC_TABLE}),
    d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    c AS (SELECT row, doc_id, strlen(text) + 1 AS size, {CRC} AS text_crc32
          FROM (SELECT *, hex(encode(text)) AS code FROM d), table_of),
    s AS (SELECT row, shard, -1 / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || '/' || shard), 1, 12))::BIGINT::DOUBLE
                                      + 0.5::DOUBLE) / 281474976710656::DOUBLE) AS score FROM d, range(17) AS r(shard)),
    b AS (SELECT row, arg_max(shard, score) FILTER (WHERE shard < 16) AS shard, arg_max(shard, score) AS grown FROM s GROUP BY row)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
           grown::INT AS grown_shard
    FROM c JOIN b USING (row)""")
def op3(spark, sf_dir):
    placed = sharding.assign(table(spark, sf_dir, "documents"), "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1), "text")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op5_secret_scan")
def op5(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_ngram_jaccard")
def op7(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op10_benchmark_leaks")
def op10(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_retrieval_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_warc_archive", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM f""")
def op2(spark, sf_dir):
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url", "payload")


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs, public_tokenizers.path("piece_bpe_32k.model")))


@query("op8_embedding_near_duplicates")
def op8(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_sentence_spans")
def op9(spark, sf_dir):
    return sentences.repeated_spans(table(spark, sf_dir, "documents"))


@query("op11_ranked_search", r"""
    WITH words AS (
      SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, doc_id
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    docs AS (SELECT row_number() OVER () AS doc, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM docs),
    postings AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY doc, term),
    weights AS (
      SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM postings, totals GROUP BY term, documents),
    items AS (
      SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM benchmark WHERE text IS NOT NULL),
    asked AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY item, term),
    scored AS (
      SELECT item, doc, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length))))::BIGINT
               AS score
      FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (doc), totals GROUP BY item, doc),
    ranked AS (
      SELECT item, doc_id, score,
             row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
      FROM scored JOIN docs USING (doc) WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 20""")
def op11(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked.search(ranked.build_index(docs, queries=items), items)


@query("op13_target_resampling", r"""
    WITH table_of AS (""" + CRC_TABLE + r"""),
    words AS (
      SELECT row, unnest(terms) AS word FROM (
        SELECT row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms
        FROM (SELECT row_number() OVER () AS row, text FROM documents
              UNION ALL SELECT -1, text FROM benchmark))),
    buckets AS (
      SELECT word, """ + CRC + r""" % 10000 AS bucket
      FROM (SELECT DISTINCT word, hex(encode(word)) AS code FROM words), table_of),
    counts AS (
      SELECT b, count(bucket) FILTER (row >= 0) AS s, count(bucket) FILTER (row < 0) AS t
      FROM range(10000) AS r(b) LEFT JOIN (SELECT row, bucket FROM words JOIN buckets USING (word)) ON bucket = b GROUP BY b),
    gains AS (
      SELECT b AS bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                          / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
    means AS (
      SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
      FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE row >= 0 GROUP BY row),
    scored AS (
      SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
               + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN means USING (row)),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place,
             count(*) FILTER (n_features >= 20) OVER () AS able
      FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed""")
def op13(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_personal_data")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return personal.find_personal(docs, personal.learn(docs))
