"""The registered queries of the corpus operators and, where SQL can express them, the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import ensure_shared_folder
from ..session import shared_folder
from . import bpe, codes_sql, embedding_dedup, exact_dedup, html_extract, huffman, language, linear_bpe, ngram_join, packing, prefix_trie, toxicity, vector_codes, warc
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_shared_folder(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op4_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digests=True)


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode_documents(docs, *vocabulary, bytes_column="decoded", keep=["doc_id"])
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identified_documents(docs, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored_documents(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    huffman.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, drops_white_space=True)
    return huffman.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


@query("op7_embedding_near_dedup")
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extracted(pages, html_extract.fit(pages), keep=["page_id", "url"])


def _op9_sql() -> str:
    uuid = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'".format
    text = r"regexp_replace(payload, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>', '', 'gis')"
    text = rf"regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g')"
    text = rf"regexp_replace({text}, '{warc._BORDER.removeprefix('(?is)')}', chr(10), 'gis')"
    text = rf"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for entity, character in warc.ENTITIES:
        text = f"replace({text}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    text = rf"trim(regexp_replace(regexp_replace({text}, ' *\n[ \n]*', chr(10), 'g'), '^\n|\n$', '', 'g'))"
    head = "'HTTP/1.1 200 OK' || crlf || 'Content-Type: text/html; charset=UTF-8' || crlf || 'Content-Length: ' || strlen(payload)"
    facts = ("'source-headers: ' || replace(head, crlf, '; ') || crlf || 'source-bytes: ' || strlen(block) || crlf || 'payload-bytes: ' || strlen(payload)"
             " || crlf || 'payload-digest: ' || payload_digest || crlf")
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, chr(13) || chr(10) AS crlf FROM pages),
r AS (SELECT *, {head} AS head, {head} || crlf || crlf || payload AS block, 'sha256:' || sha256(payload) AS payload_digest FROM p),
s AS (SELECT *, md5('response|' || coalesce(page_id::VARCHAR, 'null') || '|' || target_uri || '|' || payload_digest) AS h FROM r),
i AS (SELECT *, {uuid('h')} AS response_id, {text} AS plain, {facts} AS facts FROM s),
d AS (SELECT *, md5('metadata|' || response_id) AS m, md5('conversion|' || response_id) AS c FROM i)
SELECT page_id, 'response' AS warc_type, response_id AS record_id, NULL AS refers_to, target_uri, NULL AS source_payload_digest, NULL AS concurrent_to,
       strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest FROM d
UNION ALL
SELECT page_id, 'metadata', {uuid('m')}, response_id, target_uri, payload_digest, {uuid('c')}, strlen(facts), 'sha256:' || sha256(facts), 'sha256:' || sha256(facts) FROM d
UNION ALL
SELECT page_id, 'conversion', {uuid('c')}, response_id, target_uri, payload_digest, {uuid('m')}, strlen(plain), 'sha256:' || sha256(plain), 'sha256:' || sha256(plain) FROM d
"""


@query("op9_warc_derivatives", _op9_sql())
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.responses(table(spark, sf_dir, "pages"))
    records = found.unionByName(warc.derivatives(found))
    return records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", F.col("headers")["X-Source-Payload-Digest"].alias("source_payload_digest"),
                          F.col("headers")["WARC-Concurrent-To"].alias("concurrent_to"), F.octet_length("block").cast("long").alias("content_length"),
                          "block_digest", "payload_digest")


@query("op11_vector_codes", codes_sql.vector_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_prefix_trie", prefix_trie.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.rebuilt_prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op13_linear_bpe")
def op13_linear_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = linear_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded_column="decoded", keep=["doc_id"])
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
