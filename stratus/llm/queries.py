"""The operators bound to the given tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm import bpe, pii, prefix_trie, quality, token_store, toxicity, vector_codes, warc
from stratus.llm.common import table
from stratus.llm.exact_dedup import mark_copies
from stratus.llm.hamming_index import nearest
from stratus.llm.main_text import extract
from stratus.llm.mixing import mix
from stratus.llm.ngram_join import near_duplicates
from stratus.session import materialize, scratch_path


#: Scores from here on count as good, or as toxic.
GOOD, TOXIC = 0.7, 0.3


def quality_scores(docs: DataFrame, sf_dir: str, out: str = "score") -> DataFrame:
    """``docs`` with ``out``; learned from labels outside the held-out part."""
    spark = docs.sparkSession
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    weights = quality.fit(table(spark, sf_dir, "documents"), labels)
    return quality.score(docs, weights, out=out)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, sf_dir).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path,
                             public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


def joined_spans(column: str):
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind))
    return found.select(
        "doc_id", *[count(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(joined_spans("base"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.captures(spark, path, payloads=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.col("refers_to_page").cast(kind).alias("refers_to"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def byte_bpe_digests(docs: DataFrame, stored: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip. With ``stored``
    the ids are written between its halves, so a task runs one Python worker at a time:
    less memory for some disk and CPU."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(docs.select("doc_id", "text"), path)
    back = bpe.decode(materialize(ids, "ids") if stored else ids, path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
                       .alias("ids_sha256"),
                       F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books, _ = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    model = toxicity.fit(table(spark, sf_dir, "documents"), labels)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py``, one after another."""
    import corpus_pipeline              # it uses this module
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_hamming_index": op2_hamming_index,
    "op3_main_text": op3_main_text,
    "op4_token_store": op4_token_store,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_warc": op7_warc,
    "op8_source_mix": op8_source_mix,
    "op9_ngram_join": op9_ngram_join,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_toxicity": op13_toxicity,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''),
                                         '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size
                   FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_vector_codes": vector_codes.oracle(),
    # DuckDB's to_base gives digits 0-9A-V for base 32
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             s AS (SELECT page_id, body, sha1(body) AS sha, min(page_id) OVER (PARTITION BY body)
                          AS first FROM p)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
               translate(array_to_string(list_transform(range(8), lambda i: to_base(
                   ('0x' || substr(sha, (1 + 5 * i)::INT, 5))::BIGINT, 32, 4)), ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')
                   AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM s""",
    "op9_ngram_join": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4
                  THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(
                      range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g
              FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS n,
                     any_value(b.n) AS m
              FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p WHERE 100 * k >= 85 * (n + m - k)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents
              UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id
        FROM s JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
             USING (doc_id)""",
}
