"""A training corpus from ``documents``: quality, exact copies, near copies,
source mix, tokens. Each stage takes (spark, docs, sf_dir) and works on all
that the stage before it kept; :func:`run` writes every stage's rows as Parquet
in the shared folder and reads them back for the next, so a lost executor costs
one stage at most.

All stages but the last return the columns of ``documents``; the last returns
doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix (a
document that the mix repeats has a row for each time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import fresh_name, numbered
from stratus.llm.exact_dedup import drop_copies
from stratus.llm.mixing import mixed_documents
from stratus.llm.ngram_join import near_duplicates
from stratus.llm.queries import GOOD, byte_bpe_digests, quality_scores
from stratus.session import materialize

#: Near copies: words of a shingle, and the least Jaccard similarity in percent.
WORDS, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    score = fresh_name(docs, "score")
    return quality_scores(docs, sf_dir, score).where(F.col(score) >= GOOD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the smallest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id (null
    last, then by text). Texts without words are in no group and stay."""
    inner, (doc_id, text), back = numbered(docs, "doc_id", "text")
    sha = F.sha2(F.coalesce(text, F.lit("")), 256)
    keyed = inner.withColumn("_key", F.struct(F.col(doc_id).isNull().alias("none"),
                                              F.col(doc_id).alias("id"), sha.alias("sha")))
    groups = near_duplicates(keyed, id_col="_key", text_col=text, n=WORDS, percent=SIMILAR)
    gone = (groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id.id").alias("_id"), F.col("doc_id.sha").alias("_sha")))
    return back(keyed.join(gone, (F.col("_key.sha") == F.col("_sha"))
                           & F.col("_key.id").eqNullSafe(F.col("_id")), "left_anti"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every row. Executors still hold what the stages
    before took, so the ids are written in between."""
    return byte_bpe_digests(docs, stored=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near),
          ("source_mix", mixture), ("byte_bpe", tokens)]

#: The classifier is fitted and Jaccard components are iterated: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
