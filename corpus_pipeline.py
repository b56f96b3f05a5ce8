"""Corpus pipeline: five stages over ``documents``, each written and read again as the next's input.

1. language: documents whose language is rejected go
2. near_duplicates: SimHash proposes pairs, shingles verify them; of each group the smallest id stays
3. substrings: words of passages that repeat go
4. secrets: secrets are masked
5. packing: the rest is packed into sequences of tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.llm import language, near_copies, packing, secrets, substrings
from demandgrid.llm.common import free_name, held_out, table
from demandgrid.llm.queries import TOKENIZER
from demandgrid.session import materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; narrow leads and texts without letters go."""
    found = language.identify(docs, language.learn(docs, ~held_out()))
    return found.where(~F.col("lang_rejected")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id.

    Links are pairs with a similarity of 0.8 or more on shingles of five words. Rows of null ids
    take part and come after all others; different texts under one id are judged on their own,
    of repeated rows one stays. Texts without words are no copies of each other and stay.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    digest, first_id, first_digest = (free_name(docs, n) for n in ("_digest", "_first", "_first_digest"))
    first = near_copies.near_copies(docs).select(
        F.col("doc_id").alias(first_id), F.col("digest").alias(first_digest)
    )
    named = docs.where(worded).withColumn(digest, F.sha1(F.col("text").cast("binary")))
    same = F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(digest) == F.col(first_digest))
    kept = named.join(first, same, "left_semi").dropDuplicates(["doc_id", digest])
    return kept.select(*docs.columns).union(docs.where(~worded))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; untouched texts keep their white space."""
    cut = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(cut.withColumn("text", text), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in place."""
    found = secrets.find_secrets(docs, secrets.sample_counts(docs), masked="masked_text")
    return _with_text(found.withColumn("text", F.col("masked_text")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left; one row per piece, with its tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), TOKENIZER)


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, n_chars counted anew where the text is known."""
    size = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return changed.withColumn("n_chars", size).select(*docs.columns)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # compression, fingerprint search and packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
