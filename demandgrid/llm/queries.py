"""The corpus queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.llm import (
    bpe, codes, language, order_minhash, packing, quality, secrets, sharding, simhash, substrings, vectors, warc,
    whitening,
)
from demandgrid.llm.common import held_out, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, TOKENIZER)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality.score(docs, machine)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.sample_counts(docs))

    def joined(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.learn(docs, ~held_out()))
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected"
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(name):
        return F.expr(f"try_cast(regexp_extract({name}, '<urn:row:(.*)>', 1) AS bigint)")

    return warc.archived(table(spark, sf_dir, "pages")).select(
        row("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        row("refers_to").alias("refers_to"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = order_minhash.fingerprints(docs)
    paired = order_minhash.with_next(
        printed, {"next_print": F.col("fingerprint"), "next_text": F.col("text")}
    )
    n = F.length("text")
    gone = F.shiftright(n, 1)
    edited = F.concat(F.substring("text", F.lit(1), n - gone), F.substring("next_text", F.lit(1), gone))
    both = order_minhash.fingerprints(paired.withColumn("edited", edited), "edited", "edited_print")
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text(F.col("fingerprint")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("fingerprint"), F.col("edited_print")).alias("near_edited"),
        order_minhash.likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = codes.train_codes(table(spark, sf_dir, "embeddings"))
    digits = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return codes.label_errors(coded).select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(codes.book_digest(book)).alias("codebooks_sha256")
    )


def _rounds(n: int) -> str:
    """Assignment and codebook tables of ``n`` rounds and the last assignment a{n}."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(v.x) AS x, arg_min(j, (bb - 2 * ab) * 512 + j) AS j,
      any_value(aa) + min(bb - 2 * ab) AS error FROM (SELECT v.*, b.j, list_inner_product(v.x, v.x) AS aa,
      list_inner_product(v.x, b.x) AS ab, list_inner_product(b.x, b.x) AS bb FROM v JOIN b{r} b USING (p)) v
      GROUP BY row, vec_id, label, p)"""
    book = """b{s} AS MATERIALIZED (SELECT p, j, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
      SELECT p, j, list(y ORDER BY i) AS x FROM (SELECT p, j, i, floor(sum(x[i]) / count(*)) AS y
      FROM a{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY p, j, i) GROUP BY p, j) m USING (p, j))"""
    steps = [t for r in range(n) for t in (nearest.format(r=r), book.format(r=r, s=r + 1))]
    return ",\n".join([*steps, nearest.format(r=n)])


#: vectors of 64 components, ids without repeats among the smallest 256
OP12_SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label,
    list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
  v AS MATERIALIZED (SELECT row, vec_id, label, p, x[16 * p + 1 : 16 * p + 16] AS x FROM k, (SELECT unnest(range(4)) AS p)),
  b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS j, x FROM v QUALIFY j < 256),
  {_rounds(4)},
  c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', j), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error
    FROM a4 GROUP BY vec_id, label),
  h AS (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, j, i)) AS codebooks_sha256
    FROM b4, (SELECT unnest(range(1, 17)) AS i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, layout = sharding.balanced_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharding.read_layout(spark, layout).select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_packing, op3_quality, op4_substrings, op5_secrets, op6_fingerprints, op7_language, op8_simhash,
    op9_vectors, op10_bpe, op11_whitening, op12_codes, op13_sharding,
)}
SQL: dict[str, str] = {"op12_codes": OP12_SQL}
