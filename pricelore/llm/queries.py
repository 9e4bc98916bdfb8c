"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm import alignment, licenses, lm_scoring, mixing, negatives, packing, permutation, quality, simhash, suffixes, token_orc, toxicity, warc
from pricelore.llm.common import fresh_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ids(texts: list[str | None]) -> list[bytes]:
    """Ids of byte_bpe_50k.json, by the same vocabulary's ranks; texts with its special string by the tokenizer itself."""
    import public_tokenizers

    from pricelore.llm.tokens import rank_encoder

    return rank_encoder(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, vocabulary("byte_bpe_50k.json"))(texts)


def word_ids(texts: list[str | None]) -> list[bytes]:
    from pricelore.llm.tokens import word_encoder

    return word_encoder(vocabulary("word_bpe_49k.json"))(texts)


def alignment_files() -> tuple[str, str, str]:
    import public_tokenizers

    return vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, vocabulary("piece_bpe_32k.model")


def aligned() -> alignment.Aligner:
    return alignment.aligner(*alignment_files())


def op1_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation.search(vectors, vectors.where("vec_id % 50 = 0"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.model(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    pages = warc.read_archives(spark, path)
    return pages.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url", "whole")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), byte_ids, end_id=1, size=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens-orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, word_ids, end_id=2)
    return token_orc.with_crc(token_orc.read_tokens(spark, path))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=changed)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), aligned)[0]


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_permutation": op1_permutation,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_lm": op4_lm,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_orc": op10_orc,
    "op11_negatives": op11_negatives,
    "op12_alignment": op12_alignment,
    "op13_suffixes": op13_suffixes,
}
#: The other queries' full results can't be expressed in SQL within reason; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op11_negatives": """
        WITH base AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS nth
            FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE nth <= 10
    """,
}
