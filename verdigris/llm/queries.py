"""The thin queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import bm25, bpe, decontaminate, html_text, licenses, likelihood, oracles, quality, shards, simhash, toxicity, url_filter, vector_codes, whitening
from verdigris.llm.common import held_out, table


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_nn_vote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judge = quality.score_udf(quality.train(docs, labels), spark)
    scored = docs.select("doc_id", judge("text").alias("score"))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_filter.judge(pages, url_filter.labelled_outcomes(pages, labels))


def op8_blockmax_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, as a whole-text query against all documents."""
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where(F.col("doc_id") % 20 == 0))


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op10_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_nn_vote_quality": op2_nn_vote_quality,
    "op3_license_minhash": op3_license_minhash,
    "op4_simhash_gray_index": op4_simhash_gray_index,
    "op5_ngram_decontamination": op5_ngram_decontamination,
    "op6_bpe_trie": op6_bpe_trie,
    "op7_host_reputation": op7_host_reputation,
    "op8_blockmax_bm25": op8_blockmax_bm25,
    "op9_hypergeometric_shards": op9_hypergeometric_shards,
    "op10_composite_density": op10_composite_density,
    "op11_likelihood_ratio": op11_likelihood_ratio,
    "op12_digit_slice_whitening": op12_digit_slice_whitening,
    "op13_product_codes": op13_product_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_decontamination": oracles.DECONTAMINATION,
    "op7_host_reputation": oracles.HOST_REPUTATION,
    "op11_likelihood_ratio": oracles.LIKELIHOOD_RATIO,
    "op13_product_codes": oracles.PRODUCT_CODES,
}
