"""The registered queries of the thirteen operators and the pipeline, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.llm import decontam, divergence, exactsub, jaccard, lm, merkle, neighbours, oracle, quality, ranked, secrets, spm, tokencount, wavelet
from veladura.llm.common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.with_limit(tokencount.token_counts(documents(spark, sf_dir)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(documents(spark, sf_dir), with_ids=False)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactsub.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(documents(spark, sf_dir))


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out())
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(neighbours.graphs(vectors), vectors.where("vec_id % 20 = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_token_counts, op3_sentencepiece, op4_lattice_lm, op5_suffix_dedup,
        op6_wavelet_ids, op7_quality_ranking, op8_template_decontamination, op9_jaccard_join, op10_merkle,
        op11_ranked_search, op12_source_divergence, op13_hnsw_neighbours,
    )
}
# The others need nested decoding, tokenizers, learned weights, byte offsets or graphs that SQL lacks, or are too slow there
# on whole tables; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {"op11_ranked_search": oracle.RANKED, "op12_source_divergence": oracle.DIVERGENCE}
