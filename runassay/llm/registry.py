"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runassay.llm import binary, centroids, language, mixing, near_dups, neighbours, packing, prefixes, privacy
from runassay.llm import quality, secrets, toxicity, warc
from runassay.llm.common import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score_toxicity(documents, model).withColumn("held_out", held)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op3_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.pack_matrices(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).drop("host", "n_lines")


def op7_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_min_slack(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find_personal(_table(spark, sf_dir, "documents"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_neighbours": op2_neighbours,
    "op3_packed_matrices": op3_packed_matrices,
    "op4_mixing": op4_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_host_quality": op6_host_quality,
    "op7_min_bin_slack": op7_min_bin_slack,
    "op8_near_dups": op8_near_dups,
    "op9_language": op9_language,
    "op10_disclosure": op10_disclosure,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_web_archive": op13_web_archive,
    "pipeline": pipeline,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.mix_sql(),
        "op11_prefix_trie": prefixes.prefix_trie_sql(),
        "op12_centroids": centroids.cluster_sql(),
        "op13_web_archive": warc.archived_pages_sql(),
    }
