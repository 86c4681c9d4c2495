"""The operators' queries over a data folder, and the same as SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm import (
    centroid_clusters,
    decontamination,
    html_text,
    language_id,
    periodic_runs,
    quality_rules,
    sentence_pieces,
    sharding,
    simhash_dedup,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from tidewarden.llm.common import documents
from tidewarden.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    import public_tokenizers

    return sentence_pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(documents(spark, sf_dir), piece_model())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), map_path=scratch_path(spark, "slot-map"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(documents(spark, sf_dir), piece_model())


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(documents(spark, sf_dir))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clustered(_table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentence_pieces, op2_language_id, op3_html_text, op4_decontamination, op5_sharding,
        op6_token_counts, op7_simhash_dedup, op8_quality_rules, op9_substring_dedup, op10_toxicity,
        op11_periodic_runs, op12_centroid_clusters, op13_url_filter,
    )
}
#: Operators whose rows SQL can give on whole tables in reasonable time; the others are tested by brute force.
ORACLE: dict[str, str] = {"op12_centroid_clusters": centroid_clusters.ORACLE}
