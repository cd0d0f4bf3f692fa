"""Registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeseries.llm import common_lines, hard_negatives, importance, lm, minhash, mixing, neighbours, packing, quality, secrets, substring_dedup, url_filters, warc
from changeseries.llm.storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, folder, "pages"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_table(spark, folder, "documents"), language_column="lang")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(_table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[F.size(f"base_{kind.name}").cast("long").alias(f"n_{kind.name}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.concat("base", "added", "crossing")).alias("spans"),
    )


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), path)
    records = (
        warc.read_archives(spark, path)
        .select("record_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("bytes"))
        .checkpoint()
    )
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'").drop("bytes")
    full = responses.groupBy(F.col("record_id").alias("response")).agg(F.max("bytes").alias("bytes")).checkpoint()
    revisits = revisits.join(full, F.col("refers_to") == F.col("response"), "left").drop("response")
    return responses.unionByName(revisits).select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"
    )


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), percent=85)


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = common_lines.drop_common_lines(_table(spark, folder, "documents"), least=10, shortest=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    query.__name__: query for query in (
        op1_url_filters,
        op2_quality_rules,
        op3_substring_dedup,
        op4_lm_scoring,
        op5_mixing,
        op6_secret_scans,
        op7_nearest_neighbours,
        op8_warc,
        op9_packing,
        op10_minhash,
        op11_line_dedup,
        op12_hard_negatives,
        op13_importance_resampling,
    )
}
