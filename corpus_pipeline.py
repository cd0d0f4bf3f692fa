"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes each
result to the shared folder and hands it, read again, to the next stage.

Results for odd rows: rows without an id pass the stages like any other, near-dedup included; different texts under one
id are different documents. Rows that are equal in id and text are copies, of which the one whose other columns come first
stays. Of a group of near copies the smallest id stays, rows without one last, ties by a hash of the text. Null and empty texts
fail the quality rules; texts are taken whole, however long, by every stage. Further columns of any name are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeseries.llm import minhash, mixing, packing, quality, secrets
from changeseries.llm.storage import shared_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_DUPLICATE_PERCENT = 80
TOKENIZER = "word_bpe_49k.json"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.judge(docs, keep=COLUMNS, language_column="lang").where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: that with the smallest id."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        kept = minhash.near_duplicates(docs, percent=NEAR_DUPLICATE_PERCENT).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    return _numbered_and_kept(docs)


def _numbered_and_kept(docs: DataFrame) -> DataFrame:
    """As above where ids are missing or repeated: rows are known by a number for each id and text."""
    key = F.coalesce(F.sha2("text", 256), F.lit("null"))
    named = docs.select(*COLUMNS).withColumn("_key", key)
    numbers = written(named.select("doc_id", "_key").distinct().withColumn("_row", F.monotonically_increasing_id()), "row-numbers")
    same = named["doc_id"].eqNullSafe(numbers["doc_id"]) & (named["_key"] == numbers["_key"])
    numbered = named.join(numbers, same).select(*[named[c] for c in COLUMNS], "_row")
    one_each = numbered.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("document"))
    rows = written(one_each.select("_row", "document.*"), "numbered")
    groups = minhash.near_duplicates(rows, id_column="_row", percent=NEAR_DUPLICATE_PERCENT).select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "_row")
    kept = groups.join(numbers, "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that look live masked in their texts."""
    scanned = secrets.scan(docs, keep=COLUMNS)
    masked = scanned.withColumn("masked", secrets.redacted(F.col("text"), F.col("live")))
    return masked.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without an id are known by their texts."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = docs.select(*COLUMNS).withColumn("_key", key)
    times = mixing.mix(keyed, id_column="_key").where("epochs > 0").groupBy("_key").agg(F.max("epochs").alias("_epochs"))
    return keyed.join(times, "_key").withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_epochs")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Token ids have no SQL form; a test holds every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    folder, rows = shared_path(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
