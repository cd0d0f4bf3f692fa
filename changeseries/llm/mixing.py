"""Mixing sources to target weights by weighted fair queueing.

Every document of a source waits in a shuffled queue. The virtual finish time of a
document is the number of its source's tokens up to and including it, divided by
the source's weight; a source may be passed up to ``max_epochs`` times, a later
pass continues the count. Serving all documents in the order of their virtual
finish times until the total budget is spent takes from every source in proportion
to its weight, and hands what an exhausted source leaves to the others by weight.

Nothing is sorted in one task. Queues are cut into slices of the shuffle hash and
the virtual time into equally wide bins, each holding a bounded number of
documents on average whatever a source's size; prefix sums over the slices
and bins, which are few, give every document its place. The budget's end is found
by summing the bins, then the documents of the one bin in which it falls.

The shuffle is an md5 of the seed and the id, so that reruns agree, also after a lost executor.

Results for odd rows: null text has size 0. A null source is a source of its own,
after all others. Repeated rows each count as a document; rows with equal ids and
sizes are told apart by nothing and queue one after the other. An empty table gives
an empty result, and if no document has a word, all targets and takings are 0. Only the three
named columns are read, so that other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeseries.llm.columns import word_count
from changeseries.storage import checkpoint_folder

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SLICE_DOCUMENTS = 2_000
SEED = "mix"


def queue_hash(identity: Column, seed: str) -> Column:
    """32 hexadecimal digits, as good as random, the same in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(identity.cast("string"), F.lit("null"))))


def source_table(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """``source, source_size, weight, target``: one row per source.

    The targets are the level of water poured into vessels as wide as the weights and
    holding ``max_epochs`` times the source's size: vessels are filled in the order
    of their heights; the level stops in the first one that it does not reach the top of.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    vessels = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    height = F.col("cap") / F.col("weight")
    lower = Window.orderBy(height, F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        vessels.withColumn("height", height)
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(lower), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("stops", F.when(F.col("level") <= F.col("height"), F.struct("height", "full", "level")))
        .withColumn("level", F.min("stops").over(everything)["level"])
        .withColumn("all_weights", F.sum("weight").over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return level.select("source", "source_size", "weight", "all_weights", "budget", F.coalesce(target, F.lit(0.0)).alias("target"))


def _slice(queued: Column, slices: Column) -> Column:
    """Number of the slice of a hash: its first 8 digits scaled to the number of slices."""
    return F.floor(F.conv(F.substring(queued, 1, 8), 16, 10).cast("long") * slices / F.lit(2**32)).cast("long")


def queued_documents(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with ``before``, the tokens of its source ahead of it in the queue."""
    slices = sizes.groupBy("source").agg(F.ceil(F.count("*") / SLICE_DOCUMENTS).alias("slices"))
    known = sources.join(slices.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = (
        sizes.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("slice", _slice(F.col("queued"), F.col("slices")))
    )
    per_slice = placed.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        F.col("source").alias("_source"),
        F.col("slice").alias("_slice"),
        F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("slice_start"),
    )
    within = Window.partitionBy("source", "slice").orderBy("queued", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
        .withColumn("before", F.col("slice_start") + F.col("ahead"))
        .select("id", "source", "queued", "size", "source_size", "weight", "all_weights", "budget", "target", "before")
    )


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("before") + F.col("size")) / F.col("weight")


def cut_place(queued: DataFrame, max_epochs: int) -> DataFrame:
    """One row ``cut``: finish time and queue hash of the last document that the budget pays for."""
    entries = (
        queued.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("finish", _finish(F.col("epoch")))
    )
    width = queued.agg((F.max("budget") / F.count("*") * SLICE_DOCUMENTS / F.max("all_weights")).alias("width"))
    binned = entries.crossJoin(F.broadcast(width)).withColumn("bin", F.floor(F.col("finish") / F.col("width")))
    bins = binned.groupBy("bin").agg(F.sum("size").alias("in_bin"), F.max("budget").alias("budget"))
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        bins.withColumn("through", F.sum("in_bin").over(running))
        .where("through >= budget")
        .orderBy("bin")
        .limit(1)
        .select(F.col("bin").alias("cut_bin"), (F.col("through") - F.col("in_bin")).alias("spent"))
        .crossJoin(F.broadcast(width))
    )
    bin_start = F.struct((F.col("cut_bin") * F.col("width")).alias("finish"), F.lit("").alias("queued"))
    order = Window.orderBy("finish", "queued", "id", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, 0)
    paid = (
        binned.drop("width")
        .join(F.broadcast(last), F.col("bin") == F.col("cut_bin"))
        .withColumn("through", F.col("spent") + F.sum("size").over(order))
        .where("through - size / 2.0 <= budget")
        .select(F.struct("finish", "queued").alias("cut"))
    )
    return paid.union(last.select(bin_start)).agg(F.max("cut").alias("cut"))


def mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``id, source, size, source_size, target, epochs, taken``, one row per document.

    ``epochs`` is how often the mix takes the document, ``taken`` the words that makes.
    """
    sizes = documents.select(
        F.col(id_column).alias("id"),
        F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"),
        queue_hash(F.col(id_column), seed).alias("queued"),
    )
    checkpoint_folder(documents.sparkSession)
    sizes = sizes.checkpoint()
    queued = queued_documents(sizes, source_table(sizes, weights, max_epochs)).checkpoint()
    passes = F.array(*[F.struct(_finish(F.lit(e)).alias("finish"), F.col("queued").alias("queued")) for e in range(max_epochs)])
    return (
        queued.crossJoin(F.broadcast(cut_place(queued, max_epochs)))
        .withColumn("epochs", F.coalesce(F.size(F.filter(passes, lambda p: p <= F.col("cut"))), F.lit(0)))
        .select(
            F.col("id").alias(id_column),
            F.col("source").alias(source_column),
            "size",
            "source_size",
            "target",
            "epochs",
            (F.col("epochs") * F.col("size")).alias("taken"),
        )
    )
