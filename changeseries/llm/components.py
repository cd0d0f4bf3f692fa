"""Connected components of an undirected graph given as an edge table.

Alternating star contraction: every vertex hands its larger neighbours to its
smallest one (large star), then its smaller neighbours (small star), until every vertex
hangs at the smallest of its component. Edges point from the larger to the smaller vertex, so
both steps need only the smallest neighbour below each vertex: an aggregation with a
partial result per task, and a join. Edges are written after every round, column-wise, so that
the next one reads few files in a task where they are small, and never leave the executors; the
driver sees one number per round, that of the vertices at which something is left to contract.
A graph that consists of stars needs no round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeseries.llm.storage import written


def _below(edges: DataFrame) -> DataFrame:
    """The smallest neighbour ``m`` of each vertex that has smaller ones."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), "m")


def _both_ends(first: list, second: list) -> Column:
    return F.explode(F.array(F.struct(*first), F.struct(*second))).alias("end")


def _large_star(edges: DataFrame) -> DataFrame:
    return edges.join(_below(edges), F.col("v") == F.col("center"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    starred = edges.join(_below(edges), F.col("u") == F.col("center"))
    hung = starred.select(_both_ends(["u", "m"], [F.col("v").alias("u"), "m"])).select("end.u", F.col("end.m").alias("v"))
    return hung.where("u <> v").distinct()


def _unfinished(edges: DataFrame) -> int:
    """How many vertices hang at several smaller ones, or at one while others hang at them."""
    ends = edges.select(_both_ends([F.col("u").alias("x"), F.lit(1).alias("up")], [F.col("v").alias("x"), F.lit(0).alias("up")]))
    places = ends.groupBy("end.x").agg(F.sum("end.up").alias("up"), F.count("*").alias("n"))
    return places.where("up > 1 OR (up = 1 AND n > 1)").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every vertex that is not the smallest of its component.

    ``edges`` has two long columns; order, repetitions and loops do not matter.
    """
    now = edges.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(now.distinct(), "edges")
    while _unfinished(now):
        now = written(_small_star(_large_star(now)), "edges")
    return now.toDF("node", "component")
