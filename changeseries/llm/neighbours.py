"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors are scaled by the longest one and given one more coordinate that makes them unit vectors,
queries are scaled to length one; the largest inner product is then the smallest
distance. Each of ``TABLES`` tables cuts space into buckets by several projections on normal random
directions, ``floor((a v + b) / width)``. A query visits its own bucket and then
neighbouring ones in the order of their estimated success: moving a projection over a
border costs the squared distance to that border, and sets of moves are tried by the sum
of their costs, in the order that these sums have on average. All candidates are ranked by
their exact inner products in double precision.

The width and the number of probes are fitted on a bounded sample
(``SAMPLE_VECTORS`` vectors, first by hash) so that the sample's recall reaches
``TARGET_RECALL``; every vector is indexed. The number of projections follows the number of vectors.

Equal vectors form a class that is indexed once, with its ``k + 1`` smallest ids.
Buckets are cells; cells of more than ``CELL_VECTORS`` vectors are split, and groups
of cells of bounded size are what a task compares with the queries
that probe them, in blocks. A query for which the probes find fewer than ``k`` is compared with all
vectors. No pair leaves a task except a query's best in that group.

Results for odd rows: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as rows or as queries; so do rows without an id. Rows of equal vectors tie and are ranked by
id. A row never finds itself, but repeated rows of a query are answered once, and each of them is found by others. Vectors are
compared with those of the same length only. An empty table gives an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeseries.storage import checkpoint_folder

TABLES = 4
SAMPLE_VECTORS = 4_000
SAMPLE_QUERIES = 200
TARGET_RECALL = 0.92
WIDTH_FACTOR = 2.0
CELL_VECTORS = 20_000
BLOCK_QUERIES = 256
SEED = 20


@dataclass(frozen=True)
class Hashing:
    """``tables`` x ``projections`` random directions; the same for the same arguments everywhere."""

    dimension: int
    projections: int
    width: float
    longest: float
    tables: int = TABLES

    def _directions(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng([SEED, self.dimension, self.projections])
        directions = random.normal(size=(self.dimension + 1, self.tables * self.projections))
        return directions, random.uniform(0, self.width, self.tables * self.projections)

    def _projected(self, unit: np.ndarray) -> np.ndarray:
        directions, offsets = self._directions()
        return ((unit @ directions + offsets) / self.width).reshape(len(unit), self.tables, self.projections)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        scaled = rows / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        return self._projected(np.column_stack((scaled, rest)))

    def queries(self, rows: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((rows**2).sum(axis=1))
        return self._projected(np.column_stack((rows / lengths[:, None], np.zeros(len(rows)))))


def bucket_keys(places: np.ndarray) -> np.ndarray:
    """64-bit keys of buckets ``[..., tables, projections]``; the table is part of the key."""
    keys = np.broadcast_to(np.arange(1, places.shape[-2] + 1, dtype=np.uint64), places.shape[:-1]).copy()
    for i in range(places.shape[-1]):
        keys = (keys ^ places[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def perturbations(projections: int, probes: int) -> np.ndarray:
    """The first ``probes`` sets of moves as 0/1 rows over the ``2 * projections`` moves ranked by cost.

    Costs are the expected squares of ordered border distances. Moving one projection both
    ways is no set; of a pair of opposite moves the ranks add up to ``2 * projections - 1`` on average.
    """
    moves = 2 * projections
    rank = np.arange(1, projections + 1)
    low = rank * (rank + 1) / (4 * (projections + 1) * (projections + 2))
    high = 1 - rank[::-1] / (projections + 1) + low[::-1]
    cost = np.concatenate((low, high))
    rows, heap = [np.zeros(moves, np.int8)], [(cost[0], (0,))]
    while heap and len(rows) < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < moves:
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
        if all(moves - 1 - move not in chosen for move in chosen):
            rows.append(np.zeros(moves, np.int8))
            rows[-1][list(chosen)] = 1
    return np.array(rows)


def probed_buckets(hashing: Hashing, rows: np.ndarray, probes: int) -> np.ndarray:
    """Keys ``[query, table, probe]`` of the buckets each query visits."""
    places = hashing.queries(rows)
    own = np.floor(places)
    below = places - own
    sets = perturbations(hashing.projections, probes)
    costs = np.concatenate((below**2, (1 - below) ** 2), axis=2)
    order = np.argsort(costs, axis=2)
    projection, direction = order % hashing.projections, np.where(order < hashing.projections, -1, 1)
    moves = np.zeros((*order.shape, hashing.projections), np.int8)
    np.put_along_axis(moves, projection[..., None], direction[..., None].astype(np.int8), axis=3)
    visited = np.einsum("pm,qtmk->qptk", sets.astype(np.float32), moves.astype(np.float32))
    return np.swapaxes(bucket_keys(own[:, None] + visited), 1, 2)


def fit(sample: np.ndarray, vectors: int, longest: float, k: int) -> tuple[Hashing, int]:
    """Hashing and number of probes with which the sample finds ``TARGET_RECALL`` of its neighbours."""
    projections = int(np.clip(round(np.log2(max(vectors, 1) / 100) / 1.3), 1, 24))
    queries = sample[:SAMPLE_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return Hashing(sample.shape[1], 1, 2.0, longest), 3
    nearest = np.argsort(-scores, axis=1)[:, :k]
    lengths = np.sqrt((queries**2).sum(axis=1)) * longest
    kth = np.take_along_axis(scores, nearest[:, -1:], 1)[:, 0] / lengths
    width = WIDTH_FACTOR * float(np.median(np.sqrt(np.maximum(2 - 2 * kth, 1e-6))))
    hashing = Hashing(sample.shape[1], projections, width, longest)
    keys, most, probes = bucket_keys(np.floor(hashing.vectors(sample))), 3**projections, min(8, 3**projections)
    while True:
        visited = probed_buckets(hashing, queries, probes)
        found = np.zeros(nearest.shape, bool)
        for table in range(hashing.tables):
            wanted = keys[nearest, table]
            found |= np.array([np.isin(w, v) for w, v in zip(wanted, visited[:, table])])
        if found.mean() >= TARGET_RECALL or probes >= most:
            return hashing, probes
        probes = min(probes * 3 // 2, most)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, dimension, vector`` (bytes of doubles) and ``norm`` of the rows that take part."""
    for batch in batches:
        ids, vectors, norms, sizes = [], [], [], []
        for identity, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            if identity is None or not vector.is_valid or not len(vector):
                continue
            values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            norm = float(np.sqrt((values**2).sum()))
            if np.isfinite(values).all() and 0 < norm < np.inf:
                ids.append(identity)
                vectors.append((values + 0.0).tobytes())
                norms.append(norm)
                sizes.append(len(values))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())],
            ["id", "dimension", "vector", "norm"],
        )


def _best(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The ``k`` best classes of each query among the cells of one group that it visits."""
    out_query, out_vector, out_score = [], [], []
    if index.num_rows and queries.num_rows:
        vectors, nodes = _matrix(index.column("vector").combine_chunks()), index.column("node").to_numpy()
        cells, cell_of = np.unique(index.column("cell").to_numpy(), return_inverse=True)
        first_table = index.column("table").to_numpy() == 0
        for first in range(0, queries.num_rows, BLOCK_QUERIES):
            block = queries.slice(first, BLOCK_QUERIES)
            scores = _matrix(block.column("vector").combine_chunks()) @ vectors.T
            for row, (query, visited) in enumerate(zip(block.column("query").to_pylist(), block.column("cells"))):
                if visited.is_valid:
                    at = np.searchsorted(cells, wanted := visited.values.to_numpy(zero_copy_only=False))
                    at = at[at < len(cells)][cells[at[at < len(cells)]] == wanted[at < len(cells)]]
                    open_cells = np.zeros(len(cells), bool)
                    open_cells[at] = True
                    seen = np.flatnonzero(open_cells[cell_of])
                else:
                    seen = np.flatnonzero(first_table)
                found, owners = scores[row, seen], nodes[seen]
                owners, once = np.unique(owners, return_index=True)
                found = found[once]
                if len(found) > k:
                    least = np.partition(found, len(found) - k)[len(found) - k]
                    owners, found = owners[found >= least], found[found >= least]
                order = np.lexsort((owners, -found))[:k]
                out_query += [query] * len(order)
                out_vector += owners[order].tolist()
                out_score += found[order].tolist()
    return pa.table({"query": pa.array(out_query, pa.int64()), "node": pa.array(out_vector, pa.int64()), "near": pa.array(out_score, pa.float64())})


def _classes(usable: DataFrame, k: int) -> DataFrame:
    """``node`` (smallest id), ``ids`` (the ``k + 1`` smallest), ``vector`` of every different vector."""
    ranked = usable.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.select(F.col("ids")[0].alias("node"), "ids", "vector")


def _indexed(classes: DataFrame, hashing: Hashing) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bucket_keys(np.floor(hashing.vectors(_matrix(batch.column("vector")))))
                row = pa.array(np.repeat(np.arange(batch.num_rows), hashing.tables))
                table = pa.array(np.tile(np.arange(hashing.tables, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(row), batch.column("vector").take(row), table, pa.array(keys.ravel())],
                    ["node", "vector", "table", "bucket"],
                )

    return classes.select("node", "vector").mapInArrow(keyed, "node long, vector binary, table int, bucket long")


def _probing(queries: DataFrame, hashing: Hashing, probes: int) -> DataFrame:
    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                keys = probed_buckets(hashing, _matrix(part.column("vector")), probes)
                row = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1] * keys.shape[2]))
                yield pa.RecordBatch.from_arrays([part.column("query").take(row), pa.array(keys.ravel())], ["query", "bucket"])

    return queries.mapInArrow(visiting, "query long, bucket long")


def _one_dimension(usable: DataFrame, is_query: Column, k: int, dimension: int) -> DataFrame:
    """``query, node, ids, near``: the classes found for every query class of one vector length."""
    classes = _classes(usable, k).checkpoint()
    count, longest = classes.count(), usable.agg(F.max("norm")).first()[0]
    by_hash = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_VECTORS)
    sample = np.array([np.frombuffer(r.vector, np.float64) for r in by_hash.select("vector").collect()])
    hashing, probes = fit(sample, count, longest, k)
    groups = max(1, -(-count * hashing.tables // CELL_VECTORS))

    index = _indexed(classes, hashing)
    sizes = index.groupBy(F.col("bucket").alias("_bucket")).agg(F.ceil(F.count("*") / CELL_VECTORS).cast("int").alias("parts"))
    sizes = sizes.checkpoint()  # joins with it can then be split where a bucket is large
    cell = lambda bucket, part: F.xxhash64(bucket, part.cast("int"))
    group = F.pmod(F.col("cell"), F.lit(groups)).alias("group")
    members = (
        index.join(sizes, F.col("bucket") == F.col("_bucket"))
        .withColumn("cell", cell(F.col("bucket"), F.pmod(F.xxhash64("node"), F.col("parts"))))
        .select(group, "cell", "node", "vector", "table")
    )
    asked = usable.where(is_query).select("vector").distinct()
    queries = classes.join(asked, "vector", "left_semi").select(F.col("node").alias("query"), "vector").checkpoint()
    visits = (
        _probing(queries, hashing, probes)
        .join(sizes, F.col("bucket") == F.col("_bucket"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("cell", cell(F.col("bucket"), F.col("part")))
        .groupBy(group, "query")
        .agg(F.collect_set("cell").alias("cells"))
        .join(queries.withColumnRenamed("query", "_query"), F.col("query") == F.col("_query"))
        .select("group", "query", "vector", "cells")
    )

    def best(index_table: pa.Table, query_table: pa.Table) -> pa.Table:
        return _best(index_table, query_table, k + 1)

    def compared(pairs: DataFrame) -> DataFrame:
        found = members.groupBy("group").cogroup(pairs.groupBy("group")).applyInArrow(best, "query long, node long, near double")
        once = found.groupBy("query", "node").agg(F.max("near").alias("near"))
        order = Window.partitionBy("query").orderBy(F.desc("near"), "node")
        return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place").checkpoint()

    found = compared(visits)
    held = found.join(classes.select("node", F.size("ids").alias("held")), "node").groupBy("query").agg(F.sum("held").alias("held"))
    enough = held.where(F.col("held") > k).select(F.col("query").alias("_query"))
    short = queries.join(enough, F.col("query") == F.col("_query"), "left_anti")
    everywhere = short.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
        "query",
        "vector",
        F.lit(None).cast("array<bigint>").alias("cells"),
    )
    rest = compared(everywhere)
    first = found.join(short.select(F.col("query").alias("_query")), F.col("query") == F.col("_query"), "left_anti")
    ids = classes.select(F.col("node").alias("_node"), "ids", F.col("vector").alias("other"))
    asking = queries.select(F.col("query").alias("_query"), "vector")
    return (
        first.union(rest)
        .join(ids, F.col("node") == F.col("_node"))
        .join(asking, F.col("query") == F.col("_query"))
        .select("vector", "other", "ids")
    )


def _inner_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact inner products of ``vector`` and ``other``, summed in one order whatever the batch."""
    for batch in batches:
        if batch.num_rows:
            products = np.cumsum(_matrix(batch.column("vector")) * _matrix(batch.column("other")), axis=1)[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("ids"), pa.array(products)], ["vector", "ids", "score"])


def nearest(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``is_query``.

    ``is_query`` is a condition on a column named ``id``.
    """
    checkpoint_folder(embeddings.sparkSession)
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    usable = rows.mapInArrow(_usable, "id long, dimension int, vector binary, norm double").checkpoint()
    out = None
    for (dimension,) in usable.select("dimension").distinct().orderBy("dimension").collect():
        same = usable.where(F.col("dimension") == dimension)
        found = _one_dimension(same, is_query, k, dimension).mapInArrow(_inner_products, "vector binary, ids array<bigint>, score double")
        part = (
            same.where(is_query)
            .select(F.col("id").alias("query_id"), F.col("vector").alias("_vector"))
            .distinct()
            .join(found, F.col("_vector") == F.col("vector"))
            .select("query_id", "vector", "score", F.explode("ids").alias("vec_id"))
            .where("vec_id <> query_id")
        )
        order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("vector")
        out = part if out is None else out.union(part)
    if out is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out.select("query_id", "rank", "vec_id", "score")
