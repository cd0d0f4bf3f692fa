"""k-means with warping distance and warped-average centers.

One job per round. Every task assigns its series to the nearest center, aligns
them with that center and adds up, per cluster and center position, the values
that were warped there. Only these sums are shuffled, packed as a few arrays per
task, so a cluster may hold any share of the series and a center may be as long as it likes: no value
of a sum is a row of its own, in tasks or on the driver.

A fit that is given a folder writes centers and assignment of every round there and
goes on from the last one when it is started again (``Rounds``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeseries.functions.text import joined_name
from changeseries.operators.kmeans import Clusters, center_table
from changeseries.operators.warping import (
    assign_nearest,
    barycenter_sums,
    center_groups,
    distinct,
    nearest,
    shared_centers,
    stacks,
)

# Center positions of one array: what a task of the reduction holds, 64 KB with sums and counts.
BLOCK_POSITIONS = 4096
# One row is a block of a cluster's positions: their sums and their counts. Block -1 carries the
# cluster's cost, and its size and the two sums of row hashes that identify its set of members.
PARTIAL_SCHEMA = "cluster INT, block INT, totals BINARY, weights BINARY"
SUMMARY = -1

Centers = Sequence[Sequence[float]]


class _Partials:
    """Running sums of one task."""

    def __init__(self, centers: Centers) -> None:
        self.centers = [np.asarray(center, dtype=np.float64) for center in centers]
        self.groups = center_groups(centers)
        self.sums = [np.zeros(len(center)) for center in centers]
        self.hits = [np.zeros(len(center), dtype=np.int64) for center in centers]
        self.cost = np.zeros(len(centers))
        self.size = np.zeros(len(centers), dtype=np.int64)
        self.marks = np.zeros((2, len(centers)), dtype=np.uint64)

    def add(self, series: np.ndarray, marks: np.ndarray) -> None:
        rows, like = distinct(series)
        weight = np.bincount(like)
        best, cost = nearest(rows, self.groups)
        if (best < 0).any():
            raise ValueError("a series has no finite distance to any center")
        for cluster in np.unique(best):
            mine = best == cluster
            center = np.broadcast_to(
                self.centers[cluster], (np.count_nonzero(mine), len(self.centers[cluster]))
            )
            sums, hits = barycenter_sums(rows[mine], center)
            self.sums[cluster] += weight[mine] @ sums
            self.hits[cluster] += weight[mine] @ hits
            self.cost[cluster] += weight[mine] @ cost[mine]
            self.size[cluster] += weight[mine].sum()
            self.marks[:, cluster] += marks[:, mine[like]].sum(axis=1, dtype=np.uint64)

    def rows(self) -> pa.RecordBatch:
        rows = []
        for cluster in np.flatnonzero(self.size).tolist():
            marks = [self.size[cluster].view(np.uint64), *self.marks[:, cluster]]
            rows.append((cluster, SUMMARY, self.cost[cluster : cluster + 1].tobytes(), np.array(marks, np.uint64).tobytes()))
            for block, first in enumerate(range(0, len(self.sums[cluster]), BLOCK_POSITIONS)):
                part = slice(first, first + BLOCK_POSITIONS)
                rows.append((cluster, block, self.sums[cluster][part].tobytes(), self.hits[cluster][part].view(np.uint64).tobytes()))
        return _partial_rows(rows)


def _partial_rows(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type_) for values, type_ in zip(columns, types)], names=["cluster", "block", "totals", "weights"]
    )


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tasks' arrays of one block, as they arrive. Counts and marks add up modulo 2**64."""
    totals = weights = key = None
    for batch in batches:
        for cluster, block, some, counts in zip(*(batch.column(i) for i in range(4))):
            some, counts = np.frombuffer(some.as_py()), np.frombuffer(counts.as_py(), np.uint64)
            if totals is None:
                key, totals, weights = (cluster.as_py(), block.as_py()), some.copy(), counts.copy()
            else:
                totals += some
                weights += counts
    if key is not None:
        yield _partial_rows([(*key, totals.tobytes(), weights.tobytes())])


def barycenter_partials(features: DataFrame, centers: Centers | Broadcast) -> DataFrame:
    """Sums per cluster and block of positions over all series, as ``PARTIAL_SCHEMA``."""
    shared = centers if isinstance(centers, Broadcast) else shared_centers(features, centers)
    rows = features.select(
        "features",
        F.xxhash64("name", "features").alias("hash_a"),
        F.xxhash64(F.lit("second"), "features", "name").alias("hash_b"),
    )

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials = _Partials(shared.value)
        for batch in batches:
            marks = np.stack(
                [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2)]
            )
            for at, series in stacks(batch.column(0)):
                partials.add(series, marks[:, at])
        yield partials.rows()

    return rows.mapInArrow(accumulate, PARTIAL_SCHEMA).groupBy("cluster", "block").applyInArrow(_added_up, PARTIAL_SCHEMA)


def barycenter_positions(partials: DataFrame) -> DataFrame:
    """``(cluster, position, total, weight)``, the packed sums read off one by one."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, block, totals, weights in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sums = np.frombuffer(totals)
                places = np.arange(len(sums), dtype=np.int32) + np.int32(block * BLOCK_POSITIONS)
                columns = [np.full(len(sums), cluster, np.int32), places, sums, np.frombuffer(weights, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "position", "total", "weight"])

    schema = "cluster INT, position INT, total DOUBLE, weight BIGINT"
    return partials.where(F.col("block") != SUMMARY).mapInArrow(unpack, schema)


#: Per cluster its size and two 64-bit sums of row hashes.
Fingerprint = dict[int, tuple[int, int, int]]


def updated_centers(features: DataFrame, centers: Centers) -> tuple[list[np.ndarray], Fingerprint, float]:
    """One round: new centers, a fingerprint of the assignment, and its total cost.

    What comes to the driver are arrays, together as large as the centers. Equal fingerprints
    mean that no series changed its cluster, without keeping
    or joining the assignments. A cluster without members keeps its center.
    """
    renewed = [np.array(center, dtype=np.float64) for center in centers]
    fingerprint, cost = {}, 0.0
    shared = shared_centers(features, centers)
    rows = barycenter_partials(features, shared).toArrow()
    shared.destroy()
    for cluster, block, totals, weights in zip(*(rows.column(i) for i in range(4))):
        cluster, block = cluster.as_py(), block.as_py()
        totals, weights = np.frombuffer(totals.as_py()), np.frombuffer(weights.as_py(), np.uint64)
        if block == SUMMARY:
            fingerprint[cluster] = tuple(weights.tolist())
            cost += float(totals[0])
        else:
            first = block * BLOCK_POSITIONS
            renewed[cluster][first : first + len(totals)] = totals / weights
    return renewed, fingerprint, cost


def initial_centers(features: DataFrame, k: int, seed: int = 0) -> list[np.ndarray]:
    """k different series, drawn by an md5 of seed and name: exact, repeatable, the same everywhere."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), joined_name(F.col("name"))))
    chosen = features.orderBy(draw, "name").limit(k).select("features").toArrow().column(0)
    if len(chosen) < k:
        raise ValueError(f"k = {k} is more than the {len(chosen)} series there are")
    return [row.values.to_numpy(zero_copy_only=False).astype(np.float64) for row in chosen]


class State(NamedTuple):
    """After ``round`` updates: the centers, and the assignment that the last update started from."""

    round: int
    centers: list[np.ndarray]
    fingerprint: Fingerprint | None
    done: bool


class Rounds:
    """The states of a fit in a shared folder, one table a round, found again by the folder's name.

    A round is there once its writer has committed it; what a broken attempt has left behind is not read. ``job``
    tells apart what may not be mixed: another number of clusters, seed or start, or other series. A folder of another
    job is refused. One fit at a time may use a folder.
    """

    SCHEMA = "job STRING, done BOOLEAN, cluster INT, center BINARY, size DECIMAL(20,0), mark_a DECIMAL(20,0), mark_b DECIMAL(20,0)"

    def __init__(self, spark: SparkSession, folder: str, job: str):
        self.spark, self.folder, self.job = spark, folder.rstrip("/"), job

    def _read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self.SCHEMA + ", round INT").parquet(self.folder)
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def last(self) -> State | None:
        """The latest state, or None in a new folder."""
        rows = self._read()
        number = None if rows is None else rows.agg(F.max("round")).first()[0]
        if number is None:
            return None
        found = rows.where(F.col("round") == number).orderBy("cluster").collect()  # as many rows as clusters
        if found[0].job != self.job:
            raise ValueError(f"{self.folder} holds the rounds of another job")
        marks = {r.cluster: (int(r.size), int(r.mark_a), int(r.mark_b)) for r in found if r.size is not None}
        return State(number, [np.frombuffer(r.center) for r in found], marks or None, found[0].done)

    def keep(self, state: State) -> None:
        prints = state.fingerprint or {}
        rows = [
            (self.job, state.done, cluster, bytearray(np.asarray(center, np.float64).tobytes()), *prints.get(cluster, (None,) * 3))
            for cluster, center in enumerate(state.centers)
        ]
        table = self.spark.createDataFrame([(*r[:4], *(None if x is None else Decimal(x) for x in r[4:])) for r in rows], self.SCHEMA)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/round={state.round}")


def job_of(features: DataFrame, k: int, seed: int, centers: Centers | None) -> str:
    """What a fit depends on, as a text: its start, and number and hashes of its series."""
    marks = features.agg(F.count("*"), F.sum(F.xxhash64("name", "features").cast("decimal(38,0)"))).first()
    start = f"k={k} seed={seed}" if centers is None else sha256(b"".join(np.asarray(c, np.float64).tobytes() + b";" for c in centers)).hexdigest()
    return f"{start} series={marks[0]} marks={marks[1]}"


def fit_dba_kmeans(
    features: DataFrame,
    k: int = 10,
    max_iter: int = 100,
    seed: int = 0,
    centers: Centers | None = None,
    resume: str | None = None,
) -> Clusters:
    """Assign and update until no series changes its cluster, or ``max_iter`` updates.

    ``features`` is read once per round; hand in a stored table, not a long plan
    (``storage.stored``). ``centers`` overrides the drawn initial centers. With ``resume``, a folder that
    all executors share, every round is kept there, and a fit of the same series with the same start goes on
    after the last one; ``max_iter`` counts all rounds together.
    """
    if centers is None and k < 1:
        raise ValueError("k must be positive")
    rounds = None if resume is None else Rounds(features.sparkSession, resume, job_of(features, k, seed, centers))
    state = None if rounds is None else rounds.last()
    if state is None:
        start = initial_centers(features, k, seed) if centers is None else [np.array(c, dtype=np.float64) for c in centers]
        state = State(0, start, None, False)
    while not state.done and state.round < max_iter:
        renewed, fingerprint, _ = updated_centers(features, state.centers)
        if fingerprint == state.fingerprint:
            state = state._replace(done=True)
        else:
            state = State(state.round + 1, renewed, fingerprint, False)
        if rounds is not None:
            rounds.keep(state)
    return Clusters(
        assign_nearest(features, state.centers), center_table(features.sparkSession, state.centers)
    )


def assignment_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row ``moved``: how many series lie in another cluster than before."""
    before = previous.select("name", F.col("assignedCluster").alias("before"))
    after = current.select("name", F.col("assignedCluster").alias("after"))
    return before.join(after, "name").agg(F.count_if(F.col("before") != F.col("after")).alias("moved"))


def moved_between(features: DataFrame, previous: Centers, current: Centers) -> DataFrame:
    """One row ``moved``: how many series are nearest to another center of ``current`` than of ``previous``.

    Both assignments are made in one pass over the series; what is shuffled is a number per task.
    """
    before, after = shared_centers(features, previous), shared_centers(features, current)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, moved = [center_groups(before.value), center_groups(after.value)], 0
        for batch in batches:
            for _, series in stacks(batch.column(0)):
                rows, like = distinct(series)
                numbers = [nearest(rows, groups)[0] for groups in sets]
                moved += int(np.bincount(like)[numbers[0] != numbers[1]].sum())
        yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["moved"])

    counted = features.select("features").mapInArrow(count, "moved BIGINT")
    return counted.agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"))
