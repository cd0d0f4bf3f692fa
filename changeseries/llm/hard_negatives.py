"""Hard negatives from STR-packed R-trees.

A row's score is its whole-number inner product with an anchor. Rows are dealt into trees
by a hash, so that trees are of equal size whatever the data; every tree is packed by sort-tile-recursion: rows
are sorted by the label and cut into slabs, each slab by a coordinate, and so on, down to leaves of
``LEAF`` rows, over which nodes of ``FANOUT`` children are laid. Each node knows the least and
the greatest of its labels and of every coordinate. From these and an anchor follow, coordinate by
coordinate, an interval that holds the inner products of all its rows.

Anchors search in two passes. The first finds an anchor's nearest rows of its label, the positives:
a queue hands out nodes by their greatest possible score, and what is strictly below the k-th score found
ends the search; equal scores go on, as smaller ids win. The second finds the rows of
other labels in the score window of each positive: a node is opened only if its interval meets a
window and reaches that window's k-th score.

Anchors come in blocks and trees are many; every block meets every tree of its vectors' length, in a task of its own,
and the best of all trees are merged per anchor. Blocks and trees grow with the root of the table
up to a bound of memory, so what is shuffled stays small next to the arithmetic. The driver
learns three numbers about the table. Where products of whole numbers could leave the 53 bits of a
double, Python's integers are used; scores beyond the range of long count as its ends.

Results for odd rows: rows with a null label, a null vector, or a null or non-finite component take no part. Rows without
an id do, as candidates, and come after all others in ties. Rows with equal ids are rows of their own, and two such
anchors each have their results. Vectors of different lengths never meet; those of length 0 all score 0.
Very long vectors make smaller trees. An anchor without a positive, and a window without a row, give nothing.
An empty table gives an empty result. Only id, label and vector are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeseries.llm.batches import joined, parted
from changeseries.llm.storage import written

LEAF = 128
FANOUT = 16
#: Components of a tree and of a block of anchors: the least, and the most, which bound a task's memory.
TREE_VALUES, MOST_TREE_VALUES = 1 << 20, 1 << 24
BLOCK_VALUES, MOST_BLOCK_VALUES = 1 << 12, 1 << 21
EXACT = 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)

INDEX = "dim int, tree long, payload binary"
FOUND = "anchor long, anchor_id long, place int, partner_id long, partner_score long, id long, score long"


def pieces(values: int, least: int, most: int) -> int:
    """Into how many trees or blocks of ``least`` to ``most`` components a table of ``values`` is cut."""
    return max(1, -(-values // min(most, max(least, 64 * math.isqrt(values)))))


# --- one tree -----------------------------------------------------------------------


def tiled(keys: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of each leaf, by sort-tile-recursion over the columns of ``keys``."""
    leaves = []

    def cut(rows: np.ndarray, at: int) -> None:
        pages = -(-len(rows) // leaf)
        if pages <= 1:
            leaves.append(rows)
            return
        left = keys.shape[1] - at
        slabs = pages if left == 1 else min(pages, math.ceil(pages ** (1 / left) - 1e-9))
        rows = rows[np.argsort(keys[rows, at], kind="stable")]
        size = -(-pages // slabs) * leaf
        for first in range(0, len(rows), size):
            if left == 1:
                leaves.append(rows[first : first + size])
            else:
                cut(rows[first : first + size], at + 1)

    if len(keys):
        cut(np.arange(len(keys)), 0)
    return leaves


def packing_keys(labels: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The label, then the coordinates that are spread most, as many as leaves can be halved by."""
    halvings = max(1, math.ceil(math.log2(max(2, len(values) / LEAF))))
    spread = np.argsort(-np.ptp(values, axis=0).astype(np.float64), kind="stable") if len(values) else []
    return np.column_stack([labels, values[:, spread[: halvings - 1]]]) if len(spread) else labels[:, None]


class Tree:
    """Rows in packed order, and the boxes of all nodes: the leaves first, the root last."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, labels: np.ndarray, rows: np.ndarray, values: np.ndarray, starts: np.ndarray):
        self.ids, self.no_id, self.labels, self.rows, self.values = ids, no_id, labels, rows, values
        self.starts = np.append(starts, len(values))
        firsts = starts
        self.low, self.high = np.minimum.reduceat(values, firsts), np.maximum.reduceat(values, firsts)
        self.least_label, self.most_label = np.minimum.reduceat(labels, firsts), np.maximum.reduceat(labels, firsts)
        self.children: list[range | None] = [None] * len(firsts)
        begin, end = 0, len(firsts)
        while end - begin > 1:
            groups = np.arange(begin, end, FANOUT)
            for name, ufunc in (("low", np.minimum), ("high", np.maximum), ("least_label", np.minimum), ("most_label", np.maximum)):
                boxes = getattr(self, name)
                setattr(self, name, np.concatenate((boxes, ufunc.reduceat(boxes[begin:end], groups - begin))))
            self.children += [range(first, min(first + FANOUT, end)) for first in groups.tolist()]
            begin, end = end, len(self.children)

    @classmethod
    def to_bytes(cls, ids: np.ndarray, no_id: np.ndarray, labels: np.ndarray, rows: np.ndarray, values: np.ndarray) -> bytes:
        leaves = tiled(packing_keys(labels, values), LEAF)
        order = np.concatenate(leaves)
        starts = np.cumsum([0] + [len(leaf) for leaf in leaves[:-1]])
        kind = next(k for k in (np.int16, np.int32, np.int64) if not values.size or (values.min() >= np.iinfo(k).min and values.max() <= np.iinfo(k).max))
        stored = np.ascontiguousarray(values[order], kind)
        parts = [a[order].astype(np.int64).tobytes() for a in (ids, no_id, labels, rows)]
        return joined(*parts, starts.astype(np.int64).tobytes(), bytes([stored.itemsize]), stored.tobytes())

    @classmethod
    def from_bytes(cls, content: bytes) -> Tree:
        *numbers, size, values = parted(content)
        ids, no_id, labels, rows, starts = (np.frombuffer(n, np.int64) for n in numbers)
        dim = len(values) // size[0] // len(ids)
        return cls(ids, no_id.astype(bool), labels, rows, np.frombuffer(values, f"<i{size[0]}").reshape(len(ids), dim), starts)

    def facing(self, anchors: np.ndarray) -> Search:
        return Search(self, anchors)


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


class Search:
    """A tree and some anchors, in numbers whose sums of products are exact."""

    def __init__(self, tree: Tree, anchors: np.ndarray):
        exact = max(1, anchors.shape[1]) * _largest(tree.values) * _largest(anchors) < EXACT
        kind = np.float64 if exact else object
        self.tree, self.opened, self.clipped = tree, 0, not exact
        self.values, self.anchors = tree.values.astype(kind), anchors.astype(kind)
        low, high = tree.low.astype(kind), tree.high.astype(kind)
        up, down = np.maximum(self.anchors, 0), np.minimum(self.anchors, 0)
        self.most = self._in_range(up @ high.T + down @ low.T)
        self.least = self._in_range(up @ low.T + down @ high.T)

    def _in_range(self, scores: np.ndarray) -> np.ndarray:
        return np.clip(scores, *LONG) if self.clipped else scores

    def _leaves(self, number: int, wanted):
        """Rows and scores of the leaves that ``wanted(greatest, least, node)`` lets through, the best first.

        ``wanted`` returns None when no later node can be wanted either.
        """
        tree, most, least = self.tree, self.most[number], self.least[number]
        queue = [(-most[-1], len(tree.children) - 1)]
        while queue:
            bound, node = heapq.heappop(queue)
            answer = wanted(-bound, least[node], node)
            if answer is None:
                return
            if not answer:
                continue
            if (children := tree.children[node]) is not None:
                for child in children:
                    heapq.heappush(queue, (-most[child], child))
                continue
            self.opened += 1
            here = slice(tree.starts[node], tree.starts[node + 1])
            yield here, self._in_range(self.values[here] @ self.anchors[number])

    def _entries(self, here: slice, scores: np.ndarray, chosen: np.ndarray) -> list[tuple]:
        tree, first = self.tree, here.start
        return [(-int(scores[i]), bool(tree.no_id[first + i]), int(tree.ids[first + i])) for i in chosen.tolist()]

    def positives(self, number: int, label: int, row: int, k: int) -> list[tuple]:
        """``-score, without id, id`` of the k best rows of the label other than ``row``."""
        tree, best = self.tree, Best(k)

        def wanted(most, least, node):
            if best.full and most < best.kth:
                return None
            return tree.least_label[node] <= label <= tree.most_label[node]

        for here, scores in self._leaves(number, wanted):
            mask = (tree.labels[here] == label) & (tree.rows[here] != row)
            best.add(self._entries(here, scores, np.flatnonzero(mask & (scores >= best.kth) if best.full else mask)))
        return best.entries

    def negatives(self, number: int, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
        """For each window of scores the k best rows of other labels in it, as in ``positives``."""
        tree, bests = self.tree, [Best(k, low, high) for low, high in windows]
        open_ = [best for best in bests if best.low <= best.high]

        def wanted(most, least, node):
            if all(most < best.kth for best in open_):
                return None
            if tree.least_label[node] == label == tree.most_label[node]:
                return False
            return any(most >= best.kth and least <= best.high for best in open_)

        if not open_:
            return [[] for _ in bests]
        top = max(best.high for best in open_)
        for here, scores in self._leaves(number, wanted):
            mask = (tree.labels[here] != label) & (scores >= min(best.kth for best in open_)) & (scores <= top)
            if mask.any():
                entries = self._entries(here, scores, np.flatnonzero(mask))
                for best in open_:
                    best.add([e for e in entries if best.kth <= -e[0] <= best.high])
        return [best.entries for best in bests]


class Best:
    """The k first entries, and the score that another one has to reach."""

    def __init__(self, k: int, low: int = LONG[0], high: int = LONG[1]):
        self.k, self.low, self.high, self.kth, self.entries, self.full = k, low, high, low, [], False

    def add(self, entries: list[tuple]) -> None:
        if entries:
            self.entries = sorted(self.entries + entries)[: self.k]
            self.full = len(self.entries) == self.k
            if self.full:
                self.kth = -self.entries[-1][0]


def window_of(score: int, least_percent: int, most_percent: int) -> tuple[int, int]:
    """Whole numbers ``n`` with ``least_percent * score <= 100 * n <= most_percent * score``."""
    return -(-least_percent * score // 100), most_percent * score // 100


# --- tables -------------------------------------------------------------------------


def _matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)


def _building(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    no_id = table.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    payload = Tree.to_bytes(_numbers(table, "id"), no_id, _numbers(table, "label"), _numbers(table, "row"), _matrix(table, "vector", dim))
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "tree": pa.array([table.column("tree")[0].as_py()], pa.int64()),
            "payload": pa.array([payload], pa.binary()),
        }
    )


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [column.split()[0] for column in FOUND.split(", ")]
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, columns, kinds)})


def _searching(search):
    """A block of anchors and a tree: the rows that ``search`` makes for every anchor."""

    def each(anchors: pa.Table, index: pa.Table) -> pa.Table:
        if not anchors.num_rows or not index.num_rows:
            return _found([])
        facing = Tree.from_bytes(index.column("payload")[0].as_py()).facing(_matrix(anchors, "vector", anchors.column("dim")[0].as_py()))
        return _found([row for number, anchor in enumerate(anchors.drop(["vector"]).to_pylist()) for row in search(facing, number, anchor)])

    return each


def _id(entry: tuple) -> int | None:
    return None if entry[1] else entry[2]


def prepared(vectors: DataFrame, is_anchor: Column, label: Column, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``row, id, label, is_anchor, dim, vector`` of the rows that take part; vectors in whole numbers."""
    numbers = F.col(vector_column).cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(
            F.col(id_column).cast("long").alias("id"),
            label.cast("long").alias("label"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
            F.when(sound, F.transform(numbers, lambda x: F.floor(x * scale))).alias("vector"),
        )
        .where("label IS NOT NULL AND vector IS NOT NULL")
        .select(F.monotonically_increasing_id().alias("row"), "id", "label", "is_anchor", F.size("vector").alias("dim"), "vector")
    )


def _best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each group, in order: ``entries`` of ``-score, without id, id``. A tree sends at most k."""
    entry = F.struct((-F.col("score")).alias("below"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("score").alias("score"))
    return found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("entries"))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    most_percent: int = 100,
    scale: int = 256,
    label: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` and ``label`` (the column ``label`` by default) are expressions over the given columns. A vector's components
    become ``floor(scale * x)``. For each of an anchor's first ``positives`` rows of its label, the first ``negatives`` rows
    of other labels whose scores are ``least_percent`` to ``most_percent`` of the positive's.
    """
    rows = written(prepared(vectors, is_anchor, F.col("label") if label is None else label, scale, id_column, vector_column), "vectors")
    asked = F.when(F.col("is_anchor"), F.col("dim")).otherwise(0)
    values, anchor_values = rows.agg(F.coalesce(F.sum("dim"), F.lit(0)), F.coalesce(F.sum(asked), F.lit(0))).first()
    trees = pieces(values, TREE_VALUES, MOST_TREE_VALUES)
    blocks = pieces(anchor_values, BLOCK_VALUES, MOST_BLOCK_VALUES)

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count))

    def numbered(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    index = written(rows.withColumn("tree", dealt(trees)).groupBy("dim", "tree").applyInArrow(_building, INDEX), "trees")
    facing_blocks = index.withColumn("block", numbered(blocks))
    pair = ["dim", "tree", "block"]

    def searched(anchors: DataFrame, search) -> DataFrame:
        facing_trees = anchors.withColumn("block", dealt(blocks)).withColumn("tree", numbered(trees))
        return facing_trees.groupBy(*pair).cogroup(facing_blocks.groupBy(*pair)).applyInArrow(_searching(search), FOUND)

    def find_positives(facing: Search, number: int, anchor: dict):
        for entry in facing.positives(number, anchor["label"], anchor["row"], positives):
            yield anchor["row"], anchor["id"], 0, None, None, _id(entry), -entry[0]

    def find_negatives(facing: Search, number: int, anchor: dict):
        windows = [window_of(entry["score"], least_percent, most_percent) for entry in anchor["entries"]]
        for place, entries in enumerate(facing.negatives(number, anchor["label"], windows, negatives)):
            positive = anchor["entries"][place]
            for entry in entries:
                yield anchor["row"], anchor["id"], place, positive["id"], positive["score"], _id(entry), -entry[0]

    anchors = rows.where("is_anchor").select("row", "id", "label", "dim", "vector")
    chosen = written(_best_of(searched(anchors, find_positives), ["anchor"], positives), "positives")
    with_positives = anchors.join(chosen, F.col("row") == F.col("anchor")).drop("anchor")
    best = _best_of(searched(with_positives, find_negatives), ["anchor", "anchor_id", "place", "partner_id", "partner_score"], negatives)
    return best.select("anchor_id", F.col("partner_id").alias("positive_id"), F.col("partner_score").alias("positive_score"), F.posexplode("entries")).select(
        "anchor_id",
        "positive_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("col.id").alias("negative_id"),
        "positive_score",
        F.col("col.score").alias("negative_score"),
    )
