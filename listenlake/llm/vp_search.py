"""Nearest neighbours with a vantage-point tree in each shard.

Every row is dealt to a shard by hash, so that equal vectors spread out too.  A task builds the tree of its shard: a vantage point,
the distances of all others to it, the nearer half inside, the others outside, down to leaves of ``LEAF`` vectors.  By the
triangle inequality a half cannot hold anything closer than ``|d(query, vantage) - bound|``; it is skipped if ``factor`` times
that gap exceeds the distance of the query's k-th best so far.  Factor 1 is exact; larger ones skip more.

Queries go down a tree together, a block at a time, so that each node costs a few matrix steps.  First every query searches one
shard; the distance of its k-th best there travels with it to all other shards, where it prunes from the start.  The queries are a
stated set: sorted behind the rows of a shard they pass its tree, however many they are, and a shard returns at most k rows a query,
which a second shuffle merges.  A task holds one shard, its tree and one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled
from .textops import sides

LEAF = 128
#: Rows of a shard, on average, and queries of a block, at most.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024


def _distances(columns: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances of all queries to all columns, summed coordinate by coordinate, so that the same in whatever block a row stands."""
    total = np.zeros((queries.shape[1], columns.shape[1]))
    for x, q in zip(columns, queries):
        d = x[None, :] - q[:, None]
        total += d * d
    return np.sqrt(total)


class Tree:
    """A vantage-point tree over the rows of ``x``; ``ids`` break ties."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], ids))
        self.ids, self.columns = ids[order], np.ascontiguousarray(x[order].T)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[at] = (None, rows)
            return at
        vantage = rows[len(rows) // 2]
        d = _distances(self.columns[:, rows], self.columns[:, [vantage]])[0]
        inner = np.zeros(len(rows), dtype=bool)
        inner[np.argpartition(d, len(rows) // 2)[: len(rows) // 2]] = True  # halves stay even when distances tie
        bounds = d[inner].min(), d[inner].max(), d[~inner].min(), d[~inner].max()
        self.nodes[at] = (vantage, bounds, self._build(rows[inner]), self._build(rows[~inner]))
        return at


class Block:
    """Queries that search trees together: their vectors as columns, own ids, and the nearest rows found so far."""

    def __init__(self, own: np.ndarray, x: np.ndarray, worst: np.ndarray, k: int, factor: float):
        self.own, self.columns, self.worst, self.factor = own, np.ascontiguousarray(x.T), worst, factor
        self.d, self.i = np.full((len(own), k), np.inf), np.full((len(own), k), np.iinfo(np.int64).max)

    def search(self, tree: Tree) -> None:
        if len(self.own):
            self._visit(tree, tree.root, np.arange(len(self.own)), np.zeros(len(self.own)))

    def _visit(self, tree: Tree, at: int, some: np.ndarray, gap: np.ndarray) -> None:
        """The part of a tree below a node, for the queries that it may still help."""
        open_ = self.factor * gap <= self.worst[some]
        some, gap = some[open_], gap[open_]
        if not len(some):
            return
        node = tree.nodes[at]
        if node[0] is None:
            self._leaf(tree, node[1], some)
            return
        vantage, (in_low, in_high, out_low, out_high), inside, outside = node
        d = _distances(tree.columns[:, [vantage]], self.columns[:, some])[:, 0]
        slack = 1e-12 * (d + out_high)  # more than rounding can add
        gaps = [np.maximum(gap, np.maximum(low - d, d - high) - slack) for low, high in ((in_low, in_high), (out_low, out_high))]
        nearer = gaps[0] <= gaps[1]  # the more promising half is taken first
        for side, choice in ((inside, nearer), (outside, ~nearer), (outside, nearer), (inside, ~nearer)):
            self._visit(tree, side, some[choice], gaps[0 if side == inside else 1][choice])

    def _leaf(self, tree: Tree, rows: np.ndarray, some: np.ndarray) -> None:
        d = _distances(tree.columns[:, rows], self.columns[:, some])
        ids = np.broadcast_to(tree.ids[rows], d.shape)
        d[ids == self.own[some][:, None]] = np.inf
        better = np.flatnonzero(d.min(axis=1) <= self.worst[some])
        some = some[better]
        d, ids = np.concatenate([self.d[some], d[better]], axis=1), np.concatenate([self.i[some], ids[better]], axis=1)
        k = self.d.shape[1]
        order = np.lexsort((ids, d), axis=1)[:, :k]
        self.d[some], self.i[some] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
        self.worst[some] = np.minimum(self.worst[some], self.d[some, -1])


def _by_length(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, ids, vectors and reach of the rows, for each length of vector."""
    rows = pa.Table.from_batches(batches)
    ids, worst = (rows.column(c).to_numpy() for c in ("id", "worst"))
    vectors = rows.column("vector").combine_chunks()
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    lengths = np.diff(np.r_[0, ends])
    for n in np.unique(lengths).tolist():
        some = np.flatnonzero(lengths == n)
        yield n, ids[some], flat[(ends[some] - n)[:, None] + np.arange(n)], worst[some]


def _passing(k: int, factor: float, block: int):
    """Work on a stream of shards: of each the rows come first, of which a tree is made once, then all its queries pass it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, trees = None, [], None
        for at, side, batch in sides(batches):
            if at != shard:
                shard, rows, trees = at, [], None
            if side == 0:
                rows.append(batch)
                continue
            if trees is None:
                trees, rows = {n: Tree(ids, x) for n, ids, x, _ in _by_length(rows)} if rows else {}, []
            for start in range(0, batch.num_rows, block):
                for n, own, x, worst in _by_length([batch.slice(start, block)]):
                    if n not in trees:
                        continue
                    some = Block(own, x, worst.copy(), k, factor)
                    some.search(trees[n])
                    found = np.isfinite(some.d)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, found.sum(axis=1))), pa.array(some.i[found]), pa.array(some.d[found])], names=["query_id", "vec_id", "score"])

    return work


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor empty nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each query by Euclidean distance, in double precision.

    Returns ``query_id, rank`` (from 1)``, vec_id, score``; ties go to the smaller id, and rows with the query's own id are no
    candidates.  With fewer than ``k`` candidates all are returned.  Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do null ids; ids are whole numbers, and vectors of different lengths are never compared.
    Rows that repeat an id are candidates each; a query id is asked once, with the first of its vectors in vector order.
    Empty tables give an empty one; other columns are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_column).cast("long").alias("id"), F.transform(vector_column, lambda v: v.cast("double")).alias("vector"))
        return df.where(F.col("id").isNotNull() & usable(F.col("vector")))

    base = clean(rows)
    asked = settled(clean(queries).groupBy("id").agg(F.min("vector").alias("vector")))
    shards = max(1, -(-base.count() // SHARD_ROWS))
    base = base.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).alias("shard"), F.lit(0).alias("side"), "id", "vector", F.lit(float("inf")).alias("worst"))
    asked = asked.withColumn("home", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)))

    def met(queries: DataFrame) -> DataFrame:
        stream = base.unionByName(queries.select("shard", F.lit(1).alias("side"), "id", "vector", "worst")).repartition("shard").sortWithinPartitions("shard", "side")
        return stream.mapInArrow(_passing(k, factor, BLOCK_QUERIES), "query_id long, vec_id long, score double")

    near = settled(met(asked.select(F.col("home").alias("shard"), "id", "vector", F.lit(float("inf")).alias("worst"))))
    reach = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(F.lit(float("inf"))).alias("worst"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    asked = asked.join(reach.withColumnRenamed("query_id", "id"), "id", "left").withColumn("shard", others).where("shard <> home")
    found = met(asked.select("shard", "id", "vector", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))).unionByName(near)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
