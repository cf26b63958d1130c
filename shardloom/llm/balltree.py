"""Exact top-k inner-product search with a ball tree in each shard.

1. Vectors are dealt to leaves of a coarse tree (median splits on the widest
   dimension of a bounded sample, ``SAMPLE`` vectors, ``MAX_LEAVES`` leaves at
   most).  Every vector goes to a leaf; a leaf's ball has the sample's mean as
   centre and the distance of its farthest vector as radius.  Leaves beyond
   ``shard_rows`` vectors, such as those of a very common vector, are split by
   hash into shards of about that size.
2. The ball tree of each shard is built once and kept in files of the shared
   folder.  A node's upper bound for a query is q.centre + |q| * radius, and never
   more than its parent's.
3. Every query orders the leaves of the coarse tree by upper bound and visits
   them in rounds: the best one, then the next 8, 64, ...  After each round the
   kth score it has so far goes with it, and leaves whose bound is below it are
   never sent to; only pairs of query and leaf that may give a better score are.
4. Within a shard a query visits the leaves of the ball tree best bound first and
   ends when the next bound is below its current kth score.

A task holds one shard and one block of queries.  Scores are exact integers:
products are summed as doubles while every partial sum is below 2^53, else with
Python integers.

Defined cases: vectors that are null, empty or hold null or non-finite
components, and null ids, take no part; rows with the same id are rows of their
own, as queries and as candidates, and only the query's own row is left out;
vectors of another length than the query's aren't compared; scores beyond 64 bits
are clamped; ties go to the smaller id; fewer than k candidates give fewer rows;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.llm._files import load, save
from shardloom.llm._spark import discard, remove, ship, staged, workspace

SAMPLE, MAX_LEAVES = 1 << 16, 4096
#: Sampled vectors for each leaf of the coarse tree; queries searched at once.
PER_LEAF, BLOCK = 16, 1024
BROADCAST_SHARDS = 100_000
FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """id and floor(scale * component) of each usable vector, one row for each row."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def _wider(radius: np.ndarray | float) -> np.ndarray | float:
    """A radius that rounding can't make too small."""
    return radius * (1 + 1e-9) + 1e-6


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Largest inner product that each query can have with any point of each ball."""
    reach = queries @ centres.T + np.sqrt((queries**2).sum(1))[:, None] * np.maximum(radii, 0)[None, :]
    return np.where(radii[None, :] >= 0, reach + np.abs(reach) * 1e-9 + 1e-3, -np.inf)


class BallTree:
    """Nodes in order of depth first: ``lo``..``hi`` of the points, the parent, centre and radius."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int) -> None:
        order, self.nodes, self.centres, self.radii = np.arange(len(points)), [], [], []
        whole = points.astype(float)
        waiting = [(0, len(points), -1)]
        while waiting:
            lo, hi, parent = waiting.pop()
            own = whole[order[lo:hi]]
            centre, at = own.mean(0), len(self.nodes)
            self.nodes.append((lo, hi, parent, hi - lo <= leaf))
            self.centres.append(centre)
            self.radii.append(_wider(_distances(own, centre).max()))
            if hi - lo > leaf:
                axis, mid = int(np.argmax(own.max(0) - own.min(0))), (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
                waiting += [(lo + mid, hi, at), (lo, lo + mid, at)]
        self.nodes, self.centres, self.radii = np.array(self.nodes, np.int64), np.array(self.centres), np.array(self.radii)
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.nodes, self.centres, self.radii, self.points, self.ids, self.rows

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, ...]) -> BallTree:
        tree = cls.__new__(cls)
        tree.nodes, tree.centres, tree.radii, tree.points, tree.ids, tree.rows = arrays
        return tree

    def search(self, queries: np.ndarray, own_rows: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, id and score of its k best points here, but for those below the kth score it came with (-inf: none)."""
        asked, n = queries.astype(float), len(queries)
        limits = upper_bounds(asked, self.centres, self.radii)
        for at, parent in enumerate(self.nodes[:, 2].tolist()):
            if parent >= 0:
                np.minimum(limits[:, at], limits[:, parent], out=limits[:, at])
        leaves = np.flatnonzero(self.nodes[:, 3])
        order = np.argsort(-limits[:, leaves], axis=1, kind="stable")
        limits = np.take_along_axis(limits[:, leaves], order, 1)
        points = np.asarray(self.points)
        exact = float(np.abs(asked).max(initial=0)) * float(np.abs(points).max(initial=0)) * asked.shape[1] < _EXACT
        reals = points.astype(float)
        best = np.full((n, k), np.iinfo(np.int64).min)
        found = np.full((n, k), -1, np.int64)
        bound = kth.copy()
        live = np.arange(n)
        for turn in range(len(leaves)):
            live = live[limits[live, turn] >= bound[live]]
            if not len(live):
                break
            goes = order[live, turn]
            by_leaf = np.argsort(goes, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(goes[by_leaf]) > 0]))
            for a, b in zip(cuts, [*cuts[1:], len(live)], strict=True):
                rows = live[by_leaf[a:b]]
                lo, hi = self.nodes[leaves[goes[by_leaf[a]]], :2]
                scores = (asked[rows] @ reals[lo:hi].T).astype(np.int64) if exact else _clamped(queries[rows], points[lo:hi])
                taking_part = own_rows[rows][:, None] != self.rows[lo:hi][None, :]
                better = ((scores >= bound[rows][:, None]) & taking_part).any(1)
                if not better.any():
                    continue
                rows, scores, taking_part = rows[better], scores[better], taking_part[better]
                scores[~taking_part] = np.iinfo(np.int64).min
                at = np.where(taking_part, np.arange(lo, hi)[None, :], -1)
                merged, places = np.concatenate([best[rows], scores], 1), np.concatenate([found[rows], at], 1)
                top = np.argpartition(merged, -k, axis=1)[:, -k:]
                least = np.take_along_axis(merged, top, 1).min(1)
                # where more than k reach the kth score, ids decide
                tied = np.flatnonzero((merged >= least[:, None]).sum(1) > k)
                if len(tied):
                    ids = np.where(places[tied] >= 0, self.ids[places[tied]], np.iinfo(np.int64).max)
                    top[tied] = np.lexsort((ids, ~merged[tied], places[tied] < 0), axis=1)[:, :k]
                best[rows], found[rows] = np.take_along_axis(merged, top, 1), np.take_along_axis(places, top, 1)
                full = rows[(found[rows] >= 0).all(1)]
                bound[full] = np.maximum(bound[full], best[full].min(1).astype(float))
        query, nth = np.nonzero(found >= 0)
        score = best[query, nth]
        keep = score.astype(float) >= kth[query]
        return query[keep], self.ids[found[query, nth][keep]], score[keep]


def _clamped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products by Python integers, within 64 bits."""
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


@dataclass(frozen=True)
class Coarse:
    """The coarse tree of one vector length: splits (axis, value, left, right; a leaf's number as -1 - number) and leaf centres."""

    splits: list[tuple[int, float, int, int]]
    centres: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int) -> Coarse:
        splits: list[tuple[int, float, int, int]] = []
        centres: list[np.ndarray] = []

        def build(own: np.ndarray, wanted: int) -> int:
            axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            value = float(np.median(own[:, axis])) if len(own) else 0.0
            left = own[:, axis] <= value
            if wanted > 1 and left.all():  # more than half of the sample has the largest value
                left = own[:, axis] < value
                value = float(own[left, axis].max()) if left.any() else value
            if wanted < 2 or not left.any() or left.all():
                centres.append(own.mean(0) if len(own) else np.zeros(sample.shape[1]))
                return -len(centres)
            at = len(splits)
            splits.append((axis, value, 0, 0))
            splits[at] = (axis, value, build(own[left], -(-wanted // 2)), build(own[~left], wanted // 2))
            return at

        build(sample, leaves)
        return cls(splits, np.array(centres))

    def assign(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))] if self.splits else []
        while waiting:
            at, rows = waiting.pop()
            axis, value, left, right = self.splits[at]
            low = points[rows, axis] <= value
            for child, own in ((left, rows[low]), (right, rows[~low])):
                if child < 0:
                    out[own] = -1 - child
                else:
                    waiting.append((child, own))
        return out


def _vectors(batch: pa.RecordBatch | pa.Table, dim: int, rows: np.ndarray) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v")).take(pa.array(rows))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim)


def _kth(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("kth")).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _assign(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows with their leaf and distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            leaf, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dim, rows in _by_dim(batch):
                points = _vectors(batch, dim, rows).astype(float)
                leaf[rows] = trees[dim].assign(points)
                far[rows] = _distances(points, trees[dim].centres[leaf[rows]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(far)], [*batch.schema.names, "leaf", "far"])

    return run


def _plan(balls, first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with the leaves they visit in this round: those of rank first..last by bound, if the bound reaches the kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                kth = _kth(batch)
                for dim, rows in _by_dim(batch):
                    limits = upper_bounds(_vectors(batch, dim, rows).astype(float), *balls.value[dim])
                    order = np.argsort(-limits, axis=1, kind="stable")[:, first:last]
                    limits = np.take_along_axis(limits, order, 1)
                    goes = (limits >= kth[rows][:, None]) & (limits > -np.inf)
                    query, nth = np.nonzero(goes)
                    taken = batch.take(pa.array(rows[query]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(order[query, nth])], [*batch.schema.names, "leaf"])

    return run


def _build(folder: str, leaf: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        points = _vectors(group, dim, np.arange(group.num_rows))
        order = np.argsort(group["row"].to_numpy())
        tree = BallTree(points[order], group["id"].to_numpy()[order], group["row"].to_numpy()[order], leaf)
        return pa.table({"dim": pa.array([dim], pa.int32()), "leaf": pa.array([group["leaf"][0].as_py()], pa.int64()), "name": [save(folder, *tree.arrays())]})

    return run


def _search(folder: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best points of each query in the shard it visits; rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree = None, None
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("name"))
            code = names.dictionary_encode()
            at = code.indices.to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True) if len(at) else ():
                if names[a].as_py() != name:
                    name = names[a].as_py()
                    tree = BallTree.of(tuple(load(folder, name, i) for i in range(6)))
                for c in range(a, b, BLOCK):
                    part = batch.slice(c, min(BLOCK, b - c))
                    row, ids = (part.column(part.schema.get_field_index(x)).to_numpy() for x in ("row", "id"))
                    asked = _vectors(part, tree.points.shape[1], np.arange(part.num_rows))
                    query, near, score = tree.search(asked, row, _kth(part), k)
                    yield pa.RecordBatch.from_arrays([pa.array(row[query]), pa.array(ids[query]), pa.array(near), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    return run


def exact_top_k(points: DataFrame, asks: Column, k: int = 20, shard_rows: int = 16384, leaf: int = 512, visits: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other points (columns id, v) of each point for which ``asks`` holds.

    ``visits``: a list that gets, for each round, the number of (query, shard) pairs searched.
    """
    spark = points.sparkSession
    ship(spark)
    folder = workspace(spark, "ball-trees")
    base = staged(points.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim"), F.coalesce(asks, F.lit(False)).alias("asks")), "ball-points")
    trees = {}
    for dim, rows in base.groupBy("dim").agg(F.count("*")).collect():  # one row for each vector length
        leaves = min(MAX_LEAVES, -(-rows // shard_rows))
        if leaves > 1:
            some = base.where(F.col("dim") == dim).orderBy(F.xxhash64("row"), "row").limit(min(SAMPLE, PER_LEAF * leaves)).select("v").toArrow()
            trees[dim] = Coarse.fit(_vectors(some, dim, np.arange(some.num_rows)).astype(float), leaves)
        else:
            trees[dim] = Coarse([], np.zeros((1, dim)))
    # at most MAX_LEAVES splits and centres for each vector length
    assigned = staged(base.mapInArrow(_assign(spark.sparkContext.broadcast(trees)), "row bigint, id bigint, v array<bigint>, dim int, asks boolean, leaf bigint, far double"), "ball-leaves")
    discard(spark, base)
    sizes = assigned.groupBy("dim", "leaf").agg(F.count("*").alias("rows"), F.max("far").alias("far")).collect()
    radii = {dim: np.full(len(tree.centres), -np.inf) for dim, tree in trees.items()}
    for r in sizes:
        radii[r["dim"]][r["leaf"]] = _wider(r["far"])
    # a leaf that got no vector has no ball: it bounds nothing
    balls = spark.sparkContext.broadcast({dim: (tree.centres, radii[dim]) for dim, tree in trees.items()})
    shards = F.broadcast(spark.createDataFrame([(r["dim"], r["leaf"], -(-r["rows"] // shard_rows)) for r in sizes], "dim int, leaf bigint, shards bigint"))
    dealt = assigned.join(shards, ["dim", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    manifest = staged(dealt.select("dim", "leaf", "shard", "row", "id", "v").groupBy("dim", "leaf", "shard").applyInArrow(_build(folder, leaf), "dim int, leaf bigint, name string"), "ball-shards")
    named = F.broadcast(manifest) if manifest.count() <= BROADCAST_SHARDS else manifest
    queries = staged(assigned.where("asks").select("dim", "row", "id", "v"), "ball-queries")
    discard(spark, assigned)
    best = staged(spark.createDataFrame([], FOUND), "ball-best")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first, step, most = 0, 1, max((len(t.centres) for t in trees.values()), default=0)
    while first < most:
        reached = best.groupBy(F.col("query").alias("_query")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        asking = queries.join(reached, F.col("row") == F.col("_query"), "left").select("dim", "row", "id", "v", "kth")
        planned = asking.mapInArrow(_plan(balls, first, first + step), "dim int, row bigint, id bigint, v array<bigint>, kth bigint, leaf bigint")
        counts = planned.groupBy("dim", "leaf").agg(F.count("*").alias("n")).collect()
        if visits is not None:
            visits.append(sum(r["n"] * next(-(-s["rows"] // shard_rows) for s in sizes if (s["dim"], s["leaf"]) == (r["dim"], r["leaf"])) for r in counts))
        if counts:
            blocks = F.broadcast(spark.createDataFrame([(r["dim"], r["leaf"], -(-r["n"] // (2 * BLOCK))) for r in counts], "dim int, leaf bigint, blocks bigint"))
            goes = planned.join(blocks, ["dim", "leaf"]).join(named, ["dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
            found = goes.select("name", "block", "row", "id", "v", "kth").repartition("name", "block").sortWithinPartitions("name", "row").mapInArrow(_search(folder, k), FOUND)
            after = staged(best.unionByName(found).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"), "ball-best")
            discard(spark, best)
            best = after
        first, step = first + step, step * 8
    discard(spark, queries, manifest)
    remove(spark, folder)
    return best.withColumn("rank", F.row_number().over(ranked)).select("query_id", "rank", "vec_id", "score")
