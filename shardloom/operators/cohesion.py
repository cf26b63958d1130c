"""Triangles and k-cores; arcs count both ways and once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.functions.shipping import ship
from shardloom.operators.fixpoint import BROADCAST_ROWS, TASK_EDGES, components, cut, fixpoint, whole
from shardloom.operators.prepare import drop_self_loops, symmetrize
from shardloom.plans.model import PropertyGraph


def triangle_list(g: PropertyGraph) -> DataFrame:
    """a < b < c for each triangle.

    Arcs point from the end of smaller (degree, id) to the larger, so no
    vertex starts more than about sqrt(2 E) of them and wedges stay few.
    """
    both = drop_self_loops(symmetrize(g.arcs.select("src", "dst")))
    degree = both.groupBy("src").agg(F.count("*").alias("k"))
    ranked = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("k").alias("k_dst")), "dst")
    up = cut(ranked.where(F.struct("k", "src") < F.struct(F.col("k_dst").alias("k"), F.col("dst").alias("src"))).select("src", "dst"), "oriented")
    wedge = up.alias("x").join(up.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(F.col("x.src").alias("u"), F.col("x.dst").alias("v"), F.col("y.dst").alias("w"))
    closing = up.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("w"))
    three = F.sort_array(F.array("u", "v", "w"))
    return wedge.join(closing, ["v", "w"]).select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def triangle_count(g: PropertyGraph) -> DataFrame:
    return triangle_list(g).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(g: PropertyGraph) -> DataFrame:
    """vid, triangles of the vertices in any."""
    return triangle_list(g).select(F.explode(F.array("a", "b", "c")).alias("vid")).groupBy("vid").agg(F.count("*").alias("triangles"))


def triangles_per_subgraph(g: PropertyGraph) -> DataFrame:
    """sgid, triangles: those with two or three corners in a subgraph belong to it, others to that of the largest vertex."""
    out = triangle_list(g)
    for c in ("a", "b", "c"):
        out = out.join(g.vertices.select(F.col("vid").alias(c), F.col("sgid").alias(f"s_{c}")), c)
    owner = F.when(F.col("s_a") == F.col("s_b"), F.col("s_a")).otherwise(F.col("s_c"))
    owner = F.when(F.col("s_a") == F.col("s_c"), F.col("s_a")).otherwise(owner)
    return out.groupBy(owner.alias("sgid")).agg(F.count("*").alias("triangles"))


def peel(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and their core numbers; an edge counts both ways and once."""
    names, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = len(names)
    a, b = both[: len(src)], both[len(src) :]
    arcs = np.unique(np.concatenate([a * n + b, b * n + a]))
    via, at = arcs // n, arcs % n
    starts = np.searchsorted(via, np.arange(n + 1))
    degree, core = np.diff(starts), np.full(n, -1, np.int32)
    left, k = np.arange(n), 0
    while len(left):
        k = max(k, int(degree[left].min()))
        front = left[degree[left] <= k]
        while len(front):
            core[front] = k
            size = starts[front + 1] - starts[front]
            ends = size.cumsum()
            near = at[np.arange(ends[-1]) + np.repeat(starts[front] - ends + size, size)]
            near, lost = np.unique(near[core[near] < 0], return_counts=True)
            degree[near] -= lost
            front = near[degree[near] <= k]
        left = left[core[left] < 0]
    return names, core


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Core numbers of a task's components, many at a time: those of one don't depend on others."""
    for _, src, dst in whole(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in peel(src, dst)], ["vid", "core"])


def kcore(g: PropertyGraph, arcs_per_task: int = TASK_EDGES) -> DataFrame:
    """vid, core: the largest k for which the vertex is in a part where all have k neighbours.

    Components of up to ``arcs_per_task`` arcs are peeled in tasks, without rounds;
    in larger ones estimates fall (``_falling``).
    """
    ship(g.arcs.sparkSession)
    kind = g.arcs.schema["src"].dataType
    arcs = drop_self_loops(g.arcs).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    label = components(arcs).select(F.col("node").alias("src"), "component")
    arcs = cut(arcs.join(label, "src").select("component", "src", "dst"), "core-arcs", {"n": F.count(F.lit(1))})
    small, large = arcs, None
    if arcs._watched["n"] > arcs_per_task:
        sizes = arcs.groupBy("component").agg(F.count("*").alias("arcs"))
        big = cut(sizes.where(F.col("arcs") > arcs_per_task).select("component"), "core", {"n": F.count(F.lit(1))})
        if big._watched["n"]:
            small, large = arcs.join(big, "component", "left_anti"), arcs.join(big, "component", "left_semi")
    core = cut(small.repartition("component").sortWithinPartitions("component").mapInArrow(_peeled, "vid bigint, core int"), "core")
    if large is not None:
        core = core.unionByName(_falling(large.select("src", "dst")))
    core = core.select(F.col("vid").cast(kind).alias("vid"), "core")
    # cut, or the join sends what Spark's estimate allows outside of loops
    return cut(g.nodes.select("vid").join(core, "vid", "left").select("vid", F.coalesce("core", F.lit(0)).alias("core")), "core")


def _falling(arcs: DataFrame) -> DataFrame:
    """vid, core of the ends of arcs.

    Estimates start at the degree and fall to the h-index of the neighbours'
    estimates until nothing changes.  Neighbours are counted by estimate, so a
    hub costs as many rows as it has different estimates around it.
    """
    arcs = cut(symmetrize(arcs), "core-arcs")
    start = arcs.groupBy(F.col("src").alias("vid")).agg(F.count("*").cast("int").alias("core")).withColumn("fresh", F.lit(True))
    above = Window.partitionBy("src").orderBy(F.desc("c"))

    def step(state: DataFrame, _: int) -> DataFrame:
        # only neighbours of what fell in the last round can fall
        fell = state.where("fresh").select(F.col("vid").alias("dst"))
        fell = F.broadcast(fell) if state._watched["fresh"] <= BROADCAST_ROWS else fell
        hit = arcs.join(fell, "dst", "left_semi").select("src").distinct()
        seen = arcs.join(hit, "src", "left_semi").join(state.select(F.col("vid").alias("dst"), F.col("core").alias("theirs")), "dst").join(state.select(F.col("vid").alias("src"), F.col("core").alias("mine")), "src")
        counted = seen.groupBy("src", F.least("theirs", "mine").alias("c")).agg(F.count("*").alias("n"))
        best = counted.withColumn("at_least", F.sum("n").over(above)).groupBy(F.col("src").alias("vid")).agg(F.max(F.least("c", "at_least")).cast("int").alias("new"))
        return state.join(best, "vid", "left").select("vid", F.coalesce("new", "core").alias("core"), (F.coalesce("new", "core") < F.col("core")).alias("fresh"))

    state, _ = fixpoint(start, step, lambda now, _: not now["fresh"], watch={"fresh": F.count_if("fresh")})
    return state.select("vid", "core")


def kcore_subgraph(g: PropertyGraph, k: int) -> DataFrame:
    """src, dst of the arcs within the k-core."""
    inside = cut(kcore(g).where(F.col("core") >= k).select("vid"), "core")
    # cut, or the joins send what Spark's estimate allows outside of loops
    return cut(g.arcs.select("src", "dst").join(inside.withColumnRenamed("vid", "src"), "src", "left_semi").join(inside.withColumnRenamed("vid", "dst"), "dst", "left_semi"), "core-arcs")
