"""Counts, topology and the graph of subgraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.ids import number_within
from shardloom.functions.shipping import ship
from shardloom.operators.fixpoint import components, cut, drop
from shardloom.plans.model import PropertyGraph

#: Searches that bound others before the nodes that are left are searched from, and bytes of what these hold.
SEARCHES, SEARCH_BYTES = 256, 32 << 20


def vertex_count(g: PropertyGraph) -> DataFrame:
    return g.nodes.agg(F.count("*").alias("vertices"))


def edge_count(g: PropertyGraph) -> DataFrame:
    return g.arcs.agg(F.count("*").alias("edges"))


def edge_list(g: PropertyGraph) -> DataFrame:
    return g.arcs.select("src", "dst")


def dump(g: PropertyGraph) -> DataFrame:
    """Every vertex, arc and remote vertex as one row: kind, sgid, a, b."""
    return (
        g.vertices.select(F.lit("vertex").alias("kind"), "sgid", F.col("vid").alias("a"), F.lit(None).cast("long").alias("b"))
        .unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("src_sgid").alias("sgid"), F.col("src").alias("a"), F.col("dst").alias("b")))
        .unionByName(g.remote_vertices.select(F.lit("remote").alias("kind"), "sgid", F.col("vid").alias("a"), F.col("owner_sgid").alias("b")))
    )


def degrees(g: PropertyGraph) -> DataFrame:
    """vid, out_degree, in_degree of every vertex."""
    ends = g.arcs.select(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(g.arcs.select(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    every = ends.unionByName(g.nodes.select("vid", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return every.groupBy("vid").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def boundary_vertices(g: PropertyGraph) -> DataFrame:
    """Vertices with an arc to another subgraph."""
    return g.remote_edges.select(F.col("src").alias("vid"), F.col("src_sgid").alias("sgid")).distinct()


def subgraph_topology(g: PropertyGraph) -> DataFrame:
    """One row per subgraph: sizes, remote parts, boundary and largest out-degree."""
    by_vertex = g.edges.groupBy(F.col("src").alias("vid"), F.col("src_sgid").alias("sgid")).agg(F.count("*").alias("n"), F.count_if("is_remote").alias("r"))
    by_piece = by_vertex.groupBy("sgid").agg(F.sum("n").alias("n"), F.sum("r").alias("n_remote_edges"), F.count_if(F.col("r") > 0).alias("n_boundary"), F.max("n").alias("max_degree"))
    local = g.vertices.groupBy("sgid", "pid").agg(F.count("*").alias("n_local"))
    remote = g.remote_vertices.groupBy("sgid").agg(F.count("*").alias("n_remote"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return local.join(by_piece, "sgid", "left").join(remote, "sgid", "left").select("sgid", "pid", "n_local", zero("n_remote").alias("n_remote"), (zero("n") - zero("n_remote_edges")).alias("n_local_edges"), zero("n_remote_edges").alias("n_remote_edges"), zero("n_boundary").alias("n_boundary"), zero("max_degree").alias("max_degree"))


def meta_graph(g: PropertyGraph, multiset: bool = False) -> DataFrame:
    """Pairs of subgraphs joined by arcs; with ``multiset`` once for each remote vertex."""
    if multiset:
        return g.remote_vertices.select(F.col("sgid").alias("src_sgid"), F.col("owner_sgid").alias("dst_sgid"))
    return g.meta_edges


def meta_neighbours(g: PropertyGraph) -> DataFrame:
    """sgid, n_local and its neighbours with the number of arcs to each."""
    local = g.vertices.groupBy("sgid").agg(F.count("*").alias("n_local"))
    near = g.meta_edges.groupBy(F.col("src_sgid").alias("sgid")).agg(F.sort_array(F.collect_list(F.struct("dst_sgid", "n_edges"))).alias("neighbours"))
    return local.join(near, "sgid", "left")


def _search(root: int, starts: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hops from a node to every node, -1 where there is no path; node i's arcs lead to at[starts[i]:starts[i + 1]]."""
    dist = np.full(n, -1, np.int64)
    dist[root], front, hops = 0, np.array([root]), 0
    while len(front):
        hops += 1
        size = starts[front + 1] - starts[front]
        ends = size.cumsum()
        near = at[np.arange(ends[-1]) + np.repeat(starts[front] - ends + size, size)]
        front = np.unique(near[dist[near] < 0])
        dist[front] = hops
    return dist


def _searches(roots: np.ndarray, via: np.ndarray, at: np.ndarray, n: int) -> int:
    """The largest number of hops from any of the roots to a node it reaches: 64 roots to a word, in bounded memory; arcs sorted by ``at``."""
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sinks, words, most = at[begins], max(1, SEARCH_BYTES // (8 * max(n, len(at)))), 0
    for first in range(0, len(roots), 64 * words):
        some = roots[first : first + 64 * words]
        front = np.zeros((n, -(-len(some) // 64)), np.uint64)
        place = np.arange(len(some))
        front[some, place // 64] = np.uint64(1) << (place % 64).astype(np.uint64)
        seen, hops = front.copy(), 0
        while True:
            got = np.bitwise_or.reduceat(front[via], begins, axis=0) & ~seen[sinks]
            if not got.any():
                break
            hops += 1
            seen[sinks] |= got
            front[:] = 0
            front[sinks] = got
        most = max(most, hops)
    return most


def diameter(via: np.ndarray, at: np.ndarray) -> int:
    """The largest finite distance between nodes of the arcs of one component, exactly.

    If every arc has its opposite, each search bounds the distances from all other nodes
    (Takes and Kosters), so that few are needed; all nodes that the bounds leave, and
    all of other arcs, are searched from.
    """
    nodes, both = np.unique(np.concatenate([via, at]), return_inverse=True)
    n = len(nodes)
    arcs = np.unique(both[: len(via)] * n + both[len(via) :])
    via, at = arcs // n, arcs % n
    back = np.sort(at * n + via)
    left, most = np.arange(n), 0
    if np.array_equal(arcs, back):
        starts = np.searchsorted(via, np.arange(n + 1))
        low, high = np.zeros(n, np.int64), np.full(n, n, np.int64)
        for turn in range(SEARCHES):
            if not len(left):
                return most
            root = int(left[high[left].argmax()] if turn % 2 else left[low[left].argmin()]) if turn else int(np.diff(starts).argmax())
            dist = _search(root, starts, at, n)
            far = int(dist.max())
            most = max(most, far)
            low = np.maximum(low, np.maximum(dist, far - dist))
            high = np.minimum(high, far + dist)
            high[root] = far
            left = left[high[left] > most]
    return max(most, _searches(left, back % n, back // n, n)) if len(left) else most


def _diameters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest diameter of a task's components; rows come sorted by component."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last, most = None, 0
    for batch in batches:
        key, via, at = (x.to_numpy() for x in batch.columns)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=False):
            if held and key[x] != last:
                most = max(most, diameter(*(np.concatenate(c) for c in zip(*held, strict=True))))
                held = []
            last = key[x]
            held.append((via[x:y], at[x:y]))
    if held:
        most = max(most, diameter(*(np.concatenate(c) for c in zip(*held, strict=True))))
    yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], ["hops"])


def meta_diameter(g: PropertyGraph, roots: int = 4096, arcs_per_task: int = 1 << 20) -> DataFrame:
    """hops (largest finite distance between subgraphs) and reference_diameter (hops + 1).

    A component of the graph of subgraphs with up to ``arcs_per_task`` arcs is searched by
    one task.  In larger ones all pairs are searched by joins, from ``roots`` subgraphs
    at a time, by ranges of their ids, so what is held at once is ``roots`` times the
    subgraphs, whatever their number.
    """
    spark = g.vertices.sparkSession
    ship(spark)
    arcs = cut(g.meta_edges.select(F.col("src_sgid").alias("via"), F.col("dst_sgid").alias("at")), "meta")
    label = components(arcs.select(F.col("via").alias("src"), F.col("at").alias("dst"))).select(F.col("node").alias("via"), "component")
    arcs = cut(arcs.join(label, "via").select("component", "via", "at"), "meta")
    sizes = arcs.groupBy("component").agg(F.count("*").alias("arcs"))
    large = cut(sizes.where(F.col("arcs") > arcs_per_task).select("component"), "meta", {"n": F.count(F.lit(1))})
    small = arcs.join(large, "component", "left_anti") if large._watched["n"] else arcs
    most = small.repartition("component").sortWithinPartitions("component").mapInArrow(_diameters, "hops bigint").agg(F.max("hops")).first()[0] or 0
    if large._watched["n"]:
        most = max(most, _joined_diameter(arcs.join(large, "component", "left_semi").select("via", "at"), roots))
    return spark.createDataFrame([(most, most + 1)], "hops int, reference_diameter int")


def _joined_diameter(arcs: DataFrame, roots: int) -> int:
    """The largest finite distance, from ``roots`` nodes at a time."""
    arcs = cut(arcs, "meta")
    numbered = cut(number_within(arcs.select(F.col("via").alias("sgid")).distinct(), None, ["sgid"], "n", lambda df: cut(df, "meta")), "meta", {"n": F.count(F.lit(1))})
    most = 0
    for first in range(0, numbered._watched["n"] or 0, roots):
        own = numbered.where((F.col("n") >= first) & (F.col("n") < first + roots))
        seen = cut(own.select(F.col("sgid").alias("root"), F.col("sgid").alias("at"), F.lit(0).alias("dist")), "meta")
        hops = 0
        while True:
            reached = seen.where(F.col("dist") == hops).select("root", F.col("at").alias("via")).join(arcs, "via").select("root", "at").distinct()
            new = reached.join(seen, ["root", "at"], "left_anti").withColumn("dist", F.lit(hops + 1))
            after = cut(seen.unionByName(new), "meta", {"more": F.count_if(F.col("dist") == hops + 1)})
            drop(seen)
            seen = after
            if not after._watched["more"]:
                break
            hops += 1
        drop(seen)
        most = max(most, hops)
    return most


def graph_stats(g: PropertyGraph) -> DataFrame:
    """One row: vertices, edges, subgraphs, remote edges, boundary vertices, largest out-degree."""
    t = subgraph_topology(g)
    total = lambda c: F.sum(c).cast("long")
    return t.agg(total("n_local").alias("vertices"), total(F.col("n_local_edges") + F.col("n_remote_edges")).alias("edges"), F.count("*").alias("subgraphs"), total("n_remote_edges").alias("remote_edges"), total("n_boundary").alias("boundary_vertices"), F.max("max_degree").alias("max_degree"))


def connected_components(g: PropertyGraph) -> DataFrame:
    """vid, component: the smallest vid reachable when arcs count both ways."""
    label = components(g.arcs.select("src", "dst")).select(F.col("node").alias("vid"), "component")
    return g.nodes.select("vid").join(label, "vid", "left").select("vid", F.coalesce("component", "vid").alias("component"))


def subgraph_components(g: PropertyGraph) -> DataFrame:
    """sgid, component: the smallest sgid reachable over arcs between subgraphs."""
    label = components(g.meta_edges.select(F.col("src_sgid").alias("src"), F.col("dst_sgid").alias("dst"))).select(F.col("node").alias("sgid"), "component")
    return g.vertices.select("sgid").distinct().join(label, "sgid", "left").select("sgid", F.coalesce("component", "sgid").alias("component"))


def component_sizes(g: PropertyGraph) -> DataFrame:
    return connected_components(g).groupBy("component").agg(F.count("*").alias("vertices"))
