"""Searches along arcs: shortest paths, spanning forest, graph k-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators.fixpoint import BROADCAST_ROWS, cut, fixpoint
from shardloom.operators.prepare import symmetrize
from shardloom.operators.stats import connected_components
from shardloom.plans.model import PropertyGraph


def spread(start: DataFrame, arcs: DataFrame, move: Column, max_rounds: int | None = None) -> DataFrame:
    """vid, label: the smallest label that reaches each vertex.

    ``start``: vid, label; ``arcs``: src, dst and what ``move`` needs;
    ``move``: the label after an arc, an expression of ``label`` and the arc.
    Only vertices whose label fell in the last round send it on, and a round
    costs one shuffle of those and the labels so far.
    """
    first = start.groupBy("vid").agg(F.min("label").alias("label")).withColumn("fresh", F.lit(True))

    def step(state: DataFrame, _: int) -> DataFrame:
        fresh = state.where("fresh").select(F.col("vid").alias("src"), "label")
        fresh = F.broadcast(fresh) if state._watched["fresh"] <= BROADCAST_ROWS else fresh
        sent = arcs.join(fresh, "src").select(F.col("dst").alias("vid"), move.alias("label"), F.lit(None).cast(state.schema["label"].dataType).alias("old"))
        both = state.select("vid", "label", F.col("label").alias("old")).unionByName(sent).groupBy("vid").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        return both.select("vid", "label", (F.col("old").isNull() | (F.col("label") < F.col("old"))).alias("fresh"))

    state, _ = fixpoint(first, step, lambda now, _: not now["fresh"], max_rounds, {"fresh": F.count_if("fresh")})
    return state.select("vid", "label")


def sssp(g: PropertyGraph, source: int, weighted: bool = False, parents: bool = True) -> DataFrame:
    """vid, dist and, unless ``parents`` is false, parent of every vertex reachable from the source.

    Weights are the arcs' values, which must not be negative; an arc without
    one weighs 1.  The parent is the smallest predecessor on a shortest path;
    the source's is null.
    """
    weight = F.coalesce("value", F.lit(1.0)) if weighted else F.lit(1)
    arcs = g.arcs.select("src", "dst", weight.alias("w"))
    start = g.nodes.where(F.col("vid") == source).select("vid", (F.lit(0.0) if weighted else F.lit(0)).alias("label"))
    dist = spread(start, arcs, F.col("label") + F.col("w"))
    if not parents:
        return dist.select("vid", F.col("label").alias("dist"))
    before = dist.select(F.col("vid").alias("src"), F.col("label").alias("d")).join(arcs, "src").select(F.col("dst").alias("vid"), (F.col("d") + F.col("w")).alias("label"), "src")
    parent = before.join(dist, ["vid", "label"]).where(F.col("vid") != source).groupBy("vid").agg(F.min("src").alias("parent"))
    return dist.join(parent, "vid", "left").select("vid", F.col("label").alias("dist"), "parent")


def spanning_forest(g: PropertyGraph) -> DataFrame:
    """vid, parent, root, level of every vertex: breadth first from the smallest vertex of each component; a root's parent is null."""
    arcs = cut(symmetrize(g.arcs.select("src", "dst")), "forest")
    roots = cut(connected_components(g), "forest")
    start = roots.where("vid = component").select("vid", F.lit(0).alias("label"))
    level = spread(start, arcs, F.col("label") + 1)
    before = level.select(F.col("vid").alias("src"), (F.col("label") + 1).alias("label")).join(arcs, "src").select(F.col("dst").alias("vid"), "label", "src")
    parent = before.join(level, ["vid", "label"]).groupBy("vid").agg(F.min("src").alias("parent"))
    return level.join(parent, "vid", "left").join(roots, "vid").select("vid", "parent", F.col("component").alias("root"), F.col("label").alias("level"))


def assign_clusters(g: PropertyGraph, centres: DataFrame) -> DataFrame:
    """vid, cluster, dist: the nearest centre by hops, of several the one with the smaller cluster number; -1 where none reaches."""
    start = centres.select("vid", F.struct(F.lit(0).alias("dist"), F.col("cluster").cast("int").alias("cluster")).alias("label"))
    label = spread(start, g.arcs.select("src", "dst"), F.struct((F.col("label.dist") + 1).alias("dist"), F.col("label.cluster").alias("cluster")))
    return g.nodes.select("vid").join(label, "vid", "left").select("vid", F.coalesce("label.cluster", F.lit(-1)).alias("cluster"), F.col("label.dist").alias("dist"))


def edge_cut(g: PropertyGraph, clusters: DataFrame) -> DataFrame:
    """Number of arcs whose ends are in different clusters."""
    a, b = (clusters.select(F.col("vid").alias(c), F.col("cluster").alias(f"c_{c}")) for c in ("src", "dst"))
    # cut, or the joins send the clusters of all vertices, if Spark takes them for small
    return cut(g.arcs.select("src", "dst").join(a, "src").join(b, "dst").agg(F.count_if(F.col("c_src") != F.col("c_dst")).alias("edge_cut")), "edge-cut")


def pick_centres(g: PropertyGraph, k: int, seed: int, attempt: int) -> DataFrame:
    """k vertices by MD5 of seed, attempt and vid, numbered from 0 in order of vid."""
    name = F.concat_ws(":", F.lit(str(seed)), F.lit(str(attempt)), F.col("vid").cast("string"))
    chosen = g.nodes.select("vid").withColumn("key", F.md5(name.cast("binary"))).orderBy("key", "vid").limit(k)
    rows = sorted(r["vid"] for r in chosen.collect())  # k rows
    return g.nodes.sparkSession.createDataFrame(list(enumerate(rows)), "cluster int, vid long")


def graph_kmeans(g: PropertyGraph, k: int, max_cut: int, max_iter: int, seed: int = 1) -> tuple[DataFrame, int, int]:
    """Clusters (vid, cluster, dist), their edge cut and the attempts made, until the cut is at most ``max_cut``."""
    attempt = 0
    while True:
        clusters = cut(assign_clusters(g, pick_centres(g, k, seed, attempt)), "clusters")
        size = edge_cut(g, clusters).first()["edge_cut"]
        attempt += 1
        if size <= max_cut or attempt >= max_iter:
            return clusters, size, attempt
