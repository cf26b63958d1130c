"""PageRank and its subgraph-seeded form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.fixpoint import cut, fixpoint
from shardloom.plans.model import PropertyGraph


def _with_degree(edges: DataFrame) -> DataFrame:
    """Arcs with the out-degree of their source, parallel arcs kept; cut once for all rounds."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    return cut(edges.select("src", "dst").join(degree, "src"), "rank-arcs")


def _iterate(g: PropertyGraph, start: DataFrame, n: int, alpha: float, teleport: float, tol: float | None, max_iter: int | None) -> DataFrame:
    arcs = _with_degree(g.arcs)

    def step(state: DataFrame, _: int) -> DataFrame:
        got = arcs.join(state.select(F.col("vid").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("vid")).agg(F.sum(F.col("rank") / F.col("degree")).alias("sum"))
        new = F.lit(alpha) * F.coalesce("sum", F.lit(0.0)) + F.lit(teleport)
        return state.join(got, "vid", "left").select("vid", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))

    def done(now: dict, rounds: int) -> bool:
        return tol is not None and rounds > 0 and (now["change"] or 0.0) <= tol

    state, _ = fixpoint(start.select("vid", "rank", F.lit(None).cast("double").alias("change")), step, done, max_iter, {"change": F.max("change")})
    return state.select("vid", "rank")


def pagerank(g: PropertyGraph, alpha: float = 0.85, tol: float | None = 1e-3, max_iter: int | None = None) -> DataFrame:
    """vid, rank.  Stops when no rank moved by more than ``tol``, or after ``max_iter`` rounds; weight at vertices without out-arcs is lost."""
    n = g.nodes.count()
    if not n:
        return g.nodes.select("vid", F.lit(0.0).alias("rank"))
    return _iterate(g, g.nodes.select("vid", F.lit(1.0 / n).alias("rank")), n, alpha, (1 - alpha) / n, tol, max_iter)


def subgraph_rank(g: PropertyGraph, alpha: float = 0.85, tol: float | None = 1e-3, max_iter: int | None = None, inner_tol: float | None = 0.05, inner_iter: int | None = None, compat: bool = False) -> DataFrame:
    """vid, rank: ranks within each subgraph first, weighted by its size, then rounds over the whole graph.

    A subgraph that has settled keeps its ranks while others go on.  With
    ``compat`` the second phase has no teleport.
    """
    n = g.vertices.count()
    if not n:
        return g.vertices.select("vid", F.lit(0.0).alias("rank"))
    sizes = g.vertices.groupBy("sgid").agg(F.count("*").alias("n_sg"))
    inner = _with_degree(g.local_edges)
    start = g.vertices.join(sizes, "sgid").select("vid", "sgid", "n_sg", (F.lit(1.0) / F.col("n_sg")).alias("rank"), F.lit(True).alias("active"))

    def step(state: DataFrame, _: int) -> DataFrame:
        live = state.where("active").select(F.col("vid").alias("src"), "rank")
        got = inner.join(live, "src").groupBy(F.col("dst").alias("vid")).agg(F.sum(F.col("rank") / F.col("degree")).alias("sum"))
        new = F.when(F.col("active"), F.lit(alpha) * F.coalesce("sum", F.lit(0.0)) + F.lit(1 - alpha) / F.col("n_sg")).otherwise(F.col("rank"))
        after = state.join(got, "vid", "left").select("vid", "sgid", "n_sg", new.alias("new"), F.abs(new - F.col("rank")).alias("change"), "active")
        if inner_tol is None:
            return after.select("vid", "sgid", "n_sg", F.col("new").alias("rank"), "active")
        moving = after.groupBy("sgid").agg((F.max("change") > inner_tol).alias("moving"))
        return after.join(moving, "sgid").select("vid", "sgid", "n_sg", F.col("new").alias("rank"), (F.col("active") & F.col("moving")).alias("active"))

    seeded, _ = fixpoint(start, step, lambda now, _: not now["active"], inner_iter, {"active": F.count_if("active")})
    seed = seeded.select("vid", (F.col("rank") * F.col("n_sg") / n).alias("rank"))
    return _iterate(g, seed, n, alpha, 0.0 if compat else (1 - alpha) / n, tol, max_iter)
