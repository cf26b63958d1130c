"""From arcs to a partitioned graph: cleaning, partitioning, subgraph formation, remote resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.ids import hash_partition, modulo_partition, number_within, numbered, range_partition
from shardloom.operators.fixpoint import components, cut, fixpoint
from shardloom.plans.model import BuiltGraph, PropertyGraph


def drop_self_loops(arcs: DataFrame) -> DataFrame:
    return arcs.where("src <> dst")


def dedupe(arcs: DataFrame) -> DataFrame:
    return arcs.dropDuplicates(["src", "dst"])


def symmetrize(arcs: DataFrame) -> DataFrame:
    """Both directions of every arc, once each."""
    other = [c for c in arcs.columns if c not in ("src", "dst")]
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other)
    return dedupe(arcs.select("src", "dst", *other).unionByName(back))


def relabel(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs with ids 1..n in order of the old ids, and the map (new_id, old_id)."""
    nodes = arcs.select(F.col("src").alias("old_id")).unionByName(arcs.select(F.col("dst").alias("old_id"))).distinct()
    table = number_within(nodes, None, ["old_id"], "n", lambda df: cut(df, "relabel")).select((F.col("n") + 1).alias("new_id"), "old_id")
    new = arcs.join(table.select(F.col("old_id").alias("src"), F.col("new_id").alias("_s")), "src").join(table.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_d")), "dst")
    return new.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *[c for c in arcs.columns if c not in ("src", "dst")]), table


def assign_partitions(vertices: DataFrame, parts: int, method: str = "hash", mapping: DataFrame | None = None, arcs: DataFrame | None = None, rounds: int = 3, start: str = "hash") -> DataFrame:
    """vid, pid by "hash", "modulo", "range", "file" (a table vid, pid) or "labels" (label propagation from ``start``, "hash" or "modulo").

    A vertex takes the partition of most of its in-neighbours, of several the smallest; without any it stays.
    """
    if method == "file":
        return vertices.join(mapping.select("vid", F.col("pid").cast("int")), "vid")
    if method == "range":
        low, high = vertices.agg(F.min("vid"), F.max("vid")).first()
        return vertices.select("vid", range_partition(F.col("vid"), low or 0, high or 0, parts).alias("pid"))
    rule = modulo_partition if "modulo" in (method, start if method == "labels" else None) else hash_partition
    first = vertices.select("vid", rule(F.col("vid"), parts).alias("pid"))
    if method != "labels":
        return first

    def step(state: DataFrame, _: int) -> DataFrame:
        votes = arcs.join(state.select(F.col("vid").alias("src"), "pid"), "src").groupBy(F.col("dst").alias("vid"), "pid").agg(F.count("*").alias("n"))
        best = votes.groupBy("vid").agg(F.min_by("pid", F.struct(-F.col("n"), "pid")).alias("new"))
        return state.join(best, "vid", "left").select("vid", F.coalesce("new", "pid").alias("pid"))

    return fixpoint(first, step, lambda _, done: done >= rounds)[0]


def resolve(parts: DataFrame, arcs: DataFrame, on_dangling: str = "add", partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """vertices (vid, pid) and arcs with src_pid and dst_pid.

    A sink without a vertex row is added as a vertex (in the partition of its
    smallest source), dropped with its arcs, or an error.
    """
    if "value" not in arcs.columns:
        arcs = arcs.withColumn("value", F.lit(None).cast("double"))
    owned = parts.select("vid", F.col("pid").cast("int").alias("pid"))
    source = arcs.join(owned.select(F.col("vid").alias("src"), F.col("pid").alias("src_pid")), "src")
    missing = source.join(owned.select(F.col("vid").alias("dst")), "dst", "left_anti")
    if on_dangling == "error" and not missing.isEmpty():
        raise ValueError(f"sinks without a vertex, such as {missing.first()['dst']}")
    if on_dangling == "add":
        owned = owned.unionByName(missing.groupBy(F.col("dst").alias("vid")).agg(F.min_by("src_pid", "src").alias("pid")))
    full = source.join(owned.select(F.col("vid").alias("dst"), F.col("pid").alias("dst_pid")), "dst")
    return owned, full.select("src", "dst", "value", "src_pid", "dst_pid")


def resolve_by_rule(rule: Callable[[Column], Column], arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same where sources are the vertices and their partition follows from the id; other sinks are added.  Both tables are cut.

    Arcs are joined with the sinks that were added, and with nothing if there are none.
    """
    if "value" not in arcs.columns:
        arcs = arcs.withColumn("value", F.lit(None).cast("double"))
    ends = arcs.select(F.col("src").alias("vid"), F.lit(None).cast(arcs.schema["src"].dataType).alias("via")).unionByName(arcs.select(F.col("dst").alias("vid"), F.col("src").alias("via")))
    owned = ends.groupBy("vid").agg(F.max(F.col("via").isNull()).alias("known"), F.min("via").alias("via"))
    owned = cut(owned.select("vid", rule(F.when(F.col("known"), F.col("vid")).otherwise(F.col("via"))).alias("pid"), "known"), "owned", {"added": F.count_if(~F.col("known"))})
    full = arcs.select("src", "dst", "value", rule(F.col("src")).alias("src_pid"))
    if not owned._watched["added"]:
        return owned.select("vid", "pid"), cut(full.withColumn("dst_pid", rule(F.col("dst"))), "resolved")
    added = owned.where("NOT known").select(F.col("vid").alias("dst"), F.col("pid").alias("_pid"))
    full = full.join(added, "dst", "left").select("src", "dst", "value", "src_pid", F.coalesce("_pid", rule(F.col("dst"))).alias("dst_pid"))
    return owned.select("vid", "pid"), cut(full, "resolved")


def subgraph_pieces(vertices: DataFrame, arcs: DataFrame, mode: str = "glue") -> DataFrame:
    """vid, sgid.  "local": connected by arcs within the partition; "glue": also by a shared remote neighbour."""
    inner = arcs.where("src_pid = dst_pid").select("src", "dst")
    if mode == "glue":
        outer = arcs.where("src_pid <> dst_pid")
        hub = outer.groupBy("src_pid", "dst").agg(F.min("src").alias("hub"))
        inner = inner.unionByName(outer.join(hub, ["src_pid", "dst"]).select("src", F.col("hub").alias("dst")))
    elif mode != "local":
        raise ValueError(f"mode is {mode!r}, not glue or local")
    label = components(inner).select(F.col("node").alias("vid"), "component")
    named = cut(vertices.join(label, "vid", "left").withColumn("component", F.coalesce("component", "vid")), "named")
    pieces = number_within(named.select("pid", "component").distinct(), "pid", ["component"], "n", lambda df: cut(df, "pieces"))
    pieces = pieces.select("pid", "component", numbered(F.col("pid"), F.col("n")).alias("sgid"))
    return named.join(pieces, ["pid", "component"]).select("vid", "pid", "sgid")


def build_graph(parts: DataFrame | Callable[[Column], Column], arcs: DataFrame, mode: str = "glue", on_dangling: str = "add") -> PropertyGraph:
    """A graph from a partition map (vid, pid), or a rule for the partition of a source, and arcs (src, dst[, value]); tables are cut, so algorithms start from files.

    Subgraphs are formed when they are first asked for.
    """
    if mode not in ("glue", "local"):
        raise ValueError(f"mode is {mode!r}, not glue or local")
    if isinstance(parts, DataFrame):
        vertices, arcs = resolve(parts, arcs, on_dangling)
        # each is read several times below, and what they come from may be dear
        vertices, arcs = cut(vertices, "owned"), cut(arcs.withColumn("value", F.col("value").cast("double")), "resolved")
    else:
        vertices, arcs = resolve_by_rule(parts, arcs)
    return BuiltGraph(vertices, arcs, lambda nodes, arcs: cut(subgraph_pieces(nodes, arcs, mode), "vertices"), _placed)


def _placed(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """The arcs with the subgraphs of their ends; cut."""
    source, sink = (vertices.select(F.col("vid").alias(c), F.col("sgid").alias(f"{c}_sgid")) for c in ("src", "dst"))
    edges = arcs.join(source, "src").join(sink, "dst").select("src", "dst", F.col("value").cast("double").alias("value"), "src_pid", "dst_pid", "src_sgid", "dst_sgid", (F.col("src_sgid") != F.col("dst_sgid")).alias("is_remote"))
    return cut(edges, "edges")


def prepare(edge_list: DataFrame, parts: int | DataFrame, make_undirected: bool = True, method: str = "hash", mode: str = "local") -> PropertyGraph:
    """The whole preparation: clean, symmetrise, partition (or join a partition map), form subgraphs, resolve remote ends."""
    arcs = symmetrize(edge_list) if make_undirected else dedupe(edge_list)
    if isinstance(parts, DataFrame):
        nodes = parts.select("vid", "pid")
    else:
        vids = arcs.select(F.col("src").alias("vid")).unionByName(arcs.select(F.col("dst").alias("vid"))).distinct()
        nodes = assign_partitions(vids, parts, method, arcs=arcs)
    return build_graph(nodes, arcs, mode)
