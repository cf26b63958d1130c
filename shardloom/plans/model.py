"""A property graph as two DataFrames and the tables that follow from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.ids import number_within, numbered


def _with_ids(arcs: DataFrame) -> DataFrame:
    from shardloom.operators.fixpoint import cut

    counted = number_within(arcs, "src_pid", ["src", "dst", "value"], "eid", lambda df: cut(df, "edge-ids"))
    return counted.withColumn("eid", numbered(F.col("src_pid"), F.col("eid"))).select(*arcs.columns, "eid")


@dataclass(frozen=True)
class PropertyGraph:
    """vertices (vid, pid, sgid, ...) and edges (src, dst, value, src_pid, dst_pid, src_sgid, dst_sgid, is_remote).

    Directed multigraph; a subgraph is a connected piece of one partition.
    """

    vertices: DataFrame
    edges: DataFrame

    @cached_property
    def nodes(self) -> DataFrame:
        """What is known of vertices without forming subgraphs: vid, pid at least."""
        return self.vertices

    @cached_property
    def arcs(self) -> DataFrame:
        """What is known of edges without forming subgraphs: src, dst, value at least."""
        return self.edges

    @cached_property
    def local_edges(self) -> DataFrame:
        return self.edges.where("NOT is_remote")

    @cached_property
    def remote_edges(self) -> DataFrame:
        return self.edges.where("is_remote")

    @cached_property
    def remote_vertices(self) -> DataFrame:
        """One row for each vertex of another partition that a subgraph has an arc to."""
        return self.remote_edges.select(F.col("src_sgid").alias("sgid"), F.col("dst").alias("vid"), F.col("dst_sgid").alias("owner_sgid"), F.col("dst_pid").alias("owner_pid")).distinct()

    @cached_property
    def meta_edges(self) -> DataFrame:
        """Arcs between subgraphs, with the number of arcs and of remote vertices behind each."""
        return self.remote_edges.groupBy("src_sgid", "dst_sgid").agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_remote_vertices"))

    @cached_property
    def edge_ids(self) -> DataFrame:
        """The edges with eid: a counter within the partition, by source and sink, beside the partition's number."""
        return _with_ids(self.edges)

    @cached_property
    def arc_ids(self) -> DataFrame:
        """The same for arcs: the same ids, without forming subgraphs."""
        return _with_ids(self.arcs)

    def edge(self, eid: int) -> DataFrame:
        return self.edge_ids.where(F.col("eid") == eid)

    def out_edges(self, vid: int) -> DataFrame:
        return self.edges.where(F.col("src") == vid)

    def in_edges(self, vid: int) -> DataFrame:
        return self.edges.where(F.col("dst") == vid)

    def vertex(self, vid: int) -> DataFrame:
        return self.vertices.where(F.col("vid") == vid)

    def partition(self, pid: int) -> PropertyGraph:
        return PropertyGraph(self.vertices.where(F.col("pid") == pid), self.edges.where(F.col("src_pid") == pid))

    def subgraph(self, sgid: int) -> PropertyGraph:
        return PropertyGraph(self.vertices.where(F.col("sgid") == sgid), self.edges.where(F.col("src_sgid") == sgid))

    def simple(self) -> PropertyGraph:
        """Without parallel arcs; of several the one with the smallest value stays."""
        keys = [c for c in self.edges.columns if c != "value"]
        return PropertyGraph(self.vertices, self.edges.groupBy(*keys).agg(F.min("value").alias("value")).select(*self.edges.columns))


class BuiltGraph(PropertyGraph):
    """A graph whose subgraphs are formed, and whose edges are given them, when something first asks: much needs only ``nodes`` and ``arcs``."""

    def __init__(self, nodes: DataFrame, arcs: DataFrame, form: Callable[[DataFrame, DataFrame], DataFrame], place: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.__dict__.update(nodes=nodes, arcs=arcs, _form=form, _place=place)

    @cached_property
    def vertices(self) -> DataFrame:
        return self._form(self.nodes, self.arcs)

    @cached_property
    def edges(self) -> DataFrame:
        return self._place(self.vertices, self.arcs)
