"""Command line.

``python -m shardloom list``
``python -m shardloom run ALGORITHM --reader R --input DIR [--map FILE] --output DIR [--format F] [key=value ...]``
``python -m shardloom prepare --edges FILE (--map FILE | --parts N) --output DIR [--format F]``
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import cohesion, prepare, rank, stats, traversal
from shardloom.plans.model import PropertyGraph
from shardloom.sources import readers, writers

ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "VertexCount": stats.vertex_count,
    "EdgeCount": stats.edge_count,
    "EdgeList": stats.edge_list,
    "Dump": stats.dump,
    "ConnectedComponents": stats.connected_components,
    "SubgraphComponents": stats.subgraph_components,
    "GraphStats": stats.graph_stats,
    "SubgraphTopology": stats.subgraph_topology,
    "MetaGraph": stats.meta_graph,
    "MetaDiameter": stats.meta_diameter,
    "PageRank": rank.pagerank,
    "SubgraphRank": rank.subgraph_rank,
    "SSSP": traversal.sssp,
    "SpanningForest": traversal.spanning_forest,
    "KMeans": lambda g, **options: traversal.graph_kmeans(g, **options)[0],
    "TriangleCount": cohesion.triangle_count,
    "TriangleList": cohesion.triangle_list,
    "TrianglesPerSubgraph": cohesion.triangles_per_subgraph,
    "KCore": cohesion.kcore,
    "KCoreSubgraph": cohesion.kcore_subgraph,
}

#: Text forms of a prepared graph.
GRAPH_FORMS: dict[str, Callable[[PropertyGraph], DataFrame]] = {
    "full_info": writers.full_info_lines,
    "adjacency": lambda g: writers.adjacency_lines(g, True),
    "json": writers.json_lines,
    "neighbour_tuples": writers.neighbour_tuple_lines,
    "gml": writers.gml_lines,
}


def value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "none": None}.get(text.lower(), text)


def load(spark: SparkSession, reader: str, path: str, mode: str = "glue", mapping: str | None = None, parts: int = 4) -> PropertyGraph:
    """A graph in any of the readers' forms.  Formats that state subgraphs keep them; for others they are formed by ``mode``.

    An edge list takes its partitions from a partition map, or ``parts`` of them by hash.
    """
    if reader == "edge_list":
        table = readers.partition_map(spark, mapping) if mapping else parts
        return prepare.prepare(readers.snap_edges(spark, path), table, make_undirected=False, mode=mode)
    vertices, arcs, *_ = readers.READERS[reader](spark, path)
    if reader == "parquet":
        return PropertyGraph(vertices, arcs)
    if {"src_sgid", "dst_sgid", "src_pid", "dst_pid"} <= set(arcs.columns):
        return PropertyGraph(vertices, arcs.withColumn("is_remote", F.col("src_sgid") != F.col("dst_sgid")))
    columns = [c for c in ("src", "dst", "value") if c in arcs.columns]
    if "value" in columns:
        arcs = arcs.withColumn("value", F.col("value").try_cast("double"))
    return prepare.build_graph(vertices.select("vid", "pid"), arcs.select(*columns), mode)


def write(result: DataFrame, path: str, form: str) -> None:
    """Results as a table, or as text: one line for each row, its columns parted by tabs."""
    if form != "text":
        result.write.format(form).save(path)
        return
    lines = result if result.columns == ["value"] else result.select(writers.text(*result.columns))
    writers.write_lines(lines, path)


def log(kind: str, **fields) -> None:
    print(json.dumps({"event": kind, **fields}), file=sys.stderr)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shardloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("algorithm", choices=sorted(ALGORITHMS))
    run.add_argument("--reader", choices=sorted([*readers.READERS, "edge_list"]), default="adjacency")
    run.add_argument("--input", required=True)
    ready = commands.add_parser("prepare")
    ready.add_argument("--edges", required=True)
    ready.add_argument("--directed", action="store_true", help="keep arcs as they are; by default both directions are made")
    ready.add_argument("--method", choices=("hash", "modulo", "range", "labels"), default="hash")
    for command in (run, ready):
        command.add_argument("--mode", choices=("glue", "local"), default="glue" if command is run else "local")
        command.add_argument("--map", help="partition map: lines of vid pid")
        command.add_argument("--parts", type=int, default=4, help="partitions where there is no map")
        command.add_argument("--output", required=True)
    run.add_argument("--format", choices=("parquet", "csv", "json", "text"), default="parquet")
    ready.add_argument("--format", choices=("parquet", *sorted(GRAPH_FORMS)), default="full_info")
    asked, options = parser.parse_known_args(argv)
    if stray := [o for o in options if asked.command != "run" or o.startswith("-") or "=" not in o]:
        parser.error(f"unknown arguments: {' '.join(stray)}")
    if asked.command == "list":
        print("\n".join(sorted(ALGORITHMS)))
        return
    spark = SparkSession.builder.appName(f"shardloom {asked.command}").getOrCreate()
    context = spark.sparkContext
    log("config", **vars(asked), master=context.master, parallelism=context.defaultParallelism, shuffle_partitions=spark.conf.get("spark.sql.shuffle.partitions"))
    began = time.time()
    if asked.command == "prepare":
        edges = readers.snap_edges(spark, asked.edges)
        table = readers.partition_map(spark, asked.map) if asked.map else asked.parts
        g = prepare.prepare(edges, table, not asked.directed, asked.method, asked.mode)
        log("load", start=began, end=time.time(), seconds=time.time() - began)
        if asked.format == "parquet":
            writers.write_parquet(g, asked.output)
        else:
            lines = GRAPH_FORMS[asked.format](g)
            writers.write_lines(lines.select("value"), asked.output)
        return
    options = {k: value(v) for k, _, v in (o.partition("=") for o in options)}
    g = load(spark, asked.reader, asked.input, asked.mode, asked.map, asked.parts)
    log("load", start=began, end=time.time(), seconds=time.time() - began)
    write(ALGORITHMS[asked.algorithm](g, **options), asked.output, asked.format)
    log("run", algorithm=asked.algorithm, seconds=time.time() - began)


if __name__ == "__main__":
    main()
