"""Writers of graph text formats and results: each has a form as lines (a DataFrame with the column value)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.shipping import ship
from shardloom.operators.prepare import drop_self_loops, relabel, symmetrize
from shardloom.plans.model import PropertyGraph


def write_lines(lines: DataFrame, path: str, by: str | None = None) -> None:
    out = lines.write.partitionBy(by) if by else lines.write
    out.text(path)


def text(*columns: Column | str, sep: str = "\t") -> Column:
    """Columns as one line; nulls are empty."""
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]).alias("value")


def _sinks(edges: DataFrame, key: list[str], parts: Column, sep: str = " ") -> DataFrame:
    return edges.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda x: x["t"]), sep).alias("sinks"))


def adjacency_lines(g: PropertyGraph, with_partition: bool = False) -> DataFrame:
    """pid, value: ``vid [pid] sink ...`` of every vertex, also those without arcs."""
    near = _sinks(g.arcs, ["src"], F.struct("dst", F.col("dst").cast("string").alias("t"))).withColumnRenamed("src", "vid")
    rows = g.nodes.join(near, "vid", "left")
    head = [F.col("vid").cast("string"), *([F.col("pid").cast("string")] if with_partition else [])]
    return rows.select("pid", F.rtrim(F.concat_ws(" ", *head, F.coalesce("sinks", F.lit("")))).alias("value"))


def json_lines(g: PropertyGraph, value: Column | None = None) -> DataFrame:
    """pid, value: ``[vid,pid,"value",[[sink,eid,"value"],...]]``."""
    cell = F.struct("dst", F.format_string('[%d,%d,"%s"]', F.col("dst"), F.col("eid"), F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("t"))
    near = _sinks(g.arc_ids, ["src"], cell, ",").withColumnRenamed("src", "vid")
    own = (value if value is not None else F.lit("")).cast("string")
    return g.nodes.join(near, "vid", "left").select("pid", F.format_string('[%d,%d,"%s",[%s]]', F.col("vid"), F.col("pid"), own, F.coalesce("sinks", F.lit(""))).alias("value"))


def full_info_lines(g: PropertyGraph) -> DataFrame:
    """pid, value: ``pid <tab> vid sgid (sink sgid pid)*``, rows of a partition together and in order of vid."""
    cell = F.struct("dst", F.concat_ws(" ", F.col("dst").cast("string"), F.col("dst_sgid").cast("string"), F.col("dst_pid").cast("string")).alias("t"))
    near = _sinks(g.edges, ["src"], cell).withColumnRenamed("src", "vid")
    line = F.rtrim(F.concat(F.col("pid").cast("string"), F.lit("\t"), F.concat_ws(" ", F.col("vid").cast("string"), F.col("sgid").cast("string"), F.coalesce("sinks", F.lit("")))))
    return g.vertices.join(near, "vid", "left").repartition("pid").sortWithinPartitions("pid", "vid").select("pid", line.alias("value"))


def neighbour_tuple_lines(g: PropertyGraph) -> DataFrame:
    """value: ``pid,vid,sgid <tab> eid,sink,sgid,pid:...`` of every vertex with arcs, each different sink once with its smallest edge id."""
    arcs = g.edge_ids.groupBy("src_pid", "src", "src_sgid", "dst", "dst_sgid", "dst_pid").agg(F.min("eid").alias("eid"))
    cell = F.struct("eid", F.concat_ws(",", *[F.col(c).cast("string") for c in ("eid", "dst", "dst_sgid", "dst_pid")]).alias("t"))
    near = _sinks(arcs, ["src_pid", "src", "src_sgid"], cell, ":")
    return near.select(F.concat(F.concat_ws(",", *[F.col(c).cast("string") for c in ("src_pid", "src", "src_sgid")]), F.lit("\t"), F.col("sinks")).alias("value"))


def metis_lines(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """line, value of the METIS form of the undirected simple graph, and the map (new_id, old_id).

    Line 0 is the header ``vertices edges``, line i lists the neighbours of vertex i.
    """
    numbered, table = relabel(symmetrize(drop_self_loops(arcs.select("src", "dst"))))
    near = _sinks(numbered, ["src"], F.struct("dst", F.col("dst").cast("string").alias("t")))
    rows = near.select(F.col("src").alias("line"), F.col("sinks").alias("value"))
    head = numbered.agg(F.lit(0).cast("long").alias("line"), F.concat_ws(" ", F.count_distinct("src").cast("string"), (F.count("*") / 2).cast("long").cast("string")).alias("value"))
    return head.unionByName(rows), table


def blogel_lines(arcs: DataFrame, count_before_dedupe: bool = False) -> DataFrame:
    """``src <tab> n neighbour ...``, neighbours once each; n counts them, or all arcs."""
    near = arcs.groupBy("src").agg(F.count("*").alias("arcs"), F.sort_array(F.collect_set("dst")).alias("near"))
    n = F.col("arcs") if count_before_dedupe else F.size("near")
    return near.select(F.concat(F.col("src").cast("string"), F.lit("\t"), F.concat_ws(" ", n.cast("string"), F.array_join(F.transform("near", lambda x: x.cast("string")), " "))).alias("value"))


def edge_lines(arcs: DataFrame) -> DataFrame:
    return arcs.select(text("src", "dst", sep=" "))


def map_lines(table: DataFrame) -> DataFrame:
    """``new old`` of a relabelling."""
    return table.select(text("new_id", "old_id", sep=" "))


def gml_lines(g: PropertyGraph) -> DataFrame:
    """GML with nodes and edges; part orders header, nodes, edges, end."""
    spark = g.vertices.sparkSession
    ends = spark.createDataFrame([(0, "graph [\n  directed 1"), (3, "]")], "part int, value string")
    nodes = g.nodes.select(F.lit(1).alias("part"), F.format_string("  node [ id %d ]", "vid").alias("value"))
    edges = g.arcs.select(F.lit(2).alias("part"), F.format_string("  edge [ source %d target %d ]", "src", "dst").alias("value"))
    return ends.unionByName(nodes).unionByName(edges)


def subgraph_file_lines(g: PropertyGraph, values: DataFrame | None = None, sep: str = "\t") -> DataFrame:
    """sgid, value: for each subgraph a header ``sgid pid (sgid pid)*``, then ``vid value sink*``; rows of a subgraph together, the header first.

    ``values``: vid and one more column, 0 where a vertex has none.
    Write with ``write_subgraph_files``, or ``write_lines(lines, path, "sgid")`` for a folder each: one file is one subgraph.
    """
    owner = g.vertices.select("sgid", "pid").distinct()
    near = g.edges.where("is_remote").select(F.col("src_sgid").alias("sgid"), F.col("dst_sgid").alias("dst"), "dst_pid").distinct()
    cells = _sinks(near, ["sgid"], F.struct("dst", F.concat_ws(sep, F.col("dst").cast("string"), F.col("dst_pid").cast("string")).alias("t")), sep)
    # concat_ws leaves nulls out, so rows without sinks have no trailing separator
    head = owner.join(cells, "sgid", "left").select("sgid", F.lit(None).cast("long").alias("vid"), F.concat_ws(sep, F.col("sgid").cast("string"), F.col("pid").cast("string"), "sinks").alias("value"))
    sinks = _sinks(g.edges, ["src"], F.struct("dst", F.col("dst").cast("string").alias("t")), sep).withColumnRenamed("src", "vid")
    rows = g.vertices.join(sinks, "vid", "left")
    rows = rows.join(values.select("vid", F.col(values.columns[1]).alias("_value")), "vid", "left") if values is not None else rows.withColumn("_value", F.lit(None).cast("double"))
    body = rows.select("sgid", "vid", F.concat_ws(sep, F.col("vid").cast("string"), F.coalesce(F.col("_value").cast("string"), F.lit("0")), "sinks").alias("value"))
    return head.unionByName(body).repartition("sgid").sortWithinPartitions("sgid", F.asc_nulls_first("vid")).select("sgid", "value")


def write_subgraph_files(lines: DataFrame, path: str) -> int:
    """Write ``subgraph_file_lines`` as one file for each subgraph, named by its id, in one folder for each task; the number of files.

    Tasks write their files themselves, so the driver neither commits nor lists
    them; a task that is run again writes the same files.  Read with
    ``subgraph_files(spark, path, foldered=True)``; pyarrow must be able to open ``path``.
    """
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        folder, count = f"{base}/part-{TaskContext.get().partitionId():05d}", 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for sgid, own in itertools.groupby(rows, lambda r: r[0]):
            if not count:
                store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{sgid}") as out:
                for some in itertools.batched(own, 10_000):
                    out.write("".join(f"{line}\n" for _, line in some).encode())
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    return lines.select("sgid", "value").mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


def subgraph_value_lines(values: DataFrame) -> DataFrame:
    return values.select(text("sgid", values.columns[1]))


def vertex_value_lines(values: DataFrame, sep: str = "\t") -> DataFrame:
    return values.select(text("vid", values.columns[1], sep=sep))


def distance_lines(g: PropertyGraph, dist: DataFrame, unreached: int | None = 32767) -> DataFrame:
    """``vid <tab> dist`` of all vertices; ``unreached`` stands for no path, or such vertices are left out."""
    rows = g.nodes.select("vid").join(dist.select("vid", "dist"), "vid", "left" if unreached is not None else "inner")
    return rows.select(text("vid", F.coalesce(F.col("dist").cast("string"), F.lit(str(unreached)))))


def write_parquet(g: PropertyGraph, path: str) -> None:
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
