"""Readers of graph text formats.  Each returns (vertices, arcs) as lazy DataFrames.

vertices: vid, pid and what else the format has; arcs: src, dst, value and what
else the format has.  Lines are parsed by built-in functions in the scan's
stage.  Rows and arcs whose ids aren't numbers, such as header lines, are dropped;
other fields that aren't what they should be are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.shipping import ship

#: Bytes of files that a task holds before it passes them on.
FILE_BYTES = 16 << 20
Sanitizer = Callable[[Column], Column]


def _lines(spark: SparkSession, path: str, sanitize: Sanitizer | None = None) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = lines.withColumn("line", sanitize(F.col("line"))) if sanitize else lines
    return lines.where(F.trim("line") != "")


def _words(lines: DataFrame) -> DataFrame:
    return lines.withColumn("w", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("bigint")))


def file_partitions(lines: DataFrame) -> DataFrame:
    """A number for each file, in order of their paths; one row per file, so the table may be broadcast."""
    files = sorted(r["file"] for r in lines.select("file").distinct().collect())
    return lines.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, pid int")


def adjacency(spark: SparkSession, path: str, sanitize: Sanitizer | None = None) -> tuple[DataFrame, DataFrame]:
    """``vid sink sink ...``; the file is the partition."""
    rows = _words(_lines(spark, path, sanitize))
    rows = rows.join(F.broadcast(file_partitions(rows)), "file").where(F.element_at("w", 1).isNotNull())
    return _adjacency(rows, F.element_at("w", 1), F.col("pid"), 2)


def partitioned_adjacency(spark: SparkSession, path: str, sanitize: Sanitizer | None = None) -> tuple[DataFrame, DataFrame]:
    """``vid pid sink sink ...``."""
    rows = _words(_lines(spark, path, sanitize)).where(F.get("w", F.lit(0)).isNotNull() & F.get("w", F.lit(1)).isNotNull())
    return _adjacency(rows, F.element_at("w", 1), F.element_at("w", 2).try_cast("int"), 3)


def _adjacency(rows: DataFrame, vid: Column, pid: Column, first: int) -> tuple[DataFrame, DataFrame]:
    vertices = rows.select(vid.alias("vid"), pid.alias("pid")).distinct()
    sinks = F.when(F.size("w") >= first, F.slice("w", first, F.size("w"))).otherwise(F.array().cast("array<bigint>"))
    arcs = rows.select(vid.alias("src"), F.explode(sinks).alias("dst"), F.lit(None).cast("double").alias("value"))
    return vertices, arcs.where("dst IS NOT NULL")


def json_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``[vid, pid, value, [[sink, eid, value], ...]]``; values stay text."""
    cells = F.from_json("line", "array<string>")
    rows = _lines(spark, path).select(cells.alias("a"))
    rows = rows.select(F.get("a", F.lit(0)).try_cast("bigint").alias("vid"), F.get("a", F.lit(1)).try_cast("int").alias("pid"), F.get("a", F.lit(2)).alias("value"), F.from_json(F.get("a", F.lit(3)), "array<array<string>>").alias("edges")).where("vid IS NOT NULL")
    arcs = rows.select(F.col("vid").alias("src"), F.explode("edges").alias("x")).select("src", F.get("x", F.lit(0)).try_cast("bigint").alias("dst"), F.get("x", F.lit(1)).try_cast("bigint").alias("eid"), F.get("x", F.lit(2)).alias("value"))
    return rows.select("vid", "pid", "value"), arcs.where("dst IS NOT NULL")


def full_info(spark: SparkSession, path: str, pid_base: int = 0) -> tuple[DataFrame, DataFrame]:
    """``pid <tab> vid sgid (sink sgid pid)*``; ``pid_base`` is subtracted from the stored partition."""
    rows = _lines(spark, path).select(F.split("line", "\t", 2).alias("p")).select((F.trim(F.get("p", F.lit(0))).try_cast("int") - pid_base).alias("pid"), F.transform(F.split(F.trim(F.get("p", F.lit(1))), r"\s+"), lambda x: x.try_cast("bigint")).alias("w"))
    rows = rows.select("pid", F.get("w", F.lit(0)).alias("vid"), F.get("w", F.lit(1)).alias("sgid"), "w").where("pid IS NOT NULL AND vid IS NOT NULL AND sgid IS NOT NULL")
    triples = F.when(F.size("w") > 4, F.transform(F.sequence(F.lit(3), F.size("w") - 2, F.lit(3)), lambda i: F.struct(F.element_at("w", i).alias("dst"), F.element_at("w", i + 1).alias("dst_sgid"), (F.element_at("w", i + 2) - pid_base).try_cast("int").alias("dst_pid"))))
    arcs = rows.select(F.col("vid").alias("src"), F.col("sgid").alias("src_sgid"), F.col("pid").alias("src_pid"), F.explode(triples).alias("x"))
    return rows.select("vid", "pid", "sgid"), arcs.select("src", "x.dst", F.lit(None).cast("double").alias("value"), "src_pid", "x.dst_pid", "src_sgid", "x.dst_sgid").where("dst IS NOT NULL AND dst_pid IS NOT NULL AND dst_sgid IS NOT NULL")


def _foldered(spark: SparkSession, path: str) -> DataFrame:
    """value: the whole text of each file in the folders of a folder; the driver lists the folders, tasks list and read their files."""
    ship(spark)
    store, base = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    folders = sorted(x.base_name for x in found if x.type == fs.FileType.Directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        out: list[str] = []
        size = 0
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            for info in store.get_file_info(fs.FileSelector(f"{base}/{name}")):
                if info.type == fs.FileType.File:
                    with store.open_input_file(info.path) as file:
                        out.append(file.read().decode("utf-8", "replace"))
                    size += len(out[-1])
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    names = spark.sparkContext.parallelize([(x,) for x in folders], max(1, len(folders)))
    return spark.createDataFrame(names, "folder string").mapInArrow(run, "value string")


def subgraph_files(spark: SparkSession, path: str, delimiter: str = "\t", scale_weights: bool = False, sanitize: Sanitizer | None = None, foldered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One file is one subgraph: header ``sgid pid (sgid pid)*``, then ``vid value sink*``.

    Returns vertices, arcs and the header's neighbours (sgid, neighbour_sgid,
    neighbour_pid).  ``scale_weights`` gives each arc the weight (src + dst) % 100.
    ``foldered``: the files are in folders of ``path``, as ``write_subgraph_files`` leaves
    them; tasks list them, so their number is no load on the driver.
    """
    whole = (_foldered(spark, path) if foldered else spark.read.text(path, wholetext=True)).select(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    cut = lambda c: F.split(sanitize(c) if sanitize else c, F.lit(rf"\Q{delimiter}\E"))
    whole = whole.where(F.size("lines") > 0).select(cut(F.element_at("lines", 1)).alias("h"), F.slice("lines", 2, F.size("lines")).alias("body"))
    whole = whole.select(F.get("h", F.lit(0)).try_cast("bigint").alias("sgid"), F.get("h", F.lit(1)).try_cast("int").alias("pid"), "h", "body").where("sgid IS NOT NULL")
    near = F.when(F.size("h") > 3, F.transform(F.sequence(F.lit(3), F.size("h") - 1, F.lit(2)), lambda i: F.struct(F.element_at("h", i).try_cast("bigint").alias("neighbour_sgid"), F.element_at("h", i + 1).try_cast("int").alias("neighbour_pid"))))
    neighbours = whole.select("sgid", F.explode(near).alias("x")).select("sgid", "x.*").where("neighbour_sgid IS NOT NULL")
    rows = whole.select("sgid", "pid", F.explode("body").alias("line")).select("sgid", "pid", cut(F.col("line")).alias("w"))
    rows = rows.select(F.get("w", F.lit(0)).try_cast("bigint").alias("vid"), "pid", "sgid", F.get("w", F.lit(1)).try_cast("double").alias("value"), F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0))).alias("sinks")).where("vid IS NOT NULL")
    arcs = rows.select(F.col("vid").alias("src"), F.explode("sinks").alias("dst")).select("src", F.col("dst").try_cast("bigint").alias("dst")).where("dst IS NOT NULL")
    weight = ((F.col("src") + F.col("dst")) % 100).cast("double") if scale_weights else F.lit(None).cast("double")
    return rows.drop("sinks"), arcs.withColumn("value", weight), neighbours


def snap_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of ``src dst`` lines; lines that begin with # are comments."""
    w = F.split(F.trim("line"), r"\s+")
    rows = _lines(spark, path).where(~F.col("line").startswith("#"))
    return rows.select(F.get(w, F.lit(0)).try_cast("bigint").alias("src"), F.get(w, F.lit(1)).try_cast("bigint").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def partition_map(spark: SparkSession, path: str) -> DataFrame:
    """vid, pid of ``vid pid`` lines."""
    w = F.split(F.trim("line"), r"\s+")
    return _lines(spark, path).select(F.get(w, F.lit(0)).try_cast("bigint").alias("vid"), F.get(w, F.lit(1)).try_cast("int").alias("pid")).where("vid IS NOT NULL AND pid IS NOT NULL")


def parquet_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


READERS = {"adjacency": adjacency, "dense_adjacency": adjacency, "partitioned": partitioned_adjacency, "json": json_rows, "full_info": full_info, "subgraph_files": subgraph_files, "parquet": parquet_graph}
