"""The loop that iterative operators share, and connected components built on it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.shipping import ship


_scratch: list[str] = []
#: Estimated size of a table that a join in a loop may broadcast, and rows of one that is broadcast after they were counted.
BROADCAST_BYTES, BROADCAST_ROWS = 1 << 16, 1 << 16
#: Edges that one task joins into components.
TASK_EDGES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(f"file://{os.path.realpath(tempfile.mkdtemp(prefix='shardloom-'))}")
        named = context._jsc.sc().getCheckpointDir().get()
    return "/".join([named.rstrip("/"), *_scratch[-1:]])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is written to the shared folder within the block goes to a folder of its own, which is deleted when the block ends.

    Results read those tables when they are computed, so write them within the block, to another place.
    """
    _scratch.append(f"scratch-{uuid.uuid4().hex}")
    folder = shared_dir(spark)
    try:
        yield folder
    finally:
        _scratch.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within the block go when it is written; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins of what is written within the block send only tables of up to ``BROADCAST_BYTES`` to the driver.

    Spark goes by the size of files and shuffles, of which ids in order are a twentieth of what they are in memory.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1" if before.startswith("-") else str(BROADCAST_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, what: str = "round", watch: dict[str, Column] | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and a lost executor costs no earlier round.

    ``watch``: aggregates that are taken while the table is written, so no job
    of their own reads it again; they are in ``_watched`` of the result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    seen = Observation() if watch else None
    with shuffles_dropped(spark), small_broadcasts(spark):
        (df.observe(seen, *[c.alias(n) for n, c in watch.items()]) if watch else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path, out._watched = path, seen.get if seen else {}
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[dict, int], bool], max_rounds: int | None = None, watch: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """Apply ``step`` until ``done`` holds for the watched aggregates of a state and the rounds so far; the last state and the number of rounds.

    Each state is cut, its predecessor deleted.
    """
    state, rounds = cut(state, watch=watch), 0
    while not done(state._watched, rounds) and (max_rounds is None or rounds < max_rounds):
        after = cut(step(state, rounds), watch=watch)
        drop(state)
        state, rounds = after, rounds + 1
    return state, rounds


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that aren't the smallest of their component, and that smallest one."""
    names, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, root = both[: len(src)], both[len(src) :], np.arange(len(names))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    hung = np.flatnonzero(root != np.arange(len(root)))
    return names[hung], names[root[hung]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of a task's edges, ``TASK_EDGES`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def hung() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["src", "dst"])

    for whole in batches:
        for at in range(0, whole.num_rows, TASK_EDGES):
            batch = whole.slice(at, TASK_EDGES)
            if held and rows + batch.num_rows > TASK_EDGES:
                yield hung()
                held, rows = [], 0
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
    if held:
        yield hung()


def whole(batches: Iterator[pa.RecordBatch], rows: int = TASK_EDGES) -> Iterator[list[np.ndarray]]:
    """The columns of a task's rows, which come sorted by the first one, at least ``rows`` at a time but with all rows of a key together."""
    held: list[list[np.ndarray]] = []
    have = 0
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if have >= rows:
            other = np.flatnonzero(columns[0] != held[-1][0][-1])
            if len(other):
                held.append([c[: other[0]] for c in columns])
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, have, columns = [], 0, [c[other[0] :] for c in columns]
        if len(columns[0]):
            held.append(columns)
            have += len(columns[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node id) for the nodes of an undirected edge table (src, dst).

    Edges are dealt by ranges of their sources, and a task hangs the nodes of its
    edges on the smallest one of each piece.  Pieces of several tasks that share a
    node are edges between pieces; they are contracted in the same way while that
    at least halves them or they are more than ``TASK_EDGES``, which one task joins, and
    otherwise by ``_stars``.  Where near ids are near in the graph, little is left
    after the first time; where they aren't, it costs one pass over the edges.
    """
    ship(edges.sparkSession)
    kind = edges.schema["src"].dataType
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    e = cut(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), "pieces", {"n": F.count(F.lit(1))})
    levels: list[DataFrame] = []
    while (n := e._watched["n"]) > TASK_EDGES and (not levels or 2 * n <= levels[-1]._watched["n"]):
        # node, root: the pieces of each task; a node of several pieces joins them, and a root is in its own
        hung = cut(e.repartitionByRange(-(-n // (TASK_EDGES // 4)), "dst").mapInArrow(_forests, "src bigint, dst bigint"), "pieces", {"n": F.count(F.lit(1))})
        drop(e)
        held = hung.unionByName(hung.select(F.col("dst").alias("src"), "dst").distinct())
        low = cut(held.groupBy("src").agg(F.min("dst").alias("dst")), "pieces", {"n": F.count(F.lit(1))})
        e = held.join(low.withColumnRenamed("dst", "low"), "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        e = cut(e, "pieces", {"n": F.count(F.lit(1))})
        low._watched = hung._watched
        levels.append(low)
        drop(hung)
    if n > TASK_EDGES:
        hung = _stars(e)
    else:
        hung = cut(e.coalesce(1).mapInArrow(_forests, "src bigint, dst bigint"), "pieces")
        drop(e)
    label = hung.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(hung.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
    for low in reversed(levels):
        named = low.join(label.select(F.col("node").alias("dst"), "component"), "dst", "left")
        label = named.select(F.col("src").alias("node"), F.coalesce("component", "dst").alias("component"))
    return label.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def _stars(e: DataFrame) -> DataFrame:
    """src, dst: every node but the smallest of its component, and that one.

    Alternating large-star and small-star rounds: every round hangs the
    neighbours of a node on the smallest node among them, so the number of
    rounds grows with the logarithm of the longest path, and hubs never gather
    more rows than they have distinct neighbours.
    """
    e = e.distinct()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else pairs
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        joined = both.join(low, "src")
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")) if large else joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
        return out.where("src <> dst").distinct()

    def step(pairs: DataFrame, _: int) -> DataFrame:
        return star(star(pairs, True), False)

    seen: list[dict] = []

    def done(now: dict, _: int) -> bool:
        seen.append(dict(now))
        return not now["n"] or len(seen) > 1 and seen[-1] == seen[-2]

    stars, _ = fixpoint(e, step, done, watch={"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), "last": F.max("src")})
    return stars
