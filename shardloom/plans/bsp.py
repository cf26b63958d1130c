"""A user-extensible superstep API: think like a subgraph.

A computation is a class with ``compute(ctx, messages)`` and, if wanted,
``wrapup(ctx)`` and ``combine(a, b)``.  It is run once per superstep for every
subgraph that hasn't voted to halt or has messages.  A round deals the rows of
topologies, values and messages by subgraph id and streams them, sorted, through
the tasks, many subgraphs in a batch; what it returns is written to the shared
folder, so executors may be lost at any time.  The topology is written once, a
round writes only values, messages and metrics, and values and messages of earlier
rounds are deleted.  Messages come in order of their sender and of sending.  What
is sent to all comes once for each subgraph and message, which is a product;
with ``combine`` it comes as one message without a sender, before all others.  An
error in user code fails the job.  Topology and state of one subgraph must fit in
a worker's memory.
"""

from __future__ import annotations

import functools
import itertools
import operator
import pickle
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.shipping import ship
from shardloom.operators.fixpoint import cut, drop
from shardloom.plans.model import PropertyGraph

_OUT = "kind string, sgid bigint, target bigint, nth bigint, body binary, halted boolean, amount double"
_TOPOLOGY = "sgid bigint, topology binary"
#: Rows and bytes that a task gathers before it returns them.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


@dataclass(frozen=True)
class Message:
    sender: int | None
    target: int | None
    payload: Any


@dataclass
class Topology:
    """One subgraph: local vertices with their out-arcs, and remote vertices with their owners."""

    sgid: int
    pid: int
    arcs: dict[int, list[tuple[int, float | None]]]
    remote: dict[int, int]

    @property
    def local_vertices(self) -> list[int]:
        return list(self.arcs)

    @property
    def neighbours(self) -> set[int]:
        return set(self.remote.values())


@dataclass
class Context:
    """What user code sees of its subgraph and of the run."""

    graph: Topology
    superstep: int
    conf: dict[str, Any]
    value: Any = None
    halted: bool = False
    _sent: list[tuple[str, int | None, Any]] = field(default_factory=list)
    _rows: list[tuple] = field(default_factory=list)

    def vote_to_halt(self) -> None:
        self.halted = True

    def send(self, sgid: int, payload: Any) -> None:
        self._sent.append(("message", sgid, payload))

    def send_many(self, sgid: int, payloads: Iterable[Any]) -> None:
        for payload in payloads:
            self.send(sgid, payload)

    def send_to_vertex(self, vid: int, payload: Any) -> None:
        self._sent.append(("vertex", vid, payload))

    def send_to_all(self, payload: Any) -> None:
        """To every subgraph, this one included."""
        self._sent.append(("all", None, payload))

    def send_to_neighbours(self, payload: Any) -> None:
        """One copy to each subgraph this one has arcs to."""
        for sgid in sorted(self.graph.neighbours):
            self.send(sgid, payload)

    def emit(self, *row: Any) -> None:
        """A result row; for wrapup."""
        self._rows.append(row)


class SubgraphComputation:
    #: A commutative and associative function of two payloads: messages to all are combined to one.
    combine: Callable[[Any, Any], Any] | None = None

    def compute(self, ctx: Context, messages: list[Message]) -> None:
        raise NotImplementedError

    def wrapup(self, ctx: Context) -> None:
        """Emit result rows after the run has ended; by default (sgid, value)."""
        ctx.emit(ctx.graph.sgid, ctx.value)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str, binary: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded length and size; ``binary``: the column that takes the space."""
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += len(row[binary] or b"")
        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(out, schema)
            out, size = [], 0
    yield _batch(out, schema)


def _topologies(g: PropertyGraph) -> DataFrame:
    arcs = g.edges.select(F.col("src_sgid").alias("sgid"), F.col("src").alias("vid"), "dst", "value", F.when(F.col("is_remote"), F.col("dst_sgid")).alias("owner"), F.lit(None).cast("int").alias("pid"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("dst", "long"), ("value", "double"), ("owner", "long"))}
    rows = g.vertices.select("sgid", "vid", "pid").withColumns(nothing).select(*arcs.columns).unionByName(arcs)

    def packed(rows: Iterator[tuple]) -> Iterator[tuple]:
        # a subgraph's vertices come before its arcs
        for sgid, own in itertools.groupby(rows, lambda r: r[0]):
            out = None
            for _, vid, dst, value, owner, pid in own:
                if pid is not None:
                    out = out or Topology(sgid, pid, {}, {})
                    out.arcs[vid] = []
                else:
                    out.arcs[vid].append((dst, value))
                    if owner is not None:
                        out.remote[dst] = owner
            yield sgid, pickle.dumps(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(packed(_rows(batches)), _TOPOLOGY, 1)

    return rows.repartition("sgid").sortWithinPartitions("sgid", F.col("pid").isNull(), "vid", "dst").mapInArrow(run, _TOPOLOGY)


def _superstep(program: SubgraphComputation, step: int, conf: dict[str, Any], common: list[Message]):
    """One superstep of the subgraphs of a task; rows come sorted: a subgraph's topology, its state, its messages."""

    def computed(rows: Iterator[tuple]) -> Iterator[tuple]:
        together: Any = None  # what is sent to all, combined
        for sgid, own in itertools.groupby(rows, lambda r: r[0]):
            topology, state, inbox = None, None, []
            for _, kind, _, _, body, halted in own:
                if kind == 0:
                    topology = body
                elif kind == 1:
                    state = body, halted
                else:
                    inbox.append(body)
            if topology is None:
                continue  # a message to a subgraph that isn't there
            body, halted = state
            if halted and not inbox and not common:
                yield "state", sgid, None, None, body, True, 0.0
                continue
            messages = common + [pickle.loads(m) for m in inbox]
            ctx, began = Context(pickle.loads(topology), step, conf, pickle.loads(body)), time.perf_counter()
            program.compute(ctx, messages)
            took = time.perf_counter() - began
            yield "state", sgid, None, None, pickle.dumps(ctx.value), ctx.halted, 0.0
            for nth, (kind, target, payload) in enumerate(ctx._sent):
                to = target
                if kind == "vertex":  # most are the sender's own or known to it; others are looked up
                    to = sgid if target in ctx.graph.arcs else ctx.graph.remote.get(target)
                    kind, to = ("vertex", target) if to is None else ("message", to)
                if kind == "all" and program.combine:
                    together = (payload,) if together is None else (program.combine(together[0], payload),)
                else:
                    yield kind, sgid, to, nth, pickle.dumps(Message(sgid, target, payload)), None, 0.0
            yield "seconds", sgid, None, None, None, None, took
            yield "received", sgid, None, None, None, None, float(len(messages))
            yield "sent", sgid, None, None, None, None, float(len(ctx._sent))
            yield "broadcast", sgid, None, None, None, None, float(sum(kind == "all" for kind, _, _ in ctx._sent))
        if together is not None:
            yield "combined", None, None, None, pickle.dumps(together[0]), None, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(computed(_rows(batches)), _OUT, 4)

    return run


def run_bsp(g: PropertyGraph, program: SubgraphComputation, schema: str, conf: dict[str, Any] | None = None, max_supersteps: int = 1000) -> tuple[DataFrame, DataFrame, int]:
    """Result rows of ``wrapup``, metrics (superstep, sgid, metric, amount) and the number of supersteps.

    The run ends when all subgraphs have halted and no message is under way.
    """
    spark = g.vertices.sparkSession
    ship(spark)
    conf, step = dict(conf or {}), 0
    topology = cut(_topologies(g), "bsp-topology")
    state = topology.select("sgid", F.lit(pickle.dumps(None)).alias("body"), F.lit(False).alias("halted"))
    owners = g.vertices.select(F.col("vid").alias("target"), F.col("sgid").alias("to"))
    every = topology.select(F.col("sgid").alias("to"))
    nobody, no_body = F.lit(None).cast("long"), F.lit(None).cast("boolean")
    static = topology.select("sgid", F.lit(0).alias("kind"), nobody.alias("sender"), nobody.alias("nth"), F.col("topology").alias("body"), no_body.alias("halted"))
    inbox: DataFrame | None = None
    common: list[Message] = []
    metrics: list[DataFrame] = []
    before = None
    while True:
        if step >= max_supersteps:
            raise RuntimeError(f"no end after {max_supersteps} supersteps")
        rows = static.unionByName(state.select("sgid", F.lit(1).alias("kind"), nobody.alias("sender"), nobody.alias("nth"), "body", "halted"))
        if inbox is not None:
            rows = rows.unionByName(inbox.select(F.col("to_sgid").alias("sgid"), F.lit(2).alias("kind"), "sender", "nth", F.col("message").alias("body"), no_body.alias("halted")))
        rows = rows.repartition("sgid").sortWithinPartitions("sgid", "kind", "sender", "nth")
        kinds = {k: F.count_if(F.col("kind") == k) for k in ("message", "vertex", "all", "combined")}
        out = cut(rows.mapInArrow(_superstep(program, step, conf, common), _OUT), "bsp", {"active": F.count_if((F.col("kind") == "state") & ~F.col("halted")), **kinds})
        seen = out._watched
        counted = out.where("kind IN ('seconds', 'received', 'sent', 'broadcast')").select(F.lit(step).alias("superstep"), "sgid", F.col("kind").alias("metric"), "amount")
        metrics.append(cut(counted, "bsp-metrics"))
        if before is not None:
            drop(before)
        before = out
        state = out.where("kind = 'state'").select("sgid", "body", "halted")
        sent = out.where("kind IN ('message', 'vertex', 'all')").select("kind", "target", F.col("sgid").alias("sender"), "nth", F.col("body").alias("message"))
        step += 1
        if not any(seen.values()):
            break
        boxes = []
        if seen["message"]:
            boxes.append(sent.where("kind = 'message'").select(F.col("target").alias("to_sgid"), "sender", "nth", "message"))
        if seen["vertex"]:
            boxes.append(sent.where("kind = 'vertex'").join(owners, "target").select(F.col("to").alias("to_sgid"), "sender", "nth", "message"))
        if seen["all"]:
            # to all: the product is what was asked for, a copy for each subgraph
            boxes.append(sent.where("kind = 'all'").select("sender", "nth", "message").crossJoin(every).select(F.col("to").alias("to_sgid"), "sender", "nth", "message"))
        inbox = functools.reduce(DataFrame.unionByName, boxes) if boxes else None
        common = []
        if seen["combined"]:  # one row for each task
            parts = [pickle.loads(r["body"]) for r in out.where("kind = 'combined'").select("body").collect()]
            common = [Message(None, None, functools.reduce(program.combine, parts))]

    fields = [c.strip().split(" ")[0] for c in schema.split(",")]

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for graph, body in zip(batch["topology"], batch["body"], strict=True):
                ctx = Context(pickle.loads(graph), step, conf, pickle.loads(body))
                program.wrapup(ctx)
                rows += ctx._rows
            yield pd.DataFrame(rows, columns=fields)

    log = metrics[0]
    for more in metrics[1:]:
        log = log.unionByName(more)
    return topology.join(state, "sgid").select("topology", "body").mapInPandas(wrap, schema), log, step


class CountVertices(SubgraphComputation):
    """Every subgraph learns the number of vertices of the graph."""

    combine = staticmethod(operator.add)

    def compute(self, ctx: Context, messages: list[Message]) -> None:
        if ctx.superstep == 0:
            ctx.send_to_all(len(ctx.graph.arcs))
        else:
            ctx.value = sum(m.payload for m in messages)
        ctx.vote_to_halt()


class SmallestSubgraph(SubgraphComputation):
    """Each subgraph's component: the smallest sgid that reaches it over remote arcs."""

    def compute(self, ctx: Context, messages: list[Message]) -> None:
        if ctx.superstep == 0:
            ctx.value = min([ctx.graph.sgid, *ctx.graph.neighbours])
            ctx.send_to_neighbours(ctx.value)
        else:
            least = min(m.payload for m in messages)
            if least < ctx.value:
                ctx.value = least
                ctx.send_to_neighbours(least)
        ctx.vote_to_halt()


class ShortestHops(SubgraphComputation):
    """Hops from the vertex conf["source"]; settles a subgraph before sending what improved."""

    def compute(self, ctx: Context, messages: list[Message]) -> None:
        dist = ctx.value or {}
        new: dict[int, int] = {}
        for m in messages:
            v, d = m.payload
            if d < min(dist.get(v, 1 << 60), new.get(v, 1 << 60)):
                new[v] = d
        if ctx.superstep == 0 and ctx.conf["source"] in ctx.graph.arcs:
            new[ctx.conf["source"]] = 0
        dist.update(new)
        remote: dict[int, int] = {}
        front = sorted(new, key=new.get)
        while front:
            later = []
            for v in front:
                for w, _ in ctx.graph.arcs[v]:
                    d = dist[v] + 1
                    if w in ctx.graph.arcs:
                        if d < dist.get(w, 1 << 60):
                            dist[w] = d
                            later.append(w)
                    else:
                        remote[w] = min(remote.get(w, 1 << 60), d)
            front = later
        for w, d in remote.items():
            ctx.send_to_vertex(w, (w, d))
        ctx.value = dist
        ctx.vote_to_halt()

    def wrapup(self, ctx: Context) -> None:
        for v, d in sorted((ctx.value or {}).items()):
            ctx.emit(v, d)
