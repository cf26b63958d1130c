"""Exact Jaccard self-join of texts on word n-grams, with count-vector R-trees.

1. Copies.  Each text becomes its set of hashed n-grams; texts with the same
   set form one class, so copies are never paired.  A class is named by 64 bits;
   classes that share them and differ in another 64 get other names.
2. Order.  Any order of the n-grams keeps the next step exact; common ones are
   put last.  Common are those met several times within one task, the
   commonest ``HOT_LIMIT`` of them; the others are in order of their rarest
   word, by the counts of the commonest ``WORD_LIMIT`` words.  Both lists are
   bounded, so they may be broadcast; what they leave out changes the cost, not
   the result.
3. Prefixes.  Two classes at or above the threshold t share one of the first
   n - ceil(t n) + 1 n-grams in that order.  The smallest class that has an n-gram
   in its prefix is the hub of all others, and a hub's classes are a shard: pairs
   that share a prefix n-gram share a shard.  A shard beyond ``BLOCK`` classes, or
   ``BLOCK_GRAMS`` n-grams where whole sets are compared, is cut into blocks, and
   each pair of blocks is a cell of its own; others are one cell.  No cell holds
   more than two blocks, whatever the shard.
4. R-tree.  n-grams are hashed into groups and a class is the point of its
   counts by group.  The overlap of two sets is at most the sum of coordinate
   minima, and for a node of the tree that of the query with the node's upper
   corner.  Nodes and pairs whose bound is below the overlap they need go, and
   with them all classes that no pair is left for.
5. Verification.  The classes left fetch their texts.  The R-tree of a cell is
   searched again and pairs are compared set by set, but for those which links
   found in the cell have joined already.  So a cell gives fewer links than it
   has classes, whatever the number of its pairs, and components stay exact.

Links are joined into components by rounds of joins (``components``).

Defined cases: a text with fewer words than n has one n-gram, its whole
sequence; null and empty texts, and those without words, have none and link
with nothing; null ids are ignored as component ids unless a component has no
other; repeated rows are copies; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shardloom.llm._spark import discard, ship, spare, staged
from shardloom.llm._text import U64, distinct, mix, pieces, ranges, shingles, words
from shardloom.operators.fixpoint import components

GROUPS = 64
BLOCK, BLOCK_GRAMS = 4096, 1 << 20
#: Bytes of text that a task gathers before it compares the cells it has.
GATHER_BYTES = 16 << 20
LEAF = 64
#: An n-gram met so often within one task may be common; so many of these are kept.
HOT_LOCAL, HOT_LIMIT = 4, 1_000_000
WORD_LOCAL, WORD_LIMIT = 8, 1 << 17
#: Up to so many ids are broadcast to fetch texts, more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, rows = words(data, offsets)
    return distinct(*shingles(h, rows, n))


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return sums[rows[1:]] - sums[rows[:-1]]


def _class_keys(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set."""
    size = np.diff(rows).astype(U64)
    with np.errstate(over="ignore"):
        return mix(_sums(mix(values), rows) + size), mix(_sums(mix(values ^ U64(0xA5A5A5A5DEADBEEF)), rows) ^ size)


def _names(values: np.ndarray, rows: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """The class of each row's set; ``clashing``: first halves of keys that several classes share."""
    a, b = _class_keys(values, rows)
    return np.where(np.isin(a, clashing), mix(a ^ mix(b)), a) if len(clashing) else a


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Smallest overlap with which sets of n and m reach the Jaccard threshold num / den."""
    return -((-num * (n + m)) // (num + den))


def _describe(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "text"):
            values, rows = _sets(data, offsets, n)
            a, b = _class_keys(values, rows)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(np.diff(rows)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "n_shingles", "c1", "c2"])

    return run


class _Counter:
    """Counts of 64-bit values in bounded memory: beyond some millions those met once so far make room."""

    def __init__(self) -> None:
        self.values, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.held = 0

    def add(self, values: np.ndarray) -> None:
        self.new.append(values)
        self.held += len(values)
        if self.held > 1 << 20:
            self.fold()

    def fold(self) -> None:
        new = np.concatenate(self.new) if self.new else np.zeros(0, U64)
        new.sort()
        first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
        new, counts = new[first], np.diff(np.append(first, len(new)))
        at = np.searchsorted(self.values, new)
        known = np.zeros(len(new), bool)
        inside = at < len(self.values)
        known[inside] = self.values[at[inside]] == new[inside]
        self.counts[at[known]] += counts[known]
        self.values = np.insert(self.values, at[~known], new[~known])
        self.counts = np.insert(self.counts, at[~known], counts[~known])
        if len(self.values) > 1 << 21:
            self.values, self.counts = self.values[self.counts > 1], self.counts[self.counts > 1]
        self.new, self.held = [], 0

    def often(self, least: int, kind: int) -> pa.RecordBatch:
        self.fold()
        keep = self.counts >= least
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), kind, np.int8)), pa.array(self.values[keep].view(np.int64)), pa.array(self.counts[keep])], ["kind", "token", "n"])


def _common(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kind, token, n: n-grams (0) of several classes of this task and words (1) it met often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        grams, single = _Counter(), _Counter()
        for _, data, offsets in pieces(batches, "text"):
            _, _, h, rows = words(data, offsets)
            single.add(h)
            values, rows = distinct(*shingles(h, rows, n))
            a, _ = _class_keys(values, rows)
            new = np.array([r for r, k in enumerate(a.tolist()) if not (k in seen or seen.add(k))], np.int64)
            grams.add(values[ranges(rows[:-1][new], np.diff(rows)[new])])
        yield grams.often(HOT_LOCAL, 0)
        yield single.often(WORD_LOCAL, 1)

    return run


def _word_levels(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of 2^20 slots with a word and the logarithm of its count; of words that share one the commonest has it."""
    order = np.lexsort((hashes, counts))
    known, level = np.zeros(1 << 20, U64), np.zeros(1 << 20, np.int8)
    slot = (hashes[order] >> U64(44)).astype(np.int64)
    known[slot] = hashes[order]
    level[slot] = np.minimum(np.log2(counts[order]) + 1, 62).astype(np.int8)
    return known, level


def _prefixes(n: int, num: int, den: int, shared, clashing: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known, level = shared.value
        likely = np.zeros(1 << 20, bool)
        likely[common >> U64(44)] = True
        for _, data, offsets in pieces(batches, "text"):
            _, _, h, rows = words(data, offsets)
            slot = (h >> U64(44)).astype(np.int64)
            own = np.where(known[slot] == h, level[slot], 0).astype(np.int8)
            values, first = shingles(h, rows, n)
            rank = np.zeros(len(values), np.int8)
            long = np.flatnonzero(np.diff(rows) >= n)
            at, to = ranges(rows[:-1][long], np.diff(first)[long]), ranges(first[:-1][long], np.diff(first)[long])
            if len(at):
                rank[to] = np.minimum.reduce([own[at + i] for i in range(n)])
            maybe = np.flatnonzero(likely[values >> U64(44)])
            rank[maybe[np.isin(values[maybe], common)]] = 63
            size, token, cls = [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                order = a + np.argsort(values[a:b])
                some = values[order]
                keep = np.ones(b - a, bool)
                keep[1:] = some[1:] != some[:-1]
                order, some = order[keep], some[keep]
                key = _names(some, np.array([0, len(some)]), clashing)
                take = len(some) - least_overlap_alone(len(some), num, den) + 1 if len(some) else 0
                token.append(some[np.argsort(rank[order], kind="stable")[:take]])
                size.append(take)
                cls.append(key[0])
            token = np.concatenate(token) if token else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.repeat(np.array(cls, U64), size).view(np.int64))], ["token", "c1"])

    return run


def least_overlap_alone(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap of a set of n with any set at the threshold."""
    return -((-num * n) // den)


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub, c1 of n-grams that several classes have; rows come sorted by token and class, so a token's first class is the hub."""
    last_token, last_hub = None, None
    for batch in batches:
        token, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(token):
            continue
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        hub = cls[first]
        if last_token == token[0]:
            hub = np.concatenate([[last_hub], hub[1:]])
        last_token, last_hub = token[-1], hub[-1]
        hub = np.repeat(hub, np.diff(np.append(first, len(token))))
        other = cls != hub
        if other.any():
            pairs = np.unique(np.stack([np.concatenate([hub[other], hub[other]]), np.concatenate([cls[other], hub[other]])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["hub", "c1"])


def _points(n: int, clashing: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in pieces(batches, "text"):
            values, rows = _sets(data, offsets, n)
            a = _names(values, rows, clashing)
            owner = np.repeat(np.arange(len(a)), np.diff(rows))
            count = np.bincount(owner * GROUPS + (mix(values) % U64(GROUPS)).astype(np.int64), minlength=len(a) * GROUPS).astype(np.int32)
            packed = [count[i : i + GROUPS].tobytes() for i in range(0, len(count), GROUPS)]
            keep = np.flatnonzero(np.diff(rows))
            yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array([packed[i] for i in keep], pa.binary())], ["c1", "point"])

    return run


class CountTree:
    """R-tree over count vectors, packed bottom-up in order of size; a node keeps its upper corner, its sizes and its component if it has but one."""

    def __init__(self, points: np.ndarray, comp: np.ndarray, leaf: int = LEAF) -> None:
        self.size = points.sum(1)
        self.order = np.lexsort((*points.T[:4], self.size))
        self.points, self.comp, self.leaf = points[self.order], comp[self.order], leaf
        own = self.size[self.order]
        level, width = (self.points, own, own, self.comp, self.comp), leaf
        self.levels = []
        while not self.levels or len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), width)
            level = tuple(f.reduceat(x, starts) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level, strict=True))
            self.levels.append(level)
            width = 8

    def pairs(self, queries: np.ndarray, comp: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of queries and points of different components whose bound allows the threshold, some queries at a time."""
        size, own = queries.sum(1), self.size[self.order]
        for a in range(0, len(queries), 64):
            q, n, c = queries[a : a + 64], size[a : a + 64], comp[a : a + 64]
            row, node = np.repeat(np.arange(len(q)), len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), len(q))
            for depth in range(len(self.levels) - 1, -1, -1):
                row, node = _fit(q, n, c, row, node, *self.levels[depth], num, den)
                width, total = (self.leaf, len(self.points)) if depth == 0 else (8, len(self.levels[depth - 1][0]))
                count = np.minimum(width, total - node * width)
                row, node = np.repeat(row, count), ranges(node * width, count)
            row, node = _fit(q, n, c, row, node, self.points, own, own, self.comp, self.comp, num, den)
            yield row + a, self.order[node]


def _fit(q: np.ndarray, n: np.ndarray, c: np.ndarray, row: np.ndarray, node: np.ndarray, corner: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    sized = (den * high[node] >= num * n[row]) & (num * low[node] <= den * n[row]) & ((first[node] != c[row]) | (last[node] != c[row]))
    row, node = row[sized], node[sized]
    keep = np.zeros(len(row), bool)
    for a in range(0, len(row), 1 << 15):
        r, k = row[a : a + (1 << 15)], node[a : a + (1 << 15)]
        keep[a : a + (1 << 15)] = np.minimum(q[r], corner[k]).sum(1) >= least_overlap(n[r], low[k], num, den)
    return row[keep], node[keep]


def _cells(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[pa.Table]:
    """Whole cells, about so many rows or GATHER_BYTES together, of rows sorted by cell."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for whole in batches:
        # a batch may hold many long texts: it is taken in parts
        step = max(1, min(whole.num_rows, int(whole.num_rows * (GATHER_BYTES / 4) / max(whole.nbytes, 1))))
        for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.get_total_buffer_size() * batch.num_rows / max(whole.num_rows, 1)
            if rows < least and size < GATHER_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cell = table["cell"].to_numpy()
            done = int(np.searchsorted(cell, cell[-1]))
            if done:
                yield table.slice(0, done)
            held, rows = table.slice(done).combine_chunks().to_batches(), table.num_rows - done
            least, size = max(least, rows + (1 << 12)), size * rows / table.num_rows if done else 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(key: np.ndarray) -> Iterator[tuple[int, int]]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    yield from zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to ask and rows to search: of a cell of two blocks one each, else all."""
    if (side > 0).any():
        return np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    return np.arange(len(side)), np.arange(len(side))


def _survivors(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """hub, c1 of classes for which the R-tree of a cell leaves a partner."""

    def pairs(first: np.ndarray, size: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that are less than one leaf: all at once."""
        at = ranges(first, size)
        count = np.repeat(size, size) - 1 - (at - np.repeat(first, size))
        i, j = np.repeat(at, count), ranges(at + 1, count)
        n = points.sum(1)
        keep = (den * n[j] >= num * n[i]) & (den * n[i] >= num * n[j])
        i, j = i[keep], j[keep]
        keep = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            keep[a : a + (1 << 15)] = np.minimum(points[x], points[y]).sum(1) >= least_overlap(n[x], n[y], num, den)
        return i[keep], j[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            cell, side, hub, cls = (table[c].to_numpy() for c in ("cell", "side", "hub", "c1"))
            points = np.frombuffer(b"".join(table["point"].to_pylist()), np.int32).reshape(-1, GROUPS)
            live = np.zeros(len(cell), bool)
            bounds = np.array(list(_bounds(cell)))
            few = (bounds[:, 1] - bounds[:, 0] <= 8) & (side[bounds[:, 0]] == 0)
            if few.any():
                i, j = pairs(bounds[few, 0], bounds[few, 1] - bounds[few, 0], points)
                live[i] = live[j] = True
            for a, b in bounds[~few]:
                left, right = (a + x for x in _sides(side[a:b]))
                if len(left) and len(right):
                    tree = CountTree(points[right], np.arange(len(right)))
                    own = np.searchsorted(right, left)
                    for i, j in tree.pairs(points[left], np.where(side[left] == 0, own, -1), num, den):
                        live[left[i]] = live[right[j]] = True
            yield pa.RecordBatch.from_arrays([pa.array(hub[live]), pa.array(cls[live])], ["hub", "c1"])

    return run


def _links(n: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b: links that join the components within each cell."""

    def solve(side: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        rows = np.concatenate([[0], np.cumsum(size)])
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        points = np.bincount(owner * GROUPS + (mix(values) % U64(GROUPS)).astype(np.int64)[at], minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
        root = np.arange(len(sets))
        mark = np.zeros(len(values), bool)
        left, right = _sides(side)
        if not len(left) or not len(right):
            return
        tree = CountTree(points[right], np.arange(len(right)))
        own = np.searchsorted(right, left)
        for i, j in tree.pairs(points[left], np.where(side[left] == 0, own, -1), num, den):
            i, j = left[i], right[j]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for a, b in _bounds(i):
                x, others = i[a], j[a:b]
                if side[x] == 0:
                    others = others[others > x]
                others = others[root[others] != root[x]]
                if not len(others):
                    continue
                mark[at[rows[x] : rows[x + 1]]] = True
                for c in range(0, len(others), 512):
                    some = others[c : c + 512]
                    some = some[root[some] != root[x]]
                    if not len(some):
                        continue
                    hits = np.add.reduceat(mark[at[ranges(rows[some], size[some])]].astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
                    for y in some[den * hits >= num * (size[x] + size[some] - hits)]:
                        if root[y] != root[x]:
                            root[root == root[y]] = root[x]
                            yield int(x), int(y)
                mark[at[rows[x] : rows[x + 1]]] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches, 1 << 10):
            cell, side, cls = (table[c].to_numpy() for c in ("cell", "side", "c1"))
            for a, b in _bounds(cell):
                sets: list[np.ndarray] = []
                for _, data, offsets in pieces([pa.RecordBatch.from_arrays([table["text"].slice(a, b - a).combine_chunks()], ["t"])], "t"):
                    values, rows = _sets(data, offsets, n)
                    sets += [values[p:q] for p, q in zip(rows[:-1], rows[1:], strict=True)]
                found = list(solve(side[a:b], sets))
                if found:
                    i, j = np.array(found).T + a
                    yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j])], ["a", "b"])

    return run


def _dealt(members: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Members of shards (hub, c1) with the cell each row goes to, and its side there: 0 for whole shards and single blocks.

    ``weights``: c1 and its number of n-grams, where blocks are also bounded by these.
    """
    blocks = F.ceil(F.count("*") / BLOCK)
    if weights is not None:
        members = members.join(weights, "c1")
        blocks = F.greatest(blocks, F.ceil(F.sum("grams") / BLOCK_GRAMS))
    sizes = staged(members.groupBy("hub").agg(blocks.cast("int").alias("blocks")).where("blocks > 1"), "ngram-large")
    # shards of several blocks are few; counted before they are sent
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    rows = members.join(sizes, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c1"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("tinyint")
    return rows.select("hub", "c1", F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"))


def classes(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """doc_id, n_shingles, the class of every document and the two halves of its key, staged; and first halves that several classes share."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = staged(base.mapInArrow(_describe(n), "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint"), "ngram-classes")
    # of 64-bit hashes a handful is expected at 10^10 classes
    found = described.groupBy("c1").agg(F.min("c2").alias("low"), F.max("c2").alias("high")).where("low <> high").select("c1").toArrow().combine_chunks()
    clashing = found["c1"].to_numpy().view(U64)
    if not len(clashing):
        return described.withColumn("class", F.col("c1")), clashing

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(U64) for i in (2, 3))
            own = np.where(np.isin(a, clashing), mix(a ^ mix(b)), a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.view(np.int64))], [*batch.schema.names, "class"])

    return staged(described.mapInArrow(named, "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, class bigint"), "ngram-classes"), clashing


def links(docs: DataFrame, described: DataFrame, clashing: np.ndarray, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: classes at or above num / den, enough of them to join every component; staged."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    often = staged(base.select("text").mapInArrow(_common(n), "kind tinyint, token bigint, n bigint").groupBy("kind", "token").agg(F.sum("n").alias("n")), "ngram-common")

    def commonest(kind: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        got = often.where(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(limit).toArrow().combine_chunks()
        return got["token"].to_numpy().view(U64), got["n"].to_numpy()

    hot, (single, counts) = np.sort(commonest(0, HOT_LIMIT)[0]), commonest(1, WORD_LIMIT)
    shared = spark.sparkContext.broadcast((hot, *_word_levels(single, counts)))
    entries = base.select("text").mapInArrow(_prefixes(n, num, den, shared, clashing), "token bigint, c1 bigint")
    met = staged(entries.repartition("token").sortWithinPartitions("token", "c1").mapInArrow(_hubs, "hub bigint, c1 bigint").distinct(), "ngram-shards")
    points = base.select("text").mapInArrow(_points(n, clashing), "c1 bigint, point binary").groupBy("c1").agg(F.min("point").alias("point"))
    located = _dealt(met).join(points, "c1").select("cell", "side", "hub", "c1", "point")
    left = located.repartition("cell").sortWithinPartitions("cell", "c1").mapInArrow(_survivors(num, den), "hub bigint, c1 bigint")
    left = staged(left.distinct(), "ngram-survivors")
    # one document for each class that is left
    keeper = described.groupBy(F.col("class").alias("c1")).agg(F.min("doc_id").alias("doc_id"))
    texts = _texts(base, keeper.join(left.select("c1").distinct(), "c1", "left_semi"), n, clashing)
    weights = described.groupBy(F.col("class").alias("c1")).agg(F.max("n_shingles").alias("grams"))
    compared = _dealt(left, weights).join(texts, "c1").select("cell", "side", "c1", "text")
    found = staged(compared.repartition("cell").sortWithinPartitions("cell", "c1").mapInArrow(_links(n, num, den), "a bigint, b bigint").distinct(), "ngram-links")
    discard(spark, often, met, left)
    shared.unpersist()
    return found


def _texts(base: DataFrame, ids: DataFrame, n: int, clashing: np.ndarray) -> DataFrame:
    """c1 and a text of each class whose document is asked for; documents that share an id are told apart by their class."""
    ids = staged(ids, "ngram-ids")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    found = base.join(chosen.select(F.col("doc_id").alias("want"), F.col("c1").alias("of")), F.col("doc_id").eqNullSafe(F.col("want")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "text"):
            a = _names(*_sets(data, offsets, n), clashing)
            keep = pa.array(a.view(np.int64) == part.column(part.schema.get_field_index("of")).to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).filter(keep) for c in ("of", "text")], ["c1", "text"])

    return found.select("of", "text").mapInArrow(own, "c1 bigint, text string").dropDuplicates(["c1"])


def ngram_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), the two halves of the class key, and the component's smallest class."""
    described, clashing = classes(docs, n, id_col, text_col)
    pairs = links(docs, described, clashing, n, num, den, id_col, text_col)
    group = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # classes without words stay apart: each of their rows is a component of its own
    smallest = described.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    labelled = smallest.join(group.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_least"))
    named = labelled.join(least, "component").select(F.col("class").alias("of"), "component_least", "component")
    out = described.join(named, (F.col("class") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_least")).otherwise(F.col("doc_id")).alias("component_id"), "c1", "c2", "component")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each component: the row with the smallest id stays.  Texts without words stay."""
    spark = docs.sparkSession
    c1, c2, of, g1, g2, again = spare(docs, "_c1", "_c2", "_id", "_g1", "_g2", "_again")
    rows = ngram_components(docs, n, num, den, id_col, text_col).where("n_shingles > 0")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c1", "c2")
    keys = staged(rows.groupBy("doc_id", "c1", "c2").agg(F.min("component").alias("component"), F.count("*").alias("rows")), "ngram-keys")
    keep = keys.groupBy("component").agg(F.min(mine).alias("kept")).select(F.col("kept.doc_id").alias("k"), F.col("kept.c1").alias("k1"), F.col("kept.c2").alias("k2"), F.lit(True).alias("stays"))
    # of rows that repeat an id and a class, one stays: they are set apart by number
    same = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))
    marked = staged(keys.join(keep, same, "left").select("doc_id", "c1", "c2", "rows", F.coalesce("stays", F.lit(False)).alias("stays")), "ngram-kept")
    gone = marked.where("NOT stays OR rows > 1").select(F.col("doc_id").alias(of), F.col("c1").alias(g1), F.col("c2").alias(g2), (F.col("stays") & (F.col("rows") > 1)).alias(again))
    listed = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    columns, schema = docs.columns, StructType([*docs.schema.fields, StructField(c1, LongType()), StructField(c2, LongType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, text_col):
            a, b = _class_keys(*_sets(data, offsets, n))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], [*columns, c1, c2])

    out = docs.mapInArrow(keyed, schema).join(listed, (F.col(c1) == F.col(g1)) & (F.col(c2) == F.col(g2)) & F.col(id_col).eqNullSafe(F.col(of)), "left")
    kept = out.where(F.col(g1).isNull()).select(*columns)
    discard(spark, keys)
    if marked.where("stays AND rows > 1").isEmpty():
        return kept
    return kept.unionByName(out.where(again).dropDuplicates([c1, c2, of]).select(*columns))
