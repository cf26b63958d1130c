"""Exact removal of long repeated byte strings, by suffix arrays built with two-stage sorting.

A window is a string of ``length`` bytes.  A byte goes if a window over it also
starts anywhere else, in the same text or another.

1. Copies.  Texts are grouped by 128 bits of hash; texts that share the first 64
   only get another key.  A text that occurs twice goes whole (if it has a
   window); it stays in the search once, for the others.
2. Anchors.  Every window is assigned to its anchor, the leftmost of its
   ``gram``-byte strings with the smallest hash.  Equal windows have equal anchors,
   so only windows whose anchor occurs twice need a look.  Anchors are counted
   with partial aggregation; counts of the commonest ones are broadcast.
3. Segments.  The windows of one anchor occurrence are a segment of text, sent to
   the bucket of that anchor.  An anchor with more than ``HOT`` occurrences (a
   common line, in many contexts) is replaced by anchors of nearly a whole window,
   which split it by context.  Equal segments are combined before they are sent:
   all their windows are repeats, so their places are settled there and then, and
   one segment goes on for the comparison with others.
4. Suffix arrays.  The distinct segments of some buckets are joined into one text
   of at most ``CHUNK`` bytes.  Only suffixes smaller than their successors are
   sorted; all others are induced from them by one scan over the buckets of first
   bytes.  Then the common prefixes of neighbours show the windows that are
   repeated.  Sorting looks at ``length`` bytes, all that the question needs.
   A bucket whose distinct segments exceed ``CHUNK`` is not gathered: its windows
   are passed on one by one to buckets of their own hash, for a second pass.
5. The repeated windows of a text are merged into spans and cut out.

Matches never cross texts.  Defined cases: null and empty texts have 0 bytes,
no spans and the digest of nothing; texts shorter than a window lose nothing;
null and repeated ids are rows of their own; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm._spark import discard, ship, staged
from shardloom.llm._text import _BYTE, U64, mix, pieces, ranges

LENGTH = 200
GRAM = 64
#: Anchors with more occurrences are split by context.
HOT = 2048
HOT_MARGIN = 10
#: Segment bytes in one suffix array; windows looked at in one step of the scan; segment bytes that a task holds to combine equal ones.
CHUNK = 4 << 20
BLOCK = 1 << 20
COMBINE = 8 << 20
BROADCAST_ROWS = 200_000
_FACTOR = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at every position, by doubling."""
    with np.errstate(over="ignore"):
        part, size, power = _BYTE[data], 1, _FACTOR
        out, done = None, 0
        while True:
            if k & size:
                if out is None:
                    out, done = part, size
                else:
                    n = len(data) - done - size + 1
                    out = out[:n] * U64(power) + part[done : done + n]
                    done += size
            if size * 2 > k:
                break
            n = len(data) - 2 * size + 1
            part = part[:n] * U64(power) + part[size : size + n]
            size, power = 2 * size, power * power & ((1 << 64) - 1)
        return out


def anchors(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run of windows with one anchor.

    ``starts``: ascending starts of windows of ``length`` bytes within data.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    lo, hi = int(starts[0]), int(starts[-1]) + length
    raw = gram_hashes(data[lo:hi], k)
    low = (mix(raw) & ~U64(0xFFFFFFFF)) | np.arange(len(raw), dtype=U64)
    width, span = length - k + 1, 1
    best = low
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < width:
        rest = width - span
        best = np.minimum(best[: len(best) - rest], best[rest:])
    at = (best[starts - lo] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return starts[new], np.diff(np.append(new, len(starts))), mix(raw[at[new]])


def _window_blocks(offsets: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Starts of all windows of the rows, about BLOCK at a time."""
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    full = np.flatnonzero(count)
    if len(full):
        starts = ranges(offsets[:-1][full], count[full])
        for a in range(0, len(starts), BLOCK):
            yield starts[a : a + BLOCK]


def _anchor_rows(length: int, gram: int):
    """c1, start, run, anchor of every text; a text that one task meets again is left out there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data, offsets in pieces(batches, "text", 2 << 20):
            keys = part.column(part.schema.get_field_index("c1")).to_numpy()
            fresh = np.array([k not in seen and not seen.add(k) for k in keys.tolist()])
            for starts in _window_blocks(offsets, length):
                start, count, anchor = anchors(data, starts, length, gram)
                row = np.searchsorted(offsets, start, "right") - 1
                keep = fresh[row]
                row, start, count, anchor = row[keep], start[keep], count[keep], anchor[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array((start - offsets[row]).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64))], ["c1", "start", "run", "anchor"])
            if len(seen) > 1 << 20:
                seen.clear()

    return run


def _segments(length: int):
    """Segments of texts (key, text and the packed runs they are asked for), equal ones combined.

    A row with a segment: ``several`` if it is known to be repeated, else
    (c1, start) is its one place so far.  A row without: c1 loses size bytes at start.
    """
    size = pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], tuple[int, int] | None] = {}
        whole_spans: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = [(b, *(place or (0, 0)), 0, segment, place is None) for (b, segment), place in seen.items()]
            rows += [(c1 ^ lo, c1, lo, n, None, True) for c1, lo, n in whole_spans]
            for a in range(0, len(rows), 4096):
                bucket, c1, start, n, segment, several = zip(*rows[a : a + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(c1, pa.int64()), pa.array(start, pa.int64()), pa.array(n, size), pa.array(segment, pa.binary()), pa.array(several)], ["bucket", "c1", "start", "size", "segment", "several"])
            seen.clear()
            whole_spans.clear()
            held = 0

        for part, data, offsets in pieces(batches, "text", 2 << 20):
            keys = part.column(part.schema.get_field_index("c1")).to_pylist()
            asked, alone = (part.column(part.schema.get_field_index(c)) for c in ("runs", "alone"))
            for r in range(part.num_rows):
                text = data[offsets[r] : offsets[r + 1]]
                runs = np.array([(x["start"], x["run"], x["anchor"], x["hot"]) for x in asked[r].as_py()], np.int64).reshape(-1, 4)
                runs = runs[np.argsort(runs[:, 0])]
                hot = runs[runs[:, 3] == 1]
                start, count, bucket = (runs[runs[:, 3] == 0][:, i] for i in (0, 1, 2))
                if len(hot):
                    more = anchors(text, ranges(hot[:, 0], hot[:, 1]), length, length - HOT_MARGIN)
                    start, count, bucket = np.concatenate([start, more[0]]), np.concatenate([count, more[1]]), np.concatenate([bucket, more[2].view(np.int64)])
                whole, c1, once = text.tobytes(), keys[r], alone[r].as_py()
                for p, n, b in zip(start.tolist(), (count + length - 1).tolist(), bucket.tolist(), strict=True):
                    segment = whole[p : p + n]
                    held += _meet(seen, (b, segment), (c1, p) if once else None, whole_spans)
                    if held > COMBINE:
                        yield from flush()
        yield from flush()

    return run


def _meet(seen: dict, segment: tuple[int, bytes], place: tuple[int, int] | None, spans: list[tuple[int, int, int]]) -> int:
    """Note a place of a segment, None for several; of segments seen before all places are spans.  The bytes that this holds."""
    n = len(segment[1])
    if segment not in seen:
        seen[segment] = place
        return n + 64
    before = seen[segment]
    if before is not None:
        spans.append((*before, n))
        seen[segment] = None
    if place is not None:
        spans.append((*place, n))
    return 24


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` bytes at least, by two-stage sorting.

    A suffix is "up" if it is smaller than its successor.  Within the bucket of
    a first byte all others come before the up ones.  Up suffixes are sorted
    directly; a scan over the buckets in order then places each other suffix
    when its successor is passed.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    changes = np.flatnonzero(step)
    up = step[changes[np.searchsorted(changes, np.arange(n))]] > 0
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    order = np.empty(n, np.int64)

    raw = text.tobytes()
    direct = np.flatnonzero(up)
    second = text[np.minimum(direct + 1, n - 1)].astype(np.int64)
    pair = text[direct].astype(np.int64) << 8 | second
    direct = direct[np.argsort(pair, kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=1 << 16))])
    ups = np.bincount(text[up], minlength=256)
    for p in np.flatnonzero(np.diff(cuts) > 1):
        part = direct[cuts[p] : cuts[p + 1]].tolist()
        part.sort(key=lambda i: raw[i : i + depth])
        direct[cuts[p] : cuts[p + 1]] = part
    offset = np.cumsum(ups) - ups
    for c in np.flatnonzero(ups):
        order[ends[c] - ups[c] : ends[c]] = direct[offset[c] : offset[c] + ups[c]]

    head = begins.copy()

    def induce(passed: np.ndarray) -> None:
        before = passed[passed > 0] - 1
        before = before[~up[before]]
        if not len(before):
            return
        first = text[before]
        sort = np.argsort(first, kind="stable")
        first, before = first[sort].astype(np.int64), before[sort]
        count = np.bincount(first, minlength=256)
        order[head[first] + np.arange(len(first)) - (np.cumsum(count) - count)[first]] = before
        head[:] += count

    if not up[n - 1]:
        order[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
    for c in np.flatnonzero(sizes):
        done = begins[c]
        while done < head[c]:
            until = int(head[c])
            induce(order[done:until])
            done = until
        induce(order[ends[c] - ups[c] : ends[c]])
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Number of bytes, up to ``depth``, that the suffixes at a and b have in common; both have as many."""
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    out, live = np.full(len(a), depth, np.int64), np.arange(len(a))
    for at in range(0, depth, 8):
        other = eight[np.minimum(a[live] + at, len(eight) - 1)] != eight[np.minimum(b[live] + at, len(eight) - 1)]
        ends = other.any(1)
        out[live[ends]] = np.minimum(at + other[ends].argmax(1), depth)
        live = live[~ends]
        if not len(live):
            break
    return out


def repeated_windows(segments: list[bytes], several: np.ndarray, length: int) -> np.ndarray:
    """For the windows of all segments in turn: does the window occur again?  ``several``: segments that stand for more than one place."""
    sizes = np.array([len(s) for s in segments]) + 1
    runs = sizes - length
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    begins = np.cumsum(sizes) - sizes
    at = ranges(begins, runs)
    number = np.full(len(text), -1, np.int64)
    number[at] = np.arange(len(at))
    again = np.repeat(several, runs)
    order = suffix_array(text, length)
    order = order[number[order] >= 0]
    same = common_prefixes(text, order[:-1], order[1:], length) >= length
    again[number[order[:-1][same]]] = True
    again[number[order[1:][same]]] = True
    return again


def _repeats(length: int, chunk: int, overflow: bool = True):
    """c1, lo, hi: bytes of repeated windows; or, with a segment, a window of a bucket too large to be gathered.  Rows come sorted by bucket."""
    names = ["c1", "lo", "hi", "bucket", "segment", "several"]

    def pack(spans: list[tuple[int, int, int]], windows: list[tuple[int, int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(spans), 1 << 16):
            some = spans[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in some], pa.int64()) for i in range(3)], pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.bool_())], names)
        if windows:
            hashes = mix(gram_hashes(np.frombuffer(b"".join(w for _, _, w, _ in windows), np.uint8), length)[::length]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in windows], pa.int64()), pa.array([x[1] for x in windows], pa.int64()), pa.nulls(len(windows), pa.int64()), pa.array(hashes), pa.array([x[2] for x in windows], pa.binary()), pa.array([x[3] for x in windows])], names)

    def windows_of(segment: bytes, place: tuple[int, int] | None) -> list[tuple[int, int, bytes, bool]]:
        c1, start = place or (0, 0)
        return [(c1, start + i, segment[i : i + length], place is None) for i in range(len(segment) - length + 1)]

    def solve(held: dict[tuple[int, bytes], tuple[int, int] | None]) -> list[tuple[int, int, int]]:
        segments = [s for _, s in held]
        again = repeated_windows(segments, np.array([place is None for place in held.values()]), length)
        out: list[tuple[int, int, int]] = []
        done = 0
        for segment, place in zip(segments, held.values(), strict=True):
            run = len(segment) - length + 1
            if place is not None and len(hits := np.flatnonzero(again[done : done + run])):
                c1, start = place
                cut = np.flatnonzero(np.diff(hits) > length)
                first, last = hits[np.concatenate([[0], cut + 1])], hits[np.concatenate([cut, [len(hits) - 1]])]
                out += [(c1, start + lo, start + hi + length) for lo, hi in zip(first.tolist(), last.tolist(), strict=True)]
            done += run
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[int, int] | None] = {}  # whole buckets, then the one under way
        current, spilling, before, size = None, False, 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                spans, windows, whole = [], [], []
                for bucket, c1, start, n, segment, several in zip(*(c.to_pylist() for c in batch.slice(a, 2048).columns), strict=True):
                    if segment is None:
                        spans.append((c1, start, start + n))
                        continue
                    place = None if several else (c1, start)
                    if bucket != current:
                        current, spilling = bucket, False
                        if size >= chunk:
                            spans += solve(held)
                            held, size = {}, 0
                        before = len(held)
                    if spilling:
                        windows += windows_of(segment, place)
                    else:
                        size += _meet(held, (bucket, segment), place, whole)
                        if overflow and size > 2 * chunk:
                            if before:  # the buckets before this one fit
                                rest = list(held.items())[before:]
                                spans += solve(dict(list(held.items())[:before]))
                                held, before = dict(rest), 0
                                size = sum(len(s) + 64 for _, s in held)
                            if size > chunk:
                                spilling = True
                                for (_, s), p in held.items():
                                    windows += windows_of(s, p)
                                held, size = {}, 0
                    if len(windows) > 4096:
                        yield from pack([], windows)
                        windows = []
                yield from pack(spans + [(c1, lo, lo + n) for c1, lo, n in whole], windows)
        if held:
            yield from pack(solve(held), [])

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the two halves of the text's key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(5), text).alias("c2"))


def apart(rows: DataFrame, clashing: DataFrame | None) -> DataFrame:
    """The rows with other keys c1 for texts that share theirs with another text."""
    if clashing is None:
        return rows
    joined = rows.join(clashing, F.col("c1") == F.col("_c1"), "left")
    return joined.withColumn("c1", F.when(F.col("_c1").isNotNull(), F.xxhash64(F.lit(77), "c1", "c2")).otherwise(F.col("c1"))).drop("_c1")


def clashing_keys(described: DataFrame) -> DataFrame | None:
    """_c1: first halves of keys (c1, c2) that several texts share.  Of 64-bit hashes some are expected at 10^10 texts."""
    found = staged(described.groupBy("c1").agg(F.min("c2").alias("a"), F.max("c2").alias("b")).where("a <> b").select(F.col("c1").alias("_c1")), "clashing-keys")
    n = found.count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found


def _counted(found: DataFrame) -> DataFrame:
    """c1 and r (start, run, anchor, hot) of anchor occurrences whose anchor occurs again.

    Anchors with more occurrences than a quarter of an average task's rows are
    few for each task; their counts are broadcast, the others are joined by shuffle.
    """
    spark = found.sparkSession
    counts = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "suffix-counts")
    rows = found.count()
    bound = max(HOT, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    common = F.broadcast(counts.where(F.col("n") > bound))
    out = found.join(common.select("anchor"), "anchor", "left_anti").join(counts.where(F.col("n") <= bound), "anchor").unionByName(found.join(common, "anchor"))
    return out.select("c1", F.struct("start", "run", "anchor", (F.col("n") > HOT).cast("int").alias("hot")).alias("r"))


def repeated_spans(base: DataFrame, described: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """c1 and its removed spans (lo, hi), for texts that occur once; unmerged, staged."""
    spark = base.sparkSession
    found = staged(base.where(F.octet_length("text") >= length).select("c1", "text").mapInArrow(_anchor_rows(length, gram), "c1 bigint, start bigint, run int, anchor bigint"), "suffix-anchors")
    # a text several tasks met has its runs several times
    runs = _counted(found).groupBy("c1").agg(F.collect_set("r").alias("runs"))
    keeper = described.groupBy("c1").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies"))
    asked = staged(runs.join(keeper, "c1").select("c1", "runs", "keeper", (F.col("copies") == 1).alias("alone")), "suffix-asked")
    discard(spark, found)
    texts = base.join(asked, (base["c1"] == asked["c1"]) & base["doc_id"].eqNullSafe(asked["keeper"])).select(base["c1"], "text", "runs", "alone")
    cut = texts.mapInArrow(_segments(length), "bucket bigint, c1 bigint, start bigint, size int, segment binary, several boolean")
    kind = "c1 bigint, lo bigint, hi bigint, bucket bigint, segment binary, several boolean"
    first = staged(cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeats(length, CHUNK), kind), "suffix-spans")
    spans = first.where("segment IS NULL").select("c1", "lo", "hi")
    large = first.where("segment IS NOT NULL")
    if not large.isEmpty():
        windows = large.select("bucket", "c1", F.col("lo").alias("start"), F.lit(0).alias("size"), "segment", "several")
        second = staged(windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeats(length, CHUNK, False), kind), "suffix-spans")
        spans = spans.unionByName(second.select("c1", "lo", "hi"))
    discard(spark, asked)
    return spans


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        spans = [[{"lo": lo, "hi": hi} for lo, hi in merge([(x["lo"], x["hi"]) for x in row])] for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["c1", "spans"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in pieces(batches, "text"):
        keys, spans = part.column(part.schema.get_field_index("c1")), part.column(part.schema.get_field_index("spans"))
        removed, count, digest, kept_text = [], [], [], []
        for r in range(part.num_rows):
            whole = data[offsets[r] : offsets[r + 1]].tobytes()
            merged = merge([(x["lo"], x["hi"]) for x in spans[r].as_py()])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(whole[at:lo])
                at = hi
            kept = b"".join([*kept, whole[at:]])
            removed.append(len(whole) - len(kept))
            count.append(len(merged))
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept)
        yield pa.RecordBatch.from_arrays([keys, pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(kept_text, pa.binary())], ["c1", "n_removed", "n_spans", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``keep_bytes`` also kept, null where nothing was removed."""
    ship(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    described = staged(base.select("doc_id", "c1", "c2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-texts")
    clashing = clashing_keys(described)
    base, described = apart(base, clashing), apart(described, clashing)
    several = described.groupBy("c1", "c2").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("c1").alias("s1"), F.col("c2").alias("s2"), F.lit(True).alias("again"))
    several = staged(several, "suffix-several")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    found = repeated_spans(base, described, length, gram).groupBy("c1").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = staged(found.mapInArrow(_merged, "c1 bigint, spans array<struct<lo: bigint, hi: bigint>>"), "suffix-merged")
    texts, pieces_of = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    small = texts <= BROADCAST_ROWS and (pieces_of or 0) <= 2 * BROADCAST_ROWS
    chosen = F.broadcast(spans) if small else spans
    cut = base.select("c1", "text").join(chosen, "c1").mapInArrow(_cut_out, "c1 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    cut = staged(cut if keep_bytes else cut.drop("kept"), "suffix-cut").withColumnRenamed("c1", "of")
    out = described.join(several, (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2")), "left").join(cut, F.col("c1") == F.col("of"), "left")
    gone = F.col("again") & (F.col("n_bytes") >= length)
    pick = lambda whole, name, none: F.when(gone, whole).otherwise(F.coalesce(F.col(name), none))
    columns = ["doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")).alias("kept_sha256")]
    if keep_bytes:
        columns.append(F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)
