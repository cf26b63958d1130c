"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, ASCII letters lower-cased.  Runs of
``least`` words of the benchmark items are the seeds.  A text is joined to the
items with which it shares seeds.  The words that shared seeds reach bound an
item's coverage; items are taken in order of that bound, and those whose bound is
below the best coverage so far are left out.  With the others the text is tiled:
the longest common run of unmarked words is found by running Karp-Rabin and
marked on both sides, again and again, down to ``least`` words, so passages in
another order, or broken up, count in full.  An item's coverage is the marked
share of its words.

Seeds go to the workers by broadcast, in blocks of at most ``BLOCK_WORDS``
benchmark words; a larger benchmark takes several passes over the texts, with
what was found written to the shared folder between them, so that one block at
a time is held.

Defined cases: null and empty texts and items have no words and cover nothing;
items with fewer words than a seed are one seed of all their words; null item
ids are kept apart and reported as null; repeated items count alike, the
smallest id is reported; ties of coverage go to the smallest id; an empty
benchmark covers nothing; columns with the names of the two added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shardloom.llm._spark import discard, ship, staged, without
from shardloom.llm._text import U64, buffer, mix, pieces, ranges, words
from shardloom.llm.toxicity import _DELIMITERS

LEAST = 4
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
_FACTOR = U64(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every run of k words."""
    with np.errstate(over="ignore"):
        out = h[: max(len(h) - k + 1, 0)].copy()
        for i in range(1, k):
            out = out * _FACTOR + h[i : len(h) - k + 1 + i]
    return mix(out)


def tile(item: list[int], text: list[int], least: int) -> int:
    """Words of the item that greedy tiling marks; -1 in the text is no word."""
    free_item, free_text = [True] * len(item), [t >= 0 for t in text]
    longest = held = 0
    for free in free_text:
        held = held + 1 if free else 0
        longest = max(longest, held)
    covered, size, mask = 0, min(len(item), longest), (1 << 61) - 1

    def rolled(values: list[int], free: list[bool], k: int) -> Iterator[tuple[int, int]]:
        """Start and Karp-Rabin hash of each run of k unmarked words."""
        lead, value, held = pow(1_000_003, k - 1, mask), 0, 0
        for i, v in enumerate(values):
            if not free[i]:
                value = held = 0
                continue
            if held == k:
                value = (value - values[i - k] % mask * lead) % mask
                held -= 1
            value = (value * 1_000_003 + v % mask) % mask
            held += 1
            if held == k:
                yield i - k + 1, value

    while size >= least:
        table: dict[int, list[int]] = {}
        for at, value in rolled(item, free_item, size):
            table.setdefault(value, []).append(at)
        if table:
            for at, value in list(rolled(text, free_text, size)):
                for start in table.get(value, ()):
                    if all(free_item[start : start + size]) and all(free_text[at : at + size]) and item[start : start + size] == text[at : at + size]:
                        free_item[start : start + size] = free_text[at : at + size] = [False] * size
                        covered += size
                        break
        size -= 1
    return covered


def _seed_block(ids: list, h: np.ndarray, rows: np.ndarray, least: int) -> tuple:
    """Sorted seeds with their item and place, and the items' words."""
    count = np.diff(rows)
    full = np.flatnonzero(count >= least)
    seeds = run_hashes(h, least)
    starts = ranges(rows[:-1][full], count[full] - least + 1)
    owner = np.repeat(full, count[full] - least + 1)
    seed, item, place = seeds[starts], owner, starts - rows[:-1][owner]
    order = np.argsort(seed, kind="stable")
    short = {}
    for k in range(1, least):
        own = np.flatnonzero(count == k)
        if len(own):  # items come in order of id, so the first of equal ones is the smallest
            short[k] = np.unique(run_hashes(h, k)[rows[:-1][own]], return_index=True)
            short[k] = short[k][0], own[short[k][1]]
    return seed[order], item[order], place[order], ids, h, rows, short


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, text_col: str = "text", names: tuple[str, str] = ("coverage", "item_id")) -> DataFrame:
    """The documents with the largest coverage of any item and, where that reaches the threshold, the item's id."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("words"))
    # counted before any of it is sent: each block holds at most BLOCK_WORDS words
    sized = items.select("item_id", "words", (F.floor(F.octet_length(F.coalesce("words", F.lit(""))) / 2) + 1).alias("n"))
    blocks = max(1, -(-int(sized.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    out = without(docs, names, (text_col,)).withColumns({names[0]: F.lit(0.0), names[1]: F.lit(None).cast("long")})
    schema = StructType([StructField(f.name, f.dataType) for f in out.schema.fields])
    last = None
    for b in range(blocks):
        got = sized.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).select("item_id", "words").orderBy(F.col("item_id").isNull(), "item_id").toArrow().combine_chunks()
        if got.num_rows:
            column = got["words"].combine_chunks() if isinstance(got["words"], pa.ChunkedArray) else got["words"]
            _, _, h, rows = words(*buffer(column), delimiters=_DELIMITERS)
            shared = spark.sparkContext.broadcast(_seed_block(got["item_id"].to_pylist(), h, rows, least))
            out = out.mapInArrow(_tiler(shared, text_col, names, least, threshold), schema)
            if b < blocks - 1:
                out = staged(out, "tiled")
                shared.destroy()
                if last is not None:
                    discard(spark, last)
                last = out
    return out


def _tiler(shared, text_col: str, names: tuple[str, str], least: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, item, place, ids, item_words, item_rows, short = shared.value
        likely = np.zeros(1 << 20, bool)
        likely[seed >> U64(44)] = True
        size = np.diff(item_rows)
        for part, data, offsets in pieces(batches, text_col):
            coverage, best = (part.column(part.schema.get_field_index(n)).to_pylist() for n in names)
            _, _, h, rows = words(data, offsets, delimiters=_DELIMITERS)

            def offer(r: int, share: float, name: int | None) -> None:
                if share > coverage[r] or share == coverage[r] and name is not None and share > 0 and (best[r] is None or name < best[r]):
                    coverage[r], best[r] = share, name if share >= threshold else None

            def located(k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Row and place of runs of k words within a row that are among the known."""
                runs = run_hashes(h, k)
                at = np.flatnonzero(likely[runs >> U64(44)]) if k == least else np.arange(len(runs))
                at = at[np.isin(runs[at], known)]
                row = np.searchsorted(rows, at, "right") - 1
                inside = at + k <= rows[row + 1]
                return row[inside], at[inside]

            for k, (known, of) in short.items():
                row, at = located(k, known)
                first = of[np.searchsorted(known, run_hashes(h, k)[at])]
                for r, i in sorted(set(zip(row.tolist(), first.tolist(), strict=True))):
                    offer(r, 1.0, ids[i])
            row, at = located(least, seed)
            runs = run_hashes(h, least)[at]
            lo, hi = np.searchsorted(seed, runs), np.searchsorted(seed, runs, "right")
            pair = ranges(lo, hi - lo)
            row, at = np.repeat(row, hi - lo), np.repeat(at, hi - lo)
            key = row * len(size) + item[pair]
            order = np.lexsort((at, key))
            key, at, spot = key[order], at[order], place[pair][order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            bounded: list[tuple[int, float, int, int, int]] = []
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist() if len(cuts) else [], strict=True):
                r, i = divmod(int(key[a]), len(size))
                # words of the item that shared seeds reach
                marked = np.zeros(size[i] + least, np.int64)
                marked[spot[a:b]] = 1
                reach = int((np.convolve(marked, np.ones(least, np.int64))[: size[i]] > 0).sum())
                bounded.append((r, -reach / int(size[i]), i, a, b))
            for r, bound, i, a, b in sorted(bounded):
                if -bound < coverage[r]:
                    continue
                near = np.unique(at[a:b])
                parts = np.split(near, np.flatnonzero(np.diff(near) > least) + 1)
                text: list[int] = []
                for p in parts:  # only words that lie in a common run can be marked
                    text += [-1, *_positive(h[p[0] : p[-1] + least])]
                offer(r, tile(_positive(item_words[item_rows[i] : item_rows[i + 1]]), text, least) / int(size[i]), ids[i])
            columns = {**{n: part.column(k) for k, n in enumerate(part.schema.names)}, names[0]: pa.array(coverage, pa.float64()), names[1]: pa.array(best, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _positive(h: np.ndarray) -> list[int]:
    return (h >> U64(1)).tolist()
