"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, read through memory maps.

Tokens of a text are its words and then one end; before them stand ``order`` - 1
start marks.  Counting takes two passes.  The first gathers (word hash, count)
into sorted hash arrays, one file for each range of hashes; the rank of a hash in
them is the word's number.  The second gathers n-grams as rows of numbers, combined
in each task and sent as packed sorted columns, into parts by hash of the history
(all words but the last).  A part's distinct n-grams give the counts of that order
and the rows of the next lower one, whose counts are the numbers of different words
before them (or the counts themselves, where they begin with a start mark).  Each
part of each order is a file of sorted n-gram hashes with counts and of sorted
history hashes with totals and the numbers of n-grams counted once, twice, more
often.  The hashes have 64 bits; words and n-grams that share one count as one.

Files are in the shared folder; workers map the ones they read into memory, so
a model of any size costs them no heap.  Only a manifest of files and a few
sums come to the driver: one name for each ``TOKENS_PER_FILE`` tokens and order,
and one for each ``BYTES_PER_RANGE`` of text.  A task that is run again writes other
file names, and only names in the committed manifest are read.

  p(w | h) = max(c(h w) - D(c), 0) / c(h) + g(h) p(w | h without its first word)
  p1(w)    = max(N(w) - D'(N), 0) / N + g' / (V + 1)

with three discounts for counts of 1, 2 and more in each order; N(w) is the
number of different words before w.  A word never seen has p1 = g' / (V + 1),
a history never seen leaves the chance to the shorter one.

Defined cases: null and empty texts are an end only; null ids are in the
training part; with nothing to train on every token has the chance 1;
repeated rows count as often as they occur; an empty table gives an empty result;
columns with the names of those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from shardloom.llm._files import load, save
from shardloom.llm._spark import discard, remove, ship, staged, without, workspace
from shardloom.llm._text import U64, mix, pieces, words

END = U64(0x2545F4914F6CDD1D)
ORDER = 2
#: Tokens for each file of n-grams, about; bytes of text for each range of word hashes, and the fewest ranges, as a power of 2.
TOKENS_PER_FILE, BYTES_PER_RANGE, LEAST_BITS = 2_000_000, 1 << 28, 5
TASK_TOKENS = 6_000_000
SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
_FACTOR = U64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each row's words, and the rows' borders."""
    _, _, h, rows = words(data, offsets)
    n = len(rows) - 1
    out = np.empty(len(h) + n, U64)
    borders = rows + np.arange(n + 1)
    ends = borders[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = h, END
    return out, borders


def _keys(columns: np.ndarray) -> np.ndarray | None:
    """Rows as one number each, in their order, if 64 bits hold them."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 64:
        return None
    key = columns[0]
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key = (key << U64(b) if b < 64 else key * U64(0)) | c
    return key


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and where in it a new one begins; columns: one array for each place of the n-gram."""
    if not columns.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = columns[0] if len(columns) == 1 else _keys(columns)
    if key is not None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    order = np.lexsort(columns[::-1])
    some = columns[:, order]
    return order, np.flatnonzero(np.concatenate([[True], (some[:, 1:] != some[:, :-1]).any(0)]))


def _fold(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order with the sums of their counts."""
    order, first = _distinct(columns)
    if not len(first):
        return columns, counts
    return columns[:, order[first]], np.add.reduceat(counts[order], first)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(columns: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted rows as differences, byte plane by byte plane, then counts; compressed."""
    with np.errstate(over="ignore"):
        body = b"".join(_planes(np.diff(c, prepend=U64(0))) for c in columns) + _planes(counts.astype(U64))
    return np.int64(columns.shape[1]).tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:]), np.uint8).reshape(-1, 8, n)
    values = np.ascontiguousarray(body.transpose(0, 2, 1)).view(U64)[:, :, 0]
    return np.cumsum(values[:-1], axis=1, dtype=U64), values[-1].astype(np.int64)


def _by_part(columns: np.ndarray, counts: np.ndarray, part: np.ndarray) -> list[tuple[int, bytes]]:
    """Sorted rows packed by part."""
    if not len(part):
        return []
    if (part[1:] < part[:-1]).any():
        order = np.argsort(part, kind="stable")
        columns, counts, part = columns[:, order], counts[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [(int(part[a]), _pack(columns[:, a:b], counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]


def _combine(produce: Callable[[np.ndarray, np.ndarray], np.ndarray], part_of: Callable[[np.ndarray], np.ndarray]):
    """Map side of a count: rows of a task combined and sent as packed columns for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = new = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, new
            if held:
                columns, counts = _fold(np.concatenate([c for c, _ in held], axis=1), np.concatenate([n for _, n in held]))
                rows = _by_part(columns, counts, part_of(columns))
                held, size, new = [], 0, 0
                for i in range(0, len(rows), 16):
                    some = rows[i : i + 16]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int64()), pa.array([b for _, b in some], pa.binary())], ["part", "packed"])

        for _, data, offsets in pieces(batches, "text"):
            columns = produce(data, offsets)
            held.append(_fold(columns, np.ones(columns.shape[1], np.int64)))
            new += held[-1][0].shape[1]
            if new > max(1 << 20, size // 2):
                held = [_fold(np.concatenate([c for c, _ in held], axis=1), np.concatenate([n for _, n in held]))]
                size, new = held[0][0].shape[1], 0
                if size > TASK_TOKENS:
                    yield from flush()
        yield from flush()

    return run


def _gather(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = [_unpack(raw) for raw in group["packed"].to_pylist()]
    return _fold(np.concatenate([c for c, _ in got], axis=1), np.concatenate([n for _, n in got]))


def _chain(columns: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of numbers."""
    out = np.full(columns.shape[1], 7, U64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = mix(out * _FACTOR + c)
    return out


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash, of so many."""
    return ((hashes >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


@dataclass(frozen=True)
class Level:
    """n-grams of one order: the file of each part, and the discounts."""

    files: dict[int, str]
    discounts: tuple[float, float, float]


@dataclass(frozen=True)
class KneserNey:
    """Names of the files and what few numbers the formulas need besides."""

    folder: str
    order: int
    bits: int
    word_files: list[tuple[int, str, int]]
    n_words: int
    n_tokens: int
    parts: int
    levels: dict[int, Level]
    unigram_files: dict[int, str]
    lower: tuple[float, float, float]
    lower_total: int
    lower_rest: float

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of words given as sorted distinct hashes; number -1 for unknown ones."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes >> U64(64 - self.bits)).astype(np.int64)
        before = 0
        for p, name, size in self.word_files:
            a, b = np.searchsorted(part, [p, p + 1])
            if b > a:
                known = load(self.folder, name, 0)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), size - 1)
                hit = known[at] == hashes[a:b]
                number[a:b] = np.where(hit, before + at, -1)
                count[a:b] = np.where(hit, load(self.folder, name, 1)[at], 0)
            before += size
        return number, count

    def grams(self, number: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The n-gram that ends at each token: number n_words marks the start of a text, the next one an unknown word."""
        number = np.where(number < 0, self.n_words + 1, number).astype(U64)
        place = np.arange(len(number)) - np.repeat(borders[:-1], np.diff(borders))
        out = np.empty((self.order, len(number)), U64)
        for back in range(self.order):
            row = out[self.order - 1 - back]
            row[:] = self.n_words
            inside = place >= back
            row[inside] = number[np.flatnonzero(inside) - back]
        return out

    def part_of(self, columns: np.ndarray) -> np.ndarray:
        return _share(_chain(columns[:-1]), self.parts)

    def _range(self, number: np.ndarray) -> np.ndarray:
        """File of a word's N(w)."""
        return number * self.parts // max(self.n_words, 1)

    def _first(self, part: int) -> int:
        return -(-part * self.n_words // self.parts)

    def continuation(self, number: np.ndarray) -> np.ndarray:
        """p1 of words by number, beyond the known ones of unknown ones."""
        out = np.full(len(number), self.lower_rest / (self.n_words + 1))
        part = np.where(number < self.n_words, self._range(number), -1)
        for p in np.unique(part[part >= 0]).tolist():
            at = np.flatnonzero(part == p)
            n = np.asarray(load(self.folder, self.unigram_files[p], 0)[number[at] - self._first(p)], float)
            cut = np.choose(np.minimum(n, 3).astype(int), [0.0, *self.lower])
            out[at] += np.maximum(n - cut, 0) / max(self.lower_total, 1)
        return out

    def chances(self, columns: np.ndarray) -> np.ndarray:
        """p of the last word of each distinct n-gram after the others."""
        word, back = np.unique(columns[-1].astype(np.int64), return_inverse=True)
        p = self.continuation(word)[back]
        for order in range(2, self.order + 1):
            level, some = self.levels[order], columns[-order:]
            history = _chain(some[:-1])
            with np.errstate(over="ignore"):
                key = mix(history * _FACTOR + some[-1])
            part = _share(history, self.parts)
            by_part = np.lexsort((key, part))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[by_part]) > 0])) if len(part) else []
            for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True) if len(part) else ():
                at = by_part[a:b]
                name = level.files.get(int(part[at[0]]))
                if name is None:
                    continue
                known, counts, histories, total, kinds = (load(self.folder, name, i) for i in range(5))
                found = np.minimum(np.searchsorted(histories, history[at]), len(histories) - 1)
                seen = histories[found] == history[at]
                at, found = at[seen], found[seen]
                sums, kept = np.asarray(total[found], float), np.asarray(kinds[found], float) @ np.array(level.discounts)
                spot = np.minimum(np.searchsorted(known, key[at]), len(known) - 1)
                c = np.where(known[spot] == key[at], counts[spot], 0).astype(float)
                cut = np.choose(np.minimum(c, 3).astype(int), [0.0, *level.discounts])
                p[at] = np.maximum(c - cut, 0) / sums + kept / sums * p[at]
        return p


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(out, 1))


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts


def _save_level(model: KneserNey, order: int):
    """Write a part of an order; its name and how many n-grams have counts 1 to 4, and the rows of the next lower order."""

    def run(group: pa.Table) -> pa.Table:
        columns, counts = _gather(group)
        history = _chain(columns[:-1])
        with np.errstate(over="ignore"):
            key = mix(history * _FACTOR + columns[-1])
        by_key, by_history = np.argsort(key), np.argsort(history, kind="stable")
        own, first = np.unique(history[by_history], return_index=True)
        sums = np.add.reduceat(counts[by_history], first)
        kinds = np.stack([np.add.reduceat((np.minimum(counts, 3) == k)[by_history].astype(np.int64), first) for k in (1, 2, 3)], axis=1)
        name = save(model.folder, key[by_key], _small(counts[by_key]), own, _small(sums), _small(kinds))
        # different words before the rest of the n-gram; after a start mark the counts themselves
        shorter, more = _fold(columns[1:], np.where(columns[1] == model.n_words, counts, 1))
        part = model.part_of(shorter) if order > 2 else model._range(shorter[0].astype(np.int64))
        packed = _by_part(shorter, more, part)
        rows, n = len(packed), [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        zeros = [0] * (rows - 1)
        return pa.table({"part": pa.array([group["part"][0].as_py()] * rows, pa.int64()), "name": [name] * rows, "of": pa.array([p for p, _ in packed], pa.int64()), "packed": pa.array([b for _, b in packed], pa.binary()), **{f"n{i}": pa.array([n[i - 1], *zeros], pa.int64()) for i in (1, 2, 3, 4)}})

    return run


def fit_kneser_ney(train: DataFrame, order: int = ORDER, text_col: str = "text") -> KneserNey:
    """Count all texts of a table and write the model to the shared folder, where it stays until ``discard_model``."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = train.sparkSession
    ship(spark)
    folder = workspace(spark, "ngram-model")
    texts = train.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (size // BYTES_PER_RANGE).bit_length())

    def save_words(group: pa.Table) -> pa.Table:
        columns, counts = _gather(group)
        return pa.table({"part": pa.array([group["part"][0].as_py()]), "name": [save(folder, columns[0], counts)], "size": [columns.shape[1]], "total": [int(counts.sum())]})

    found = texts.mapInArrow(_combine(lambda d, o: tokens(d, o)[0][None, :], lambda c: (c[0] >> U64(64 - bits)).astype(np.int64)), "part bigint, packed binary")
    listed = staged(found.groupBy("part").applyInArrow(save_words, "part bigint, name string, size bigint, total bigint"), "ngram-words")
    word_files = sorted(map(tuple, listed.collect()))
    n_words, n_tokens = sum(x[2] for x in word_files), sum(x[3] for x in word_files)
    model = KneserNey(folder, order, bits, [x[:3] for x in word_files], n_words, n_tokens, max(8, n_tokens // TOKENS_PER_FILE), {}, {}, (0.5,) * 3, 0, 1.0)
    shared = spark.sparkContext.broadcast(model)

    def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        number, _, borders = _numbered(shared.value, data, offsets)
        return shared.value.grams(number, borders)

    rows = texts.mapInArrow(_combine(grams, lambda c: shared.value.part_of(c)), "part bigint, packed binary")
    levels, above = {}, [listed]
    for m in range(order, 1, -1):
        kind = "part bigint, name string, of bigint, packed binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint"
        level = staged(rows.groupBy("part").applyInArrow(_save_level(model, m), kind), "ngram-level")
        counted = level.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in (1, 2, 3, 4)]).first()
        levels[m] = Level({r["part"]: r["name"] for r in level.select("part", "name").distinct().collect()}, discounts(list(counted)))
        rows = level.select(F.col("of").alias("part"), "packed")
        above.append(level)

    def save_lower(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        columns, n = _gather(group)
        dense = np.zeros(model._first(part + 1) - model._first(part), np.int64)
        dense[columns[0].astype(np.int64) - model._first(part)] = n
        return pa.table({"part": pa.array([part]), "name": [save(folder, dense)], "total": [int(n.sum())], **{f"n{i}": [int((n == i).sum())] for i in (1, 2, 3, 4)}, "more": [int((n > 2).sum())]})

    lower = staged(rows.groupBy("part").applyInArrow(save_lower, "part bigint, name string, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint"), "ngram-lower")
    low = lower.collect()
    n = {c: sum(r[c] for r in low) for c in ("total", "n1", "n2", "n3", "n4", "more")}
    cut = discounts([n["n1"], n["n2"], n["n3"], n["n4"]])
    rest = (cut[0] * n["n1"] + cut[1] * n["n2"] + cut[2] * n["more"]) / n["total"] if n["total"] else 1.0
    discard(spark, lower, *above)
    return KneserNey(folder, order, bits, model.word_files, n_words, n_tokens, model.parts, levels, {r["part"]: r["name"] for r in low}, cut, n["total"], rest)


def discard_model(spark: SparkSession, model: KneserNey) -> None:
    """Delete a model's files; scores that were not computed yet can't be any more."""
    remove(spark, model.folder)


def _numbered(model: KneserNey, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number and training count of every token, and the rows' borders."""
    h, borders = tokens(data, offsets)
    known, back = np.unique(h, return_inverse=True)
    number, count = model.numbers(known)
    return number[back], count[back], borders


def score_texts(docs: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """The documents with n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity."""
    docs = without(docs, SCORES, (text_col,))
    ship(docs.sparkSession)
    # the model object lists file names; their number grows with the corpus at one for each 2 million tokens and order
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, offsets in pieces(batches, text_col):
            number, count, borders = _numbered(m, data, offsets)
            base = np.log10((count + 1) / (m.n_tokens + 1 * (m.n_words + 1)))
            if m.n_tokens:
                columns = m.grams(number, borders)
                order, first = _distinct(columns)
                p = np.empty(len(order))
                p[order] = np.repeat(m.chances(columns[:, order[first]]), np.diff(np.append(first, len(order))))
            else:
                p = np.ones(len(number))
            sums, size = lambda x: np.add.reduceat(x, borders[:-1]), np.diff(borders)
            score = sums(np.log10(p))
            columns = [pa.array(size), pa.array(sums((count > 0).astype(np.int64))), pa.array(np.full(part.num_rows, m.n_tokens)), pa.array(sums(base)), pa.array(score), pa.array(10.0 ** (-score / size))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *SCORES])

    kinds = [LongType()] * 3 + [DoubleType()] * 3
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(SCORES, kinds, strict=True)]]))


def kneser_ney_scores(docs: DataFrame, train_rows: Column, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """Fit on the rows for which ``train_rows`` holds and score all rows."""
    return score_texts(docs, fit_kneser_ney(docs.where(train_rows), order, text_col), text_col)
