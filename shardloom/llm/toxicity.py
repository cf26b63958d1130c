"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(x.w - threshold_k): all thresholds share the weights w,
and the thresholds stay in order.  The score is the expected severity, the
sum over k of P(grade > k).  x marks which words a text has (runs of letters
and digits, ASCII letters lower-cased) and which beginnings of words of 4 to 6
bytes, so inflected and compounded forms count, at any place of the whole text.
Features are 32-bit hashes; only those whose odds differ between toxic and other
training rows get a weight.

Training is on the driver, by proximal gradient steps in numpy (an L1 penalty
keeps the weights sparse), on a bounded, documented sample of labelled rows
(``max_rows`` for each label, by hash of the id).  Labels may be grades.
Labels of 0 and 1 only are graded first: a toxic row is severe (2) if it has
more words that mark toxic rows than the median of the toxic rows, else mild (1).

Which features get a weight, and from which P(grade > 0) a text is rejected, is
chosen within the training sample: every row is scored by a model that was
fitted without its fold (``FOLDS``), and of the offered values those are taken
that lose least, a false alarm counting ``ALARM`` times a miss.

Defined cases: null and empty texts have no words and get the severity of no
evidence; several labels of one id count as their maximum, of several texts of
one id the one with the smallest hash is learned from; without two grades among
the labels everything gets grade 0; null ids are scored like others, repeated
rows alike; an empty table gives an empty result; columns with the names of those
added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from shardloom.llm._spark import ship, without
from shardloom.llm._text import U64, distinct, lowered, mix, pieces, ranges, words
from shardloom.llm.quality import arrays, gathered, labelled_sample, row_sums

MAX_ROWS = 2500
#: Features in fewer training rows, with odds closer to even, or fewer standard deviations from chance carry no weight; of the deviations one is chosen.
LEAST_ROWS, LEAST_ODDS, DEVIATIONS = 4, 1.0, (2.0, 2.5, 3.0, 4.0)
PREFIXES = (4, 5, 6)
FOLDS, ALARM = 4, 5.0
#: Offered values of P(grade > 0) from which a text counts as toxic; the middle one holds where nothing can be chosen.
REJECT_AT = tuple(i / 20 for i in range(2, 19))
_DELIMITERS = np.zeros(256, bool)
_DELIMITERS[:128] = True
_DELIMITERS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class OrdinalModel:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    reject_at: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score, by k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def word_features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """32-bit features and the row of each: words, then their beginnings."""
    starts, ends, h, rows = words(data, offsets, delimiters=_DELIMITERS)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out = [((h >> U64(32)).astype(np.uint32), owner)]
    length, value, small = ends - starts, np.zeros(len(starts), U64), lowered(data)
    for size in range(1, PREFIXES[-1] + 1):
        longer = length >= size
        starts, length, value, owner = starts[longer], length[longer], value[longer], owner[longer]
        value = value << U64(8) | small[starts + size - 1].astype(U64)
        if size in PREFIXES:
            out.append(((mix(value + U64(size << 56)) >> U64(32)).astype(np.uint32), owner))
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in pieces(batches, "text", 1 << 20):
        index, owner = (np.concatenate(x) for x in zip(*word_features(data, offsets), strict=True))
        order = np.argsort(owner, kind="stable")
        index, rows = distinct(index[order], np.searchsorted(owner[order], np.arange(part.num_rows + 1)))
        yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("doc_id", "label")), pa.array([index[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())], ["doc_id", "label", "index"])


def screen(index: np.ndarray, rows: np.ndarray, label: np.ndarray, least_deviation: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features worth a weight: their keys, odds, and what is left of the rows as positions among the keys."""
    keys, at = np.unique(index, return_inverse=True)
    toxic = label > 0
    owner = np.repeat(np.arange(len(label)), np.diff(rows))
    inside = np.bincount(at[toxic[owner]], minlength=len(keys))
    outside = np.bincount(at[~toxic[owner]], minlength=len(keys))
    odds = np.log((inside + 0.5) / (toxic.sum() + 1)) - np.log((outside + 0.5) / ((~toxic).sum() + 1))
    both, share = inside + outside, toxic.mean() if len(label) else 0.5
    deviation = np.abs(inside - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    kept = (both >= LEAST_ROWS) & (np.abs(odds) >= LEAST_ODDS) & (deviation >= least_deviation)
    place = np.cumsum(kept) - 1
    live = kept[at]
    return keys[kept], odds[kept], place[at[live]], np.searchsorted(owner[live], np.arange(len(label) + 1))


def grade(odds: np.ndarray, at: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Severity grades from labels of 0 and 1."""
    toxic = label > 0
    marks = row_sums((odds > 2).astype(float)[at], rows)
    return np.where(toxic, 1 + (marks > np.median(marks[toxic])), 0)


def fit_ordinal(keys: np.ndarray, at: np.ndarray, rows: np.ndarray, grades: np.ndarray, penalty: float = 3e-4, steps: int = 200, rate: float = 0.3) -> OrdinalModel:
    """Weights and ordered thresholds for grades 0..K of sparse binary rows, given as positions among the keys."""
    top = int(grades.max(initial=0))
    if top == 0 or not (grades == 0).any():
        return OrdinalModel(keys[:0], np.zeros(0), np.full(1, np.inf if top == 0 else -np.inf))
    owner = np.repeat(np.arange(len(grades)), np.diff(rows))
    n, w, past = len(grades), np.zeros(len(keys)), np.full(len(keys), 1e-8)
    share = np.clip([(grades > k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    theta, moved = np.log((1 - share) / share), np.full(top, 1e-8)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(steps):
        s = row_sums(w[at], rows)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(edges[grades + 1] - s), sigmoid(edges[grades] - s)
        upper, lower = np.where(grades == top, 1.0, upper), np.where(grades == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g = np.bincount(at, weights=(du - dl)[owner], minlength=len(keys)) / n
        past += g * g
        pace = rate / np.sqrt(past)
        w -= pace * g
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
        gt = np.array([-du[grades == k].sum() + dl[grades == k + 1].sum() for k in range(top)]) / n
        moved += gt * gt
        theta -= rate / np.sqrt(moved) * gt
        theta = np.maximum.accumulate(theta - 1e-3 * np.arange(top)) + 1e-3 * np.arange(top)
    return OrdinalModel(keys[w != 0], w[w != 0], theta)


def fit_screened(index: np.ndarray, rows: np.ndarray, label: np.ndarray, least_deviation: float) -> OrdinalModel:
    keys, odds, at, rows = screen(index, rows, label, least_deviation)
    grades = grade(odds, at, rows, label) if label.max(initial=0) == 1 and (label == 0).any() else label
    return fit_ordinal(keys, at, rows, grades)


def scores(model: OrdinalModel, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x.w of rows of distinct features."""
    if not len(model.keys):
        return np.zeros(len(rows) - 1)
    order = np.argsort(model.keys)
    keys = model.keys[order]
    at = np.minimum(np.searchsorted(keys, index), len(keys) - 1)
    return row_sums(np.where(keys[at] == index, model.weights[order][at], 0.0), rows)


def choose(index: np.ndarray, rows: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The deviation and the rejection threshold that lose least on rows scored without their fold."""
    best = (np.inf, DEVIATIONS[1], REJECT_AT[len(REJECT_AT) // 2])
    toxic = label > 0
    if min(toxic.sum(), (~toxic).sum()) < 2 * FOLDS:
        return best[1:]
    fold, size = np.zeros(len(label), np.int64), np.diff(rows)
    for own in (np.flatnonzero(toxic), np.flatnonzero(~toxic)):
        fold[own] = np.arange(len(own)) % FOLDS
    part = [(np.flatnonzero(fold == f), np.flatnonzero(fold != f)) for f in range(FOLDS)]
    cut = lambda some: (index[ranges(rows[:-1][some], size[some])], np.concatenate([[0], np.cumsum(size[some])]))
    for deviation in DEVIATIONS:
        chance = np.zeros(len(label))
        for left_out, used in part:
            model = fit_screened(*cut(used), label[used], deviation)
            chance[left_out] = model.above(scores(model, *cut(left_out)))[:, 0]
        for at in REJECT_AT:
            loss = (chance[toxic] < at).mean() + ALARM * (chance[~toxic] >= at).mean()
            best = min(best, (float(loss), deviation, at))
    return best[1:]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train_rows: Column | None = None, max_rows: int = MAX_ROWS) -> OrdinalModel:
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if train_rows is None else train_rows, max_rows, per_label=True)
    got, order = gathered(sample, _gather, "doc_id bigint, label int, index binary")
    parts = arrays(got["index"], order, np.uint32)
    index = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    rows = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    label = np.maximum(got["label"].to_numpy()[order], 0).astype(int)
    deviation, reject_at = choose(index, rows, label)
    return replace(fit_screened(index, rows, label, deviation), reject_at=reject_at)


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float | None = None, names: tuple[str, str, str] = ("severity", "grade", "toxic")) -> DataFrame:
    """The documents with expected severity, likeliest grade, and whether P(grade > 0) is at least ``reject_at`` (by default the model's)."""
    spark, docs = docs.sparkSession, without(docs, names, (text_col,))
    ship(spark)
    limit = model.reject_at if reject_at is None else reject_at
    # no more weights than there are features in the bounded training sample
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        order = np.argsort(fitted.keys)
        keys, values = fitted.keys[order], fitted.weights[order]
        likely = np.zeros(1 << 20, bool)
        likely[keys >> np.uint32(12)] = True
        for part, data, offsets in pieces(batches, text_col):
            hits = [np.stack([owner[keep], np.searchsorted(keys, index[keep])]) for index, owner in word_features(data, offsets) for keep in [np.flatnonzero(likely[index >> np.uint32(12)])] for keep in [keep[np.isin(index[keep], keys)]]]
            owner, at = np.unique(np.concatenate(hits, axis=1), axis=1)
            above = fitted.above(np.bincount(owner, weights=values[at], minlength=part.num_rows))
            chance = -np.diff(above, axis=1, prepend=1.0, append=0.0)
            columns = [pa.array(above.sum(1)), pa.array(chance.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= limit)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    kinds = [DoubleType(), IntegerType(), BooleanType()]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(names, kinds, strict=True)]]))
