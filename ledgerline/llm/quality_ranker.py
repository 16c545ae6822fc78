"""Operator 5: quality scores by Bradley-Terry ranking of preference pairs.

A pair is a text labelled good and one labelled bad; the model says that the good one wins with
probability ``sigmoid(w . (x_good - x_bad))`` for the texts' features x, and w minimises the
logistic loss of all pairs (with a small penalty) by Newton's steps.
Texts are then ranked by ``w . x`` and the threshold is a quantile of that rank: the share of
bad ones among the labelled rows. Scores are shifted so that the quantile falls on ``CUT``.

The model is fitted on all labelled rows and all pairs of them. Their number grows with the square
of the rows', so they aren't made: each pass gathers, by label and by cells of ``WIDTH`` of the rank, the sums of
powers of the offset in the cell and of their products with the features, from which the loss of all pairs
and its slope follow by a series of ``ORDERS`` terms (exact to about 1e-9). What the driver gets is these sums.
The threshold is exact too (``common.order_statistics``).

Defined results: a null or empty text has the features of no words and is scored like any
other; labels that contradict each other for a doc_id, null labels and null ids are not
learned from; of rows that share an id the one with the least features is; where one of
the labels is missing all scores are 0.5; repeated rows get the same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ledgerline.llm.common import Words, checkpointed, chunks, fold, order_statistics, release
from ledgerline.llm.repetition import covered, repeated_lines
from ledgerline.shipping import shipped

CUT = 0.3
PENALTY = 1e-3
STEPS = 400
#: Cells of the rank, and terms of the series in it.
WIDTH, ORDERS = 0.25, 8

SYMBOLS = re.compile(r"[#*$%&|<>]")
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:!?'\"()-")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_OTHER = np.zeros(256, dtype=bool)
_OTHER[list(b"#*$%&|<>{}[]\\^~_=+@`")] = True

FEATURES = ("log_words", "word_length", "log_lines", "repeated_3", "repeated_5", "dup_lines", "distinct", "one_letter", "long_words", "punctuation", "digits", "symbols", "any_symbols", "repeats_squared", "symbols_squared")


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text; shares are of its words or word characters."""
    n, words = len(texts), Words(texts)
    count = np.maximum(words.counts, 1)
    chars = words.code_points

    def mean(of: np.ndarray) -> np.ndarray:
        return np.bincount(words.owner, weights=of, minlength=n) / count

    sizes = np.maximum(np.bincount(words.owner, weights=chars, minlength=n), 1)
    owner_of_byte = np.repeat(np.arange(n), np.diff(words.text_starts))

    def share(table: np.ndarray) -> np.ndarray:
        return np.bincount(owner_of_byte[table[words.bytes]], minlength=n) / sizes

    _, first = np.unique(words.owner * (len(words.distinct) + 1) + words.ids, return_index=True)
    owner, again, _, _ = repeated_lines(words)
    lines = np.bincount(owner, minlength=n)
    repeated = mean(covered(words, 5))
    symbols = share(_OTHER)
    distinct = np.bincount(words.owner[first], minlength=n) / count
    return np.column_stack((
        np.log1p(words.counts), mean(chars), np.log1p(lines), mean(covered(words, 3)), repeated,
        np.bincount(owner[again], minlength=n) / np.maximum(lines, 1), distinct, mean(chars == 1), mean(chars > 20),
        share(_PUNCTUATION), share(_DIGIT), np.minimum(symbols, 1), np.minimum(symbols * 20, 1), np.minimum(repeated * 3, 1), np.minimum(symbols, 1) ** 2,
    ))


@dataclass
class RankModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    steepness: float
    cut: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def ranks(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; ``cut`` at the threshold."""
        if not self.steepness:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((self.ranks(x) - self.threshold) * self.steepness + np.log(self.cut / (1 - self.cut)), -30, 30)))


def _sums(x: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
    """Of the rows in each cell of the rank: sums of the offset's powers, of these times x, and of x's products."""
    ranks = x @ w
    cells = np.floor(ranks / WIDTH).astype(np.int64)
    powers = (ranks - (cells + 0.5) * WIDTH)[:, None] ** np.arange(ORDERS)
    order = np.argsort(cells, kind="stable")
    out = {}
    for own in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        if len(own):
            out[int(cells[own[0]])] = np.concatenate((powers[own].sum(axis=0), (powers[own].T @ x[own]).ravel(), (x[own].T @ x[own]).ravel()))
    return out


def _derivatives(t: np.ndarray) -> list[np.ndarray]:
    """log(1 + exp(-t)) and its derivatives, each over its order's factorial."""
    p = 1 / (1 + np.exp(np.clip(-t, -700, 700)))
    out, poly = [np.logaddexp(0, -t)], np.polynomial.Polynomial([-1, 1])
    for k in range(1, ORDERS + 1):
        out.append(poly(p) / math.factorial(k))
        poly = poly.deriv() * np.polynomial.Polynomial([0, 1, -1])
    return out


def _loss(good: dict[int, np.ndarray], bad: dict[int, np.ndarray], size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss of all pairs and its slope, from the sums by cell; and its curvature, as of the cells' middles."""

    def split(of: dict[int, np.ndarray]):
        cells = np.array(sorted(of))
        rows = np.array([of[c] for c in cells.tolist()])
        return cells, rows[:, :ORDERS], rows[:, ORDERS : ORDERS * (size + 1)].reshape(-1, ORDERS, size), rows[:, ORDERS * (size + 1) :].reshape(-1, size, size)

    b_cells, b0, b1, b2 = split(bad)
    loss, slope, curve, pairs = 0.0, np.zeros(size), np.zeros((size, size)), 0.0
    g_all = split(good)
    for at in range(0, len(g_all[0]), 256):
        g_cells, g0, g1, g2 = (x[at : at + 256] for x in g_all)
        f = _derivatives((g_cells[:, None] - b_cells[None, :]) * WIDTH)
        pairs += g0[:, 0].sum() * b0[:, 0].sum()
        for k in range(ORDERS):
            for m in range(k + 1):
                sign = math.comb(k, m) * (-1) ** (k - m)
                loss += sign * (g0[:, m] @ f[k] @ b0[:, k - m])
                first = f[k + 1] * (k + 1)  # the slope's own series
                slope += sign * (g1[:, m].T @ (first @ b0[:, k - m]) - b1[:, k - m].T @ (g0[:, m] @ first))
        second = f[2] * 2
        cross = g1[:, 0].T @ second @ b1[:, 0]
        curve += np.tensordot(second @ b0[:, 0], g2, 1) + np.tensordot(g0[:, 0] @ second, b2, 1) - cross - cross.T
    return loss / pairs, slope / pairs, curve / pairs


def _weights(gather: Callable[[np.ndarray], tuple[dict, dict]], size: int, penalty: float, steps: int) -> np.ndarray:
    """Newton's steps on the mean logistic loss of all pairs, halved until it falls; ``gather`` gives the sums of both labels."""

    def told(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = _loss(*gather(w), size)
        return loss + penalty * w @ w / 2, slope + penalty * w, curve + penalty * np.eye(size)

    w = np.zeros(size)
    now, slope, curve = told(w)
    for _ in range(steps):
        step, part = np.linalg.solve(curve, slope), 1.0
        new = told(w - step)
        while new[0] > now and part > 1e-6:
            part /= 2
            new = told(w - part * step)
        if part <= 1e-6 or now - new[0] < 1e-9:
            break
        w, (now, slope, curve) = w - part * step, new
    return w


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float, cut: float = CUT, penalty: float = PENALTY, steps: int = STEPS) -> RankModel:
    """Bradley-Terry weights of all pairs of good and bad rows, and the rank's quantile as threshold, of rows in memory."""
    size = good.shape[1]
    if not len(good) or not len(bad):
        return _unknown(size, cut)
    both = np.concatenate((good, bad))
    mean, spread = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6)
    g, b = (np.clip((x - mean) / spread, -8, 8) for x in (good, bad))
    w = _weights(lambda w: (_sums(g, w), _sums(b, w)), size, penalty, steps)
    own, other = g @ w, b @ w
    # The quantile of all labelled rows, of which these may hold either label in another share.
    ranks, weights = np.concatenate((other, own)), np.concatenate((np.full(len(b), bad_share / len(b)), np.full(len(g), (1 - bad_share) / len(g))))
    order = np.argsort(ranks, kind="stable")
    reached = int(np.searchsorted(np.cumsum(weights[order]), bad_share - 1e-12))
    upper = min(reached + 1, len(order) - 1)
    threshold = float((ranks[order[reached]] + ranks[order[upper]]) / 2)
    return RankModel(mean, spread, w, threshold, 1.0, cut)


def _unknown(size: int, cut: float) -> RankModel:
    return RankModel(np.zeros(size), np.ones(size), np.zeros(size), 0.0, 0.0, cut)


def _feature_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and the features of every row as an array."""
    schema = StructType([*docs.select(*keep).schema, StructField("features", ArrayType(DoubleType()))])

    def run(batches):
        release()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start, texts in chunks(x.as_py() or "" for x in batch.column(at)):
                x = features(texts)
                own = [batch.column(batch.schema.get_field_index(c)).slice(start, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(x), pa.list_(pa.float64()))], [*keep, "features"])

    return shipped(docs).select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def _gathered(rows: DataFrame, model: RankModel) -> tuple[dict, dict]:
    """The sums by cell of the good and of the bad rows, at the model's weights."""
    size, schema = len(FEATURES), "quality int, cell long, sums array<double>"

    def table(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["quality", "cell", "sums"])

    def add(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            label, x = batch.column(0).to_numpy(), model.scaled(batch.column(1).flatten().to_numpy().reshape(-1, size))
            for quality in (0, 1):
                for cell, own in _sums(x[label == quality], model.weights).items():
                    held[quality, cell] = held.get((quality, cell), 0) + own
        yield table(held)

    def merge(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for quality, cell, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held[quality, cell] = held.get((quality, cell), 0) + own.values.to_numpy()
        yield table(held)

    out: tuple[dict, dict] = ({}, {})
    for r in rows.mapInArrow(add, schema).repartition("quality", "cell").mapInArrow(merge, schema).collect():
        out[r["quality"]][r["cell"]] = np.array(r["sums"])
    return out[1], out[0]


def train(docs: DataFrame, labels: DataFrame, where: Column) -> RankModel:
    """Fit on all labelled rows of ``docs`` that ``where`` admits."""
    told = labels.where(where & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    # Texts aren't shuffled: their features are, one row of each id, whatever repeats.
    found = _feature_rows(docs.where(where & F.col("doc_id").isNotNull()).select("doc_id", "text"), ("doc_id",)).groupBy("doc_id").agg(F.min("features").alias("features"))
    rows = checkpointed(found.join(told, "doc_id").select("quality", "features"))
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    size = len(FEATURES)
    if len(counts) < 2:
        return _unknown(size, CUT)
    each = [F.col("features")[k] for k in range(size)]
    moments = rows.agg(*[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    model = RankModel(np.array(moments[:size]), np.maximum(np.array(moments[size:]), 1e-6), np.zeros(size), 0.0, 1.0, CUT)

    model = replace(model, weights=_weights(lambda w: _gathered(rows, replace(model, weights=w)), size, PENALTY, STEPS))

    def rank(batches):
        for batch in batches:
            ranks = model.ranks(batch.column(1).flatten().to_numpy().reshape(-1, size))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ranks), dtype=np.int32)), pa.array(ranks)], ["group", "value"])

    places = (counts[0] - 1, counts[0])
    at = order_statistics(checkpointed(rows.mapInArrow(rank, "group int, value double")), {0: places})
    return replace(model, threshold=(at[0, places[0]] + at[0, places[1]]) / 2)


def score(docs: DataFrame, model: RankModel) -> DataFrame:
    """``docs`` with the column score, in place of one that has its name; one pass, no shuffle."""
    docs = docs.drop("score")
    schema = StructType([*docs.schema, StructField("score", DoubleType())])
    names = docs.columns
    at = names.index("text")

    def run(batches):
        release()
        for batch in batches:
            for start, texts in chunks(x.as_py() or "" for x in batch.column(at)):
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(model.scores(features(texts)))], [*names, "score"])

    return shipped(docs).mapInArrow(run, schema)


def ranked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned from four folds of five."""
    model = train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches):
        release()
        for batch in batches:
            for start, texts in chunks(x.as_py() or "" for x in batch.column(2)):
                scores = model.scores(features(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array(scores), pa.array((scores >= model.cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return shipped(rows).mapInArrow(run, schema)
