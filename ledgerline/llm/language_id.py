"""Operator 10: language identification by the nearest of several centroids per language.

A text is the vector of its hashed letter n-grams (1 to 3, words bounded by blanks), weighted
``log(1 + tf) * idf`` and normalised. Each language's training vectors are clustered
(spherical k-means) into ``CLUSTERS`` centroids; a text gets the language of the centroid with
the largest cosine (of equal ones the first in the languages' order), and is rejected where
that is under the language's least accepted cosine: a share of a low quantile of its
training texts' cosines, so a matter of distance alone that odd texts don't move.

The model is fitted on all texts that have a language: their counts are written down once, and each
step of the clustering is a pass over them that gathers sums of vectors of ``SIZE`` numbers by centroid, so
what the driver gets is bounded by the languages. The quantile is exact. All texts are read whole.

Defined results: ``und`` with score 0, rejected, for a null or empty text and one without a letter;
also for all texts where there is nothing to learn from. Rows with a null doc_id or lang are
not learned from; of rows that share an id and lang the one with the least counts is. Every language is learned,
however rare; a model over ``MODEL_BYTES`` is an error. Repeated rows get the same result; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ledgerline.llm.common import checkpointed, fold, order_statistics, release, stored
from ledgerline.shipping import shipped

SIZE = 4096
#: Bytes of a model's centroids that a worker holds; a model with more is an error (some 10,000 languages).
MODEL_BYTES = 1 << 30
#: Texts whose vectors are multiplied with all centroids at once.
TOGETHER = 64
CLUSTERS = 3
ROUNDS = 10
#: Tasks that share the parts of one sum.
SALTS = 16
#: Least accepted cosine: this share of that quantile of a language's training texts.
REJECT_UNDER, REJECT_QUANTILE = 0.35, 0.05
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHIFT = np.uint32(32 - SIZE.bit_length() + 1)


def counted(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for a text without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate(([np.uint32(32)], codes[letter | np.concatenate(([False], letter[:-1]))], [np.uint32(32)])).astype(np.uint32)
    one = codes[1:-1] * _A
    two = (codes[:-1] * _A + codes[1:]) * _B
    three = (two[:-1] + codes[2:]) * _C
    grams = np.concatenate((one, two, three))
    return np.bincount((grams ^ (grams >> np.uint32(15))) * _B >> _SHIFT, minlength=SIZE)


def _normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class CentroidModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether it is rejected, of each text."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        for start in range(0, len(texts), TOGETHER):
            found = [(start + i, c) for i, t in enumerate(texts[start : start + TOGETHER]) if (c := counted(t)) is not None]
            if not found:
                continue
            cosines = _normalised(np.log1p(np.array([c for _, c in found])) * self.idf) @ self.centroids.T
            best = np.argmax(cosines, axis=1)
            scores = np.clip(cosines[np.arange(len(found)), best], 0.0, 1.0)
            far = scores < self.least[self.owner[best]]
            for (i, _), k, score, rejected in zip(found, best.tolist(), scores.tolist(), far.tolist(), strict=True):
                out[i] = self.languages[self.owner[k]], score, rejected
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]


def _clusters(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next one the vector farthest from all."""
    centres = [_normalised(vectors.mean(axis=0))]
    while len(centres) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.array(centres).T, axis=1)
        centres.append(vectors[int(np.argmin(nearest))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        centres = np.array([_normalised(vectors[own == i].mean(axis=0)) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def fit(counts: np.ndarray, languages: list[str], clusters: int = CLUSTERS, rounds: int = ROUNDS, reject_under: float = REJECT_UNDER) -> CentroidModel:
    """Model of the rows of n-gram counts and their languages."""
    names = sorted(set(languages))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1 if len(counts) else np.ones(SIZE)
    vectors, of = _normalised(np.log1p(counts) * idf), np.array(languages)
    centroids, owner, least = [], [], []
    for i, name in enumerate(names):
        own = vectors[of == name]
        centres = _clusters(own, clusters, rounds)
        centroids.append(centres)
        owner += [i] * len(centres)
        least.append(reject_under * float(np.quantile(np.max(own @ centres.T, axis=1), REJECT_QUANTILE)))
    return CentroidModel(names, idf, np.concatenate(centroids) if centroids else np.zeros((0, SIZE)), np.array(owner, dtype=int), np.array(least))


def packed(counts: np.ndarray) -> bytes:
    """The counts that are not zero and the steps between their places, compressed."""
    at = np.flatnonzero(counts)
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + counts[at].astype("<u4").tobytes(), 1)


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and counts of some rows one after the other, and where each row starts."""
    raw = [zlib.decompress(r) for r in rows]
    sizes = np.array([len(r) // 6 for r in raw])
    starts = np.cumsum(sizes) - sizes
    steps = np.concatenate([np.frombuffer(r, "<u2", n) for r, n in zip(raw, sizes.tolist(), strict=True)]).astype(np.int64)
    counts = np.concatenate([np.frombuffer(r, "<u4", n, 2 * n) for r, n in zip(raw, sizes.tolist(), strict=True)]).astype(np.float64)
    at = np.cumsum(steps)
    return at - np.repeat(at[starts] - steps[starts], sizes), counts, starts


def _runs(batches, names: list[str], idf: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows at a time: numbers of their languages, their packed counts, and their vectors' places, numbers and starts."""
    release()
    number = {name: i for i, name in enumerate(names)}
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            own = batch.slice(start, 256)
            rows = own.column(1).to_pylist()
            at, counts, starts = unpacked(rows)
            if idf is not None:
                counts = np.log1p(counts) * idf[at]
                lengths = np.sqrt(np.add.reduceat(counts * counts, starts))
                counts = counts / np.repeat(np.maximum(lengths, 1e-12), np.diff(starts, append=len(at)))
            yield np.array([number[x] for x in own.column(0).to_pylist()]), rows, at, counts, starts


def _stacked(centres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All languages' centres in one table (language, centre, place), and how many each has; made once a task."""
    out = np.zeros((len(centres), max(map(len, centres)), SIZE))
    for i, own in enumerate(centres):
        out[i, : len(own)] = own
    return out, np.array([len(c) for c in centres])


def _cosines(of: np.ndarray, at: np.ndarray, vector: np.ndarray, starts: np.ndarray, stacked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each row with its language's centres; -2 where a language has fewer."""
    all_centres, sizes = stacked
    most = all_centres.shape[1]
    language = np.repeat(of, np.diff(starts, append=len(at)))
    out = np.column_stack([np.add.reduceat(vector * all_centres[language, k, at], starts) for k in range(most)])
    return np.where(np.arange(most) < sizes[of][:, None], out, -2.0)


def _sums(rows: DataFrame, work: Callable) -> dict[int, np.ndarray]:
    """The sums by key of the vectors that ``work`` yields for the table's batches."""

    def table(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["key", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for key, own in work(batches):
            held[key] = held.get(key, 0) + own
        yield table(held)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[key] = held.get(key, 0) + np.frombuffer(own.as_py())
        yield table(held)

    schema = "key int, sums binary"
    # Two levels, so that a key's sum doesn't wait for one task to read the parts of all others.
    parts = rows.mapInArrow(add, schema).withColumn("salt", F.spark_partition_id() % SALTS).repartition("key", "salt").select("key", "sums").mapInArrow(merge, schema)
    return {r["key"]: np.frombuffer(bytes(r["sums"])) for r in parts.repartition("key").mapInArrow(merge, schema).collect()}


def _centroids(rows: DataFrame, names: list[str], sizes: list[int], idf: np.ndarray, clusters: int, rounds: int) -> list[np.ndarray]:
    """Each language's centroids as of :func:`_clusters`, by passes over the rows (lang, counts)."""

    def nearest(centres: list[np.ndarray]) -> list[dict[int, np.ndarray]]:
        """The sums of the vectors nearest to each centre, and in the last place how many."""
        most = max(map(len, centres))

        def work(batches):
            stacked = _stacked(centres)
            for of, _, at, vector, starts in _runs(batches, names, idf):
                key = of * most + np.argmax(_cosines(of, at, vector, starts, stacked), axis=1)
                each = np.repeat(key, np.diff(starts, append=len(at)))
                for k in np.unique(key).tolist():
                    yield k, np.append(np.bincount(at[each == k], weights=vector[each == k], minlength=SIZE), (key == k).sum())

        out: list[dict[int, np.ndarray]] = [{} for _ in names]
        for key, own in _sums(rows, work).items():
            out[key // most][key % most] = own[:SIZE] / own[SIZE]
        return out

    def farthest(centres: list[np.ndarray]) -> dict[int, np.ndarray]:
        """The vector of each language whose largest cosine is the least; of equal ones that of the least packed counts."""

        def least(batches):
            held: dict[int, tuple[float, bytes]] = {}
            stacked = _stacked(centres)
            for of, packs, at, vector, starts in _runs(batches, names, idf):
                cosines = np.max(_cosines(of, at, vector, starts, stacked), axis=1)
                for i, own in zip(of.tolist(), zip(cosines.tolist(), packs, strict=True), strict=True):
                    held[i] = min(held.get(i, own), own)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.float64()), pa.array([x[1] for x in held.values()], pa.binary())], ["key", "cosine", "counts"])

        out = {}
        for r in rows.mapInArrow(least, "key int, cosine double, counts binary").groupBy("key").agg(F.min(F.struct("cosine", "counts")).alias("best")).collect():
            at, counts, _ = unpacked([bytes(r["best"]["counts"])])
            out[r["key"]] = _normalised(np.log1p(np.bincount(at, weights=counts, minlength=SIZE)) * idf)
        return out

    centres = [np.zeros((1, SIZE)) for _ in names]
    centres = [_normalised(own[0])[None, :] for own in nearest(centres)]
    for k in range(1, clusters):
        if any(n > k for n in sizes):
            far = farthest(centres)
            centres = [np.concatenate((own, far[i][None, :])) if sizes[i] > k else own for i, own in enumerate(centres)]
    for _ in range(rounds):
        means = nearest(centres)
        moved = [np.array([_normalised(own[k]) if k in own else old[k] for k in range(len(old))]) for old, own in zip(centres, means, strict=True)]
        settled = all(np.array_equal(x, y) for x, y in zip(centres, moved, strict=True))
        centres = moved
        if settled:
            break
    return centres


def train(docs: DataFrame, where: Column, clusters: int = CLUSTERS, rounds: int = ROUNDS, reject_under: float = REJECT_UNDER) -> CentroidModel:
    """Fit on all rows of ``docs`` that ``where`` admits and that have a language and a letter."""
    known = docs.where(where & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")

    def run(batches):
        release()
        for batch in batches:
            # Of rows that repeat an id the least counts stay, first of a batch and then of all.
            held: dict[tuple[int, str], bytes] = {}
            for doc_id, text, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if (found := counted(text.as_py())) is not None:
                    own = packed(found)
                    held[doc_id, lang] = min(own, held.get((doc_id, lang), own))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.binary())], ["doc_id", "lang", "counts"])

    rows = stored(shipped(known).mapInArrow(run, "doc_id long, lang string, counts binary").groupBy("doc_id", "lang").agg(F.min("counts").alias("counts")).select("lang", "counts"))
    most = MODEL_BYTES // (8 * SIZE * clusters)
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if not found:
        return fit(np.zeros((0, SIZE)), [])
    if len(found) > most:
        raise ValueError(f"a model of more than {most} languages is larger than {MODEL_BYTES} bytes")
    names = sorted(found)
    sizes = [found[x] for x in names]

    def documents(batches):
        for _, _, at, _, _ in _runs(batches, names):
            yield 0, np.bincount(at, minlength=SIZE).astype(np.float64)

    idf = np.log((1 + sum(sizes)) / (1 + _sums(rows, documents)[0])) + 1
    centres = _centroids(rows, names, sizes, idf, clusters, rounds)

    def accepted(batches):
        stacked = _stacked(centres)
        for of, _, at, vector, starts in _runs(batches, names, idf):
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.max(_cosines(of, at, vector, starts, stacked), axis=1))], ["group", "value"])

    places = {i: (n - 1) * REJECT_QUANTILE for i, n in enumerate(sizes)}
    cosines = order_statistics(checkpointed(rows.mapInArrow(accepted, "group int, value double")), {i: sorted({math.floor(x), math.ceil(x)}) for i, x in places.items()})
    least = [reject_under * (cosines[i, math.floor(x)] + (cosines[i, math.ceil(x)] - cosines[i, math.floor(x)]) * (x - math.floor(x))) for i, x in places.items()]
    return CentroidModel(names, idf, np.concatenate(centres), np.repeat(np.arange(len(names)), [len(c) for c in centres]), np.array(least))


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, in place of columns that have their names; one pass, no shuffle."""
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    at = names.index("text")
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches):
        release()
        for batch in batches:
            told = model.predict_all(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64()), pa.array([x[2] for x in told], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return shipped(docs).mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row; learned from two folds of three."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs, fold(F.col("doc_id"), 3) != 1)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")

    def run(batches):
        release()
        for batch in batches:
            told = model.predict_all(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64()), pa.array([x[2] for x in told], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return shipped(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
