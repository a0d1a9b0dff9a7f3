"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import quality_rules, samples
from candlewick.llm import textops as X

#: The labelled vectors are those of so many documents of each label at most; all bounds of what is broadcast.
PER_CLASS, RANK, NEIGHBOURS = 1500, 64, 25
#: Documents whose products with all labelled vectors are taken at once.
BLOCK = 256

_PAIRS, _SHAPES, _BINS = 1024, 512, 16
_PLACES = 100_000
DIMENSIONS = _PAIRS + _SHAPES + 5 * _BINS

_rng = np.random.default_rng(22)
_PAIR_AT = _rng.integers(0, _PAIRS, 1 << 16, dtype=np.int64)
_KIND = np.arange(256) % 64 + 5  # characters that aren't letters, digits or white space stand for themselves
for _chars, _kind in ((range(0x80, 0x100), 1), (range(ord("a"), ord("z") + 1), 1), (range(ord("A"), ord("Z") + 1), 2), (range(ord("0"), ord("9") + 1), 3), (X.WHITE, 4), ((0x0A,), 0)):
    _KIND[list(_chars)] = _kind
_SHAPE_AT = _rng.integers(0, _SHAPES, 69**3, dtype=np.int64)


def features(part: X.Slice) -> np.ndarray:
    """For each text: logarithmic counts of byte pairs and of shapes of three characters, hashed; its length and how much of it repeats, in bins."""
    n, data, counts = len(part), part.data, quality_rules.measure(part)
    out = np.zeros((n, DIMENSIONS), np.float32)
    pairs = _PAIR_AT[data[:-1].astype(np.int64) << 8 | data[1:]]
    kind = _KIND[data]
    shapes = _SHAPE_AT[(kind[:-2] * 69 + kind[1:-1]) * 69 + kind[2:]]
    for i, (a, b) in enumerate(zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True)):
        if b - a > 1:
            out[i, :_PAIRS] = np.bincount(pairs[a : b - 1], minlength=_PAIRS)
        if b - a > 2:
            out[i, _PAIRS : _PAIRS + _SHAPES] = np.bincount(shapes[a : b - 2], minlength=_SHAPES)
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    bins = [np.log2(counts["n_words"] + 1), 15 * counts["n_repeat_words"] / words, 15 * counts["line_chars"] / chars, 30 * counts["n_symbols"] / chars, 15 * counts["gram_5_chars"] / chars]
    for k, x in enumerate(bins):
        out[np.arange(n), _PAIRS + _SHAPES + k * _BINS + np.minimum(x.astype(int), _BINS - 1)] = 20
    return np.log1p(out).astype(np.float16).astype(np.float32)  # as labelled ones are sent


@dataclass
class Space:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space."""
        x = x * self.idf
        x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """The mean label of the nearest labelled vectors, weighted by the fourth power of their cosines.

        Cosines count to five places; of equal ones the labelled row with the lesser features is nearer. Blocks have one shape,
        so a text's vote doesn't depend on those beside it.
        """
        if not len(self.labels):
            return np.full(len(x), 0.5)
        out, n = np.empty(len(x)), len(self.labels)
        k, block = min(NEIGHBOURS, n), np.zeros((BLOCK, x.shape[1]), np.float32)
        for a in range(0, len(x), BLOCK):
            own = x[a : a + BLOCK]
            block[: len(own)], block[len(own) :] = own, 0
            near = np.rint((self.place(block) @ self.vectors.T)[: len(own)] * _PLACES).astype(np.int64)
            best = np.argpartition(np.arange(n) - near * n, k - 1, axis=1)[:, :k]
            weight = (np.maximum(np.take_along_axis(near, best, axis=1), 1) / _PLACES) ** 4
            out[a : a + BLOCK] = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.round(np.clip(out, 0, 1), 6)


def fit(x: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Space:
    """Latent semantic analysis of the labelled rows: the leading right singular vectors, by subspace iteration."""
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    space = Space(idf, np.eye(DIMENSIONS, rank, dtype=np.float32), np.zeros((0, rank), np.float32), labels)
    if len(x):
        m = x * idf
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        q = np.random.default_rng(23).normal(size=(DIMENSIONS, rank + 16)).astype(np.float32)
        for _ in range(5):
            q, _ = np.linalg.qr(m.T @ (m @ q))
        _, _, v = np.linalg.svd(m @ q, full_matrices=False)
        space.basis = np.ascontiguousarray((q @ v[:rank].T).astype(np.float32))
        space.vectors = space.place(x)
    return space


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Space:
    """Fits the space on at most per_class documents of each label; what comes to the driver is bounded by that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(1)):
                a, b = part.rows
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.string()), batch.column(2).slice(a, b - a), X.binaries([x.astype("<f2").tobytes() for x in features(part)])], ["id", "label", "x"])

    sample = samples.labelled_sample(docs, labels, label, per_class, id_col, text_col).select("id", "text", "label")
    rows = sample.mapInArrow(run, "id string, label int, x binary").groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["label"]))  # by what they are, not by their ids
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], np.float32).reshape(len(rows), DIMENSIONS)
    return fit(x, np.array([r["label"] for r in rows], np.float64))


def quality_knn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: label 1 is likelier).

    Every text is compared with every labelled vector; the vote is that of the 25 nearest, of equally near ones those with
    the lesser features. Only text is scored, whole and of any length: a null or empty one by its length and lack of words.
    Without any label the score is 0.5. Null ids count as not held out; repeated ids give a row each; a document labelled
    more than once has its largest label; other columns don't matter. The documents aren't shuffled.
    """
    space = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, per_class, id_col, text_col))
    few = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows[0], len(part)), pa.array(space.value.vote(features(part)), pa.float64())], [id_col, "score"])

    found = few.mapInArrow(run, f"{id_col} {few.schema[id_col].dataType.simpleString()}, score double")
    return found.select(id_col, samples.held_out(F.col(id_col)).alias("held_out"), "score")
