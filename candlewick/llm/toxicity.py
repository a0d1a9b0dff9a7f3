"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import samples
from candlewick.llm import textops as X

#: Categories in the order of the chain. The label gives the first. The learnt words fall into two groups by the documents
#: they occur in together: a document of label 1 with words of the larger one is core, with others fringe; it may be both.
CATEGORIES = ("toxic", "core", "fringe")
#: Documents of each label, and words, at most; the least z of a word.
PER_CLASS, WORDS, LEAST_Z = 3000, 200, 5.0

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class Chain:
    """hashes: of the listed words, ascending; links: for each category which words it may see, and its weights over these and the probabilities before."""

    hashes: np.ndarray
    links: list[tuple[np.ndarray, np.ndarray]]

    def probabilities(self, counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        if not self.links:
            return np.zeros((len(counts), len(CATEGORIES)))
        found: list[np.ndarray] = []
        for seen, w in self.links:
            found.append(samples.probability(np.column_stack([design(counts, n_words, seen), *found]), w))
        return np.round(np.column_stack(found), 6)


def word_counts(part: X.Slice, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text how often it has each listed word, and the number of its words."""
    starts, ends = X.edges(_IS_LETTER[part.data], part.offsets)
    first = np.searchsorted(starts, part.offsets)
    texts = np.repeat(np.arange(len(part)), np.diff(first))
    out = np.zeros((len(part), len(hashes)))
    if len(hashes) and len(starts):
        own = X.span_hashes(part.data, starts, ends, X.LOWER_CODES)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[at] == own
        np.add.at(out, (texts[hit], at[hit]), 1)
    return out, np.diff(first)


def design(counts: np.ndarray, n_words: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Features from the words that may be seen: logarithmic counts, how many different ones a text has, their share of its words."""
    own = counts[:, seen]
    return np.column_stack([np.log1p(own), (own > 0).sum(axis=1), 10 * own.sum(axis=1) / np.maximum(n_words, 1)])


def _words(sample: DataFrame) -> DataFrame:
    """Columns word, and for each fold k the documents of label 1 (a_k) and 0 (b_k) that have it; A to Z in lower case."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = sample.select("label", "fold", F.explode(F.array_distinct(F.split(lower, r"[^a-z\x{80}-\x{10FFFF}]+"))).alias("word")).where("word <> ''")
    own = lambda k, label: F.count_if((F.col("fold") == k) & (F.col("label") == label))
    return words.groupBy("word").agg(*(own(k, label).alias(f"{n}_{k}") for k in range(samples.FOLDS) for n, label in (("a", 1), ("b", 0))))


def word_lists(sample: DataFrame) -> list[list[str]]:
    """For each fold the words that the documents outside it give, and last those that all give: the ones whose document frequency is higher for label 1, by z."""
    counts = sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
    seen = _words(sample).cache()
    lists = []
    for left_out in (*range(samples.FOLDS), None):
        folds = [k for k in range(samples.FOLDS) if k != left_out]
        n1, n0 = (sum(r["n"] for r in counts if r["label"] == label and r["fold"] in folds) for label in (1, 0))
        if not n1 or not n0:
            lists.append([])
            continue
        a, b = (sum((F.col(f"{x}_{k}") for k in folds), F.lit(0)) for x in "ab")
        p = (a + b + 1) / (n1 + n0 + 2)
        z = (a / n1 - b / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        lists.append([r["word"] for r in seen.select("word", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(WORDS).collect()])
    seen.unpersist()
    return lists


def core_words(has: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which words are core: rather in documents with the first listed word than with the one that is least often there with it. Rows of has are documents of label 1."""
    core = np.zeros(has.shape[1], bool)
    if len(listed):
        has = has.astype(float)
        together = has.T @ has
        size = np.sqrt(np.maximum(np.diag(together), 1))
        near = together / size[:, None] / size[None, :]
        far = listed[int(np.argmin(near[listed[0], listed]))]
        core[listed] = near[listed[0], listed] > near[far, listed]
        core[listed[0]] = True
    return core


def train(counts: np.ndarray, n_words: np.ndarray, label: np.ndarray, folds: np.ndarray, lists: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The links of the chain. lists: columns of counts for each fold without it, and last for all.

    A group's link sees no word that makes its category, so what it knows of them comes from the probabilities before. While
    it is trained, these come from models, and word lists, that didn't see the row.
    """
    core = core_words(counts[label == 1] > 0, lists[-1])
    groups = {"core": core, "fringe": np.isin(np.arange(counts.shape[1]), lists[-1]) & ~core}
    links, before = [], []
    for name in CATEGORIES:
        hidden = groups.get(name, np.zeros(counts.shape[1], bool))
        y = label * (counts[:, hidden].sum(axis=1) > 0) if name in groups else label
        unseen = np.zeros(len(label))
        for k in range(samples.FOLDS):
            out = folds == k
            own = np.column_stack([design(counts, n_words, lists[k][~hidden[lists[k]]]), *before])
            if out.any() and not out.all():
                unseen[out] = samples.probability(own[out], samples.logistic(own[~out], y[~out]))
        seen = lists[-1][~hidden[lists[-1]]]
        links.append((seen, samples.logistic(np.column_stack([design(counts, n_words, seen), *before]), y)))
        before.append(unseen)
    return links


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fits the chain on at most per_class documents of each label; what comes to the driver is bounded by that."""
    sample = samples.labelled_sample(docs, labels, label, per_class, id_col, text_col).select("id", "text", "label")
    sample = sample.withColumn("fold", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(samples.FOLDS)).cast("int"))
    lists = word_lists(sample)
    words = sorted({w for own in lists for w in own})
    part = next(X.slices(pa.array(words, pa.string())), None)
    hashes = X.span_hashes(part.data, part.offsets[:-1], part.offsets[1:], X.LOWER_CODES) if part else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    hashes, column = hashes[order], {words[j]: i for i, j in enumerate(order.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(1)):
                a, b = part.rows
                counts, n_words = word_counts(part, hashes)
                found = [np.flatnonzero(x) for x in counts]
                sparse = X.binaries([np.array([at, x[at]], "<u4").tobytes() for at, x in zip(found, counts, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.string()), *(c.slice(a, b - a) for c in batch.columns[2:]), pa.array(n_words, pa.int64()), sparse], ["id", "label", "fold", "n_words", "counts"])

    found = sample.mapInArrow(run, "id string, label int, fold int, n_words bigint, counts binary")
    rows = found.groupBy("id").agg(F.min_by(F.struct("label", "fold", "n_words", "counts"), F.struct("n_words", "counts")).alias("r")).select("id", "r.*").collect()
    rows.sort(key=lambda r: r["id"])
    if not rows:
        return Chain(hashes, [])
    counts = np.zeros((len(rows), len(hashes)))
    for i, r in enumerate(rows):
        at, n = np.frombuffer(r["counts"], "<u4").reshape(2, -1)
        counts[i, at] = n
    of = lambda name: np.array([r[name] for r in rows])
    return Chain(hashes, train(counts, of("n_words"), of("label").astype(float), of("fold"), [np.array([column[w] for w in own], np.int64) for own in lists]))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, p_toxic, p_core, p_fringe (0 to 1), is_toxic (p_toxic is 0.5 or more).

    Words are runs of letters, A to Z in lower case. Documents that the quality score holds out aren't learnt from here
    either. Null and empty texts have no words. Without labels all probabilities are 0; with labels of one class only no
    word is listed, and the probability is near that class. A document labelled more than once has its largest label; of
    equal ids the text with the fewest words is learnt from. Whole texts are scored, of any length; repeated and null ids
    give a row each; other columns don't matter. No shuffle of documents.
    """
    chain = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, per_class, id_col, text_col))
    few, names = docs.select(id_col, text_col), [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(1)):
                p = chain.value.probabilities(*word_counts(part, chain.value.hashes))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows[0], len(part)), *(pa.array(p[:, i]) for i in range(len(names)))], [id_col, *names])

    found = few.mapInArrow(run, f"{id_col} {few.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
    return found.withColumn("is_toxic", F.col("p_toxic") >= 0.5)
