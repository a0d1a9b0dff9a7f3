"""Quality rules by repetition coverage: how much of a text lies inside repeated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm import textops as X

#: Symbols that count.
SYMBOLS = b"#*$%&|<>"

#: n-gram length -> the largest allowed share of a text's word characters inside n-grams that occurred before.
LIMITS = {5: 0.25, 8: 0.2, 12: 0.15}
#: The largest allowed share of word characters in lines that occurred before.
LINE_LIMIT = 0.3
LEAST_WORDS, MOST_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of these aren't their first occurrence."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    later, every = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    every[order[1:][same]] = True
    every[order[:-1][same]] = True
    return every, later


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def measure(part: X.Slice) -> dict[str, np.ndarray]:
    """The counts of each text of a slice; ``gram_<n>_chars`` are the characters in repeated n-grams after the first of each."""
    data, words, n = part.data, X.Words(part), len(part)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[words.ends] - points[words.starts]
    texts = words.texts()
    salt = X.mix(texts.astype(np.uint64) + np.uint64(1))  # keys of different texts differ
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    out = {"n_words": words.counts(), "word_chars": _per_text(chars, words.first), "n_symbols": _per_text(symbols[data], part.offsets)}

    starts, ends = X.edges(data != 0x0A, part.offsets)
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    of = np.searchsorted(part.offsets, starts, "right") - 1
    _, later = _repeats(X.span_hashes(data, starts, ends) ^ X.mix(of.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = np.bincount(of[later], minlength=n)
    marks = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(marks, np.searchsorted(words.starts, starts[later]), 1)
    np.add.at(marks, np.searchsorted(words.starts, ends[later]), -1)
    out["line_chars"] = _per_text(np.where(np.cumsum(marks)[:-1] > 0, chars, 0), words.first)

    for k in (3, *LIMITS):
        keys, at = X.windows(words, k)
        every, later = _repeats(keys ^ salt[at])
        if k == 3:
            out["n_repeat_words"] = _per_text(X.spread(at[every], 3, len(texts)), words.first)
        else:
            out[f"gram_{k}_chars"] = _per_text(np.where(X.spread(at[later], k, len(texts)), chars, 0), words.first)
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the columns of carry, the counts of ``measure``, ``base_failed``, ``kept``.

    A text fails the base rule with fewer than 50 words, or when more than half of its words lie in three-word windows
    that occur twice or more. It is kept when it passes and no share of its word characters inside repeated n-grams (5,
    8 and 12 words) or repeated lines, first occurrences excluded, is over its limit. Null and empty texts have no words
    and fail; a very long text is measured whole, alone. Ids aren't looked at: null and repeated ids give a row each, equal
    texts equal results. Carried columns whose names clash with these results are left out. No shuffle.
    """
    names = [*COUNTS, *(f"gram_{k}_chars" for k in LIMITS)]
    carried = [c for c in carry if c not in {*names, "base_failed", "kept"}]
    few = docs.select(*carried, F.col(text_col).alias("_measured")) if text_col not in carried else docs.select(*carried)
    at = few.columns.index(text_col) if text_col in carried else len(carried)
    fields = [*few.schema.fields[: len(carried)], *(T.StructField(k, T.LongType()) for k in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(at)):
                out = measure(part)
                a, b = part.rows
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(carried)]), *(pa.array(out[k], pa.int64()) for k in names)], [f.name for f in fields])

    found = few.mapInArrow(run, T.StructType(fields))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    repeats = F.col("line_chars") > LINE_LIMIT * F.col("word_chars")
    for k, most in LIMITS.items():
        repeats = repeats | (F.col(f"gram_{k}_chars") > most * F.col("word_chars"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)
