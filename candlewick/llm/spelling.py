"""Spelling variants: words one edit apart, found by one-edit neighbourhoods in a reduced alphabet, grouped under frequent forms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import chunks as C
from candlewick.llm import textops as X

#: A run whose hash this divides loses a letter; the least length and number of a word; how many times as frequent a form is.
DROPS, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 97, 5, 3, 2
#: The letters of words after lower-casing A to Z: those, and U+00C0 to U+00FF.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
#: The least number of symbols that letters are reduced to, and all that there are.
LEAST_SYMBOLS, SYMBOLS = 8, "0123456789abcdefghijklmnopqrstuv"
#: Bytes of a text that are handled at once; distinct words that a task holds before it sends them on; runs longer than so many bytes are hashed singly.
PIECE, HELD, SHORT = 1 << 22, 1 << 18, 48

_LOWER = X.LOWER.astype(np.uint8)
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _crc_table() -> np.ndarray:
    made = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        made = np.where(made & 1, (made >> np.uint32(1)) ^ np.uint32(0xEDB88320), made >> np.uint32(1))
    return made


_CRC = _crc_table()


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters: ASCII ones, or the two bytes of U+00C0 to U+00FF."""
    two = data == 0xC3
    inside = _IS_LETTER[data] | two
    inside[1:] |= two[:-1]
    return inside


def _hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, continued from ``begun``; all runs at once, a byte after the other."""
    lengths, out = ends - starts, np.empty(len(starts), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    longer = int(np.searchsorted(-lengths[order], -SHORT, "left"))
    for i in order[:longer].tolist():
        out[i] = zlib.crc32(lower[starts[i] : ends[i]].tobytes(), int(begun[i]))
    order = order[longer:]
    at, state, sizes = starts[order], ~begun[order].astype(np.uint32), lengths[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k
        state[:n] = _CRC[(state[:n] ^ lower[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def _pieces(part: X.Slice) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, offsets and number of the first text of stretches of a slice, cut where no letter is."""
    if len(part.data) <= PIECE or len(part) > 1:
        yield part.data, part.offsets, 0
        return
    at = 0
    while at < len(part.data):
        end = min(at + PIECE, len(part.data))
        while end < len(part.data):  # on to the next byte that is in no letter
            others = np.flatnonzero(~_letters(part.data[end - 1 : end + PIECE])[1:])
            if len(others):
                end += int(others[0])
                break
            end = min(end + PIECE, len(part.data))
        yield part.data[at:end], np.array([0, end - at]), 0
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, ids: list[str]) -> pa.Array:
    """The words of some texts, one for each run of letters that is long enough after it lost a letter or not."""
    inside = _letters(data)
    starts, ends = X.edges(inside, offsets)
    if not len(starts):
        return pa.array([], pa.string())
    lower = _LOWER[data]
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    of = np.searchsorted(offsets, starts, "right") - 1
    hashes = _hashes(lower, starts, ends, begun[of])
    points = np.flatnonzero(inside & ((data & 0xC0) != 0x80))  # where code points of runs begin
    first = np.searchsorted(points, starts)
    lengths = np.diff(np.append(first, len(points)))
    drops = hashes % np.uint32(DROPS) == 0
    lost = points[first[drops] + hashes[drops] % lengths[drops]]
    inside[lost] = False
    inside[lost[data[lost] == 0xC3] + 1] = False
    long = lengths - drops >= LEAST_LENGTH
    starts, ends = starts[long], ends[long]
    bytes_ = np.append(0, np.cumsum(inside, dtype=np.int64))
    sizes = bytes_[ends] - bytes_[starts]
    kept = np.flatnonzero(inside)
    text = lower[kept[X.ragged(bytes_[starts], sizes)]]
    bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(text))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns word, n: each word that occurs often enough in all texts. Tasks count their own words before the shuffle."""
    own = C.numbered(docs)
    few = own.select(F.coalesce(F.col(C.number_of(docs, id_col)).cast("string"), F.lit("")).alias("id"), F.col(C.number_of(docs, text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in X.slices(batch.column(1)):
                for data, offsets, first in _pieces(part):
                    counts = pc.value_counts(words_of(data, offsets, ids[part.rows[0] + first : part.rows[0] + first + len(offsets) - 1]))
                    held.append(pa.table([counts.field(0), counts.field(1)], ["word", "n"]))
                    size += len(counts)
                    if size > HELD:
                        held = [merged()]
                        size = held[0].num_rows
                        if 2 * size > HELD:
                            yield from held[0].to_batches()
                            held, size = [], 0
        if held:
            yield from merged().to_batches()

    return few.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def reduced(word: Column, symbols: int) -> Column:
    """A word in the reduced alphabet: each letter's symbol is a hash of it."""
    return F.translate(word, LETTERS, "".join(SYMBOLS[zlib.crc32(c.encode()) % symbols] for c in LETTERS))


def symbols_for(words: int) -> int:
    """How many symbols keep the words of one reduced form few: neighbourhoods grow with their number, groups of equal forms shrink with its powers."""
    return min(len(SYMBOLS), max(LEAST_SYMBOLS, int(np.ceil(words ** (1 / 6)))))


def _codes(column: pa.Array) -> Iterator[tuple[X.Slice, np.ndarray, np.ndarray]]:
    for part in X.slices(column, PIECE // 16):
        up, _ = X._power_table(len(part.data) + 2)
        total = np.zeros(len(part.data) + 1, np.uint64)
        np.cumsum(part.data.astype(np.uint64) * up[: len(part.data)], out=total[1:])
        yield part, total, up


def codes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each reduced word: a polynomial of its symbols."""
    found = []
    for part, total, _ in _codes(column):
        _, down = X._power_table(len(part.data) + 2)
        a, b = part.offsets[:-1], part.offsets[1:]
        found.append(X.mix((total[b] - total[a]) * down[a]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def neighbourhoods(column: pa.Array, symbols: int, one_side: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of reduced words and of all that one edit makes of them, each once, and the number of the word each comes from.

    An edit changes the polynomial's terms before and after its place in one way, so a hash comes from running sums. With
    one_side each pair of neighbours comes from one of the two: the longer, or of equal ones that with the lesser symbol
    at the place where they differ. An insertion in one word is a deletion in the other.
    """
    alphabet = np.frombuffer(SYMBOLS[:symbols].encode(), np.uint8)
    before = 0
    for part, total, up in _codes(column):
        _, down = X._power_table(len(part.data) + 2)
        data, sizes = part.data.astype(np.uint64), np.diff(part.offsets)
        own = np.arange(len(part))
        a, b = part.offsets[:-1], part.offsets[1:]
        of = np.repeat(own, sizes)
        at, start, end = np.arange(len(data)), np.repeat(a, sizes), np.repeat(b, sizes)
        same = np.zeros(len(data), bool)  # as the symbol before
        same[1:] = (data[1:] == data[:-1]) & (start[1:] == start[:-1])
        yield X.mix((total[b] - total[a]) * down[a]), own + before
        p = at[~same]  # of equal symbols side by side any deletion does the same
        yield X.mix(((total[p] - total[start[p]]) + (total[end[p]] - total[p + 1]) * down[1]) * down[start[p]]), of[p] + before
        whole = (total[end] - total[start]) * down[start]
        for c in alphabet.astype(np.uint64):
            p = at[data < c if one_side else data != c]
            yield X.mix(whole[p] + (c - data[p]) * up[p - start[p]]), of[p] + before
            if one_side:
                continue
            p = at[(at == start) | (np.append(c, data[:-1]) != c)]  # an insertion after the same symbol is one before it
            left, right = total[p] - total[start[p]], total[end[p]] - total[p]
            yield X.mix((left + c * up[p] + right * up[1]) * down[start[p]]), of[p] + before
            p = own[(sizes == 0) | (data[np.maximum(b - 1, 0)] != c)] if len(data) else own  # at the end
            yield X.mix((total[b[p]] - total[a[p]] + c * up[b[p]]) * down[a[p]]), p + before
        before += len(part)


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """Columns word, n, other, m: each word (and its number) with each one that is exactly one edit from it (and its number).

    Words that are one edit apart are so or equal when reduced. The neighbourhoods of all different reduced words meet the
    reduced words by hash, each pair from one side; the words of such pairs are compared themselves.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes(batch.column(2)).view(np.int64)), batch.column(2)], ["word", "n", "code", "reduced"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(1))
            for keys, of in neighbourhoods(batch.column(0), symbols, one_side=True):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[of])], ["code", "source"])

    own = C.written(words.select("word", "n", reduced(F.col("word"), symbols).alias("reduced")).mapInArrow(coded, "word string, n bigint, code bigint, reduced string"), "reduced-words")
    keys = own.select("reduced", "code").distinct().mapInArrow(around, "code bigint, source bigint")
    meeting = keys.join(own.select("code").distinct(), "code")
    asking = meeting.join(own.select(F.col("code").alias("source"), "word", "n"), "source").select("code", (F.col("code") == F.col("source")).alias("alike"), "word", "n")
    pairs = asking.join(own.select("code", F.col("word").alias("other"), F.col("n").alias("m")), "code")
    pairs = pairs.where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    ways = F.when(F.col("alike"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))  # words reduced alike meet both ways
    way = pairs.withColumn("way", F.explode(ways))
    return way.select(*(F.when(F.col("way"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("word", "other"), ("n", "m"), ("other", "word"), ("m", "n"))))


def roots(forms: DataFrame) -> DataFrame:
    """Columns word, root from word, form: where forms lead in the end. Each turn doubles the steps taken, so they are few."""
    now = C.written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = C.written(now.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int | None = None) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Runs of letters, A to Z in lower case, are words; a run whose CRC-32 after its document's id divides by DROPS loses a
    letter first, so that variants are there. Words of fewer than 5 letters or 3 occurrences are none. A form is the near
    word that occurs most, the first in code-point order of several, if it occurs twice as often or more. A null text
    has no words, a null id counts as an empty one; repeated rows count again; texts, runs and words may have any length;
    other columns don't matter; an empty table gives none. ``symbols`` is the size of the reduced alphabet, by default
    what the number of words asks for: it changes the work, not the result. Reduced words are compared by 64 bits, words
    themselves by their letters.
    """
    words = C.written(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, symbols or symbols_for(words.count()))
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("form")))
    each = near.groupBy("word").agg(F.any_value("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= FORM_RATIO * F.col("n")
    each = C.written(each.select("word", "n_near", F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")), "near-words")
    found = words.join(each, "word", "left").join(roots(each.where("form is not null").select("word", "form")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
