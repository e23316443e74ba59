"""Periodic runs of words: stretches that repeat a period of q words at least four times over.

For each period q, the places of a text where the word equals the word q further on form stretches, and a run of length
L is one of L - q places. As L is at least max(6, 4q), such a stretch is at least max(6, 4q) - q long and covers a
multiple of that number: these multiples are the grid of q, and all grids together have n log n points, a harmonic sum.
Points where the words differ go at once. From all others, of all periods and texts of a step together, the stretch is
measured both ways by binary search over prefix hashes, then every word of it is compared. A run of several times a
period is the same stretch as the run of the period, so of equal stretches the least period stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, column, mix, power_tables

#: Least words of a run, and least times that it holds its period.
LEAST, TIMES = 6, 4
#: Bytes of text, grid points, and words compared that one vectorised step takes; a longer text or run is a step of its own.
TEXT_STEP, POINTS, COMPARED = 1 << 20, 1 << 19, 1 << 22

RUNS = "array<struct<start: long, length: long, period: long>>"

#: (doc_ids, words of each text) -> (first looped word, period) of each text; a period of 0 leaves the text as it is.
Loops = Callable[[list[int | None], np.ndarray], tuple[np.ndarray, np.ndarray]]


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of `many` numbers from `first` on, for each owner."""
    owner = np.repeat(np.arange(len(many)), many)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)


class _Step:
    """Texts as numbered words: text t's are codes[offsets[t]:offsets[t + 1]]; equal words have equal codes."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        self.codes, self.offsets = codes, offsets
        self.powers, _ = power_tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(mix(codes.astype(U64)) * self.powers[: len(codes)], out=self.sums[1:])

    def _equal(self, at: np.ndarray, size: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether `size` words from `at` on hash as those q further on do."""
        s = self.sums
        return (s[at + size] - s[at]) * self.powers[q] == s[at + q + size] - s[at + q]

    def _reach(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest equal stretch, up to `most` words, that begins at `at` or, going back, ends before it."""
        low, high = np.zeros_like(most), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) // 2
            same = self._equal(at[open_] - middle if back else at[open_], middle, q[open_])
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low

    def _exact(self, text: int, q: int) -> np.ndarray:
        """(start, length, q) of the runs of one text and period, word by word: for hashes that deceive."""
        a, b = self.offsets[text], self.offsets[text + 1]
        apart = np.flatnonzero(self.codes[a : b - q] != self.codes[a + q : b])
        edges = np.concatenate([[-1], apart, [b - a - q]])
        gap = np.diff(edges) - 1
        long = gap + q >= np.maximum(LEAST, TIMES * q)
        return np.stack([a + edges[:-1][long] + 1, gap[long] + q, np.full(long.sum(), q)], 1)

    def _true(self, start: np.ndarray, length: np.ndarray, q: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether every word of a run equals that q further on, and the words beside it do not go on."""
        c, first, last = self.codes, self.offsets[text], self.offsets[text + 1]
        end = start + length
        ok = (start == first) | (c[start - 1] != c[start - 1 + q])
        ok &= (end == last) | (c[end - q] != c[np.minimum(end, len(c) - 1)])
        size = length - q
        k = 0
        while k < len(size):
            then = max(k + 1, k + int(np.searchsorted(np.cumsum(size[k:]), COMPARED)))
            owner, at = spread(start[k:then], size[k:then])
            wrong = owner[c[at] != c[at + q[k:then][owner]]]
            ok[k + wrong] = False
            k = then
        return ok

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows (start, length, period), start counted in codes, and the text of each; by text, start and period."""
        n = np.diff(self.offsets)
        # periods of each text: enough words for four of them, and for six words
        text, q = spread(np.ones(len(n), np.int64), np.where(n >= LEAST, n // TIMES, 0))
        stride = np.maximum(LEAST, TIMES * q) - q
        points = -(-(n[text] - q) // stride)
        found, texts, known = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], np.zeros(0, np.int64)
        ends, k = np.cumsum(points), 0
        while k < len(points):
            then = max(k + 1, int(np.searchsorted(ends, ends[k] - points[k] + POINTS)))
            owner, nth = spread(np.zeros(then - k, np.int64), points[k:then])
            t, period = text[k:then][owner], q[k:then][owner]
            at = self.offsets[t] + nth * stride[k:then][owner]
            same = self.codes[at] == self.codes[at + period]
            at, t, period = at[same], t[same], period[same]
            first, last = self.offsets[t], self.offsets[t + 1]
            back = self._reach(at, period, at - first, True)
            ahead = self._reach(at, period, last - period - at, False)
            length = back + ahead + period
            long = length >= np.maximum(LEAST, TIMES * period)
            rows, t = np.stack([(at - back)[long], length[long], period[long]], 1), t[long]
            # a stretch is compared once, as one of its least period; if that is a hash's deceit, of the next
            key = (rows[:, 0] << 31) + rows[:, 1]
            order = np.lexsort((rows[:, 2], key))
            rows, t, key = rows[order], t[order], key[order]
            while len(rows):
                new = np.ones(len(rows), bool)
                new[1:] = key[1:] != key[:-1]
                fresh = new & ~np.isin(key, known)
                true = self._true(*rows[fresh].T, t[fresh])
                good, bad = rows[fresh][true], rows[fresh][~true]
                found.append(good)
                texts.append(t[fresh][true])
                known = np.union1d(known, key[fresh][true])
                for a, b in {(int(x), int(y)) for x, y in zip(t[fresh][~true], bad[:, 2])}:
                    found.append(self._exact(a, b))
                    texts.append(np.full(len(found[-1]), a))
                if not len(bad):
                    break
                stay = ~new & np.isin(key, key[fresh][~true])
                rows, t, key = rows[stay], t[stay], key[stay]
            k = then
        rows, texts = np.concatenate(found), np.concatenate(texts)
        # the least period of equal stretches
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, texts = rows[order], texts[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows, texts = rows[new], texts[new]
        order = np.lexsort((rows[:, 2], rows[:, 0]))
        return rows[order], texts[order]


def by_document(doc_ids: list[int | None], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loops of a tenth of all documents: h is the crc32 of the decimal doc_id, first and period follow from h // 10."""
    h = np.array([1 if d is None else zlib.crc32(b"%d" % d) for d in doc_ids], np.int64)
    g, some = h // 10, (h % 10 == 0) & (n > 0)
    first = np.where(some, g % np.maximum(n, 1), 0)
    return first, np.where(some, 1 + (n - first) // (3 + g % 8), 0)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each text's words among them, and where each text's begin."""
    cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = cut.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.zeros(len(codes) + 1, np.int64)
    empty = pc.index(coded.dictionary, "").as_py()  # stands for white space at an end
    np.cumsum(codes != empty, out=sums[1:])
    ends = np.cumsum(np.concatenate([[0], pc.list_value_length(cut).to_numpy(zero_copy_only=False)]))
    return coded.dictionary, codes[codes != empty], sums[ends]


def _looped(codes: np.ndarray, offsets: np.ndarray, first: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words from first on are those of one period from there, over and over, where the period is not 0."""
    n = np.diff(offsets)
    owner, nth = spread(np.zeros(len(n), np.int64), n)
    a, p = first[owner], period[owner]
    moved = np.where((p > 0) & (nth >= a), a + (nth - a) % np.maximum(p, 1), nth)
    return codes[offsets[:-1][owner] + moved]


def _runs(loops: Loops | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text").fill_null("")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < len(ids):
                before = int(size[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(size, before + TEXT_STEP)))
                yield _found(ids.slice(low, high - low), texts.slice(low, high - low), loops)
                low = high
        pa.default_memory_pool().release_unused()  # workers live on between stages

    return run


def _found(ids: pa.Array, texts: pa.Array, loops: Loops | None) -> pa.RecordBatch:
    words, codes, offsets = _words(texts)
    if loops:
        codes = _looped(codes, offsets, *loops(ids.to_pylist(), np.diff(offsets)))
    rows, owner = _Step(codes, offsets).runs()
    # a word goes if a run holds it after its first period
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[offsets]
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words.take(pa.array(codes[kept]))), pa.scalar(" ", pa.large_string()))
    many = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ids)))])
    start = rows[:, 0] - offsets[owner]
    row = pa.StructArray.from_arrays([pa.array(start), pa.array(rows[:, 1]), pa.array(rows[:, 2])], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), row)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), runs, text.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, loops: Loops | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, by start, then period) and collapsed, one row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, told apart by case. A run is a stretch with least period q of at least max(6, 4q) words
    that goes no further on either side; collapsed holds the words that no run has after its first q, joined by one
    space. A null or empty text has no words and runs and an empty collapsed text. Rows that repeat a doc_id or have none
    are like any other; other columns are ignored; an empty table gives an empty one. A text is one task's work in
    memory of about 100 bytes a word, however long. loops, if given, rewrites words before runs are sought.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_runs(loops), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def greatest(runs: Column) -> Column:
    """The run that holds its period most times; of equals the first, then that of the least period."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.reduce(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, run: F.when(better(best, run), run).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run's start, length, period and exponent_milli, and digests of all runs and of what is left."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", "runs", "collapsed", greatest(F.col("runs")).alias("best"), lines.alias("lines"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
