"""Shared plumbing: durable intermediate tables, connected components, vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import clear_staged, drop_staged, scratch_dir, staged  # noqa: F401

#: Rows of the broadcast table of hashed ids (12 bytes each).
WORDS = 1 << 18


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _hashed(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Column]:
    """docs with a column of hashed bits of ids, at most WORDS rows of 64 bits and so broadcast; and the test of them."""
    word_name, bits_name = free_name("id_word", docs.columns), free_name("id_bits", docs.columns)
    words = F.pmod(F.xxhash64("doc_id"), F.lit(WORDS)).cast("int").alias(word_name)
    bit = F.pmod(F.shiftright(F.xxhash64("doc_id"), 40), F.lit(64)).cast("int")
    bits = ids.groupBy(words).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits_name))
    joined = docs.withColumn(word_name, words).join(F.broadcast(bits), word_name, "left")
    return joined, F.coalesce(F.getbit(bits_name, bit) == 1, F.lit(False))


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids, which repeats none. Most others are held back before texts are shuffled."""
    joined, likely = _hashed(docs, ids)
    return joined.where(likely).select(*docs.columns).join(ids, "doc_id", "left_semi").select(*docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is null or not in ids. Most of these pass without a shuffle of texts."""
    joined, likely = _hashed(docs, ids)
    unsure = joined.where(likely).select(*docs.columns).join(ids, "doc_id", "left_anti").select(*docs.columns)
    return joined.where(~likely).select(*docs.columns).unionByName(unsure)


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node reachable.

    Alternating large-star and small-star steps: each step re-points neighbours to the least node known,
    so long chains shrink in logarithmically many rounds and no group is ever gathered in one task.
    Each round is written to the shared folder.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = staged(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_staged(now)
        now = then
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row.n, row.h):
            break
        mark = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


# ---------------------------------------------------------------- vectorised words

#: Bytes of text that one vectorised step takes at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x + U64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, STEP_BYTES + 1)
        steps = np.full(size, U64(_BASE))
        steps[0] = 1
        powers = np.multiply.accumulate(steps)
        steps[1:] = U64(_BASE_INV)
        inverse = np.multiply.accumulate(steps)
        if size > 8 * STEP_BYTES:
            return powers, inverse  # for one very long text only
        _powers, _inverse = powers, inverse
    return _powers, _inverse


#: Bytes 9-13 and 32 part words.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_VALUES = mix(np.arange(256, dtype=U64), 7)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]


class Words:
    """Words of several texts: hash, byte span, and the first word of each text (first has one more entry)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACES, fold: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~parts[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        self.start = np.flatnonzero(inside & (before | edge[:n]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        powers, inverse = power_tables(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((_FOLDED if fold else _VALUES)[data] * powers[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        total = len(self.hash)
        if total < k:
            return np.zeros(0, U64), np.zeros(0, bool)
        powers, inverse = power_tables(total + 1)
        sums = np.zeros(total + 1, U64)
        np.cumsum(self.hash * powers[:total], out=sums[1:])
        at = np.arange(total - k + 1)
        text = np.searchsorted(self.first, at, side="right")
        return mix((sums[k:] - sums[:-k]) * inverse[: total - k + 1], k), self.first[text] >= at + k


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system, as workers live on between stages: Arrow's, and what malloc keeps (glibc only)."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most `most` bytes, or of one longer row; null is empty."""
    texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

