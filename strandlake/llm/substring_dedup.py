"""Removal of long word windows that repeat anywhere, with a count-min prefilter.

A window of 35 words is sampled by its anchor: the least hashed run of 8 words inside it. Equal windows hold
equal anchors at equal places, so the number of anchor occurrences never falls below the number of window
occurrences. Partitions sketch their anchors; the sketches are merged by hash range into one blocked count-min
table whose counters stop at 2. Only windows whose anchor is estimated repeated are grouped exactly, by two
hashes of all their words; groups of one row are false alarms and are handed back to their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, mix, text_steps

ANCHOR = 8
DEPTH = 4
#: Counters for each anchor, and the most bytes that the merged sketch may take (four 2-bit counters a byte).
CELLS, MOST_BYTES = 8, 1 << 27
BLOCK_BYTES = 1 << 14


def _windows(data: np.ndarray, offsets: np.ndarray, window: int):
    """Of all windows: hash, second hash, text; their anchor's hash, and the word index of the anchor."""
    w = Words(data, offsets)
    hashes, whole = w.runs(window)
    at = np.flatnonzero(whole)
    text = np.searchsorted(w.first, at, side="right") - 1
    if not len(at):
        return w, at, text, *(np.zeros(0, U64) for _ in range(3)), at
    runs = w.runs(ANCHOR)[0]
    span = window - ANCHOR + 1
    least = sliding_window_view(runs, span)
    place = np.empty(len(least), np.int64)
    for k in range(0, len(least), 1 << 15):
        place[k : k + (1 << 15)] = least[k : k + (1 << 15)].argmin(axis=1)
    place = place[at] + at
    second = mix(w.hash, 5)
    sums = np.zeros(len(second) + 1, U64)
    odd = np.arange(1, 2 * len(second), 2, dtype=U64)
    np.cumsum(second * odd, out=sums[1:])
    flat = np.zeros(len(second) + 1, U64)
    np.cumsum(second, out=flat[1:])
    # sum over the window of (1, 3, 5, ...) * second, whatever the window's place
    other = sums[at + window] - sums[at] - (flat[at + window] - flat[at]) * (at.astype(U64) * U64(2))
    return w, at, text, hashes[at], mix(other, 6) >> U64(32), runs[place], place


def _anchors(window: int, blocks: int):
    """One row for each block: the anchors seen in this partition and whether they came twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            seen, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block = (seen >> U64(40)) % U64(blocks)
            order = np.argsort(block, kind="stable")
            seen, count, block = seen[order], count[order], block[order]
            names, first = np.unique(block, return_index=True)
            ends = np.append(first[1:], len(seen))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(names.astype(np.int64)),
                    pa.array([seen[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    pa.array([np.minimum(count[a:b], 2).astype(np.uint8).tobytes() for a, b in zip(first, ends)], pa.binary()),
                ],
                names=["block", "anchors", "counts"],
            )

        for batch in batches:
            for _, _, data, offsets in text_steps(column(batch, "text")):
                *_, anchor, place = _windows(data, offsets, window)
                fresh = np.ones(len(place), bool)
                fresh[1:] = place[1:] != place[:-1]
                held.append(anchor[fresh])
                if sum(map(len, held)) > 1 << 20:
                    yield flush()
        if held:
            yield flush()

    return run


def _cells(anchors: np.ndarray, width: int) -> np.ndarray:
    """Counters of each anchor in its block, one a row of the sketch; width counters a row."""
    return np.stack([mix(anchors, 60 + r) % U64(width) + U64(r * width) for r in range(DEPTH)]).astype(np.int64)


def _merge(width: int):
    """Sums the sketches of a block that stand in one partition, stopping at 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, anchors, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = blocks.setdefault(block, np.zeros(DEPTH * width, np.uint8))
                each = np.frombuffer(counts, np.uint8)
                for row in _cells(np.frombuffer(anchors, U64), width):
                    added = np.bincount(row, weights=each, minlength=len(total))
                    np.minimum(total + np.minimum(added, 2).astype(np.uint8), 2, out=total)
        for block, total in blocks.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary())],
                names=["block", "twice"],
            )

    return run


class _Sketch:
    """The merged sketch as executors use it: for each counter, whether it reached 2."""

    def __init__(self, blocks: int, width: int, bits: np.ndarray):
        self.blocks, self.width, self.bits = blocks, width, bits

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        block = ((anchors >> U64(40)) % U64(self.blocks)).astype(np.int64) * (DEPTH * self.width)
        found = np.ones(len(anchors), bool)
        for row in _cells(anchors, self.width):
            at = row + block
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _candidates(window: int, sketch):
    """(h1, h2, n, doc_id, key) of windows estimated repeated, equal ones of a step added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "key")
            for i, _, data, offsets in text_steps(column(batch, "text")):
                _, _, text, h1, h2, anchor, _ = _windows(data, offsets, window)
                on = np.flatnonzero(sketch.value.repeated(anchor))
                order = on[np.lexsort((h2[on], h1[on]))]
                h1, h2, text = h1[order], h2[order], text[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                first = np.flatnonzero(fresh)
                count = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[first].view(np.int64)),
                        pa.array(h2[first].astype(np.uint32).view(np.int32)),
                        pa.array(np.minimum(count, 2).astype(np.int32)),
                        ids.take(pa.array(text[first] + i)), keys.take(pa.array(text[first] + i)),
                    ],
                    names=["h1", "h2", "n", "doc_id", "key"],
                )

    return run


def _removed(window: int, sketch):
    """Marks and removes the covered words; h1 and h2 list the document's candidates that came once only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, once1, once2 = (column(batch, c) for c in ("doc_id", "h1", "h2"))
            for i, j, data, offsets in text_steps(column(batch, "text")):
                w, at, text, h1, h2, anchor, _ = _windows(data, offsets, window)
                on = sketch.value.repeated(anchor)
                for d in np.unique(text[on]):
                    if once1[int(d) + i].is_valid:
                        a, b = np.searchsorted(text, [d, d + 1])
                        single = set(zip(once1[int(d) + i].as_py(), once2[int(d) + i].as_py()))
                        mine = np.flatnonzero(on[a:b]) + a
                        keys = zip(h1[mine].view(np.int64).tolist(), h2[mine].astype(np.uint32).view(np.int32).tolist())
                        on[mine] = [k not in single for k in keys]
                cover = np.zeros(len(w.hash) + 1, np.int64)
                cover[at[on]] += 1
                cover[at[on] + window] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                size = np.diff(w.first)
                lost = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (size > 0) if j > i else size
                raw = data.tobytes()
                texts = []
                for d in range(j - i):
                    words = raw[offsets[d] : offsets[d + 1]].split()
                    if lost[d]:
                        words = compress(words, ~gone[w.first[d] : w.first[d + 1]])
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(size), pa.array(lost), pa.array(texts, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 bytes): one row for each row of docs (doc_id long, text string).

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if any window of `window` words over it also starts anywhere
    else, in the same text too; windows are judged on the input. Null, empty and short texts lose nothing. Rows
    that repeat a doc_id, or have none, are texts of their own: a repeated row repeats its windows. Other columns
    are ignored. An empty table gives an empty one.
    The sketch grows with the corpus up to MOST_BYTES; past that it only lets more windows through to the exact
    grouping, so the result stays the same.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    bytes_ = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    anchors = max(1024, bytes_ // 6 * 2 // (window - ANCHOR + 2))  # a word of six bytes or more with its space
    size = min(MOST_BYTES, max(BLOCK_BYTES, CELLS * anchors // 8))
    blocks = -(-size // BLOCK_BYTES)
    width = BLOCK_BYTES * 8 // DEPTH
    parts = source.select("text").mapInArrow(_anchors(window, blocks), "block long, anchors binary, counts binary")
    merged = parts.repartition("block").mapInArrow(_merge(width), "block long, twice binary")
    bits = np.zeros(blocks * BLOCK_BYTES, np.uint8)
    for row in merged.collect():  # MOST_BYTES at most
        bits[row.block * BLOCK_BYTES : (row.block + 1) * BLOCK_BYTES] = np.frombuffer(row.twice, np.uint8)
    sketch = spark.sparkContext.broadcast(_Sketch(blocks, width, bits))

    # rows that share a doc_id, or have none, are told apart by their texts
    keyed = source.withColumn("key", F.xxhash64("text"))
    found = keyed.mapInArrow(_candidates(window, sketch), "h1 long, h2 int, n int, doc_id long, key long")
    once = (
        found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.first(F.struct("doc_id", "key")).alias("at")).where("n = 1")
        .groupBy(F.col("at.doc_id").alias("own"), F.col("at.key").alias("own_key"))
        .agg(F.collect_list("h1").alias("h1"), F.collect_list("h2").alias("h2"))  # of one text
    )
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key"))
    joined = keyed.join(once.hint("shuffle_hash"), same, "left").select("doc_id", "text", "h1", "h2")
    return joined.mapInArrow(_removed(window, sketch), "doc_id long, n_words long, n_removed long, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of removed; nothing kept has the digest of nothing."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
