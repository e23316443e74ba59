"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share enough runs of LEAST_TILE words for tiles to cover the item are compared: the
longest unmarked common run of words is marked in both, again and again, until none of LEAST_TILE words is left. Runs are found by running
Karp-Rabin hashes, whose prefix sums give the hash of any run at once. Tiles may lie in any order, so passages
whose sentences were moved are caught: an item is leaked if its tiles cover enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, mix, power_tables, text_steps

LEAST_TILE, COVERAGE = 3, 0.8
#: Bytes of benchmark text that are broadcast at a time; a larger benchmark is taken in so many more passes.
BLOCK_BYTES = 8 << 20

#: Letters, digits and all bytes from 128 on make words; case is folded.
PARTS = np.ones(256, bool)
PARTS[48:58] = PARTS[65:91] = PARTS[97:123] = PARTS[128:] = False


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    powers, inverse = power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return (sums[size:] - sums[:-size]) * inverse[: len(words) - size + 1]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs without a marked word."""
    sums = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=sums[1:])
    return np.flatnonzero(sums[size:] == sums[:-size])


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """(item start, doc start, words) of the tiles between two arrays of word hashes, longest first.

    Of tiles of one length, the first in the item goes to the first place free in the document.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    # only words of the document inside a common run of `least` words can be in a tile; breaks keep runs apart
    common = np.isin(_run_hashes(doc, least), _run_hashes(item, least))
    cover = np.zeros(len(doc) + 1, np.int64)
    at = np.flatnonzero(common)
    cover[at] += 1
    cover[at + least] -= 1
    kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    if not len(kept):
        return []
    gap = np.flatnonzero(np.diff(kept) > 1) + 1
    place = np.insert(kept, gap, -1)
    part = np.where(place < 0, U64(0), doc[place])
    item_marked, doc_marked = np.zeros(len(item), bool), place < 0
    tiles = []

    def matches(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = _free(item_marked, size), _free(doc_marked, size)
        ha, hb = _run_hashes(item, size)[a], _run_hashes(part, size)[b]
        return a[np.isin(ha, hb)], b, hb

    high = min(len(item), len(part))
    while True:
        low, top = least - 1, high  # the longest size with a match lies in (low, top]
        while low < top:
            middle = (low + top + 1) // 2
            if len(matches(middle)[0]):
                low = middle
            else:
                top = middle - 1
        if low < least:
            return tiles
        high = low
        starts, b, hb = matches(low)
        for i in starts.tolist():
            if item_marked[i : i + low].any():
                continue
            mine = _run_hashes(item[i : i + low], low)[0]
            for j in b[hb == mine].tolist():
                if not doc_marked[j : j + low].any():
                    item_marked[i : i + low] = doc_marked[j : j + low] = True
                    tiles.append((i, int(place[j]), low))
                    break


class Items:
    """A block of benchmark items as executors use it."""

    def __init__(self, ids: list, texts: list[str]):
        data = "".join(texts).encode()
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        words = Words(np.frombuffer(data, np.uint8), offsets, PARTS, fold=True)
        self.ids = ids
        self.words = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(texts))]
        size = np.diff(words.first)
        self.runs = [_run_hashes(w, min(LEAST_TILE, len(w))) for w in self.words]
        self.needs = [int(np.ceil(COVERAGE * len(w))) for w in self.words]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {min(LEAST_TILE, int(s)) for s in size if s}:
            runs, whole = words.runs(n)
            owner = np.searchsorted(words.first, np.arange(len(runs)), side="right") - 1
            on = np.flatnonzero(whole & ((n == LEAST_TILE) | (size[owner] == n)))
            # tiles that cover an item have a run in n words of them; without so many of its commonest runs the
            # others still hold one
            _, back, often = np.unique(runs[on], return_inverse=True, return_counts=True)
            on = on[np.lexsort((often[back], owner[on]))]
            spared = np.array([-(-need // n) - 1 for need in self.needs], np.int64)[owner[on]]
            first = np.searchsorted(owner[on], owner[on])
            on = on[np.arange(len(on)) - first < size[owner[on]] - n + 1 - spared]
            order = np.argsort(runs[on], kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(runs[on] & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[n] = runs[on][order], owner[on][order], bits

    def covers(self, item: int, runs: np.ndarray) -> bool:
        """Whether an item's runs that are among those of a text (distinct, in order) cover enough of its words."""
        own, n = self.runs[item], min(LEAST_TILE, len(self.words[item]))
        held = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, own), len(runs) - 1)] == own)
        cover = np.zeros(len(self.words[item]) + 1, np.int64)
        cover[held] += 1
        np.subtract.at(cover, held + n, 1)
        return np.count_nonzero(np.cumsum(cover[:-1])) >= self.needs[item]

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) of the leaked items of each text."""
        words = Words(data, offsets, PARTS, fold=True)
        pairs = [np.zeros((0, 2), np.int64)]
        for n, (seeds, owner, bits) in self.seeds.items():
            runs, whole = words.runs(n)
            at = np.flatnonzero(whole & bits[(runs & U64((1 << 20) - 1)).astype(np.int64)])
            left, right = np.searchsorted(seeds, runs[at]), np.searchsorted(seeds, runs[at], side="right")
            text = np.searchsorted(words.first, at, side="right") - 1
            # each seed once a text
            hit = np.flatnonzero(right > left)
            once = np.unique(np.stack([text[hit], left[hit], right[hit]], axis=1), axis=0)
            for k in range(0, len(once), 4096):
                of, low, high = once[k : k + 4096].T
                many = high - low
                spot = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
                pairs.append(np.unique(np.stack([np.repeat(of, many), owner[spot]], axis=1), axis=0))
        found = []
        now, runs = -1, {}
        for text, item in np.unique(np.concatenate(pairs), axis=0).tolist():
            own = words.hash[words.first[text] : words.first[text + 1]]
            if text != now:
                now, runs = text, {}
            n = min(LEAST_TILE, len(self.words[item]))
            if n not in runs:
                runs[n] = np.unique(_run_hashes(own, n))
            if not self.covers(item, runs[n]):
                continue
            tiles = greedy_tiles(self.words[item], own)
            if sum(t[2] for t in tiles) >= COVERAGE * len(self.words[item]):
                found.append((text, item, tiles))
        return found


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of about BLOCK_BYTES; items without text are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null and text <> ''")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield Items([r.item_id for r in rows], [r.text for r in rows])


_TILE = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])


def _find(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for batch in batches:
            ids = column(batch, "doc_id")
            for i, _, data, offsets in text_steps(column(batch, "text")):
                rows = items.leaks(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([t + i for t, _, _ in rows], pa.int64())),
                        pa.array([items.ids[k] for _, k, _ in rows], pa.int64()),
                        pa.array([len(items.words[k]) for _, k, _ in rows], pa.int64()),
                        pa.array([sum(x[2] for x in t) for _, _, t in rows], pa.int64()),
                        pa.array([[dict(zip(("item_start", "doc_start", "words"), x)) for x in t] for _, _, t in rows], pa.list_(_TILE)),
                    ],
                    names=["doc_id", "item_id", "item_words", "covered_words", "tiles"],
                )

    return run


_LEAKS = "doc_id long, item_id long, item_words long, covered_words long, tiles array<struct<item_start:int,doc_start:int,words:int>>"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles: one row for each leaked item of each row of docs.

    docs has doc_id long and text string, benchmark item_id long and text string; other columns are ignored. An
    item leaks if tiles of LEAST_TILE words or more (all words, of a shorter item) cover COVERAGE of its words. Null, empty and wordless texts and items have no leaks. Repeated rows give
    repeated leaks. Empty tables give empty ones.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    found = None
    for items in item_blocks(benchmark):
        part = source.mapInArrow(_find(context.broadcast(items)), _LEAKS)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _LEAKS)


def is_leaked(text: Column, items: Items, spark) -> Column:
    """Whether a text leaks any item of the block."""
    sent = spark.sparkContext.broadcast(items)

    @F.arrow_udf("boolean")
    def leaked(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for i, _, data, offsets in text_steps(texts):
            for t, _, _ in sent.value.leaks(data, offsets):
                out[i + t] = True
        return pa.array(out)

    return leaked(text)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs (text, any other columns) that leak no item of benchmark (item_id, text); columns stay.

    Null, empty and wordless texts stay, and so do all rows if the benchmark has no words. Repeated rows stay or go alike.
    """
    for items in item_blocks(benchmark):
        docs = docs.where(~is_leaked(F.col("text"), items, docs.sparkSession))
    return docs
