"""Best-fit packing of tokenised documents by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem is a histogram of at most `capacity`
entries, whatever the number of documents. The driver solves it: best-fit decreasing gives the incumbent, a
waste bound tells whether it can be beaten, and branch-and-bound completes bins around the largest length left
with undominated fillings. The solution is a table of patterns; each piece finds its slot by its rank among the
pieces of its length, which two small shuffles give.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, column, release, staged

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first

#: Groups that the pieces of one length are dealt into for ranking.
SALTS = 256
#: Words whose ids a worker remembers (some 40 bytes each, and as much again while a step looks its words up).
REMEMBERED = 100_000
#: Bytes of text that are coded at once: beside the table of known words, a worker's memory goes with this.
CODED_BYTES = STEP_BYTES
#: Search nodes of a round; bins tried at a node and fillings looked at for them in the first round; steps of the second.
NODES, WIDTH, TRIES, STEPS = 6_000, 4, 60, 20_000_000

# ---------------------------------------------------------------- bin completion


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Bins as (filling, how many alike); equal bins are handled together."""
    open_: dict[int, list[tuple[Filling, int]]] = {capacity: []}
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            spot = bisect_left(rooms, length)
            if spot == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                for many, bins in ((each, full), (rest, 1 if rest else 0)):
                    if bins:
                        room = capacity - many * length
                        if room not in open_ or room == capacity:
                            open_.setdefault(room, [])
                        if room not in rooms:
                            insort(rooms, room)
                        open_[room].append((((length, many),), bins))
                break
            room = rooms[spot]
            filling, bins = open_[room].pop()
            if not open_[room]:
                rooms.pop(spot)
            each = room // length
            take = min(bins, left // each)
            many = each
            if not take:
                take, many = 1, left
            if bins > take:
                open_[room].append((filling, bins - take))
                if room not in rooms:
                    insort(rooms, room)
            left -= take * many
            then = room - many * length
            open_.setdefault(then, []).append(((*filling, (length, many)), take))
            if then not in rooms:
                insort(rooms, then)
    return [(f, n) for group in open_.values() for f, n in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing goes below: total length, and what large lengths rule out for small ones."""
    n = np.zeros(capacity + 1, np.int64)
    for length, many in counts.items():
        n[length] = many
    total = np.cumsum(n * np.arange(capacity + 1))
    upto = np.cumsum(n)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        large = int(upto[-1] - upto[capacity - k])
        middle = int(upto[capacity - k] - upto[half])
        room = middle * capacity - int(total[capacity - k] - total[half])
        small = int(total[half] - total[k - 1])
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def _sums(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each place in lengths, bits of the sums up to room that pieces from there on can make."""
    mask, out = (1 << room + 1) - 1, [1]
    for x in reversed(lengths):
        bits, left, step = out[-1], min(counts[x], room // x), 1
        while left > 0:
            take = min(step, left)
            bits |= bits << take * x & mask
            left, step = left - take, 2 * step
        out.append(bits)
    return out[::-1]


def _fillings(counts: dict[int, int], room: int, most: int, tries: int | None = None, steps: list[int] | None = None) -> Iterator[tuple[int, dict[int, int]]]:
    """(waste, pieces of each length) of the undominated fillings of room that waste no more than most, least waste first.

    A table of the sums that lengths can make leads straight to fillings of each waste, without dead ends. A filling
    is dominated if a free length fits in what it leaves, or in place of one or two of its pieces. After `tries`
    fillings the search for more ends; if all of these are dominated, the first one is given. `steps` is what all
    searches together may still spend, in lengths compared.
    """
    lengths = sorted((x for x, many in counts.items() if many and x <= room), reverse=True)
    sums = _sums(lengths, counts, room)
    chosen: dict[int, int] = {}

    def dominated(waste: int) -> bool:
        held = list(chosen)
        spans = {0, *held, *(a + b for i, a in enumerate(held) for b in held[i + (chosen[a] == 1) :])}
        for x in lengths:
            if counts[x] > chosen.get(x, 0) and any(x - waste <= s < x for s in spans):
                return True
        return False

    def fill(k: int, left: int) -> Iterator[None]:
        if not left:
            yield
            return
        while k < len(lengths) and sums[k] >> left & 1:
            x = lengths[k]
            for many in range(min(counts[x], left // x), 0, -1):
                if sums[k + 1] >> left - many * x & 1:
                    chosen[x] = many
                    yield from fill(k + 1, left - many * x)
                    del chosen[x]
            k += 1

    spare, seen = None, 0
    for waste in range(min(room, most) + 1):
        for _ in fill(0, room - waste):
            seen += 1
            if not dominated(waste):
                spare = False
                yield waste, dict(chosen)
            elif spare is None:
                spare = waste, dict(chosen)
            if seen == tries:
                if spare:
                    yield spare
                return
            if steps is not None:
                steps[0] -= len(lengths) + 1
                if steps[0] < 0:
                    return


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """A packing of counts (length -> pieces) as (filling, bins alike).

    Exact when the second round ends within its nodes; else the best packing found, never worse than best-fit decreasing.
    The first round tries WIDTH bins at a node, repeated as often as they go or else used once, which keeps branches
    short. Unless that meets the bound, the second one tries every undominated bin. Both run whatever the number of
    pieces. Pieces that nothing else fits beside are set aside before.
    """
    counts = {x: n for x, n in counts.items() if n}
    alone = {x: n for x, n in counts.items() if x + min(counts) > capacity}
    counts = {x: n for x, n in counts.items() if x not in alone}
    best = best_fit_decreasing(counts, capacity)
    best_bins, bound = sum(n for _, n in best), lower_bound(counts, capacity) if counts else 0
    total = sum(x * n for x, n in counts.items())
    left, bins, waste, steps = Counter(counts), 0, 0, [STEPS]

    def options(first: bool) -> Iterator[tuple[int, dict[int, int], int]]:
        """(waste, pieces of each length, how often) of the bins that may come next, the best first."""
        largest, held = max(left), dict(left)
        held[largest] -= 1
        spare = (best_bins - 1) * capacity - total - waste
        for lost, need in _fillings(held, capacity - largest, spare, *((TRIES, None) if first else (None, steps))):
            need[largest] = need.get(largest, 0) + 1
            often = min((held[x] + (x == largest)) // many for x, many in need.items()) if first else 1
            # many bins at once must not waste more than is left to waste either
            often = min(often, spare // lost) if lost else often
            for times in (often, 1) if often > 1 else (1,):
                yield lost, need, times

    for first in (True, False):
        nodes_left = nodes
        # one bin a level: what may still come, how many came, and what stands; bins are taken out of and put back into one
        # count. A level holds a few bins and makes the next ones anew: thousands of levels must not hold a table of sums each
        levels: list[list] = [[iter(()), 0, []]] if left else []
        while levels and nodes_left and best_bins > bound:
            coming, came, stands = levels[-1]
            if stands:
                lost, need, times = stands.pop()
                for x, many in need.items():
                    left[x] += many * times
                bins, waste = bins - times, waste - lost * times
            found = next(coming, None)
            if found is None and not (first and came):
                more = list(islice(options(first), came, came + max(WIDTH, came)))
                levels[-1][:2] = iter(more), came + len(more)
                found = next(levels[-1][0], None)
            if found is None:
                levels.pop()
                continue
            nodes_left -= 1
            lost, need, times = found
            stands.append(found)
            for x, many in need.items():
                left[x] -= many * times
                if not left[x]:
                    del left[x]
            bins, waste = bins + times, waste + lost * times
            if not left:
                if bins < best_bins:
                    best_bins = bins
                    best = [(tuple(sorted(need.items(), reverse=True)), times) for _, _, ((_, need, times),) in levels]
            elif waste <= (best_bins - 1) * capacity - total:
                levels.append([iter(()), 0, []])
        left, bins, waste = Counter(counts), 0, 0
    return [*best, *((((x, 1),), n) for x, n in alone.items())]


# ---------------------------------------------------------------- tokens and pieces


#: Words of these characters are cut and folded here; all are composed, and lower case is one character for each.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_PLAIN = f"^[!-~{_LETTERS}]+$"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: A word of letters and what follows it, without letters, digits or the apostrophe that may begin a piece of its own.
_TAILED = f"^(?P<stem>[{_LETTERS}]+)(?P<tail>[!-&(-/:-@\\[-`{{-~]*)$"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte: itself if it can be shown, others in order from 256 on.
_BYTES = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], [*map(chr, _SHOWN), *(chr(256 + k) for k in range(256 - len(_SHOWN)))]))


def _gathered(ids: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids that begin at starts and are size long, one after another; and where each ends."""
    ends = np.cumsum(size)
    return ids[np.repeat(starts - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class _Encoder:
    """Ids of whitespace-separated words, remembered. The tokenizer drops whitespace, so words are independent.

    Arrow cuts texts and finds their distinct words; only those not yet known are coded, and a text's ids are gathered
    from the table of known words. Of Latin words in capitals or with a mark at the end, the lower-case word and the
    mark are looked up in turn. Words of ASCII and Latin letters go to the tokenizer's model piece by piece, all
    others through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # row 0 stands for the end of a text, row k + 1 for word k; the empty word has no ids
        self.words = pa.array([""], pa.large_string())
        self.ids, self.starts = np.array([end_id], np.uint32), np.array([0, 1, 1], np.int64)

    def _piece(self, piece: str) -> list[int]:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.model.tokenize(raw)]

    def _coded(self, words: list[str], plain: list[bool]) -> list[list[int]]:
        out = [
            [] if not ok else self._piece(word) if word.isalpha() else [i for piece in _PIECE.findall(word) for i in self._piece(piece)]
            for word, ok in zip(words, plain)
        ]
        odd = [k for k, ok in enumerate(plain) if not ok]
        for k in range(0, len(odd), 5000):
            part = odd[k : k + 5000]
            for at, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                out[at] = e.ids
        return out

    def _add(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rows = np.arange(len(words)) + len(self.words) + 1
        self.starts = np.concatenate([self.starts, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.words = pa.concat_arrays([self.words, words])
        return rows

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Row of each of distinct words in the table of known ones; new ones are added."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        rows = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        if not new.any():
            return rows
        fresh = words.filter(pa.array(new))
        plain = pc.match_substring_regex(fresh, _PLAIN)
        # what folds to another word, or to a word and its tail
        parts = pc.extract_regex(fresh, _TAILED)
        stem, tail = pc.utf8_lower(parts.field("stem")), parts.field("tail")
        other = pc.fill_null(pc.or_(pc.not_equal(stem, fresh), pc.not_equal(tail, "")), False)
        derived = pc.and_(other, parts.is_valid()).to_numpy(zero_copy_only=False)
        placed = np.empty(len(fresh), np.int64)
        if derived.any():
            both = pa.concat_arrays([stem.filter(pa.array(derived)), tail.filter(pa.array(derived))]).dictionary_encode()
            at = self._rows(both.dictionary)[both.indices.to_numpy()].reshape(2, -1).T.ravel()
            ids, ends = _gathered(self.ids, self.starts[at], (self.starts[1:] - self.starts[:-1])[at])
            placed[derived] = self._add(fresh.filter(pa.array(derived)), ids, ends[1::2])
        if not derived.all():
            rest, ok = fresh.filter(pa.array(~derived)), plain.filter(pa.array(~derived)).to_pylist()
            folded = pc.if_else(plain, pc.utf8_lower(fresh), fresh).filter(pa.array(~derived))
            coded = self._coded(folded.to_pylist(), ok)
            ends = np.cumsum(list(map(len, coded)))
            placed[~derived] = self._add(rest, np.fromiter(chain.from_iterable(coded), np.uint32, int(ends[-1])), ends)
        rows[new] = placed
        return rows

    def _forget(self, words: pa.Array, rows: np.ndarray) -> None:
        """Keeps only the words of the last step once there are too many; none, if these are too many as well."""
        if len(self.words) <= REMEMBERED:
            return
        words, rows = words.slice(0, len(words) if len(words) <= REMEMBERED else 0), rows[: len(words) if len(words) <= REMEMBERED else 0]
        named = pc.not_equal(words, "")
        rows = np.concatenate([[0, 1], rows[named.to_numpy(zero_copy_only=False)]])
        self.ids, ends = _gathered(self.ids, self.starts[rows], (self.starts[1:] - self.starts[:-1])[rows])
        self.starts, self.words = np.append(0, ends), pa.concat_arrays([pa.array([""], pa.large_string()), words.filter(named)])

    def step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, one after another; and where each text's end."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary)
        # each text's words (white space at its ends gives empty ones), then row 0
        last = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        at = np.insert(rows[coded.indices.to_numpy()], last, 0)
        flat, ends = _gathered(self.ids, self.starts[at], (self.starts[1:] - self.starts[:-1])[at])
        self._forget(coded.dictionary, rows)
        return flat, ends[last + np.arange(len(last))]

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text and the end id; a long one is coded in parts that end at white space."""
        parts, at = [], 0
        while len(text) - at > STEP_BYTES:
            gap = _GAP.search(text, at + STEP_BYTES)
            if gap is None:
                break
            parts.append(self.step(pa.array([text[at : gap.start()]], pa.large_string()))[0][:-1])
            at = gap.end()
        return np.concatenate([*parts, self.step(pa.array([text[at:]], pa.large_string()))[0]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without the end id."""
        flat, ends = self.step(pa.array(texts, pa.large_string()))
        return [flat[a : b - 1].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


_GAP = re.compile(r"[ \t-\r]")
_encoders: dict[tuple[str, int], _Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((path, end_id)) or _encoders.setdefault((path, end_id), _Encoder(path, end_id))
        dealt = 0
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text").fill_null("")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            low = 0
            while low < len(ids):
                high = max(low + 1, low + int(np.searchsorted(np.cumsum(size[low : low + 100_000]), CODED_BYTES)))
                if size[low] > CODED_BYTES:
                    flat = encoder.whole(texts[low].as_py())
                    ends = np.array([len(flat)])
                else:
                    flat, ends = encoder.step(texts.slice(low, high - low))
                long = np.diff(ends, prepend=0)
                many = -(-long // capacity)
                at = np.repeat(np.arange(len(long)), many)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, long[at] - start)
                first = (ends - long)[at] + start
                raw = memoryview(np.ascontiguousarray(flat)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                # equal rows of a table are spread too: the salt counts on through the task
                salt = (np.array(crc, np.int64) + np.arange(len(at)) + dealt) % SALTS
                dealt += len(at)
                out = [
                    ids.take(pa.array(at + low)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(np.array(crc, np.int64)), pa.array(salt.astype(np.int32)),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                low = high
                pa.default_memory_pool().release_unused()
            release()

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt and, if asked for, ids: every document's tokens and end_id, cut at capacity.

    salt deals the pieces of one length into SALTS groups.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + ", ids array<int>" * keep_ids
    return source.mapInArrow(_pieces(tokenizer, capacity, end_id, keep_ids), kinds)


def _place(table):
    """Adds sequence_id and offset to pieces that know their rank among those of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, many, base, offset = table.value
        for batch in batches:
            length = column(batch, "length").to_numpy()
            rank = column(batch, "rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            within = rank - first[at]
            place = pa.array(offset[at] + within % many[at] * length)
            rest = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in rest), pa.array(base[at] + within // many[at]), place],
                names=[*rest, "sequence_id", "offset"],
            )

    return run


def _slots(packing: list[tuple[Filling, int]]) -> tuple[np.ndarray, ...]:
    """For each length and pattern: key, first rank, pieces a bin, first sequence, offset in the sequence."""
    used: Counter[int] = Counter()
    rows, base = [], 0
    for filling, bins in packing:
        offset = 0
        for length, many in filling:
            rows.append(((length << 44) + used[length], used[length], many, base, offset))
            used[length] += many * bins
            offset += many * length
        base += bins
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """One row for each piece of each row of docs (doc_id long, text string): doc_id, piece, start, length, ids_crc32,
    ids if asked for, sequence_id, offset. Sequences are gapless from offset 0 and at most capacity long.

    A null or empty text is end_id alone. Rows that repeat a doc_id or have none are packed like any other.
    Strings of special tokens count as ordinary text. Other columns are ignored; an empty table gives an empty one.
    `tokenizer` names a tokenizers file whose tokens never span whitespace.
    """
    salted = staged(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    pieces = salted.drop("salt")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows
    table = docs.sparkSession.sparkContext.broadcast(_slots(complete_bins(histogram, capacity)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("nth", F.row_number().over(order)).join(starts, ["length", "salt"])
        .select(*pieces.columns, (F.col("first") + F.col("nth") - 1).alias("rank"))
    )
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(_place(table), f"{kinds}, sequence_id long, offset long")
