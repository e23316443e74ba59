"""Greedy parse of sequences into matches and literals against a reference, and its inverse.

The parse is sequential within a file, so each file is one row of an Arrow batch; files are dealt over tasks. Places
where no seed can match are found for a whole file at once. The reference's index is built once a worker. Decoding is relational: a join with the reference and an ordered concat.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import MAX_SEED_N, MIN_AFTER, MIN_MATCH
from .matching import MOST_BROADCAST, spread

#: Residues in a row of a reference that is joined in chunks.
CHUNK = 1 << 16

TUPLES = "file_id long, tuple_no long, kind string, ref_pos long, len long, lit string, out_start long"

Tuple = tuple[str, int | None, int, str | None]  # kind, ref_pos from 1, length, literal


def common_length(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the equal run from a[i] and b[j] on; compared in growing steps."""
    done, step, most = 0, 16, min(len(a) - i, len(b) - j)
    if most <= 0:
        return 0
    while done < most:
        size = min(step, most - done)
        x, y = a[i + done : i + done + size], b[j + done : j + done + size]
        if x == y:
            done += size
            step *= 2
        elif size == 1:
            return done
        else:
            step = max(1, size // 2)
            if a[i + done : i + done + step] == b[j + done : j + done + step]:
                done += step
                step = 1 if step == 1 else step // 2
    return done


def _encoded(sequence: str, name: str) -> bytes:
    if not sequence.isascii():
        raise ValueError(f"{name} holds residues beyond ASCII")
    return sequence.encode()


def _hashes(raw: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k residues, from prefix sums; equal runs have equal hashes."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return out


#: Kinds of spans in the order of their codes.
KINDS = ("LIT", "MATCH", "N_RUN", "n_RUN")
LITERALS, MATCH, N_RUN, LOWER_N_RUN = range(4)


class Reference:
    """A reference with the places of its k-mers, low in N."""

    def __init__(self, sequence: str, k: int = MIN_MATCH, most_n: int = MAX_SEED_N):
        self.raw, self.k = _encoded(sequence, "the reference"), k
        many = np.frombuffer(self.raw, np.uint8)
        ns = np.concatenate([[0], np.cumsum((many == 78) | (many == 110))])
        rich = (ns[k:] - ns[:-k] > most_n).tolist() if len(many) >= k else []
        self.places: dict[bytes, list[int]] = {}
        for p, over in enumerate(rich):
            if not over:
                self.places.setdefault(self.raw[p : p + k], []).append(p)
        self.seeds = np.unique(_hashes(self.raw, k))
        self.runs = re.compile(rb"N{%d,}|n{%d,}" % (k, k))

    def _stops(self, alt: bytes) -> np.ndarray:
        """Places of alt where a seed may match or a run of N begins or goes on for k residues; all others are literals."""
        hashes = _hashes(alt, self.k)
        stop = np.zeros(len(hashes), bool)
        if len(hashes) and len(self.seeds):
            stop = self.seeds[np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)] == hashes
        for run in self.runs.finditer(alt):
            stop[run.start() : run.end() - self.k + 1] = True
        return np.flatnonzero(stop)

    def spans(self, sequence: str, least_after: int = MIN_AFTER, indel2: bool = False, name: str = "the sequence") -> list[tuple[int, int, int, int]]:
        """(kind, place in the sequence, place in the reference from 1 or 0, length) of spans that tile the sequence.

        Runs of N, and matches: the longest from their place on, the first in the reference of equals. After a match, a
        changed, inserted or deleted residue (or two, with indel2) is tried before a new seed; of equals in that order.
        What is left are spans of literals.
        """
        alt, ref, k = _encoded(sequence, name), self.raw, self.k
        moves = [(1, 1), (1, 0), (0, 1)] + [(2, 0), (0, 2)] * indel2
        stops = self._stops(alt)
        out: list[tuple[int, int, int, int]] = []
        i, n = 0, 0
        while i < len(alt):
            n += int(np.searchsorted(stops[n : n + 64], i))
            if n < len(stops) and stops[n] < i:
                n = int(np.searchsorted(stops, i))
            stop = int(stops[n]) if n < len(stops) else len(alt)
            if stop > i:
                out.append((LITERALS, i, 0, stop - i))
                i = stop
                continue
            head = alt[i : i + 1]
            if head in b"Nn":
                run = _run(alt, i)
                if run >= k:
                    out.append((N_RUN if head == b"N" else LOWER_N_RUN, i, 0, run))
                    i += run
                    continue
            best, at = 0, 0
            for p in self.places.get(alt[i : i + k], ()):
                size = k + common_length(alt, i + k, ref, p + k)
                if size > best:
                    best, at = size, p
            if not best:
                out.append((LITERALS, i, 0, 1))
                i += 1
                continue
            out.append((MATCH, i, at + 1, best))
            i, p = i + best, at + best
            while i < len(alt):
                size, a, b = _best_move(alt, i, ref, p, moves)
                if size < least_after:
                    break
                if a:
                    out.append((LITERALS, i, 0, a))
                out.append((MATCH, i + a, p + b + 1, size))
                i, p = i + a + size, p + b + size
        return out

    def parse(self, sequence: str, least_after: int = MIN_AFTER, indel2: bool = False) -> list[Tuple]:
        """The tuples of the sequence: spans with each literal by itself."""
        out: list[Tuple] = []
        for kind, at, p, size in self.spans(sequence, least_after, indel2):
            if kind == LITERALS:
                out += [("LIT", None, 1, c) for c in sequence[at : at + size]]
            else:
                out.append((KINDS[kind], p if kind == MATCH else None, size, None))
        return out


def _run(alt: bytes, i: int) -> int:
    size, head = 16, alt[i : i + 1]
    while alt[i : i + size] == head * size:
        size *= 2
    part = alt[i : i + size]
    return len(part) - len(part.lstrip(head))


def _best_move(alt: bytes, i: int, ref: bytes, p: int, moves: list[tuple[int, int]]) -> tuple[int, int, int]:
    best = (0, 0, 0)
    for a, b in moves:
        size = common_length(alt, i + a, ref, p + b)
        if size > best[0]:
            best = size, a, b
    return best


def rebuild(tuples: list[Tuple], reference: str) -> str:
    """The sequence that tuples came from."""
    take = {"MATCH": lambda p, n, c: reference[p - 1 : p - 1 + n], "LIT": lambda p, n, c: c, "N_RUN": lambda p, n, c: "N" * n, "n_RUN": lambda p, n, c: "n" * n}
    return "".join(take[kind](p, n, c) for kind, p, n, c in tuples)


#: The last reference that a worker has indexed, by its broadcast and options.
_indexed: dict[tuple, Reference] = {}


def _parse(reference, options: dict, name: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _indexed:
            _indexed.clear()
            _indexed[name] = Reference(reference.value, options["k"])
        index = _indexed[name]
        kinds = pa.array(KINDS)
        for batch in batches:
            for file_id, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = seq or ""
                found = index.spans(seq, options["least_after"], options["indel2"], f"file {file_id}")
                kind, at, place, size = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
                if options["merged"]:
                    texts = [seq[a : a + n] if k == LITERALS else None for k, a, _, n in found]
                    yield _batch(file_id, kinds.take(pa.array(kind)), pa.array(place, mask=kind != MATCH), pa.array(size), pa.array(texts, pa.string()), pa.array(at))
                    continue
                many = np.where(kind == LITERALS, size, 1)
                each = np.repeat(np.arange(len(kind)), many)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                single, match = kind[each] == LITERALS, kind[each] == MATCH
                start = at[each] + np.where(single, nth, 0)
                length = np.where(single, 1, size[each])
                letters = pa.array(np.frombuffer(seq.encode(), np.uint8)[start] if len(start) else np.zeros(0, np.uint8))
                literal = pc.if_else(pa.array(single), _LETTERS.take(letters), pa.scalar(None, pa.string()))
                yield _batch(file_id, kinds.take(pa.array(kind[each])), pa.array(place[each], mask=~match), pa.array(length), literal, pa.array(start))

    return run


def _batch(file_id: int | None, *columns: pa.Array) -> pa.RecordBatch:
    rows = len(columns[0])
    ids = pa.array(np.full(rows, file_id, np.int64)) if file_id is not None else pa.nulls(rows, pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.arange(rows)), *columns], names=["file_id", "tuple_no", "kind", "ref_pos", "len", "lit", "out_start"])


_LETTERS = pa.array([chr(c) for c in range(128)])


def encode(files: DataFrame, reference: str, k: int = MIN_MATCH, least_after: int = MIN_AFTER, indel2: bool = False, merged: bool = False) -> DataFrame:
    """Tuples of every file (file_id, seq); the reference, one sequence, is sent to all workers.

    A literal is a tuple of its own, as the second stage needs; with merged, neighbouring ones are one.
    """
    sent = files.sparkSession.sparkContext.broadcast(reference)
    options = {"k": k, "least_after": least_after, "indel2": indel2, "merged": merged}
    name = (uuid.uuid4().hex, k)
    return spread(files.select("file_id", "seq"), "file_id").mapInArrow(_parse(sent, options, name), TUPLES)


def _unmatched() -> Column:
    """The text of a literal or run."""
    runs = F.when(F.col("kind") == "N_RUN", F.repeat(F.lit("N"), F.col("len").cast("int"))).otherwise(F.repeat(F.lit("n"), F.col("len").cast("int")))
    return F.when(F.col("kind") == "LIT", F.col("lit")).otherwise(runs)


def pieces(tuples: DataFrame, reference: DataFrame) -> DataFrame:
    """Tuples with the text that each stands for; reference is one row (ref_seq)."""
    match = F.col("ref_seq").substr(F.col("ref_pos").cast("int"), F.col("len").cast("int"))
    text = F.when(F.col("kind") == "MATCH", match).otherwise(_unmatched())
    return tuples.crossJoin(F.broadcast(reference)).withColumn("piece", text).drop("ref_seq")


def chunks(reference: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, bases): a long reference (ref_seq) cut into rows."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("ref_seq") - 1) / size).cast("int")), lambda k: F.struct(k.cast("long").alias("chunk"), F.substring("ref_seq", k * size + 1, size).alias("bases")))
    return reference.where(F.length("ref_seq") > 0).select(F.explode(cut).alias("c")).select("c.*")


def chunked_pieces(tuples: DataFrame, cut: DataFrame, size: int = CHUNK) -> DataFrame:
    """pieces for a reference in chunks: matches are split at chunk borders and joined with the chunks they lie in.

    Pieces of one tuple keep its columns but for out_start, which moves on.
    """
    others = tuples.where("kind <> 'MATCH'").withColumn("piece", _unmatched())
    first, last = F.floor((F.col("ref_pos") - 1) / size), F.floor((F.col("ref_pos") + F.col("len") - 2) / size)
    split = tuples.where("kind = 'MATCH'").withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("ref_pos") - 1, F.col("chunk") * size)
    high = F.least(F.col("ref_pos") - 1 + F.col("len"), (F.col("chunk") + 1) * size)
    joined = split.join(cut, "chunk").withColumn("piece", F.col("bases").substr((low - F.col("chunk") * size + 1).cast("int"), (high - low).cast("int")))
    joined = joined.withColumn("out_start", F.col("out_start") + low - (F.col("ref_pos") - 1))
    return others.unionByName(joined.select(*others.columns))


def _small(reference: DataFrame) -> bool:
    return (reference.agg(F.max(F.length("ref_seq"))).first()[0] or 0) <= MOST_BROADCAST


def decode(tuples: DataFrame, reference: DataFrame, *more: Column) -> DataFrame:
    """(file_id, seq): the files that tuples stand for, with further aggregates of their pieces.

    A reference over MOST_BROADCAST residues is joined in chunks.
    """
    return _joined(pieces(tuples, reference) if _small(reference) else chunked_pieces(tuples, chunks(reference)), *more)


def _joined(found: DataFrame, *more: Column) -> DataFrame:
    """Pieces are joined in chunks of the output first, so that a file's last step joins few long ones."""
    row = F.array_sort(F.collect_list(F.struct("out_start", "piece")))
    text = lambda rows: F.array_join(F.transform(rows, lambda r: r["piece"]), "")
    part = found.groupBy("file_id", F.floor(F.col("out_start") / CHUNK).alias("part")).agg(text(row).alias("piece"), F.min("out_start").alias("out_start"), F.sum("len").alias("len"))
    return part.groupBy("file_id").agg(text(row).alias("seq"), *more)


def extract_range(tuples: DataFrame, reference: DataFrame, first: int, last: int) -> DataFrame:
    """(file_id, seq): residues first to last (from 1) of each file; only tuples that overlap are read."""
    ranges = tuples.select("file_id").distinct().select("file_id", F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"))
    near = tuples.where((F.col("out_start") < last) & (F.col("out_start") + F.col("len") >= first))
    return extract_ranges(near, reference, ranges)


def extract_ranges(tuples: DataFrame, reference: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_id, seq): of each file in ranges (file_id, first, last, from 1), the residues first to last.

    Only what overlaps is cut out of the tuples, before their pieces are looked up.
    """
    near = tuples.join(ranges, "file_id").where((F.col("out_start") < F.col("last")) & (F.col("out_start") + F.col("len") >= F.col("first")))
    skipped = F.greatest(F.col("first") - 1 - F.col("out_start"), F.lit(0))
    until = F.least(F.col("last") - F.col("out_start"), F.col("len"))
    cut = near.withColumn("skipped", skipped).withColumn("len", until - skipped)
    cut = cut.withColumn("lit", F.col("lit").substr((F.col("skipped") + 1).cast("int"), F.col("len").cast("int")))
    cut = cut.withColumn("ref_pos", F.col("ref_pos") + F.col("skipped")).withColumn("out_start", F.col("out_start") + F.col("skipped"))
    return decode(cut.where("len > 0").drop("first", "last", "skipped"), reference)
