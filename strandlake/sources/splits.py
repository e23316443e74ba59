"""FASTA files read in byte ranges, so that neither a file nor a record has to fit a task.

What a range holds depends on where in a record it begins. A first pass sums a range up as a function: for each state
that the file may be in at the range's first character, the state after its last one and the records that begin in it.
These functions are applied one after another along a file, a few numbers each, and a second pass reads every range from
its known state. The rows are the same whatever the size of ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import staged, store_of
from .fasta import qualified

#: Bytes of a range; residues of a row of it, and of a chunk.
SPLIT, PART, CHUNK = 32 << 20, 1 << 14, 1 << 16

#: Where in a file a character is: in a body or before the first record; in a header; after a header's CR, where an LF
#: still ends the header; in the first line of a body.
BODY, HEADER, AFTER_CR, FIRST_LINE = range(4)

_END, _MARK = re.compile("[\r\n]"), re.compile("[>@]")
_DROPPED = bytes(range(0x41))
_DROPPED_TEXT = re.compile("[\x00-\x40]+")

RANGES = "file_id long, range_no long, uri string, at long, size long, length long"


def ranges(spark: SparkSession, *paths: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(file_id, ord, filename) of files in the given order, and their byte ranges. Contents are not read."""
    order = spark.createDataFrame([(k, qualified(spark, p), p.rstrip("/").rsplit("/", 1)[-1]) for k, p in enumerate(paths)], "ord int, uri string, filename string")
    found = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).select(F.regexp_replace("path", "^file:/+", "file:/").alias("uri"), "length")
    files = staged(found.join(F.broadcast(order), "uri").select(F.col("ord").cast("long").alias("file_id"), "ord", "filename", "uri", "length"), "files")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))
    cut = files.select("file_id", F.posexplode(starts).alias("range_no", "at"), "uri", "length")
    cut = cut.select("file_id", F.col("range_no").cast("long").alias("range_no"), "uri", "at", F.least(F.lit(split), F.col("length") - F.col("at")).cast("long").alias("size"), "length")
    return files.select("file_id", "ord", "filename"), cut


def _text(uri: str, at: int, size: int, length: int) -> str:
    """Characters whose first byte is in the range."""
    store, path = store_of(uri)
    with store.open_input_file(path) as file:
        raw = file.read_at(min(size + 3, length - at), at)
    first, last = 0, min(size, len(raw))
    while at and first < last and raw[first] & 0xC0 == 0x80:
        first += 1
    while last < len(raw) and raw[last] & 0xC0 == 0x80:
        last += 1
    return raw[first:last].decode("utf-8", "replace") if first < min(size, len(raw)) else ""


def _spans(text: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(kind, from, to, state after) of spans: "mark" and "name" of a header, its "end", "line" (first one) and "body"."""
    i, n = 0, len(text)
    while i < n:
        if state == HEADER:
            end = _END.search(text, i)
            j = end.start() if end else n
            yield "name", i, j, state
            if end:
                state = FIRST_LINE if text[j] == "\n" else AFTER_CR
                yield "end", j, j + 1, state
                j += 1
            i = j
        elif state == AFTER_CR:
            state = FIRST_LINE
            if text[i] == "\n":
                yield "end", i, i + 1, state
                i += 1
        else:
            mark = _MARK.search(text, i)
            j = mark.start() if mark else n
            if state == FIRST_LINE:
                end = _END.search(text, i, j)
                state = BODY if end else FIRST_LINE
                yield "line", i, end.start() if end else j, state
            yield "body", i, j, state
            if mark:
                state = HEADER
                yield "mark", j, j + 1, state
                j += 1
            i = j


def _summary(text: str) -> list[int]:
    """Of each state before the text, the state after it; then of each, the records that begin in it."""
    after, begun = [], []
    for entry in range(4):
        state, many = entry, 0
        if entry not in (BODY, HEADER) and begun[BODY]:
            state, many = after[BODY], begun[BODY]  # from the first mark on, all but headers agree
        else:
            for kind, _, _, state in _spans(text, entry):
                many += kind == "mark"
        after.append(state)
        begun.append(many)
    return after + begun


_SUMMARY = [f"after_{k}" for k in range(4)] + [f"begun_{k}" for k in range(4)]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            text = _text(row["uri"], row["at"], row["size"], row["length"])
            row |= dict(zip(_SUMMARY, _summary(text))) | {"closed": text[-1:] in ("\n", "\r") and text != ""}
            yield pa.RecordBatch.from_pylist([row], _schema(f"{RANGES}, {', '.join(f'{c} long' for c in _SUMMARY)}, closed boolean"))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file's ranges come in order; each gets the state before it and the number of the record that is open there."""
    now, state, record = None, BODY, -1
    for batch in batches:
        states, records = [], []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _SUMMARY]
        for k, file_id in enumerate(batch.column(batch.schema.get_field_index("file_id")).to_pylist()):
            if file_id != now:
                now, state, record = file_id, BODY, -1
            states.append(state)
            records.append(record)
            record += columns[4 + state][k]
            state = columns[state][k]
        kept = batch.select([f.split()[0] for f in RANGES.split(", ")] + ["closed"])
        yield kept.append_column("state", pa.array(states, pa.int64())).append_column("record", pa.array(records, pa.int64()))


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(kinds: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (part.split() for part in kinds.split(", "))])


def _residues(text: str) -> str:
    return text.encode().translate(None, _DROPPED).decode() if text.isascii() else _DROPPED_TEXT.sub("", text)


PIECES = "file_id long, range_no long, seq_no long, part long, name string, header_end string, line_len long, seq string"


def _read(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = _text(row["uri"], row["at"], row["size"], row["length"])
                rows, seq_no = [], row["record"]
                piece = {"file_id": row["file_id"], "range_no": row["range_no"], "seq_no": seq_no, "line_len": 0, "seq": ""}
                for kind, a, b, _ in _spans(text, row["state"]):
                    if kind == "mark":
                        rows.append(piece)
                        seq_no += 1
                        piece = piece | {"seq_no": seq_no, "name": "", "header_end": None, "line_len": 0, "seq": ""}
                    elif kind == "body":
                        piece["seq"] = _residues(text[a:b])
                    elif kind == "line":
                        piece["line_len"] = b - a
                    else:
                        key = "name" if kind == "name" else "header_end"
                        piece[key] = (piece.get(key) or "") + text[a:b]
                rows.append(piece)
                for whole in (r for r in rows if r["seq_no"] >= 0):
                    rest = {**whole, "name": None, "header_end": None, "line_len": 0}
                    cut = range(0, max(1, len(whole["seq"])), size)
                    parts = [{**(whole if not at else rest), "part": k, "seq": whole["seq"][at : at + size]} for k, at in enumerate(cut)]
                    yield pa.RecordBatch.from_pylist(parts, _schema(PIECES))

    return run


def scan(cut: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(pieces, ends) of byte ranges. pieces: of each record in each range, the parts of its name, of its header's end,
    of its first line's length and of its residues that lie there. ends: (file_id, newline_at_eof)."""
    some = f"{RANGES}, {', '.join(f'{c} long' for c in _SUMMARY)}, closed boolean"
    summed = cut.repartition("file_id", "range_no").mapInArrow(_summed, some)
    ordered = summed.repartition("file_id").sortWithinPartitions("file_id", "range_no")  # a few numbers a range
    known = staged(ordered.mapInArrow(_carried, f"{RANGES}, closed boolean, state long, record long"), "ranges")
    pieces = known.drop("closed").repartition("file_id", "range_no").mapInArrow(_read(part), PIECES)
    ends = known.where(F.col("at") + F.col("size") >= F.col("length")).select("file_id", F.col("closed").alias("newline_at_eof"))
    return staged(pieces, "pieces"), ends


def records(pieces: DataFrame) -> DataFrame:
    """(file_id, seq_no, seq_name, line_len, size, start_pos, header_end): records without their residues."""

    def text(name: str):
        row = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("range_no", F.col(name).alias("t")))))
        return F.array_join(F.transform(row, lambda r: r["t"]), "").alias(name)

    found = pieces.groupBy("file_id", "seq_no").agg(
        text("name"), F.sum("line_len").alias("line_len"), F.sum(F.length("seq").cast("long")).alias("size"), text("header_end"), F.min("range_no").alias("range_no")
    )
    # residues before a record: those of the ranges before its first one, and of the records that begin before it there
    placed = found.join(_before(pieces).where("part = 0"), ["file_id", "range_no", "seq_no"])
    return placed.select("file_id", F.col("seq_no").cast("int").alias("seq_no"), F.col("name").alias("seq_name"), "line_len", "size", "start_pos", "header_end")


def _before(pieces: DataFrame) -> DataFrame:
    """(file_id, range_no, seq_no, part, start_pos): where in the residues of its file a piece begins."""
    sizes = pieces.select("file_id", "range_no", "seq_no", "part", F.length("seq").cast("long").alias("n"))
    totals = sizes.groupBy("file_id", "range_no").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("file_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = totals.select("file_id", "range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("file_id", "range_no").orderBy("seq_no", "part").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(carried, ["file_id", "range_no"]).select("file_id", "range_no", "seq_no", "part", (F.col("carried") + F.col("local")).alias("start_pos"))


def layouts(files: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """(file_id, filename, n_seqs, n_residues, line_width, eol, newline_at_eof) of files with records."""
    first = F.max(F.when(F.col("seq_no") == 0, F.col("header_end")))
    eol = F.when(first == "\r\n", "CRLF").when(first == "\r", "CR").otherwise("LF")
    stats = found.groupBy("file_id").agg(
        F.count("*").alias("n_seqs"), F.sum("size").alias("n_residues"), F.max("line_len").alias("line_width"), eol.alias("eol")
    )
    return stats.join(files.select("file_id", "filename"), "file_id").join(ends, "file_id")


def chunks(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file_id, chunk, bases): the residues of each file, record after record, cut every `size`."""
    placed = pieces.where("seq <> ''").join(_before(pieces), ["file_id", "range_no", "seq_no", "part"])
    n = F.length("seq")
    last = F.floor((F.col("start_pos") + n - 1) / size)
    cut = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_pos") / size), last)))
    low = F.greatest(F.col("chunk") * size - F.col("start_pos"), F.lit(0))
    high = F.least((F.col("chunk") + 1) * size - F.col("start_pos"), n.cast("long"))
    cut = cut.select("file_id", "chunk", (F.col("start_pos") + low).alias("at"), F.col("seq").substr((low + 1).cast("int"), (high - low).cast("int")).alias("bases"))
    row = F.array_sort(F.collect_list(F.struct("at", "bases")))
    return cut.groupBy("file_id", "chunk").agg(F.array_join(F.transform(row, lambda r: r["bases"]), "").alias("bases"))
