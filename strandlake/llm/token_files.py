"""Token ids in flat files of unsigned integers, with 64-bit offsets of documents, to be memory-mapped.

A folder holds shards in the order of doc_id. Of shard s, `s.ids` is nothing but ids, one after another, of 2 bytes where
the vocabulary allows and of 4 else; `s.offsets` has n + 1 unsigned 64-bit numbers, where each document begins and the
last one ends in the ids of the whole folder; `s.docs` has n doc_ids. All are little-endian. `manifest` (Parquet) lists
shards with their sizes and bases. Bases are prefix sums of sizes, known only when all shards are written, so a second
pass over the small offset files makes these absolute.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import shared_uri
from .common import STEP_BYTES, column, staged
from .packing import _Encoder, _encoders

#: Stands for a missing doc_id.
NO_ID = np.iinfo(np.int64).min
#: Documents that one reading task takes, and ids that it widens at a time.
SLICE, WIDENED = 1 << 16, 1 << 20

MANIFEST = "shard int, name string, width int, n_docs long, n_tokens long"


def _encoded(encoder: _Encoder, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts taken, ids, where each text's ids end) of runs of texts; a very long text is a run of its own."""
    texts = texts.fill_null("")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(texts):
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(size[low : low + 100_000]), 4 * STEP_BYTES)))
        if size[low] > 4 * STEP_BYTES:
            flat = encoder.whole(texts[low].as_py())
            yield 1, flat, np.array([len(flat)])
        else:
            yield high - low, *encoder.step(texts.slice(low, high - low))
        low = high


def _shards(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        encoder = _encoders.get((tokenizer, end_id)) or _encoders.setdefault((tokenizer, end_id), _Encoder(tokenizer, end_id))
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        # an attempt has names of its own; the manifest lists those of the attempt that counts
        name, outs, docs, tokens = uuid.uuid4().hex, None, 0, 0
        try:
            for batch in batches:
                ids = column(batch, "doc_id").fill_null(NO_ID).to_numpy()
                low = 0
                for many, flat, ends in _encoded(encoder, column(batch, "text")):
                    if outs is None:
                        store.create_dir(base, recursive=True)
                        outs = [store.open_output_stream(f"{base}/{name}.{kind}") for kind in ("ids", "ends", "docs")]
                    outs[0].write(np.ascontiguousarray(flat, f"<u{width}"))
                    outs[1].write(np.ascontiguousarray(ends + tokens, "<u8"))
                    outs[2].write(np.ascontiguousarray(ids[low : low + many], "<i8"))
                    docs, tokens, low = docs + many, tokens + len(flat), low + many
        finally:
            for out in outs or ():
                out.close()
        pa.default_memory_pool().release_unused()
        if docs:
            row = [[TaskContext.get().partitionId()], [name], [width], [docs], [tokens]]
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["shard", "name", "width", "n_docs", "n_tokens"])

    return run


def _place(folder: str):
    """Makes a shard's offsets absolute; a rerun writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(column(batch, "name").to_pylist(), column(batch, "first_token").to_pylist()):
                with store.open_input_stream(f"{base}/{name}.ends") as read, store.open_output_stream(f"{base}/{name}.offsets") as out:
                    out.write(np.array([first], "<u8"))
                    while part := read.read(1 << 23):
                        out.write(np.frombuffer(part, "<u8") + np.uint64(first))
            yield batch

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the ids of all rows of docs (doc_id long, text string), each followed by end_id, to a new folder; the manifest.

    Rows are dealt into ranges of doc_id, one for each shuffle partition, and a range is a shard. Rows that repeat a doc_id
    stay in the order of the input and may lie in several shards; rows without one come first. A null or empty text is
    end_id alone; other columns are ignored; an empty table gives a manifest without rows. `tokenizer` names a tokenizers
    file whose tokens never span whitespace.
    """
    spark = docs.sparkSession
    uri = shared_uri(spark, folder)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = source.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    written = staged(dealt.mapInArrow(_shards(uri, tokenizer, end_id), MANIFEST), "shards")
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    sums = {f"first_{x}": F.coalesce(F.sum(f"n_{x}s").over(before), F.lit(0)) for x in ("doc", "token")}
    based = written.withColumns(sums).repartition("shard")
    based.mapInArrow(_place(uri), f"{MANIFEST}, first_doc long, first_token long").write.parquet(f"{uri}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """shard, name, width, n_docs, n_tokens, first_doc and first_token of the shards of a folder."""
    return spark.read.schema(f"{MANIFEST}, first_doc long, first_token long").parquet(f"{folder}/manifest")


class Mapped:
    """A file of numbers, mapped into memory if it is local and read in ranges else."""

    def __init__(self, uri: str, dtype: str):
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.dtype = np.dtype(dtype)
        if isinstance(store, pyarrow.fs.LocalFileSystem):
            self.file, self.numbers = None, np.memmap(path, self.dtype, "r")
        else:
            self.file = store.open_input_file(path)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.file is None:
            return self.numbers[span]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((span.stop - span.start) * size, span.start * size), self.dtype)


def _read(folder: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, end = row["at"], row["at"] + row["many"]
                ids = Mapped(f"{folder}/{row['name']}.ids", f"<u{row['width']}")
                offsets = Mapped(f"{folder}/{row['name']}.offsets", "<u8")[at : end + 1].astype(np.int64)
                docs = Mapped(f"{folder}/{row['name']}.docs", "<i8")[at:end]
                low = 0
                while low < end - at:
                    high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + WIDENED, side="right")) - 1)
                    part = offsets[low : high + 1]
                    wide = ids[int(part[0] - row["first_token"]) : int(part[-1] - row["first_token"])].astype("<u4")
                    raw, cuts = memoryview(wide).cast("B"), (4 * (part - part[0])).tolist()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                    doc = docs[low:high].astype(np.int64)
                    out = [pa.array(doc, mask=doc == NO_ID), pa.array(part[:-1]), pa.array(np.diff(part)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        out.append(pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(wide.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    low = high

    return run


def documents(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<int>) of every document, read from the folder's files."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(SLICE).cast("long"))).alias("at")
    slices = manifest(spark, folder).select("name", "width", "first_token", "n_docs", starts)
    slices = slices.withColumn("many", F.least(F.lit(SLICE).cast("long"), F.col("n_docs") - F.col("at"))).repartition("name", "at")
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return slices.mapInArrow(_read(shared_uri(spark, folder), keep_ids), kinds)


def windows(spark: SparkSession, folder: str, length: int, last: bool = True) -> DataFrame:
    """window_no and ids (array<int>) of the folder's ids cut every `length`, whatever document or shard they are of.

    A trainer reads them in any order. The last window may be shorter; without `last` it is left out then.
    """
    uri = shared_uri(spark, folder)
    # a window is put together from the parts of it that shards hold, as a rule one
    some = F.explode(F.sequence(F.floor(F.col("first_token") / length), F.floor((F.col("first_token") + F.col("n_tokens") - 1) / length))).alias("window_no")
    parts = manifest(spark, folder).select("name", "width", "first_token", "n_tokens", some)
    low = F.greatest(F.col("window_no") * length, F.col("first_token"))
    high = F.least((F.col("window_no") + 1) * length, F.col("first_token") + F.col("n_tokens"))
    parts = parts.select("window_no", "name", "width", (low - F.col("first_token")).alias("at"), (high - low).alias("many"), low.alias("start"))
    read = parts.repartition("name", F.floor(F.col("at") / (length * 256))).mapInArrow(_spans(uri), "window_no long, start long, ids array<int>")
    whole = read.groupBy("window_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda r: r["ids"])).alias("ids"))
    return whole if last else whole.where(F.size("ids") == length)


def _spans(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Mapped(f"{folder}/{row['name']}.ids", f"<u{row['width']}")[row["at"] : row["at"] + row["many"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["window_no"]]), pa.array([row["start"]]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))],
                    names=["window_no", "start", "ids"],
                )

    return run
