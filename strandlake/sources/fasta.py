"""FASTA source and sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import shared_uri, store_of
from ..functions.residues import residues, wrapped

#: A header marker, the rest of its line, the line's end, and everything up to the next marker.
RECORD = r"[>@]([^\r\n]*)(\r\n|\n|\r|\z)([^>@]*)"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_id, ord, filename, content) of whole files in the given order; the first is the reference.

    Files are told apart by their whole paths, so names may repeat in different folders.
    """
    order = spark.createDataFrame([(k, qualified(spark, p), p.rstrip("/").rsplit("/", 1)[-1]) for k, p in enumerate(paths)], "ord int, at string, filename string")
    read = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    named = read.select(F.regexp_replace("path", "^file:/+", "file:/").alias("at"), F.decode("content", "UTF-8").alias("content"))
    return named.join(F.broadcast(order), "at").select(F.col("ord").cast("long").alias("file_id"), "ord", "filename", "content")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark reports it."""
    return re.sub("^file:/+", "file:/", shared_uri(spark, path))


def end_of_line(content: Column) -> Column:
    """LF, CR or CRLF, from the end of the first header line."""
    end = F.regexp_extract(content, RECORD, 2)
    return F.when(end == "\r\n", "CRLF").when(end == "\r", "CR").otherwise("LF")


def records(contents: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, seq_no, seq_name, line_len, seq): the records of each row's content, with gaps and digits dropped.

    line_len is that of the first line as it stands, gaps and digits included.
    """
    text = F.col(content)
    cut = F.arrays_zip(F.regexp_extract_all(text, F.lit(RECORD), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(RECORD), F.lit(3)).alias("body"))
    rows = contents.select(key, F.posexplode(cut).alias("seq_no", "r"))
    first_line = F.regexp_extract("r.body", r"\A([^\r\n]*)", 1)
    return rows.select(
        key, "seq_no", F.col("r.name").alias("seq_name"), F.length(first_line).alias("line_len"), residues(F.col("r.body")).alias("seq")
    )


def sequences(found: DataFrame, key: str = "file_id") -> DataFrame:
    """Records with size and start_pos in the concatenation of their file."""
    before = Window.partitionBy(key).orderBy("seq_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = found.withColumn("size", F.length("seq").cast("long"))
    return sized.withColumn("start_pos", F.coalesce(F.sum("size").over(before), F.lit(0)))


def file_stats(found: DataFrame, key: str = "file_id") -> DataFrame:
    """Records, residues and line width of each file."""
    return found.groupBy(key).agg(
        F.count("*").alias("n_seqs"), F.sum(F.length("seq").cast("long")).alias("n_residues"), F.max("line_len").cast("long").alias("line_width")
    )


def rendered(name: Column, sequence: Column, width: Column | int, final_feed: bool = True) -> Column:
    """A record as text: header, wrapped lines and, unless told otherwise, a feed at the end."""
    text = F.concat(F.lit(">"), name, F.lit("\n"), wrapped(sequence, width))
    return F.concat(text, F.lit("\n")) if final_feed else text


def layout(content: Column) -> tuple[Column, Column]:
    """End of line, and whether the content's last character ends a line."""
    return end_of_line(content).alias("eol"), F.substring(content, -1, 1).isin("\n", "\r").alias("newline_at_eof")


def laid_out(found: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, seq_no, text) of records with the layout of their file: name, lines of line_width and their ends.

    found: key, seq_no, seq_name, seq, and the file's n_seqs, line_width, eol and newline_at_eof. Texts of a file, one
    after another, are the file.
    """
    end = F.when(F.col("eol") == "CRLF", "\r\n").when(F.col("eol") == "CR", "\r").otherwise("\n")
    lines = F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.greatest(F.col("line_width"), F.lit(1)).cast("int")),
        lambda at: F.substring("seq", at, F.greatest(F.col("line_width"), F.lit(1)).cast("int")),
    ), "\n")
    lines = F.when(F.length("seq") > 0, F.concat(end, F.replace(lines, F.lit("\n"), end))).otherwise("")
    closed = (F.col("seq_no") < F.col("n_seqs") - 1) | F.col("newline_at_eof")
    return found.select(key, "seq_no", F.concat(F.lit(">"), "seq_name", lines, F.when(closed, end).otherwise("")).alias("text"))


def write_exact(found: DataFrame, path: str) -> list[str]:
    """Writes texts (file_id, filename, seq_no, text) to `<file name>.ori` in a folder, byte by byte; the paths written.

    A task writes a file record by record under a name of its own and renames it, so a rerun replaces a lost attempt.
    Names that repeat are told apart by their file_id. A path without a scheme is on Spark's default file system.
    """
    uri = shared_uri(found.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(uri)
        store.create_dir(folder, recursive=True)
        now, out, done = None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{now}.{attempt}", now)
                done.append(now)

        attempt = uuid.uuid4().hex
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f"{folder}/{name}.ori" != now:
                    close()
                    now = f"{folder}/{name}.ori"
                    out = store.open_output_stream(f"{now}.{attempt}")
                out.write(text.encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    alike = Window.partitionBy("filename")
    named = F.when(F.min("file_id").over(alike) == F.max("file_id").over(alike), F.col("filename")).otherwise(F.concat_ws(".", "filename", F.col("file_id").cast("string")))
    rows = found.withColumn("filename", named).repartition("filename").sortWithinPartitions("filename", "seq_no")
    return [r.path for r in rows.select("filename", "text").mapInArrow(run, "path string").collect()]  # one row a file


def write_fasta(found: DataFrame, path: str, width: int = 70) -> None:
    """One text row a record, a folder for each file; a file's records stay in order."""
    order = [c for c in ("file_id", "seq_no") if c in found.columns]
    rows = found.repartition("file_id").sortWithinPartitions(*order)
    rows.select("file_id", rendered(F.col("seq_name"), F.col("seq"), width, final_feed=False).alias("value")).write.partitionBy("file_id").text(path)
