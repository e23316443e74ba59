"""Files that arrive over time: each micro-batch is parsed against the reference and appended to an archive.

The second stage goes on from batch to batch: windows of tuples of files that later ones may repeat are kept as a table,
which each batch joins and adds to. So files have the segments they would have had in one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..durable import drop_staged, staged
from ..functions import buckets
from ..operators import dedup, parsing, repeats
from ..sources import archive, fasta

#: Windows of files by their order of arrival, which later batches look up: 128 bits of a hash of the tuples.
WINDOWS = "file_id long, tuple_no long, window string, size long"

_ARRIVING = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, filename, content) of files as they land in a folder; the id is a hash of the path."""
    stream = spark.readStream.format("binaryFile").schema(_ARRIVING).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return stream.select(F.xxhash64("path").alias("file_id"), name.alias("filename"), F.decode("content", "UTF-8").alias("content"))


def encoded_batch(batch: DataFrame, reference: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, sequences, tuples) of one micro-batch. A position that the archive cannot hold is an error."""
    found = fasta.records(batch.select("file_id", "content"))
    stats = fasta.file_stats(found).join(batch.select("file_id", "filename", *fasta.layout(F.col("content"))), "file_id")
    layout = fasta.sequences(found).select("file_id", "seq_no", "seq_name", "size", "start_pos", "line_len")
    whole = F.array_sort(F.collect_list(F.struct("seq_no", "seq")))
    joined = found.groupBy("file_id").agg(F.array_join(F.transform(whole, lambda r: r["seq"]), "").alias("seq"))
    tuples = parsing.encode(joined, reference)
    return stats, layout, tuples.withColumn("ref_pos", buckets.checked_position(F.col("ref_pos")))


def begin(spark: SparkSession, path: str, reference: str, name: str = "reference") -> None:
    """Lays down the reference of a new archive as its file 0; an archive that is there stays as it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/residues/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return
    first = spark.createDataFrame([(0, reference)], "file_id long, seq string")
    size = F.length("seq").cast("long")
    files = first.select(
        "file_id", F.lit(1).cast("long").alias("n_seqs"), size.alias("n_residues"), F.lit(70).cast("long").alias("line_width"), F.lit(name).alias("filename"),
        F.lit("LF").alias("eol"), F.lit(True).alias("newline_at_eof"), F.lit(0).cast("long").alias("ord"), F.lit(True).alias("is_reference"),
    )
    sequences = first.select("file_id", F.lit(0).alias("seq_no"), F.lit(name).alias("seq_name"), size.alias("size"), F.lit(0).cast("long").alias("start_pos"), F.lit(70).alias("line_len"))
    files.write.mode("overwrite").parquet(f"{path}/files/batch=-1")
    sequences.write.mode("overwrite").parquet(f"{path}/sequences/batch=-1")
    archive.write_streams(path, spark.createDataFrame([], parsing.TUPLES), spark.createDataFrame([], archive.SEGMENTS), -1)
    spark.createDataFrame([], WINDOWS).write.mode("overwrite").parquet(f"{path}/windows/batch=-1")
    first.write.mode("overwrite").parquet(f"{path}/residues")


def _before(spark: SparkSession, path: str, table: str, schema: str, number: int) -> DataFrame:
    """Rows of a table that batches before this one wrote; the reference's are numbered -1."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{table}").where(F.col("batch") < number).drop("batch")


def second_stage(spark: SparkSession, path: str, files: DataFrame, tuples: DataFrame, number: int, sources: int | None = None) -> DataFrame:
    """archive.SEGMENTS of a batch's files (file_id, ord); adds its windows to the archive's, for later batches.

    Earlier files are all of batches before, and those of the batch with a lower ord. Only the first `sources` files of
    the archive may be repeated (all, if None): the windows of others are not kept.
    """
    catalog = _before(spark, path, "files", "file_id long, ord long", number).unionByName(files.select("file_id", "ord"))
    signed = tuples.withColumn("sig", F.concat_ws(":", "kind", "ref_pos", "len", "lit"))
    found = dedup.windows(signed).select("file_id", "tuple_no", F.md5(F.col("window").cast("binary")).alias("window"), F.col("size").cast("long").alias("size"))
    # order of arrival stands for the file
    found = staged(found.join(files.select("file_id", "ord"), "file_id").select(F.col("ord").alias("file_id"), "tuple_no", "window", "size"), "windows")
    own = files.select(F.col("ord").alias("file_id"))
    kept = catalog.where("ord > 0").select(F.col("ord").alias("file_id"))
    if sources is not None:
        kept = kept.orderBy("file_id").limit(sources)  # of the catalog, which has a row for each file
    kept = staged(kept, "kept")
    known = _before(spark, path, "windows", WINDOWS, number)
    segments = repeats.chosen_segments(found.unionByName(known), kept, fresh=own)
    name = catalog.select(F.col("ord").alias("file_id"), F.col("file_id").alias("name"))
    source = name.toDF("src_file", "src_name")
    named = segments.join(name, "file_id").join(source, "src_file")
    made = staged(named.select(F.col("name").alias("file_id"), "tuple_no", F.col("src_name").alias("src_file"), "src_tuple", "n_tuples"), "segments")
    lasting = found.join(kept, "file_id", "left_semi").repartition("window").sortWithinPartitions("window")
    lasting.write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
    for table in (found, kept):
        drop_staged(table)
    return made


def ingest(spark: SparkSession, folder: str, path: str, reference: str, checkpoint: str, sources: int | None = None) -> StreamingQuery:
    """Appends tuples, segments, records and catalog rows of arriving files to the archive at path, which is read like any other.

    A batch is written under its own number and overwritten if it is run again, and reads only batches before it, so a
    restart adds nothing twice. Files are in order of arrival; those of a batch go by name. The first `sources` files may
    be repeated by later ones; what dedup.retained keeps of m files at a level are the first floor(m * level / 10) - 1.
    """
    begin(spark, path, reference)

    def append(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        files, sequences, tuples = encoded_batch(held, reference)
        order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("filename", "file_id"))  # files of one batch
        files = files.withColumn("ord", F.lit(number).cast("long") * (1 << 32) + order).withColumn("is_reference", F.lit(False))
        files, tuples = staged(files, "files"), staged(tuples, "tuples")
        segments = second_stage(batch.sparkSession, path, files, tuples, number, sources)
        sequences.write.mode("overwrite").parquet(f"{path}/sequences/batch={number}")
        archive.write_streams(path, dedup.uncovered(tuples, segments), segments, number)
        files.write.mode("overwrite").parquet(f"{path}/files/batch={number}")  # the last, so that a catalog names what is there
        for table in (files, tuples, segments):
            drop_staged(table)
        held.unpersist()

    stream = arriving_files(spark, folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
