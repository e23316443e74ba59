"""Archive of a collection: a folder of Parquet tables.

files (catalog and layout), sequences (records), residues (the reference, ord 0), segments (runs of tuples that repeat
an earlier file's) and tuples (all others), the last partitioned by bucket of file so that selecting files prunes what
is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import staged
from ..operators import dedup
from ..ordering import numbered  # noqa: F401

BUCKETS = 64


#: Columns of the segments table: which tuples of a file repeat an earlier file's.
SEGMENTS = "file_id long, tuple_no long, src_file long, src_tuple long, n_tuples long"


#: Tuples as stored. In place of positions and places, what seldom changes from one to the next: `diagonal`, how far the
#: reference is ahead of the file, and `skipped`, the residues before a tuple that segments cover.
STORED = "file_id long, tuple_no long, kind string, len long, lit string, diagonal long, skipped long"

_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2", **{f"parquet.enable.dictionary#{c}": "false" for c in ("tuple_no", "diagonal", "skipped")}}


def delta_coded(tuples: DataFrame) -> DataFrame:
    """STORED of tuples that no segment covers; delta_decoded gives them back."""
    rows = dedup.running(tuples, F.col("len"), "stored_before")
    diagonal = F.when(F.col("kind") == "MATCH", F.col("ref_pos") - F.col("out_start"))
    return rows.select("file_id", "tuple_no", "kind", "len", "lit", diagonal.alias("diagonal"), (F.col("out_start") - F.col("stored_before")).alias("skipped"))


def delta_decoded(stored: DataFrame) -> DataFrame:
    """The tuples of whole files from STORED: places are sums of lengths, carried from block to block."""
    rows = dedup.running(stored, F.col("len"), "stored_before").withColumn("out_start", F.col("stored_before") + F.col("skipped"))
    return rows.select("file_id", "tuple_no", "kind", (F.col("diagonal") + F.col("out_start")).alias("ref_pos"), "len", "lit", "out_start")


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(BUCKETS)))


def write_streams(path: str, tuples: DataFrame, segments: DataFrame, batch: int | None = None) -> None:
    """Tuples that no segment covers, and segments; those of a batch in a folder of its own, which a rerun replaces."""
    inside = "" if batch is None else f"/batch={batch}"
    mode = "errorifexists" if batch is None else "overwrite"
    dealt = _bucketed(delta_coded(tuples)).repartition("bucket").sortWithinPartitions("file_id", "tuple_no")
    dealt.write.mode(mode).partitionBy("bucket").options(**_OPTIONS).parquet(f"{path}/tuples{inside}")
    # sorted by bucket, so that row groups of others are passed over
    dealt = _bucketed(segments).repartition("bucket").sortWithinPartitions("bucket", "file_id", "tuple_no")
    dealt.write.mode(mode).options(**_OPTIONS).parquet(f"{path}/segments{inside}")


def write(path: str, files: DataFrame, sequences: DataFrame, reference: DataFrame, tuples: DataFrame, segments: DataFrame) -> None:
    files.write.parquet(f"{path}/files")
    sequences.write.parquet(f"{path}/sequences")
    reference.write.parquet(f"{path}/residues")
    write_streams(path, tuples, segments)


def _of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows of files (file_id). The buckets that they lie in are known before rows are read, so others are not."""
    buckets = [r.bucket for r in _bucketed(files.select("file_id")).select("bucket").distinct().collect()]  # at most BUCKETS
    return rows.where(F.col("bucket").isin(buckets)).join(files.select("file_id").distinct(), "file_id", "left_semi")


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The table without the number of the batch that wrote a row."""
    return spark.read.schema(schema).parquet(f"{path}/{name}").select(*(part.split()[0] for part in schema.split(", ")))


def read(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, residues, tuples); with names, only of these files. Tuples that segments cover are looked up in the
    files they repeat: segments are followed from the named files back, and only files met on the way are read."""
    files, residues = (spark.read.parquet(f"{path}/{x}") for x in ("files", "residues"))
    own, segments = (_table(spark, path, name, schema) for name, schema in (("tuples", f"{STORED}, bucket int"), ("segments", f"{SEGMENTS}, bucket long")))
    if names is None:
        return files, residues, dedup.restored(delta_decoded(own.drop("bucket")), segments.drop("bucket"))
    files = files.where(F.col("filename").isin(*dict.fromkeys(names)))
    wanted = files.select("file_id")
    # files that the wanted ones repeat, and those that these do
    met = fresh = staged(wanted, "met")
    while not fresh.isEmpty():
        further = _of_files(segments, fresh).select(F.col("src_file").alias("file_id")).distinct()
        fresh = staged(further.join(met, "file_id", "left_anti"), "met")
        met = staged(met.unionByName(fresh), "met")
    near = _of_files(segments, met).drop("bucket")
    places = dedup.resolved(near, wanted)
    stored = _of_files(own, staged(places.select(F.col("src_file").alias("file_id")).unionByName(wanted).distinct(), "met")).drop("bucket")
    return files, residues, dedup.looked_up(delta_decoded(stored), places, wanted)
