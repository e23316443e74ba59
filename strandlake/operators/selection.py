"""Catalog of a collection, and choice of files by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordering import numbered


def catalog(stats: DataFrame, filename: Column, key: str) -> DataFrame:
    """stats with ord (by key, from 0), filename and is_reference: the first file is the reference."""
    return numbered(stats.withColumn("filename", filename), key).withColumn("is_reference", F.col("ord") == 0)


def selected(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files with one of the names; a name asked for twice counts once."""
    return files.join(names.select("filename").distinct(), "filename", "left_semi")


def unknown(files: DataFrame, names: DataFrame) -> DataFrame:
    """Names that no file has."""
    return names.select("filename").distinct().join(files, "filename", "left_anti")


def same_record_count(files: DataFrame) -> DataFrame:
    """files with whether each has as many records as the reference."""
    first = files.where("is_reference").agg(F.max("n_seqs").alias("wanted"))
    return files.crossJoin(F.broadcast(first)).withColumn("same", F.col("n_seqs") == F.col("wanted")).drop("wanted")


def checked(files: DataFrame) -> DataFrame:
    """files, or an error when a record count differs from the reference's."""
    wrong = F.when(~F.col("same"), F.raise_error(F.concat(F.lit("record count differs in "), "filename")).cast("boolean")).otherwise(True)
    return same_record_count(files).where(wrong).drop("same")
