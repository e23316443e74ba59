"""VCF source and sink: fixed fields become typed columns, sample columns a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(variants, genotypes in text form, sample names) of a VCF file, plain or gzipped.

    path is one file. line_no grows with the lines of the file: a file's splits are read in their order.
    """
    if spark.read.format("binaryFile").load(path).count() != 1:
        raise ValueError(f"{path} is not one file")
    lines = spark.read.option("wholetext", False).text(path)
    header = lines.where(F.col("value").startswith("#CHROM")).first()
    samples = header.value.split()[len(FIXED) :] if header else []
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("line_no", F.monotonically_increasing_id())
    fields = body.withColumn("f", F.split(F.trim("value"), r"\s+"))
    fixed = [F.col("f")[k].alias(name) for k, name in enumerate(FIXED)]
    variants = fields.select("line_no", *fixed).withColumn("pos", F.expr("try_cast(pos as bigint)")).withColumn("alts", F.split("alt", ","))
    variants = variants.withColumn("format", F.split("format", ":"))
    # where a record's calls hold their genotype is known before they are dealt out
    place = F.array_position(F.split(F.col("f")[len(FIXED) - 1], ":"), "GT").cast("int").alias("place")
    called = fields.select("line_no", place, F.posexplode(F.slice("f", len(FIXED) + 1, max(1, len(samples)))).alias("sample_no", "call"))
    genotypes = called.select("line_no", "sample_no", F.when(F.col("place") > 0, F.get(F.split("call", ":"), F.col("place") - 1)).alias("gt"))
    return variants.drop("alt"), genotypes, samples


def column_prefix(line: Column, columns: int) -> Column:
    """The first tab-separated columns of a line; lines with fewer stay whole."""
    return F.substring_index(line, "\t", columns)


def split_lines(spark: SparkSession, path: str, male: set[str], low: int, high: int) -> DataFrame:
    """(part, line_no, value): a VCF's lines dealt into fem, mal, mal1 and mal2, with the columns of their samples.

    Header lines go to all parts. fem has every record, the others those of their region: mal1 before low, mal up to
    and with high, mal2 after.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    header = lines.where(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError(f"{path} has no #CHROM line, so its samples are unknown")
    samples = header.value.split()[len(FIXED) :]

    def columns(kept: bool) -> Column:
        places = [*range(len(FIXED)), *(len(FIXED) + k for k, s in enumerate(samples) if (s in male) == kept)]
        return F.array_join(F.transform(F.array(*map(F.lit, places)), lambda k: F.get("f", k)), "\t")

    meta = F.col("value").startswith("##")
    pos = F.when(F.col("value").startswith("#"), None).otherwise(F.col("f")[1].try_cast("bigint"))
    top = meta | (F.col("f")[0] == "#CHROM")
    wanted = {"fem": F.lit(True), "mal": pos.between(low, high), "mal1": pos < low, "mal2": pos > high}
    # a line is read once and dealt to all of its parts
    rows = lines.where(F.trim("value") != "").withColumn("f", F.split(F.trim("value"), r"\s+"))
    rows = rows.withColumns({"fem": F.when(meta, F.col("value")).otherwise(columns(False)), "mal": F.when(meta, F.col("value")).otherwise(columns(True))})
    parts = [F.when(top | where, F.struct(F.lit(part).alias("part"), F.col("fem" if part == "fem" else "mal").alias("value"))) for part, where in wanted.items()]
    dealt = rows.select("line_no", F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return dealt.select("p.part", "line_no", "p.value")


def write_lines(rows: DataFrame, path: str) -> None:
    """Parts as folders of text files that follow each other in the order of lines."""
    dealt = rows.repartitionByRange("line_no").sortWithinPartitions("part", "line_no")
    dealt.select("part", "value").write.partitionBy("part").text(path)
