"""Command line: encode, decode and list archives; build consensus sequences; cut regions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .durable import drop_staged, staged
from .functions import buckets
from .operators import dedup, parsing, repeats, selection, variants
from .sources import archive, fasta, splits, vcf


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("encode", help="write FASTA files to an archive; the first is the reference")
    e.add_argument("archive")
    e.add_argument("files", nargs="+", help="paths, or @path of a list of them")
    e.add_argument("--level", type=int, default=10, help="share of files, in tenths, that later files are matched with")
    e.add_argument("--min-match", type=int, default=15)
    e.add_argument("--min-after", type=int, default=4)
    e.add_argument("--indel2", action="store_true")
    d = sub.add_parser("decode", help="rebuild all or the named files")
    d.add_argument("archive")
    d.add_argument("out", help="output folder, or noop to time decoding only")
    d.add_argument("names", nargs="*")
    d.add_argument("--range", nargs=2, type=int, metavar=("FIRST", "LAST"))
    d.add_argument("--sequence", help="name of the sequence that the range counts in; else the files' concatenations")
    d.add_argument("--ori", action="store_true", help="write each file to <name>.ori, byte by byte as it was")
    sub.add_parser("list", help="the archive's catalog").add_argument("archive")
    c = sub.add_parser("consensus", help="apply a phased VCF to a reference")
    c.add_argument("vcf")
    c.add_argument("reference")
    c.add_argument("out")
    c.add_argument("--start", type=int, default=1, help="position of the reference's first base")
    c.add_argument("--ploidy", type=int, choices=(1, 2), default=2)
    c.add_argument("--strict", action="store_true", help="rejected records lose their reference base")
    x = sub.add_parser("split-x", help="deal a VCF of chromosome X into male and female samples and regions")
    x.add_argument("vcf")
    x.add_argument("males", help="a file of the male samples' names")
    x.add_argument("out")
    x.add_argument("--bounds", nargs=2, type=int, default=(variants.PAR1_END, variants.PAR2_START), metavar=("LOW", "HIGH"))
    p = sub.add_parser("columns", help="keep the first columns of a VCF")
    p.add_argument("vcf")
    p.add_argument("out")
    p.add_argument("columns", type=int)
    t = sub.add_parser("cut", help="cut a region out of a reference")
    t.add_argument("reference")
    t.add_argument("out")
    t.add_argument("start", type=int)
    t.add_argument("end", type=int)
    return top


def named_files(spark: SparkSession, given: list[str]) -> list[str]:
    """The given paths; @path stands for the white-space separated paths in that file."""
    out: list[str] = []
    for name in given:
        out += spark.read.text(name[1:], wholetext=True).first().value.split() if name.startswith("@") else [name]
    return out


def encode(spark: SparkSession, a) -> None:
    named, cut = splits.ranges(spark, *named_files(spark, a.files))
    pieces, ends = splits.scan(cut)
    found = staged(splits.records(pieces), "records")
    files = selection.catalog(splits.layouts(named, found, ends).withColumnRenamed("filename", "name"), F.col("name"), "file_id")
    files = staged(selection.checked(files.drop("name")), "catalog")
    layout = found.select("file_id", "seq_no", "seq_name", "size", "start_pos", "line_len")
    # the parse takes a file at a time
    row = F.array_sort(F.collect_list(F.struct("chunk", "bases")))
    whole = splits.chunks(pieces).groupBy("file_id").agg(F.array_join(F.transform(row, lambda r: r["bases"]), "").alias("seq"))
    reference = staged(whole.where("file_id = 0"), "reference")
    first = reference.first()
    tuples = parsing.encode(whole.where("file_id > 0"), first.seq if first else "", a.min_match, a.min_after, a.indel2)
    tuples = staged(tuples.withColumn("ref_pos", buckets.checked_position(F.col("ref_pos"))), "tuples")
    signed = tuples.withColumn("sig", F.concat_ws(":", "kind", "ref_pos", "len", "lit"))
    kept = dedup.retained(files.select("ord", "file_id"), a.level).where("retained")
    segments = staged(repeats.chosen_segments(dedup.windows(signed), kept), "segments")
    archive.write(a.archive, files, layout, reference, dedup.uncovered(tuples, segments), segments)
    for table in (tuples, segments, pieces, found, files, reference):
        drop_staged(table)


def decode(spark: SparkSession, a) -> None:
    files, residues, tuples = archive.read(spark, a.archive, a.names or None)
    for row in selection.unknown(files, spark.createDataFrame([(n,) for n in a.names], "filename string")).collect() if a.names else []:
        print(f"no such file: {row.filename}")
    reference = residues.select(F.col("seq").alias("ref_seq"))
    sequences = spark.read.parquet(f"{a.archive}/sequences")
    if a.range:
        first, last = (F.lit(x).cast("long") for x in a.range)
        ranges = files.select("file_id", first.alias("first"), last.alias("last"))
        if a.sequence:
            places = sequences.where(F.col("seq_name") == a.sequence).join(files.select("file_id"), "file_id", "left_semi")
            ranges = places.select("file_id", (F.col("start_pos") + first).alias("first"), (F.col("start_pos") + F.least(last, F.col("size"))).alias("last"))
        made = parsing.extract_ranges(tuples, reference, ranges)
        own = residues.join(ranges, "file_id").select("file_id", variants.cut(F.col("seq"), F.col("first"), F.col("last")).alias("seq"))
        out = made.unionByName(own).join(files.select("file_id", "filename"), "file_id").select(F.col("filename").alias("seq_name"), "file_id", "seq")
    else:
        whole = parsing.decode(tuples, reference).unionByName(residues.select("file_id", "seq")).join(files.select("file_id"), "file_id", "left_semi")
        # files without residues have no tuples
        cut = sequences.join(files.select("file_id"), "file_id", "left_semi").join(whole, "file_id", "left").withColumn("seq", F.coalesce("seq", F.lit("")))
        out = cut.select("file_id", "seq_no", "seq_name", F.col("seq").substr((F.col("start_pos") + 1).cast("int"), F.col("size").cast("int")).alias("seq"))
        if a.ori:
            texts = fasta.laid_out(out.join(files, "file_id")).join(files.select("file_id", "filename"), "file_id")
            fasta.write_exact(texts, a.out)
            return
    if a.out == "noop":
        out.write.format("noop").mode("overwrite").save()
    else:
        fasta.write_fasta(out, a.out)


def list_files(spark: SparkSession, a) -> None:
    files = spark.read.parquet(f"{a.archive}/files").select("ord", "is_reference", "filename")
    for k, row in enumerate(files.orderBy("ord").toLocalIterator()):
        print(f"{k}. {'(reference) ' if row.is_reference else ''}{row.filename}")


def consensus(spark: SparkSession, a) -> None:
    rows, calls, samples = vcf.read_vcf(spark, a.vcf)
    records = fasta.records(fasta.read_files(spark, a.reference))
    # a record for each chromosome, named by its header's first word; a single record serves all
    one = records.count() == 1
    chrom = F.regexp_extract("seq_name", r"^\s*(\S*)", 1)
    reference = records.select(*([] if one else [chrom.alias("chrom")]), F.col("seq").alias("ref_seq"))
    headers = records.select(*([] if one else [chrom.alias("chrom")]), F.col("seq_name").alias("header"))
    moved = rows.withColumn("pos", F.col("pos") - (a.start - 1))
    names = spark.createDataFrame(list(enumerate(samples)), "sample_no int, sample string")
    haps = F.explode(F.array(*(F.struct(F.lit(h).alias("hap"), variants.allele(F.col("gt"), h).alias("allele")) for h in range(a.ploidy)))).alias("h")
    genotypes = calls.join(F.broadcast(names), "sample_no").select("line_no", "sample", haps).select("line_no", "sample", "h.hap", "h.allele")
    classed = variants.classified(moved, reference, haploid=a.ploidy == 1)
    found = variants.events(classed, genotypes)
    haplotypes = names.select("sample", F.explode(F.array(*(F.lit(h) for h in range(a.ploidy)))).alias("hap"))
    if not one:
        haplotypes = haplotypes.crossJoin(F.broadcast(reference.select("chrom")))  # a name for each chromosome
    if a.strict:
        found = found.unionByName(variants.omitted_bases(classed, haplotypes))
    made = variants.consensus(found, haplotypes, reference)
    made = made.crossJoin(F.broadcast(headers)) if one else made.join(F.broadcast(headers), "chrom")  # a line for each chromosome
    text = fasta.rendered(F.col("header"), F.col("seq"), 70, final_feed=False)
    order = [] if one else ["chrom"]
    dealt = made.select("sample", "hap", *order, text.alias("value")).repartition("sample", "hap").sortWithinPartitions("sample", "hap", *order)
    dealt.drop(*order).write.partitionBy("sample", "hap").text(a.out)


def split_x(spark: SparkSession, a) -> None:
    male = set(spark.read.text(a.males, wholetext=True).first().value.split())
    vcf.write_lines(vcf.split_lines(spark, a.vcf, male, *a.bounds), a.out)


def columns(spark: SparkSession, a) -> None:
    spark.read.text(a.vcf).select(vcf.column_prefix(F.col("value"), a.columns).alias("value")).write.text(a.out)


def cut(spark: SparkSession, a) -> None:
    first = fasta.records(fasta.read_files(spark, a.reference)).where("seq_no = 0")
    header = F.concat("seq_name", F.lit(f" {a.start}-{a.end}"))
    first.select(fasta.rendered(header, variants.cut(F.col("seq"), F.lit(a.start), F.lit(a.end)), 70, final_feed=False).alias("value")).write.text(a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    {"encode": encode, "decode": decode, "list": list_files, "consensus": consensus, "cut": cut, "split-x": split_x, "columns": columns}[args.command](session, args)


if __name__ == "__main__":
    main()
