"""Variant classes, validity, genotypes and consensus sequences, as relational operators.

Deletions are intervals merged by a running maximum and the reference is copied in slices between events, so the
work follows the number of variants, never the number of bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import staged
from .matching import checked_broadcast

#: Residues in a row of a reference that single places are looked up in, and of one that slices are cut from.
LOOKUP, SLICE = 1 << 10, 1 << 14
#: Positions whose first lines are broadcast.
POSITIONS = 1 << 19


def variant_class(info: Column, chrom: Column | None = None, ref: Column | None = None, alts: Column | None = None) -> Column:
    """SNP, INDEL or SV by the VT field of INFO, tried in this order; null if none.

    With chrom, ref and alts, single-letter records of chromosome Y count as SNP even without VT.
    """
    out = F.when(F.contains(info, F.lit("VT=SNP")), "SNP")
    if chrom is not None:
        out = out.when((chrom == "Y") & (F.length(ref) == 1) & (F.length(F.get(alts, F.lit(0))) == 1), "SNP")
    return out.when(F.contains(info, F.lit("VT=INDEL")), "INDEL").when(F.contains(info, F.lit("VT=SV")), "SV")


def end_of(info: Column) -> Column:
    """The END field of INFO as a number, or null."""
    return F.regexp_extract(info, "(?:^|;)END=([^;]*)", 1).try_cast("bigint")


def _chunks(reference: DataFrame, size: int, more: int = 0) -> tuple[DataFrame, list[str]]:
    """(chrom, chunk, bases) of a reference (chrom, ref_seq), and the columns that name a chromosome.

    Chunks are size residues long and hold so many more of the next one.

    A reference without chrom is one chromosome, whatever variants call it.
    """
    keys = [c for c in ("chrom",) if c in reference.columns]
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("ref_seq") - 1) / size).cast("int")),
        lambda k: F.struct(k.cast("long").alias("chunk"), F.substring("ref_seq", k * size + 1, size + more).alias("bases")),
    )
    return reference.where(F.length("ref_seq") > 0).select(*keys, F.explode(cut).alias("c")).select(*keys, "c.*"), keys


def _near(cut: DataFrame, reference: DataFrame) -> DataFrame:
    """Chunks of a reference, broadcast if it is small: variants then stay where they are."""
    return checked_broadcast(cut, reference.agg(F.sum(F.length("ref_seq"))).first()[0] or 0)


def reference_base(rows: DataFrame, reference: DataFrame, name: str = "base", length: int = 1) -> DataFrame:
    """rows (chrom, pos) with the reference's residues from there on; empty beyond it. Joined by chromosome and chunk."""
    cut, keys = _chunks(reference, LOOKUP, length - 1)
    at = rows.withColumn("chunk", F.floor((F.col("pos") - 1) / LOOKUP))
    joined = at.join(_near(cut, reference), [*keys, "chunk"], "left")
    base = F.col("bases").substr((F.col("pos") - F.col("chunk") * LOOKUP).cast("int"), F.lit(length))
    return joined.withColumn(name, F.coalesce(base, F.lit(""))).select(*rows.columns, name)


def reference_slices(rows: DataFrame, reference: DataFrame, name: str = "piece") -> DataFrame:
    """rows (chrom, from_, to_) with the residues from_ to to_ - 1, in pieces with their part number.

    A slice is cut at chunk borders and joined by chromosome and chunk, so no whole chromosome is sent to a task.
    """
    cut, keys = _chunks(reference, SLICE)
    spread = rows.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("from_") - 1) / SLICE), F.floor((F.col("to_") - 2) / SLICE))))
    low = F.greatest(F.col("from_") - 1, F.col("chunk") * SLICE)
    high = F.least(F.col("to_") - 1, (F.col("chunk") + 1) * SLICE)
    text = F.col("bases").substr((low - F.col("chunk") * SLICE + 1).cast("int"), (high - low).cast("int"))
    return spread.join(_near(cut, reference), [*keys, "chunk"]).withColumn(name, text).drop("bases")


def classified(variants: DataFrame, reference: DataFrame, partition: tuple[str, ...] = ("chrom",), haploid: bool = False) -> DataFrame:
    """variants with class, valid, reason, del_len and warned.

    variants: chrom, pos, line_no, ref, alts, filter, info. reference: rows (chrom, ref_seq), or one row (ref_seq) for
    all. A second record at a position can't be an SNP. A filter other than PASS or . is a warning only. With haploid,
    single-letter records of chromosome Y are SNPs whatever INFO says.
    """
    # the least line of each position, so records are not sorted; as few rows as positions are broadcast
    firsts = variants.groupBy(*(F.col(c).alias(f"first_{c}") for c in (*partition, "pos"))).agg(F.min("line_no").alias("first_line"))
    firsts = staged(firsts, "positions")
    firsts = F.broadcast(firsts) if firsts.count() <= POSITIONS else firsts
    y_rule = (F.col("chrom"), F.col("ref"), F.col("alts")) if haploid else ()
    rows = reference_base(variants.withColumn("class", variant_class(F.col("info"), *y_rule)), reference)
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in (*partition, "pos")]
    rows = rows.join(firsts, same).withColumn("repeated", F.col("line_no") > F.col("first_line")).drop(*firsts.columns)
    rows = rows.withColumn("end", end_of(F.col("info")))
    first = F.substring("ref", 1, 1)
    reason = (
        F.when(F.col("class").isNull(), "class")
        .when(
            F.col("class") == "SNP",
            F.when(F.col("repeated"), "repeated")
            .when(F.length("ref") != 1, "long ref")
            .when(F.col("ref") != F.col("base"), "ref mismatch")
            .when(F.exists("alts", lambda a: F.length(a) != 1), "long alt"),
        )
        .when(F.col("class") == "INDEL", F.when(F.exists("alts", lambda a: F.substring(a, 1, 1) != first), "first letters differ"))
        .otherwise(
            F.when(~F.contains("info", F.lit("SVTYPE=DEL")), "type")
            .when(F.col("end").isNull(), "no end")
            .when(F.exists("alts", lambda a: (a != "<DEL>") & (F.substring(a, 1, 1) != first)), "alt")
        )
    )
    deleted = (
        F.when(F.col("class") == "INDEL", F.length("ref") - 1).when(F.col("class") == "SV", F.greatest(F.col("end") - F.col("pos"), F.lit(0))).otherwise(0)
    )
    rows = rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).withColumn("del_len", deleted.cast("long"))
    return rows.withColumn("warned", ~F.col("filter").isin("PASS", ".")).drop("end")


def allele(gt: Column, haplotype: int) -> Column:
    """The allele number of a haplotype from genotype text: phased by |, else one number for both; . and junk are 0."""
    part = F.split(gt, r"\|")
    own = F.coalesce(F.get(part, F.lit(haplotype)), F.get(part, F.lit(0))) if haplotype else F.get(part, F.lit(0))
    return F.coalesce(F.regexp_extract(own, r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def in_range(number: Column, alts: Column) -> Column:
    """Numbers beyond the alternatives are 0."""
    return F.when(number > F.size(alts), 0).otherwise(number)


def allele_text(ref: Column, alts: Column, number: Column) -> Column:
    return F.when(number > 0, F.get(alts, number - 1)).otherwise(ref)


def _keys(rows: DataFrame) -> list[str]:
    """The columns that name a haplotype's chromosome."""
    return [c for c in ("sample", "chrom", "hap") if c in rows.columns]


def events(variants: DataFrame, genotypes: DataFrame) -> DataFrame:
    """What each haplotype's valid, non-reference records do: letter, inserted text and deleted length.

    variants are classified; genotypes: line_no, sample, hap, allele. Records without the alternative are dropped
    before anything is shuffled.
    """
    return called_events(genotypes.where("allele > 0").join(variants.where("valid"), "line_no"))


def called_events(called: DataFrame) -> DataFrame:
    """What valid variants do, of which each row is one on one haplotype that has its allele."""
    chosen = F.get(F.col("alts"), F.col("allele") - 1)
    tail = F.substring(chosen, 2, 1_000_000_000)
    insert = F.when((F.col("class") == "INDEL") & (F.length("ref") == 1), tail).when((F.col("class") == "SV") & (chosen != "<DEL>"), tail).otherwise("")
    return called.where("allele <= size(alts)").select(
        "sample", "chrom", "hap", "pos", "line_no", F.when(F.col("class") == "SNP", chosen).alias("letter"), insert.alias("insert"), "del_len"
    )


def omitted_bases(variants: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """Events that drop the base of each rejected record that is the first at its position, on every haplotype.

    For the strict reading, in which a record that is left out takes its reference base along.
    """
    lost = variants.where("not valid and not repeated").select("chrom", "pos", "line_no")
    owners = haplotypes.select(*_keys(haplotypes))
    joined = lost.join(F.broadcast(owners), "chrom") if "chrom" in owners.columns else lost.crossJoin(F.broadcast(owners))
    return joined.select(
        "sample", "chrom", "hap", "pos", "line_no", F.lit("").alias("letter"), F.lit("").alias("insert"), F.lit(0).cast("long").alias("del_len")
    )


def deletion_cover(found: DataFrame) -> DataFrame:
    """events with covered: the last base deleted by records at earlier positions, and up to and with this one."""
    order = Window.partitionBy(*_keys(found)).orderBy("pos", "line_no")
    earlier = Window.partitionBy(*_keys(found)).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    reach = F.when(F.col("del_len") > 0, F.col("pos") + F.col("del_len"))
    rows = found.withColumn("covered_before", F.coalesce(F.max(reach).over(earlier), F.lit(0)))
    return rows.withColumn("covered", F.coalesce(F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def suppressed_inserts(found: DataFrame) -> DataFrame:
    """events with emitted: of a second insertion at a position, only what goes beyond the longest before it."""
    same = Window.partitionBy(*_keys(found), "pos").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.coalesce(F.max(F.length("insert")).over(same), F.lit(0))
    return found.withColumn("emitted", F.col("insert").substr(longest + 1, F.length("insert")))


def consensus(found: DataFrame, haplotypes: DataFrame, reference: DataFrame) -> DataFrame:
    """(sample, chrom, hap, seq): the reference with each haplotype's events; those without events get the reference.

    haplotypes: sample, hap; with chrom as well if reference has it (chrom, ref_seq). Without, reference is one row
    (ref_seq) and events of any chrom count. Deleted bases vanish, an SNP on a deleted base too; insertions follow their
    base even if it is deleted.
    """
    sizes = reference.withColumn("size", F.coalesce(F.length("ref_seq"), F.lit(0)).cast("long")).drop("ref_seq")
    by = "chrom" in reference.columns
    owners = haplotypes.select(*(c for c in _keys(haplotypes) if by or c != "chrom"))
    # a row for each chromosome
    owners = owners.join(F.broadcast(sizes), "chrom") if by else owners.crossJoin(F.broadcast(sizes))
    keys = _keys(owners)
    start = owners.select(
        *keys, "size", F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("line_no"), F.lit(None).cast("string").alias("letter"),
        F.lit("").alias("insert"), F.lit(0).cast("long").alias("del_len"),
    )
    own = found.select(*keys, F.lit(None).cast("long").alias("size"), "pos", "line_no", "letter", "insert", "del_len")
    rows = suppressed_inserts(deletion_cover(own.unionByName(start)))
    order = Window.partitionBy(*keys).orderBy("pos", "line_no")
    rows = rows.withColumn("size", F.max("size").over(Window.partitionBy(*keys))).where("size is not null")
    rows = rows.withColumn("next_pos", F.lead("pos").over(order)).withColumn("last_pos", F.lag("pos").over(order))
    opens = (F.col("pos") > 0) & (F.col("last_pos") != F.col("pos")) & (F.col("pos") > F.col("covered_before")) & (F.col("pos") <= F.col("size"))
    first = F.greatest("pos", "covered") + 1
    until = F.least(F.coalesce("next_pos", F.col("size") + 1), F.col("size") + 1)
    slot = lambda n, text, low, high: F.struct(F.lit(n).alias("slot"), text.alias("text"), low.alias("from_"), high.alias("to_"))
    none, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    # a base of the reference, text of the records, and the reference up to the next event
    base = F.when(opens & F.col("letter").isNull(), slot(0, no_text, F.col("pos"), F.col("pos") + 1))
    lead = F.concat(F.when(opens, F.coalesce("letter", F.lit(""))).otherwise(""), "emitted")
    text = F.when((lead != "") | (F.col("line_no") == -1), slot(1, lead, none, none))  # every haplotype has a part
    tail = F.when((until > F.col("pos")) & (until > first), slot(2, no_text, first, until))
    parts = rows.select(*keys, "pos", "line_no", F.explode(F.array_compact(F.array(base, text, tail))).alias("p")).select(*keys, "pos", "line_no", "p.*")
    # slices get their residues where they stand, so parts are not shuffled again before they are put together
    cut, names = _chunks(reference, SLICE)
    chunks = F.sequence(F.floor((F.col("from_") - 1) / SLICE), F.floor((F.col("to_") - 2) / SLICE))
    spread = parts.withColumn("chunk", F.explode(F.when(F.col("text").isNull(), chunks).otherwise(F.array(F.lit(0).cast("long")))))
    low = F.greatest(F.col("from_") - 1, F.col("chunk") * SLICE)
    high = F.least(F.col("to_") - 1, (F.col("chunk") + 1) * SLICE)
    slice_ = F.col("bases").substr((low - F.col("chunk") * SLICE + 1).cast("int"), (high - low).cast("int"))
    pieces = spread.join(_near(cut, reference), [*names, "chunk"], "left").withColumn("text", F.coalesce("text", slice_))
    listed = F.array_sort(F.collect_list(F.struct("pos", "line_no", "slot", "chunk", "text")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda r: r["text"]), "").alias("seq"))


def cut_regions(regions: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, seq) of regions (key, start, end, and chrom if reference has it): residues start to end, from 1 and inclusive."""
    sizes = reference.withColumn("size", F.length("ref_seq").cast("long")).drop("ref_seq")
    sized = regions.join(F.broadcast(sizes), "chrom") if "chrom" in reference.columns else regions.crossJoin(F.broadcast(sizes))
    sized = sized.withColumn("from_", F.greatest(F.col("start"), F.lit(1)).cast("long")).withColumn("to_", F.least(F.col("end") + 1, F.col("size") + 1).cast("long"))
    pieces = reference_slices(sized.where("to_ > from_"), reference)
    listed = F.array_sort(F.collect_list(F.struct("chunk", "piece")))
    made = pieces.groupBy(key).agg(F.array_join(F.transform(listed, lambda r: r["piece"]), "").alias("seq"))
    return regions.select(key).join(made, key, "left").withColumn("seq", F.coalesce("seq", F.lit("")))


# Bounds of the pseudo-autosomal regions of chromosome X.
PAR1_END, PAR2_START = 2_699_521, 154_931_043


def region_part(pos: Column, low: int = PAR1_END, high: int = PAR2_START) -> Column:
    """mal1 before low, mal up to and with high, mal2 after; every row is in fem as well."""
    return F.when(pos < low, "mal1").when(pos <= high, "mal").otherwise("mal2")


def split_x(genotypes: DataFrame, samples: DataFrame, low: int = PAR1_END, high: int = PAR2_START) -> DataFrame:
    """genotypes (pos, sample, ...) dealt into the parts of male samples by region, and of female ones over all."""
    male = genotypes.join(samples.where("is_male"), "sample", "left_semi").withColumn("part", region_part(F.col("pos"), low, high))
    female = genotypes.join(samples.where("not is_male"), "sample", "left_semi").withColumn("part", F.lit("fem"))
    return male.unionByName(female)


def cut(seq: Column, start: Column, end: Column) -> Column:
    """Residues start to end, from 1 and inclusive, up to the sequence's end."""
    return seq.substr(start.cast("int"), (end - start + 1).cast("int"))
