"""The driver's tables as sequence collections, tuple streams and variants; SQL twins of each stand beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import staged
from ..functions.residues import letters
from ..operators import variants as ops
from ..ordering import numbered
from ..session import table

# ------------------------------------------------------------------ sequences

SEQS = "seqs as (select doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) seq from documents)"
REF = "ref as (select seq ref_seq from seqs where doc_id = (select min(doc_id) from seqs))"


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", letters(F.col("text")).alias("seq"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the sequence of the least doc_id."""
    docs = table(spark, sf_dir, "documents")
    least = docs.agg(F.min("doc_id").alias("doc_id"))
    first = docs.select("doc_id", "text").join(F.broadcast(least), "doc_id").agg(F.min("text").alias("text"))
    return first.select(letters(F.col("text")).alias("seq"))


# ------------------------------------------------------------------ lines as records

LINES = r"""lines as (
  select doc_id, k - 1 seq_no, regexp_replace(string_split(text, chr(10))[k], '[^A-Za-z]', '', 'g') seq
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) k from documents))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a record of it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq_no", "line"))
    rows = rows.select("doc_id", "seq_no", F.regexp_replace("line", "[^A-Za-z]", "").alias("seq"))
    return rows.withColumn("line_len", F.length("seq"))


# ------------------------------------------------------------------ tuple streams

TUPLES = """tuples as (
  select l_suppkey % 20 file_id, row_number() over (partition by l_suppkey % 20 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 tuple_no,
    case when l_linenumber % 3 = 0 then 'LIT' when l_partkey % 17 = 0 then 'N_RUN' else 'MATCH' end kind,
    case when l_linenumber % 3 = 0 or l_partkey % 17 = 0 then null else l_partkey end ref_pos,
    case when l_linenumber % 3 = 0 then 1 else l_suppkey + l_partkey * 13 % 700 + 1 end len,
    case when l_linenumber % 3 = 0 then substr('ACGTN', cast(l_partkey % 5 + 1 as int), 1) end lit,
    concat(l_returnflag, l_linestatus, cast(l_partkey % 97 as varchar)) sig
  from lineitem)"""


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tuples of 20 files."""
    order = Window.partitionBy("file_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("file_id", F.expr("l_suppkey % 20"))
    rows = rows.withColumn("tuple_no", (F.row_number().over(order) - 1).cast("long"))
    literal, run = F.expr("l_linenumber % 3 = 0"), F.expr("l_partkey % 17 = 0")
    return rows.select(
        "file_id", "tuple_no",
        F.when(literal, "LIT").when(run, "N_RUN").otherwise("MATCH").alias("kind"),
        F.when(~literal & ~run, F.col("l_partkey")).alias("ref_pos"),
        F.when(literal, 1).otherwise(F.expr("l_suppkey + l_partkey * 13 % 700 + 1")).alias("len"),
        F.when(literal, F.expr("substr('ACGTN', cast(l_partkey % 5 + 1 as int), 1)")).alias("lit"),
        F.concat("l_returnflag", "l_linestatus", F.expr("cast(l_partkey % 97 as string)")).alias("sig"),
    )


FILES = """files as (select row_number() over (order by file_id) - 1 ord, file_id, concat('f', cast(file_id as varchar)) filename
  from (select distinct file_id from tuples))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the tuples belong to."""
    found = tuples(spark, sf_dir).select("file_id").distinct()
    return numbered(found.withColumn("filename", F.concat(F.lit("f"), F.col("file_id").cast("string"))), "file_id")


# ------------------------------------------------------------------ variants

#: A chromosome for each language: the sequence of its least doc_id.
REFS = """refs as (select lang chrom, arg_min(seq, doc_id) ref_seq, row_number() over (order by lang) - 1 chrom_no
  from (select doc_id, lang, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) seq from documents) group by lang)"""

_NUMBER = ("chrom", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

VARIANTS = f"""{REFS},
l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, chrom, ref_seq s, l_suppkey % 5 cls, o_custkey,
       1 + (l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 17) % greatest(length(ref_seq) - 8, 1) pos
     from lineitem join refs on chrom_no = l_linenumber % (select count(*) from refs) join orders on o_orderkey = l_orderkey),
variants as (select row_number() over (order by pos, {", ".join(_NUMBER)}) line_no, chrom, pos, o_custkey,
       case when l_orderkey % 1100 = 0 then '0' when cls = 2 then substr(s, pos, 3) else substr(s, pos, 1) end as ref,
       case cls when 0 then case when substr(s, pos, 1) = 'A' then 'C' else 'A' end
                when 1 then concat(substr(s, pos, 1), 'GT') when 2 then substr(s, pos, 1)
                when 3 then '<DEL>' else 'T,G' end alt,
       case when l_orderkey % 700 = 0 then 'q10' else 'PASS' end as filter,
       case cls when 1 then 'VT=INDEL' when 2 then 'VT=INDEL'
                when 3 then concat('SVTYPE=DEL;VT=SV;END=', cast(pos + 5 as varchar)) else 'VT=SNP' end info
     from l)"""


def chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, ref_seq): a row for each language."""
    found = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("chrom")).agg(F.min_by("text", "doc_id").alias("text"))
    return staged(found.select("chrom", letters(F.col("text")).alias("ref_seq")), "chromosomes")  # a row for each language


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as variants of the chromosomes, each called in the customer of its order."""
    refs = chromosomes(spark, sf_dir)
    # as many rows as chromosomes
    sizes = refs.select("chrom", F.length("ref_seq").alias("size")).withColumns(
        {"chrom_no": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("chrom")) - 1, "chroms": F.count("*").over(Window.partitionBy(F.lit(1)))}
    )
    rows = table(spark, sf_dir, "lineitem").join(F.broadcast(sizes), F.expr("chrom_no = l_linenumber % chroms"))
    rows = rows.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumn("pos", F.expr("1 + (l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 17) % greatest(size - 8, 1)"))
    rows = numbered(rows.select("pos", *_NUMBER, "o_custkey"), "pos", "line", _NUMBER)
    rows = ops.reference_base(rows, refs, "bases", 3).withColumn("cls", F.expr("l_suppkey % 5"))
    base = F.substring("bases", 1, 1)
    return rows.select(
        (F.col("line") + 1).alias("line_no"), "chrom", "pos", "o_custkey",
        F.when(F.expr("l_orderkey % 1100 = 0"), "0").when(F.col("cls") == 2, F.col("bases")).otherwise(base).alias("ref"),
        F.when(F.col("cls") == 0, F.when(base == "A", "C").otherwise("A")).when(F.col("cls") == 1, F.concat(base, F.lit("GT")))
        .when(F.col("cls") == 2, base).when(F.col("cls") == 3, "<DEL>").otherwise("T,G").alias("alt"),
        F.when(F.expr("l_orderkey % 700 = 0"), "q10").otherwise("PASS").alias("filter"),
        F.when(F.col("cls").isin(1, 2), "VT=INDEL")
        .when(F.col("cls") == 3, F.concat(F.lit("SVTYPE=DEL;VT=SV;END="), (F.col("pos") + 5).cast("string"))).otherwise("VT=SNP").alias("info"),
    ).withColumn("alts", F.split("alt", ","))


CLASSED = VARIANTS + """,
c0 as (select v.*, string_split(alt, ',') alts, substr(ref_seq, cast(pos as int), 1) base,
     case when contains(info, 'VT=SNP') then 'SNP' when contains(info, 'VT=INDEL') then 'INDEL' when contains(info, 'VT=SV') then 'SV' end as class,
     coalesce(lag(pos) over (partition by chrom order by pos, line_no) = pos, false) repeated,
     try_cast(regexp_extract(info, '(?:^|;)END=([^;]*)', 1) as bigint) ends
   from variants v join refs using (chrom)),
classed as (select *, case
     when class is null then 'class'
     when class = 'SNP' then case when repeated then 'repeated' when length(ref) <> 1 then 'long ref' when ref <> base then 'ref mismatch'
                                  when len(list_filter(alts, lambda a: length(a) <> 1)) > 0 then 'long alt' end
     when class = 'INDEL' then case when len(list_filter(alts, lambda a: substr(a, 1, 1) <> substr(ref, 1, 1))) > 0 then 'first letters differ' end
     else case when not contains(info, 'SVTYPE=DEL') then 'type' when ends is null then 'no end'
               when len(list_filter(alts, lambda a: a <> '<DEL>' and substr(a, 1, 1) <> substr(ref, 1, 1))) > 0 then 'alt' end end reason,
     case class when 'INDEL' then length(ref) - 1 when 'SV' then greatest(ends - pos, 0) else 0 end del_len
   from c0)"""

GENOTYPES = CLASSED + """,
samples as (select c_name sample, c_custkey, c_custkey % 2 = 1 is_male from customer),
genotypes as (
  select line_no, sample, chrom, 0 hap, (line_no + c_custkey) % 3 number, pos, alts, ref from classed join samples on c_custkey = o_custkey
  union all
  select line_no, sample, chrom, 1, (line_no + 2 * c_custkey + 1) % 2, pos, alts, ref from classed join samples on c_custkey = o_custkey)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("sample"), "c_custkey", F.expr("c_custkey % 2 = 1").alias("is_male"))


#: Phased genotype text of a variant (line_no) in the sample c_custkey.
GT = "concat(cast((line_no + c_custkey) % 3 as string), '|', cast((line_no + 2 * c_custkey + 1) % 2 as string))"


def genotype_text(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """(line_no, sample, pos, ref, alts, gt): phased genotype text of every variant in its sample."""
    rows = (found or variants(spark, sf_dir)).select("line_no", "pos", "ref", "alts", F.col("o_custkey").alias("c_custkey"))
    return rows.join(samples(spark, sf_dir), "c_custkey").select("line_no", "sample", "pos", "ref", "alts", F.expr(GT).alias("gt"))
