"""Command line, streaming ingest and the driver entry."""

import subprocess
import sys
from pathlib import Path

from strandlake import __main__ as cli
from strandlake.sources import archive
from strandlake.streaming import ingest

REF = ">r1\nACGTTGCAACGGTTAACCGGTACGATCGATTAGC\n>r2\nTTTTGGGGCCCCAAAATTTTGGGG\n"
ALT = ">a1\nACGTTGCAACGGTTAACCGGTTCGATCGATTAGC\n>a2\nTTTTGGGGCCCCAAATTTTGGGG\n"


def text(folder: Path) -> dict[int, str]:
    return {int(p.parent.name.split("=")[1]): p.read_text() for p in folder.rglob("part-*.txt")}


def test_encode_decode(spark, tmp_path, capsys):
    for name, body in (("ref.fa", REF), ("alt.fa", ALT)):
        (tmp_path / name).write_text(body)
    made = f"{tmp_path}/made"
    (tmp_path / "list").write_text(f"{tmp_path}/ref.fa\n{tmp_path}/alt.fa\n")
    cli.main(["encode", made, f"@{tmp_path}/list"], spark)
    assert spark.read.parquet(f"{made}/segments").count() == 0
    cli.main(["list", made], spark)
    assert capsys.readouterr().out.split("\n")[:2] == ["0. (reference) ref.fa", "1. alt.fa"]
    cli.main(["decode", made, f"{tmp_path}/out", "alt.fa", "none.fa"], spark)
    assert "no such file: none.fa" in capsys.readouterr().out
    assert text(tmp_path / "out").get(1, "").strip() == ALT.strip() and 0 not in text(tmp_path / "out")
    cli.main(["decode", made, "noop"], spark)


LAYOUTS = {
    "ref.fa": b">r1\nACGTTGCAACGGTTAACCGG\nTACGATCGATTAGC\n>r2 x\nTTTTGGGGCC\n",
    "crlf.fa": b">a\r\nACGTTGCAACGG\r\nTTAACCGGTACG\r\nATCG\r\n>b\r\nTTTTGG\r\n",
    "cr.fa": b">a\rACGTTGCAACGGTTAACCGGTACGATC\rGATT\r>b\rNNNNNNNNNNNNNNNNNNNN",
    "wide.fa": b">a\n" + b"ACGTTGCAACGG" * 20 + b"\n>b\nacgtnn\n",
    "open.fa": b">a\nACGTTGCAACGGTTAACCGGTACGATCGATTAGC\n>b\n",
    "empty.fa": b">a\n>b\n",
}


def test_exact_files(spark, tmp_path):
    (tmp_path / "other").mkdir()
    for name, body in LAYOUTS.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "other" / "cr.fa").write_bytes(LAYOUTS["wide.fa"])  # a name that repeats
    paths = [f"{tmp_path}/{n}" for n in LAYOUTS] + [f"{tmp_path}/other/cr.fa"]
    cli.main(["encode", f"{tmp_path}/made", *paths], spark)
    assert spark.read.parquet(f"{tmp_path}/made/segments").count() > 0
    cli.main(["decode", f"{tmp_path}/made", f"{tmp_path}/out", "--ori"], spark)
    got = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    want = {f"{n}.ori": b for n, b in LAYOUTS.items() if n != "cr.fa"} | {"cr.fa.2.ori": LAYOUTS["cr.fa"], "cr.fa.6.ori": LAYOUTS["wide.fa"]}
    assert got == want
    cli.main(["decode", f"{tmp_path}/made", f"{tmp_path}/part", "crlf.fa", "ref.fa", "--range", "3", "6", "--sequence", "a"], spark)
    assert text(tmp_path / "part") == {1: ">crlf.fa\nGTTG\n"}


def test_split_and_columns(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tm1\tf1\tm2\n"
    rows = [f"X\t{p}\t.\tA\tC\t.\tPASS\tVT=SNP\tGT\t0|{p}\t1|{p}\t2|{p}" for p in (5, 10, 20, 21)]
    (tmp_path / "x.vcf").write_text(head + "\n".join(rows) + "\n")
    (tmp_path / "males").write_text("m1\nm2\n")
    cli.main(["split-x", f"{tmp_path}/x.vcf", f"{tmp_path}/males", f"{tmp_path}/out", "--bounds", "10", "20"], spark)
    got = {}
    for part in ("fem", "mal", "mal1", "mal2"):
        got[part] = "".join(p.read_text() for p in sorted((tmp_path / "out" / f"part={part}").glob("part-*.txt"))).splitlines()
    cut = lambda line, keep: "\t".join([*line.split("\t")[:9], *(line.split("\t")[k] for k in keep)])
    lines = [*head.splitlines(), *rows]
    for part, keep, chosen in (("fem", (10,), (0, 1, 2, 3)), ("mal", (9, 11), (1, 2)), ("mal1", (9, 11), (0,)), ("mal2", (9, 11), (3,))):
        assert got[part] == [lines[0], cut(lines[1], keep), *(cut(lines[2 + k], keep) for k in chosen)]
    cli.main(["columns", f"{tmp_path}/x.vcf", f"{tmp_path}/cut", "11"], spark)
    kept = "".join(p.read_text() for p in sorted((tmp_path / "cut").glob("part-*.txt"))).splitlines()
    assert kept == [lines[0], *("\t".join(x.split("\t")[:11]) for x in lines[1:])]


def test_consensus_of_two_chromosomes(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(">1 first\nACGTACGTAC\n>Y second\nTTTTGGGG\n")
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n"
    (tmp_path / "a.vcf").write_text(head + "1\t2\t.\tC\tT\t.\tPASS\tVT=SNP\tGT\t1\nY\t2\t.\tT\tA\t.\tPASS\tAC=1\tGT\t1\nY\t5\t.\tG\tC\t.\tPASS\tVT=SNP\tGT\t1\n")
    cli.main(["consensus", f"{tmp_path}/a.vcf", f"{tmp_path}/ref.fa", f"{tmp_path}/c", "--ploidy", "1"], spark)
    got = "".join(p.read_text() for p in sorted((tmp_path / "c").rglob("part-*.txt")))
    assert got.split() == [">1", "first", "ATGTACGTAC", ">Y", "second", "TATTCGGG"]


def test_consensus_and_cut(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(">1 test\nACGTACGTAC\n")
    (tmp_path / "a.vcf").write_text(
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n1\t2\t.\tC\tT\t.\tPASS\tVT=SNP\tGT\t1|0\n1\t5\t.\tACG\tA\t.\tPASS\tVT=INDEL\tGT\t0|1\n"
    )
    cli.main(["consensus", f"{tmp_path}/a.vcf", f"{tmp_path}/ref.fa", f"{tmp_path}/c"], spark)
    got = {p.parent.name: p.read_text().split("\n")[1] for p in (tmp_path / "c").rglob("part-*.txt")}
    assert got == {"hap=0": "ATGTACGTAC", "hap=1": "ACGTATAC"}
    (tmp_path / "b.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n1\t2\t.\tG\tT\t.\tPASS\tVT=SNP\tGT\t1|0\n")
    for flags, want in (([], "ACGTACGTAC"), (["--strict"], "AGTACGTAC")):
        out = tmp_path / f"s{len(flags)}"
        cli.main(["consensus", f"{tmp_path}/b.vcf", f"{tmp_path}/ref.fa", str(out), "--ploidy", "1", *flags], spark)
        assert next(out.rglob("part-*.txt")).read_text().split("\n")[1] == want
    cli.main(["cut", f"{tmp_path}/ref.fa", f"{tmp_path}/k", "3", "99"], spark)
    assert next((tmp_path / "k").glob("part-*.txt")).read_text().strip() == ">1 test 3-99\nGTACGTAC"


def test_streaming_ingest(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(ALT)
    reference = "".join(x for x in REF.split("\n") if x and x[0] != ">")
    for extra in (None, "b.fa"):
        if extra:
            (tmp_path / "in" / extra).write_text(REF)
        ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", reference, f"{tmp_path}/check").awaitTermination()
    files = spark.read.parquet(f"{tmp_path}/out/files")
    assert {r.filename: r.n_residues for r in files.where("not is_reference").collect()} == {"a.fa": 57, "b.fa": 58}
    assert spark.read.parquet(f"{tmp_path}/out/tuples").groupBy("file_id").sum("len").count() == 2
    cli.main(["list", f"{tmp_path}/out"], spark)
    assert capsys.readouterr().out.split("\n")[:3] == ["0. (reference) reference", "1. a.fa", "2. b.fa"]
    cli.main(["decode", f"{tmp_path}/out", f"{tmp_path}/back", "--ori"], spark)
    assert (tmp_path / "back" / "a.fa.ori").read_text() == ALT and (tmp_path / "back" / "b.fa.ori").read_text() == REF


def test_entry_without_llm():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("strandlake.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) == 51 and set(e.oracle_sql()) == set(e.queries()), len(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_split_reads_its_file_once(spark, tmp_path):
    import pytest

    from strandlake.sources import vcf

    (tmp_path / "x.vcf").write_text("##m\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nX\tbad\t.\tA\tC\t.\t.\t.\tGT\t0\t1\n\n")
    rows = vcf.split_lines(spark, f"{tmp_path}/x.vcf", {"a"}, 10, 20)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    # a record without a place is in no region
    assert sorted((r.part, r.value.split("\t")[-1]) for r in rows.collect()) == sorted([(p, "##m") for p in ("fem", "mal", "mal1", "mal2")] + [("fem", "b"), ("fem", "1"), ("mal", "a"), ("mal1", "a"), ("mal2", "a")])
    (tmp_path / "none.vcf").write_text("X\t1\t.\tA\tC\t.\t.\t.\tGT\t0\n")
    with pytest.raises(ValueError, match="none.vcf has no #CHROM"):
        vcf.split_lines(spark, f"{tmp_path}/none.vcf", set(), 1, 2)
