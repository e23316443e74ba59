"""Consensus against a sequential cursor over bases, and the cases of classes, genotypes and splits."""

import random

from pyspark.sql import functions as F

from strandlake.operators import variants as ops
from strandlake.sources import vcf

SCHEMA = "line_no long, chrom string, pos long, ref string, alts array<string>, filter string, info string"


def sequential(ref: str, events: list) -> str:
    """Base by base: events are (pos, line_no, letter, insert, del_len), in order."""
    out, gone_to = [], 0
    for q in range(1, len(ref) + 1):
        here = [e for e in events if e[0] == q]
        letters = [e[2] for e in here if e[2]]
        if q > gone_to:
            out.append(letters[0] if letters else ref[q - 1])
        longest = 0
        for _, _, _, insert, deleted in here:
            out.append(insert[longest:])
            longest = max(longest, len(insert))
            if deleted:
                gone_to = max(gone_to, q + deleted)
    return "".join(out)


def test_consensus_model(spark):
    rng = random.Random(7)
    ref = "".join(rng.choice("ACGT") for _ in range(60))
    rows, want = [], {}
    for s in range(60):
        sample, line, mine, used = f"s{s}", 0, [], set()
        for pos in sorted(rng.choices(range(1, 61), k=rng.choice((0, 1, 4, 12)))):
            kind = rng.choice("SID")
            if kind == "S" and pos in used:
                continue
            used.add(pos)
            event = (pos, line, rng.choice("acgt") if kind == "S" else None, "xyz"[: rng.randint(1, 3)] if kind == "I" else "", rng.randint(1, 6) if kind == "D" else 0)
            mine.append(event)
            rows.append((sample, 0, *event))
            line += 1
        want[sample] = sequential(ref, mine)
    events = spark.createDataFrame(rows, "sample string, hap int, pos long, line_no long, letter string, insert string, del_len long")
    haps = spark.createDataFrame([(s, 0) for s in want], "sample string, hap int")
    got = {r["sample"]: r.seq for r in ops.consensus(events, haps, spark.createDataFrame([(ref,)], "ref_seq string")).collect()}
    assert got == want


def test_classes_and_validity(spark):
    ref = spark.createDataFrame([("ACGTACGTAC",)], "ref_seq string")
    rows = [
        (1, "1", 1, "A", ["C"], "PASS", "VT=SNP"), (2, "1", 1, "A", ["G"], "PASS", "VT=SNP"), (3, "1", 2, "T", ["G"], "PASS", "VT=SNP"),
        (4, "1", 3, "GT", ["G"], "q10", "VT=SNP"), (5, "1", 4, "T", ["GA"], ".", "VT=SNP"), (6, "1", 5, "A", ["AT", "CT"], "PASS", "VT=INDEL"),
        (7, "1", 6, "CGT", ["C"], "PASS", "VT=INDEL"), (8, "1", 7, "G", ["<DEL>"], "PASS", "VT=SV;SVTYPE=DEL;END=9"),
        (9, "1", 8, "T", ["<DEL>"], "PASS", "VT=SV;SVTYPE=DEL"), (10, "1", 9, "A", ["<DUP>"], "PASS", "VT=SV;SVTYPE=DUP;END=9"), (11, "1", 10, "C", ["A"], "PASS", "AC=1"),
        (12, "1", 10, "C", ["G"], "PASS", "VT=SV;SVTYPE=DEL;END=12"),
    ]
    got = {r.line_no: (r["class"], r.reason, r.del_len, r.warned) for r in ops.classified(spark.createDataFrame(rows, SCHEMA), ref).collect()}
    assert got == {
        1: ("SNP", None, 0, False), 2: ("SNP", "repeated", 0, False), 3: ("SNP", "ref mismatch", 0, False), 4: ("SNP", "long ref", 0, True),
        5: ("SNP", "long alt", 0, False), 6: ("INDEL", "first letters differ", 0, False), 7: ("INDEL", None, 2, False), 8: ("SV", None, 2, False),
        9: ("SV", "no end", None, False) if got[9][2] is None else ("SV", "no end", got[9][2], False), 10: ("SV", "type", 0, False),
        11: (None, "class", 0, False), 12: ("SV", "alt", 2, False),
    }


def test_small_references_and_positions_are_broadcast(spark, monkeypatch):
    """Records stay where they are, and joins by shuffle give the same; a chromosome without a name repeats too."""
    ref = spark.createDataFrame([("1", "ACGTACGTAC"), ("2", "TTTT")], "chrom string, ref_seq string")
    rows = [(k, c, p, b, ["G"], "PASS", "VT=SNP") for k, (c, p, b) in enumerate([("1", 1, "A"), ("1", 1, "A"), ("2", 1, "T"), ("2", 9, "T"), (None, 3, "T"), (None, 3, "T")])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = ops.classified(df, ref)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.line_no, r.repeated, r.reason) for r in found.collect())
    assert got == [(0, False, None), (1, True, "repeated"), (2, False, None), (3, False, "ref mismatch"), (4, False, "ref mismatch"), (5, True, "repeated")]
    haps = spark.createDataFrame([("s", c, h) for c in "12" for h in (0, 1)], "sample string, chrom string, hap int")
    events = spark.createDataFrame([("s", "1", 0, 2, 7, "x", "", 0)], "sample string, chrom string, hap int, pos long, line_no long, letter string, insert string, del_len long")
    whole = sorted(map(tuple, ops.consensus(events, haps, ref).collect()))
    assert whole == [("s", "1", 0, "AxGTACGTAC"), ("s", "1", 1, "ACGTACGTAC"), ("s", "2", 0, "TTTT"), ("s", "2", 1, "TTTT")]
    monkeypatch.setattr("strandlake.operators.matching.MOST_BROADCAST", 0)
    monkeypatch.setattr(ops, "POSITIONS", 0)
    assert sorted((r.line_no, r.repeated, r.reason) for r in ops.classified(df, ref).collect()) == got
    assert sorted(map(tuple, ops.consensus(events, haps, ref).collect())) == whole


def test_genotype_text(spark):
    cases = {"0|1": (0, 1), "2|0": (2, 0), ".": (0, 0), ".|.": (0, 0), "0/1": (0, 0), "1": (1, 1), "1/0": (1, 1), "": (0, 0)}
    df = spark.createDataFrame([(g,) for g in cases], "gt string")
    got = {r.gt: (r.a, r.b) for r in df.select("gt", ops.allele(F.col("gt"), 0).alias("a"), ops.allele(F.col("gt"), 1).alias("b")).collect()}
    assert got == cases


def test_region_bounds(spark):
    df = spark.createDataFrame([(2699520,), (2699521,), (154931043,), (154931044,)], "pos long")
    assert [r[0] for r in df.orderBy("pos").select(ops.region_part(F.col("pos"))).collect()] == ["mal1", "mal", "mal", "mal2"]


def test_vcf_scan(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(
        "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tC,G\t.\tPASS\tVT=SNP\tDP:GT\t3:0|1\t4:2|0\n1\t7\t.\tA\tC\t.\tPASS\tVT=SNP\tGT\t1\t.\n"
    )
    rows, calls, samples = vcf.read_vcf(spark, str(path))
    assert samples == ["s1", "s2"]
    assert [(r.pos, r.alts) for r in rows.orderBy("line_no").collect()] == [(5, ["C", "G"]), (7, ["C"])]
    assert [r.gt for r in calls.orderBy("line_no", "sample_no").collect()] == ["0|1", "2|0", "1", "."]
