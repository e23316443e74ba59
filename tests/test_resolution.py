"""Segments followed back as intervals against following every tuple, and what a selective decode reads."""

import random

import pytest

from strandlake import __main__ as cli
from strandlake.operators import dedup

SEG = "file_id long, tuple_no long, src_file long, src_tuple long, n_tuples long"


def made(seed, files=12, n=300):
    rng = random.Random(seed)
    segments, stored = [], []
    for f in range(files):
        at = 0
        while at < n:
            if f and rng.random() < 0.6:
                size = min(n - at, rng.choice([1, 5, 40, 200]))
                src = rng.randrange(f)
                segments.append((f, at, src, rng.randrange(n - size + 1), size))
                at += size
            else:
                stored.append((f, at))
                at += 1
    return segments, stored


def follow(segments, place):
    for f, at, src, first, n in segments:
        if f == place[0] and at <= place[1] < at + n:
            return follow(segments, (src, first + place[1] - at))
    return place


@pytest.mark.parametrize("span", [4, 64, 1 << 10])
def test_intervals(spark, monkeypatch, span):
    monkeypatch.setattr(dedup, "SPAN", span)
    segments, stored = made(span)
    df = spark.createDataFrame(segments, SEG)
    want = {(f, at + k): follow(segments, (src, first + k)) for f, at, src, first, n in segments for k in range(n)}
    assert set(want.values()) <= set(stored)

    def places(rows):
        out = {}
        for r in rows:
            for k in range(r.n_tuples):
                assert (r.file_id, r.tuple_no + k) not in out
                out[r.file_id, r.tuple_no + k] = (r.src_file, r.src_tuple + k)
        return out

    assert places(dedup.resolved(df).collect()) == want
    some = spark.createDataFrame([(5,), (11,)], "file_id long")
    assert places(dedup.resolved(df, some).collect()) == {k: v for k, v in want.items() if k[0] in (5, 11)}
    rows = spark.createDataFrame([(f, at) for f in range(12) for at in range(300)], "file_id long, tuple_no long")
    assert sorted(tuple(r) for r in dedup.uncovered(rows, df).collect()) == sorted(stored)


def test_selective_decode_reads_its_closure(spark, tmp_path):
    """Of a hundred files in ten families, one that repeats its family's first is decoded from a few buckets."""
    rng = random.Random(8)
    families = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(10)]
    for k in range(100):
        seq = list(families[k % 10])
        for _ in range(3):
            seq[rng.randrange(400)] = rng.choice("ACGT")
        (tmp_path / f"f{k:03}.fa").write_text(f">s{k}\n{''.join(seq)}\n")
    (tmp_path / "ref.fa").write_text(">r\n" + "".join(rng.choice("ACGT") for _ in range(400)) + "\n")
    names = [f"{tmp_path}/f{k:03}.fa" for k in range(100)]
    cli.main(["encode", f"{tmp_path}/made", f"{tmp_path}/ref.fa", *names], spark)
    from strandlake.sources import archive

    assert spark.read.parquet(f"{tmp_path}/made/segments").count() >= 90
    # all else is destroyed: what is still decoded was decoded without it
    family = spark.createDataFrame([(k + 1,) for k in range(7, 58, 10)], "file_id long")
    kept = {r.bucket for r in archive._bucketed(family).collect()}
    gone = 0
    for part in (tmp_path / "made" / "tuples").glob("bucket=*/*.parquet"):
        if int(part.parent.name.split("=")[1]) not in kept:
            part.write_bytes(b"")
            (part.parent / f".{part.name}.crc").unlink()
            gone += 1
    assert gone > 30 and len(kept) <= 6
    files, _, tuples = archive.read(spark, f"{tmp_path}/made", ["f057.fa"])
    assert files.count() == 1 and tuples.select("file_id").distinct().count() == 1
    cli.main(["decode", f"{tmp_path}/made", f"{tmp_path}/out", "f057.fa", "--ori"], spark)
    assert (tmp_path / "out" / "f057.fa.ori").read_bytes() == (tmp_path / "f057.fa").read_bytes()


def test_segment_deltas_against_steps(spark, monkeypatch):
    """Expected places by a join over residues against moving tuple by tuple."""
    monkeypatch.setattr(dedup, "RESIDUES", 64)
    rng = random.Random(6)
    lens = {(f, t): rng.choice([1, 1, 1, 7, 30, 200]) for f in range(5) for t in range(60)}
    segments = []
    for f in range(1, 5):
        at = rng.randrange(4)
        while at < 58:
            n = rng.randint(1, min(8, 60 - at))
            segments.append((f, at, rng.randrange(f), rng.randrange(60 - n), n))
            at += n + rng.randrange(6)
    want, last = [], {}
    for f, at, g, src, n in segments:
        had = sum(lens[f, t] for t in range(at))
        place, before = last.get((f, g), (0, 0))
        left = had - before
        while left > 0 and place < 60:
            step = lens[g, place]
            if step <= 2 * left:
                place += 1
            left -= step
        want.append((f, at, g, src, n, place, src - place))
        last[f, g] = src + n, had + sum(lens[f, t] for t in range(at, at + n))
    tuples = spark.createDataFrame([(*k, v) for k, v in lens.items()], "file_id long, tuple_no long, len long")
    assert sorted(map(tuple, dedup.segment_deltas(spark.createDataFrame(segments, SEG), tuples).collect())) == sorted(want)


def test_delta_coded_streams(spark, tmp_path):
    """Stored tuples come back as they were, in fewer bytes than as plain columns."""
    from strandlake.operators import parsing
    from strandlake.sources import archive

    rng = random.Random(1)
    rows = []
    for f in range(3):
        out, ref = 0, 1
        for t in range(4000):
            kind = rng.choice(["MATCH", "MATCH", "LIT", "N_RUN"])
            n = 1 if kind == "LIT" else rng.randrange(15, 4000)
            ref = ref + rng.choice([0, 0, 0, 3, -2]) if rng.random() < 0.9 else rng.randrange(1, 10**7)
            rows.append((f, t, kind, ref if kind == "MATCH" else None, n, "A" if kind == "LIT" else None, out))
            out, ref = out + n, ref + n
    kept = [r for r in rows if r[1] % 1000 < 700]  # segments cover the others
    df = spark.createDataFrame(kept, parsing.TUPLES)
    assert sorted(map(tuple, archive.delta_decoded(archive.delta_coded(df)).collect())) == sorted(kept)
    none = spark.createDataFrame([], archive.SEGMENTS)
    archive.write_streams(f"{tmp_path}/a", df, none)
    stored = spark.read.schema(archive.STORED).parquet(f"{tmp_path}/a/tuples")
    assert sorted(map(tuple, archive.delta_decoded(stored).collect())) == sorted(kept)
    df.coalesce(1).sortWithinPartitions("file_id", "tuple_no").write.option("compression", "zstd").parquet(f"{tmp_path}/plain")
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / folder).rglob("*.parquet"))
    assert size("a/tuples") < 0.7 * size("plain")
