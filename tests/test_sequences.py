"""Round trips, boundaries and invariants of the sequence operators."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandlake.functions import buckets
from strandlake.operators import dedup, matching, parsing
from strandlake.sources import archive, fasta


def mutated(rng: random.Random, seq: str) -> str:
    out = []
    for ch in seq:
        r = rng.random()
        if r < 0.02:
            out.append(rng.choice("ACGT"))
        elif r < 0.03:
            out += [ch, rng.choice("ACGT")]
        elif r < 0.04:
            continue
        elif r < 0.043:
            out.append(rng.choice("Nn") * rng.choice((14, 15, 16, 40)))
        else:
            out.append(ch.lower() if r > 0.995 else ch)
    return "".join(out)


@pytest.mark.parametrize("indel2", [False, True])
def test_parse_round_trip(indel2):
    rng = random.Random(1)
    for _ in range(150):
        ref = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.choice((0, 5, 14, 15, 16, 400))))
        alt = mutated(rng, ref) if rng.random() < 0.8 else "".join(rng.choice("ACGT") for _ in range(50))
        tuples = parsing.Reference(ref).parse(alt, indel2=indel2)
        assert parsing.rebuild(tuples, ref) == alt
        assert sum(t[2] for t in tuples) == len(alt)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=80), st.integers(0, 10), st.text("ab", max_size=80), st.integers(0, 10))
def test_common_length(a, i, b, j):
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert parsing.common_length(a.encode(), i, b.encode(), j) == want


def test_long_runs_and_edit_moves():
    ref = "ACGTTGCAACGGTTAACCGGTACGATCGATTAGC"
    run = parsing.Reference(ref).parse("N" * 15 + ref)
    assert run[0] == ("N_RUN", None, 15, None) and run[1] == ("MATCH", 1, len(ref), None)
    assert parsing.Reference(ref).parse("N" * 14)[0][0] == "LIT"
    snp = parsing.Reference(ref).parse(ref[:18] + "T" + ref[19:])
    assert [t[0] for t in snp] == ["MATCH", "LIT", "MATCH"]
    deleted = parsing.Reference(ref).parse(ref[:18] + ref[19:])
    assert [t[0] for t in deleted] == ["MATCH", "MATCH"]


def test_relational_decode(spark):
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(500))
    files = [(k, mutated(rng, ref)) for k in range(1, 9)] + [(9, ""), (10, None), (11, ref)]
    tuples = parsing.encode(spark.createDataFrame(files, "file_id long, seq string"), ref).persist()
    reference = spark.createDataFrame([(ref,)], "ref_seq string")
    got = {r.file_id: r.seq for r in parsing.decode(tuples, reference).collect()}
    assert got == {k: s for k, s in files if s}
    cut = parsing.chunked_pieces(tuples, parsing.chunks(reference, 37), 37)
    assert {r.file_id: r.seq for r in parsing._joined(cut).collect()} == got
    merged = parsing.encode(spark.createDataFrame(files, "file_id long, seq string"), ref, merged=True).persist()
    assert merged.count() < tuples.count() and {r.file_id: r.seq for r in parsing.decode(merged, reference).collect()} == got
    for found in (tuples, merged):
        part = {r.file_id: r.seq for r in parsing.extract_range(found, reference, 41, 90).collect()}
        assert part == {k: s[40:90] for k, s in files if s and len(s) > 40}


def test_seed_matches_are_maximal(spark):
    ref = "ACGTTGCAACGGTTAACCGGTACGATCGATTAGC"
    docs = spark.createDataFrame([(1, "TT" + ref[3:30] + "GG"), (2, "ACGT"), (3, "")], "doc_id long, seq string")
    reference = spark.createDataFrame([(ref,)], "seq string")
    found = matching.maximal_matches(matching.seed_hits(docs, reference)).collect()
    raw = "TT" + ref[3:30] + "GG"
    assert len(found) == 1
    m = found[0]
    assert raw[m.alt_pos - 1 : m.alt_pos - 1 + m.len] == ref[m.ref_pos - 1 : m.ref_pos - 1 + m.len] and m.len >= 27


def test_retention_levels(spark):
    files = spark.range(12).selectExpr("id ord", "id file_id")
    for level, most in ((10, 10), (5, 4), (1, 0), (99, 10), (-3, 0)):
        assert dedup.retained(files, level).where("retained").count() == most


FASTA = [
    ("lf", ">one first\nACGT\nAC\n>two\nNNnn\n", [("one first", 4, "ACGTAC"), ("two", 4, "NNnn")], "LF"),
    ("crlf", "@one\r\nAC-GT*\r\nA1C\r\n", [("one", 6, "ACGTAC")], "CRLF"),
    ("cr", ">one\rACGT\rAC", [("one", 4, "ACGTAC")], "CR"),
    ("empty record", ">one\n>two\nA", [("one", 0, ""), ("two", 1, "A")], "LF"),
    ("header only", ">one", [("one", 0, "")], "LF"),
]


@pytest.mark.parametrize("name,content,want,eol", FASTA)
def test_fasta_records(spark, name, content, want, eol):
    df = spark.createDataFrame([(0, content)], "file_id long, content string")
    got = [(r.seq_name, r.line_len, r.seq) for r in fasta.records(df).orderBy("seq_no").collect()]
    assert got == want
    assert df.select(fasta.end_of_line(df.content)).first()[0] == eol


def test_numbering_is_by_key(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 k")
    got = archive.numbered(rows, "k").collect()
    assert all(r.k == r.ord for r in got) and len(got) == 1000


def test_numbering_of_many_rows(spark):
    rows = spark.range(3_000_000).selectExpr("(id * 2654435761) % 3000017 k", "concat('payload ', id) payload", "id % 3 part")
    got = archive.numbered(rows, "k", then=("payload",))
    assert got.columns == ["k", "payload", "part", "ord"]
    row = got.agg(F.count_distinct("ord").alias("d"), F.min("ord").alias("a"), F.max("ord").alias("b"), F.sum((F.col("k") < 0).cast("int")).alias("n")).first()
    assert (row.d, row.a, row.b) == (3_000_000, 0, 2_999_999)
    # keys grow with the number
    pairs = got.groupBy(F.floor(F.col("ord") / 1000).alias("g")).agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("g").collect()
    assert all(a.high <= b.low for a, b in zip(pairs, pairs[1:]))


def test_numbering_of_equal_and_missing_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), *((5, i) for i in range(50)), (7, 0)], "k long, v long")
    got = sorted((r.ord, r.k, r.v) for r in archive.numbered(rows, "k", then=("v",)).collect())
    assert [g[0] for g in got] == list(range(53)) and [g[1] for g in got] == [None, None, *[5] * 50, 7]
    assert [g[2] for g in got[2:52]] == list(range(50))
    assert archive.numbered(rows.limit(0), "k").collect() == []


def common(a, i, b, j):
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def plain_parse(alt, ref, k, least, indel2):
    """The parse residue by residue, comparing with every place of the reference."""
    out, i = [], 0
    while i < len(alt):
        run = len(alt) - i - len(alt[i:].lstrip(alt[i]))
        if alt[i] in "Nn" and run >= k:
            out.append((alt[i] + "_RUN", None, run, None))
            i += run
            continue
        best, at = 0, 0
        for q in range(len(ref) - k + 1):
            n = common(alt, i, ref, q)
            if n >= k and n > best and sum(x in "Nn" for x in ref[q : q + k]) <= 3:
                best, at = n, q
        if not best:
            out.append(("LIT", None, 1, alt[i]))
            i += 1
            continue
        out.append(("MATCH", at + 1, best, None))
        i, q = i + best, at + best
        while i < len(alt):
            moves = [(common(alt, i + a, ref, q + b), a, b) for a, b in [(1, 1), (1, 0), (0, 1)] + [(2, 0), (0, 2)] * indel2]
            most = max(m[0] for m in moves)
            n, a, b = next(m for m in moves if m[0] == most)
            if n < least:
                break
            out += [("LIT", None, 1, x) for x in alt[i : i + a]] + [("MATCH", q + b + 1, n, None)]
            i, q = i + a + n, q + b + n
    return out


def test_parse_against_plain_comparison():
    rng = random.Random(3)
    for _ in range(300):
        ref = "".join(rng.choice("ACGTNn" if rng.random() < 0.2 else "AC") for _ in range(rng.choice((0, 3, 30, 80))))
        alt = list(ref)
        for _ in range(rng.randint(0, 8)):
            if alt:
                alt[rng.randrange(len(alt))] = rng.choice(["A", "C", "", "AC", "NNNNNN", "nnnnn", "G"])
        alt, k, indel2 = "".join(alt), rng.choice((3, 4, 6)), rng.random() < 0.5
        assert parsing.Reference(ref, k).parse(alt, 2, indel2) == plain_parse(alt, ref, k, 2, indel2)


def test_residues_beyond_ascii(spark):
    with pytest.raises(Exception, match="file 3 holds residues beyond ASCII"):
        parsing.encode(spark.createDataFrame([(3, "ACGT\u00e9")], "file_id long, seq string"), "ACGT").collect()


def plain_segments(runs):
    """Greedy choice over runs (start, src_file, src, windows, tuples) of one file, place by place."""
    out, at = [], 0
    while any(s + w > at for s, _, _, w, _ in runs):
        here = [(-(s + n), f, x - s) for s, f, x, w, n in runs if s <= at < s + w]
        if not here:
            at += 1
            continue
        end, f, diag = min(here)
        out.append((at, f, at + diag, -end - at))
        at = -end
    return out


def test_chosen_segments(spark):
    rng = random.Random(8)
    runs = {f: [(rng.randrange(60), rng.randrange(f), rng.randrange(40), w := rng.randint(1, 9), w + rng.randint(1, 5)) for _ in range(rng.randint(0, 25))] for f in range(1, 30)}
    rows = [(f, s, g, x, w, n) for f, held in runs.items() for s, g, x, w, n in held]
    df = spark.createDataFrame(rows, "file_id long, tuple_no long, src_file long, src_tuple long, n_windows long, n_tuples long")
    got = {}
    for r in dedup.chosen_segments(df).orderBy("file_id", "tuple_no").collect():
        got.setdefault(r.file_id, []).append(tuple(r)[1:])
    assert got == {f: plain_segments(held) for f, held in runs.items() if held}


def test_segments_restore_streams(spark):
    rng = random.Random(9)
    base = [("MATCH", rng.randint(1, 900), rng.randint(15, 40), None) if rng.random() < 0.5 else ("LIT", None, 1, rng.choice("ACGT")) for _ in range(80)]
    rows = []
    for f in range(1, 7):
        own = list(base)
        for _ in range(4):
            own[rng.randrange(len(own))] = ("LIT", None, 1, rng.choice("acgt"))
        at = 0
        for k, (kind, pos, size, lit) in enumerate(own):
            rows.append((f, k, kind, pos, size, lit, at))
            at += size
    tuples = spark.createDataFrame(rows, parsing.TUPLES).persist()
    signed = tuples.withColumn("sig", F.concat_ws(":", "kind", "ref_pos", "len", "lit"))
    kept = spark.range(1, 7).selectExpr("id file_id")
    segments = dedup.chosen_segments(dedup.segment_matches(dedup.window_hits(dedup.windows(signed), kept))).persist()
    left = dedup.uncovered(tuples, segments)
    assert left.count() < tuples.count() / 2
    plain = lambda df: sorted(map(tuple, df.select(*tuples.columns).collect()), key=lambda r: r[:2])
    assert plain(dedup.restored(left, segments, 6)) == rows
    only = spark.createDataFrame([(5,)], "file_id long")
    assert plain(dedup.restored(left, segments, 6, only)) == [r for r in rows if r[0] == 5]


def test_seeds_rich_in_n_count(spark):
    reference = spark.createDataFrame([("NANCYNINNENNINANDCOLD",)], "seq string")
    docs = spark.createDataFrame([(1, "NANCYNINNENNINANDCOLD"), (2, "XXNINNENNINANDCOLD"), (3, "NINNENNINAN")], "doc_id long, seq string")
    hits = sorted(map(tuple, matching.seed_hits(docs, reference).collect()))
    assert hits == [*((1, k, k) for k in range(1, 8)), (2, 3, 6), (2, 4, 7)]
    assert matching.reference_index(reference).count() < 7  # the second stage's index leaves them out


def test_hashed_seeds_are_all_seeds(spark, monkeypatch):
    """Windows told by a hash against every window, over steps that cut texts; only those that occur become rows."""
    rng = random.Random(14)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    docs = spark.createDataFrame([(k, mutated(rng, ref).upper() if k % 3 else "".join(rng.choice("ACGT") for _ in range(rng.randrange(90)))) for k in range(40)] + [(98, ""), (99, None)], "doc_id long, seq string")
    reference = spark.createDataFrame([(ref,)], "seq string")
    for k in (1, 7, 15, 16):
        index = matching.reference_index(reference, k=k, most_n=None)
        want = sorted(map(tuple, matching.kmers(docs, "doc_id", "seq", k, "alt_pos").join(index, "kmer").select("doc_id", "alt_pos", "ref_pos").collect()))
        assert sorted(map(tuple, matching.seed_hits(docs, reference, k=k).collect())) == want and want
    assert matching.seeded_kmers(docs, ref, "doc_id", "seq", 15).count() < matching.kmers(docs, "doc_id", "seq", 15).count()
    assert matching.seed_hits(docs, spark.createDataFrame([("ACG",)], "seq string")).isEmpty()


def test_steps_cut_texts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(matching, "STEP", 7)
    texts = pa.array([b"", b"ABCDEFGHIJ", b"KLM", b"NOPQRSTUVWXYZ"]).slice(1)
    steps = list(matching._steps(texts, 2))
    assert b"".join(bytes(raw[:7]) for raw, _ in steps) == b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    whole = matching._hashes(np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8), 3)
    assert np.concatenate([matching._hashes(raw, 3) for raw, _ in steps]).tolist() == whole.tolist()


def test_bytes_are_counted_once(spark):
    texts = ["abcAB", "zz\u00e9", "", None, "N" * 3000]
    got = {r.byte: r.n for r in matching.byte_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()}
    want = {}
    for b in "".join(t or "" for t in texts).encode():
        want[b] = want.get(b, 0) + 1
    assert got == want


def test_matches_rich_in_n_are_whole(spark, tmp_path):
    """seed_matches and longest_match keep matches whose k-mers hold more N than the second stage's index takes."""
    docs = [(0, "nancy ninnennin and cold"), (1, "xx NINNENNINANDCOLD"), (2, "cold nancy ninnennin an")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from strandlake.plans import sequence_queries as q

    matches = sorted((r.doc_id, r.alt_pos, r.ref_pos, r.len) for r in q.seed_matches(spark, str(tmp_path)).collect())
    assert matches == [(0, 1, 1, 21), (1, 3, 6, 16), (2, 5, 1, 16)]
    assert sorted((r.doc_id, r.alt_pos, r.ref_pos, r.len) for r in q.longest_match(spark, str(tmp_path)).collect()) == matches


def test_packed_tuples(spark):
    rows = [("MATCH", 7, 300, None), ("MATCH", 2**31 - 3, 2**24 - 1, None), ("LIT", None, 1, "a"), ("LIT", None, 1, "T"), ("N_RUN", None, 15, None), ("n_RUN", None, 70000, None)]
    df = spark.createDataFrame(rows, "kind string, ref_pos long, len long, lit string")
    raw = df.select(buckets.packed(*(F.col(c) for c in df.columns)).alias("raw"))
    assert [len(r.raw) for r in raw.collect()] == [7, 7, 1, 1, 7, 7]
    assert raw.first().raw == bytes([0, 0, 0, 7, 0, 1, 44])
    assert [tuple(r) for r in raw.select(buckets.unpacked(F.col("raw")).alias("t")).select("t.*").collect()] == rows
    with pytest.raises(Exception, match="position out of range"):
        spark.createDataFrame([(2**31,)], "p long").select(buckets.checked_position(F.col("p"))).collect()


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f, n, rng.choice(("LIT", "MATCH")), rng.choice("abc")) for f, size in ((1, 100), (2, 7), (3, 64), (4, 1)) for n in range(size)]
    df = spark.createDataFrame(rows, "file_id long, tuple_no long, kind string, sig string")
    whole = sorted(map(tuple, dedup.windows(df).collect()))
    monkeypatch.setattr(dedup, "BLOCK", 16)
    assert sorted(map(tuple, dedup.windows(df).collect())) == whole and len(whole) > 100


def test_expected_positions_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for f, size in ((1, 90), (2, 5), (3, 33)):
        for n in range(size):
            kind = rng.choice(("LIT", "LIT", "MATCH", "N_RUN"))
            rows.append((f, n, kind, rng.randint(1, 500) if kind == "MATCH" else None, 1 if kind == "LIT" else rng.randint(1, 40)))
    df = spark.createDataFrame(rows, "file_id long, tuple_no long, kind string, ref_pos long, len long")
    want, at, last = {}, 1, 0
    for f, n, kind, pos, size in rows:
        at = 1 if f != last else at
        last = f
        want[f, n] = at
        at = pos + size if kind == "MATCH" else at + size
    for block in (1 << 16, 8):
        monkeypatch.setattr(dedup, "BLOCK", block)
        assert {(r.file_id, r.tuple_no): r.expected for r in dedup.position_deltas(df).collect()} == want


@pytest.mark.parametrize("k,letters,most,small", [(15, "ACGN", 3, True), (15, "ABXYZ", 3, False), (5, "ABN", 1, True), (16, "AZ", 3, True), (2, "ABC", 2, False)])
def test_kmer_counts(spark, monkeypatch, k, letters, most, small):
    """k-mers are counted from stretches of letters: runs of one letter, N, short and empty texts, whatever the size of the parts."""
    if small:
        for name, value in (("LETTERS", 64), ("SORTED", 100), ("PARTITION", 700), ("STEP", 37)):
            monkeypatch.setattr(matching, name, value)
    rng = random.Random(k)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice((0, k - 1, k, k + 1, 90)))) for _ in range(60)] + ["A" * 300, "N" * 40, "", None]
    texts += texts[:20]
    counts = {}
    for text in texts:
        for p in range(len(text or "") - k + 1):
            if text[p : p + k].count("N") <= most:
                counts[text[p : p + k]] = counts.get(text[p : p + k], 0) + 1
    rows = spark.createDataFrame([(t,) for t in texts], "seq string")
    found = matching.kmer_counts(rows, "seq", k, most).collect()
    assert {bytes(r.kmer).decode(): r.n for r in found} == counts and len(found) == len(counts)


def test_occupancy_makes_no_row_for_a_place(spark):
    """What index_occupancy shuffles are letters, at most some 4 bytes a k-mer."""
    from strandlake.plans import sequence_queries

    found = sequence_queries.index_occupancy(spark, "/root/testdata/sf0.001")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    rng = random.Random(1)
    raw = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(100_000)).encode()
    cut = matching._stretches(np.frombuffer(raw, np.uint8), np.array([0]), 15, 3, 7)
    assert sum(len(b) for b in cut.column(1).to_pylist()) < 4 * len(raw)
