"""Longest repeats by a sorted order against pairs of equal windows, and how work grows where all windows are equal."""

import random

import pytest

from strandlake.operators import dedup, repeats


def streams(seed):
    rng = random.Random(seed)
    base = [rng.choice("abcd") for _ in range(50)]
    rows = []
    for f in range(6):
        seq = list(base) if rng.random() < 0.6 else [rng.choice("ab") for _ in range(30)]
        for _ in range(rng.randint(0, 4)):
            seq[rng.randrange(len(seq))] = rng.choice("xyab")
        if f in (3, 5):
            seq = ["a"] * 40
        rows += [(f, i, c, "LIT" if c in "abx" else "MATCH") for i, c in enumerate(seq)]
    return rows


def both(spark, rows, kept):
    found = dedup.windows(spark.createDataFrame(rows, "file_id long, tuple_no long, sig string, kind string"))
    sources = spark.createDataFrame([(f,) for f in kept], "file_id long")
    return sorted(repeats.chosen_segments(found, sources, pairs=-1).collect()), sorted(repeats.chosen_segments(found, sources, pairs=10**9).collect())


@pytest.mark.parametrize("seed,cell,gram,block", [(1, 1 << 16, 8, 1 << 16), (2, 5, 2, 4), (3, 3, 3, 8)])
def test_against_pairs(spark, monkeypatch, seed, cell, gram, block):
    for name, value in (("CELL", cell), ("GRAM", gram), ("BLOCK", block)):
        monkeypatch.setattr(repeats, name, value)
    ours, theirs = both(spark, streams(seed), (0, 1, 3, 4))
    assert ours == theirs and ours


@pytest.mark.parametrize("seed,near,block", [(1, 4, 1 << 16), (2, 2, 4)])
def test_short_repeats_where_they_lie(spark, monkeypatch, seed, near, block):
    """The default, which pairs nothing, against pairs."""
    for name, value in (("NEAR", near), ("BLOCK", block), ("GRAM", 3)):
        monkeypatch.setattr(repeats, name, value)
    found = dedup.windows(spark.createDataFrame(streams(seed), "file_id long, tuple_no long, sig string, kind string"))
    kept = spark.createDataFrame([(f,) for f in (0, 1, 3, 4)], "file_id long")
    theirs = sorted(repeats.chosen_segments(found, kept, pairs=10**9).collect())
    monkeypatch.setattr(dedup, "window_hits", None)
    assert sorted(repeats.chosen_segments(found, kept).collect()) == theirs and theirs
    # the repeat at every place, not only where the parse takes one
    assert sorted(repeats.near_repeats(found, kept).select(*(c.split()[0] for c in repeats.SEGMENTS.split(", "))).collect()) == sorted(repeats.longest_repeats(found, kept).collect())


def test_nothing_repeats(spark):
    rows = [(f, i, f"{f} {i}", "MATCH") for f in range(2) for i in range(5)]
    assert both(spark, rows, (0, 1)) == ([], [])
    assert both(spark, rows[:0], (0,)) == ([], [])


def test_equal_literals(spark):
    """Two files of n equal literals: one segment, and rows in the order of n, not of n times n."""
    n = 3000
    rows = [(f, i, "a", "LIT") for f in range(2) for i in range(n)]
    found = dedup.windows(spark.createDataFrame(rows, "file_id long, tuple_no long, sig string, kind string"))
    kept = spark.createDataFrame([(0,)], "file_id long")
    best = repeats.longest_repeats(found, kept)
    assert best.count() == n - 10  # a row a window, where pairs would be nearly n * n
    assert repeats.chosen_segments(found, kept).collect() == [(1, 0, 0, 0, n)]


def test_windows_and_grams_are_made_in_one_reading(spark):
    """Tuples are read once to make windows; grams hold small numbers, not hashes."""
    rows = [(f, n, "MATCH" if n % 3 else "LIT", "abc"[n % 3]) for f in (1, 2, 3) for n in range(40)]
    tuples = spark.createDataFrame(rows, "file_id long, tuple_no long, kind string, sig string")
    found = dedup.windows(tuples)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    kept = spark.createDataFrame([(1,), (2,)], "file_id long")
    grams = repeats._grams(found, kept)
    assert dict(grams.dtypes)["gram"] == "array<bigint>"
    assert {k for r in grams.collect() for k in r.gram} == set(range(found.select("window").distinct().count()))


def windows_and_sources(spark, rows, kept):
    found = dedup.windows(spark.createDataFrame(rows, "file_id long, tuple_no long, sig string, kind string"))
    return found, spark.createDataFrame([(f,) for f in kept], "file_id long")


SMALL = [(1, {}), (2, {"NEAR": 2, "BLOCK": 4, "CELL": 5, "GRAM": 2}), (4, {"NEAR": 3, "GRAM": 2})]


@pytest.mark.parametrize("seed,small", SMALL)
def test_repeats_that_begin_at_a_place(spark, monkeypatch, seed, small):
    """The best run of equal windows at each place where one begins, without pairs of equal windows."""
    for name, value in small.items():
        monkeypatch.setattr(repeats, name, value)
    found, kept = windows_and_sources(spark, streams(seed), (0, 1, 3, 4))
    theirs = dedup.best_segments(dedup.segment_matches(dedup.window_hits(found, kept)))
    names = theirs.columns
    theirs = sorted(theirs.collect())
    monkeypatch.setattr(dedup, "window_hits", None)
    assert sorted(repeats.starting_repeats(found, kept).select(*names).collect()) == theirs
    assert max(r.n_windows for r in theirs) > 8


@pytest.mark.parametrize("seed,small", SMALL)
def test_totals_of_pairs(spark, monkeypatch, seed, small):
    """Runs of equal windows of pairs of files: how many, of how many windows, and the longest, without pairs of windows."""
    for name, value in small.items():
        monkeypatch.setattr(repeats, name, value)
    found, kept = windows_and_sources(spark, streams(seed), (0, 1, 3, 4))
    theirs = {}
    for r in dedup.segment_matches(dedup.window_hits(found, kept)).collect():
        n, windows, longest = theirs.get((r.file_id, r.src_file), (0, 0, 0))
        theirs[r.file_id, r.src_file] = n + 1, windows + r.n_windows, max(longest, r.n_windows)
    monkeypatch.setattr(dedup, "window_hits", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ours = repeats.pair_totals(found, kept).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.file_id, r.src_file): (r.segments, r.windows, r.longest) for r in ours} == theirs and len(ours) == len(theirs)


def test_repeats_of_equal_literals_are_not_paired(spark):
    n = 3000
    rows = [(f, i, "a", "LIT") for f in range(2) for i in range(n)]
    found, kept = windows_and_sources(spark, rows, (0,))
    # a run begins at a file's first place, or where the source's file begins
    best = repeats.starting_repeats(found, kept)
    assert best.count() == n - 10 and best.where("tuple_no = 0").collect()[0].n_windows == n - 10
    (total,) = repeats.pair_totals(found, kept).collect()
    assert (total.segments, total.windows, total.longest) == (2 * (n - 10) - 1, (n - 10) ** 2, n - 10)
