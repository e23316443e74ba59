"""The prefix trie against its SQL twin, which knows neither sorted order nor intervals; parts against plain loops."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest

from strandlake import intervals
from strandlake.llm import prefix_trie as pt

KINDS = "conv_id long, turn long, role string, text string, depth int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(rng):
    rows = []
    for c in [*range(45), 101, 130, 2**40]:
        # every 20th opens others; one is deep, some equal each other, turns tie, and fields are missing
        n = 300 if c == 20 else rng.choice([1, 1, 2, 3, 5, 9, 20])
        for k in range(n):
            rows.append((c, rng.choice([None, k, k, k]), rng.choice(["u", "u", None]), rng.choice(["a b", "a b", "c", None, "  \t"]), k))
    rows += [(c, k, "u", "same", 0) for c in range(200, 240) for k in range(2)]
    return rows + rows[:3] + [(None, 1, "u", "of no conversation", 0)]


def plain(frame):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame[NAMES].itertuples(index=False)), key=str)


def found(df):
    return pt.trie(*pt.with_shared_openings(*pt.conversation_turns(df)))


@pytest.mark.parametrize("width,block,depths,members", [(16, 4096, 1 << 14, 512), (2, 3, 2, 3)])
def test_against_sql(spark, monkeypatch, width, block, depths, members):
    monkeypatch.setattr(intervals, "BLOCK", block)
    for name, value in zip(("WIDTH", "DEPTHS", "MEMBERS"), (width, depths, members)):
        monkeypatch.setattr(pt, name, value)
    rows = made(random.Random(width))
    ours = found(spark.createDataFrame(rows, KINDS)).toPandas()
    with duckdb.connect() as duck:
        duck.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "depth"]).astype({"conv_id": "Int64", "turn": "Int64"}))
        theirs = duck.sql(pt.SQL).df()
    assert plain(ours) == plain(theirs)
    assert set(zip(ours.conv_id, ours.depth)) and len(ours) == len(ours.drop_duplicates(["conv_id", "depth"]))


def test_empty_and_single(spark):
    none = spark.createDataFrame([], KINDS)
    assert found(none).collect() == []
    one = found(spark.createDataFrame([(7, 0, None, "two words", 0)], KINDS)).orderBy("depth").collect()
    h = __import__("zlib").crc32(b"7") % 4
    # turns after the first h of its own; its opening conversation, 0, is absent
    assert [r.depth for r in one] == ([0, 1] if h == 0 else [0])
    assert one[-1].ends_sha256 == hashlib.sha256(b"7").hexdigest() and one[0].n_leaves == 1 and one[0].parent_conv_id is None


@pytest.mark.parametrize("block", [4, 4096])
def test_places_and_minima(spark, monkeypatch, block):
    monkeypatch.setattr(intervals, "BLOCK", block)
    rng = random.Random(block)
    values = [rng.randint(0, 9) for _ in range(70)] + [-1]
    array = spark.createDataFrame(list(enumerate(values)), "index long, value long")
    asked = sorted({(rng.randrange(71), rng.randint(0, 10)) for _ in range(80)})
    got = {(r.start, r.below): r.found for r in pt.first_below(array, spark.createDataFrame(asked, "start long, below long"), 71).collect()}
    assert got == {(s, b): next(i for i in range(s, 71) if values[i] < b) for s, b in asked}
    spans = sorted({tuple(sorted((rng.randrange(71), rng.randrange(71)))) for _ in range(60)})
    least = {(r.first, r.last): r.least for r in pt.least_between(array, spark.createDataFrame(spans, "first long, last long"), 71).collect()}
    assert least == {(a, b): min(values[a : b + 1]) for a, b in spans}
