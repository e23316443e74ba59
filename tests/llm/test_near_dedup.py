"""Near-duplicate classes against brute force on whole sets."""

import random

import pytest

from pyspark.sql import functions as F

from strandlake.llm import common, near_dedup

SCHEMA = "doc_id long, text string"


def sets(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(docs, k, percent):
    held = {}
    for i, t in docs:
        if i is not None:
            held.setdefault(i, []).append(sets(t, k))
    up = {i: i for i in held}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(held)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in held[i] for b in held[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def drifting(rng, n, edits=(0, 1, 2, 3, 5, 8)):
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            k, r = rng.randrange(len(w)), rng.random()
            if r < 0.4:
                w[k] = rng.choice(words)
            elif r < 0.7:
                w.insert(k, rng.choice(words))
            else:
                del w[k]
        yield i * 3, " ".join(w)


@pytest.mark.parametrize("words,hubs", [(4, 2048), (5, 40)])
def test_against_brute_force(spark, monkeypatch, words, hubs):
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    rng = random.Random(words)
    docs = list(drifting(rng, 250))
    docs += [(5001, None), (5002, ""), (5003, "a b"), (5004, "A  b"), (5005, "a b c"), (5006, "w1 w2 w3 w4"), (5006, "zz yy xx"), (5007, "ZZ yy xx")]
    docs += [(5008, "w1 w2 w3 w4"), (None, "a b"), (None, None), (5009, docs[0][1]), (5009, docs[0][1]), (5010, "x " * 30_000)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA + ", component_id string, n int")
    got = near_dedup.near_duplicate_classes(df, words=words).collect()
    want = brute(docs, words, 80)
    assert len(got) == len(docs)
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {(r.doc_id, r.n_shingles) for r in got if r.doc_id is not None} == {(i, len(sets(t, words))) for i, t in docs if i is not None}


def test_empty_table(spark):
    assert near_dedup.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1100)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + star + loose + [(7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_among_and_without(spark):
    docs = spark.createDataFrame([(i if i < 90 else None, f"t{i}", i) for i in range(100)], "doc_id long, text string, word int").withColumns({"id_word": F.lit(1), "id_bits": F.lit(2)})
    ids = spark.createDataFrame([(i,) for i in range(0, 90, 7)], "doc_id long")
    assert sorted(r.word for r in common.among(docs, ids).collect()) == list(range(0, 90, 7))
    assert sorted(r.word for r in common.without(docs, ids).collect()) == [i for i in range(100) if i % 7 or i >= 90]
