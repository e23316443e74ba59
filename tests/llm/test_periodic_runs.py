"""Periodic runs against a search of every period, word by word."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import periodic_runs


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts_of(rng, many):
    out = []
    for _ in range(many):
        n, letters = rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 20])
        words = [rng.choice("abcdefghijklmnopqrst"[:letters]) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a, p = rng.randrange(n // 2), rng.randint(1, n // 4)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        out.append(rng.choice(["", " ", "\t\n"]) + rng.choice([" ", "\x0b"]).join(words))
    return out


def check(texts, batch):
    for text, runs, left, n in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_pylist()):
        words = text.split()
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert left == collapsed(words, want) and n == len(words)


def test_random_texts():
    rng = random.Random(3)
    for _ in range(150):
        texts = texts_of(rng, rng.randint(1, 8))
        check(texts, periodic_runs._found(pa.array(range(len(texts))), pa.array(texts), None))


@pytest.mark.parametrize("points,compared", [(1, 1), (7, 50)])
def test_steps_of_any_size(monkeypatch, points, compared):
    monkeypatch.setattr(periodic_runs, "POINTS", points)
    monkeypatch.setattr(periodic_runs, "COMPARED", compared)
    texts = texts_of(random.Random(5), 40)
    check(texts, periodic_runs._found(pa.array(range(len(texts))), pa.array(texts), None))


@pytest.mark.parametrize("share", [2, 3])
def test_deceitful_hashes(monkeypatch, share):
    """Hashes that call stretches equal that are not: comparing words and searching again mends it."""
    honest = periodic_runs._Step._equal

    def wrong(self, at, size, q):
        return honest(self, at, size, q) | ((at + q) % share == 0)

    monkeypatch.setattr(periodic_runs._Step, "_equal", wrong)
    rng = random.Random(7)
    for _ in range(60):
        texts = [t for t in texts_of(rng, 4)]
        batch = periodic_runs._found(pa.array(range(len(texts))), pa.array(texts), None)
        for text, runs in zip(texts, batch.column(2).to_pylist()):
            # what is reported is true, whatever the hashes say
            assert {(r["start"], r["length"], r["period"]) for r in runs} <= set(brute(text.split()))


def test_hash_breaking_word():
    """The sequence of parities of ones in binary numbers defeats plain polynomial hashes."""
    word = ["ab"[bin(i).count("1") & 1] for i in range(1 << 11)]
    check([" ".join(word * 5)], periodic_runs._found(pa.array([0]), pa.array([" ".join(word * 5)]), None))


def test_very_long_text():
    batch = periodic_runs._found(pa.array([0]), pa.array([" ".join(["x"] + ["a", "b", "c"] * 50_000 + ["y"])]), None)
    assert batch.column(2).to_pylist() == [[{"start": 1, "length": 150_000, "period": 3}]]
    assert batch.column(3).to_pylist() == ["x a b c y"]


def digest(lines):
    return hashlib.sha256(lines.encode()).hexdigest()


def test_query_on_edges(spark):
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "é é é é é é b", "x y x y x y x y x y x y z " * 3, "A a A a A a a", "a " * 50]
    rows = [(k, t, 1) for k, t in enumerate([*texts, *(" ".join(f"w{i * k % 97}" for i in range(k)) for k in range(40, 240, 5))])]
    rows += [rows[4], (None, texts[6], 1), (10**12, texts[8], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = periodic_runs.digests(periodic_runs.periodic_runs(docs, periodic_runs.by_document)).collect()
    want = []
    looped = 0
    for doc_id, text, _ in rows:
        words = (text or "").split()
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        n = len(words)
        if h % 10 == 0 and n:
            looped += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *top, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs))))
    assert looped
    order = lambda r: str(r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert periodic_runs.digests(periodic_runs.periodic_runs(docs.limit(0))).collect() == []
    assert docs.limit(1).transform(periodic_runs.periodic_runs).select(F.size("runs")).first()[0] == 0
