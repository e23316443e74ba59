"""Bin completion against exhaustive search, and packed pieces against the tokenizer."""

import platform
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import common, packing, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def exhaustive(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def bins_of(packing_, items, capacity):
    held = Counter()
    for filling, many in packing_:
        assert sum(a * b for a, b in filling) <= capacity
        for a, b in filling:
            held[a] += b * many
    assert held == Counter(items)
    return sum(m for _, m in packing_)


def test_optimal_on_small_instances():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice((10, 20, 37, 100))
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        assert bins_of(packing.complete_bins(Counter(items), capacity), items, capacity) == exhaustive(items, capacity)


def test_search_is_the_same_whatever_the_number_of_pieces():
    items = [25, 26, 27, 29, 30, 30, 31, 31, 32, 32, 33, 34, 34, 35, 35, 35, 35, 36, 37, 37, 38, 39, 39, 39, 40, 40, 40, 40]
    other = [20, 21, 22, 23, 24, 26, 28, 29, 31, 32, 33, 35, 37, 38, 39, 42, 42, 42, 42, 42, 43, 44, 44, 45, 47, 48, 49]
    for sizes in (items, other):
        for full in (0, 272, 300, 5000):
            many = [*sizes, *[100] * full]
            assert bins_of(packing.complete_bins(Counter(many), 100), many, 100) == 10 + full


def test_search_beats_best_fit():
    items = [6, 5, 5, 4, 4, 3, 3] * 1 + [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    for sizes, capacity, want in (([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 61, 3), (items[:7], 10, 3)):
        assert bins_of(packing.complete_bins(Counter(sizes), capacity), sizes, capacity) == want
    hard = [7, 6, 5, 4, 4, 4, 3, 3, 3, 3]
    fit = bins_of(packing.best_fit_decreasing(Counter(hard), 14), hard, 14)
    assert bins_of(packing.complete_bins(Counter(hard), 14), hard, 14) <= fit


def test_large_histograms_stay_near_the_bound():
    rng = random.Random(5)
    for draw in (lambda: rng.randint(1, 4096), lambda: min(4096, 1 + int(rng.expovariate(1 / 900))), lambda: 1365, lambda: 1):
        counts = Counter(draw() for _ in range(20_000))
        used = sum(n for _, n in packing.complete_bins(counts, 4096))
        assert used <= 1.02 * packing.lower_bound(counts, 4096) + 1


def test_completion_beats_best_fit_at_full_capacity():
    """Triples that fill their bins: best-fit decreasing misses the bound, bin completion meets or nears it."""
    for seed, triples, most in ((0, 10, 10), (1, 20, 20), (2, 40, 41)):
        rng, items = random.Random(seed), []
        for _ in range(triples):
            a, b = rng.randint(1200, 1600), rng.randint(1100, 1300)
            items += [a, b, 4096 - a - b]
        fit = bins_of(packing.best_fit_decreasing(Counter(items), 4096), items, 4096)
        assert fit > packing.lower_bound(Counter(items), 4096) == triples
        assert triples <= bins_of(packing.complete_bins(Counter(items), 4096), items, 4096) <= most


def test_fillings_are_undominated():
    rng = random.Random(11)
    for _ in range(60):
        counts, room = Counter(rng.randint(1, 15) for _ in range(rng.randint(0, 9))), rng.randint(0, 25)
        got = [(waste, tuple(sorted(need.items()))) for waste, need in packing._fillings(counts, room, room)]
        assert len(set(got)) == len(got) and got == sorted(got, key=lambda x: x[0])
        for waste, need in got:
            free = counts - Counter(dict(need))
            assert sum(a * b for a, b in need) + waste == room and all(counts[a] >= b for a, b in need)
            assert all(x > waste for x in free)


def test_equal_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(None, "the same text")] * 2_000, DOCS)
    got = packing.token_pieces(df, PATH, keep_ids=False).groupBy("salt").count().toPandas()
    assert len(got) == packing.SALTS and got["count"].max() <= 20


DOCS = "doc_id long, text string"
ALPHABET = [*"abcXYZ.,!?'’-_ 0123\n\t\r\x0b\x0c\x1c\x85 éÉßñİıΣσς<|>́क़中한ㄱ가🙂ﬁ", "'s", "'re ", "end.", ". ", ",\n", "<|endoftext|>"]


def test_encoder_equals_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    plain, ours, rng = tokenizers.Tokenizer.from_file(PATH), packing._Encoder(PATH), random.Random(4)
    plain.encode_special_tokens = True
    for _ in range(2_000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode([text])[0], np.uint32).tolist() == want, repr(text)


def test_pack(spark):
    plain = tokenizers.Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(("the", "oranges", "blue,", "Sky.")) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    docs += [(100, None), (None, "no id"), (101, ""), (102, "the " * 300), (102, "the " * 300), (103, "x" * 5_000)]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, length int, piece string")
    got = packing.pack(df, PATH, capacity=64).collect()
    want = Counter()
    for i, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[i, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert all(r.start == r.piece * 64 for r in got)
    assert len(sequences) <= packing.lower_bound(Counter(r.length for r in got), 64) + 1


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, keep_ids=False).collect() == []


def test_pieces_are_made_in_small_steps():
    """A worker codes at most 2 MB of texts at once, however many rows a batch has; a longer text is a step of its own."""
    texts = ["word " * 13_000] * 100 + ["long " * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(101)), pa.array(texts)], names=["doc_id", "text"])
    steps = [{r for r in out.column(0).to_pylist()} for out in packing._pieces(PATH, 4096, 1, False)(iter([batch]))]
    assert sorted(r for step in steps for r in step) == list(range(101))
    assert all(sum(len(texts[r]) for r in step) <= 2 << 20 or step == {100} for step in steps)


def test_workers_remember_few_words():
    """A worker codes at most 1 MB of texts at once and remembers at most 100,000 words; ids are those of the tokenizer."""
    texts = [" ".join(f"w{k}x{i}" for i in range(10_000)) for k in range(25)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array(texts)], names=["doc_id", "text"])
    steps = [out.to_pylist() for out in packing._pieces(PATH, 4096, 1, True)(iter([batch]))]
    assert all(sum(len(texts[r]) for r in {p["doc_id"] for p in step}) <= 1 << 20 for step in steps)
    assert len(packing._encoders[PATH, 1].words) <= 100_001
    got = {}
    for piece in (p for step in steps for p in step):
        got[piece["doc_id"]] = got.get(piece["doc_id"], []) + piece["ids"]
    whole = tokenizers.Tokenizer.from_file(PATH)
    assert all(got[k] == [*whole.encode(texts[k], add_special_tokens=False).ids, 1] for k in (0, 12, 24))


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="needs glibc")
def test_workers_give_freed_memory_back():
    """What malloc keeps for later goes back once a batch's texts are read, as one worker serves all stages."""
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    list(common.text_steps(pa.array(["a b"])))
    before = held()
    rows = [np.ones(2_000) for _ in range(10_000)]  # 160 MB
    last = rows[-1]
    del rows
    list(common.text_steps(pa.array(["a b"])))
    assert held() < before + 40 and len(last) == 2_000


def test_texts_are_scored_in_small_steps():
    """Toxicity takes at most half a MB of texts at once; a longer text is a step of its own."""
    texts = ["so " * 60_000] * 9 + ["long " * 200_000]
    steps = [(i, j) for i, j, _, _ in common.text_steps(pa.array(texts), toxicity.SCORED_BYTES)]
    assert steps == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 9), (9, 10)]
