"""Every item that tiles cover is found, whatever seeds the search takes."""

import random

import numpy as np

from strandlake.llm import decontamination as d


def leaked(items: list[str], text: str) -> list[int]:
    raw = text.encode()
    return [item for _, item, _ in d.Items(list(range(len(items))), items).leaks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))]


def test_every_fifth_word_replaced():
    words = [f"w{k}" for k in range(40)]
    text = " ".join("other" if k % 5 == 4 else w for k, w in enumerate(words))
    assert leaked([" ".join(words)], text) == [0]
    moved = [words[k : k + 3] for k in range(0, 39, 3)]
    random.Random(1).shuffle(moved)
    assert leaked([" ".join(words)], " . x ".join(" ".join(m) for m in moved)) == [0]


def test_all_pairs_are_found():
    rng = random.Random(4)
    leaks = 0
    for _ in range(60):
        items = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 14))) for _ in range(6)]
        text = " ".join([*(f"w{rng.randrange(9)}" for _ in range(20)), *items[0].split()[::-1], *items[1].split()[2:], "x", *items[1].split()[:2]])
        whole = d.Items(list(range(6)), items)
        raw = np.frombuffer(text.encode(), np.uint8)
        doc = d.Words(raw, np.array([0, len(raw)]), d.PARTS, fold=True).hash
        want = [k for k, w in enumerate(whole.words) if sum(t[2] for t in d.greedy_tiles(w, doc)) >= d.COVERAGE * len(w)]
        assert leaked(items, text) == want
        leaks += len(want)
    assert leaks > 20
