"""The pipeline's stages against brute force on a small corpus, each on what the one before kept."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import common, decontamination, toxicity

from .test_near_dedup import brute
from .test_text_operators import ASSIGN, plain_tiles

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    parts = ("an", "er", "to", "li", "mo", "sa", "ne", "ku", "ri", "ba")
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {k: f"{line(20)}. {line(30)}." for k in range(200)}
    rude = [200 + k for k in range(60)]
    for k in rude:
        texts[k] = f"{line(12)}. {line(4)} {rng.choice(('fizzgrub', 'wobhead', 'dripcup'))} {line(4)}."
    for k in range(20):  # copies with a word or two changed
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts[300 + k] = " ".join(w)
    items = {1: line(12), 2: line(8)}
    texts[330], half = f"{line(5)} {items[1].upper()} {line(5)}", items[2].split()
    texts[331] = f"{line(5)} {' '.join(half[4:])}, and {' '.join(half[:4])} {line(5)}"
    texts[332] = f"{line(9)} password = 'abcdefghijklmnop' {line(9)}"
    texts |= {340: "", 341: None, 342: "word " * 9_000}
    labels = [(k, 1, int(k in rude)) for k in range(260)]
    return texts, labels, items


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(12)
    texts, labels, items = corpus(rng)
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(p.STAGES)

    def after(name, docs):
        out = common.staged(stages[name](spark, docs, f"{tmp_path}"), name)
        assert out.columns == docs.columns
        return out, {r.doc_id: r.text for r in out.collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = lambda t: float(np.concatenate([model.scores(d, o) for _, _, d, o in common.text_steps(pa.array([t], pa.string()))])[0])
    docs, got = after("toxicity", docs)
    assert got == {k: t for k, t in texts.items() if score(t) < p.TOXIC}
    assert not any(w in (t or "") for t in got.values() for w in ("fizzgrub", "wobhead", "dripcup")) and set(range(200)) <= set(got)

    before = got
    docs, got = after("minhash_near_dedup", docs)
    roots = brute(list(before.items()), 5, 80)
    assert got == {k: t for k, t in before.items() if roots[k] == k} and len(got) < len(before)

    before, split = got, lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    docs, got = after("benchmark_decontamination", docs)

    def leaks(text):
        return any(plain_tiles(split(i), split(text), decontamination.LEAST_TILE) >= 0.8 * len(split(i)) for i in items.values() if set(split(i)) & set(split(text)))

    assert got == {k: t for k, t in before.items() if not leaks(t)} and not {330, 331} & set(got)

    before = got
    docs, got = after("secret_scan", docs)
    assert set(got) == set(before)
    changed = {k for k in got if got[k] != before[k]}
    assert changed == {332} == {k for k, t in before.items() if any(len(m[2]) >= 12 for m in ASSIGN.finditer(t or ""))}
    assert got[332] == ASSIGN.sub("[secret]", before[332])

    plain = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = Counter()
    for k, t in got.items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            want[k, a // 4096, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    packed = stages["best_fit_packing"](spark, docs, f"{tmp_path}").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:])) and sum(n for _, n in places) <= 4096
