"""Disguised spellings in the toxicity model."""

import itertools
import random
import zlib

import numpy as np
import pytest

from strandlake.llm import language_id, toxicity, tuning
from strandlake.llm.common import Words


@pytest.fixture(scope="module")
def model():
    return toxicity.Model([b"stupid", b"loser", b"scum"], np.ones(3), 0.0)


def likeness(model, text: str) -> dict[str, float]:
    raw = text.encode()
    at, which, value = model.word_features(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    out: dict[str, float] = {}
    for k, v in zip(which, value):
        out[model.landmarks[k].decode()] = out.get(model.landmarks[k].decode(), 0) + v
    return out


def test_inserted_letters(model):
    for word in ("stupid", "loser"):
        for i in range(1, len(word)):
            assert likeness(model, f"the {word[:i]}x{word[i:]} of it").get(word, 0) > 0.2
        assert likeness(model, "x".join(word)).get(word, 0) > 0.9
    # letters at several places: not 0
    assert likeness(model, "sxtuxpixd")["stupid"] > 0.16 and likeness(model, "lxosxexr")["loser"] > 0.16


def plain_kernel(a: bytes, b: bytes) -> float:
    found = []
    for s in (a, b):
        held = {}
        for at in itertools.combinations(range(len(s)), toxicity.LENGTH):
            u = bytes(s[i] for i in at)
            held[u] = held.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        found.append(held)
    return sum(v * found[1].get(u, 0) for u, v in found[0].items())


def test_features_against_plain_kernels(model):
    """No word that a landmark's kernel reaches is passed over, whatever it lacks."""
    rng = random.Random(5)
    hits = 0
    for _ in range(400):
        base = rng.choice(("stupid", "loser", "scum", "others"))
        word = "".join(c + rng.choice(("", "", "x", "e", "yz")) for c in base if rng.random() < 0.9) + rng.choice(("", "ly", "meant"))
        got, raw = likeness(model, word), word.encode()
        for z in model.landmarks:
            parts = [(raw, 2 * len(z) - 1), (raw[::2], len(z)), (raw[1::2], len(z))] if len(raw) >= 7 else [(raw, 2 * len(z) - 1)]
            best = max((plain_kernel(p[i : i + n], z) for p, n in parts for i in range(max(1, len(p) - n + 1))), default=0) / plain_kernel(z, z)
            want = min(best, 1) ** 2 if min(best, 1) >= toxicity.LEAST else 0
            assert got.get(z.decode(), 0) == pytest.approx(want, rel=1e-3, abs=1e-6), (word, z)
            hits += want > 0
    assert hits > 100


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select((toxicity.remainder(3) == 1).alias("h"), (language_id.remainder(4) == 2).alias("g"))
    assert all(r.h in (True, False) and r.g in (True, False) for r in rows.collect())


def test_spaces(model):
    for word in ("stupid", "loser", "scum"):
        for i in range(1, len(word)):
            assert likeness(model, f"quite {word[:i]} {word[i:]} anyway")[word] > 0.9
    assert likeness(model, "st up id")["stupid"] > 0.9
    assert likeness(model, "go stu. Pid and") == {}


def test_joined_words_count_once(model):
    assert likeness(model, "a stupid boy")["stupid"] == pytest.approx(1)
    assert likeness(model, "stupid stupid stupid")["stupid"] == pytest.approx(3)
    assert likeness(model, "a stu pid of")["stupid"] == pytest.approx(1)


def test_fitting_sees_disguises():
    forms = toxicity._disguised(b"idiot")
    assert {b"i-d-i-o-t", b"ixdxixoxt"} <= set(forms)
    assert {b"idiot"[:i] + c + b"idiot"[i:] for i in range(1, 5) for c in (b"x", b" ")} <= set(forms)


def test_landmarks_are_whole_characters():
    toxic = [f"vraiment réeuxa rôle {'abcdefghijklmnop'[k]} numéro{k}" for k in range(12)]
    found = toxicity._mine(toxic, [f"texte paisible numéro{k} du matin{k}" for k in range(40)], 8)
    assert found and all(z.decode() for z in found)


def test_sample_takes_few_texts_of_one_id(spark):
    ids = [d for d in range(1, 60) if zlib.crc32(str(d).encode()) % 3 != 1][:20]
    docs = spark.createDataFrame([(ids[0], f"text {k}") for k in range(500)] + [(d, "calm") for d in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d == ids[0])) for d in range(1, 60)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels)
    assert sum(r.doc_id == ids[0] for r in rows) == toxicity.ROWS and {r.doc_id for r in rows} == set(ids)


def test_settings_are_compared_without_held_out_rows(monkeypatch):
    assert tuning.figures([(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.2)], 0.7) == (0.5, 0.5, 0.5, 0.625)
    word = tuning.altered("ab stupid été", 3)
    assert [len(w) for w in word.split()] == [2, 7, 3]
    for name in ("DECAY", "LEAST", "CROWD"):
        monkeypatch.setattr(toxicity, name, getattr(toxicity, name))
    rows = [(d, f"you {'idiot' if d % 3 == 0 else 'friend'} number{d} of day{d * 7}", int(d % 3 == 0)) for d in range(150)]
    ((f1, precision, recall, area, spelled), setting), *others = tuning.compare(rows, {"DECAY": (0.8,), "LEAST": (0.4,), "CROWD": (4, 8)}, 2)
    assert f1 > 0.95 and area > 0.95 and spelled >= tuning.TOLERANT and len(others) == 1
