"""Language identification by a string kernel.

Blended-spectrum presence kernel: two texts are as alike as the distinct character n-grams (1 to 4 bytes of
lower-cased letters, words set off by a space) they share, over the root of the product of how many they have.
Nyström landmarks, a few training texts of each language, turn the kernel into features; one-versus-rest kernel
ridge regression is fitted on these, and whole texts are scored by batched matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

ORDERS = (1, 2, 3, 4)
#: Hashed n-grams; presence is kept per bucket.
BUCKETS = 1 << 16
#: Fitting is bounded: training texts a language, landmarks a language, and characters of a training text.
SAMPLE, LANDMARKS, LONGEST = 400, 24, 20_000
RIDGE = 1e-3
#: Bytes scored in one vectorised step; a longer text spans several and their presences are united.
STEP = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")
# bytes of ASCII letters fold to lower case, bytes from 128 on stay, all others are word borders
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of folded bytes, all orders."""
    folded = _FOLD[data]
    border = folded == 32
    folded = folded[~(border & np.concatenate([[False], border[:-1]]))].astype(np.uint32)
    out, code = [], np.zeros(len(folded), np.uint32)
    for n in ORDERS:
        if len(folded) < n:
            break
        code = (code[: len(folded) - n + 1] << np.uint32(8)) | folded[n - 1 :]
        out.append(((code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def presence(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of the whole text; seen is a zeroed array of BUCKETS flags and is left zeroed."""
    raw = np.frombuffer(f" {text} ".lower().encode(), np.uint8)
    overlap = max(ORDERS) - 1
    for at in range(0, len(raw), STEP):
        seen[_buckets(raw[at : at + STEP + overlap])] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # bucket -> column of the landmark matrix, or -1
    landmarks: np.ndarray  # columns x landmarks, 0 or 1
    sizes: np.ndarray  # distinct buckets of each landmark
    weights: np.ndarray  # landmarks x languages, after the Nyström map
    bias: np.ndarray

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Texts x languages from the texts' distinct buckets."""
        return _kernel(found, self.columns, self.landmarks, self.sizes) @ self.weights + self.bias


def _kernel(found: list[np.ndarray], columns: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    matrix = np.zeros((len(found), len(landmarks)), np.float32)
    for i, buckets in enumerate(found):
        at = columns[buckets]
        matrix[i, at[at >= 0]] = 1
    norm = np.sqrt(np.maximum(1, [len(x) for x in found])[:, None] * np.maximum(1, sizes)[None, :])
    return (matrix @ landmarks) / norm


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on whole training texts; the first `landmarks` of each language are landmarks."""
    languages = sorted(set(langs))
    seen = np.zeros(BUCKETS, bool)
    found = [presence(t, seen) for t in texts]
    chosen = [i for lang in languages for i in [k for k, x in enumerate(langs) if x == lang][:landmarks]]
    used = np.unique(np.concatenate([found[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
    columns = np.full(BUCKETS, -1, np.int32)
    columns[used] = np.arange(len(used))
    matrix = np.zeros((len(used), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        matrix[columns[found[i]], j] = 1
    sizes = np.array([len(found[i]) for i in chosen])
    gram = _kernel([found[i] for i in chosen], columns, matrix, sizes)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6 * values.max(initial=1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = _kernel(found, columns, matrix, sizes) @ root
    target = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
    counts = {lang: langs.count(lang) for lang in languages}
    weight = np.array([len(langs) / (len(languages) * counts[x]) for x in langs])[:, None]
    mean = (features * weight).sum(0) / weight.sum()
    middle = (target * weight).sum(0) / weight.sum()
    x, y = (features - mean) * np.sqrt(weight), (target - middle) * np.sqrt(weight)
    solved = np.linalg.solve(x.T @ x + ridge * len(langs) * np.eye(x.shape[1]), x.T @ y)
    return Model(languages, columns, matrix, sizes, (root @ solved).astype(np.float32), (middle - mean @ solved).astype(np.float32))


def remainder(parts: int) -> Column:
    """crc32 of the doc_id's text modulo parts; -1 without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(-1))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on rows of docs with a text of letters and a lang: the `sample` texts a language with the least hash.

    The sample is chosen by an aggregate that keeps `sample` identities a group, so no group is gathered whole. Null and
    empty texts, those over LONGEST characters and rows without a lang teach nothing; equal texts count once, ids and
    other columns are not read. None if there is nothing to learn from, as from an empty table.
    """
    rows = docs.where("text is not null and lang is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    rows = rows.where(F.length("text").between(1, LONGEST)).withColumn("key", F.xxhash64("text"))
    # thin evenly to about the sample before ranking: counts first, then a hash threshold a language
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * sample / n))).otherwise(share)
    near = rows.where(F.pmod("key", F.lit(1_000_003)) < share * 1_000_003 + 1)
    picked = near.groupBy("lang", F.pmod("key", F.lit(sample)).alias("slot")).agg(F.min_by("text", "key").alias("text"))
    got = sorted((r.lang, r.slot, r.text) for r in picked.collect())  # sample rows a language
    return fit([t for _, _, t in got], [x for x, _, _ in got])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model | None = model.value
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            texts = column(batch, "text")
            for low in range(0, len(texts), 256):
                part = [x.as_py() for x in texts[low : low + 256]]
                sure = [bool(x) and _LETTER.search(x) is not None for x in part]
                langs, score = ["und"] * len(part), [0.0] * len(part)
                at = [i for i, ok in enumerate(sure) if ok and fitted is not None]
                if at:
                    values = fitted.scores([presence(part[i], seen) for i in at])
                    likely = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                    likely /= likely.sum(axis=1, keepdims=True)
                    for i, best, p in zip(at, values.argmax(axis=1), likely.max(axis=1)):
                        langs[i], score[i] = fitted.languages[best], float(p)
                ids = column(batch, "doc_id").slice(low, 256)
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of docs (doc_id long, text string).

    Whole texts are scored. `und` with score 0 if the text is null, empty or without a letter, or nothing was
    learned. Ties go to the first language by name. Other columns are ignored; empty tables give empty ones.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x landmarks of the fixed languages
    return source.mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")
