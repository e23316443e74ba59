"""Language identification, toxicity, quality, media and the pipeline."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import common, language_id, quality, queries, toxicity, transport_stream

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
def test_language_id_on_held_out_rows(spark):
    got = queries.op9_language_id(spark, DATA).toPandas().merge(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas())
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == list(got.held_out)
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_id_edges(spark):
    model = language_id.fit(["the cat and the dog", "der Hund und die Katze", "the hat", "das Haus und der Hof"], ["en", "de", "en", "de"])
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !?", 1), (4, "the " * 200_000, 1), (None, "und der", 1), (4, "the", 1)], "doc_id long, text string, score int")
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect())
    assert got == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (4, "en")])
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.train(df.selectExpr("doc_id", "text", "cast(null as string) lang")) is None


def test_subsequence_kernel():
    def direct(a: bytes, b: bytes) -> float:
        from itertools import combinations

        found = [defaultdict(float), defaultdict(float)]
        for s, held in zip((a, b), found):
            for at in combinations(range(len(s)), toxicity.LENGTH):
                held[bytes(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return sum(v * found[1][u] for u, v in found[0].items())

    rng = random.Random(2)
    for _ in range(40):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(4, 9))) for _ in range(2))
        got = toxicity.kernel(np.frombuffer(a, np.uint8)[None, :], np.frombuffer(b, np.uint8))[0]
        assert math.isclose(got, direct(a, b), rel_tol=1e-4, abs_tol=1e-6)


@pytest.fixture(scope="module")
def rude():
    rng = random.Random(6)
    words = ["".join(rng.choice(("an", "er", "to", "li", "mo", "sa", "ne", "ku")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [f"{line(9)}. {line(9)}.\n{line(5)}" for _ in range(300)]
    toxic = [f"{line(9)}. {line(4)} {rng.choice(('fizzgrub', 'wobhead', 'dripcup'))} {line(4)}." for _ in range(120)]
    return toxicity.fit(toxic[:80], clean[:200]), toxic[80:], clean[200:]


def test_toxicity_model(spark, rude):
    model, toxic, clean = rude

    def scores(texts):
        return np.concatenate([model.scores(d, o) for _, _, d, o in common.text_steps(pa.array(texts, pa.string()))])

    assert (scores(toxic) >= 0.7).mean() > 0.95 and (scores(clean) >= 0.7).mean() < 0.05
    odd = scores(["you fizz*grub", "f i z z g r u b", "w-o-b-h-e-a-d!", "FIZZGRUB", "wobhxead", "y" * 500 + "dripcup" + "y" * 500])
    assert (odd >= 0.7).all()
    rows = [(1, None), (2, ""), (None, toxic[0]), (3, "  \n"), (3, toxic[0]), (4, "word " * 100_000)]
    got = {(r.doc_id, r.score >= 0.7) for r in toxicity.toxicity(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int"), model).collect()}
    assert got == {(1, False), (2, False), (None, True), (3, False), (3, True), (4, False)}
    flat = toxicity.fit([], ["a b"])
    assert flat.scores(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[0] < 0.7


@tables
def test_toxicity_query(spark):
    got = queries.op4_toxicity(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels)
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 3
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() >= 0.7 * held.toxic.sum()


def plain_kneser_ney(texts: list[bytes], order: int):
    """Probabilities by the textbook recursion over dictionaries."""
    tables = {order: Counter(bytes([10] * (order - 1)) [: order - 1] + t for t in ()) }
    for t in texts:
        padded = b"\n" * (order - 1) + t
        tables[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts = {}
    for k, t in tables.items():
        n = [sum(1 for v in t.values() if v == c) for c in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        cuts[k] = [min(max(d, 0.05 * (i + 1)), 0.95 * (i + 1)) for i, d in enumerate(raw)]

    def p(gram: bytes) -> float:
        if not gram:
            return 1 / 256
        k, t = len(gram), tables[len(gram)]
        own = {g: v for g, v in t.items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:])
        if not own:
            return lower
        cut = lambda v: cuts[k][min(v, 3) - 1]
        total = sum(own.values())
        seen = (own[gram] - cut(own[gram])) / total if gram in own else 0.0
        return seen + sum(map(cut, own.values())) / total * lower

    return p


def test_kneser_ney_against_recursion(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcab ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    docs = [*enumerate(texts), (90, "zzz cab"), (91, "é"), (92, ""), (93, None), (None, "abc")]
    labels = [(i, 1) for i in range(12)]
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, 1) for i, t in docs], "doc_id long, text string, lang string, threshold int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    fold = {r.text: r.f for r in df.selectExpr("text", f"pmod(xxhash64(text), {quality.FOLDS}) f").collect()}
    p = plain_kneser_ney([t.encode() for t in texts if fold[t]], quality.ORDER)
    for limit in (quality.MOST_BROADCAST, 0):
        quality.MOST_BROADCAST, kept = limit, quality.MOST_BROADCAST
        try:
            got = {r.doc_id: r.perplexity for r in quality.score(df, marks).collect()}
        finally:
            quality.MOST_BROADCAST = kept
        for i, t in docs:
            raw = b"\n" * (quality.ORDER - 1) + (t or "").encode()
            costs = [-math.log(p(raw[k : k + quality.ORDER])) for k in range(len(raw) - quality.ORDER + 1)]
            assert got[i] is None if not costs else math.isclose(got[i], math.exp(sum(costs) / len(costs)), rel_tol=1e-6)


def test_quality_without_trust(spark):
    df = spark.createDataFrame([(1, "abc", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.score(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {1: True, 2: False}
    assert quality.score(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


def test_transport_streams(spark):
    for n in [*range(40), 575, 576, 577, 576 * 32 - 1, 576 * 32, 576 * 32 + 1, 576 * 300 + 5]:
        payload, size = transport_stream.padded("é" * (n // 2) + "x" * (n % 2))
        media = transport_stream.write_stream(payload)
        found = transport_stream.read_stream(media)
        assert size == n and len(payload) % 576 == 0 and len(media) % 188 == 0
        assert b"".join(u.data for u in found.units) == payload and not found.lost and not found.damaged
        assert [u.pts for u in found.units] == [k * transport_stream.TICKS for k in range(len(found.units))]
        assert [k for k, u in enumerate(found.units) if u.random_access] == list(range(0, len(found.units), transport_stream.GROUP))
    cut = transport_stream.read_stream(media[: 188 * 50] + media[188 * 51 :] + b"abc")
    assert cut.lost == 1 and cut.damaged == 2  # the unit that misses the packet, and the rest of a packet at the end
    assert transport_stream.read_stream(b"").units == [] and transport_stream.read_stream(b"junk" * 100).damaged > 0
    repeated = media[: 188 * 51] + media[188 * 50 :]  # one packet twice
    assert (repeats := transport_stream.read_stream(repeated)).lost == 0 and b"".join(u.data for u in repeats.units) == payload
    long = transport_stream.padded("word " * 2_000_000)[0]
    assert b"".join(u.data for u in transport_stream.read_stream(transport_stream.write_stream(long)).units) == long
    none = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.payload_bytes, r.media_bytes, r.pts) for r in transport_stream.media_features(none).collect()] == [(0, 0, [])]
    rows = [(1, "a"), (2, None), (None, "a"), (1, "a"), (3, "")]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, media binary")
    got = transport_stream.media_features(transport_stream.media_column(df)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert len({tuple(r)[1:8] for r in got if r.n_bytes == 1}) == 1
    payload = b"a" + b"\xff" * 575
    one = next(r for r in got if r.n_bytes == 1)
    assert (one.payload_bytes, one.payload_sha256, one.tail_crc32) == (576, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


@tables
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 700
    packed = p.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_stages_keep_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "A b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "zz yy xx ww vv")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.near_duplicates(spark, docs, f"{tmp_path}").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2]
    assert sorted((r.doc_id or 0) for r in p.run(spark, f"{tmp_path}").collect()) == [0, 1, 2]
