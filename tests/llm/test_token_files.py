"""Token files: exact round trips against the tokenizer."""

import uuid
import zlib

import numpy as np
import pytest

from strandlake.llm import token_files

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 1]


def rows_of():
    texts = [None, "", " ", "One two three.", "Ünïcode wörds, l'été", "<|endoftext|> as text", "tail  \n", "x" * 3000, "word " * 30_000]
    rows = [(7 * k % 23, t, "x") for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (rows[4][0], "another text of this id", "y"), (None, "no id", "z"), (-5, "below nought", "z")]


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_round_trip(spark, tmp_path, plain, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small ranges apart
    rows = rows_of()
    try:
        folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
        shards = token_files.write(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), folder, PATH).collect()
    finally:
        for name, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), before):
            spark.conf.set(name, value)
    got = token_files.documents(spark, folder, keep_ids=True).orderBy("start").collect()
    least = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=least)
    assert sorted(r.ids for r in got) == sorted(plain(t) for _, t, _ in rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert {(r.doc_id, tuple(r.ids)) for r in got} == {(d, tuple(plain(t))) for d, t, _ in rows}
    # the files are flat: all ids, in order, are all documents', and shards' bases follow each other
    flat = np.concatenate([np.fromfile(f"{folder[7:]}/{s.name}.ids", f"<u{s.width}") for s in sorted(shards, key=lambda s: s.shard)])
    assert flat.tolist() == [i for r in got for i in r.ids]
    for s in shards:
        offsets = np.fromfile(f"{folder[7:]}/{s.name}.offsets", "<u8")
        assert (len(offsets), offsets[0], offsets[-1]) == (s.n_docs + 1, s.first_token, s.first_token + s.n_tokens)
    for length in (7, 1000, 10**6):
        cut = token_files.windows(spark, folder, length).orderBy("window_no").collect()
        assert [i for r in cut for i in r.ids] == flat.tolist() and all(len(r.ids) == length for r in cut[:-1])
        assert token_files.windows(spark, folder, length, last=False).count() == len(flat) // length


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write(docs, f"file://{tmp_path}/none", PATH).count() == 0
    assert token_files.documents(spark, f"file://{tmp_path}/none").collect() == []
    assert token_files.windows(spark, f"file://{tmp_path}/none", 10).collect() == []


def test_wide_ids(spark, tmp_path):
    """An end id over 16 bits makes all ids 32 bits wide; a remote file is read in ranges."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    shard = token_files.write(docs, f"file://{tmp_path}/wide", PATH, end_id=70_000).collect()
    assert {s.width for s in shard} == {4}
    assert sorted(r.ids[-1] for r in token_files.documents(spark, f"file://{tmp_path}/wide", keep_ids=True).collect()) == [70_000, 70_000]
    file = token_files.Mapped(f"file://{tmp_path}/wide/{shard[0].name}.ids", "<u4")
    local = file[0:2].tolist()
    from pyarrow import fs

    file.file = fs.LocalFileSystem().open_input_file(f"{tmp_path}/wide/{shard[0].name}.ids")
    assert file[0:2].tolist() == local
