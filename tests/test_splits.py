"""Files read in ranges of any size give what the reader of whole files gives."""

import random

import pytest

from strandlake.sources import fasta, splits

CASES = {
    "plain.fa": b">r1 first\nACGTTGCAAC\nGGTTAA\n>r2\nTTTTGGGG\n",
    "crlf.fa": b">a\r\nACGT\r\nTT\r\n>b\r\nTTTTGG",
    "cr.fa": b">a\rACGTTGCAACGG\rTTA\r>b\r\rNNN\r",
    "marks.fa": b"before\n@x>y\nAC>in body\nGT\n>\n>empty\n>last",
    "odd.fa": "\n\n>nàme é\nAC-G*T12\nÀÉ acgt\n\n>b\r\n\r\nAC".encode(),
    "long.fa": b">one\n" + b"ACGTNNacgt" * 300 + b"\n>two\n" + b"AC\n" * 50,
    "none.fa": b"no record at all\n",
    "empty.fa": b"",
}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("fa files")
    more = {f"r{k}.fa": bytes(rng.choice(b"AC>\n\r@ acgt-") for _ in range(rng.choice([1, 9, 60]))) for k in range(12)}
    for name, body in (CASES | more).items():
        (folder / name).write_bytes(body)
    return [str(folder / name) for name in CASES | more] + [str(folder / "plain.fa")]


@pytest.fixture(scope="module")
def small(spark, paths):
    """Records and files as the reader of whole files sees them."""
    contents = fasta.read_files(spark, *paths)
    found = fasta.records(contents)
    rows = {(r.file_id, r.seq_no): (r.seq_name, r.line_len, r.size, r.start_pos, r.seq) for r in fasta.sequences(found).collect()}
    layout = fasta.file_stats(found).join(contents.select("file_id", "filename", *fasta.layout(contents.content)), "file_id")
    return rows, {r.file_id: r.asDict() for r in layout.collect()}


@pytest.mark.parametrize("split,part", [(1, 1 << 20), (3, 1), (7, 1 << 20), (64, 5), (1 << 20, 7), (1 << 20, 1 << 20)])
def test_rows_at_any_split(spark, paths, small, split, part):
    files, cut = splits.ranges(spark, *paths, split=split)
    pieces, ends = splits.scan(cut, part)
    found = splits.records(pieces)
    seqs: dict = {}
    for p in sorted(pieces.collect(), key=lambda p: (p.file_id, p.seq_no, p.range_no, p.part)):
        seqs[p.file_id, p.seq_no] = seqs.get((p.file_id, p.seq_no), "") + p.seq
    assert {(r.file_id, r.seq_no): (r.seq_name, r.line_len, r.size, r.start_pos, seqs[r.file_id, r.seq_no]) for r in found.collect()} == small[0]
    assert {r.file_id: r.asDict() for r in splits.layouts(files, found, ends).collect()} == small[1]
    whole: dict = {}
    for c in sorted(splits.chunks(pieces, 16).collect(), key=lambda c: (c.file_id, c.chunk)):
        assert c.chunk * 16 == len(whole.get(c.file_id, "")) and 0 < len(c.bases) <= 16
        whole[c.file_id] = whole.get(c.file_id, "") + c.bases
    want: dict = {}
    for (file_id, _), row in sorted(small[0].items()):
        want[file_id] = want.get(file_id, "") + row[4]
    assert whole == {k: v for k, v in want.items() if v}
    assert {f.file_id for f in files.collect()} >= {k for k, _ in small[0]}
