"""The second stage over batches against one batch of the same order."""

import random

import pytest

from strandlake import __main__ as cli
from strandlake.operators import repeats
from strandlake.streaming import ingest


def collection(files: int) -> tuple[str, dict[str, str]]:
    """A reference and files that share changes with each other, so that later ones repeat earlier ones' tuples."""
    rng = random.Random(files)
    reference = "".join(rng.choice("ACGT") for _ in range(1200))
    changed = {at: rng.choice("ACGT") for at in rng.sample(range(1200), 150)}
    made = {}
    for k in range(files):
        mine = {at for at in changed if rng.random() < 0.85}
        made[f"{k:02}.fa"] = "".join(changed[at] if at in mine else c for at, c in enumerate(reference))
    return reference, made


def batches(spark, folder, reference, parts, sources=None):
    (folder / "in").mkdir(parents=True)
    for part in parts:
        for name, text in part.items():
            (folder / "in" / name).write_text(f">s\n{text}\n")
        ingest.ingest(spark, f"{folder}/in", f"{folder}/out", reference, f"{folder}/check", sources).awaitTermination()
    names = {r.file_id: r.filename for r in spark.read.parquet(f"{folder}/out/files").collect()}
    rows = spark.read.parquet(f"{folder}/out/segments").collect()
    return sorted((names[r.file_id], r.tuple_no, names[r.src_file], r.src_tuple, r.n_tuples) for r in rows)


@pytest.mark.parametrize("sources, pairs", [(None, 0), (2, repeats.PAIRS)])
def test_three_batches_are_one(spark, tmp_path, monkeypatch, sources, pairs):
    """One batch pairs equal windows; three do as well, or sort places."""
    reference, made = collection(6)
    items = list(made.items())
    parts = [dict(items[:2]), dict(items[2:3]), dict(items[3:])]
    whole = batches(spark, tmp_path / "one", reference, [made], sources)
    monkeypatch.setattr(repeats.chosen_segments, "__defaults__", (pairs, None))
    found = batches(spark, tmp_path / "three", reference, parts, sources)
    assert found == whole
    assert {f for f, *_ in found} >= {"02.fa", "05.fa"} and all(src < f for f, _, src, _, _ in found)
    assert sources is None or {src for _, _, src, _, _ in found} <= {"00.fa", "01.fa"}
    # what segments cover is not stored, and all comes back
    stored = spark.read.parquet(f"{tmp_path}/three/out/tuples").count()
    covered = sum(n for *_, n in found)
    assert covered > stored / 4
    if sources is not None:
        return
    cli.main(["decode", f"{tmp_path}/three/out", f"{tmp_path}/back", "--ori"], spark)
    for name, text in made.items():
        assert (tmp_path / "back" / f"{name}.ori").read_text() == f">s\n{text}\n"
    cli.main(["decode", f"{tmp_path}/three/out", f"{tmp_path}/some", "04.fa", "--ori"], spark)
    assert [p.name for p in (tmp_path / "some").glob("*.ori")] == ["04.fa.ori"] and (tmp_path / "some" / "04.fa.ori").read_text() == f">s\n{made['04.fa']}\n"


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    reference, made = collection(4)
    items = list(made.items())
    found = batches(spark, tmp_path, reference, [dict(items[:2]), dict(items[2:])])
    kept = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/windows").drop("batch").collect())
    # as after a loss of the second batch's commit
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", reference, f"{tmp_path}/check").awaitTermination()
    names = {r.file_id: r.filename for r in spark.read.parquet(f"{tmp_path}/out/files").collect()}
    rows = spark.read.parquet(f"{tmp_path}/out/segments").collect()
    assert sorted((names[r.file_id], r.tuple_no, names[r.src_file], r.src_tuple, r.n_tuples) for r in rows) == found
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/windows").drop("batch").collect()) == kept
