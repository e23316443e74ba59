"""Near-duplicate classes by min-max hashing.

Every permutation of the hashed shingles gives two signature values, the least and the greatest, so 80
permutations give the 160 values of 32 bands of 5. Documents with equal shingle sets are one class before
banding; only one representative a class goes on. Bucket members are linked to a hub first, links are confirmed
on whole sets, and buckets that still hold several components go on to further pairs until each pair is linked,
joined by other links, or shown too different by a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, among, column, connected_components, mix, staged, text_steps

BANDS, ROWS = 32, 5
#: Members of a bucket that are compared with the whole bucket in one round.
HUBS = 2048

_MULTIPLIERS = mix(np.arange(BANDS * ROWS // 2, dtype=U64), 101) | U64(1)
_BAND = mix(np.arange(ROWS, dtype=U64), 202) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin.

    A text with fewer words than a shingle takes has its whole word sequence as its one shingle.
    """
    w = Words(data, offsets, fold=True)
    hashes, whole = w.runs(words)
    owner = np.searchsorted(w.first, np.flatnonzero(whole), side="right") - 1
    hashes = hashes[whole]
    counts = np.diff(w.first)
    for k in range(1, words):
        short = np.flatnonzero(counts == k)
        if len(short):
            hashes = np.concatenate([hashes, w.runs(k)[0][w.first[short]]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))]
)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for i, j, data, offsets in text_steps(texts):
                sets, begin = shingle_sets(data, offsets, words)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                at = begin[full]
                f1, f2 = np.zeros(j - i, U64), np.zeros(j - i, U64)
                keys = np.zeros((j - i, BANDS), U64)
                if len(full):
                    f1[full] = np.add.reduceat(mix(sets, 11), at)
                    f2[full] = np.add.reduceat(mix(sets, 12), at)
                    half = len(_MULTIPLIERS)
                    values = np.empty((len(full), 2 * half), U64)
                    spare = np.empty_like(sets)
                    for k in range(half):
                        np.multiply(sets, _MULTIPLIERS[k], out=spare)
                        values[:, k] = np.minimum.reduceat(spare, at)
                        values[:, half + k] = np.maximum.reduceat(spare, at)
                    for b in range(BANDS):
                        keys[full, b] = mix((values[:, b * ROWS : (b + 1) * ROWS] * _BAND).sum(axis=1), b)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists],
                    schema=_SIGNED,
                )

    return run


def _intersections(words: int, percent: int):
    """(a, b, same, linked): how many shingles whole texts share, and whether that links them.

    Rows come ordered by b, so b's set is kept from one to the next.
    """

    def sets_of(texts: pa.Array) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for _, _, data, offsets in text_steps(texts):
            sets, begin = shingle_sets(data, offsets, words)
            found += [sets[begin[k] : begin[k + 1]] for k in range(len(offsets) - 1)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, str, np.ndarray] | None = None
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                b, right = column(batch, "b").to_pylist(), column(batch, "text_b")
                found, linked = [], []
                for k, x in enumerate(sets_of(column(batch, "text_a"))):
                    text = right[k].as_py()
                    if kept is None or kept[0] != b[k] or kept[1] != text:
                        kept = b[k], text, sets_of(pa.array([text], pa.large_string()))[0]
                    y = kept[2]
                    if len(x) > len(y):
                        x, y = y, x
                    spot = np.searchsorted(y, x)
                    same = int((y[np.minimum(spot, len(y) - 1)] == x).sum()) if len(x) else 0
                    found.append(same)
                    linked.append(len(x) > 0 and 100 * same >= percent * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "a"), column(batch, "b"), pa.array(found, pa.int64()), pa.array(linked, pa.bool_())],
                    names=["a", "b", "same", "linked"],
                )

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for i, _, data, offsets in text_steps(column(batch, "text")):
                sets, begin = shingle_sets(data, offsets, words)
                owner = np.repeat(np.arange(len(offsets) - 1) + i, np.diff(begin))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(sets.view(np.int64))], names=["rep", "shingle"])

    return run


def near_duplicate_classes(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id long, text string).

    Links join texts whose sets of `words`-word shingles (A-Z lower-cased) satisfy
    100 * |intersection| >= percent * |union|; component_id is the least doc_id reachable over links.
    Null or wordless texts have no shingles and no links. Rows that repeat a doc_id are one node: their links
    are pooled. A row with a null doc_id links with nothing: component_id null, kept true. Other columns of docs
    are ignored. An empty table gives an empty one.
    A link of similarity 0.8 escapes all 32 bands with a chance of 3e-6.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(
        source.mapInArrow(_signatures(words), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "signatures"
    )
    real = signed.where("n > 0 and doc_id is not null")
    classes = staged(
        real.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes"
    )
    members = real.select("doc_id", "n", "f1", "f2").join(classes.drop("bands"), ["n", "f1", "f2"]).select("doc_id", "rep", "n")

    # rows that repeat a doc_id with other texts tie the classes of these texts together
    pooled = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("m")).where("b < m")
    pooled = members.join(pooled.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")

    # band keys are salted by their band, so a key alone names a bucket
    rows = classes.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = staged(rows.join(shared, "key"), "shared")
    # the hub of a bucket is its member with the most company over all bands: the middle of its group
    company = shared.groupBy("rep").agg(F.sum("size").alias("company"))
    hubs = shared.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", -F.col("rep"))).alias("hub"))
    hubs = hubs.select("key", (-F.col("hub.col2")).alias("hub"))
    slot = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / HUBS)).alias("slot")
    buckets = staged(shared.join(hubs, "key").select("key", "rep", "hub", slot), "buckets")
    texts = staged(among(source, buckets.select(F.col("rep").alias("doc_id")).distinct()), "candidates")

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b, same, linked) for distinct pairs (a, b); of texts that share a doc_id, the most similar count."""
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.distinct().join(left, "a").join(right, "b")
        each = both.mapInArrow(_intersections(words, percent), "a long, b long, same long, linked boolean")
        return each.groupBy("a", "b").agg(F.max("same").alias("same"), F.max("linked").alias("linked"))

    scores = staged(compared(buckets.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))), "scores")
    labels = connected_components(scores.where("linked").select("a", "b").union(pooled))
    # Buckets that still hold several components go on: pairs of these are compared unless they can't be similar.
    # What two texts share lies in the hub's set, or outside of it among shingles that another open text has too.
    scored = buckets
    named = lambda: scored.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    split = named().groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")
    ).where("low < high and members > 2")
    open_ = staged(buckets.join(split.select("key"), "key"), "open")
    last = open_.agg(F.max("slot")).first()[0]
    if last is not None:
        reps = open_.select("rep").distinct()
        open_texts = texts.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        alone = (
            open_texts.mapInArrow(_shingles(words), "rep long, shingle long").groupBy("shingle")
            .agg(F.count("*").alias("texts"), F.first("rep").alias("rep")).where("texts = 1")
            .groupBy("rep").agg(F.count("*").alias("own"))
        )
        facts = classes.join(reps, "rep", "left_semi").join(alone, "rep", "left").select("rep", "n", "bands", F.coalesce("own", F.lit(0)).alias("own"))
        with_hub = scores.select(F.col("a").alias("rep"), F.col("b").alias("hub"), "same")
        scored = staged(
            open_.join(facts, "rep").join(with_hub, ["rep", "hub"], "left").withColumn("same", F.coalesce("same", "n"))
            .withColumn("rest", F.greatest(F.lit(0), F.expr("n - same - own"))).drop("own"), "scored",
        )
        for t in range(last + 1):
            each = named().where("rep <> hub")
            mine = each.where(f"slot = {t}").select("key", *(F.col(c).alias(f"h_{c}") for c in ("rep", "n", "same", "rest", "bands", "component")))
            most = "(least(same, h_same) + least(rest, h_rest))"
            # a pair comes from the first bucket that it shares
            pairs = each.join(mine, "key").where(f"""
                component <> h_component and (slot > {t} or slot = {t} and rep > h_rep)
                and 100 * {most} >= {percent} * (n + h_n - {most})
                and not exists(zip_with(slice(bands, 1, cast(array_position(bands, key) as int) - 1),
                                        slice(h_bands, 1, cast(array_position(bands, key) as int) - 1), (x, y) -> x = y), same_key -> same_key)
            """)
            pairs = pairs.select(F.greatest("rep", "h_rep").alias("a"), F.least("rep", "h_rep").alias("b"))
            found = staged(compared(pairs).where("linked").select("a", "b"), "links")
            if not found.isEmpty():
                labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    result = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id")
    )
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(result, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
