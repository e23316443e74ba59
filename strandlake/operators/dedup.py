"""Second stage: tuple streams of files matched against tuple streams of earlier files."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import drop_staged, staged
from ..functions.buckets import MIN_SEGMENT_BYTES, tuple_bytes
from ..ordering import numbered

#: Tuples of a file that are summed in one group.
BLOCK = 1 << 16


def retained(files: DataFrame, level: int = 10) -> DataFrame:
    """files (ord from 0, 0 being the reference) with whether each enters the second-stage index.

    Of the m other files, the k-th (from 0) does if k + 1 < trunc(m * level * 0.1); level is held to 1..10.
    """
    share = min(max(level, 1), 10)
    m = files.where("ord > 0").agg(F.count("*").alias("m"))
    kept = (F.col("ord") > 0) & (F.col("ord") < F.floor(F.col("m") * share / 10))
    return files.crossJoin(F.broadcast(m)).withColumn("retained", kept).drop("m")


def running(tuples: DataFrame, step: Column, name: str) -> DataFrame:
    """tuples with block and the sum of step over the tuples of the file before each.

    Tuples are summed in blocks of BLOCK and blocks' sums carried on, so a file of any length spreads over tasks.
    """
    sized = tuples.withColumn("step", step).withColumn("block", F.floor(F.col("tuple_no") / BLOCK))
    sums = sized.groupBy("file_id", "block").agg(F.sum("step").alias("total"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("file_id", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("file_id", "block").orderBy("tuple_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn(name, F.sum("step").over(inside) - F.col("step"))
    # a row for each BLOCK tuples
    return rows.join(F.broadcast(carried), ["file_id", "block"]).withColumn(name, F.col(name) + F.col("carried")).drop("carried", "step")


def windows(tuples: DataFrame, least: int = MIN_SEGMENT_BYTES) -> DataFrame:
    """(file_id, tuple_no, window, bytes, size): from each tuple, the tuples that begin within the next `least` bytes.

    Windows that the file's end cuts short of `least` bytes are left out. A block sees the first tuples of the next.
    """
    block = F.floor(F.col("tuple_no") / BLOCK)
    blocks = F.when((F.col("tuple_no") % BLOCK < least) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    placed = tuples.select("file_id", "tuple_no", "sig", tuple_bytes(F.col("kind")).alias("bytes"), F.explode(blocks).alias("block"))
    # only differences of offsets count, so they are summed within a block, and tuples are read and shuffled once
    inside = Window.partitionBy("file_id", "block").orderBy("tuple_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("offset", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).withColumn("own", F.col("block") == block)
    ahead = Window.partitionBy("file_id", "block").orderBy("offset").rangeBetween(0, least - 1)
    framed = rows.withColumn("window", F.array_join(F.collect_list("sig").over(ahead), "|")).withColumn("width", F.sum("bytes").over(ahead))
    framed = framed.withColumn("size", F.count("*").over(ahead))
    return framed.where(F.col("own") & (F.col("width") >= least)).select("file_id", "tuple_no", "window", "bytes", "size")


def window_hits(found: DataFrame, kept: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, size) of equal windows in earlier retained files; of fresh files, if given."""
    source = found.join(kept.select("file_id"), "file_id", "left_semi")
    source = source.select(F.col("file_id").alias("src_file"), F.col("tuple_no").alias("src_tuple"), "window")
    if fresh is not None:
        found = found.join(fresh.select("file_id"), "file_id", "left_semi")
    return found.join(source, "window").where("src_file < file_id").select("file_id", "tuple_no", "src_file", "src_tuple", "size")


def segment_matches(hits: DataFrame) -> DataFrame:
    """(file_id, src_file, tuple_no, src_tuple, n_windows, n_tuples): runs of hits on a diagonal.

    A run's tuples are the first of each window and all of its last one.
    """
    diagonal = Window.partitionBy("file_id", "src_file", "diag").orderBy("tuple_no")
    rows = hits.withColumn("diag", F.col("src_tuple") - F.col("tuple_no"))
    rows = rows.withColumn("island", F.col("tuple_no") - F.row_number().over(diagonal))
    return rows.groupBy("file_id", "src_file", "diag", "island").agg(
        F.min("tuple_no").alias("tuple_no"), F.min("src_tuple").alias("src_tuple"), F.count("*").alias("n_windows"),
        (F.count("*") + F.max_by("size", "tuple_no") - 1).alias("n_tuples"),
    ).drop("diag", "island")


def best_segments(matches: DataFrame) -> DataFrame:
    """Of the matches that start at a tuple, the longest; of equals, the one in the earliest file and place."""
    best = F.max_by(
        F.struct("src_file", "src_tuple", "n_windows", "n_tuples"), F.struct(F.col("n_windows"), -F.col("src_file"), -F.col("src_tuple"))
    ).alias("m")
    return matches.groupBy("file_id", "tuple_no").agg(best).select("file_id", "tuple_no", "m.*")


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks through each file's runs, which come in order; state is the place reached and the runs that reach over it."""
    now, at, open_ = None, 0, []

    def reached(until: int | None) -> Iterator[tuple]:
        """Segments that begin before `until`."""
        nonlocal at, open_
        while open_:
            if until is not None and at >= until:
                return
            end, src_file, diag, last = open_[0]
            if last < at:
                heappop(open_)
                continue
            yield now, at, src_file, at + diag, -end - at
            at = -end

    for batch in batches:
        out: list[tuple] = []
        for file_id, start, src_file, src, windows_, tuples in zip(*(c.to_pylist() for c in batch.columns)):
            if file_id != now:
                out += reached(None)
                now, at, open_ = file_id, 0, []
            out += reached(start)
            if not open_:
                at = max(at, start)
            heappush(open_, (-(start + tuples), src_file, src - start, start + windows_ - 1))
        yield _segment_batch(out)
    yield _segment_batch(list(reached(None)))


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file_id", "tuple_no", "src_file", "src_tuple", "n_tuples"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)


def chosen_segments(matches: DataFrame) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, n_tuples): a greedy parse of each file from left to right.

    At each tuple where a window of some run begins, the run that reaches farthest is taken up to its end; of equals,
    that of the earliest file and place. Files are dealt over tasks and a file's runs pass by in order, so a task
    holds only those over the place it has reached.
    """
    rows = matches.select("file_id", "tuple_no", "src_file", "src_tuple", "n_windows", "n_tuples")
    sorted_ = rows.repartition("file_id").sortWithinPartitions("file_id", "tuple_no")
    return sorted_.mapInArrow(_choose, "file_id long, tuple_no long, src_file long, src_tuple long, n_tuples long")


#: Tuples of a file that intervals are cut at, so that they are joined by place.
SPAN = 1 << 10


def _cut(rows: DataFrame, first: str) -> DataFrame:
    """rows, a copy for each SPAN places that theirs (n_tuples from `first` on) touch, with span, and low and high there."""
    last = F.floor((F.col(first) + F.col("n_tuples") - 1) / SPAN)
    cut = rows.where("n_tuples > 0").withColumn("span", F.explode(F.sequence(F.floor(F.col(first) / SPAN), last)))
    return cut.withColumns({"low": F.greatest(first, F.col("span") * SPAN), "high": F.least(F.col(first) + F.col("n_tuples"), (F.col("span") + 1) * SPAN)})


def redirected(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """Intervals (file_id, tuple_no, src_file, src_tuple, n_tuples, done) that repeat the same tuples one step further back.

    What a segment covers in the source goes to where that one points, with its done; the rest stays and is done.
    """
    asked = _cut(intervals, "src_tuple").select("file_id", (F.col("tuple_no") + F.col("low") - F.col("src_tuple")).alias("tuple_no"), "src_file", "span", "low", "high")
    there = _cut(segments, "tuple_no").select(
        F.col("file_id").alias("src_file"), "span", F.col("low").alias("from"), F.col("high").alias("until"), F.col("src_file").alias("to_file"),
        (F.col("src_tuple") + F.col("low") - F.col("tuple_no")).alias("to_tuple"), F.col("done").alias("there_done"),
    )
    near = (asked["src_file"] == there["src_file"]) & (asked["span"] == there["span"]) & (F.col("from") < F.col("high")) & (F.col("until") > F.col("low"))
    joined = asked.join(there.select("*"), near, "left").drop(there["src_file"]).drop(there["span"])
    low, high = F.greatest("low", "from"), F.least("high", "until")
    hit = F.struct(low.alias("a"), high.alias("b"), "to_file", (F.col("to_tuple") + low - F.col("from")).alias("to"), F.col("there_done").alias("d"))
    # at most SPAN of them
    by = joined.groupBy("file_id", "tuple_no", "src_file", "low", "high").agg(F.array_sort(F.collect_list(F.when(F.col("from").isNotNull(), hit))).alias("hits"))
    begins = F.concat(F.array("low"), F.transform("hits", lambda h: h["b"]))
    ends = F.concat(F.transform("hits", lambda h: h["a"]), F.array("high"))
    gaps = F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    moved = by.select("file_id", "tuple_no", "low", F.explode("hits").alias("h"))
    moved = moved.select("file_id", (F.col("tuple_no") + F.col("h.a") - F.col("low")).alias("tuple_no"), F.col("h.to_file").alias("src_file"), F.col("h.to").alias("src_tuple"), (F.col("h.b") - F.col("h.a")).alias("n_tuples"), F.col("h.d").alias("done"))
    stay = by.select("file_id", "tuple_no", "low", "src_file", F.explode(F.filter(gaps, lambda g: g["a"] < g["b"])).alias("g"))
    stay = stay.select("file_id", (F.col("tuple_no") + F.col("g.a") - F.col("low")).alias("tuple_no"), "src_file", F.col("g.a").alias("src_tuple"), (F.col("g.b") - F.col("g.a")).alias("n_tuples"), F.lit(True).alias("done"))
    return moved.unionByName(stay)


def resolved(segments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, n_tuples): where the covered tuples of the wanted files (all, if None) are stored.

    For some files, their segments are followed back a step at a time and nothing else is touched. For all files,
    segments are followed by way of each other, so that steps double.
    """
    open_ = segments.withColumn("done", F.lit(False))
    steps = open_
    if wanted is not None:
        open_ = open_.join(wanted, "file_id", "left_semi")
    found = staged(open_, "intervals")
    while not found.where("not done").isEmpty():
        more = redirected(found.where("not done").drop("done"), steps if wanted is not None else found)
        last, found = found, staged(found.where("done").unionByName(more), "intervals")
        drop_staged(last)
    return found.drop("done")


def uncovered(tuples: DataFrame, segments: DataFrame) -> DataFrame:
    """Tuples that no segment covers."""
    cut = _cut(segments, "tuple_no").select(F.col("file_id").alias("f"), "span", "low", "high")
    here = (F.col("file_id") == F.col("f")) & (F.floor(F.col("tuple_no") / SPAN) == F.col("span")) & F.col("tuple_no").between(F.col("low"), F.col("high") - 1)
    return tuples.join(cut, here, "left_anti")


def restored(own: DataFrame, segments: DataFrame, files: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """All tuples of the wanted files (all, if None) from those stored and the segments that cover the others.

    Steps end when no segment leads on; `files` is no longer needed.
    """
    return looked_up(own, resolved(segments, wanted), wanted)


def looked_up(own: DataFrame, places: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """All tuples of the wanted files (all, if None): those stored, and those that places (resolved) say are stored elsewhere."""
    cut = _cut(places, "src_tuple").select("file_id", "src_file", "span", "low", "high", (F.col("tuple_no") - F.col("src_tuple")).alias("shift"))
    source = own.withColumnRenamed("file_id", "own_file")
    here = (F.col("own_file") == F.col("src_file")) & (F.floor(F.col("tuple_no") / SPAN) == F.col("span")) & F.col("tuple_no").between(F.col("low"), F.col("high") - 1)
    lent = source.join(cut, here).withColumn("tuple_no", F.col("tuple_no") + F.col("shift")).select(*own.columns)
    mine = own if wanted is None else own.join(F.broadcast(wanted), "file_id", "left_semi")
    return running(lent.unionByName(mine).drop("out_start"), F.col("len"), "out_start").select(*own.columns)


def expand(segments: DataFrame, tuples: DataFrame, count: str = "n_windows") -> DataFrame:
    """The tuples that segments stand for: (file_id, tuple_no, src_file, src_tuple, kind, sig)."""
    places = segments.select(
        "file_id", F.col("tuple_no").alias("first"), "src_file", F.col("src_tuple").alias("src_first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias("k"),
    ).select("file_id", (F.col("first") + F.col("k")).alias("tuple_no"), "src_file", (F.col("src_first") + F.col("k")).alias("src_tuple"))
    source = tuples.select(F.col("file_id").alias("src_file"), F.col("tuple_no").alias("src_tuple"), "kind", "sig")
    return places.join(source, ["src_file", "src_tuple"])


def position_deltas(tuples: DataFrame) -> DataFrame:
    """tuples with the reference position each was expected at: a literal moves it by one, others by their length.

    A match sets it to its own end; before the first match it counts from 1. What a tuple expects is how far the file
    has moved so far plus the lead of the last match over that; both are carried from block to block.
    """
    step = F.when(F.col("kind") == "LIT", 1).otherwise(F.col("len"))
    inside = Window.partitionBy("file_id", "block").orderBy("tuple_no")
    rows = tuples.withColumn("block", F.floor(F.col("tuple_no") / BLOCK)).withColumn("step", step)
    rows = rows.withColumn("moved", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("lead", F.when(F.col("kind") == "MATCH", F.col("ref_pos") + F.col("len") - F.col("moved")))
    sums = rows.groupBy("file_id", "block").agg(
        F.sum("step").alias("total"), F.max_by("lead", F.when(F.col("lead").isNotNull(), F.col("tuple_no"))).alias("last_lead")
    )
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("moved0", F.coalesce(F.sum("total").over(before), F.lit(0)))
    sums = sums.withColumn("lead0", F.coalesce(F.last(F.col("last_lead") - F.col("moved0"), ignorenulls=True).over(before), F.lit(1)))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = F.last("lead", ignorenulls=True).over(earlier)
    rows = rows.withColumn("own_lead", own).join(sums.select("file_id", "block", "moved0", "lead0"), ["file_id", "block"])
    lead = F.coalesce(F.col("own_lead") - F.col("moved0"), F.col("lead0"))
    expected = F.col("moved0") + F.col("moved") - F.col("step") + lead
    return rows.select(*tuples.columns, expected.alias("expected"))


#: Residues of a file that tuples are cut at, so that places are found by residue.
RESIDUES = 1 << 16


def segment_deltas(segments: DataFrame, tuples: DataFrame) -> DataFrame:
    """segments (file_id, tuple_no, src_file, src_tuple, n_tuples) with the tuple each was expected at, and delta from it.

    A file goes on in a source where its last segment of that source ended (at first, at the source's beginning), moved by
    the residues that the file has had since then. The tuple that holds the last of these is passed if no more than
    half of it lies beyond them; past the source's end, the expected tuple is the one after its last.
    """
    placed = staged(running(tuples.select("file_id", "tuple_no", "len"), F.col("len"), "before").select("file_id", "tuple_no", "len", "before"), "residues")
    at = lambda file, tuple_, what, name: placed.select(F.col("file_id").alias(file), F.col("tuple_no").alias(tuple_), what.alias(name))
    after = F.col("before") + F.col("len")
    rows = segments.withColumns({"last": F.col("tuple_no") + F.col("n_tuples") - 1, "src_last": F.col("src_tuple") + F.col("n_tuples") - 1})
    rows = rows.join(at("file_id", "tuple_no", F.col("before"), "had"), ["file_id", "tuple_no"])
    rows = rows.join(at("file_id", "last", after, "has"), ["file_id", "last"]).join(at("src_file", "src_last", after, "src_has"), ["src_file", "src_last"])
    # the segment before in the same pair of files, found by number, so that no pair is one task
    order = numbered(rows, ["file_id", "src_file"], "no", then=("tuple_no",))
    before = order.select("file_id", "src_file", (F.col("no") + 1).alias("no"), (F.col("src_last") + 1).alias("from"), F.col("has").alias("had0"), F.col("src_has").alias("src_had0"))
    rows = order.join(before, ["file_id", "src_file", "no"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("from", "had0", "src_had0")})
    rows = rows.withColumn("moved", F.col("had") - F.col("had0")).withColumn("target", F.col("src_had0") + F.col("moved"))
    rows = staged(rows.select("file_id", "tuple_no", "src_file", "src_tuple", "n_tuples", "from", "moved", "target"), "deltas")

    spans = placed.withColumn("span", F.explode(F.sequence(F.floor(F.col("before") / RESIDUES), F.floor((after - 1) / RESIDUES))))
    spans = spans.select(F.col("file_id").alias("held_file"), "span", F.col("tuple_no").alias("held"), F.col("before").alias("held_from"), F.col("len").alias("held_len"))
    far = rows.where("moved > 0").withColumn("asked", F.floor((F.col("target") - 1) / RESIDUES))
    inside = (F.col("src_file") == F.col("held_file")) & (F.col("asked") == F.col("span"))
    inside &= (F.col("held_from") < F.col("target")) & (F.col("target") <= F.col("held_from") + F.col("held_len"))
    ends = tuples.groupBy(F.col("file_id").alias("src_file")).agg((F.max("tuple_no") + 1).alias("end"))
    passed = F.when(F.col("held_len") <= 2 * (F.col("target") - F.col("held_from")), 1).otherwise(0)
    found = far.join(spans, inside, "left").join(ends, "src_file").withColumn("expected", F.coalesce(F.col("held") + passed, F.col("end")))
    near = rows.where("moved <= 0").withColumn("expected", F.col("from"))
    names = ["file_id", "tuple_no", "src_file", "src_tuple", "n_tuples", "expected"]
    return found.select(*names).unionByName(near.select(*names)).withColumn("delta", F.col("src_tuple") - F.col("expected"))
