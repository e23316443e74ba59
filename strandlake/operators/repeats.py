"""The longest repeat at each place of tuple streams, from one sorted order of all places.

Places are put in the order of the windows that follow them: first of GRAM windows, then, where those are equal, of GRAM
such groups, and so on, so each round reads GRAM times farther and only places that are still equal take part. In this
order the places that share most windows with a place are its neighbours: the nearest ones, on either side, of an earlier
retained file. What they share is the least of the shared lengths between. Nothing pairs equal windows, so work grows
with the places, however often a window stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import staged
from ..intervals import first_below, least_between, least_of, minima, next_below
from ..ordering import numbered, running_sums
from . import dedup

#: Windows, or groups of them, that are compared at once; places of the order that a task solves by itself.
GRAM, CELL = 8, 1 << 16
#: Tuples of a file whose grams are made in one group.
BLOCK = 1 << 16
#: Stands for a file, or a place, that repeats may not come from.
NOWHERE = (1 << 62) + 1
#: Bits of a place that number the tuple in its file.
TUPLE_BITS = 40

SEGMENTS = "file_id long, tuple_no long, src_file long, src_tuple long, n_tuples long"


# ---------------------------------------------------------------- the order of places


def _grams(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, tuple_no, gram): up to GRAM windows from each place on, as far as they occur in an earlier retained file
    or in a later one of a retained place. Others end a gram like the end of the file, as no repeat goes on there."""
    keyed = found.select("file_id", "tuple_no", "window")
    source = kept.select("file_id", F.lit(True).alias("kept"))
    marked = keyed.join(source, "file_id", "left")
    earliest = F.min(F.when(F.col("kept"), F.col("file_id")))
    shared = marked.groupBy("window").agg(earliest.alias("low"), F.max("file_id").alias("high")).where("low < high").select("window")
    # small numbers stand for windows: they shuffle at a fraction of a hash's bytes, and tell windows apart for certain
    shared = numbered(shared, "window", "key")
    block = F.floor(F.col("tuple_no") / BLOCK)
    blocks = F.when((F.col("tuple_no") % BLOCK < GRAM - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = keyed.join(shared, "window", "left").select("file_id", "tuple_no", F.coalesce("key", F.lit(-1).cast("long")).alias("key"), F.explode(blocks).alias("block"))
    ahead = Window.partitionBy("file_id", "block").orderBy("tuple_no").rangeBetween(0, GRAM - 1)
    rows = rows.withColumn("gram", F.collect_list("key").over(ahead)).where((F.col("block") == block) & (F.col("key") >= 0))
    end = F.array_position("gram", F.lit(-1).cast("long"))
    cut = F.slice("gram", 1, F.when(end > 0, (end - 1).cast("int")).otherwise(F.size("gram")))
    return rows.select("file_id", "tuple_no", cut.alias("gram"))


def _tied(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group of by: its first place in the order and how many places it has."""
    return rows.groupBy(*by).agg(F.min(order).alias("group_first"), F.count("*").alias("group_size"))


def _ordered(grams: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(file_id, tuple_no, at): places in order; and for each round the grams (file_id, tuple_no, gram) compared in it."""
    placed = numbered(grams, "gram", "at", then=("file_id", "tuple_no"))
    ranked = placed.join(_tied(placed, ["gram"], "at"), "gram")
    ranked = staged(ranked.select("file_id", "tuple_no", F.col("group_first").alias("rank"), (F.col("group_size") > 1).alias("more"), (F.size("gram") == GRAM).alias("whole")), "ranks")
    levels, span = [placed.select("file_id", "tuple_no", "gram")], GRAM
    open_ = ranked.where("more and whole").select("file_id", "tuple_no", "rank")
    if open_.isEmpty():
        return placed.select("file_id", "tuple_no", "at"), levels
    ranks = ranked.drop("more")
    while not open_.isEmpty():
        # the ranks at every span-th place; a rank is the number of places before its group, in each round's order
        asked = open_.select("file_id", "tuple_no", "rank", F.explode(F.sequence(F.lit(0), F.lit(GRAM - 1))).alias("k"))
        asked = asked.withColumn("there", F.col("tuple_no") + F.col("k") * span)
        there = ranks.select("file_id", F.col("tuple_no").alias("there"), F.col("rank").alias("r"), F.col("whole").alias("w"))
        row = F.array_sort(F.collect_list(F.struct("k", "r", "w")))
        read = asked.join(there, ["file_id", "there"]).groupBy("file_id", "tuple_no", "rank").agg(row.alias("row"))
        # what stands after a missing place or a group that ends early does not count
        short = F.array_position(F.transform("row", lambda s: s["w"]), False).cast("int")
        run = F.filter(F.when(short > 0, F.slice("row", 1, short)).otherwise(F.col("row")), lambda s, i: s["k"] == i)
        made = read.withColumn("row", run).select(
            "file_id", "tuple_no", "rank", F.transform("row", lambda s: s["r"]).alias("gram"), ((F.size("row") == GRAM) & F.element_at("row", -1)["w"]).alias("whole")
        )
        sorted_ = numbered(made, ["rank", "gram"], "a", then=("file_id", "tuple_no"))
        levels.append(sorted_.select("file_id", "tuple_no", "gram"))
        old = sorted_.groupBy("rank").agg(F.min("a").alias("old_first"))
        new = sorted_.join(_tied(sorted_, ["rank", "gram"], "a"), ["rank", "gram"]).join(old, "rank")
        new = staged(
            new.select("file_id", "tuple_no", (F.col("rank") + F.col("group_first") - F.col("old_first")).alias("new"), (F.col("group_size") > 1).alias("more"), F.col("whole").alias("new_whole")),
            "ranks",
        )
        both = ranks.join(new.drop("more"), ["file_id", "tuple_no"], "left")
        ranks = staged(both.select("file_id", "tuple_no", F.coalesce("new", "rank").alias("rank"), F.coalesce("new_whole", "whole").alias("whole")), "ranks")
        open_ = new.where("more and new_whole").select("file_id", "tuple_no", F.col("new").alias("rank"))
        span *= GRAM
    return numbered(ranks, "rank", "at", then=("file_id", "tuple_no")).select("file_id", "tuple_no", "at"), levels


def _shared(order: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(at, shared): windows that each place but the first shares with the one before it."""
    before = order.select((F.col("at") + 1).alias("at"), F.col("file_id").alias("file_b"), F.col("tuple_no").alias("tuple_b"))
    rows = order.join(before, "at").withColumn("shared", F.lit(0).cast("long"))
    for k in reversed(range(len(levels))):
        a = levels[k].select("file_id", F.col("tuple_no").alias("x"), F.col("gram").alias("a"))
        b = levels[k].select(F.col("file_id").alias("file_b"), F.col("tuple_no").alias("y"), F.col("gram").alias("b"))
        moved = rows.withColumns({"x": F.col("tuple_no") + F.col("shared"), "y": F.col("tuple_b") + F.col("shared")})
        differ = F.array_position(F.zip_with("a", "b", lambda p, q: p.eqNullSafe(q)), False)
        # of equal ones, the last group is compared in the next round again; in the last round all windows count
        equal = F.when(F.col("a").isNull() | F.col("b").isNull(), 0).when(differ > 0, differ - 1).otherwise(F.size("a") - (1 if k else 0))
        if k:
            some = moved.join(a, ["file_id", "x"]).join(b, ["file_b", "y"]).select("at", (equal * GRAM**k).alias("more"))
            rows = staged(rows.join(some, "at", "left").withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0))).drop("more"), "shared")
        else:
            both = moved.join(a, ["file_id", "x"], "left").join(b, ["file_b", "y"], "left")
            rows = both.select("at", (F.col("shared") + equal).alias("shared"))
    return rows


# ---------------------------------------------------------------- neighbours


def _sides(cell: pd.DataFrame) -> pd.DataFrame:
    """What each place shares with the nearest place of an earlier retained file before and after it, or none where the
    search leaves the cell."""
    cell = cell.sort_values("at")
    file_id, source, shared = (cell[c].to_numpy(np.int64) for c in ("file_id", "source", "shared"))
    n = len(cell)
    at = np.arange(n)
    lengths = minima(shared)

    def ahead(rows_source, rows_shared, border_from):
        found = next_below(rows_source, at + 1, file_id if rows_source is forward else file_id[::-1])
        border = next_below(rows_shared, border_from, np.ones(n, np.int64))
        return found, border

    forward, mirrored = minima(source), minima(source[::-1].copy())
    right, border = ahead(forward, lengths, at + 1)
    after = np.zeros(n, np.int64)
    some = (right < n) & (right < border)
    after[some] = least_of(lengths, at[some] + 1, right[some])
    known_after = (right < n) | (border < n)
    left, first = ahead(mirrored, minima(shared[::-1].copy()), at)
    left, first = n - 1 - left[::-1], n - 1 - first[::-1]
    before = np.zeros(n, np.int64)
    some = (left >= 0) & (left >= first)
    before[some] = least_of(lengths, left[some] + 1, at[some])
    known_before = (left >= 0) | (first >= 0)
    return pd.DataFrame({
        "at": cell["at"].to_numpy(), "before": pd.array(np.where(known_before, before, 0), "Int64").copy(), "after": pd.array(np.where(known_after, after, 0), "Int64").copy(),
        "known": known_before & known_after,
    })


def _earliest(cell: pd.DataFrame) -> pd.DataFrame:
    """The earliest retained place among those that share `need` windows with each place; none where they leave the cell."""
    cell = cell.sort_values("at")
    need, shared, source = (cell[c].to_numpy(np.int64) for c in ("need", "shared", "place"))
    n = len(cell)
    at = np.arange(n)
    end = next_below(minima(shared), at + 1, need)
    first = n - 1 - next_below(minima(shared[::-1].copy()), at, need[::-1])[::-1]
    known = (end < n) & (first >= 0) & (need > 0)
    place = np.full(n, NOWHERE)
    place[known] = least_of(minima(source), first[known], end[known] - 1)
    return pd.DataFrame({"at": cell["at"].to_numpy(), "earliest": place, "known": known})


def _cells(rows: DataFrame, function, kinds: str) -> DataFrame:
    return rows.withColumn("cell", F.floor(F.col("at") / CELL)).groupBy("cell").applyInPandas(function, kinds)


def _mirror(array: DataFrame, size: int) -> DataFrame:
    return array.select((size - 1 - F.col("index")).alias("index"), "value")


def _array(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(F.col("at").alias("index"), value.alias("value"))


def _far_shared(rows: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(at, most): what places whose search leaves their cell share with the nearest place of an earlier retained file."""
    source, shared = _array(rows, F.col("source")), _array(rows, F.col("shared"))
    right = first_below(source, asked.select((F.col("at") + 1).alias("start"), F.col("file_id").alias("below")), size)
    left = first_below(_mirror(source, size), asked.select((size - F.col("at")).alias("start"), F.col("file_id").alias("below")), size)
    spans = right.select((F.col("start") - 1).alias("at"), F.col("start").alias("first"), F.col("found").alias("last")).unionByName(
        left.select((size - F.col("start")).alias("at"), (size - F.col("found")).alias("first"), (size - F.col("start")).alias("last"))
    )
    spans = staged(spans, "spans")
    least = least_between(shared, spans.select("first", "last").distinct(), size)
    return spans.join(least, ["first", "last"]).groupBy("at").agg(F.max("least").alias("most"))


def _far_earliest(rows: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(at, earliest) for places (at, need) whose group leaves their cell."""
    shared, place = _array(rows, F.col("shared")), _array(rows, F.col("place"))
    end = first_below(shared, asked.select((F.col("at") + 1).alias("start"), F.col("need").alias("below")), size)
    first = first_below(_mirror(shared, size), asked.select((size - 1 - F.col("at")).alias("start"), F.col("need").alias("below")), size)
    end = end.select((F.col("start") - 1).alias("at"), (F.col("found") - 1).alias("last"))
    first = first.select((size - 1 - F.col("start")).alias("at"), (size - 1 - F.col("found")).alias("first"))
    spans = staged(end.join(first, "at"), "spans")
    least = least_between(place, spans.select("first", "last").distinct(), size)
    return spans.join(least, ["first", "last"]).select("at", F.col("least").alias("earliest"))


def _placed(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(at, file_id, tuple_no, shared, source, place): places in order, what each shares with the one before it, and where
    repeats may come from. sources: (file_id, no), fewer than 2^22 of them."""
    order, levels = _ordered(staged(_grams(found, sources), "grams"))
    order = staged(order, "order")
    return order.join(_shared(order, levels), "at", "left").join(sources, "file_id", "left").select(
        "at", "file_id", "tuple_no", F.coalesce("shared", F.lit(0)).alias("shared"),
        F.when(F.col("no").isNotNull(), F.col("file_id")).otherwise(NOWHERE).alias("source"),
        F.when(F.col("no").isNotNull(), F.col("no") * (1 << TUPLE_BITS) + F.col("tuple_no")).otherwise(NOWHERE).alias("place"),
    )


def longest_repeats(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, n_tuples): at every place whose window occurs in an earlier file of kept,
    the repeat that reaches farthest; of equals, that of the earliest file and place.

    found: windows (file_id, tuple_no, window, size) of tuples; a repeat's tuples are the first of each window that it
    shares and all of its last one. kept: file_id, fewer than 2^22 of them.
    """
    found = staged(found.select("file_id", "tuple_no", "window", "size"), "windows")
    sources = staged(numbered(kept.select("file_id").distinct(), "file_id", "no"), "sources")
    rows = staged(_placed(found, sources), "order")
    size = rows.count() + 1  # and a place after the last, which shares nothing
    spark = found.sparkSession
    nothing = F.lit(0).cast("long")
    last = spark.range(size - 1, size).select(F.col("id").alias("at"), F.lit(-NOWHERE).alias("file_id"), F.lit(-1).cast("long").alias("tuple_no"), nothing.alias("shared"), F.lit(NOWHERE).alias("source"), F.lit(NOWHERE).alias("place"))
    rows = staged(rows.unionByName(last), "places")

    sides = staged(_cells(rows.select("at", "file_id", "source", "shared"), _sides, "at long, before long, after long, known boolean"), "sides")
    near = sides.where("known").select("at", F.greatest("before", "after").alias("most"))
    far = sides.where("not known").join(rows.select("at", "file_id"), "at").where("file_id >= 0")
    most = near if far.isEmpty() else near.unionByName(_far_shared(rows, far.select("at", "file_id"), size))
    most = rows.select("at", "file_id", "tuple_no").join(most.where("most > 0"), "at")

    # the fewest windows that reach as far as the most do
    ends = found.select("file_id", "tuple_no", (F.col("tuple_no") + F.col("size")).alias("end"))
    alike = ends.groupBy("file_id", "end").agg(F.min("tuple_no").alias("first_window"))
    reach = most.withColumn("last_window", F.col("tuple_no") + F.col("most") - 1)
    reach = reach.join(ends.withColumnRenamed("tuple_no", "last_window"), ["file_id", "last_window"]).join(alike, ["file_id", "end"])
    need = F.greatest(F.col("first_window") - F.col("tuple_no"), nothing) + 1
    reach = staged(reach.select("at", "file_id", "tuple_no", (F.col("end") - F.col("tuple_no")).alias("n_tuples"), need.alias("need")), "reach")

    asked = rows.select("at", "shared", "place").join(reach.select("at", "need"), "at", "left").withColumn("need", F.coalesce("need", nothing))
    earliest = staged(_cells(asked, _earliest, "at long, earliest long, known boolean"), "earliest")
    near = earliest.where("known").select("at", "earliest")
    far = reach.select("at", "need").join(earliest.where("not known").select("at"), "at")
    best = near if far.isEmpty() else near.unionByName(_far_earliest(rows, far, size))
    made = reach.join(best, "at").withColumn("no", F.shiftright("earliest", TUPLE_BITS))
    made = made.join(sources.select("no", F.col("file_id").alias("src_file")), "no")
    return made.select("file_id", "tuple_no", "src_file", F.col("earliest").bitwiseAND(F.lit((1 << TUPLE_BITS) - 1)).alias("src_tuple"), "n_tuples")


# ---------------------------------------------------------------- the parse


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places with repeats come in order; one that no repeat before it covers begins the next."""
    now, at = None, 0
    for batch in batches:
        taken = []
        for k, (file_id, start, n) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file_id", "tuple_no", "n_tuples")))):
            if file_id != now:
                now, at = file_id, 0
            if start >= at:
                taken.append(k)
                at = start + n
        yield batch.take(pa.array(taken, pa.int64()))


def chosen_repeats(best: DataFrame) -> DataFrame:
    """Of repeats at every place, those of a greedy parse of each file from left to right. A task holds two numbers."""
    rows = best.select(*(part.split()[0] for part in SEGMENTS.split(", ")))
    return rows.repartition("file_id").sortWithinPartitions("file_id", "tuple_no").mapInArrow(_walk, SEGMENTS)


#: Windows from each place on that are compared where the first one lies; a first window that stands more often than HEAVY
#: times is too much for one group. NEAR is 2 at least: where the second window differs, a run of equal windows ends.
NEAR, HEAVY = 4, 1 << 20


def _following(found: DataFrame, before: bool = False) -> DataFrame:
    """(file_id, tuple_no, g0, n0, g1, n1, ...): the NEAR windows from each place on, as far as the file has them, and the
    tuples up to the end of each; with `before`, also the window before the place (before), null at the file's first."""
    block, inside = F.floor(F.col("tuple_no") / BLOCK), F.col("tuple_no") % BLOCK
    blocks = F.array(block)
    blocks = F.when((inside < NEAR - 1) & (block > 0), F.concat(blocks, F.array(block - 1))).otherwise(blocks)
    if before:
        blocks = F.when(inside == BLOCK - 1, F.concat(blocks, F.array(block + 1))).otherwise(blocks)
    rows = found.select("file_id", "tuple_no", "window", "size", F.explode(blocks).alias("block"))
    order = Window.partitionBy("file_id", "block").orderBy("tuple_no")
    for k in range(NEAR):
        follows = F.lead("tuple_no", k).over(order) == F.col("tuple_no") + k
        rows = rows.withColumns({f"g{k}": F.when(follows, F.lead("window", k).over(order)), f"n{k}": F.when(follows, F.lead("size", k).over(order) + k)})
    if before:
        rows = rows.withColumn("before", F.when(F.lag("tuple_no").over(order) == F.col("tuple_no") - 1, F.lag("window").over(order)))
    return rows.where(F.col("block") == block).drop("window", "size", "block")


def _near(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, n_tuples, wide, wide_size): at every place, the repeat of up to NEAR windows
    that reaches farthest, or null; of equals, that of the earliest file and place.

    The earliest retained place of those that share L windows is the answer for L, if its file is an earlier one; so nothing
    is paired. wide holds the NEAR windows from places that share them with an earlier retained file or a later one.
    """
    rows, g = _following(found), [f"g{k}" for k in range(NEAR)]
    rows = rows.join(kept.select("file_id", F.lit(True).alias("kept")), "file_id", "left")
    # one shuffle and one sort: groups of more windows lie in those of fewer
    rows = rows.repartition("g0").sortWithinPartitions(*g)
    place = F.when(F.col("kept"), F.struct(F.col("file_id").alias("file"), F.col("tuple_no").alias("place")))
    rows = rows.withColumn("high", F.max("file_id").over(Window.partitionBy(*g)))
    for k in reversed(range(NEAR)):
        rows = rows.withColumn(f"e{k}", F.min(place).over(Window.partitionBy(*g[: k + 1])))
    shared = [F.coalesce(F.col(f"g{k}").isNotNull() & (F.col(f"e{k}.file") < F.col("file_id")), F.lit(False)) for k in range(NEAR)]
    reach = F.coalesce(*(F.when(shared[k], F.col(f"n{k}")) for k in reversed(range(NEAR))))
    # the fewest windows that reach as far
    source = F.coalesce(*(F.when(shared[k] & (F.col(f"n{k}") == reach), F.col(f"e{k}")) for k in range(NEAR)))
    wide = F.col(g[-1]).isNotNull() & (F.col(f"e{NEAR - 1}.file") < F.col("high"))
    rows = rows.select("file_id", "tuple_no", source.alias("s"), reach.cast("long").alias("n_tuples"), F.when(wide, F.to_json(F.array(*g))).alias("wide"), F.when(wide, F.col(f"n{NEAR - 1}")).alias("wide_size"))
    rows = rows.where("s is not null or wide is not null")
    return rows.select("file_id", "tuple_no", F.col("s.file").alias("src_file"), F.col("s.place").alias("src_tuple"), "n_tuples", "wide", "wide_size")


def _wide(open_: DataFrame) -> DataFrame:
    """Windows NEAR as wide, of which longer repeats are repeats; a window of its own stands after each run of these."""
    ends = open_.select("file_id", (F.col("tuple_no") + 1).alias("tuple_no")).join(open_.select("file_id", "tuple_no"), ["file_id", "tuple_no"], "left_anti")
    ends = ends.select("file_id", "tuple_no", F.concat_ws(":", "file_id", "tuple_no").alias("window"), F.lit(None).cast("long").alias("size"))
    return open_.select("file_id", "tuple_no", F.col("wide").alias("window"), F.col("wide_size").cast("long").alias("size")).unionByName(ends)


def near_repeats(found: DataFrame, kept: DataFrame) -> DataFrame:
    """longest_repeats, where no window stands more than HEAVY times: only places that share NEAR windows are put in order."""
    near = staged(_near(found, kept), "near")
    own = near.where("src_file is not null").drop("wide", "wide_size")
    open_ = near.where("wide is not null")
    if open_.isEmpty():
        return own
    far = longest_repeats(_wide(open_), kept)
    far = staged(far.join(open_.select("file_id", "tuple_no", "wide_size"), ["file_id", "tuple_no"]).where("n_tuples > wide_size").drop("wide_size"), "far")
    settled = near.where("src_file is not null and wide is null").drop("wide", "wide_size")
    rest = open_.where("src_file is not null").drop("wide", "wide_size").join(far.select("file_id", "tuple_no"), ["file_id", "tuple_no"], "left_anti")
    return settled.unionByName(rest).unionByName(far)


#: Pairs of equal windows a place, on average, up to which they are joined; more only if asked for.
PAIRS = 0


def chosen_segments(found: DataFrame, kept: DataFrame, pairs: int = PAIRS, fresh: DataFrame | None = None) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, n_tuples): a greedy parse of each file of windows from left to right.

    At each place that no segment covers yet, the repeat of an earlier file of kept that reaches farthest is taken; of
    equals, that of the earliest file and place. Work grows with the places: short repeats are found where their first
    window lies, longer ones by the order of their places; where a window stands more than HEAVY times, all are. Up to
    `pairs` pairs of equal windows a place are joined instead; with less than 0 all places are put in order. The result is
    the same. With fresh (file_id), only these files are parsed; the others are there to be repeated.
    """
    found = staged(found, "windows")
    kept = staged(kept.select("file_id").distinct(), "sources")
    if pairs >= 0:
        marked = found.select("file_id", "window").join(kept.select("file_id", F.lit(1).alias("kept")), "file_id", "left")
        many = marked.groupBy("window").agg(F.count("*").alias("n"), F.count("kept").alias("sources"))
        work = many.agg(F.max("n").alias("most"), F.sum("n").alias("places"), F.sum(F.col("n").cast("double") * F.col("sources")).alias("pairs")).first()
        if (work.pairs or 0) <= pairs * (work.places or 0):
            return dedup.chosen_segments(dedup.segment_matches(dedup.window_hits(found, kept, fresh)))
        best = near_repeats(found, kept) if work.most <= HEAVY else longest_repeats(found, kept)
    else:
        best = longest_repeats(found, kept)
    return chosen_repeats(best if fresh is None else best.join(fresh.select("file_id"), "file_id", "left_semi"))


# ---------------------------------------------------------------- repeats that begin at a place


def _near_starts(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, n_windows, n_tuples, before, open, wide, wide_size): as _near, of repeats that
    do not begin earlier: the source's window before, if any, is another one than the place's.

    Of the places that share L windows, the earliest retained one (e) and the earliest with another window before it than
    that one has (o) are enough: one of them is the answer for L. open: so it is for all NEAR windows, and perhaps more.
    """
    g = [f"g{k}" for k in range(NEAR)]
    rows = _following(found, before=True).join(kept.select("file_id", F.lit(True).alias("kept")), "file_id", "left")
    rows = rows.repartition("g0").sortWithinPartitions(*g)
    rows = rows.withColumn("high", F.max("file_id").over(Window.partitionBy(*g)))
    place = F.struct(F.col("file_id").alias("file"), F.col("tuple_no").alias("place"), "before")
    for k in reversed(range(NEAR)):
        group = Window.partitionBy(*g[: k + 1])
        rows = rows.withColumn("e", F.min(F.when(F.col("kept"), place)).over(group))
        rows = rows.withColumn("o", F.min(F.when(F.col("kept") & F.coalesce(F.col("before") != F.col("e.before"), F.lit(True)), place)).over(group))
        taken = F.when(F.col("before") == F.col("e.before"), F.col("o")).otherwise(F.col("e"))
        here = F.coalesce(F.col(f"g{k}").isNotNull() & (taken["file"] < F.col("file_id")), F.lit(False))
        if k == NEAR - 1:
            wide = F.col(g[k]).isNotNull() & (F.col("e.file") < F.col("high"))
            rows = rows.withColumns({"wide": F.when(wide, F.to_json(F.array(*g))), "wide_size": F.when(wide, F.col(f"n{k}")), "open": here})
            rows = rows.withColumn("s", F.lit(None).cast("struct<file:bigint,place:bigint,n:int,tuples:bigint>"))
        found_here = F.struct(taken["file"].cast("long").alias("file"), taken["place"].cast("long").alias("place"), F.lit(k + 1).alias("n"), F.col(f"n{k}").cast("long").alias("tuples"))
        rows = rows.withColumn("s", F.coalesce("s", F.when(here, found_here))).drop("e", "o")
    rows = rows.where("s is not null or wide is not null")
    return rows.select(
        "file_id", "tuple_no", F.col("s.file").alias("src_file"), F.col("s.place").alias("src_tuple"), F.col("s.n").cast("long").alias("n_windows"),
        F.col("s.tuples").alias("n_tuples"), F.when(F.col("wide").isNotNull(), F.col("before")).alias("before"), "open", "wide", "wide_size",
    )


def _least_two(place: np.ndarray, before: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row k holds of each 2^k neighbours the least place, the window before it, and the least place with another before it."""
    rows = [(place, before, np.full(len(place), NOWHERE))]
    while 2 << len(rows) - 1 <= len(place):
        half = 1 << len(rows) - 1
        rows.append(_either(tuple(c[:-half] for c in rows[-1]), tuple(c[half:] for c in rows[-1])))
    return rows


def _either(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    swap = b[0] < a[0]
    (place, before, other), (place_b, before_b, other_b) = (tuple(np.where(swap, y, x) for x, y in zip(p, q)) for p, q in ((a, b), (b, a)))
    return place, before, np.minimum(other, np.where(before_b != before, place_b, other_b))


def _starts(cell: pd.DataFrame) -> pd.DataFrame:
    """How many windows the longest repeat that begins at each open place has, and the earliest place that it repeats.

    A cell holds whole groups of places that share a window; each place's length is found by halving.
    """
    cell = cell.sort_values("at")
    shared, own, place = (cell[c].to_numpy(np.int64) for c in ("shared", "own", "place"))
    n = len(cell)
    before = pd.factorize(cell["before"])[0].astype(np.int64)
    before = np.where(before < 0, -1 - np.arange(n), before)  # a file's first place is like no other
    shared[0] = 0
    ahead, mirrored, two = minima(shared), minima(shared[::-1].copy()), _least_two(place, before)
    asked = np.flatnonzero(cell["open"].to_numpy(bool))

    def earliest(at: np.ndarray, need: np.ndarray) -> np.ndarray:
        last = next_below(ahead, at + 1, need) - 1
        first = n - 1 - next_below(mirrored, n - 1 - at, need)
        power = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.full(len(at), NOWHERE)
        for k in np.unique(power):
            some = np.flatnonzero(power == k)
            both = _either(tuple(c[first[some]] for c in two[k]), tuple(c[last[some] + 1 - (1 << k)] for c in two[k]))
            out[some] = np.where(both[1] == before[at[some]], both[2], both[0])
        return np.where(out < own[at], out, NOWHERE)

    low, high = np.zeros(len(asked), np.int64), np.maximum(shared[asked], np.append(shared[1:], 0)[asked])
    while (low < high).any():
        middle = (low + high + 1) // 2
        right = (earliest(asked, np.maximum(middle, 1)) < NOWHERE) & (middle > 0)
        low, high = np.where(right, middle, low), np.where(right, high, middle - 1)
    some = low > 0
    asked, low = asked[some], low[some]
    return pd.DataFrame({"file_id": cell["file_id"].to_numpy()[asked], "tuple_no": cell["tuple_no"].to_numpy()[asked], "k": low, "earliest": earliest(asked, low)})


def _grouped(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of an order (at, shared, ...) with cell: whole groups of places that share a window with the one before them, of
    those groups in which a place is wanted (at). A cell is CELL places and what the last group goes beyond them."""
    rows = running_sums(rows.withColumn("first", (F.col("shared") == 0).cast("long")), "at", {"sum": F.col("first")})
    rows = staged(rows.withColumn("group", F.col("sum") + F.col("first")).drop("sum", "first"), "groups")
    groups = rows.join(wanted, "at", "left_semi").select("group").distinct().join(rows.groupBy("group").agg(F.min("at").alias("least")), "group")
    return rows.join(groups, "group").withColumn("cell", F.floor(F.col("least") / CELL)).drop("least")


def starting_repeats(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, tuple_no, src_file, src_tuple, n_windows, n_tuples): at every place, of the repeats of earlier files of kept
    that begin there, so that they do not go on before it, the one of most windows; of equals, that of the earliest file
    and place.

    This is dedup.best_segments(dedup.segment_matches(dedup.window_hits(...))), but nothing is paired, so work grows with
    the places. found: windows (file_id, tuple_no, window, size); kept: file_id.
    """
    near = staged(_near_starts(found, kept), "starts")
    names = ["file_id", "tuple_no", "src_file", "src_tuple", "n_windows", "n_tuples"]
    own = near.where("src_file is not null").select(*names)
    if near.where("open").isEmpty():
        return own
    open_ = near.where("wide is not null")
    sources = staged(numbered(kept.select("file_id").distinct(), "file_id", "no"), "sources")
    wide = staged(_wide(open_), "wide")
    # sources before a file, so that places of earlier files are less than this; a row a file
    files = open_.select("file_id", F.lit(0).alias("is")).unionByName(sources.select("file_id", F.lit(1).alias("is"))).groupBy("file_id").agg(F.max("is").alias("is"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_id", (F.coalesce(F.sum("is").over(earlier), F.lit(0)) * (1 << TUPLE_BITS)).alias("own"))
    rows = _placed(wide, sources).join(open_.select("file_id", "tuple_no", "before", "open"), ["file_id", "tuple_no"])
    rows = staged(rows.join(F.broadcast(files), "file_id").drop("source"), "places")
    rows = _grouped(rows, rows.where("open").select("at"))
    made = rows.groupBy("cell").applyInPandas(_starts, "file_id long, tuple_no long, k long, earliest long")
    made = made.withColumn("no", F.shiftright("earliest", TUPLE_BITS)).join(sources.select("no", F.col("file_id").alias("src_file")), "no")
    sizes = open_.select("file_id", F.col("tuple_no").alias("last"), "wide_size")
    made = made.withColumn("last", F.col("tuple_no") + F.col("k") - 1).join(sizes, ["file_id", "last"])
    far = staged(made.select(
        "file_id", "tuple_no", "src_file", F.col("earliest").bitwiseAND(F.lit((1 << TUPLE_BITS) - 1)).alias("src_tuple"),
        (F.col("k") + NEAR - 1).alias("n_windows"), (F.col("wide_size") + F.col("k") - 1).cast("long").alias("n_tuples"),
    ), "far")
    rest = own.join(far.select("file_id", "tuple_no"), ["file_id", "tuple_no"], "left_anti")
    return rest.unionByName(far)


# ---------------------------------------------------------------- totals of pairs of files


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, at, np.concatenate(sums))
    return [unique], [total]


class _PairSums:
    """Of groups of places, told one after another by their files, sums over pairs of files of the product of their places."""

    def __init__(self, files: int) -> None:
        self.files, self.open, self.keys, self.sums = files, None, [], []

    def add(self, group: np.ndarray, file: np.ndarray, goes_on: bool) -> None:
        """Places in the order of their groups (from 0); group 0 goes on from the last call's last group, if so told."""
        if not goes_on:
            self.close()
        if not len(group):
            return
        entries, n = np.unique(group * (2 * self.files) + file, return_counts=True)
        if self.open is not None:
            (entries,), (n,) = _summed([self.open[0], entries], [self.open[1], n])
        last = np.searchsorted(entries, int(group[-1]) * 2 * self.files)
        self._pairs(entries[:last], n[:last])
        self.open = entries[last:] % (2 * self.files), n[last:]

    def close(self) -> None:
        if self.open is not None:
            self._pairs(*self.open)
        self.open = None

    def _pairs(self, entries: np.ndarray, n: np.ndarray) -> None:
        # a file is told by its number twice, and one more if repeats may come from it
        group, file = entries // (2 * self.files), entries % (2 * self.files)
        begin = np.searchsorted(group, group)
        ends = np.cumsum(np.arange(len(group)) - begin)
        at = 0
        while at < len(group):  # the pairs of as many entries as make some million
            had = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, had + (1 << 20), "right")), at + 1)
            count = np.arange(at, to) - begin[at:to]
            a = np.repeat(np.arange(at, to), count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[at:to], count)
            kept = file[b] % 2 == 1
            a, b, at = a[kept], b[kept], to
            self.keys.append((file[a] // 2) * self.files + file[b] // 2)
            self.sums.append(n[a].astype(np.int64) * n[b])
            if sum(map(len, self.keys)) > 1 << 21:
                self.keys, self.sums = _summed(self.keys, self.sums)


def _near_pairs(files: int):
    """Sorted places (file, tuple_no, g0, g1, ...) become sums (level, key, n) of pairs of files that share the windows g0 to
    g<level>, and the places (level null, file, tuple_no, key) that share all of them with another, by a number of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, before, wide, group, held = [_PairSums(files) for _ in range(NEAR)], None, None, TaskContext.get().partitionId() << 33, None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, tuple_no = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
            new = np.zeros(batch.num_rows, bool)
            for k in range(NEAR):
                column = batch.column(2 + k)
                first = pa.array([before[k] if before else None], column.type)
                moved = pa.concat_arrays([first, column.slice(0, len(column) - 1)])
                new = new | pc.fill_null(pc.not_equal(column, moved), True).to_numpy(zero_copy_only=False)
                full = column.is_valid().to_numpy(zero_copy_only=False)
                # places without that many windows are none of a group's: each is new, and passed over
                number = np.cumsum(new)
                number = number[full]
                # the first place that counts goes on with the open group only if nothing new lies before it
                goes_on = not len(number) or number[0] == 0
                sums[k].add(number - (number[0] if len(number) else 0), file[full], goes_on)
            before = [batch.column(2 + k)[batch.num_rows - 1].as_py() for k in range(NEAR)]
            # of places that share all windows with the one before or after; the batch's last place waits for the next one
            number = group + np.cumsum(new)
            group = int(number[-1])
            if held is not None:
                file, tuple_no, number, new, full = (np.append(h, c) for h, c in zip(held, (file, tuple_no, number, new, full)))
            same = ~new & full
            shared = (same | np.append(same[1:], False)) & full
            held = tuple(c[-1:] for c in (file, tuple_no, number, new, full))
            yield _pair_batch(None, *(c[:-1][shared[:-1]] for c in (number, file, tuple_no)))
        if held is not None and (~held[3] & held[4])[0]:
            yield _pair_batch(None, held[2], held[0], held[1])
        for k in range(NEAR):
            sums[k].close()
            if sums[k].keys:
                (keys,), (n,) = _summed(sums[k].keys, sums[k].sums)
                yield _pair_batch(k, keys, np.zeros_like(keys), n)

    return run


def _pair_batch(level: int | None, key: np.ndarray, file: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([level] * len(key), pa.int32()), *(pa.array(c, pa.int64()) for c in (key, file, n))]
    return pa.RecordBatch.from_arrays(columns, names=["level", "key", "file", "n"])


def _lengths(cell: pd.DataFrame) -> pd.DataFrame:
    """The most windows that two files share at places of a cell: of a file's places, the last one in the order counts."""
    cell = cell.sort_values("at")
    since, most = {}, {}
    for file, shared, kept in zip(cell["file_id"].tolist(), cell["shared"].tolist(), (cell["source"] != NOWHERE).tolist()):
        if not shared:
            since.clear()
        for other, (least, source) in since.items():
            least = min(least, shared)
            since[other] = least, source
            if file != other and (kept if file < other else source):
                pair = (max(file, other), min(file, other))
                if least > most.get(pair, 0):
                    most[pair] = least
        since[file] = 1 << 62, kept
    return pd.DataFrame([(*pair, k) for pair, k in most.items()], columns=["file_id", "src_file", "k"]).astype("int64")


def pair_totals(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_id, src_file, segments, windows, longest) of files that share windows with earlier files of kept: runs of equal
    windows, equal windows, and the windows of the longest run.

    That is what dedup.segment_matches(dedup.window_hits(...)) gives by pair of files, but nothing is paired: windows are
    counted by file, and a run ends wherever two windows are equal and the next two are not.
    """
    sources = staged(numbered(kept.select("file_id").distinct(), "file_id", "no"), "sources")
    files = staged(numbered(found.select("file_id").distinct(), "file_id", "f").join(sources.select("file_id", F.lit(1).alias("kept")), "file_id", "left"), "files")
    names = [f"g{k}" for k in range(NEAR)]
    rows = _following(found).join(files.select("file_id", (F.col("f") * 2 + F.coalesce("kept", F.lit(0))).alias("file")), "file_id")
    rows = rows.select("file", "tuple_no", *names).repartition("g0").sortWithinPartitions(*names)
    count = files.count()
    made = staged(rows.mapInArrow(_near_pairs(count), "level int, key long, file long, n long"), "pairs")
    number = files.select(F.col("f"), "file_id")
    sums = made.where("level is not null").groupBy("level", "key").agg(F.sum("n").alias("n")).withColumns({"f": F.floor(F.col("key") / count), "g": F.col("key") % count})
    sums = sums.join(number, "f").join(number.select(F.col("f").alias("g"), F.col("file_id").alias("src_file")), "g").select("file_id", "src_file", F.col("level").cast("long").alias("level"), "n")
    wide = made.where("level is null").select(F.floor(F.col("file") / 2).alias("f"), F.col("n").alias("tuple_no"), F.col("key").cast("string").alias("wide"), F.lit(None).cast("long").alias("wide_size"))
    if not wide.isEmpty():
        wide = wide.join(number, "f").drop("f")
        order = staged(_placed(staged(_wide(wide), "wide"), sources), "places")
        far = _grouped(order, order.select("at")).select("cell", "at", "file_id", "shared", "source")
        far = far.groupBy("cell").applyInPandas(_lengths, "file_id long, src_file long, k long")
        sums = sums.unionByName(far.select("file_id", "src_file", (F.col("k") + NEAR - 2).alias("level"), F.lit(0).cast("long").alias("n")))
    windows = F.sum(F.when(F.col("level") == 0, F.col("n")).otherwise(0))
    segments = windows - F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0))
    return sums.groupBy("file_id", "src_file").agg(segments.alias("segments"), windows.alias("windows"), (F.max("level") + 1).alias("longest"))
