"""Nearest smaller values and least values of spans of a long array, block by block.

An array is a table (index, value) with index from 0 and no gaps. What a block of it does not hold is looked up in the
minima of blocks, which are an array of the same kind, so no task sees more than a block and its questions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import staged

#: Places of an array in a block.
BLOCK = 4096


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Row k holds the least of each 2^k neighbouring values."""
    rows = [values]
    while 2 << len(rows) - 1 <= len(values):
        half = 1 << len(rows) - 1
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    return rows


def next_below(rows: list[np.ndarray], start: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The first place from each start on with a value less than `below`; the number of values if there is none."""
    n, at = len(rows[0]), start.astype(np.int64)
    for k in reversed(range(len(rows))):
        skip = at + (1 << k) <= n
        skip[skip] = rows[k][at[skip]] >= below[skip]
        at += skip.astype(np.int64) << k
    return at


def least_of(rows: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value from each first place to its last one."""
    power = np.frexp((last - first + 1).astype(float))[1] - 1
    least = np.zeros(len(first), rows[0].dtype)
    for k in np.unique(power):
        some = power == k
        least[some] = np.minimum(rows[k][first[some]], rows[k][last[some] + 1 - (1 << k)])
    return least


def _below(array: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(asked):
        return asked.assign(found=pd.Series([], dtype="Int64"))[["start", "below", "found"]]
    if not len(array):
        return pd.DataFrame({"start": asked["start"], "below": asked["below"], "found": pd.array([pd.NA] * len(asked), "Int64")})
    array = array.sort_values("index")
    values, first = array["value"].to_numpy(np.int64), int(array["index"].iloc[0])
    at = next_below(minima(values), asked["start"].to_numpy(np.int64) - first, asked["below"].to_numpy(np.int64))
    found = pd.array(at + first, "Int64")
    found[at >= len(values)] = pd.NA
    return pd.DataFrame({"start": asked["start"], "below": asked["below"], "found": found})


def _least(array: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(asked):
        return asked.assign(least=pd.Series([], dtype="int64"))[["first", "last", "least"]]
    array = array.sort_values("index")
    rows, start = minima(array["value"].to_numpy(np.int64)), int(array["index"].iloc[0])
    least = least_of(rows, asked["a"].to_numpy(np.int64) - start, asked["b"].to_numpy(np.int64) - start)
    return pd.DataFrame({"first": asked["first"], "last": asked["last"], "least": least})


def _cell(index: Column) -> Column:
    return F.floor(index / BLOCK).cast("long")


def _in_blocks(array: DataFrame, asked: DataFrame, place: str, function, kinds: str) -> DataFrame:
    cells = array.select("index", "value", _cell(F.col("index")).alias("cell")).groupBy("cell")
    return cells.cogroup(asked.withColumn("cell", _cell(F.col(place))).groupBy("cell")).applyInPandas(function, kinds)


def first_below(array: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(start, below, found) for asked (start, below), all distinct: the first place from start on with a value less than below.

    array: index from 0 to size - 1 and value. Where there is no such place there is no row.
    """
    kinds = "start long, below long, found long"
    near = _in_blocks(array, asked, "start", _below, kinds)
    if size <= BLOCK:
        return near.where("found is not null")
    near = staged(near, "nearest")
    blocks = array.groupBy(_cell(F.col("index")).alias("index")).agg(F.min("value").alias("value"))
    open_ = near.where("found is null").select("start", "below", (_cell(F.col("start")) + 1).alias("then"))
    open_ = open_.where(F.col("then") * BLOCK < size)
    over = first_below(blocks, open_.select(F.col("then").alias("start"), "below").distinct(), -(-size // BLOCK))
    over = staged(over.select(F.col("start").alias("then"), "below", (F.col("found") * BLOCK).alias("at")), "nearest")
    inside = _in_blocks(array, over.select(F.col("at").alias("start"), "below").distinct(), "start", _below, kinds)
    far = open_.join(over, ["then", "below"]).join(inside.select(F.col("start").alias("at"), "below", "found"), ["at", "below"])
    return near.where("found is not null").unionByName(far.select("start", "below", "found"))


def least_between(array: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(first, last, least) for asked (first, last), all distinct: the least value from place first to place last."""
    one = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    first, last = F.col("first"), F.col("last")
    ends = F.array(one(first, (_cell(first) + 1) * BLOCK - 1), one(_cell(last) * BLOCK, last))
    parts = asked.select("first", "last", F.explode(F.when(_cell(first) == _cell(last), F.array(one(first, last))).otherwise(ends)).alias("p"))
    found = _in_blocks(array, parts.select("first", "last", "p.a", "p.b"), "a", _least, "first long, last long, least long")
    if size > BLOCK:
        blocks = array.groupBy(_cell(F.col("index")).alias("index")).agg(F.min("value").alias("value"))
        long = asked.select("first", "last", (_cell(first) + 1).alias("from"), (_cell(last) - 1).alias("to")).where(F.col("from") <= F.col("to"))
        over = least_between(blocks, long.select(F.col("from").alias("first"), F.col("to").alias("last")).distinct(), -(-size // BLOCK))
        over = over.select(F.col("first").alias("from"), F.col("last").alias("to"), "least")
        found = found.unionByName(long.join(over, ["from", "to"]).select("first", "last", "least"))
    return found.groupBy("first", "last").agg(F.min("least").alias("least"))
