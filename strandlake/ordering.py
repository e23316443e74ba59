"""Global order without one sorting task: row numbers and running sums over ranges and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import staged

#: Rows whose running sums are made in one group.
BLOCK = 1 << 16


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def numbered(rows: DataFrame, key: str | list[str], number: str = "ord", then: tuple[str, ...] = ()) -> DataFrame:
    """rows with a number from 0 in the order of key (nulls first), then of further columns, without sorting them in one task.

    Rows are dealt into ranges of all these columns and of their place in the input, so equal keys split too. The ranges
    are written with each row's range and rank, which a later reading of the table cannot change, and ranks are shifted
    by the sizes of the ranges before. Rows equal in all columns named get any order. There are as many ranges as
    shuffle partitions, and no literal grows with them.
    """
    by = [*([key] if isinstance(key, str) else key), *then]
    place, at, shift, first = (free_name(n, [*rows.columns, number]) for n in ("input_place", "range_place", "shift", "range_first"))
    dealt = rows.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*by, place).sortWithinPartitions(*by, place)
    ranked = staged(dealt.drop(place).withColumn(at, F.monotonically_increasing_id()), "ranges")
    part, rank = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranked.groupBy(part.alias(shift)).agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy(shift).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(shift, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))  # a row a range
    joined = ranked.withColumn(shift, part).join(F.broadcast(shifts), shift)
    return joined.select(*rows.columns, (F.col(first) + rank).alias(number))


def running_sums(rows: DataFrame, index: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows with, under each name in sums, the total of its expression over rows of a smaller index (0 for the first).

    index numbers the rows from 0 without gaps, so each block of them is of a known size; blocks' totals are carried on.
    """
    names, cell = list(sums), free_name("cell", [*rows.columns, *sums])
    sized = rows.withColumns({**sums, cell: F.floor(F.col(index) / block)})
    totals = sized.groupBy(cell).agg(*(F.sum(n).alias(n) for n in names))
    before = Window.partitionBy(F.lit(0)).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = totals.select(cell, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}__before") for n in names))
    inside = Window.partitionBy(cell).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})
    joined = local.join(carried, cell)
    return joined.select(*(c for c in rows.columns if c not in sums), *((F.col(n) + F.col(f"{n}__before")).alias(n) for n in names))
