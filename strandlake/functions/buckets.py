"""Bucket and context expressions of the tuple codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket limits of lengths and positions.
LENGTH_LIMITS = (256, 65_792)
SEGMENT_LIMITS = (16, 48, 176, 432)
NEAR, TUPLE_NEAR, TUPLE_FAR = 63, 16, 256
MATCH_BYTES, LITERAL_BYTES, MIN_SEGMENT_BYTES = 7, 1, 11


def _limit_bucket(value: Column, limits: tuple[int, ...]) -> Column:
    out = F.lit(len(limits))
    for k in reversed(range(len(limits))):
        out = F.when(value < limits[k], k).otherwise(out)
    return out


def length_bucket(length: Column) -> Column:
    return _limit_bucket(length, LENGTH_LIMITS)


def segment_bucket(length: Column) -> Column:
    return _limit_bucket(length, SEGMENT_LIMITS)


def position_bucket(delta: Column, pseudo: Column) -> Column:
    """0: as expected; 1: within NEAR, or a run of N; 2: elsewhere."""
    return F.when(delta == 0, 0).when((F.abs(delta) <= NEAR) | pseudo, 1).otherwise(2)


def tuple_bucket(delta: Column) -> Column:
    """0: as expected; then three classes of distance for either sign."""
    size = F.when(F.abs(delta) < TUPLE_NEAR, 1).when(F.abs(delta) < TUPLE_FAR, 2).otherwise(3)
    return F.when(delta == 0, 0).when(delta > 0, size).otherwise(size + 3)


def literal_context(ch: Column) -> Column:
    """a, c, g, t in either case are 1 to 4, all else 0."""
    return F.instr(F.lit("acgt"), F.lower(ch)).cast("int")


def tuple_bytes(kind: Column) -> Column:
    return F.when(kind == "LIT", LITERAL_BYTES).otherwise(MATCH_BYTES)


def flag_context(previous: Column, flag: Column) -> Column:
    """Context of a flag from the two before it: the older one modulo 3 and the newer."""
    return (previous % 3) * 3 + flag


# ------------------------------------------------------------------ packed tuples

# Largest position and length that a packed match holds, positions that stand for runs of N and n.
MAX_POSITION, MAX_LENGTH = (1 << 31) - 3, (1 << 24) - 1
N_RUN_POSITION, LOWER_N_RUN_POSITION = 0x7FFFFFFF, 0x7FFFFFFE


def packed(kind: Column, ref_pos: Column, length: Column, literal: Column) -> Column:
    """A tuple as bytes: a literal is its letter with the top bit set, others 4 bytes of position and 3 of length."""
    position = F.when(kind == "N_RUN", N_RUN_POSITION).when(kind == "n_RUN", LOWER_N_RUN_POSITION).otherwise(ref_pos)
    match = F.unhex(F.concat(F.lpad(F.hex(position.cast("long")), 8, "0"), F.lpad(F.hex(length.cast("long")), 6, "0")))
    return F.when(kind == "LIT", F.unhex(F.hex((F.ascii(literal).bitwiseOR(F.lit(128))).cast("long")))).otherwise(match)


def unpacked(raw: Column) -> Column:
    """struct<kind, ref_pos, len, lit> of one packed tuple."""
    digits = F.hex(raw)
    number = lambda a, n: F.conv(F.substring(digits, a, n), 16, 10).cast("long")
    position = number(1, 8)
    single = F.length(raw) == 1
    kind = (
        F.when(single, "LIT").when(position == N_RUN_POSITION, "N_RUN").when(position == LOWER_N_RUN_POSITION, "n_RUN").otherwise("MATCH")
    )
    return F.struct(
        kind.alias("kind"), F.when(kind == "MATCH", position).alias("ref_pos"), F.when(single, F.lit(1).cast("long")).otherwise(number(9, 6)).alias("len"),
        F.when(single, F.char(number(1, 2).bitwiseAND(F.lit(127)))).alias("lit"),
    )


def checked_position(ref_pos: Column) -> Column:
    """ref_pos, or an error if it is beyond what a packed match holds."""
    wrong = F.raise_error(F.concat(F.lit("position out of range: "), ref_pos.cast("string"))).cast("long")
    return F.when(ref_pos > MAX_POSITION, wrong).otherwise(ref_pos)
