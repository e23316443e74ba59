"""Expressions over residues, records and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue code order, reference symbol classes, thresholds.
CODES = "ACGTacgtNn"
SYMBOL_N_RUN, SYMBOL_LOWER_N_RUN, SYMBOL_ESCAPE, SYMBOL_END = 1000, 1001, 1002, 1003
MIN_MATCH, MIN_AFTER, MAX_SEED_N = 15, 4, 3


def residues(body: Column) -> Column:
    """Bytes from 'A' on; white space, digits, gaps and stops are dropped."""
    return F.regexp_replace(body, r"[\x00-\x40]+", "")


def letters(text: Column) -> Column:
    """The upper-case ASCII letters that stand for a document's sequence."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def residue_code(ch: Column) -> Column:
    """0 to 9 in the order of CODES, else -1."""
    return F.instr(F.lit(CODES), ch) - 1


def trigram_code(tri: Column) -> Column:
    """a * 100 + b * 10 + c of the residue codes; the escape symbol if any has none or the trigram is short."""
    a, b, c = (F.instr(F.lit(CODES), F.substring(tri, k, 1)) - 1 for k in (1, 2, 3))
    valid = (F.length(tri) == 3) & (a >= 0) & (b >= 0) & (c >= 0)
    return F.when(valid, a * 100 + b * 10 + c).otherwise(SYMBOL_ESCAPE)


def symbols(sequence: Column, least: int = MIN_MATCH) -> Column:
    """The symbols of a coded reference: runs of N or of n of at least that length, else up to three residues; last, the end."""
    cut = F.regexp_extract_all(sequence, F.lit(f"(N{{{least},}}|n{{{least},}}|.{{1,3}})"), F.lit(1))
    return F.concat(cut, F.array(F.lit("")))


def symbol_code(symbol: Column, least: int = MIN_MATCH) -> Column:
    """Class of a symbol: a trigram's code, a run of N, a run of n, the end, or an escape."""
    run = lambda c: F.rlike(symbol, F.lit(f"^{c}{{{least},}}$"))
    return F.when(symbol == "", SYMBOL_END).when(run("N"), SYMBOL_N_RUN).when(run("n"), SYMBOL_LOWER_N_RUN).otherwise(trigram_code(symbol))


def n_count(kmer: Column) -> Column:
    return F.length(kmer) - F.length(F.translate(kmer, "Nn", ""))


def wrapped(sequence: Column, width: Column | int) -> Column:
    """Lines of width residues, joined by line feeds; no feed at the end."""
    width = F.lit(width) if isinstance(width, int) else width
    lines = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(sequence), F.lit(1)), width), lambda at: F.substring(sequence, at, width)
    )
    return F.array_join(lines, "\n")
