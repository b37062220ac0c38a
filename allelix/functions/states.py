"""States, symbols and storage blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BLOCK, GAP, SYMBOLS


def to_state(symbol: Column) -> Column:
    """a, t, c, g in either case to 0..3; every other symbol is the gap state."""
    at = F.when(symbol == "", 0).otherwise(F.position(F.lower(symbol), F.lit(SYMBOLS[:4])))
    return F.when(at > 0, at - 1).otherwise(GAP).cast("int")


def to_symbol(state: Column) -> Column:
    return F.substring(F.lit(SYMBOLS), F.when(state.between(0, 3), state).otherwise(GAP) + 1, F.lit(1))


def normal_sequence(text: Column) -> Column:
    """A whole sequence in normal symbols: lower case, and a gap for each character that is no state."""
    return F.regexp_replace(F.lower(text), "(?s)[^atcg]", "-")


def merge_states(left: Column, right: Column) -> Column:
    """The left state, or the right one where the left is a gap."""
    return F.when(left == GAP, right).otherwise(left)


def block_of(locus: Column) -> Column:
    return F.shiftright(locus, 5)


def place_in_block(locus: Column) -> Column:
    return locus.bitwiseAND(F.lit(BLOCK - 1))


def first_of_block(block: Column) -> Column:
    return block * BLOCK


def n_blocks(n_loci: Column) -> Column:
    return F.floor((n_loci + BLOCK - 1) / BLOCK).cast("int")


def last_block_size(n_loci: Column) -> Column:
    return F.pmod(n_loci - 1, F.lit(BLOCK)) + 1


def size_string(n_loci: Column, n_samples: Column) -> Column:
    return F.concat(F.lit("L"), n_loci.cast("string"), F.lit("n"), n_samples.cast("string"))
