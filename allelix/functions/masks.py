"""Masks over loci, packed 64 to a word: a column array<long> whose word k has the loci 64 k to 64 k + 63, lowest bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def count(mask: Column) -> Column:
    """How many bits are set."""
    return F.aggregate(mask, F.lit(0), lambda n, w: n + F.bit_count(w))


def is_set(mask: Column, k: Column) -> Column:
    """Whether bit k is set; false beyond the mask."""
    word = F.get(mask, F.floor(k / WORD).cast("int"))
    return F.coalesce(F.call_function("shiftright", word, F.pmod(k, F.lit(WORD)).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def rank(mask: Column, k: Column) -> Column:
    """How many bits before bit k are set."""
    whole = F.floor(k / WORD).cast("int")
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.pmod(k, F.lit(WORD)).cast("int")))
    return (count(F.slice(mask, F.lit(1), whole)) + F.coalesce(F.bit_count(F.get(mask, whole).bitwiseAND(below)), F.lit(0))).cast("int")


def select(mask: Column, n: Column) -> Column:
    """The place of the set bit that n others stand before; null where there are not so many."""
    start = F.struct(n.cast("int").alias("left"), F.lit(0).alias("base"), F.lit(None).cast("long").alias("word"), F.lit(None).cast("int").alias("at"))

    def by_word(a: Column, w: Column) -> Column:
        here = a["word"].isNull() & (a["left"] < F.bit_count(w))
        gone = a["word"].isNotNull() | here
        return F.struct(F.when(gone, a["left"]).otherwise(a["left"] - F.bit_count(w)).cast("int").alias("left"), F.when(gone, a["base"]).otherwise(a["base"] + WORD).alias("base"), F.when(here, w).otherwise(a["word"]).alias("word"), a["at"].alias("at"))

    def by_bit(a: Column, k: Column) -> Column:
        set_ = F.call_function("shiftright", a["word"], k).bitwiseAND(1) == 1
        return F.struct(F.when(set_, a["left"] - 1).otherwise(a["left"]).cast("int").alias("left"), a["base"].alias("base"), a["word"].alias("word"), F.when(set_ & (a["left"] == 0), k).otherwise(a["at"]).cast("int").alias("at"))

    found = F.aggregate(mask, start, by_word)
    return F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), found, by_bit, lambda a: F.when(n >= 0, a["base"] + a["at"]).cast("int"))


def ones(mask: Column) -> Column:
    """The places of all set bits, in order."""
    each = F.transform(mask, lambda w, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftright", w, b).bitwiseAND(1) == 1), lambda b: (k * WORD + b).cast("int")))
    return F.flatten(each)
