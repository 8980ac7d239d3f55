"""Bloom filters built by an aggregate and probed by a column expression.

A filter is some tables of 64-bit words. A key picks one word of each table and sets a few bits
of it, so a probe reads one word a table. The words of a filter are constants in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 64
BITS_A_KEY = 16
BITS_SET = 5
#: No table is longer than this, 4 MB; beyond it a filter lets more through.
MOST_WORDS = 1 << 19


def _place(key: Column, salt: int, table: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(table)), F.lit(words).cast("bigint"))


def _mask(key: Column, salt: int, table: int) -> Column:
    """A word with the key's bits set, six bits of a hash for each."""
    drawn = F.xxhash64(key, F.lit(salt), F.lit(-1 - table))
    one = F.lit(1).cast("bigint")
    places = [F.shiftrightunsigned(drawn, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(BITS_SET)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", one, place) for place in places])


@dataclass(frozen=True)
class Bloom:
    """Tables of words; ``salt`` tells the hashes of one filter from those of another."""

    tables: tuple[tuple[int, ...], ...]
    salt: int = 0

    def may_hold(self, key: Column) -> Column:
        """True for every key that was put in, and for few others; false for NULL."""
        found = []
        for number, words in enumerate(self.tables):
            # One string to parse and fold, where a literal for each word would make a plan of them.
            held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
            word = F.get(held, _place(key, self.salt, number, len(words)).cast("int"))
            mask = _mask(key, self.salt, number)
            found.append(word.bitwiseAND(mask) == mask)
        return key.isNotNull() & reduce(and_, found)

    @property
    def size_bytes(self) -> int:
        return 8 * sum(map(len, self.tables))


def words_for(keys: int, bits_a_key: int = BITS_A_KEY) -> int:
    return min(MOST_WORDS, max(1, -(-keys * bits_a_key // WORD_BITS)))


def build(keys: DataFrame, column: str, words: int, tables: int = 1, salt: int = 0) -> Bloom:
    """The filter of a column's values. Each task sends at most ``words`` rows a table to be put together."""
    if not 1 <= words <= MOST_WORDS:
        raise ValueError(f"a table has 1 to {MOST_WORDS} words, not {words}")
    key = F.col(column)
    drawn = [
        F.struct(
            F.lit(number).alias("t"),
            _place(key, salt, number, words).alias("w"),
            _mask(key, salt, number).alias("m"),
        )
        for number in range(tables)
    ]
    each = keys.where(key.isNotNull()).select(F.explode(F.array(*drawn)).alias("d"))
    found = [[0] * words for _ in range(tables)]
    for t, w, m in each.groupBy("d.t", "d.w").agg(F.bit_or("d.m").alias("m")).collect():
        found[t][w] = m
    return Bloom(tuple(map(tuple, found)), salt)
