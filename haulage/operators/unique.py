"""UNIQUE constraints on rows that arrive: one row of each key stays, the others and those already there are refused.

The arriving rows are written once, each with a number of its own, so that all that is asked of them later agrees. A
key's winner is found by an aggregate, which combines in each task before the shuffle, and is marked by a join on
its number: however many rows share a key, none of them meet in one task. Stored keys are held against the winners
alone, and whole rows are shuffled once a constraint, to be marked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.types import named
from haulage.operators import bloom
from haulage.operators.skew import row_hash
from haulage.session import landed

ROW = "_arrived"
# A filter of fewer bits a key lets most of the stored keys through.
LEAST_BITS = 4


def arrived(df: DataFrame) -> DataFrame:
    """The rows, written once, with a number that tells each from all others."""
    return landed(df.withColumn(ROW, F.monotonically_increasing_id()))


def has_key(keys: Sequence[str]) -> Column:
    """A key with a NULL in it equals no other."""
    return reduce(and_, [named(key).isNotNull() for key in keys])


def least_of_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each key, with the number of the arrived row that stays: the one with the least hash of all columns,
    and of equal rows the one that came first."""
    order = F.struct(row_hash(rows.drop(ROW)), F.col(ROW))
    least = rows.where(has_key(keys)).groupBy(*map(named, keys)).agg(F.min(order).alias("_least"))
    return least.withColumn("_first", F.col("_least")[ROW]).drop("_least")


def winners(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Arrived rows that stay and that go: one of those that share a key stays."""
    first = least_of_each(rows, keys).select("_first")
    is_first = F.col(ROW) == F.col("_first")
    stay = rows.join(first, is_first, "left_semi").unionByName(rows.where(~has_key(keys)))
    return stay, rows.where(has_key(keys)).join(first, is_first, "left_anti")


def possible(stored: DataFrame, rows: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """The distinct keys of a stored table that may be among the rows'.

    A Bloom filter of the rows' keys, sized by their count, is probed as the stored table is scanned, and only what it lets
    through is shuffled. Of more rows than a filter of bounded size can tell apart, none is made.
    """
    names = [f"_stored{i}" for i in range(len(keys))]
    there = stored.where(has_key(keys)).select(*[named(k).alias(n) for k, n in zip(keys, names)])
    words = bloom.words_for(count)
    if count * LEAST_BITS <= words * bloom.WORD_BITS:
        key = rows.where(has_key(keys)).select(F.struct(*map(named, keys)).alias("key"))
        held = bloom.build(key, "key", words)
        # As the rows have them, where they can: a value that their type cannot hold is none of theirs.
        alike = [F.col(n).try_cast(rows.schema[k].dataType) for k, n in zip(keys, names)]
        there = there.where(held.may_hold(F.struct(*alike)))
    return there.distinct()


def is_stored(keys: Sequence[str]) -> Column:
    """A row's key is that of a row of `possible`."""
    return reduce(and_, [named(k) == F.col(f"_stored{i}") for i, k in enumerate(keys)])


def against_stored(
    rows: DataFrame, stored: DataFrame, keys: Sequence[str], count: int
) -> tuple[DataFrame, DataFrame]:
    """Arrived rows whose key is new, and those whose key the stored table has."""
    taken, same = possible(stored, rows, keys, count), is_stored(keys)
    return rows.join(taken, same, "left_anti"), rows.join(taken, same, "left_semi")


def settled(
    rows: DataFrame, stored: DataFrame | None, keys: Sequence[str], count: int
) -> tuple[DataFrame, DataFrame]:
    """Arrived rows that stay, and the others: those whose key the stored table has, and all but one of those that share
    a key. They are marked and written once, for both of their readers."""
    first = least_of_each(rows, keys)
    if stored is not None:
        first = first.join(possible(stored, rows, keys, count), is_stored(keys), "left_anti")
    # One number a key: from the size of packed files Spark would take millions of them for a small table to broadcast.
    marked = rows.join(first.select("_first").hint("merge"), F.col(ROW) == F.col("_first"), "left")
    marked = landed(marked.withColumn("_stays", F.col("_first").isNotNull() | ~has_key(keys)).drop("_first"))
    return marked.where("_stays").drop("_stays"), marked.where("not _stays").drop("_stays")
