"""Constraint checks over whole tables.

A rule is a name and a Column that says what holds. As in SQL, a check passes
where its predicate is TRUE or NULL; only FALSE breaks it. Row rules are all
evaluated in one pass over the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named condition on a row."""

    name: str
    holds: Column

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(True))


# --- conditions ---------------------------------------------------------------


def in_set(value: Column, allowed: Sequence) -> Column:
    return value.isin(list(allowed))


def in_range(value: Column, lowest, highest) -> Column:
    return value.between(lowest, highest)


def positive(value: Column) -> Column:
    return value > 0


def not_negative(value: Column) -> Column:
    return value >= 0


def present(value: Column) -> Column:
    return value.isNotNull()


def text_length(value: Column, shortest: int | None = None, longest: int | None = None) -> Column:
    holds = F.lit(True)
    if shortest is not None:
        holds = holds & (F.length(value) >= shortest)
    if longest is not None:
        holds = holds & (F.length(value) <= longest)
    return holds


def has_text(value: Column, part: str) -> Column:
    return F.contains(value, F.lit(part))


def occurrences(value: Column, character: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(character), F.lit("")))


def implies(premise: Column, conclusion: Column) -> Column:
    return ~premise | conclusion


def exactly_when(left: Column, right: Column) -> Column:
    """Both hold or neither does."""
    return left == right


def within_days(value: Column, as_of: Column, days: int) -> Column:
    """Not after the given day, and at most so many days before it."""
    return F.datediff(as_of, value).between(0, days)


def age_in_years(born: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, born) / 12)


# --- row rules ----------------------------------------------------------------


def judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``accepted`` and the names of the rules each row breaks, in the order given.

    Only rows that break some rule build the list of names.
    """
    any_broken = reduce(or_, [rule.broken for rule in rules], F.lit(False))
    names = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
    none = F.array().cast("array<string>")
    return df.withColumns(
        {"accepted": ~any_broken, "broken_rules": F.when(any_broken, names).otherwise(none)}
    )


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the rules they break."""
    checked = judged(df, rules)
    accepted = checked.where(F.col("accepted")).select(*df.columns)
    return accepted, checked.where(~F.col("accepted")).drop("accepted")


def summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rows checked and rows breaking it.

    All rules are counted by one aggregate, so the table is read once and only
    one row per task is shuffled.
    """
    counts = [F.count(F.lit(1)).alias("rows_checked")]
    counts += [F.count_if(rule.broken).alias(f"r{i}") for i, rule in enumerate(rules)]
    facts = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.col("rows_checked"),
            F.col(f"r{i}").alias("violations"),
        )
        for i, rule in enumerate(rules)
    ]
    return df.agg(*counts).select(F.inline(F.array(*facts)))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NOT NULL as a report: rows checked and NULLs found per column."""
    return summary(df, [Rule(column, present(F.col(column))) for column in columns])


# --- table rules --------------------------------------------------------------


def digested(df: DataFrame, text: str) -> DataFrame:
    """The SHA-256 digest of a long text in its place, to compare and shuffle instead of it."""
    return df.select(F.sha2(F.col(text).cast("binary"), 256).alias(text))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with how often.

    As with a UNIQUE constraint, a key with a NULL in it equals no other. Counts
    combine before the shuffle, so a value repeated without end is one row per
    task by then.
    """
    whole = df.select(*keys).where(reduce(and_, [F.col(key).isNotNull() for key in keys]))
    counts = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.where(F.col("occurrences") > 1)


def unique_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated key values, and the rows a UNIQUE constraint would have turned away."""
    extra = F.sum(F.col("occurrences") - 1)
    return repeated_keys(df, keys).agg(
        F.count(F.lit(1)).alias("repeated_keys"),
        F.coalesce(extra, F.lit(0)).alias("surplus_rows"),
    )
