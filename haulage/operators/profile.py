"""Counts, statistics, lookups and exact samples."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import named
from haulage.operators.conform import stack_up


# --- aggregates ---------------------------------------------------------------


def row_count(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("rows"))


def count_and_average(df: DataFrame, category: str, value: str, digits: int = 4) -> DataFrame:
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(value), digits).alias("average"),
    )


def count_and_sum(df: DataFrame, category: str, amount: str) -> DataFrame:
    """Rows and exact total per category; doubles are added up as decimals."""
    total = F.sum(F.col(amount).cast("decimal(15,2)")).cast("decimal(25,2)")
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("rows"), total.alias("total"))


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table. Parquet answers a bare count from its footers."""
    counts = [
        row_count(df).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()
    ]
    return stack_up(counts)


def children_per_parent(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Rows of both tables and how many children a parent has on average."""
    counts = table_stats({"parent": parent, "child": child})
    sizes = counts.agg(
        F.max(F.when(F.col("table_name") == "parent", F.col("rows"))).alias("parents"),
        F.max(F.when(F.col("table_name") == "child", F.col("rows"))).alias("children"),
    )
    average = F.col("children").cast("decimal(20,0)") / F.nullif("parents", F.lit(0))
    return sizes.withColumn("average", F.round(average, 1).cast("decimal(20,1)"))


def column_stats(df: DataFrame) -> DataFrame:
    """Rows, NULLs, smallest and largest value of every column, in one pass.

    Nested columns have no order; their extremes are NULL.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    facts = []
    for i, field in enumerate(df.schema.fields):
        value = named(field.name)
        measures.append(F.count(value).alias(f"n{i}"))
        ordered = isinstance(field.dataType, T.AtomicType)
        if ordered:
            measures += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
        facts.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.col("rows"),
                (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
                (F.col(f"lo{i}") if ordered else F.lit(None)).cast("string").alias("lowest"),
                (F.col(f"hi{i}") if ordered else F.lit(None)).cast("string").alias("highest"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*facts)))


def refresh_statistics(spark: SparkSession, *names: str) -> None:
    """Have the optimizer's statistics of catalog tables counted anew, column by column."""
    for name in names:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


# --- lookups ------------------------------------------------------------------


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; reaches the Parquet scan as a filter."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def in_period(df: DataFrame, column: str, first: str, before: str) -> DataFrame:
    """Rows from the first instant on and before the second."""
    kind = df.schema[column].dataType
    start, end = F.lit(first).cast(kind), F.lit(before).cast(kind)
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def json_holds(text: Column, wanted: Mapping[str, Any]) -> Column:
    """Whether JSON text contains an object: all its members, at any depth, with their values.

    A value matches one of its own kind only: 69 is not "69". Numbers compare as
    numbers, a list is contained if each of its elements is, in any order. A
    member that is not there matches nothing, and what is not JSON contains nothing.
    """
    return json_answers(text, {"holds": wanted})["holds"]


def json_answers(text: Column, questions: Mapping[str, Mapping[str, Any]]) -> Column:
    """A struct that says of each object whether JSON text contains it; the text is parsed once for all."""
    # A variable of a lambda is a value, where an expression used twice would be worked out twice.
    parsed = F.array(F.try_parse_json(text))
    return F.get(
        F.transform(parsed, lambda found: F.struct(*[variant_holds(found, w).alias(n) for n, w in questions.items()])), 0
    )


def variant_holds(found: Column, wanted: Mapping[str, Any]) -> Column:
    """Whether a VARIANT column, as JSON lands with ``json_as_variant``, contains an object; nothing is parsed."""
    return F.coalesce(_contains(found, wanted), F.lit(False))


def _contains(found: Column, wanted: Any) -> Column:
    """Whether a variant contains a value; NULL or false where it does not."""
    shown = F.to_json(found)
    if isinstance(wanted, Mapping):
        # What has a member by its name is an object.
        members = [
            F.coalesce(_contains(F.try_variant_get(found, _member(key), "variant"), inner), F.lit(False))
            for key, inner in wanted.items()
        ]
        return reduce(and_, members) if members else shown.startswith("{")
    if isinstance(wanted, (list, tuple)):
        elements = F.try_variant_get(found, "$", "array<variant>")
        held = [F.coalesce(F.exists(elements, _containing(inner)), F.lit(False)) for inner in wanted]
        return reduce(and_, held, shown.startswith("["))
    if wanted is None:
        return shown == F.lit("null")
    if isinstance(wanted, bool):
        return shown == F.lit("true" if wanted else "false")
    if isinstance(wanted, (int, float, Decimal)):
        number = F.lit(Decimal(str(wanted)))
        exact = F.when(shown.rlike("^-?[0-9]"), shown).try_cast("decimal(38,10)")
        return F.coalesce(exact == number, shown.try_cast("double") == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return shown.startswith('"') & (F.try_variant_get(found, "$", "string") == F.lit(wanted))
    raise TypeError(f"cannot look for {wanted!r} in JSON")


def _containing(wanted: Any) -> Callable[[Column], Column]:
    return lambda element: F.coalesce(_contains(element, wanted), F.lit(False))


def _member(key: str) -> str:
    for quote in "'\"":
        if quote not in key:
            return f"$[{quote}{key}{quote}]"
    raise ValueError(f"a key with both kinds of quotes cannot be looked for: {key!r}")


def with_parameters(
    df: DataFrame, key: str, names: Sequence[str], parameters: Mapping[str, Sequence], types: str
) -> DataFrame:
    """Add the parameters listed for each row's key.

    Every row stays. A NULL key has NULL parameters; a key that is not listed
    fails the job. The list is part of the program.
    """
    listed = df.sparkSession.createDataFrame(
        [(k, *values) for k, values in parameters.items()], f"_key string, {types}"
    )
    message = F.concat(F.lit(f"no parameters are listed for {key} "), named(key).cast("string"))
    known = F.when(
        named(key).isNotNull() & F.col("_key").isNull(), F.raise_error(message).cast("boolean")
    ).otherwise(F.lit(True))
    joined = df.join(listed, named(key) == F.col("_key"), "left").where(known)
    return joined.select(*[named(c) for c in df.columns], *names)


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)


# --- exact sample -------------------------------------------------------------


# Hexadecimal digits that one round of counting tells apart, and rows that are few enough to be put in order.
DIGITS = 3
FEW = 1 << 16


def kth_digest(hashed: DataFrame, k: Callable[[int], int]) -> Row | None:
    """The row of the k-th smallest (_hash, _key), k worked out from the number of rows; none where there are no rows.

    Rows are counted by the first digits of the hash, then, among those that share the digits of the k-th,
    by the next ones, until few are left to look at. A round sends back a count for each of 4,096 prefixes at most.
    """
    prefix, left, wanted = "", None, 0
    while left is None or (left > FEW and len(prefix) < 32):
        head = F.substring("_hash", 1, len(prefix) + DIGITS).alias("head")
        counts = hashed.where(F.col("_hash").startswith(prefix)).groupBy(head).count().orderBy("head").collect()
        if left is None:
            if not counts:
                return None
            wanted = k(sum(row["count"] for row in counts))
        for row in counts:
            if wanted <= row["count"]:
                break
            wanted -= row["count"]
        prefix, left = row["head"], row["count"]
    rest = hashed.where(F.col("_hash").startswith(prefix)).orderBy("_hash", "_key").limit(wanted).collect()
    return rest[-1]


def sample_keys(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Exactly ``max(1, floor(n * ratio))`` of n unique keys, the same ones every time.

    The keys with the smallest seeded hash are taken: the greatest of them is found by counting, and a filter takes all up to
    it. No key is shuffled or sorted for it but a few around that one. A table without rows gives none.
    """
    digest = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), named(key).cast("string"))), F.lit(""))
    hashed = df.select(named(key).alias("_key"), digest.alias("_hash"))
    last = kth_digest(hashed, lambda n: max(1, int(n * ratio)))
    if last is None:
        return df.select(key)
    until = (F.col("_hash") < last["_hash"]) | (
        (F.col("_hash") == last["_hash"]) & (F.col("_key").isNull() | (F.col("_key") <= F.lit(last["_key"])))
    )
    return hashed.where(until).select(F.col("_key").alias(key))
