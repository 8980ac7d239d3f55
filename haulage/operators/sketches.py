"""Column statistics that merge: distinct values, quantiles and frequent values as sketches, kept load by load.

A load is summed up in one pass, a row for each column. The rows of several loads merge into those of all of them
without reading the loads again. Sketches have a bounded size, whatever the column holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import named, wall_clock_micros

# Standard error of the distinct count 1.04 / sqrt(2 ^ HLL_BITS), 0.8 %; ranks of quantiles are off by
# less than 0.7 % of the rows in 99 of 100 columns (k of 400).
HLL_BITS = 14
KLL_SIZE = 400
# Values followed in a column; one of fewer rows than 2 / TRACKED of them may be missed.
TRACKED = 10_000


def number_of(field: T.StructField) -> Column | None:
    """A column as doubles in its own order, where it has one that doubles can follow."""
    value, kind = named(field.name), field.dataType
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return wall_clock_micros(value).cast("double")
    return None


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each column that is not nested: its rows and NULLs, and sketches of its values as text and as numbers.

    Dates count in days, timestamps in microseconds. Text and booleans have no quantiles.
    """
    wanted = set(df.columns if columns is None else columns)
    measures, facts = [F.count(F.lit(1)).alias("rows")], []
    for i, field in enumerate(df.schema.fields):
        if field.name not in wanted or not isinstance(field.dataType, T.AtomicType):
            continue
        text, number = named(field.name).cast("string"), number_of(field)
        empty = F.lit(None).cast("double") if number is None else F.when(~F.isnan(number), number)
        measures += [
            F.count(named(field.name)).alias(f"n{i}"),
            F.hll_sketch_agg(text, HLL_BITS).alias(f"d{i}"),
            F.kll_sketch_agg_double(empty, F.lit(KLL_SIZE)).alias(f"q{i}"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias(f"f{i}"),
        ]
        facts.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.col("rows"),
                (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
                F.col(f"d{i}").alias("distinct"),
                F.col(f"q{i}").alias("quantiles"),
                F.col(f"f{i}").alias("frequent"),
            )
        )
    if not facts:
        raise ValueError("there is no column that can be sketched")
    return df.agg(*measures).select(F.inline(F.array(*facts)))


def merge_sketches(*loads: DataFrame) -> DataFrame:
    """The statistics of all loads together, from those of each."""
    every = reduce(DataFrame.unionByName, loads)
    return every.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", F.lit(KLL_SIZE)).alias("quantiles"),
        F.call_function("approx_top_k_combine", "frequent", F.lit(TRACKED)).alias("frequent"),
    )


def estimates(sketches: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75), common: int = 5) -> DataFrame:
    """What the sketches say: distinct values, the values at these fractions of the rows, and the most frequent values.

    A column without numbers has NULL for quantiles.
    """
    some = F.kll_sketch_get_n_double("quantiles") > 0
    at = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(float(f)) for f in fractions]))
    return sketches.select(
        "column_name",
        "rows",
        "nulls",
        F.hll_sketch_estimate("distinct").alias("distinct_values"),
        F.when(some, at).alias("quantiles"),
        F.call_function("approx_top_k_estimate", "frequent", F.lit(common)).alias("common_values"),
    )
