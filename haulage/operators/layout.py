"""Rows laid out for lookups by several columns at once.

Files sorted by one column say little about another. Along a Z-order curve the bits of all columns' ranks take turns, so
every file holds a narrow range of each, and a lookup by any of them skips most files by their statistics alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import named
from haulage.operators.sketches import KLL_SIZE, number_of
from haulage.operators.skew import spread, task_count

# A column's values fall into 2 ^ RANK_BITS ranges of about as many rows each.
RANK_BITS = 8
TEXT_BYTES = 6


def position(field: T.StructField) -> Column:
    """A column as doubles that never decrease when it increases; NULL first. Text goes by its first six bytes."""
    number = number_of(field)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        digits = F.rpad(F.hex(F.substring(named(field.name).cast("binary"), 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
        number = F.conv(digits, 16, 10).cast("double")
    elif isinstance(field.dataType, T.BooleanType):
        number = named(field.name).cast("int").cast("double")
    elif number is None:
        raise TypeError(f"cannot lay out rows by {field.name}: {field.dataType.simpleString()}")
    largest = F.lit(1.0e300)
    return F.coalesce(F.greatest(F.least(F.nanvl(number, largest), largest), -largest), -largest)


def ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with ``_rank0``, ``_rank1``, …: which of 2 ^ RANK_BITS ranges each column's value is in.

    The ranges' bounds come from one sketch for each column, so what the driver gets does not grow with the rows.
    """
    fields = {field.name: field for field in df.schema.fields}
    placed = df.withColumns({f"_at{k}": position(fields[c]) for k, c in enumerate(columns)})
    fractions = F.array(*[F.lit(k / (1 << RANK_BITS)) for k in range(1, 1 << RANK_BITS)])
    sketches = placed.agg(*[F.kll_sketch_agg_double(f"_at{k}", F.lit(KLL_SIZE)).alias(f"s{k}") for k in range(len(columns))])
    some = F.kll_sketch_get_n_double("s0") > 0
    bounds = sketches.select(
        *[F.when(some, F.kll_sketch_get_quantile_double(f"s{k}", fractions)).alias(f"s{k}") for k in range(len(columns))]
    ).first()
    for k in range(len(columns)):
        splits = [-math.inf, *sorted(set(bounds[k] or [0.0])), math.inf]
        placed = Bucketizer(splits=splits, inputCol=f"_at{k}", outputCol=f"_slot{k}").transform(placed)
        # A frequent value takes several ranks' room and leaves few to the others; ranks keep their places.
        scaled = F.floor(F.col(f"_slot{k}") * ((1 << RANK_BITS) - 1) / (len(splits) - 2)).cast("bigint")
        placed = placed.withColumn(f"_rank{k}", scaled).drop(f"_slot{k}", f"_at{k}")
    return placed


def interleaved(ranks: Sequence[Column]) -> Column:
    """One number of all ranks' bits in turn, the highest of each first."""
    bits = [
        F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), bit * len(ranks) + len(ranks) - 1 - k)
        for bit in range(RANK_BITS)
        for k, rank in enumerate(ranks)
    ]
    total = bits[0]
    for one in bits[1:]:
        total = total.bitwiseOR(one)
    return total


def z_ordered(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows in `parts` partitions along the Z-order of the columns, sorted in each; to be written as they are.

    A scatter column ends the order, so copies of one row spread over partitions too.
    """
    if not 1 <= len(columns) <= 63 // RANK_BITS:
        raise ValueError(f"rows are laid out by 1 to {63 // RANK_BITS} columns")
    curve = interleaved([F.col(f"_rank{k}") for k in range(len(columns))])
    rows = ranked(df, columns).withColumns({"_curve": curve, "_scatter": spread(df)})
    dealt = rows.repartitionByRange(parts or task_count(df), "_curve", "_scatter")
    return dealt.sortWithinPartitions("_curve").select(*[named(c) for c in df.columns])
