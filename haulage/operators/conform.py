"""Shape a source DataFrame into the target table's columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import (
    SourceColumn,
    ValueRules,
    is_mapped,
    land,
    landing_type,
    named,
    required,
    safe_cast,
)


def require_same_columns(found: Sequence[str], wanted: Sequence[str]) -> None:
    missing = [name for name in wanted if name not in found]
    extra = [name for name in found if name not in wanted]
    if missing or extra or len(found) != len(wanted):
        raise ValueError(f"columns do not match: missing {missing}, unexpected {extra}")


def conform(
    df: DataFrame, columns: Sequence[SourceColumn], rules: ValueRules = ValueRules()
) -> DataFrame:
    """Map types, render unmapped ones as text and guard required columns.

    One projection over the scan: no shuffle, and a query that reads a few
    columns of the result still reads only those from the source.
    """
    require_same_columns(df.columns, [c.name for c in columns])
    types = {field.name: field.dataType for field in df.schema.fields}
    return df.select([land(named(c.name), c, types[c.name], rules) for c in columns])


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a DataFrame to an existing schema: its order, its widths, its NOT NULLs.

    A column too many or too few is an error, never a silent drop or fill.
    """
    require_same_columns(df.columns, schema.names)
    types = {field.name: field.dataType for field in df.schema.fields}
    aligned = []
    for field in schema.fields:
        value = safe_cast(named(field.name), field.name, types[field.name], field.dataType)
        if not field.nullable:
            value = required(value, field.name, field.dataType)
        aligned.append(value.alias(field.name))
    return df.select(aligned)


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add declared defaults for columns the input lacks; given NULLs stay NULL."""
    return df.withColumns({n: value for n, value in defaults.items() if n not in df.columns})


def mapping_report(
    df: DataFrame, columns: Sequence[SourceColumn], rules: ValueRules = ValueRules()
) -> DataFrame:
    """What each column lands as, and how many of its values take the text fallback."""
    types = {field.name: field.dataType for field in df.schema.fields}
    counts = [F.count(named(c.name)).alias(f"c{i}") for i, c in enumerate(columns)]
    facts = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(c.name).alias("column_name"),
            F.lit(c.type_name).alias("source_type"),
            F.lit(landing_type(c, rules, types[c.name]).simpleString()).alias("target_type"),
            F.lit(is_mapped(c)).alias("mapped"),
            F.col(f"c{i}").alias("present_values"),
            (F.lit(0).cast("bigint") if is_mapped(c) else F.col(f"c{i}")).alias("fallback_values"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*counts).select(F.inline(F.array(*facts))).orderBy("position")


def stack_up(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, duplicates kept, columns matched by name."""
    if not parts:
        raise ValueError("nothing to stack")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
