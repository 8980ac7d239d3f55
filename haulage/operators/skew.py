"""Cut work so that its pieces follow the size of the input, whatever the keys look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import named

TASK_BYTES = 128 * 1024 * 1024
# What the optimizer says of a relation whose size it does not know is of this order.
UNKNOWN_BYTES = 1 << 60


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate, where it has one."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None
    return size if size < UNKNOWN_BYTES else None


def task_count(df: DataFrame) -> int:
    """How many tasks to spread a table over: the session's number, or more by its size."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, wanted, (estimated_bytes(df) or 0) // TASK_BYTES)


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    return isinstance(data_type, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, *more: Column) -> Column:
    """A hash of all columns, and of what else is given."""
    hashable = [
        F.to_json(F.struct(named(f.name))) if _has_map(f.dataType) else named(f.name)
        for f in df.schema.fields
    ]
    return F.xxhash64(*hashable, *more)


def spread(df: DataFrame) -> Column:
    """A number to scatter rows by, the same on every attempt of a task, unlike a random one.

    A hash of the whole row, and of the partition it comes from: copies of one
    row scatter too, since they do not all come from one partition.
    """
    return row_hash(df, F.spark_partition_id())
