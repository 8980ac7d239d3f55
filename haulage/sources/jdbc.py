"""A database table as a source, over Spark's JDBC reader."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from haulage.functions.types import SourceColumn
from haulage.plans.spec import LoadSpec


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def catalog_query(schema: str, table: str) -> str:
    """The catalog's description of a table, in column order.

    The reader wraps a query into a subselect, where an ORDER BY need not
    survive; the position is selected and sorted on afterwards.
    """
    return (
        "SELECT ordinal_position, column_name, data_type, is_nullable,"
        " numeric_precision, numeric_scale FROM information_schema.columns"
        f" WHERE table_schema = {quoted(schema)} AND table_name = {quoted(table)}"
    )


def bounds_query(spec: LoadSpec) -> str:
    column = spec.partition_column
    return (
        f"SELECT min({column}) AS lowest, max({column}) AS highest"
        f" FROM {spec.schema_name}.{spec.table_name}"
    )


def scan_options(spec: LoadSpec, bounds: tuple[Any, Any] | None = None) -> dict[str, str]:
    """Reader options for the whole table.

    The bounds only shape the ranges; rows outside them and NULLs are read too.

    One partition is one SELECT and so one consistent picture of the table.
    More partitions read in parallel, each in its own transaction: use them on
    a source that is quiet while it is read, or on a replica held still.
    """
    options = {
        **spec.connection,
        "dbtable": f"{spec.schema_name}.{spec.table_name}",
        "fetchsize": str(spec.batch_size),
        "preferTimestampNTZ": "true",
    }
    if spec.num_partitions > 1 and bounds is not None:
        lowest, highest = bounds
        options["partitionColumn"] = spec.partition_column
        options["lowerBound"] = str(lowest)
        options["upperBound"] = str(highest)
        options["numPartitions"] = str(spec.num_partitions)
    return options


def read_catalog(spark: SparkSession, spec: LoadSpec) -> list[SourceColumn]:
    """Columns of the source table; a few rows of metadata, so they come to the driver."""
    query = catalog_query(spec.schema_name, spec.table_name)
    rows = spark.read.format("jdbc").options(**spec.connection, query=query).load()
    return [
        SourceColumn(name, data_type, nullable == "YES", precision, scale)
        for _, name, data_type, nullable, precision, scale in sorted(
            rows.collect(), key=lambda row: row[0]
        )
    ]


def read_table(spark: SparkSession, spec: LoadSpec) -> DataFrame:
    """Every row and column of the source table."""
    bounds = None
    if spec.num_partitions > 1:
        query = bounds_query(spec)
        row = spark.read.format("jdbc").options(**spec.connection, query=query).load().first()
        if row is not None and row[0] is not None:
            bounds = (row[0], row[1])
    return spark.read.format("jdbc").options(**scan_options(spec, bounds)).load()
