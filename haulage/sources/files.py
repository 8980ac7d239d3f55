"""Parquet as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.types import columns_of, named


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Scan Parquet files; Catalyst pushes the columns and filters used into the scan."""
    return spark.read.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


def source_schema(df: DataFrame) -> DataFrame:
    """One row per column in position order, with the row and NULL counts found.

    File schemas call every column nullable, so the NULLs are counted: one
    scan, one global aggregate whatever the number of columns.
    """
    columns = columns_of(df)
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count(named(c.name)).alias(f"c{i}") for i, c in enumerate(columns)]
    facts = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(c.name).alias("column_name"),
            F.lit(c.type_name).alias("data_type"),
            F.col("rows"),
            (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
            (F.col("rows") > F.col(f"c{i}")).alias("is_nullable"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*counts).select(F.inline(F.array(*facts))).orderBy("position")
