"""Files along a Z-order curve, by the statistics in their footers."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from haulage.operators.layout import interleaved, ranked, z_ordered
from haulage.plans.spec import LoadSpec
from tests.conftest import rows


def shares(path, column, values):
    """The share of row groups whose statistics admit a value, on average."""
    ranges = []
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = [meta.schema.column(k).name for k in range(meta.num_columns)].index(column)
        for g in range(meta.num_row_groups):
            found = meta.row_group(g).column(at).statistics
            ranges.append((found.min, found.max))
    return sum(sum(low <= v <= high for low, high in ranges) / len(ranges) for v in values) / len(values)


def test_lookups_on_each_column_skip_row_groups(spark, tmp_path):
    df = spark.range(40_000).selectExpr(
        "pmod(xxhash64(id), 5000) AS a", "concat('name', lpad(cast(pmod(xxhash64(id, 1), 3000) AS string), 4, '0')) AS b", "id"
    )
    z_ordered(df, ["a", "b"], parts=64).write.parquet(str(tmp_path / "z"))
    df.repartition(64).write.parquet(str(tmp_path / "plain"))
    back = spark.read.parquet(str(tmp_path / "z"))
    assert rows(back) == rows(df)
    assert shares(tmp_path / "z", "a", range(0, 5000, 97)) < 0.3
    assert shares(tmp_path / "plain", "a", range(0, 5000, 97)) > 0.9
    dates = df.selectExpr("a", "date_add(date'2020-01-01', cast(id % 900 AS int)) AS d", "id")
    z_ordered(dates, ["d", "a"], parts=64).write.parquet(str(tmp_path / "d"))
    values = [r.d for r in dates.select("d").distinct().limit(40).collect()]
    assert shares(tmp_path / "d", "d", values) < 0.3 and shares(tmp_path / "d", "a", range(0, 5000, 97)) < 0.3


def test_ranks_follow_the_order_and_bits_take_turns(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) AS v", "if(id % 100 = 0, null, cast(id AS string)) AS t")
    found = ranked(df, ["v", "t"]).select("v", "_rank0").distinct().orderBy("v").collect()
    assert [r._rank0 for r in found] == sorted(r._rank0 for r in found) and found[-1]._rank0 == 255
    one = spark.sql("SELECT 5 AS x, 2 AS y").select(interleaved([F.col("x").cast("bigint"), F.col("y").cast("bigint")]))
    assert one.first()[0] == 0b100110


def test_copies_and_odd_values_spread(spark):
    df = spark.range(8000, numPartitions=4).selectExpr("cast(if(id % 3 = 0, 'NaN', '1') AS double) AS v", "cast(null AS int) AS w")
    sizes = [r["count"] for r in z_ordered(df, ["v", "w"], 8).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8000 and len(sizes) > 2
    assert z_ordered(df.limit(0), ["v"], 4).count() == 0
    with pytest.raises(TypeError, match="cannot lay out"):
        z_ordered(df.select(F.array("v").alias("v")), ["v"])
    with pytest.raises(ValueError, match="1 to"):
        z_ordered(df, [])
    with pytest.raises(ValueError, match="not both"):
        LoadSpec("t", z_order_by=("a",), cluster_by=("b",))
