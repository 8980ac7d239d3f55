"""What is refused instead of changed, and what JSON text contains."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage import load
from haulage.functions.types import SourceColumn, interval_nanos, safe_cast
from haulage.operators import profile
from haulage.operators.conform import conform
from haulage.operators.quality import Rule
from haulage.plans.spec import LoadSpec
from tests.conftest import rows

SECOND = 1_000_000_000
DAY = 86_400 * SECOND


@pytest.mark.parametrize(
    ("text", "nanos"),
    [
        ("1 year 2 mons 3 days 04:05:06.7", (365 + 60 + 3) * DAY + 14_706_700_000_000),
        ("P1DT2H", DAY + 7200 * SECOND), ("P2W", 14 * DAY), ("P1M", 30 * DAY), ("PT1M", 60 * SECOND),
        ("04:05", 14_700 * SECOND), ("-04:05", -14_700 * SECOND), ("2 weeks", 14 * DAY),
        ("1 day ago", -DAY), ("4 hours 5 mins 6.5 secs", 14_706_500_000_000), ("00:00:00", 0), (None, None),
    ],
)
def test_intervals(spark, text, nanos):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(interval_nanos(F.col("v"))).first()[0] == nanos


@pytest.mark.parametrize("text", ["garbage", "", "P", "1 dayz", "PT", "5"])
def test_an_interval_that_cannot_be_read_fails(spark, text):
    df = spark.createDataFrame([(text,)], "v string")
    with pytest.raises(Exception, match="cannot read the interval"):
        df.select(interval_nanos(F.col("v"))).collect()


@pytest.mark.parametrize(
    ("arrives", "lands", "good", "bad"),
    [
        ("decimal(10,4)", "decimal(10,2)", Decimal("1.2300"), Decimal("1.2367")),
        ("timestamp_ntz", "date", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 10)),
        ("double", "float", 0.1, 1e300),
    ],
)
def test_a_cast_fails_instead_of_changing_a_value(spark, arrives, lands, good, bad):
    kinds = [T.StructType.fromDDL(f"v {kind}")[0].dataType for kind in (arrives, lands)]
    cast = safe_cast(F.col("v"), "v", *kinds)
    assert spark.createDataFrame([(good,)], f"v {arrives}").select(cast.alias("v")).first().v is not None
    with pytest.raises(Exception, match="cannot hold exactly"):
        spark.createDataFrame([(bad,)], f"v {arrives}").select(cast).collect()


@pytest.mark.parametrize("name", ["timestamp", "timestamptz", "timestamp(6) without time zone", "TIMESTAMP(3) with time zone"])
def test_timestamps_keep_their_date(spark, name):
    moment = dt.datetime(2024, 3, 5, 6, 7, 8)
    df = spark.createDataFrame([(moment,)], "t timestamp_ntz")
    assert conform(df, [SourceColumn("t", name)]).first().t == moment


def test_json_is_typed(spark):
    data = [('{"k": 69}',), ('{"k": "69"}',), ('{"k": [1, {"a": null}]}',), ('{}',), (None,), ("no",), ('{"it\'s": true}',)]
    df = spark.createDataFrame(data, "j string")

    def found(wanted):
        return [r.j for r in df.where(profile.json_holds(F.col("j"), wanted)).collect()]

    assert found({"k": 69}) == ['{"k": 69}'] and found({"k": 69.0}) == ['{"k": 69}']
    assert found({"k": "69"}) == ['{"k": "69"}']
    assert found({"k": [{"a": None}]}) == found({"k": [1]}) == ['{"k": [1, {"a": null}]}']
    assert len(found({})) == 5 and found({"a": {}}) == [] and found({"k": None}) == []
    assert found({"it's": True}) == ['{"it\'s": true}']
    with pytest.raises(TypeError):
        profile.json_holds(F.col("j"), {"k": object()})


def test_parameters_lose_no_row_and_refuse_an_unlisted_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    listed = profile.with_parameters(df, "k", ["n"], {"a": (5,)}, "n int")
    assert rows(listed) == [(1, "a", 5), (2, None, None)]
    with pytest.raises(Exception, match="no parameters are listed"):
        profile.with_parameters(df, "k", ["n"], {"b": (5,)}, "n int").collect()


def test_partition_values_do_not_change(spark, tables):
    df = spark.createDataFrame([(1, "a"), (2, "")], "v int, p string")
    with pytest.raises(Exception, match="empty text"):
        tables.write(df, "ns.t", partition_by=["p"])
    with pytest.raises(ValueError, match="load_snapshot"):
        tables.write(df.withColumnRenamed("v", "load_snapshot"), "ns.t")


def test_clustered_loads_count_each_row_once(spark, tables):
    df = spark.range(1500).withColumn("p", F.col("id") % 3)
    done = tables.write(df, "ns.t", cluster_by=["id"], partition_by=["p"])
    assert done.rows_loaded == 1500 == tables.read("ns.t").count()
    assert tables.row_counts().first()["rows"] == 1500


def test_rows_of_one_load_that_share_a_key(spark, tables, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e"), (9, "f")], "k int, v string").write.parquet(path)
    tables.write(spark.createDataFrame([(2, "x")], "k int, v string"), "ns.t", "append")
    spec = LoadSpec("t", namespace="ns", path=path, mode="append")
    load(spark, spec, tables, checks=[Rule("small", F.col("k") < 5)], unique=[["k"]])
    assert [r[0] for r in rows(tables.read("ns.t"))] == [None, None, 1, 2]
    rejected = {(r.k, tuple(r.broken_rules)) for r in tables.read("ns.t_rejected").collect()}
    assert rejected == {(1, ("k is unique",)), (2, ("k is unique",)), (9, ("small",))}
