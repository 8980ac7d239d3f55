"""Mergeable statistics against exact ones."""

import datetime as dt

import pytest

from haulage.operators.sketches import column_sketches, estimates, merge_sketches
from haulage.workload import QUERIES
from tests.conftest import plan_of


def told(sketches, **how):
    return {r.column_name: r for r in estimates(sketches, **how).collect()}


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(60_000).selectExpr(
        "id AS key", "if(id % 3 = 0, 0, id % 20000) AS hot", "cast(id % 7 AS string) AS few",
        "cast(id AS decimal(20,2)) / 4 AS money", "timestamp_seconds(id) AS at", "array(id) AS nested",
        "if(id % 10 = 0, null, if(id % 10 = 1, double('NaN'), cast(id AS double))) AS holes",
    )


def test_loads_merge_into_the_statistics_of_all(skewed):
    loads = [column_sketches(skewed.where(f"key % 5 = {k}").repartition(3)) for k in range(5)]
    merged, whole = told(merge_sketches(*loads), fractions=(0.1, 0.9)), told(column_sketches(skewed), fractions=(0.1, 0.9))
    for column in ("key", "hot", "few", "at", "money"):
        distinct = skewed.select(column).distinct().count()
        assert abs(merged[column].distinct_values - distinct) <= max(1, 0.03 * distinct)
        assert abs(whole[column].distinct_values - distinct) <= max(1, 0.03 * distinct)
        assert merged[column].rows == 60_000 and merged[column].nulls == 0
    for column, scale in (("key", 1), ("money", 0.25), ("at", 1e6)):
        low, high = merged[column].quantiles
        assert abs(low / scale - 6_000) < 900 and abs(high / scale - 54_000) < 900
    assert "nested" not in merged and merged["few"].quantiles is None and merged["holes"].nulls == 6_000


def test_frequent_values_are_found(skewed):
    merged = told(merge_sketches(column_sketches(skewed.where("key < 1000")), column_sketches(skewed.where("key >= 1000"))), common=3)
    assert (merged["hot"].common_values[0]["item"], merged["hot"].common_values[0]["count"]) == ("0", 20_002)
    assert {(c["item"], c["count"]) for c in told(column_sketches(skewed), common=7)["few"].common_values} == {
        (str(k), 8572 if k < 3 else 8571) for k in range(7)
    }


def test_empty_loads_and_columns_without_values(spark, skewed):
    none = column_sketches(skewed.limit(0))
    assert told(none)["key"].rows == 0 and told(none)["key"].quantiles is None and told(none)["key"].distinct_values == 0
    merged = told(merge_sketches(none, column_sketches(skewed.limit(10))))
    assert merged["key"].rows == 10 and merged["key"].distinct_values == 10
    days = spark.createDataFrame([(dt.date(1970, 1, 3),), (None,)], "day date")
    assert told(column_sketches(days))["day"].quantiles == [2.0, 2.0, 2.0]
    with pytest.raises(ValueError, match="no column"):
        column_sketches(skewed.select("nested"))


def test_exact_values_are_counted_without_a_row_for_each_column(spark, tmp_path):
    spark.range(900).selectExpr(
        "if(id % 9 = 0, null, id) AS l_orderkey", "id % 40 AS l_partkey", "cast(id % 300 AS double) AS l_extendedprice",
        "timestamp_ntz '1996-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 50 AS int)) AS l_shipdate",
        "cast(id % 7 AS int) AS l_linenumber", "cast(id % 5 AS double) AS l_quantity",
        "substr('ANR', cast(id % 3 AS int) + 1, 1) AS l_returnflag",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["column_sketches"](spark, str(tmp_path))
    assert "Expand" not in plan_of(found)
    told = {r.column_name: r for r in found.collect()}
    assert len(told) == 7 and all(r.rows == 900 and r.distinct_close for r in told.values())
    assert told["l_orderkey"].nulls == 100 and all(r.quartiles_close for n, r in told.items() if n != "l_returnflag")
    assert told["l_returnflag"].quartiles_close is None and told["l_returnflag"].most_rows == 300
