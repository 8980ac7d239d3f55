"""Every registered query against its SQL, and what the plans must not contain."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from haulage import workload
from tests.conftest import DATA, plan_of

QUERIES, ORACLES = workload.QUERIES, workload.ORACLES


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(None if row[i] is None else str(row[i]) for i in order) for row in found]
    return sorted(columns), sorted(lines, key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = oracle.execute(ORACLES[name])
    assert found == canonical([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_stays_in_the_jvm_and_scales(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for never in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert never not in plan


SPREAD = [
    "append_unique", "check_fk", "first_per_group", "fk_cascade", "fk_set_null", "fk_valid_rows",
    "ledger_balance", "ledger_from_opening", "ledger_with_gaps", "name_match", "number_by_text",
    "parent_child", "running_count", "sample_keys", "surrogate_key", "unique_rejects",
]


@pytest.fixture
def as_if_large(spark):
    """Nothing is broadcast by size, and there are many small partitions that may be split."""
    changed = {
        "spark.sql.shuffle.partitions": "50",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", SPREAD)
def test_query_agrees_when_rows_are_spread(spark, oracle, as_if_large, name):
    df = QUERIES[name](spark, DATA)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = oracle.execute(ORACLES[name])
    assert found == canonical([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 5
