"""No Iceberg runtime is at hand; these tests look at what would be asked of it."""

from unittest.mock import MagicMock

import pytest
from pyspark.sql import types as T

from haulage.tables.iceberg import IcebergTables

SCHEMA = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("v", T.StringType())])


@pytest.fixture
def session(spark):
    session = MagicMock()
    session.conf.get.return_value = "org.apache.iceberg.spark.SparkCatalog"
    return session


def asked(session):
    return [call.args[0] for call in session.sql.call_args_list]


def test_needs_a_catalog(spark):
    with pytest.raises(ValueError, match="no catalog"):
        IcebergTables(spark, "lake")


def test_first_load_creates_the_table(session):
    session.catalog.tableExists.return_value = False
    session.table.return_value.schema = SCHEMA
    df = MagicMock()
    IcebergTables(session, "lake").write(
        df, "bank.users", "append", schema=SCHEMA, snapshot_id=7, partition_by=["v"]
    )
    assert asked(session) == [
        "CREATE NAMESPACE IF NOT EXISTS lake.bank",
        "CREATE OR REPLACE TABLE lake.bank.users (k INT NOT NULL,v STRING) USING iceberg PARTITIONED BY (v)",
    ]
    df.writeTo.assert_called_once_with("lake.bank.users")
    writer = df.writeTo.return_value.option
    writer.assert_called_once_with("snapshot-property.haulage-load-id", "7")
    writer.return_value.append.assert_called_once_with()


def test_overwrite_of_the_same_schema_is_one_commit(session):
    session.catalog.tableExists.return_value = True
    session.table.return_value.schema = SCHEMA
    df = MagicMock()
    IcebergTables(session, "lake").write(df, "bank.users", "overwrite", schema=SCHEMA)
    assert not any("CREATE OR REPLACE" in text for text in asked(session))
    df.writeTo.return_value.overwrite.assert_called_once()


def test_as_of_and_dropping(session):
    tables = IcebergTables(session, "lake")
    tables.read("bank.users", as_of=42)
    session.read.option.assert_called_once_with("snapshot-id", "42")
    tables.drop("bank.loans", "bank.users")
    assert asked(session) == [
        "DROP TABLE IF EXISTS lake.bank.loans", "DROP TABLE IF EXISTS lake.bank.users",
    ]
