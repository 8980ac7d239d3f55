import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haulage.session import build_session, fresh_warehouse  # noqa: E402
from haulage.tables.snapshots import SnapshotTables  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tables(spark):
    return SnapshotTables(spark, fresh_warehouse(spark))


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df, *columns):
    """Rows as sorted tuples, NULLs first."""
    found = [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda row: [(value is not None, value) for value in row])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
