"""Table loads, snapshot reads and table-scale data quality on Spark DataFrames."""

from haulage.plans.load import load, load_all
from haulage.plans.spec import LoadSpec
from haulage.tables.snapshots import SnapshotTables

__all__ = ["LoadSpec", "SnapshotTables", "load", "load_all"]
