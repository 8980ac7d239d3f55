"""A load from source to committed snapshot, and several loads in dependency order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import SourceColumn, columns_of, landing_schema, parse_type
from haulage.operators import unique as unique_keys
from haulage.operators.conform import conform, stack_up, with_defaults
from haulage.operators.layout import z_ordered
from haulage.operators.quality import Rule, judged
from haulage.operators.running import Movements, Opening, number_rows
from haulage.plans.spec import LoadSpec
from haulage.sources import files, jdbc
from haulage.tables.snapshots import Commit, SnapshotTables

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType(), False),
        T.StructField("rows_loaded", T.LongType(), False),
        T.StructField("mode", T.StringType(), False),
    ]
)


def describe_source(
    spark: SparkSession, spec: LoadSpec
) -> tuple[DataFrame, list[SourceColumn]]:
    """The source rows, still unread, and the source's description of its columns."""
    if spec.path is None:
        return jdbc.read_table(spark, spec), jdbc.read_catalog(spark, spec)
    df = files.read_parquet(spark, spec.path)
    columns = []
    for column in columns_of(df):
        name, precision, scale = column.source_type, column.precision, column.scale
        if column.name in spec.column_types:
            name, precision, scale = parse_type(spec.column_types[column.name])
        nullable = column.name not in spec.not_null
        columns.append(SourceColumn(column.name, name, nullable, precision, scale))
    return df, columns


def load(
    spark: SparkSession,
    spec: LoadSpec,
    tables: SnapshotTables | None = None,
    snapshot_id: int | None = None,
    checks: Sequence[Rule] = (),
    unique: Sequence[Sequence[str]] = (),
) -> Commit:
    """Run one load: scan, conform, guard, write and commit, in a single Spark job.

    A plain load has no shuffle; every source partition is converted and written
    by the task that read it. With ``checks``, only rows that break none are loaded. With
    ``unique``, a list of keys, neither are rows whose key is in the table that is
    appended to, nor all but one of the rows that share a key. The rest goes to the table
    ``<target>_rejected``, appended or overwritten likewise, with the names of the rules
    each row breaks.
    """
    if tables is None:
        if spec.warehouse is None:
            raise ValueError("name a bucket in the spec or pass the target tables")
        tables = SnapshotTables(spark, spec.warehouse)
    df, columns = describe_source(spark, spec)
    rows = conform(df, columns, spec.rules)
    if checks or unique:
        there = spec.mode == "append" and tables.exists(spec.target)
        stored = tables.read(spec.target) if there else None
        rows, rejected = screened(rows, checks, unique, stored)
        tables.write(rejected, f"{spec.target}_rejected", spec.mode, snapshot_id=snapshot_id)
    if spec.z_order_by:
        rows = z_ordered(rows, spec.z_order_by)
    return tables.write(
        rows,
        spec.target,
        spec.mode,
        schema=landing_schema(columns, spec.rules, df.schema),
        snapshot_id=snapshot_id,
        cluster_by=spec.cluster_by,
        partition_by=spec.partition_by,
    )


def screened(
    rows: DataFrame,
    checks: Sequence[Rule],
    unique: Sequence[Sequence[str]],
    stored: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """Rows that may be loaded, and the others with ``broken_rules``.

    Of new rows that share a key, the one with the least hash of all its columns stays, and of equal rows
    one; both results come from rows written once, so they agree. A key with a NULL in it equals no other. A key of rows that break a rule is free.
    """
    names = rows.columns
    judged_rows = judged(rows, checks)
    refused = [judged_rows.where("not accepted").drop("accepted")]
    left = judged_rows.where("accepted").select(*names)
    if unique:
        left = unique_keys.arrived(left)
        count = left.count() if stored is not None else 0
    for keys in unique:
        rule = F.array(F.lit(f"{', '.join(keys)} is unique")).alias("broken_rules")
        left, others = unique_keys.settled(left, stored, keys, count)
        refused.append(others.select(*names, rule))
    return left.select(*names), stack_up(refused)


def insert(
    tables: SnapshotTables,
    name: str,
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    defaults: Mapping[str, Column],
    snapshot_id: int | None = None,
) -> Commit:
    """Add rows with generated keys and defaults; keys go on from the table's last one.

    ``order`` says in which order the new rows get their keys; it must be unique.
    ``tables.read_load(name, commit.snapshot_id)`` returns them with their keys.
    """
    last = 0
    if tables.exists(name):
        last = tables.read(name).agg(F.max(key)).first()[0] or 0
    numbered = number_rows(with_defaults(rows, defaults), order, key, start=last + 1)
    numbered = numbered.select(key, *[c for c in numbered.columns if c != key])
    return tables.write(numbered, name, "append", snapshot_id=snapshot_id)


def append_movements(
    tables: SnapshotTables,
    name: str,
    rows: DataFrame,
    movements: Movements,
    opening: Column | Opening,
) -> Commit:
    """Add movements to a table with their balances, from the states that the loads before left.

    Each account's state is kept in ``<name>_state`` under the load's snapshot id, written first: a load that dies between both
    leaves a state that no load of the table names, and the next one goes on from the last that is whole.
    """
    kept = f"{name}_state"
    last = {t: tables.history(t).agg(F.max("snapshot_id")).first()[0] if tables.exists(t) else 0 for t in (name, kept)}
    state = tables.read(kept, as_of=last[name]) if last[name] else None
    balances, behind = movements.replay(rows, opening, state)
    snapshot_id = max(last.values()) + 1
    tables.write(behind, kept, "overwrite", snapshot_id=snapshot_id)
    return tables.write(balances, name, "append", snapshot_id=snapshot_id)


def load_all(
    spark: SparkSession,
    specs: Mapping[str, LoadSpec],
    tables: SnapshotTables | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Run several loads, each after those it depends on; one report row per load.

    Loads that do not depend on one another run side by side as Spark jobs,
    those into the same table one after the other. The first failure stops what
    has not started yet.
    """
    order = TopologicalSorter({step: spec.depends_on for step, spec in specs.items()})
    order.prepare()

    def run(steps: list[str]) -> list[Commit]:
        return [load(spark, specs[step], tables) for step in steps]

    report = []
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        while order.is_active():
            by_target: dict[str, list[str]] = {}
            for step in order.get_ready():
                by_target.setdefault(specs[step].target, []).append(step)
            for target, commits in zip(by_target, pool.map(run, by_target.values())):
                for step, commit in zip(by_target[target], commits):
                    report.append((target, commit.rows_loaded, specs[step].mode))
                    order.done(step)
    return spark.createDataFrame(report, REPORT_SCHEMA)
