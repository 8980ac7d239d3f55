"""Tables kept as numbered snapshots: one folder of Parquet per load, plus a load log.

A load writes its rows first and its log row last; the log row is the commit.
Readers look only at folders the log names, so a load that died half way is
never seen and its folder is simply written again. One writer per table at a
time is assumed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import named
from haulage.operators.conform import align
from haulage.operators.skew import spread, task_count

LOG_SCHEMA = T.StructType(
    [
        T.StructField("namespace", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("snapshot_id", T.LongType(), False),
        T.StructField("committed_at_ms", T.LongType(), False),
        T.StructField("operation", T.StringType(), False),
        T.StructField("rows_loaded", T.LongType(), False),
        T.StructField("schema_json", T.StringType(), False),
        T.StructField("partition_by", T.ArrayType(T.StringType()), False),
    ]
)

STARTS_OVER = ("overwrite", "truncate")
NAMESPACE_MARK = ""


@dataclass(frozen=True)
class Commit:
    """One row of the load log."""

    namespace: str
    table_name: str
    snapshot_id: int
    committed_at_ms: int
    operation: str
    rows_loaded: int
    schema_json: str
    partition_by: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema_json))


def split_name(name: str) -> tuple[str, str]:
    namespace, _, table = name.rpartition(".")
    return namespace or "default", table


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system the path names, as Spark itself would."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def live_commits(known: Sequence[Commit], as_of: int | None = None) -> list[Commit]:
    """Of a table's commits, oldest first, those that make it up as of a snapshot."""
    parts: list[Commit] = []
    for commit in known:
        if as_of is not None and commit.snapshot_id > as_of:
            break
        if commit.operation == "drop":
            parts = []
        elif commit.operation in STARTS_OVER or not parts:
            parts = [commit]
        else:
            parts.append(commit)
    return parts


class SnapshotTables:
    """All tables under one warehouse root that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- log -----------------------------------------------------------------

    def _log_path(self, namespace: str, table: str, snapshot_id: int | None = None) -> str:
        path = f"{self.root}/load_log/ns={namespace}/t={table or '-'}"
        return path if snapshot_id is None else f"{path}/s={snapshot_id}"

    def _data_path(self, namespace: str, table: str, snapshot_id: int | None = None) -> str:
        path = f"{self.root}/data/{namespace}/{table}"
        return path if snapshot_id is None else f"{path}/load_snapshot={snapshot_id}"

    def _read_log(self, path: str) -> DataFrame:
        if not folder_exists(self.spark, path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        reader = self.spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true")
        return reader.parquet(path)

    def load_log(self) -> DataFrame:
        """Every commit of every table."""
        return self._read_log(f"{self.root}/load_log")

    def commits(self, name: str) -> list[Commit]:
        """Commits of one table in order; one short row per load ever made."""
        rows = self._read_log(self._log_path(*split_name(name))).collect()
        made = [Commit(*row[:-1], tuple(row[-1])) for row in rows]
        return sorted(made, key=lambda commit: commit.snapshot_id)

    def _commit(self, commit: Commit) -> Commit:
        values = {**vars(commit), "partition_by": list(commit.partition_by)}
        row = self.spark.range(1, numPartitions=1).select(
            [F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields]
        )
        path = self._log_path(commit.namespace, commit.table_name, commit.snapshot_id)
        row.write.mode("overwrite").parquet(path)
        return commit

    # --- namespaces and tables -----------------------------------------------

    def create_namespace(self, namespace: str) -> None:
        """Make a namespace known, even while it holds no table."""
        if not self.commits(f"{namespace}.{NAMESPACE_MARK}"):
            now = int(time.time() * 1000)
            empty = T.StructType([]).json()
            self._commit(Commit(namespace, NAMESPACE_MARK, 0, now, "create_namespace", 0, empty))

    def namespaces(self) -> DataFrame:
        return self.load_log().select("namespace").distinct()

    def tables(self, namespace: str | None = None) -> DataFrame:
        """Tables whose latest commit did not drop them."""
        log = self.load_log().where(F.col("table_name") != NAMESPACE_MARK)
        if namespace is not None:
            log = log.where(F.col("namespace") == namespace)
        latest = log.groupBy("namespace", "table_name").agg(
            F.max_by("operation", "snapshot_id").alias("operation")
        )
        return latest.where(F.col("operation") != "drop").select("namespace", "table_name")

    def row_counts(self) -> DataFrame:
        """Rows per table as the log tells them; no table is read."""
        by_table = Window.partitionBy("namespace", "table_name")
        starts = F.col("operation").isin("drop", *STARTS_OVER)
        log = self.load_log().where(F.col("table_name") != NAMESPACE_MARK)
        log = log.withColumn("start", F.max(F.when(starts, F.col("snapshot_id"))).over(by_table))
        live = F.col("snapshot_id") >= F.coalesce("start", F.lit(0))
        counts = log.groupBy("namespace", "table_name").agg(
            F.sum(F.when(live, F.col("rows_loaded"))).alias("rows"),
            F.max_by("operation", "snapshot_id").alias("operation"),
        )
        return counts.where(F.col("operation") != "drop").drop("operation")

    def exists(self, name: str) -> bool:
        return bool(live_commits(self.commits(name)))

    def schema(self, name: str) -> T.StructType:
        """Declared schema with nullability, which Parquet itself does not keep."""
        live = live_commits(self.commits(name))
        if not live:
            raise ValueError(f"no table {name}")
        return live[-1].schema

    def drop(self, *names: str) -> None:
        """Drop tables in the order given, children first; a missing one is no error.

        The rows stay readable as of an earlier snapshot.
        """
        for name in names:
            known = self.commits(name)
            if live_commits(known):
                self._mark(known, "drop")

    def truncate(self, *names: str) -> None:
        """Empty tables, keeping their schema and earlier snapshots."""
        for name in names:
            known = self.commits(name)
            if not live_commits(known):
                raise ValueError(f"no table {name}")
            self._mark(known, "truncate")

    def _mark(self, known: Sequence[Commit], operation: str) -> None:
        last = known[-1]
        self._commit(
            replace(
                last,
                snapshot_id=last.snapshot_id + 1,
                committed_at_ms=int(time.time() * 1000),
                operation=operation,
                rows_loaded=0,
            )
        )

    # --- writing -------------------------------------------------------------

    def write(
        self,
        df: DataFrame,
        name: str,
        mode: str = "overwrite",
        *,
        schema: T.StructType | None = None,
        snapshot_id: int | None = None,
        cluster_by: Sequence[str] = (),
        partition_by: Sequence[str] = (),
    ) -> Commit:
        """Write one snapshot and commit it.

        ``overwrite`` takes the DataFrame's columns, all nullable unless ``schema``
        declares otherwise; ``append`` brings the rows to the existing table's schema,
        or creates the table. Repeating a committed ``snapshot_id`` changes
        nothing, so a retried job cannot load twice.

        Rows are counted while they are written; the table is not read again.
        """
        if mode not in ("overwrite", "append"):
            raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")
        namespace, table = split_name(name)
        known = self.commits(name)
        for commit in known:
            if commit.snapshot_id == snapshot_id:
                return commit
        newest = known[-1].snapshot_id if known else 0
        if snapshot_id is None:
            snapshot_id = newest + 1
        elif snapshot_id < newest:
            raise ValueError(f"snapshot {snapshot_id} is older than the last one of {name}")
        live = live_commits(known)
        if mode == "append" and live:
            schema = live[-1].schema
            partition_by = live[-1].partition_by
            df = align(df, schema)
        schema = schema or T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])

        if "load_snapshot" in df.columns:
            raise ValueError("load_snapshot is the name of the folders' column; rename the source's")
        for field in df.schema.fields:
            if field.name in partition_by and isinstance(field.dataType, T.StringType):
                # A folder's name cannot tell an empty text from NULL.
                message = F.lit(f"column {field.name} cannot lay out a table: it holds an empty text")
                own = named(field.name)
                guarded = F.when(own == "", F.raise_error(message)).otherwise(own)
                df = df.withColumn(field.name, guarded)
        rows = df
        if cluster_by:
            # Neighbouring keys share files and row groups, so that lookups on
            # them skip the rest by the min/max in the footers.
            # What ends the ordering splits a key, or copies of a row, too
            # frequent for one task.
            order = [*partition_by, *cluster_by]
            rows = rows.withColumn("_spread", spread(rows))
            rows = rows.repartitionByRange(task_count(rows), *order, "_spread")
            rows = rows.sortWithinPartitions(*order).drop("_spread")
        # Counted behind the shuffle, which reads what is below it twice.
        counter = Observation()
        rows = rows.observe(counter, F.count(F.lit(1)).alias("rows_loaded"))
        # Whatever a dead attempt left in the folder goes, whole.
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self._data_path(namespace, table, snapshot_id))
        loaded = counter.get["rows_loaded"]
        now = int(time.time() * 1000)
        return self._commit(
            Commit(
                namespace, table, snapshot_id, now, mode, loaded,
                schema.json(), tuple(partition_by),
            )
        )

    # --- reading -------------------------------------------------------------

    def read(self, name: str, as_of: int | None = None) -> DataFrame:
        """The table now, or as of a snapshot.

        Only the folders of the snapshots that make it up are listed and
        scanned; filters and columns reach the Parquet scan.
        """
        known = self.commits(name)
        if as_of is not None and as_of not in {commit.snapshot_id for commit in known}:
            raise ValueError(f"{name} has no snapshot {as_of}")
        live = live_commits(known, as_of)
        if not live:
            raise ValueError(f"no table {name}")
        return self._scan(name, live)

    def read_load(self, name: str, snapshot_id: int) -> DataFrame:
        """Only the rows one load brought, such as those an insert gave keys to."""
        made = [commit for commit in self.commits(name) if commit.snapshot_id == snapshot_id]
        if not made:
            raise ValueError(f"{name} has no snapshot {snapshot_id}")
        return self._scan(name, made)

    def _scan(self, name: str, live: Sequence[Commit]) -> DataFrame:
        namespace, table = split_name(name)
        schema = live[-1].schema
        paths = [
            self._data_path(namespace, table, commit.snapshot_id)
            for commit in live
            if commit.rows_loaded > 0
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self._data_path(namespace, table))
        return reader.parquet(*paths).select([named(column) for column in schema.names])

    def create_views(self, namespace: str) -> list[str]:
        """Make the tables of a namespace known to SQL under their own names."""
        names = sorted(row.table_name for row in self.tables(namespace).collect())
        for name in names:
            self.read(f"{namespace}.{name}").createOrReplaceTempView(name)
        return names

    def history(self, name: str) -> DataFrame:
        """Snapshots of a table: id, commit time and operation."""
        log = self._read_log(self._log_path(*split_name(name)))
        return log.select("snapshot_id", "committed_at_ms", "operation", "rows_loaded").orderBy(
            "snapshot_id"
        )
