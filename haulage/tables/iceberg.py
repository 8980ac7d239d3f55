"""The same tables kept by an Iceberg catalog, where the session has one.

Needs the Iceberg runtime on the class path and the settings
``spark.sql.catalog.<name>`` in the session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.operators.conform import align
from haulage.operators.skew import spread
from haulage.tables.snapshots import Commit, split_name

LOAD_ID = "haulage-load-id"


class IcebergTables:
    """Loads, reads and history as ``SnapshotTables`` has them, kept by Iceberg.

    ``read_load``, ``row_counts`` and ``create_views`` are not there.
    """

    def __init__(self, spark: SparkSession, catalog: str):
        if spark.conf.get(f"spark.sql.catalog.{catalog}", None) is None:
            raise ValueError(f"the session has no catalog {catalog!r}")
        self.spark = spark
        self.catalog = catalog

    def _full(self, name: str) -> str:
        return ".".join([self.catalog, *split_name(name)])

    def create_namespace(self, namespace: str) -> None:
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {self.catalog}.{namespace}")

    def namespaces(self) -> DataFrame:
        return self.spark.sql(f"SHOW NAMESPACES IN {self.catalog}")

    def tables(self, namespace: str) -> DataFrame:
        listed = self.spark.sql(f"SHOW TABLES IN {self.catalog}.{namespace}")
        return listed.select("namespace", F.col("tableName").alias("table_name"))

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._full(name))

    def schema(self, name: str) -> T.StructType:
        return self.spark.table(self._full(name)).schema

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._full(name)}")

    def truncate(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"TRUNCATE TABLE {self._full(name)}")

    def history(self, name: str) -> DataFrame:
        return self.spark.table(f"{self._full(name)}.snapshots").select(
            "snapshot_id",
            F.unix_millis("committed_at").alias("committed_at_ms"),
            "operation",
            F.element_at("summary", "added-records").cast("bigint").alias("rows_loaded"),
            F.element_at("summary", LOAD_ID).alias("load_id"),
        )

    def read(self, name: str, as_of: int | None = None) -> DataFrame:
        reader = self.spark.read
        if as_of is not None:
            reader = reader.option("snapshot-id", str(as_of))
        return reader.table(self._full(name))

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
        """Overwrite or append; history stays.

        One commit, and one more before it where an overwrite changes the table's columns.

        ``snapshot_id`` is kept with the commit as the load's id, and a load
        whose id is already there is not written again.
        """
        if mode not in ("overwrite", "append"):
            raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")
        full = self._full(name)
        self.create_namespace(split_name(name)[0])
        there = self.exists(name)
        if there and snapshot_id is not None:
            done = self.history(name).where(F.col("load_id") == str(snapshot_id)).first()
            if done is not None:
                return self._commit(name, mode, done)
        schema = schema or df.schema
        if there and mode == "append":
            df = align(df, self.schema(name))
        elif not there or self.schema(name) != schema:
            layout = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
            self.spark.sql(f"CREATE OR REPLACE TABLE {full} ({schema.toDDL()}) USING iceberg{layout}")
        if cluster_by:
            df = df.withColumn("_spread", spread(df))
            df = df.repartitionByRange(*partition_by, *cluster_by, "_spread")
            df = df.sortWithinPartitions(*partition_by, *cluster_by).drop("_spread")
        writer = df.writeTo(full)
        if snapshot_id is not None:
            writer = writer.option(f"snapshot-property.{LOAD_ID}", str(snapshot_id))
        if mode == "append":
            writer.append()
        else:
            writer.overwrite(F.lit(True))
        newest = self.history(name).orderBy(F.col("committed_at_ms").desc()).first()
        return self._commit(name, mode, newest)

    def _commit(self, name: str, mode: str, row) -> Commit:
        namespace, table = split_name(name)
        return Commit(
            namespace, table, row.snapshot_id, row.committed_at_ms, mode,
            row.rows_loaded or 0, self.schema(name).json(),
        )
