"""Loads, snapshot reads and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.types import (
    SourceColumn,
    ValueRules,
    columns_of,
    wall_clock,
    wall_clock_micros,
)
from haulage.operators import conform as shaping
from haulage.operators import profile
from haulage.operators.quality import Rule
from haulage.plans.load import insert, load, load_all
from haulage.plans.spec import LoadSpec
from haulage.session import fresh_warehouse
from haulage.sources import files
from haulage.sources.files import table
from haulage.tables.snapshots import SnapshotTables
from haulage.workload import query

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()

# Source type per lineitem column, as a database catalog would name it.
LINEITEM_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "integer",
    "l_quantity": "double precision",
    "l_extendedprice": "double precision",
    "l_discount": "double precision",
    "l_tax": "double precision",
    "l_returnflag": "text",
    "l_linestatus": "text",
    "l_shipdate": "timestamp without time zone",
}


def new_tables(spark: SparkSession) -> SnapshotTables:
    return SnapshotTables(spark, fresh_warehouse(spark))


def file_spec(folder: str, name: str, **settings) -> LoadSpec:
    return LoadSpec(table_name=name, path=f"{folder}/{name}.parquet", **settings)


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("SELECT * FROM orders")
def scan_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


@query(
    union_sql(
        [
            f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS data_type,"
            f" count(*) AS rows, count(*) - count({name}) AS nulls,"
            f" count(*) > count({name}) AS is_nullable FROM lineitem"
            for i, (name, kind) in enumerate(LINEITEM_TYPES.items(), 1)
        ]
    )
)
def source_schema(spark: SparkSession, folder: str) -> DataFrame:
    return files.source_schema(table(spark, folder, "lineitem"))


@query("SELECT * FROM orders")
def table_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    tables = new_tables(spark)
    load(spark, file_spec(folder, "orders", namespace="sales"), tables)
    return tables.read("sales.orders")


@query("SELECT * FROM orders")
def load_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """The second of two overwrites is what remains."""
    tables = new_tables(spark)
    orders = table(spark, folder, "orders")
    tables.write(orders.where(F.col("o_orderstatus") == "F"), "sales.orders", "overwrite")
    load(spark, file_spec(folder, "orders", namespace="sales", mode="overwrite"), tables)
    return tables.read("sales.orders")


@query("SELECT * FROM orders")
def load_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two slices appended; the first one creates the table."""
    tables = new_tables(spark)
    orders = table(spark, folder, "orders")
    final = F.col("o_orderstatus") == "F"
    tables.write(orders.where(final), "sales.orders", "append")
    tables.write(orders.where(~final), "sales.orders", "append")
    return tables.read("sales.orders")


@query("SELECT * FROM orders")
def load_retried(spark: SparkSession, folder: str) -> DataFrame:
    """An append repeated under its snapshot id loads nothing twice."""
    tables = new_tables(spark)
    spec = file_spec(folder, "orders", namespace="sales", mode="append")
    for _ in range(2):
        load(spark, spec, tables, snapshot_id=7)
    return tables.read("sales.orders")


@query("SELECT *, (SELECT count(*) FROM orders) AS reported FROM orders")
def load_clustered(spark: SparkSession, folder: str) -> DataFrame:
    """A load laid out by status and customer, for lookups to skip what they do not need, and its row count."""
    tables = new_tables(spark)
    spec = file_spec(
        folder, "orders", partition_by=("o_orderstatus",), cluster_by=("o_custkey", "o_orderkey")
    )
    done = load(spark, spec, tables)
    return tables.read("default.orders").withColumn("reported", F.lit(done.rows_loaded).cast("bigint"))


@query(
    "SELECT 'l_partkey' AS column_name, count(*) AS rows, true AS skips FROM lineitem WHERE l_partkey = 77"
    " UNION ALL SELECT 'l_shipdate', count(*), true FROM lineitem WHERE l_shipdate = TIMESTAMP '1996-03-01 00:00:00'"
)
def load_z_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """A load laid out by two columns: rows found by either one, and whether the files' ranges spare a quarter of them or more."""
    tables = new_tables(spark)
    load(spark, file_spec(folder, "lineitem", z_order_by=("l_partkey", "l_shipdate")), tables)
    lines = tables.read("default.lineitem")
    wanted = {"l_partkey": F.lit(77), "l_shipdate": F.lit("1996-03-01").cast("timestamp_ntz")}
    ranges = lines.groupBy(F.input_file_name().alias("file")).agg(
        *[F.min(c).alias(f"low_{c}") for c in wanted],
        *[F.max(c).alias(f"high_{c}") for c in wanted],
        *[F.sum((F.col(c) == v).cast("bigint")).alias(f"rows_{c}") for c, v in wanted.items()],
    )
    parts = [
        ranges.agg(
            F.sum(f"rows_{c}").alias("rows"), F.avg(v.between(F.col(f"low_{c}"), F.col(f"high_{c}")).cast("int")).alias("share")
        ).select(F.lit(c).alias("column_name"), "rows", (F.col("share") <= 0.75).alias("skips"))
        for c, v in wanted.items()
    ]
    return shaping.stack_up(parts)


@query(
    "SELECT 'loaded' AS part, count(*) AS rows, count(*) AS reported FROM orders"
    " WHERE o_totalprice <= 300000 AND o_orderstatus <> 'P'"
    " UNION ALL SELECT 'rejected', count(*), count(*) FROM orders"
    " WHERE o_totalprice > 300000 OR o_orderstatus = 'P'"
)
def load_with_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break a rule go to a table of their own; both are reported and read back."""
    tables = new_tables(spark)
    checks = [
        Rule("price is at most 300000", F.col("o_totalprice") <= 300000),
        Rule("order is decided", F.col("o_orderstatus") != "P"),
    ]
    load(spark, file_spec(folder, "orders", namespace="sales"), tables, checks=checks)
    return counted_back(tables, {"loaded": "sales.orders", "rejected": "sales.orders_rejected"})


@query(
    "SELECT 'loaded' AS part, count(*) AS rows, count(*) AS reported FROM orders"
    " UNION ALL SELECT 'rejected', count(*), count(*) FROM orders WHERE o_orderstatus = 'F'"
)
def append_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Appending all orders to those already there adds only the ones whose key is new."""
    tables = new_tables(spark)
    orders = table(spark, folder, "orders")
    tables.write(orders.where(F.col("o_orderstatus") == "F"), "sales.orders", "append")
    spec = file_spec(folder, "orders", namespace="sales", mode="append")
    load(spark, spec, tables, unique=[["o_orderkey"]])
    return counted_back(tables, {"loaded": "sales.orders", "rejected": "sales.orders_rejected"})


@query(
    "SELECT 'loaded' AS part, count(DISTINCT (l_partkey, l_suppkey)) AS rows,"
    " count(DISTINCT (l_partkey, l_suppkey)) AS keys, count(DISTINCT (l_partkey, l_suppkey)) AS reported FROM lineitem"
    " UNION ALL SELECT 'rejected', n - k, r, n - k FROM"
    " (SELECT count(*) FILTER (l_returnflag <> 'R') AS n, count(DISTINCT (l_partkey, l_suppkey))"
    " - count(DISTINCT (l_partkey, l_suppkey)) FILTER (l_returnflag = 'R') AS k FROM lineitem),"
    " (SELECT count(*) AS r FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL"
    " HAVING count(*) > 1 OR (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R')))"
)
def load_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose part and supplier repeat, within a load and against those already there: one of each is loaded."""
    tables = new_tables(spark)
    lines = table(spark, folder, "lineitem")
    key = ["l_partkey", "l_suppkey"]
    tables.write(lines.where(F.col("l_returnflag") == "R").dropDuplicates(key), "sales.lineitem", "append")
    new = f"{fresh_warehouse(spark)}/lines"
    lines.where(F.col("l_returnflag") != "R").write.parquet(new)
    load(spark, LoadSpec("lineitem", path=new, namespace="sales", mode="append"), tables, unique=[key])
    names = {"loaded": "sales.lineitem", "rejected": "sales.lineitem_rejected"}
    keys = [
        tables.read(name).select(*key).distinct().agg(F.count(F.lit(1)).alias("keys")).withColumn("part", F.lit(part))
        for part, name in names.items()
    ]
    return counted_back(tables, names).join(shaping.stack_up(keys), "part")


def counted_back(tables: SnapshotTables, names: dict[str, str]) -> DataFrame:
    """Rows read back from tables, beside the rows their loads reported."""
    read = profile.table_stats({part: tables.read(name) for part, name in names.items()})
    told = tables.row_counts().withColumnRenamed("rows", "reported")
    full = F.concat_ws(".", "namespace", "table_name")
    parts = F.coalesce(*[F.when(full == name, F.lit(part)) for part, name in names.items()])
    told = told.select(parts.alias("table_name"), "reported")
    return read.join(told, "table_name").withColumnRenamed("table_name", "part")


@query(
    "SELECT 1::BIGINT AS as_of, * FROM orders WHERE o_orderstatus = 'F'"
    " UNION ALL SELECT 2::BIGINT AS as_of, * FROM orders"
)
def snapshot_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The table as of its first and as of its second load."""
    tables = new_tables(spark)
    orders = table(spark, folder, "orders")
    final = F.col("o_orderstatus") == "F"
    tables.write(orders.where(final), "sales.orders", "overwrite")
    tables.write(orders.where(~final), "sales.orders", "append")
    reads = [
        tables.read("sales.orders", as_of=k).withColumn("as_of", F.lit(k).cast("bigint"))
        for k in (1, 2)
    ]
    return shaping.stack_up(reads)


@query(
    "SELECT 1::BIGINT AS snapshot_id, 'overwrite' AS operation, count(*) AS rows_loaded"
    " FROM orders WHERE o_orderstatus = 'F'"
    " UNION ALL SELECT 2, 'append', count(*) FROM orders WHERE o_orderstatus <> 'F'"
    " UNION ALL SELECT 3, 'truncate', 0"
    " UNION ALL SELECT 4, 'overwrite', count(*) FROM orders"
)
def snapshot_history(spark: SparkSession, folder: str) -> DataFrame:
    tables = new_tables(spark)
    orders = table(spark, folder, "orders")
    tables.write(orders.where("o_orderstatus = 'F'"), "sales.orders", "overwrite")
    tables.write(orders.where("o_orderstatus <> 'F'"), "sales.orders", "append")
    tables.truncate("sales.orders")
    tables.write(orders, "sales.orders", "overwrite")
    return tables.history("sales.orders").drop("committed_at_ms")


@query(
    "SELECT 'sales' AS namespace, 'customer' AS table_name, count(*) AS rows FROM customer"
    " UNION ALL SELECT 'sales', 'orders', count(*) FROM orders"
    " UNION ALL SELECT 'web', 'events', count(*) FROM events"
)
def catalog_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Namespaces and tables known to the warehouse, with the rows behind each."""
    tables = new_tables(spark)
    wanted = {"customer": "sales", "orders": "sales", "events": "web"}
    for name, namespace in wanted.items():
        tables.create_namespace(namespace)
        load(spark, file_spec(folder, name, namespace=namespace), tables)
    return tables.tables().join(tables.row_counts(), ["namespace", "table_name"])


@query(
    "SELECT o_orderpriority, count(*) AS rows, sum(l_quantity::DECIMAL(15,2))::DECIMAL(25,2) AS quantity"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority"
)
def sql_over_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded tables asked in SQL under their own names."""
    tables = new_tables(spark)
    for name in ("orders", "lineitem"):
        load(spark, file_spec(folder, name, namespace="shop", target_name=f"shop_{name}"), tables)
    tables.create_views("shop")
    return spark.sql(
        "SELECT o_orderpriority, count(*) AS rows,"
        " cast(sum(cast(l_quantity AS decimal(15,2))) AS decimal(25,2)) AS quantity"
        " FROM shop_orders JOIN shop_lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority"
    )


@query(
    "SELECT 'as of load' AS moment, count(*) AS rows FROM orders"
    " UNION ALL SELECT 'after truncate', 0"
)
def truncate_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A truncated table is empty, and whole again as of the load before."""
    tables = new_tables(spark)
    first = load(spark, file_spec(folder, "orders"), tables)
    tables.truncate("default.orders")
    return profile.table_stats(
        {
            "as of load": tables.read("default.orders", as_of=first.snapshot_id),
            "after truncate": tables.read("default.orders"),
        }
    ).withColumnRenamed("table_name", "moment")


@query("SELECT 'customer' AS table_name, count(*) AS rows FROM customer")
def drop_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Children dropped before their parent; what stays is still listed and readable."""
    tables = new_tables(spark)
    for name in ("customer", "orders", "lineitem"):
        load(spark, file_spec(folder, name), tables)
    tables.drop("default.lineitem", "default.orders", "default.never_there")
    left = [row.table_name for row in tables.tables("default").collect()]
    return profile.table_stats({name: tables.read(f"default.{name}") for name in left})


@query(
    "SELECT 'sales.customer' AS table, count(*) AS rows_loaded, 'overwrite' AS mode FROM customer"
    " UNION ALL SELECT 'sales.orders', count(*), 'overwrite' FROM orders"
    " UNION ALL SELECT 'sales.line', count(*), 'append' FROM lineitem"
)
def load_report(spark: SparkSession, folder: str) -> DataFrame:
    """Three loads in dependency order, the last one clustered, one report row each."""
    specs = {
        "customers": file_spec(folder, "customer", namespace="sales"),
        "orders": file_spec(folder, "orders", namespace="sales", depends_on=("customers",)),
        "lines": file_spec(
            folder, "lineitem", namespace="sales", target_name="line", mode="append",
            depends_on=("orders",), cluster_by=("l_partkey",),
        ),
    }
    return load_all(spark, specs, new_tables(spark))


@query(
    "SELECT row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderkey) AS loan_id, o_orderkey,"
    " CASE WHEN o_orderstatus = 'F' THEN 'paid_off' ELSE 'active' END AS status FROM orders"
)
def insert_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows added to a table: keys go on from the last one, omitted columns get defaults."""
    tables = new_tables(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    closed = F.col("o_orderstatus") == "F"
    paid = orders.where(closed).select("o_orderkey", F.lit("paid_off").alias("status"))
    more = orders.where(~closed).select("o_orderkey")
    for rows in (paid, more):
        insert(tables, "bank.loans", rows, "loan_id", ["o_orderkey"], {"status": F.lit("active")})
    return tables.read("bank.loans")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return profile.preview(table(spark, folder, "orders"), ["o_orderkey"])


@query(union_sql([f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ALL_TABLES]))
def table_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_stats({name: table(spark, folder, name) for name in ALL_TABLES})


@query(
    union_sql(
        [
            f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls,"
            f" min({c})::VARCHAR AS lowest, max({c})::VARCHAR AS highest FROM orders"
            for c in (
                "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority",
            )
        ]
    )
)
def column_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_stats(table(spark, folder, "orders"))


# --- types --------------------------------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice::DECIMAL(15,2) AS l_extendedprice,"
    " l_discount::FLOAT AS l_discount, l_returnflag, l_shipdate FROM lineitem"
)
def conform_types(spark: SparkSession, folder: str) -> DataFrame:
    """Declared source types mapped to landing types, money kept as a decimal."""
    columns = [
        SourceColumn("l_orderkey", "BIGINT", nullable=False),
        SourceColumn("l_linenumber", "smallint"),
        SourceColumn("l_quantity", "double precision"),
        SourceColumn("l_extendedprice", "numeric", True, 15, 2),
        SourceColumn("l_discount", "real"),
        SourceColumn("l_returnflag", "character"),
        SourceColumn("l_shipdate", "timestamp with time zone"),
    ]
    lines = table(spark, folder, "lineitem").select([c.name for c in columns])
    return shaping.conform(lines, columns, ValueRules(exact_decimal=True))


@query(
    "SELECT p_partkey, to_json(string_split(p_name, ' '))::VARCHAR AS tags,"
    " to_json({'brand': p_brand, 'size': p_size})::VARCHAR AS metadata,"
    " '\\x' || lower(hex(p_brand)) AS token,"
    " (p_size::BIGINT * 86400000000000)::VARCHAR AS grace,"
    " (p_size::BIGINT * 604800000000000)::VARCHAR AS weeks,"
    " (-p_size::BIGINT * 3600000000000)::VARCHAR AS hours_ago,"
    " (p_size::BIGINT * 86400000000000 + 7200000000000)::VARCHAR AS spell,"
    " make_timestamp(p_partkey * 1000001) AS seen_at,"
    " strftime(make_timestamp(p_partkey * 1000001), '%H:%M:%S.%f') AS due_time,"
    " p_type AS part_uuid FROM part"
)
def unmapped_to_string(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays, JSON, bytes, intervals and times land as text; a timestamp of six digits as itself."""
    columns = [
        SourceColumn("p_partkey", "bigint"),
        SourceColumn("tags", "ARRAY"),
        SourceColumn("metadata", "jsonb"),
        SourceColumn("token", "bytea"),
        SourceColumn("grace", "interval"),
        SourceColumn("weeks", "interval"),
        SourceColumn("hours_ago", "interval"),
        SourceColumn("spell", "interval"),
        SourceColumn("seen_at", "timestamp(6) without time zone"),
        SourceColumn("due_time", "time without time zone"),
        SourceColumn("part_uuid", "uuid"),
    ]
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.split("p_name", " ").alias("tags"),
        F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("metadata"),
        F.encode("p_brand", "UTF-8").alias("token"),
        F.make_dt_interval(F.col("p_size")).alias("grace"),
        F.concat(F.col("p_size").cast("string"), F.lit(" weeks")).alias("weeks"),
        F.concat(F.col("p_size").cast("string"), F.lit(" hours ago")).alias("hours_ago"),
        F.concat(F.lit("P"), F.col("p_size").cast("string"), F.lit("DT2H")).alias("spell"),
        wall_clock(F.col("p_partkey") * 1_000_001).alias("seen_at"),
        wall_clock(F.col("p_partkey") * 1_000_001).alias("due_time"),
        F.col("p_type").alias("part_uuid"),
    )
    return shaping.conform(parts, columns)


@query(
    union_sql(
        [
            f"SELECT {i} AS position, '{n}' AS column_name, '{s}' AS source_type, '{t}' AS target_type,"
            f" {m} AS mapped, count({e}) AS present_values,"
            f" {'0::BIGINT' if m else f'count({e})'} AS fallback_values FROM part"
            for i, (n, s, t, m, e) in enumerate(
                [
                    ("p_partkey", "bigint", "bigint", True, "p_partkey"),
                    ("p_name", "text", "string", True, "p_name"),
                    ("p_size", "integer", "int", True, "p_size"),
                    ("p_retailprice", "double precision", "double", True, "p_retailprice"),
                    ("tags", "array", "string", False, "p_name"),
                    ("metadata", "jsonb", "string", False, "p_brand"),
                ],
                1,
            )
        ]
    )
)
def mapping_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each column would land as, and how many values take the text fallback."""
    parts = table(spark, folder, "part").select(
        "p_partkey",
        "p_name",
        "p_size",
        "p_retailprice",
        F.split("p_name", " ").alias("tags"),
        F.struct("p_brand").alias("metadata"),
    )
    return shaping.mapping_report(parts, columns_of(parts))


@query("SELECT event_id, ts FROM events")
def truncate_ns(spark: SparkSession, folder: str) -> DataFrame:
    """Nanosecond timestamps cut down to the microsecond, never rounded up."""
    columns = [
        SourceColumn("event_id", "bigint"),
        SourceColumn("ts", "timestamp(9) without time zone"),
    ]
    nanos = wall_clock_micros(F.col("ts")) * 1000 + 999
    events = table(spark, folder, "events").select("event_id", nanos.alias("ts"))
    return shaping.conform(events, columns)


@query(
    "SELECT s_acctbal, s_name, s_suppkey::INTEGER AS s_suppkey, s_nationkey::BIGINT AS s_nationkey"
    " FROM supplier"
)
def align_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Columns brought to an existing table's order and widths."""
    target = T.StructType(
        [
            T.StructField("s_acctbal", T.DoubleType()),
            T.StructField("s_name", T.StringType(), False),
            T.StructField("s_suppkey", T.IntegerType(), False),
            T.StructField("s_nationkey", T.LongType()),
        ]
    )
    return shaping.align(table(spark, folder, "supplier"), target)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def not_null_ok(spark: SparkSession, folder: str) -> DataFrame:
    """Every column guarded; a NULL in any would fail the job."""
    documents = table(spark, folder, "documents")
    columns = [SourceColumn(c.name, c.source_type, False) for c in columns_of(documents)]
    return shaping.conform(documents, columns)


@query(
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events"
)
def nan_to_null(spark: SparkSession, folder: str) -> DataFrame:
    """NaN, here in place of the value of every error event, lands as NULL."""
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, folder, "events").select("event_id", value.alias("value"))
    return shaping.conform(events, columns_of(events))


@query(
    "SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS status,"
    " 'USD' AS currency, true AS is_active, 0.00::DECIMAL(15,2) AS overdraft_limit FROM customer"
)
def with_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Omitted columns take their default; a NULL that was given stays."""
    given = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", given.alias("status"))
    return shaping.with_defaults(
        customers,
        {
            "status": F.lit("active"),
            "currency": F.lit("USD"),
            "is_active": F.lit(True),
            "overdraft_limit": F.lit("0.00").cast("decimal(15,2)"),
        },
    )


@query("SELECT * FROM lineitem")
def union_all(spark: SparkSession, folder: str) -> DataFrame:
    """Slices put together again, duplicates kept."""
    lines = table(spark, folder, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return shaping.stack_up([lines.where(returned), lines.where(~returned)])
