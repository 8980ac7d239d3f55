import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage import LoadSpec, load, load_all
from haulage.functions.types import SourceColumn, micros_from_nanos
from haulage.operators.conform import conform
from haulage.plans.load import insert
from haulage.plans.spec import specs_from_steps
from haulage.sources import jdbc
from tests.conftest import plan_of, rows


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")


@pytest.fixture
def more(spark):
    return spark.createDataFrame([(3, "c")], "k int, v string")


def test_overwrite_twice_equals_once(tables, small):
    for _ in range(2):
        tables.write(small, "ns.t", "overwrite")
    assert rows(tables.read("ns.t")) == [(1, "a"), (2, "b")]


def test_append_creates_then_adds(tables, small, more):
    assert tables.write(small, "ns.t", "append").snapshot_id == 1
    second = tables.write(more, "ns.t", "append")
    assert (second.snapshot_id, second.rows_loaded, second.operation) == (2, 1, "append")
    assert rows(tables.read("ns.t")) == rows(small.unionByName(more))


def test_as_of_is_unchanged_by_later_loads(tables, small, more):
    tables.write(small, "ns.t", "overwrite")
    tables.write(more, "ns.t", "append")
    tables.write(more, "ns.t", "overwrite")
    assert rows(tables.read("ns.t", as_of=1)) == rows(small)
    assert rows(tables.read("ns.t", as_of=2)) == rows(small.unionByName(more))
    assert rows(tables.read("ns.t")) == rows(more)
    with pytest.raises(ValueError, match="no snapshot 9"):
        tables.read("ns.t", as_of=9)


def test_a_retried_load_changes_nothing(tables, small, more):
    first = tables.write(small, "ns.t", "append", snapshot_id=5)
    assert tables.write(small, "ns.t", "append", snapshot_id=5) == first
    tables.write(more, "ns.t", "append", snapshot_id=6)
    assert tables.read("ns.t").count() == 3
    with pytest.raises(ValueError, match="older than the last"):
        tables.write(more, "ns.t", "append", snapshot_id=4)


def test_rows_without_a_commit_are_not_seen(tables, small, more):
    tables.write(small, "ns.t", "append")
    more.write.parquet(tables._data_path("ns", "t", 2))
    assert tables.read("ns.t").count() == 2
    tables.write(more, "ns.t", "append")
    assert tables.read("ns.t").count() == 3


def test_leftovers_of_a_dead_attempt_go(tables, spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.partitionBy("c").parquet(tables._data_path("ns", "t", 1))
        tables.write(df.where("c = 'a'"), "ns.t", partition_by=["c"])
        assert rows(tables.read("ns.t")) == [(1, "a")]
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_a_failed_guard_commits_nothing(tables, spark, small):
    schema = T.StructType(
        [T.StructField("k", T.IntegerType(), False), T.StructField("v", T.StringType())]
    )
    tables.write(small, "ns.t", "overwrite", schema=schema)
    bad = spark.createDataFrame([(None, "x")], "k int, v string")
    with pytest.raises(Exception, match="must not be NULL"):
        tables.write(bad, "ns.t", "append")
    assert rows(tables.read("ns.t")) == rows(small)
    assert tables.schema("ns.t") == schema


def test_append_takes_the_target_schema(tables, spark, small):
    tables.write(small, "ns.t", "overwrite")
    tables.write(spark.createDataFrame([("z", 9)], "v string, k bigint"), "ns.t", "append")
    assert (9, "z") in rows(tables.read("ns.t"))
    assert tables.read("ns.t").schema["k"].dataType == T.IntegerType()
    with pytest.raises(ValueError, match="columns do not match"):
        tables.write(small.drop("v"), "ns.t", "append")


def test_an_empty_source_gives_an_empty_table(tables, small):
    made = tables.write(small.limit(0), "ns.t", "overwrite")
    assert made.rows_loaded == 0
    assert tables.read("ns.t").columns == ["k", "v"] and tables.read("ns.t").count() == 0
    tables.write(small, "ns.t", "append")
    assert tables.read("ns.t").count() == 2


def test_truncate_drop_and_listing(tables, small):
    tables.create_namespace("bare")
    tables.create_namespace("bare")
    tables.write(small, "ns.parent")
    tables.write(small, "ns.child")
    assert rows(tables.namespaces()) == [("bare",), ("ns",)]
    assert rows(tables.tables("ns")) == [("ns", "child"), ("ns", "parent")]
    tables.truncate("ns.child")
    assert tables.read("ns.child").count() == 0
    tables.drop("ns.child", "ns.parent", "ns.absent")
    assert rows(tables.tables()) == [] and not tables.exists("ns.child")
    with pytest.raises(ValueError, match="no table"):
        tables.read("ns.child")
    assert tables.read("ns.child", as_of=1).count() == 2
    tables.write(small, "ns.child", "append")
    assert rows(tables.read("ns.child")) == rows(small)
    assert [r.operation for r in tables.history("ns.child").collect()] == [
        "overwrite", "truncate", "drop", "append",
    ]


def test_partitioned_and_clustered_layout(tables, spark):
    df = spark.range(1000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c")
    )
    for mode in ("overwrite", "append"):
        tables.write(df, "ns.t", mode, cluster_by=["k"], partition_by=["c"])
    assert tables.read("ns.t").columns == ["k", "c"]
    assert rows(tables.read("ns.t")) == rows(df.unionAll(df))
    plan = plan_of(tables.read("ns.t").where("c = 'a' AND k = 6"))
    assert "PartitionFilters: [isnotnull(c" in plan and "EqualTo(k,6)" in plan


def test_a_frequent_key_spreads_over_files(tables, spark):
    df = spark.range(8000).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    tables.write(df, "ns.t", cluster_by=["k"])
    files = tables.read("ns.t").groupBy(F.input_file_name()).count().collect()
    assert len(files) == 8 and max(row["count"] for row in files) < 2000


def test_copies_of_one_row_spread_over_files(tables, spark):
    df = spark.range(8000, numPartitions=8).select(F.lit(7).alias("k"), F.lit("x").alias("v"))
    tables.write(df, "ns.t", cluster_by=["k"])
    files = tables.read("ns.t").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 4 and max(row["count"] for row in files) <= 3000


def test_a_read_lists_only_its_snapshots(tables, small, more):
    tables.write(small, "ns.t", "overwrite")
    tables.write(more, "ns.t", "overwrite")
    assert all("load_snapshot=2" in f for f in tables.read("ns.t").inputFiles())


def test_load_defaults_and_report(spark, tables, data):
    spec = LoadSpec("nation", path=f"{data}/nation.parquet")
    assert spec.target == "default.nation"
    commit = load(spark, spec, tables)
    assert (commit.operation, commit.rows_loaded) == ("overwrite", 25)
    again = load(spark, LoadSpec("nation", path=f"{data}/nation.parquet", mode="append"), tables)
    assert again.rows_loaded == 25 and tables.read("default.nation").count() == 50


def test_load_declared_types_and_not_null(spark, tables, data):
    spec = LoadSpec(
        "orders",
        path=f"{data}/orders.parquet",
        namespace="sales",
        target_name="o",
        column_types={"o_totalprice": "numeric(15,2)", "o_orderpriority": "inet"},
        not_null=("o_orderkey",),
    )
    load(spark, spec, tables)
    schema = tables.schema("sales.o")
    assert schema["o_totalprice"].dataType == T.DoubleType()
    assert not schema["o_orderkey"].nullable and schema["o_custkey"].nullable


def test_a_plain_load_has_no_shuffle(spark, tables, data):
    load(spark, LoadSpec("orders", path=f"{data}/orders.parquet"), tables)
    plan = plan_of(tables.read("default.orders").select("o_orderkey").where("o_custkey = 7"))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "EqualTo(o_custkey,7)" in plan


def test_load_all_runs_dependencies_first(spark, tables, data):
    steps = {
        "orders": {"table_name": "orders", "path": f"{data}/orders.parquet", "depends_on": ["people"]},
        "people": {"table_name": "customer", "path": f"{data}/customer.parquet", "namespace": "crm"},
    }
    report = load_all(spark, specs_from_steps(steps), tables).collect()
    assert [(r["table"], r["mode"]) for r in report] == [
        ("crm.customer", "overwrite"), ("default.orders", "overwrite"),
    ]
    assert report[1]["rows_loaded"] == tables.read("default.orders").count()


def test_loads_into_one_table_do_not_collide(spark, tables, data):
    specs = {
        f"s{i}": LoadSpec("nation", path=f"{data}/nation.parquet", mode="append") for i in range(4)
    }
    assert load_all(spark, specs, tables).count() == 4
    assert tables.read("default.nation").count() == 100


def test_column_names_may_hold_dots_and_spaces(spark, tables):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "`a.b` int, `c d` double")
    columns = [SourceColumn("a.b", "integer", False), SourceColumn("c d", "double precision")]
    tables.write(conform(df, columns), "ns.t", cluster_by=[])
    tables.write(conform(df, columns), "ns.t", "append")
    assert rows(tables.read("ns.t")) == [(1, 2.0), (1, 2.0), (2, None), (2, None)]


def test_a_failed_load_stops_those_that_depend_on_it(spark, tables, data):
    specs = {
        "bad": LoadSpec("nation", path=f"{data}/missing.parquet"),
        "next": LoadSpec("region", path=f"{data}/region.parquet", depends_on=("bad",)),
    }
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_all(spark, specs, tables)
    assert not tables.exists("default.region")


def test_settings_are_checked():
    with pytest.raises(ValueError, match="mode"):
        LoadSpec("t", mode="upsert")
    with pytest.raises(ValueError, match="partition_column"):
        LoadSpec("t", num_partitions=4)
    with pytest.raises(ValueError, match="unknown settings"):
        specs_from_steps({"a": {"table_name": "t", "colour": "red"}})
    with pytest.raises(ValueError, match="unknown steps"):
        specs_from_steps({"a": {"table_name": "t", "depends_on": ["b"]}})
    assert LoadSpec("t", bucket="lake").warehouse == "s3a://lake/warehouse"


def test_steps_as_existing_files_write_them():
    connections = {"bank": {"url": "jdbc:postgresql://db/bank"}}
    steps = {
        "users": {
            "kind": "table load", "table_name": "users", "schema_name": "public",
            "iceberg_namespace": "banking", "iceberg_table_name": "people", "s3_bucket": "lake",
            "s3_prefix": "wh", "mode": "append", "batch_size": 100, "postgres_conn_id": "bank",
        }
    }
    spec = specs_from_steps(steps, connections, ignore=["kind"])["users"]
    assert (spec.target, spec.warehouse, spec.mode) == ("banking.people", "s3a://lake/wh", "append")
    assert jdbc.scan_options(spec)["url"] == connections["bank"]["url"]
    with pytest.raises(ValueError, match="unknown connection"):
        specs_from_steps(steps, ignore=["kind"])
    with pytest.raises(ValueError, match="unknown settings"):
        specs_from_steps(steps, connections)


def test_row_counts_come_from_the_log(tables, small, more):
    for name in ("ns.a", "ns.b", "ns.c"):
        tables.write(small, name, "append")
        tables.write(more, name, "append")
    tables.write(more, "ns.b", "overwrite")
    tables.drop("ns.c")
    tables.create_namespace("bare")
    assert rows(tables.row_counts()) == [("ns", "a", 3), ("ns", "b", 1)]


def test_insert_goes_on_from_the_last_key(tables, spark):
    defaults = {"status": F.lit("active")}
    first = spark.createDataFrame([(20, "b"), (10, "a")], "at int, name string")
    insert(tables, "ns.t", first, "id", ["at"], defaults)
    given = spark.createDataFrame([(5, "c", None)], "at int, name string, status string")
    insert(tables, "ns.t", given, "id", ["at"], defaults)
    assert rows(tables.read_load("ns.t", 2), "id", "name") == [(3, "c")]
    insert(tables, "ns.t", given, "id", ["at"], defaults, snapshot_id=2)
    assert rows(tables.read("ns.t"), "id", "name", "status") == [
        (1, "a", "active"), (2, "b", "active"), (3, "c", None),
    ]


def test_session_settings_do_not_change_what_lands(spark, tables):
    df = spark.sql(
        "SELECT timestamp'2024-03-31 01:30:00Z' AS t, timestamp_ntz'2024-03-31 02:30:00' AS n,"
        " interval '200' day AS i, 3000000000L AS big"
    )
    columns = [
        SourceColumn("t", "timestamp with time zone"),
        SourceColumn("n", "timestamp without time zone"),
        SourceColumn("i", "interval"),
        SourceColumn("big", "bigint"),
    ]
    wanted = conform(df, columns).collect()
    before = {k: spark.conf.get(k) for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone")}
    spark.conf.set("spark.sql.ansi.enabled", "false")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert conform(df, columns).collect() == wanted
        nanos = spark.sql("SELECT 1711848600000000999L AS v").select(micros_from_nanos(F.col("v")))
        assert nanos.first()[0] == wanted[0].t
        with pytest.raises(Exception, match="cannot hold exactly: 3000000000"):
            conform(df, [*columns[:3], SourceColumn("big", "integer")]).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_jdbc_options():
    connection = {"url": "jdbc:postgresql://db/bank", "user": "u", "password": "p"}
    spec = LoadSpec("users", connection=connection, batch_size=100)
    options = jdbc.scan_options(spec)
    assert options["dbtable"] == "public.users" and options["fetchsize"] == "100"
    assert "numPartitions" not in options
    spec = LoadSpec("users", connection=connection, partition_column="user_id", num_partitions=4)
    options = jdbc.scan_options(spec, (1, 1000))
    assert (options["lowerBound"], options["upperBound"]) == ("1", "1000")
    assert (options["partitionColumn"], options["numPartitions"]) == ("user_id", "4")
    assert "numPartitions" not in jdbc.scan_options(spec, None)
    assert "table_name = 'o''clock'" in jdbc.catalog_query("public", "o'clock")
    assert "max(user_id)" in jdbc.bounds_query(spec)
