"""Aggregates, lookups, ledger replay and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.types import ValueRules, wall_clock_micros
from haulage.operators import profile, running, sketches
from haulage.operators.conform import stack_up
from haulage.operators.running import Opening
from haulage.plans.load import append_movements, load
from haulage.sources.files import table
from haulage.workload import query
from haulage.workload.loads import file_spec, new_tables


@query("SELECT count(*) AS rows FROM lineitem")
def agg_count(spark: SparkSession, folder: str) -> DataFrame:
    return profile.row_count(table(spark, folder, "lineitem"))


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def agg_count_by(spark: SparkSession, folder: str) -> DataFrame:
    return profile.count_by(table(spark, folder, "events"), "event_type")


SEGMENTS = (
    "SELECT c_mktsegment, count(*) AS rows, round(avg(c_acctbal), 4) AS average"
    " FROM customer GROUP BY c_mktsegment"
)


@query(SEGMENTS)
def agg_count_avg(spark: SparkSession, folder: str) -> DataFrame:
    return profile.count_and_average(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal")


@query(SEGMENTS)
def load_then_average(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: load the customers, read the table back, profile it by segment."""
    tables = new_tables(spark)
    load(spark, file_spec(folder, "customer", namespace="banking"), tables)
    return profile.count_and_average(tables.read("banking.customer"), "c_mktsegment", "c_acctbal")


@query(
    "SELECT event_type, count(*) AS rows,"
    " sum(value::DECIMAL(15,2))::DECIMAL(25,2) AS total FROM events GROUP BY event_type"
)
def agg_count_sum(spark: SparkSession, folder: str) -> DataFrame:
    return profile.count_and_sum(table(spark, folder, "events"), "event_type", "value")


@query(
    "SELECT parents, children, round(children / parents, 1)::DECIMAL(20,1) AS average FROM"
    " (SELECT (SELECT count(*) FROM customer) AS parents, (SELECT count(*) FROM orders) AS children)"
)
def summary_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return profile.children_per_parent(table(spark, folder, "customer"), table(spark, folder, "orders"))


# --- lookups ------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_custkey = 7")
def lookup_key(spark: SparkSession, folder: str) -> DataFrame:
    return profile.where_equal(table(spark, folder, "orders"), o_custkey=7)


@query("SELECT * FROM events WHERE event_type = 'purchase'")
def lookup_category(spark: SparkSession, folder: str) -> DataFrame:
    return profile.where_equal(table(spark, folder, "events"), event_type="purchase")


@query(
    "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'"
    " AND ts < TIMESTAMP '2024-01-20 12:00:00'"
)
def time_range(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return profile.in_period(events, "ts", "2024-01-10 00:00:00", "2024-01-20 12:00:00")


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 5")
def lookup_composite(spark: SparkSession, folder: str) -> DataFrame:
    return profile.where_equal(table(spark, folder, "lineitem"), l_returnflag="R", l_suppkey=5)


@query(
    "SELECT event_id, props, (props ->> '$.k')::INT = 69 AS number, false AS text, true AS any_object,"
    " true AS nested, true AS listed FROM events"
)
def json_contains(spark: SparkSession, folder: str) -> DataFrame:
    """What each event's properties contain, also wrapped in an object and in a list."""
    events = table(spark, folder, "events").select("event_id", "props")
    props = F.col("props")
    wrapped = F.concat(F.lit('{"of": '), props, F.lit(', "none": null, "tags": [1, "a", {"b": [2]}]}'))
    plain = {"number": {"k": 69}, "text": {"k": "69"}, "any_object": {}}
    inside = {"nested": {"of": {}, "none": None}, "listed": {"tags": [{"b": []}, "a"]}}
    asked = events.withColumns({"_p": profile.json_answers(props, plain), "_w": profile.json_answers(wrapped, inside)})
    return asked.select("event_id", "props", "_p.*", "_w.*")


@query(
    "SELECT event_id, json_extract(props, '$.k')::BIGINT = 69 AS number, false AS text, true AS any_object,"
    " json_extract(props, '$.k')::BIGINT AS k FROM events"
)
def json_landed(spark: SparkSession, folder: str) -> DataFrame:
    """JSON that landed as VARIANT, parsed by the load alone: containment and a member read from the column."""
    tables = new_tables(spark)
    spec = file_spec(
        folder, "events", namespace="web", column_types={"props": "jsonb"}, rules=ValueRules(json_as_variant=True)
    )
    load(spark, spec, tables)
    props = F.col("props")
    return tables.read("web.events").select(
        "event_id",
        profile.variant_holds(props, {"k": 69}).alias("number"),
        profile.variant_holds(props, {"k": "69"}).alias("text"),
        profile.variant_holds(props, {}).alias("any_object"),
        F.variant_get(props, "$.k", "bigint").alias("k"),
    )


SKETCHED = {
    "l_orderkey": None, "l_partkey": None, "l_extendedprice": None, "l_shipdate": None,
    "l_linenumber": "few", "l_quantity": "few", "l_returnflag": "few",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, true AS distinct_close,"
        f" {'NULL::BOOLEAN' if c == 'l_returnflag' else 'true'} AS quartiles_close,"
        + (f" (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c}))" if few else " NULL::BIGINT")
        + " AS most_rows FROM lineitem"
        for c, few in SKETCHED.items()
    )
)
def column_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics kept for each of three loads and merged without reading them again, held against exact ones.

    Distinct counts are to be within 4 % and the ranks of the quartiles within 2 % of the rows.
    """
    tables, lines = new_tables(spark), table(spark, folder, "lineitem")
    for flag in ("A", "N", "R"):
        load = sketches.column_sketches(lines.where(F.col("l_returnflag") == flag), list(SKETCHED))
        tables.write(load, "sales.lineitem_statistics", "append")
    told = sketches.estimates(sketches.merge_sketches(tables.read("sales.lineitem_statistics")))
    quartiles = {r["column_name"]: r["quantiles"] for r in told.collect()}

    def measured(name: str) -> DataFrame:
        # Each value with its rows, once: all columns in one aggregate would send a row for each of them.
        held = lines.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        value = wall_clock_micros(F.col(name)) if name == "l_shipdate" else F.col(name)
        value = value.cast("double") if quartiles[name] else F.lit(None)
        close = F.lit(True) if quartiles[name] else F.lit(None).cast("boolean")
        for wanted, at in zip((0.25, 0.5, 0.75), quartiles[name] or ()):
            # The rows of one value span a range of ranks.
            every = F.sum(F.when(value.isNotNull(), F.col("n")))
            below, upto = (F.sum(F.when(there, F.col("n")).otherwise(0)) / every for there in (value < at, value <= at))
            close = close & (below - 0.02 <= wanted) & (upto + 0.02 >= wanted)
        return held.agg(F.count(name).alias("exact"), close.alias("quartiles_close")).withColumn("column_name", F.lit(name))

    exact = stack_up([measured(c) for c in SKETCHED])
    few = F.col("column_name").isin([c for c, kind in SKETCHED.items() if kind])
    return told.join(exact, "column_name").select(
        "column_name",
        "rows",
        "nulls",
        (F.abs(F.col("distinct_values") - F.col("exact")) <= F.lit(0.04) * F.col("exact")).alias("distinct_close"),
        "quartiles_close",
        F.when(few, F.get("common_values", F.lit(0))["count"]).alias("most_rows"),
    )


# --- ledger -------------------------------------------------------------------

EVENT_MOVES = (
    "SELECT *, 1000 + sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END"
    " * value::DECIMAL(15,2)) OVER (PARTITION BY user_id ORDER BY event_id"
    " ROWS UNBOUNDED PRECEDING) AS s FROM events"
)
EVENT_LEDGER = (
    "SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id"
    f" ROWS UNBOUNDED PRECEDING)) AS b FROM ({EVENT_MOVES})"
)


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return running.ledger(
        events,
        account="user_id",
        order=["event_id"],
        kind="event_type",
        amount="value",
        credits=["signup", "view"],
        debits=["click", "error", "purchase"],
        opening=F.lit(1000),
    )


@query(f"SELECT event_id, user_id, b::DECIMAL(28,2) AS balance_after FROM ({EVENT_LEDGER})")
def ledger_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Balance after every event, never below zero."""
    return event_ledger(spark, folder).select("event_id", "user_id", "balance_after")


@query(f"SELECT event_id, user_id, b::DECIMAL(28,2) AS balance_after FROM ({EVENT_LEDGER})")
def ledger_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The same in three loads, each from the states that the one before left, without its movements."""
    tables = new_tables(spark)
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    rules = running.Movements(
        "user_id", ("event_id",), "event_type", "value", ("signup", "view"), ("click", "error", "purchase")
    )
    last = events.agg(F.max("event_id")).first()[0]
    third = F.floor(F.col("event_id") * 3 / F.lit(last + 1))
    for number in range(3):
        append_movements(tables, "bank.movements", events.where(third == number), rules, F.lit(1000))
    return tables.read("bank.movements").select("event_id", "user_id", "balance_after")


@query(
    "SELECT event_id, user_id, s::DECIMAL(28,2) AS stored, b::DECIMAL(28,2) AS balance_after FROM"
    " (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n"
    f" FROM ({EVENT_LEDGER})) WHERE abs(s - b) > 0.01 * n"
)
def ledger_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Balances kept without the floor, checked against the replay."""
    replayed = event_ledger(spark, folder).withColumnRenamed("unfloored_balance", "stored")
    wrong = running.ledger_mismatches(replayed, "stored")
    return wrong.select("event_id", "user_id", "stored", "balance_after")


@query(
    "WITH m AS (SELECT o_orderkey, o_custkey, greatest(c_acctbal, 0)::DECIMAL(15,2) +"
    " sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * o_totalprice::DECIMAL(15,2))"
    " OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s"
    " FROM orders JOIN customer ON o_custkey = c_custkey)"
    " SELECT o_orderkey, o_custkey, (s - least(0, min(s) OVER (PARTITION BY o_custkey"
    " ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)))::DECIMAL(28,2) AS balance_after FROM m"
)
def ledger_from_opening(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's ledger starts from the customer's own balance."""
    balance = F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance")
    customers = table(spark, folder, "customer").select("c_custkey", balance)
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    replayed = running.ledger(
        orders,
        account="o_custkey",
        order=["o_orderkey"],
        kind="o_orderstatus",
        amount="o_totalprice",
        credits=["F"],
        debits=["O", "P"],
        opening=Opening(customers, "c_custkey", "balance"),
    )
    return replayed.select("o_orderkey", "o_custkey", "balance_after")


@query(
    "SELECT event_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id"
    " ROWS UNBOUNDED PRECEDING)) AS balance_after FROM (SELECT *, 1000::DECIMAL(28,2) +"
    " sum(CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 1 ELSE -1 END"
    " * value::DECIMAL(15,2)) OVER (PARTITION BY user_id ORDER BY event_id"
    " ROWS UNBOUNDED PRECEDING) AS s FROM events)"
)
def ledger_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Movements without an amount, here those of every error, move nothing."""
    value = F.when(F.col("event_type") != "error", F.col("value"))
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", value.alias("value"))
    replayed = running.ledger(
        events,
        account="user_id",
        order=["event_id"],
        kind="event_type",
        amount="value",
        credits=["signup", "view"],
        debits=["click", "error", "purchase"],
        opening=F.lit(1000),
    )
    return replayed.select("event_id", F.col("balance_after"))


@query(
    "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"
    " AS is_primary FROM orders"
)
def first_per_group(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return running.flag_first(orders, ["o_custkey"], "o_orderkey")


@query(
    "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id"
    " ROWS UNBOUNDED PRECEDING) AS transactions FROM events"
)
def running_count(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id")
    return running.running_count(events, "user_id", ["event_id"], name="transactions")


@query(
    "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER"
    " (ORDER BY md5('7:' || c_custkey), c_custkey) AS r, count(*) OVER () AS n FROM customer)"
    " WHERE r <= greatest(1, floor(n * 0.4))"
)
def sample_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Two in five customers, exactly, and the same ones every time."""
    return profile.sample_keys(table(spark, folder, "customer"), "c_custkey", 0.4, seed=7)
