"""Foreign keys and ON DELETE actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators import names, profile, relate
from haulage.operators.conform import stack_up
from haulage.operators.relate import ForeignKey
from haulage.sources.files import table
from haulage.workload import query

IN_DEBT = "c_acctbal < 0"
GONE = f"(SELECT c_custkey FROM customer WHERE {IN_DEBT})"


def after_delete(spark: SparkSession, folder: str, on_delete: str = "cascade") -> dict[str, DataFrame]:
    """Customer, order and line tables once the customers in debt are deleted."""
    tables = {name: table(spark, folder, name) for name in ("customer", "orders", "lineitem")}
    keys = [
        ForeignKey("orders", "o_custkey", "customer", "c_custkey", on_delete),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ]
    return relate.delete_rows(tables, keys, "customer", F.col("c_acctbal") < 0)


@query(
    "SELECT * FROM lineitem WHERE l_orderkey NOT IN"
    f" (SELECT o_orderkey FROM orders WHERE o_custkey IN {GONE})"
)
def fk_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Lines left after their customers' orders went, two levels down."""
    return after_delete(spark, folder)["lineitem"]


@query(
    f"SELECT 'customer' AS table_name, count(*) AS rows FROM customer WHERE NOT {IN_DEBT}"
    f" UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN {GONE}"
    " UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN"
    f" (SELECT o_orderkey FROM orders WHERE o_custkey IN {GONE})"
)
def fk_cascade_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_stats(after_delete(spark, folder))


REFERRED = (
    "WITH RECURSIVE first_order AS (SELECT o_custkey + 1 AS k, min(o_orderkey) AS via FROM orders GROUP BY o_custkey),"
    " referred AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 12 > 0 THEN via END AS via"
    " FROM customer LEFT JOIN first_order ON k = c_custkey),"
    f" gone AS (SELECT c_custkey FROM customer WHERE {IN_DEBT} UNION SELECT referred.c_custkey FROM gone"
    " JOIN orders ON o_custkey = gone.c_custkey JOIN referred ON via = o_orderkey)"
)


@query(
    f"{REFERRED} SELECT 'orders' AS table_name, o_orderkey AS id, o_custkey AS refers_to FROM orders"
    " WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)"
    " UNION ALL SELECT 'customer', c_custkey, via FROM referred WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)"
)
def fk_cascade_ring(spark: SparkSession, folder: str) -> DataFrame:
    """Customers came through another customer's order, orders belong to customers: what is left of both without those in debt."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    first = orders.groupBy((F.col("o_custkey") + 1).alias("c_custkey")).agg(F.min("o_orderkey").alias("via"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal").join(first, "c_custkey", "left")
    customers = customers.withColumn("via", F.when(F.col("c_custkey") % 12 > 0, F.col("via")))
    keys = [
        ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        ForeignKey("customer", "via", "orders", "o_orderkey"),
    ]
    left = relate.delete_rows({"orders": orders, "customer": customers}, keys, "customer", F.col("c_acctbal") < 0)
    names = {"orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey", "via")}
    parts = [
        left[name].select(F.lit(name).alias("table_name"), F.col(key).alias("id"), F.col(to).alias("refers_to"))
        for name, (key, to) in names.items()
    ]
    return stack_up(parts)


@query(
    "SELECT o_orderkey, CASE WHEN o_custkey IN"
    f" {GONE} THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice FROM orders"
)
def fk_set_null(spark: SparkSession, folder: str) -> DataFrame:
    """All orders stay; those of deleted customers lose the reference."""
    return after_delete(spark, folder, "set null")["orders"].select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(f"SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE NOT {IN_DEBT})")
def fk_valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    solvent = table(spark, folder, "customer").where(F.col("c_acctbal") >= 0)
    return relate.with_parent(table(spark, folder, "orders"), "o_custkey", solvent, "c_custkey")


@query(
    "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer"
    " LEFT JOIN orders ON c_custkey = o_custkey"
)
def parent_child(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with each order, or none."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = relate.children_of(customers, "c_custkey", orders, "o_custkey")
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query(
    "SELECT c_custkey, 'NATION_' || (c_nationkey + c_custkey % 3) AS merchant, n_nationkey, n_regionkey"
    " FROM customer LEFT JOIN nation ON n_name = 'NATION_' || (c_nationkey + c_custkey % 3)"
)
def name_match(spark: SparkSession, folder: str) -> DataFrame:
    """Free text, some of which names nothing, matched to the reference row of that name."""
    number = F.col("c_nationkey") + F.col("c_custkey") % 3
    merchant = F.concat(F.lit("NATION_"), number.cast("string"))
    customers = table(spark, folder, "customer").select("c_custkey", merchant.alias("merchant"))
    matched = relate.look_up(customers, "merchant", table(spark, folder, "nation"), "n_name")
    return matched.select("c_custkey", "merchant", "n_nationkey", "n_regionkey")


MISSPELT = (
    "CASE WHEN c_custkey % 11 = 0 THEN 'UNKNOWN' WHEN c_custkey % 4 = 0 THEN 'NATION_' || c_nationkey"
    " WHEN c_custkey % 4 = 1 THEN 'NAION_' || c_nationkey WHEN c_custkey % 4 = 2 THEN 'NATIOON_' || c_nationkey"
    " ELSE 'NATOIN_' || c_nationkey END"
)


@query(
    f"WITH written AS (SELECT c_custkey, {MISSPELT} AS merchant FROM customer),"
    " near AS (SELECT merchant, n_name, levenshtein(merchant, n_name) AS d"
    " FROM (SELECT DISTINCT merchant FROM written), nation),"
    " best AS (SELECT merchant, arg_min(n_name, (d, n_name)) AS matched, min(d)::INTEGER AS distance"
    " FROM near WHERE d <= 2 GROUP BY merchant)"
    " SELECT c_custkey, merchant, matched, distance FROM written LEFT JOIN best USING (merchant)"
)
def name_match_close(spark: SparkSession, folder: str) -> DataFrame:
    """Misspelt names, and some that name nothing, matched to the closest reference name within two edits."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    written = (
        F.when(key % 11 == 0, F.lit("UNKNOWN"))
        .when(key % 4 == 0, F.concat(F.lit("NATION_"), nation))
        .when(key % 4 == 1, F.concat(F.lit("NAION_"), nation))
        .when(key % 4 == 2, F.concat(F.lit("NATIOON_"), nation))
        .otherwise(F.concat(F.lit("NATOIN_"), nation))
    )
    customers = table(spark, folder, "customer").select("c_custkey", written.alias("merchant"))
    return names.closest_name(customers, "merchant", table(spark, folder, "nation"), "n_name")
