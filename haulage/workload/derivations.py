"""Row derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions import derive
from haulage.operators.profile import with_parameters
from haulage.operators.running import number_rows
from haulage.sources.files import table
from haulage.workload import query

# Term in months and yearly rate per order priority.
TERMS = {
    "1-URGENT": (12, "4.250"),
    "2-HIGH": (18, "8.750"),
    "3-MEDIUM": (30, "9.400"),
    "4-NOT SPECIFIED": (48, "3.300"),
    "5-LOW": (96, "10.050"),
}
TERM_VALUES = ", ".join(f"('{k}', {term}, {rate})" for k, (term, rate) in TERMS.items())

# The oracle rounds in whole numbers: n over d, the remainder deciding, ties to even.
HALF_EVEN = "(n // d + CASE WHEN 2 * (n % d) > d OR (2 * (n % d) = d AND (n // d) % 2 = 1) THEN 1 ELSE 0 END)"


def with_terms(orders: DataFrame) -> DataFrame:
    listed = {key: (term, rate) for key, (term, rate) in TERMS.items()}
    return with_parameters(
        orders, "o_orderpriority", ["term", "rate_text"], listed, "term int, rate_text string"
    ).select(*orders.columns, "term", F.col("rate_text").cast("decimal(5,3)").alias("rate"))


@query(
    "SELECT c_custkey, lower(c_name) AS email,"
    " ((q + CASE WHEN r = 3 OR (r = 2 AND q % 2 <> 0) THEN 1 ELSE 0 END)::DECIMAL(15,0) / 100)"
    "::DECIMAL(15,2) AS amount FROM (SELECT *, floor(cents / 4.0)::BIGINT AS q,"
    " (cents - 4 * floor(cents / 4.0))::BIGINT AS r FROM (SELECT c_custkey, c_name,"
    " round(c_acctbal * 100)::BIGINT AS cents FROM customer))"
)
def normalise_row(spark: SparkSession, folder: str) -> DataFrame:
    """Lower-case text, and a quarter of the balance to cents, ties to even."""
    quarter = F.col("c_acctbal").cast("decimal(15,2)") * F.lit("0.25").cast("decimal(3,2)")
    return table(spark, folder, "customer").select(
        "c_custkey",
        derive.lowered(F.col("c_name")).alias("email"),
        derive.money(quarter).cast("decimal(15,2)").alias("amount"),
    )


@query(
    "SELECT row_number() OVER (ORDER BY ts, event_id) AS audit_id, event_id, ts FROM events"
)
def surrogate_key(spark: SparkSession, folder: str) -> DataFrame:
    """Gapless numbers in time order."""
    events = table(spark, folder, "events").select("event_id", "ts")
    return number_rows(events, ["ts", "event_id"], "audit_id")


@query(
    "SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS row_id, o_orderkey, o_orderpriority"
    " FROM orders"
)
def number_by_text(spark: SparkSession, folder: str) -> DataFrame:
    """Gapless numbers in the order of a text that few values fill."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return number_rows(orders, ["o_orderpriority", "o_orderkey"])


@query("SELECT p_partkey, substr(p_name, 1, 8) AS short_name FROM part")
def text_truncate(spark: SparkSession, folder: str) -> DataFrame:
    short = derive.truncated(F.col("p_name"), 8)
    return table(spark, folder, "part").select("p_partkey", short.alias("short_name"))


@query(
    "SELECT event_id, upper(event_type[1]) || lower(event_type[2:]) || ': ' || props AS description"
    " FROM events"
)
def compose_label(spark: SparkSession, folder: str) -> DataFrame:
    label = derive.labelled(F.col("event_type"), F.col("props"))
    return table(spark, folder, "events").select("event_id", label.alias("description"))


@query(
    "SELECT s_suppkey, 'https://' || replace(replace(replace(lower(s_name), ' ', ''), ',', ''), '#', '')"
    " || '.example.com' AS website FROM supplier"
)
def slug_url(spark: SparkSession, folder: str) -> DataFrame:
    url = derive.site_url(F.col("s_name"), " ,#")
    return table(spark, folder, "supplier").select("s_suppkey", url.alias("website"))


@query(
    "SELECT p_partkey, to_json({'brand': p_brand, 'size': p_size,"
    " 'kind': CASE WHEN p_size > 25 THEN p_type END})::VARCHAR AS metadata FROM part"
)
def json_encode(spark: SparkSession, folder: str) -> DataFrame:
    text = derive.json_object(
        brand=F.col("p_brand"),
        size=F.col("p_size"),
        kind=derive.only_when(F.col("p_size") > 25, F.col("p_type")),
    )
    return table(spark, folder, "part").select("p_partkey", text.alias("metadata"))


@query(
    "SELECT o_orderkey, term, greatest(0.100, rate - 6.000)::DECIMAL(6,3) AS rate FROM orders"
    f" JOIN (VALUES {TERM_VALUES}) AS t(name, term, rate) ON o_orderpriority = name"
)
def terms_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters by key, the rate kept above its floor."""
    orders = with_terms(table(spark, folder, "orders"))
    rate = derive.at_least(
        F.col("rate") - F.lit("6.000").cast("decimal(5,3)"),
        F.lit(derive.LOWEST_RATE).cast("decimal(5,3)"),
    )
    return orders.select("o_orderkey", "term", rate.cast("decimal(6,3)").alias("rate"))


@query(
    f"SELECT o_orderkey, ({HALF_EVEN}::DECIMAL(15,0) / 100)::DECIMAL(15,2) AS monthly_payment FROM ("
    " SELECT o_orderkey, round(o_totalprice * 100)::BIGINT * 115 AS n, 100 * term AS d FROM orders"
    f" JOIN (VALUES {TERM_VALUES}) AS t(name, term, rate) ON o_orderpriority = name)"
)
def instalment(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly payment over the term of each order's priority."""
    payment = derive.instalment(F.col("o_totalprice"), F.col("term"))
    orders = with_terms(table(spark, folder, "orders"))
    return orders.select("o_orderkey", payment.alias("monthly_payment"))


@query(
    "SELECT o_orderkey, (o_orderdate::DATE + term * 30)::DATE AS maturity_date FROM orders"
    f" JOIN (VALUES {TERM_VALUES}) AS t(name, term, rate) ON o_orderpriority = name"
)
def maturity_date(spark: SparkSession, folder: str) -> DataFrame:
    due = derive.maturity(F.col("o_orderdate"), F.col("term"))
    orders = with_terms(table(spark, folder, "orders"))
    return orders.select("o_orderkey", due.alias("maturity_date"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed_at,"
    " CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS outstanding FROM orders"
)
def conditional_null(spark: SparkSession, folder: str) -> DataFrame:
    """Values that exist only in some states."""
    closed = F.col("o_orderstatus") == "F"
    return table(spark, folder, "orders").select(
        "o_orderkey",
        derive.only_when(closed, F.col("o_orderdate")).alias("closed_at"),
        derive.only_when(~closed, F.col("o_totalprice")).alias("outstanding"),
    )
