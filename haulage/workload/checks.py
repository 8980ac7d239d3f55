"""Constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.operators import quality, relate, running
from haulage.operators.quality import Rule
from haulage.sources.files import table
from haulage.workload import query


def breaking(df: DataFrame, rule: Rule) -> DataFrame:
    return df.where(rule.broken)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def check_in_set(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return breaking(orders, Rule("status", quality.in_set(F.col("o_orderstatus"), ["F", "O"])))


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
    " WHERE NOT (l_quantity BETWEEN 1 AND 40)"
)
def check_range(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return breaking(lines, Rule("quantity", quality.in_range(F.col("l_quantity"), 1, 40)))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0)")
def check_sign(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return breaking(customers, Rule("balance", quality.not_negative(F.col("c_acctbal"))))


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount")
def check_cross_column(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return breaking(lines, Rule("tax", F.col("l_tax") <= F.col("l_discount")))


@query(
    "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem"
    " GROUP BY ALL HAVING count(*) > 1"
)
def check_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated values of a composite key."""
    return quality.repeated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "SELECT count(*) AS repeated_keys, coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows FROM"
    " (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)"
)
def check_unique_text(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as a key: how many repeat, and the rows a constraint would turn away."""
    texts = quality.digested(table(spark, folder, "documents"), "text")
    return quality.unique_summary(texts, ["text"])


@query(
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER"
    " (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1"
)
def unique_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Documents a unique text would turn away, in order of arrival."""
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    documents = table(spark, folder, "documents").select("doc_id", "source", digest)
    return running.turned_away(documents, ["digest"], "doc_id").drop("digest")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN"
    " (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"
)
def check_fk(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose order is missing, here among the orders not pending."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    settled = table(spark, folder, "orders").where(F.col("o_orderstatus") != "P")
    return relate.orphans(lines, "l_orderkey", settled, "o_orderkey")


@query(
    "SELECT l_orderkey, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN"
    " (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey"
)
def check_fk_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The missing keys, each with the rows that refer to it."""
    settled = table(spark, folder, "orders").where(F.col("o_orderstatus") != "P")
    return relate.orphan_summary(table(spark, folder, "lineitem"), "l_orderkey", settled, "o_orderkey")


@query(
    "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
    " SELECT 'lang' AS rule, count(*) AS rows_checked, count(*) - count(lang) AS violations FROM d"
    " UNION ALL SELECT 'quality', count(*), count(*) - count(quality) FROM d"
    " UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic) FROM d"
)
def check_not_null(spark: SparkSession, folder: str) -> DataFrame:
    """NULLs per column, as a report."""
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return quality.null_counts(labelled, ["lang", "quality", "toxic"])


@query(
    "SELECT doc_id, length(text) AS characters FROM documents"
    " WHERE NOT (length(text) >= 100 AND length(text) <= 2000)"
)
def check_length(spark: SparkSession, folder: str) -> DataFrame:
    rule = Rule("text", quality.text_length(F.col("text"), 100, 2000))
    documents = breaking(table(spark, folder, "documents"), rule)
    return documents.select("doc_id", F.length("text").cast("bigint").alias("characters"))


@query(
    "SELECT p_partkey, p_name FROM part WHERE NOT (contains(p_name, 'e')"
    " AND length(p_name) - length(replace(p_name, ' ', '')) = 1 AND length(p_name) = 10)"
)
def check_format(spark: SparkSession, folder: str) -> DataFrame:
    """A part it must contain, a separator it has once, an exact length."""
    name = F.col("p_name")
    formed = (
        quality.has_text(name, "e")
        & (quality.occurrences(name, " ") == 1)
        & quality.text_length(name, 10, 10)
    )
    return breaking(table(spark, folder, "part").select("p_partkey", "p_name"), Rule("name", formed))


@query(
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
    " WHERE o_orderstatus = 'F' AND o_totalprice >= 200000"
)
def check_implies(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    small = quality.implies(F.col("o_orderstatus") == "F", F.col("o_totalprice") < 200000)
    return breaking(orders, Rule("closed orders are small", small))


@query(
    "SELECT event_id, ts FROM events"
    " WHERE NOT (date_diff('day', ts::DATE, DATE '2024-01-31') BETWEEN 0 AND 20)"
)
def check_recency(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts")
    as_of = F.lit("2024-01-31").cast("date")
    return breaking(events, Rule("recent", quality.within_days(F.col("ts"), as_of, 20)))


@query(
    "SELECT o_orderkey, date_sub('year', o_orderdate::DATE, DATE '2020-06-15') AS years FROM orders"
    " WHERE NOT (date_sub('year', o_orderdate::DATE, DATE '2020-06-15') BETWEEN 20 AND 23)"
)
def check_age(spark: SparkSession, folder: str) -> DataFrame:
    """Whole years up to a given day, within bounds."""
    years = quality.age_in_years(F.col("o_orderdate"), F.lit("2020-06-15").cast("date"))
    orders = table(spark, folder, "orders").select("o_orderkey", years.alias("years"))
    return breaking(orders, Rule("age", quality.in_range(F.col("years"), 20, 23)))


def customer_rules() -> list[Rule]:
    return [
        Rule("balance", quality.not_negative(F.col("c_acctbal"))),
        Rule("segment", quality.in_set(F.col("c_mktsegment"), ["BUILDING", "FURNITURE", "MACHINERY"])),
        Rule("nation", quality.in_range(F.col("c_nationkey"), 0, 19)),
    ]


CUSTOMER_BROKEN = (
    "(c_acctbal < 0)",
    "(c_mktsegment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY'))",
    "(NOT c_nationkey BETWEEN 0 AND 19)",
)


@query(
    "SELECT c_custkey, broken = '' AS accepted, broken FROM (SELECT c_custkey, concat_ws(',',"
    f" CASE WHEN {CUSTOMER_BROKEN[0]} THEN 'balance' END,"
    f" CASE WHEN {CUSTOMER_BROKEN[1]} THEN 'segment' END,"
    f" CASE WHEN {CUSTOMER_BROKEN[2]} THEN 'nation' END) AS broken FROM customer)"
)
def dq_split(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected rows, the rejected ones with the rules they break."""
    judged = quality.judged(table(spark, folder, "customer"), customer_rules())
    broken = F.concat_ws(",", "broken_rules").alias("broken")
    return judged.select("c_custkey", "accepted", broken)


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS rows_checked,"
        f" count(*) FILTER (WHERE {broken}) AS violations FROM customer"
        for name, broken in zip(("balance", "segment", "nation"), CUSTOMER_BROKEN)
    )
)
def dq_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.summary(table(spark, folder, "customer"), customer_rules())
