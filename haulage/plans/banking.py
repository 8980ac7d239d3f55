"""The six tables of the banking source: columns, rules, keys and defaults.

Types are written as the database catalog names them, with lengths and scales,
and ``!`` for NOT NULL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.types import SourceColumn, parse_type
from haulage.operators import quality, relate, running
from haulage.operators.conform import stack_up
from haulage.operators.quality import Rule
from haulage.operators.relate import ForeignKey
from haulage.operators.running import Opening

# Columns of the source tables, in catalog order.
COLUMNS: dict[str, dict[str, str]] = {
    "users": {
        "user_id": "integer!",
        "first_name": "character varying(50)!",
        "last_name": "character varying(50)!",
        "email": "character varying(100)!",
        "phone": "character varying(20)",
        "date_of_birth": "date!",
        "ssn": "character varying(11)",
        "address": "character varying(200)",
        "city": "character varying(100)",
        "state": "character varying(2)",
        "zip_code": "character varying(10)",
        "account_type": "character varying(20)!",
        "account_number": "character varying(20)!",
        "balance": "numeric(15,2)",
        "credit_score": "integer",
        "is_active": "boolean",
        "created_at": "timestamp without time zone",
        "last_login": "timestamp without time zone",
    },
    "transactions": {
        "transaction_id": "integer!",
        "user_id": "integer",
        "transaction_type": "character varying(20)!",
        "amount": "numeric(15,2)!",
        "balance_after": "numeric(15,2)!",
        "transaction_date": "timestamp without time zone!",
        "description": "character varying(200)",
        "category": "character varying(50)",
        "merchant": "character varying(100)",
        "status": "character varying(20)",
        "reference_number": "character varying(50)!",
        "created_at": "timestamp without time zone",
    },
    "accounts": {
        "account_id": "bigint!",
        "user_id": "integer!",
        "account_number": "character varying(20)!",
        "account_type": "character varying(20)!",
        "balance": "numeric(15,2)!",
        "available_balance": "numeric(15,2)!",
        "interest_rate": "real",
        "overdraft_limit": "double precision",
        "currency": "character(3)!",
        "is_primary": "boolean",
        "opened_at": "timestamp without time zone!",
        "closed_at": "timestamp without time zone",
        "last_activity_at": "timestamp with time zone",
        "status": "character varying(20)!",
    },
    "merchants": {
        "merchant_id": "integer!",
        "merchant_uuid": "uuid!",
        "name": "character varying(100)!",
        "legal_name": "text",
        "category": "character varying(50)!",
        "mcc_code": "character(4)",
        "country": "character(2)!",
        "city": "character varying(100)",
        "website": "text",
        "tags": "array",
        "metadata": "jsonb",
        "risk_score": "smallint",
        "is_active": "boolean",
        "onboarded_on": "date!",
        "created_at": "timestamp without time zone",
    },
    "loans": {
        "loan_id": "bigint!",
        "user_id": "integer!",
        "account_id": "bigint",
        "loan_type": "character varying(20)!",
        "principal_amount": "numeric(15,2)!",
        "outstanding_balance": "numeric(15,2)!",
        "interest_rate": "numeric(5,3)!",
        "term_months": "smallint!",
        "monthly_payment": "numeric(15,2)!",
        "grace_period": "interval",
        "payment_due_time": "time without time zone",
        "origination_date": "date!",
        "maturity_date": "date!",
        "next_payment_date": "date",
        "status": "character varying(20)!",
        "collateral_desc": "text",
        "created_at": "timestamp without time zone",
        "updated_at": "timestamp without time zone",
    },
    "audit_log": {
        "audit_id": "bigint!",
        "event_uuid": "uuid!",
        "user_id": "integer",
        "entity_type": "character varying(50)!",
        "entity_id": "bigint",
        "action": "character varying(50)!",
        "changed_fields": "jsonb",
        "ip_address": "inet",
        "user_agent": "text",
        "session_token": "bytea",
        "occurred_at": "timestamp with time zone!",
        "duration_ms": "integer",
        "succeeded": "boolean!",
    },
}

# The values each column may take.
ACCOUNT_TYPES = ["checking", "savings", "credit", "investment"]
TRANSACTION_TYPES = ["deposit", "withdrawal", "transfer", "payment", "fee", "interest"]
TRANSACTION_STATUS = ["pending", "completed", "failed", "cancelled"]
ACCOUNT_STATUS = ["active", "frozen", "closed", "dormant"]
LOAN_TYPES = ["mortgage", "auto", "personal", "student", "credit_line"]
LOAN_STATUS = ["active", "paid_off", "delinquent", "defaulted", "refinanced"]
AUDIT_ACTIONS = ["create", "read", "update", "delete", "login", "logout", "failed_login"]
CREDITS = ["deposit", "interest"]

# Term in months, yearly rate, smallest and largest principal per loan type.
LOAN_TERMS = {
    "mortgage": (360, "5.5", 200_000, 800_000),
    "auto": (60, "7.2", 15_000, 60_000),
    "personal": (36, "11.9", 3_000, 35_000),
    "student": (120, "6.1", 10_000, 120_000),
    "credit_line": (24, "17.5", 1_000, 25_000),
}

# Keys no two rows may share.
UNIQUE = {
    "users": ["user_id", "email", "ssn", "account_number"],
    "transactions": ["transaction_id", "reference_number"],
    "accounts": ["account_id", "account_number"],
    "merchants": ["merchant_id", "merchant_uuid"],
    "loans": ["loan_id"],
    "audit_log": ["audit_id"],
}

FOREIGN_KEYS = [
    ForeignKey("transactions", "user_id", "users", "user_id"),
    ForeignKey("accounts", "user_id", "users", "user_id"),
    ForeignKey("loans", "user_id", "users", "user_id"),
    ForeignKey("loans", "account_id", "accounts", "account_id", "set null"),
    ForeignKey("audit_log", "user_id", "users", "user_id", "set null"),
]

# Children before the parents they refer to.
DROP_ORDER = ["audit_log", "loans", "merchants", "accounts", "transactions", "users"]


def source_columns(table: str) -> list[SourceColumn]:
    """The table's columns as the catalog would describe them."""
    columns = []
    for name, declared in COLUMNS[table].items():
        kind, precision, scale = parse_type(declared.rstrip("!"))
        if not kind.startswith("numeric"):
            precision = scale = None
        columns.append(SourceColumn(name, kind, not declared.endswith("!"), precision, scale))
    return columns


def defaults(table: str) -> dict[str, Column]:
    """Values for columns a row leaves out."""
    now = F.localtimestamp()
    zero = F.lit("0.00").cast("decimal(15,2)")
    return {
        "users": {"balance": zero, "is_active": F.lit(True), "created_at": now},
        "transactions": {"status": F.lit("completed"), "created_at": now},
        "accounts": {
            "balance": zero,
            "available_balance": zero,
            "overdraft_limit": F.lit(0.0),
            "currency": F.lit("USD"),
            "is_primary": F.lit(False),
            "opened_at": now,
            "status": F.lit("active"),
        },
        "merchants": {
            "merchant_uuid": F.uuid(),
            "country": F.lit("US"),
            "is_active": F.lit(True),
            "onboarded_on": F.current_date(),
            "created_at": now,
        },
        "loans": {"status": F.lit("active"), "created_at": now, "updated_at": now},
        "audit_log": {
            "event_uuid": F.uuid(),
            "occurred_at": F.current_timestamp(),
            "succeeded": F.lit(True),
        },
    }[table]


def declared_rules(table: str) -> list[Rule]:
    """NOT NULL and length rules that follow from the column types."""
    rules = []
    for name, declared in COLUMNS[table].items():
        kind, length, _ = parse_type(declared.rstrip("!"))
        if declared.endswith("!"):
            rules.append(Rule(f"{name} is present", quality.present(F.col(name))))
        if kind.startswith("character") and length:
            rules.append(
                Rule(f"{name} fits", quality.text_length(F.col(name), longest=length))
            )
    return rules


def check_rules(table: str, as_of: Column | None = None) -> list[Rule]:
    """The table's CHECK constraints, and what its rows promise beyond them.

    ``as_of`` is the day ages and recencies are measured from; without it those
    rules are left out.
    """
    c = F.col
    if table == "users":
        rules = [
            Rule(
                "names are not empty",
                quality.text_length(c("first_name"), 1) & quality.text_length(c("last_name"), 1),
            ),
            Rule("email has @", quality.has_text(c("email"), "@")),
            Rule("email is lower case", c("email") == F.lower("email")),
            Rule("ssn is 11 long", quality.text_length(c("ssn"), 11, 11)),
            Rule("ssn has two dashes", quality.occurrences(c("ssn"), "-") == 2),
            Rule("state is 2 long", quality.text_length(c("state"), 2, 2)),
            Rule("account type is known", quality.in_set(c("account_type"), ACCOUNT_TYPES)),
            Rule("account number is 10 to 20 long", quality.text_length(c("account_number"), 10, 20)),
            Rule("balance is not negative", quality.not_negative(c("balance"))),
            Rule("credit score is 300 to 850", quality.in_range(c("credit_score"), 300, 850)),
        ]
        if as_of is not None:
            age = quality.age_in_years(c("date_of_birth"), as_of)
            rules.append(Rule("age is 18 to 80", quality.in_range(age, 18, 80)))
            rules.append(Rule("last login is recent", quality.within_days(c("last_login"), as_of, 30)))
        return rules
    if table == "transactions":
        rules = [
            Rule("type is known", quality.in_set(c("transaction_type"), TRANSACTION_TYPES)),
            Rule("amount is positive", quality.positive(c("amount"))),
            Rule("balance is not negative", quality.not_negative(c("balance_after"))),
            Rule("status is known", quality.in_set(c("status"), TRANSACTION_STATUS)),
            Rule(
                "only payments name a merchant",
                quality.implies(c("merchant").isNotNull(), c("transaction_type") == "payment"),
            ),
        ]
        if as_of is not None:
            recent = quality.within_days(c("transaction_date"), as_of, 90)
            rules.append(Rule("date is recent", recent))
        return rules
    if table == "accounts":
        return [
            Rule("account type is known", quality.in_set(c("account_type"), ACCOUNT_TYPES)),
            Rule("status is known", quality.in_set(c("status"), ACCOUNT_STATUS)),
            Rule("available is at most the balance", c("available_balance") <= c("balance")),
            Rule(
                "closed accounts have a closing time",
                quality.exactly_when(c("status") == "closed", c("closed_at").isNotNull()),
            ),
        ]
    if table == "merchants":
        return [Rule("risk score is 0 to 100", quality.in_range(c("risk_score"), 0, 100))]
    if table == "loans":
        paid = c("status") == "paid_off"
        secured = quality.in_set(c("loan_type"), ["mortgage", "auto"])
        return [
            Rule("loan type is known", quality.in_set(c("loan_type"), LOAN_TYPES)),
            Rule("principal is positive", quality.positive(c("principal_amount"))),
            Rule("principal fits the loan type", principal_in_range()),
            Rule("outstanding is not negative", quality.not_negative(c("outstanding_balance"))),
            Rule("term is positive", quality.positive(c("term_months"))),
            Rule("maturity follows origination", c("maturity_date") > c("origination_date")),
            Rule("status is known", quality.in_set(c("status"), LOAN_STATUS)),
            Rule("paid off loans owe nothing", quality.implies(paid, c("outstanding_balance") == 0)),
            Rule(
                "paid off loans have no next payment",
                quality.exactly_when(paid, c("next_payment_date").isNull()),
            ),
            Rule(
                "collateral only where secured",
                quality.implies(c("collateral_desc").isNotNull(), secured),
            ),
        ]
    if table == "audit_log":
        return [
            Rule("action is known", quality.in_set(c("action"), AUDIT_ACTIONS)),
            Rule(
                "failed logins did not succeed",
                quality.implies(c("action") == "failed_login", ~c("succeeded")),
            ),
            Rule(
                "changes only with updates",
                quality.exactly_when(c("action") == "update", c("changed_fields").isNotNull()),
            ),
        ]
    raise ValueError(f"unknown table {table!r}")


def principal_in_range() -> Column:
    """Whether a loan's principal lies in the range of its type; NULL for an unknown type."""
    amount, kind = F.col("principal_amount"), F.col("loan_type")
    holds = F.lit(None).cast("boolean")
    for name, (_, _, lowest, highest) in LOAN_TERMS.items():
        holds = F.when(kind == name, quality.in_range(amount, lowest, highest)).otherwise(holds)
    return holds


def all_rules(table: str, as_of: Column | None = None) -> list[Rule]:
    return declared_rules(table) + check_rules(table, as_of)


def key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of every unique and foreign key among the given tables."""
    parts = []
    for table, keys in UNIQUE.items():
        for key in keys if table in tables else ():
            extra = quality.unique_summary(tables[table], [key])
            parts.append((f"{table}.{key} is unique", extra.select("surplus_rows")))
    for fk in FOREIGN_KEYS:
        if fk.child in tables and fk.parent in tables:
            missing = relate.orphan_summary(
                tables[fk.child], fk.child_key, tables[fk.parent], fk.parent_key
            ).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("surplus_rows"))
            parts.append((f"{fk.child}.{fk.child_key} exists in {fk.parent}", missing))
    violations = F.col("surplus_rows").alias("violations")
    return stack_up([df.select(F.lit(name).alias("rule"), violations) for name, df in parts])


def delete_users(tables: Mapping[str, DataFrame], condition: Column) -> dict[str, DataFrame]:
    """All tables after deleting users: what is theirs goes, their audit trail stays."""
    keys = [fk for fk in FOREIGN_KEYS if fk.child in tables and fk.parent in tables]
    return relate.delete_rows(tables, keys, "users", condition)


def with_merchants(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """Every transaction with the id of the merchants its free text names, if any."""
    names = merchants.select("merchant_id", F.col("name").alias("merchant_name"))
    matched = relate.look_up(transactions, "merchant", names, "merchant_name")
    return matched.drop("merchant_name")


def replay_transactions(transactions: DataFrame, users: DataFrame) -> DataFrame:
    """Every transaction with the balance it should leave, from its user's opening one.

    A stored ``balance_after`` is kept as ``stored_balance``.
    """
    return running.ledger(
        transactions.withColumnRenamed("balance_after", "stored_balance"),
        account="user_id",
        order=["transaction_id"],
        kind="transaction_type",
        amount="amount",
        credits=CREDITS,
        debits=[kind for kind in TRANSACTION_TYPES if kind not in CREDITS],
        opening=Opening(users, "user_id", "balance"),
    )
